"""The corpus pipeline: language ID, near copies, benchmark passages, secrets, mixing.

Every stage takes and returns documents, except the last, which returns the mix: a row
per document with the words it takes.  What a stage decides is in its result:

1. Documents whose language cannot be told go: texts without a letter, or below
   LEAST_SCORE.  If no document is labelled, nothing can be told and all stay.
2. Of each group of documents linked by their shingles the smallest id stays, once.
   Two are linked if their sets of NEAR_WORDS-word shingles have a Jaccard similarity of
   NEAR_PERCENT or more; op10_ngram_join has its own contract (3 words, 90 percent).
   Rows without id cannot be named by a group and stay.
3. Documents that hold a benchmark passage go.
4. Secrets are masked in the text, and ``n_chars`` follows the text.
5. Documents are mixed to their sources' targets.

Empty tables pass through every stage; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from affectlake.llm import decontamination, language, ngram_join, secrets
from affectlake.llm.common import maybe_in
from affectlake.llm.mixing import mix
from affectlake.session import saved

LEAST_SCORE = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs)
    if not model:
        return docs
    told = language.predict(docs, model)
    return told.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = saved(ngram_join.components(docs, NEAR_WORDS, NEAR_PERCENT))
    marked = saved(linked.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")
    ).filter("n > 1 or not stays"))
    # Most documents are not marked; only possible ones are shuffled to the exact join.
    possible = maybe_in(marked, "doc_id")("doc_id") & F.col("doc_id").isNotNull()
    unmarked = docs.filter(~possible).unionByName(docs.filter(possible).join(marked, "doc_id", "left_anti"))
    repeated = docs.filter(possible).join(marked.filter("stays").select("doc_id"), "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    return unmarked.unionByName(repeated.withColumn("__first", first).filter("__first = 1").drop("__first"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_passages(docs, items)
    return found.filter(F.size("spans") == 0).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = secrets.train(secrets.labelled_findings(docs))
    found = secrets.scan(docs, trees)
    changed = F.exists("findings", lambda f: f["secret"])
    new = {
        "text": F.when(changed, F.col("masked")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.char_length("masked").cast("bigint")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("language_id", tell_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]

#: A fitted classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = saved(docs)
    return docs
