"""Queries of the operators that scan texts: language ID, decontamination, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affectlake.llm import decontamination, language, licenses, secrets
from affectlake.llm.common import table
from affectlake.llm.registry import query


@query("op4_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    judged = language.predict(docs.select("doc_id", "text"), model)
    return judged.select(
        "row.doc_id", language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score"
    )


@query("op5_benchmark_passages", r"""
    with i as (
        select item_id::varchar as item, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from benchmark where item_id is not null
    ), p as (
        select distinct item, least(len(w), 10) as n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') as passage
        from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)
    ), d as (
        select row_number() over () as r, doc_id, coalesce(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
        from documents
    ), x as (
        select r, n, s, array_to_string(w[s : s + n - 1], ' ') as passage
        from (select d.r, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) as s
              from d, (select distinct n from p) l where len(d.w) >= l.n)
    ), h as (
        select x.r, x.s, x.n, p.item from x join p on x.n = p.n and x.passage = p.passage
    ), k as (
        select r, count(distinct word) as n_hit
        from (select r, unnest(range(s, s + n)) as word from (select distinct r, s, n from h)) group by r
    ), m as (
        select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from h group by r
    )
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_hit, 0)::bigint as n_hit,
           coalesce(m.n_items, 0)::bigint as n_items, sha256(coalesce(m.ids, '')) as items_sha256,
           coalesce(k.n_hit, 0) > 0 as contaminated
    from d left join k using (r) left join m using (r)
    """)
def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    n_hit = decontamination.hit_words("spans")
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op6_license_scan")
def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.labels(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "row.doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"), F.array_max("base_starts").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
    )


@query("op8_secret_scan")
def secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate, judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    trees = secrets.train(secrets.labelled_findings(docs))
    found = secrets.scan(docs, trees).select("row.doc_id", F.inline("findings"))
    return found.withColumnsRenamed({"start": "start_char", "end": "end_char", "secret": "is_secret"})
