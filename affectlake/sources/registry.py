"""Named corpora in one long shape, and job specifications.

Every loader returns ``(dataset, id, split, text, label)``: ``label`` is an
index (single), a 0/1 array (multi) or a struct of v, a and d.  Corpora that
come with their splits are read lazily.  The others need a few passes to be
split, so their parsed rows are first written to the shared folder once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affectlake.functions import labels as L
from affectlake.functions import text as T
from affectlake.operators.annotators import attach_transcripts
from affectlake.operators.splits import (
    stratified_split, train_valid_split, train_valid_test_split,
)
from affectlake.session import saved
from affectlake.sources import files


def _text(col: str, cleaner: Callable[[str], Column], clean: bool) -> Column:
    return (cleaner(col) if clean else F.col(col)).alias("text")


def _long(df: DataFrame, dataset: str, id_col: str, text: Column, label: Column) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), F.col(id_col).cast("string").alias("id"), "split", text, label.alias("label"))


def load_vad_corpus(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    corpus = files.read_vad_corpus(spark, f"{path}/emobank.csv").filter(F.col("split").isin("train", "dev", "test"))
    corpus = corpus.withColumn("split", F.when(F.col("split") == "dev", "valid").otherwise(F.col("split")))
    return _long(corpus, "emobank", "id", _text("text", T.clean_basic, clean), L.vad_struct("V", "A", "D"))


def load_tweets(spark: SparkSession, path: str, clean: bool = True, html: str = "native") -> DataFrame:
    rows = files.read_tweets(spark, path)
    return _long(
        rows, "semeval", "ID", _text("Tweet", lambda c: T.clean_tweet(c, html), clean),
        L.columns_to_multi_hot(L.TWEET_LABELS),
    )


def load_statements(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Rows carry no id: it is the file's name and the row's number in it."""
    sheet = files.read_statements(spark, path, places=True)
    rows = saved(sheet.withColumn("id", F.concat_ws(":", "file", "row_no")).drop("file", "row_no"))
    split = stratified_split(rows, "id", "Field1", 0.15, 0.15)
    return _long(
        split, "isear", "id", _text("SIT", T.clean_statement, clean),
        L.label_index("Field1", L.STATEMENT_LABELS),
    )


def load_stance_tweets(
    spark: SparkSession, path: str, clean: bool = True, skip_first: int = files.STANCE_SKIPPED
) -> DataFrame:
    """Validation rows come from the training file only, which may be a folder of parts in order."""
    def read(name, skip):
        rows = files.read_stance_tweets(spark, f"{path}/{files.STANCE_FILES[name]}")
        columns = rows.columns
        numbered = files.with_row_numbers(rows, across=True).filter(F.col("row_no") > skip)
        return numbered.select(*columns, F.concat(F.lit(f"{name}:"), "row_no").alias("id"))

    train = train_valid_split(saved(read("train", skip_first)), "id")
    rows = train.unionByName(read("test", 0).withColumn("split", F.lit("test")))
    hot = F.array(*[T.is_own_name(name, name) for name in L.STANCE_LABELS])
    return _long(rows, "ssec", "id", _text("text", T.clean_basic, clean), hot)


def _load_forum(spark: SparkSession, path: str, dataset: str, names: list[str], clean: bool) -> DataFrame:
    rows = files.read_forum_posts(spark, path)
    return _long(
        rows, dataset, "Alpha", _text("Text", T.clean_basic, clean),
        L.multi_hot(T.int_list("Label"), len(names)),
    )


def load_forum_posts(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    return _load_forum(spark, path, "goemotions", L.FORUM_LABELS, clean)


def load_ekman_posts(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    return _load_forum(spark, path, "ekman", L.EKMAN_LABELS, clean)


def dialogue_rows(spark: SparkSession, path: str) -> DataFrame:
    """Evaluated utterances of the nine known emotions with their transcripts."""
    evaluations = files.parse_evaluations(
        files.read_whole_files(spark, files.dialogue_folders(path, "evaluations"))
    )
    transcripts = files.parse_transcripts(
        files.read_whole_files(spark, files.dialogue_folders(path, "transcripts"))
    )
    named = evaluations.withColumn("emotion", L.rename_codes("emotion"))
    return attach_transcripts(named.filter(F.col("emotion").isin(L.DIALOGUE_LABELS)), transcripts)


def load_dialogue_categories(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    rows = train_valid_test_split(saved(dialogue_rows(spark, path)), "id")
    return _long(
        rows, "iemocap-cat", "id", _text("transcription", T.clean_dialogue, clean), F.col("emotion")
    )


def load_dialogue_vad(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    rows = train_valid_test_split(saved(dialogue_rows(spark, path)), "id")
    return _long(
        rows, "iemocap-vad", "id", _text("transcription", T.clean_dialogue, clean),
        L.vad_struct("v", "a", "d"),
    )


LOADERS: dict[str, Callable[..., DataFrame]] = {
    "emobank": load_vad_corpus,
    "semeval": load_tweets,
    "isear": load_statements,
    "ssec": load_stance_tweets,
    "goemotions": load_forum_posts,
    "ekman": load_ekman_posts,
    "iemocap-cat": load_dialogue_categories,
    "iemocap-vad": load_dialogue_vad,
}
LABEL_KINDS = {
    "emobank": "vad", "semeval": "multi", "isear": "single", "ssec": "multi",
    "goemotions": "multi", "ekman": "multi", "iemocap-cat": "single", "iemocap-vad": "vad",
}
LABEL_LISTS = {
    "emobank": L.VAD_AXES, "semeval": L.TWEET_LABELS, "isear": L.STATEMENT_LABELS,
    "ssec": L.STANCE_LABELS, "goemotions": L.FORUM_LABELS, "ekman": L.EKMAN_LABELS,
    "iemocap-cat": L.DIALOGUE_LABELS, "iemocap-vad": L.VAD_AXES,
}


def load_corpus(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(LOADERS)}")
    return LOADERS[name](spark, path, **options)


# What a job specification may hold.
ALLOWED = {
    "task": ["category-classification", "vad-regression", "vad-from-categories"],
    "model": ["bert", "roberta"],
    "dataset": list(LOADERS),
    "load_model": ["pretrained_lm", "fine_tuned_lm"],
    "label_type": ["categorical", "dimensional"],
    "optimizer_type": ["legacy", "trans"],
}


def read_job_schema() -> str:
    return ", ".join([f"{k} string" for k in ALLOWED] + [
        "load_dataset string", "load_task string", "csv_file_name string", "use_emd boolean",
        "max_seq_len int", "train_batch_size int", "eval_batch_size int", "few_shot_ratio double",
        "max_freeze_epoch int", "max_epoch int", "save_dir string",
    ])


def read_job(spark: SparkSession, path: str) -> DataFrame:
    """A JSON job specification as one row."""
    return spark.read.schema(read_job_schema()).option("multiLine", True).json(path)


def job_violations(jobs: DataFrame) -> DataFrame:
    """``(field, value)`` for every field outside its allowed values."""
    cells = F.array(*[
        F.struct(F.lit(k).alias("field"), F.col(k).alias("value"), F.coalesce(F.col(k).isin(v), F.lit(False)).alias("ok"))
        for k, v in ALLOWED.items()
    ])
    return jobs.select(F.inline(cells)).filter(~F.col("ok")).select("field", "value")
