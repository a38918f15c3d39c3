"""Corpus files and the append-only result log."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

META_COLUMNS = ("document", "category", "subcategory")

# Column layouts of the result log, in order, and what names a row.
RUN_COLUMNS = ["epoch", "file_name", "n_updates", "valid_size", "test_size", "valid_loss", "test_loss"]
LOG_KEYS = ("file_name", "epoch")
METRIC_COLUMNS = {
    "vad": ["v", "v_p", "a", "a_p", "d", "d_p"],
    "multi": ["microF1", "macroF1", "jaccard_micro", "jaccard_macro", "acc"],
    "single": ["macroF1", "weightF1", "acc"],
}
# Where each logged metric stands in the long metric table.
METRIC_SOURCES = {
    "vad": {
        "v": ("correlation", "v_cor", "r"), "v_p": ("correlation", "v_cor", "p"),
        "a": ("correlation", "a_cor", "r"), "a_p": ("correlation", "a_cor", "p"),
        "d": ("correlation", "d_cor", "r"), "d_p": ("correlation", "d_cor", "p"),
    },
    "multi": {
        "microF1": ("average", "micro", "f1"), "macroF1": ("average", "macro", "f1"),
        "jaccard_micro": ("jaccard", "micro", "jaccard"),
        "jaccard_macro": ("jaccard", "macro", "jaccard"),
        "acc": ("jaccard", "samples", "jaccard"),
    },
    "single": {
        "macroF1": ("average", "macro", "f1"), "weightF1": ("average", "weighted", "f1"),
        "acc": ("accuracy", "all", "accuracy"),
    },
}


def _csv(df: DataFrame, path: str, quote_all: bool, mode: str) -> None:
    """Text is kept as it is: no trimming, quotes doubled, newlines allowed."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_split_corpus(df: DataFrame, path: str, form: str = "csv", mode: str = "errorifexists") -> None:
    """The corpus without metadata, as ``id, split, V, A, D, text``.

    Parquet is partitioned by split, so that reading one split skips the others.
    """
    out = df.drop(*META_COLUMNS).select("id", "split", "V", "A", "D", "text")
    if form == "parquet":
        out.write.mode(mode).partitionBy("split").parquet(path)
    else:
        _csv(out, path, False, mode)


def write_named_files(rows: DataFrame) -> None:
    """Every row ``(folder, name, value)`` as a text file of its own, written by the task that holds the row.

    Folders are on a mount that all executors share.  A file gets its name once it is whole,
    so a task that is tried again, or runs twice, leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for folder, name, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                part = f"{folder}/_{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(value.encode() + b"\n")
                os.replace(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("folder", "name", "value").mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def write_combined_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Combined annotations with all fields quoted."""
    _csv(df.select("id", "V", "A", "D", "text"), path, True, mode)


def layout_of(prediction_type: str, dataset: str) -> str:
    """Which log layout an evaluation uses."""
    if prediction_type == "vad":
        return "vad"
    return "single" if dataset == "isear" else "multi"


def layout_columns(layout: str) -> list[str]:
    metrics = METRIC_COLUMNS[layout]
    return RUN_COLUMNS + [f"{s}_{m}" for s in ("valid", "test") for m in metrics]


def layout_schema(layout: str) -> str:
    types = ["int", "string", "int", "long", "long", "double", "double"]
    columns = layout_columns(layout)
    return ", ".join(f"{c} {t}" for c, t in zip(columns, types + ["double"] * len(columns)))


def log_evaluation(row: DataFrame, layout: str, path: str, form: str = "parquet") -> bool:
    """Put one typed row into a result log; an evaluation without metrics is skipped.

    The log has a folder per run (``file_name``) and epoch, and a row takes the place of
    an earlier one of its run and epoch: an append that is tried again adds nothing.
    CSV parts carry no header; :func:`export_log` makes one file with one header.
    """
    names = layout_columns(layout)
    if any(c not in row.columns for c in names):
        return False
    types = dict(part.rsplit(" ", 1) for part in layout_schema(layout).split(", "))
    typed = row.select(*[F.col(c).cast(types[c]).alias(c) for c in names]).coalesce(1)
    writer = typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LOG_KEYS)
    writer.format(form).save(path)
    return True


def read_log(spark: SparkSession, layout: str, path: str, form: str = "parquet") -> DataFrame:
    """The log's rows in the order of its columns; a log that nothing was written to is empty."""
    schema = layout_schema(layout)
    try:
        stored = spark.read.schema(schema).format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return stored.select(*layout_columns(layout))


def export_log(log: DataFrame, path: str) -> None:
    """A result log, a row per run and epoch, as one CSV file with one header."""
    _csv(log.orderBy(*LOG_KEYS).coalesce(1), path, False, "overwrite")
