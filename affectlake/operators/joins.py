"""Equality joins of corpora, metadata and key lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from affectlake.operators.ranking import small_join


def with_metadata(corpus: DataFrame, meta: DataFrame, id_col: str = "id") -> DataFrame:
    """Corpus rows that have metadata, with its columns; the optimizer picks the join."""
    return corpus.join(meta, id_col, "inner")


def select_keys(df: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in a key list."""
    return df.join(keys.select(id_col), id_col, "left_semi")


def set_split(df: DataFrame, splits: DataFrame, id_col: str = "id") -> DataFrame:
    """Give the listed ids a new split value; other rows keep theirs."""
    new = splits.select(id_col, F.col("split").alias("__new"))
    return df.join(new, id_col, "left").withColumn(
        "split", F.coalesce("__new", "split")
    ).drop("__new")


def keep_labels(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(labels)))


def with_label_index(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Look names up in a label table ``(label_idx, label)``; see :func:`unlisted_labels`."""
    return small_join(df, labels.select(F.col("label").alias(column), "label_idx"), [column], "inner")


def unlisted_labels(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Names, with counts, that the label table lacks (an error for the corpus)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return small_join(counts, labels.select(F.col("label").alias(column)), [column], "left_anti")
