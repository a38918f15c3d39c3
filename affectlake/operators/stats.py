"""Corpus statistics: counts, relative frequencies, label entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from affectlake.functions.rounding import round_even
from affectlake.session import bounded

SPLITS = ("train", "valid", "test")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def relative_frequencies(
    df: DataFrame, category: str, split: str = "split", names: Sequence[str] = SPLITS
) -> DataFrame:
    """Share of each category within each split, splits as columns, three decimals.

    A category that a split lacks has no share there (null).
    """
    counts = df.groupBy(category).pivot(split, list(names)).agg(F.count(F.lit(1)))
    counts, _ = bounded(counts)
    totals = counts.agg(*[F.sum(n).alias(n) for n in names]).first()
    shares = [round_even(F.col(n) / F.lit(totals[n]), 3).alias(n) for n in names]
    return counts.select(category, *shares)


def split_sizes(df: DataFrame, split: str = "split", fields: Sequence[str] = ("text", "label")) -> DataFrame:
    """Number of values per split and field, with the totals over all splits."""
    counted = df.rollup(split).agg(*[F.count(f).alias(f) for f in fields])
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])
    return counted.select(F.coalesce(split, F.lit("all")).alias("split"), F.inline(entries))


def multi_hot_counts(df: DataFrame, column: str, size: int) -> DataFrame:
    """Rows per label of a 0/1 array, zero classes included, over all splits."""
    sums = df.agg(*[F.sum(F.col(column)[i]).alias(str(i)) for i in range(size)])
    entries = F.array(
        *[F.struct(F.lit(i).alias("label_idx"), F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias("n")) for i in range(size)]
    )
    return sums.select(F.inline(entries))


def index_counts(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Occurrences of each label index in index lists (or single indexes).

    An index that the label table lacks is an error.
    """
    is_list = df.schema[column].dataType.typeName() == "array"
    flat = df.select((F.explode(column) if is_list else F.col(column)).alias("label_idx"))
    counts = flat.groupBy("label_idx").agg(F.count("*").alias("n"))
    listed = labels.select("label_idx", F.lit(True).alias("__listed"))
    unlisted = F.raise_error(F.concat(F.lit("label index not listed: "), F.coalesce(F.col("label_idx").cast("string"), F.lit("null"))))
    return listed.join(counts, "label_idx", "full").select(
        "label_idx", F.when(F.col("__listed"), F.coalesce("n", F.lit(0))).otherwise(unlisted.cast("long")).alias("n")
    )


def label_entropy(counts: DataFrame, size: int) -> DataFrame:
    """Entropy (nats) of label counts, plain and over ln(K); empty classes add nothing.

    ``counts`` is label-sized: ``n`` per label.  H = ln N - sum(n ln n) / N.
    """
    n = F.col("n").cast("double")
    weighted = F.sum(F.when(n > 0, n * F.log(n)).otherwise(0.0))
    entropy = F.log(F.sum(n)) - weighted / F.sum(n)
    return counts.agg(entropy.alias("entropy")).select(
        "entropy", (F.col("entropy") / F.log(F.lit(float(size)))).alias("normalised")
    )


def empty_texts(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """How many rows of each split have no text left after cleaning."""
    return df.groupBy(split).agg(F.count_if(F.coalesce(F.col(text), F.lit("")) == "").alias("n_empty"))


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that still have text; a null text counts as empty.

    An explode of a list of none or one text, because a plain filter moves
    below the cleaning and so cleans every text twice.
    """
    kept = F.explode(F.filter(F.array(F.col(text)), lambda t: t != "")).alias(text)
    return df.select(*[kept if c == text else F.col(c) for c in df.columns])


def single_counts(df: DataFrame, column: str, size: int) -> DataFrame:
    """Rows per label index, zero classes included; an index outside the labels is an error."""
    listed = df.sparkSession.range(size).select(F.col("id").cast("int").alias("label_idx"))
    return index_counts(df, column, listed)


def corpus_stats(df: DataFrame, dataset: str, size: int, kind: str = "multi") -> DataFrame:
    """``(dataset, split, stat, label_idx, value)`` of a corpus with multi-hot or single labels."""
    sizes = split_sizes(df).select(
        "split", F.concat(F.lit("n_"), F.col("field")).alias("stat"),
        F.lit(None).cast("int").alias("label_idx"), F.col("n").cast("double").alias("value"),
    )
    counts = single_counts(df, "label", size) if kind == "single" else multi_hot_counts(df, "label", size)
    labels = counts.select(
        F.lit("all").alias("split"), F.lit("label_count").alias("stat"),
        F.col("label_idx").cast("int"), F.col("n").cast("double").alias("value"),
    )
    pair = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in ("entropy", "normalised")])
    entropy = label_entropy(counts, size).select(F.inline(pair)).select(
        F.lit("all").alias("split"), "stat", F.lit(None).cast("int").alias("label_idx"), "value"
    )
    return sizes.unionByName(labels).unionByName(entropy).select(F.lit(dataset).alias("dataset"), "*")
