"""Reconciling annotators, extreme rows and shape checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from affectlake.functions.rounding import round_even

SCORES = ("V", "A", "D")


def common_ids(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that both tables hold."""
    return left.select(id_col).intersect(right.select(id_col))


def combine_perspectives(reader: DataFrame, writer: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean of two annotator tables weighted by their rater counts, two decimals.

    Only ids that both tables hold are kept.
    """
    r = reader.select(id_col, *[F.col(c).alias(f"r{c}") for c in (*SCORES, "N")])
    w = writer.select(id_col, *[F.col(c).alias(f"w{c}") for c in (*SCORES, "N")])
    raters = F.col("rN") + F.col("wN")
    means = [
        round_even((F.col(f"r{c}") * F.col("rN") + F.col(f"w{c}") * F.col("wN")) / raters, 2).alias(c)
        for c in SCORES
    ]
    return r.join(w, id_col, "inner").select(id_col, *means)


def combine_raters(ratings: DataFrame, perspectives: int, id_col: str = "id") -> DataFrame:
    """The same for any number of perspectives in one long table.

    ``ratings`` has one or more rows per id and ``perspective``; ids that lack a
    perspective are left out.  Sums combine before the shuffle.
    """
    sums = [F.sum(F.col(c) * F.col("N")).alias(f"s{c}") for c in SCORES]
    held = ratings.groupBy(id_col).agg(*sums, F.sum("N").alias("n"), F.size(F.collect_set("perspective")).alias("p"))
    return held.filter(F.col("p") == perspectives).select(
        id_col, *[round_even(F.col(f"s{c}") / F.col("n"), 2).alias(c) for c in SCORES]
    )


def attach_text(scores: DataFrame, raw: DataFrame, id_col: str = "id") -> DataFrame:
    """Add the raw text to every id; an id without text is an error."""
    joined = scores.join(raw.select(id_col, F.col("text").alias("__t"), F.lit(True).alias("__m")), id_col, "left")
    missing = F.raise_error(F.concat(F.lit("no text for id "), F.col(id_col).cast("string")))
    text = F.when(F.col("__m").isNull(), missing.cast("string")).otherwise(F.col("__t"))
    return joined.withColumn("text", text).drop("__t", "__m")


def missing_ids(scores: DataFrame, raw: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids without a raw text."""
    return scores.select(id_col).join(raw.select(id_col), id_col, "left_anti")


def extreme_rows(df: DataFrame, id_col: str = "id", columns: Sequence[str] = SCORES) -> DataFrame:
    """The whole row with the smallest and the largest value per column, in one pass.

    Equal values go to the first id.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    picks = []
    for c in columns:
        picks.append(F.min_by(row, F.struct(F.col(c), F.col(id_col))).alias(f"min_{c}"))
        picks.append(F.min_by(row, F.struct(-F.col(c), F.col(id_col))).alias(f"max_{c}"))
    found = df.agg(*picks)
    entries = [
        F.struct(F.lit(c).alias("axis"), F.lit(side).alias("side"), F.col(f"{side}_{c}").alias("row"))
        for c in columns
        for side in ("min", "max")
    ]
    return found.select(F.inline(F.array(*entries))).select("axis", "side", "row.*")


def check_shape(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Row and column counts against expectations: ``(check, expected, actual, ok)``."""
    counted = df.agg(F.count("*").alias("n"))
    entries = F.array(
        F.struct(F.lit("rows").alias("check"), F.lit(rows).cast("long").alias("expected"), F.col("n").alias("actual")),
        F.struct(F.lit("columns").alias("check"), F.lit(columns).cast("long").alias("expected"), F.lit(len(df.columns)).cast("long").alias("actual")),
    )
    return counted.select(F.inline(entries)).withColumn("ok", F.col("expected") == F.col("actual"))


def attach_transcripts(evaluations: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Evaluation rows with their transcript; see :func:`missing_transcripts`."""
    return evaluations.join(transcripts.select("id", "transcription"), "id", "inner")


def missing_transcripts(evaluations: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Evaluation rows that have no transcript (an error for the corpus)."""
    return evaluations.join(transcripts.select("id"), "id", "left_anti")


def relabel(mapping: Mapping[str, str], column: str):
    """Stored split names to the common ones."""
    out = F.col(column)
    for old, new in mapping.items():
        out = F.when(F.col(column) == old, new).otherwise(out)
    return out
