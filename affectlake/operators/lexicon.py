"""Word lexicon, label coordinates, and the order of labels along each axis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from affectlake.functions.rounding import round_even
from affectlake.operators.ranking import small_join

AXES = ("v", "a", "d")


def lexicon_scores(raw: DataFrame, line: str = "line_no", only: DataFrame | None = None) -> DataFrame:
    """One row per word with scores rounded to three places; the last line wins.

    Three aggregates of plain numbers hash; one of a struct would sort all lines.  With
    ``only``, a table of labels, other words are left out in the scan: nothing but the
    lines of those labels is aggregated or shuffled.
    """
    if only is not None:
        raw = small_join(raw, only.select(F.col("label").alias("word")).distinct(), ["word"], "left_semi")
    last = [F.max_by(a, line).alias(a) for a in AXES]
    return raw.groupBy("word").agg(*last).select("word", *[round_even(a, 3).alias(a) for a in AXES])


def label_coordinates(labels: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Scores of label names; a missing word or a dimensional label set is an error.

    ``labels`` is the label list (``label_idx``, ``label``), so it is the side
    that is broadcast; the lexicon is scanned once and never shuffled.
    """
    words = lexicon.withColumnRenamed("word", "label")
    found = small_join(words, labels.select("label", "label_idx"), ["label"], "inner")
    listed = labels.select("label_idx", "label").join(
        found.select("label_idx", *AXES), "label_idx", "left"
    )
    bad = F.col("v").isNull() | (F.col("label") == "V")
    problem = F.raise_error(F.concat(F.lit("no coordinates for label: "), F.col("label")))
    return listed.withColumn("v", F.when(bad, problem.cast("double")).otherwise(F.col("v")))


def unknown_labels(labels: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Label names without a lexicon entry."""
    words = lexicon.select(F.col("word").alias("label"))
    return labels.select("label_idx", "label").join(words, "label", "left_anti")


def long_axes(labels: DataFrame) -> DataFrame:
    """``(label_idx, label, axis, score)``, three rows per label."""
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("score")) for a in AXES])
    return labels.select("label_idx", "label", F.inline(entries))


def label_order(labels: DataFrame) -> DataFrame:
    """Position of every label on every axis, both ways.

    ``position`` is where a label stands in sorted order (ties by label index),
    ``label_idx`` is which label stands at a position.
    """
    order = Window.partitionBy("axis").orderBy("score", "label_idx")
    return long_axes(labels).withColumn("position", F.row_number().over(order) - 1)


def gap_weights(labels: DataFrame, mode: str = "reference") -> DataFrame:
    """Distance from each sorted label to the next one along its axis.

    The last label's gap wraps to the first and then counts as 0.  A zero gap
    takes the unmodified gap after it, so a tie of the two largest labels takes
    the negative wrap-around gap; ``mode="safe"`` gives 0 there.  An axis where
    all labels are equal is an error.
    """
    if mode not in ("reference", "safe"):
        raise ValueError(f"mode must be reference or safe, not {mode!r}")
    order = Window.partitionBy("axis").orderBy("position")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("score").over(order), F.first("score").over(whole))
    last = F.col("position") == F.max("position").over(whole)
    gaps = label_order(labels).withColumn("__last", last)
    gaps = gaps.withColumn("__raw", after - F.col("score"))
    gaps = gaps.withColumn("__next", F.lead("__raw").over(order))
    gaps = gaps.withColumn("__next_last", F.lead("__last").over(order))
    filled = F.col("__next")
    if mode == "safe":
        filled = F.when(F.col("__next_last"), 0.0).otherwise(filled)
    equal = F.raise_error(F.concat(F.lit("all labels are equal on axis "), F.col("axis")))
    weight = (
        F.when(F.col("__last") & (F.col("__raw") == 0), equal.cast("double"))
        .when(F.col("__last"), 0.0)
        .when(F.col("__raw") == 0, filled)
        .otherwise(F.col("__raw"))
    )
    return gaps.withColumn("gap", weight).drop("__last", "__raw", "__next", "__next_last")


@dataclass(frozen=True)
class LabelAxes:
    """Driver-side constants of a label list: K entries per axis, no more."""

    names: list[str]
    orders: list[list[int]]
    scores: list[list[float]]
    gaps: list[list[float]]

    @property
    def size(self) -> int:
        return len(self.names)


def label_axes(labels: DataFrame, mode: str = "reference") -> LabelAxes:
    """Collect the label-sized tables once, for use as constants in row functions."""
    rows = gap_weights(labels, mode).collect()
    per_axis = [sorted((r for r in rows if r["axis"] == a), key=lambda r: r["position"]) for a in AXES]
    named = sorted(per_axis[0], key=lambda r: r["label_idx"])
    return LabelAxes(
        [r["label"] for r in named],
        [[r["label_idx"] for r in axis] for axis in per_axis],
        [[r["score"] for r in axis] for axis in per_axis],
        [[r["gap"] for r in axis] for axis in per_axis],
    )


def running_sum(value: Column | str, group: list[str], position: str) -> Column:
    """Cumulative sum along the sorted labels of one row (at most K entries)."""
    frame = Window.partitionBy(*group).orderBy(position)
    return F.sum(value).over(frame.rowsBetween(Window.unboundedPreceding, Window.currentRow))
