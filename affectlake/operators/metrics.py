"""Evaluation metrics as partial aggregates; predictions are never collected.

State per class is a handful of sums, so one shuffle of class-sized rows is all
that an evaluation moves, whatever the number of predictions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affectlake.session import bounded

AXES = ("v", "a", "d")


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def _prf(tp: Column, predicted: Column, support: Column) -> list[Column]:
    return [
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, predicted + support).alias("f1"),
        _ratio(tp, predicted + support - tp).alias("jaccard"),
    ]


# ------------------------------------------------------------------ correlation

def pearson(
    df: DataFrame, predicted: Sequence[str], gold: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Pearson r and row count per axis, all axes in one aggregate.

    A constant column has no correlation (null); ``corr`` would fail on it.
    """
    pairs = list(zip(AXES, predicted, gold))

    def r(p, g):
        spread = F.sqrt(F.var_pop(p)) * F.sqrt(F.var_pop(g))
        return F.covar_pop(p, g) / F.nullif(spread, F.lit(0.0))

    aggs = [r(p, g).alias(f"r_{a}") for a, p, g in pairs]
    wide = df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    entries = [F.struct(F.lit(a).alias("axis"), F.col(f"r_{a}").alias("r")) for a, _, _ in pairs]
    return wide.select(*by, "n", F.inline(F.array(*entries)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + even * d or tiny)
        c = 1.0 + even / c or tiny
        value *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + odd * d or tiny)
        c = 1.0 + odd / c or tiny
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value / a


def p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of r; meant for the few rows of an aggregate."""

    @F.arrow_udf("double")
    def two_sided(rs, ns):
        import pyarrow as pa

        def one(r, n):
            if r is None or r != r or n < 2:
                return None
            if n == 2:
                return 1.0
            return incomplete_beta((n - 2) / 2.0, 0.5, 1.0 - min(r * r, 1.0))

        return pa.array([one(r, n) for r, n in zip(rs.to_pylist(), ns.to_pylist())], pa.float64())

    r = F.col(r) if isinstance(r, str) else r
    n = F.col(n) if isinstance(n, str) else n
    return two_sided(r.cast("double"), n.cast("long"))


def pearson_with_p(df, predicted, gold, by=()) -> DataFrame:
    return pearson(df, predicted, gold, by).withColumn("p", p_value("r", "n"))


# --------------------------------------------------------------- classification

def multi_label_counts(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class: true positives, predictions, support; per group: row averages.

    One scan and one shuffle.  The sums of the per-row ratios ride on class 0.
    """
    both = F.aggregate(F.zip_with(gold, predicted, lambda g, p: g * p), F.lit(0), lambda s, x: s + x)
    size = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    rows = df.select(
        *by, gold, predicted, both.alias("__i"), size(gold).alias("__g"), size(predicted).alias("__p")
    )
    flat = rows.select(
        *by, "__i", "__g", "__p",
        F.posexplode(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p"))).alias("label_idx", "e"),
    )
    i, g, p = F.col("__i"), F.col("__g"), F.col("__p")

    def once(value):
        return F.sum(F.when(F.col("label_idx") == 0, value))

    return flat.groupBy(*by, "label_idx").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("e.g") * F.col("e.p")).alias("tp"),
        F.sum("e.p").alias("predicted"),
        F.sum("e.g").alias("support"),
        once(_ratio(i, p)).alias("s_precision"),
        once(_ratio(i, g)).alias("s_recall"),
        once(_ratio(2 * i, g + p)).alias("s_f1"),
        once(_ratio(i, g + p - i)).alias("s_jaccard"),
        once(F.when((g == p) & (g == i), 1.0).otherwise(0.0)).alias("s_exact"),
    )


def single_label_counts(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class counts from the K x K confusion table.

    Classes seen in neither gold nor prediction do not appear.
    """
    table = df.groupBy(*by, F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("g").alias("label_idx"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("p").alias("label_idx"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("support")),
    )
    return (
        table.select(*by, F.inline(sides))
        .groupBy(*by, "label_idx")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    )


def per_class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, Jaccard and support of each class."""
    ratios = _prf(F.col("tp"), F.col("predicted"), F.col("support"))
    return counts.select(*by, "label_idx", *ratios, "support")


def averages(counts: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Micro, macro and weighted averages, plus row averages or accuracy.

    ``counts`` is class-sized.  Returns ``(*by, average, precision, recall, f1,
    jaccard)``.  The row ``accuracy`` repeats one value: the share of rows whose
    prediction equals the gold label (single) or the whole label set (multi).
    """
    names = ("precision", "recall", "f1", "jaccard")
    extra = [c for c in counts.columns if c.startswith("s_")] + (["n_rows"] if kind == "multi" else [])
    rows = counts.select(
        *by, "label_idx", "tp", "predicted", "support", *extra,
        *_prf(F.col("tp"), F.col("predicted"), F.col("support")),
    )
    sums = [F.sum(c).alias(f"t_{c}") for c in ("tp", "predicted", "support")]
    sums += [F.avg(c).alias(f"macro_{c}") for c in names]
    sums += [
        _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names
    ]
    if kind == "multi":
        sums += [(F.sum(f"s_{c}") / F.max("n_rows")).alias(f"samples_{c}") for c in (*names, "exact")]
    wide = rows.groupBy(*by).agg(*sums)
    micro = _prf(F.col("t_tp"), F.col("t_predicted"), F.col("t_support"))
    wide = wide.select("*", *[c.alias(f"micro_{n}") for c, n in zip(micro, names)])
    kinds = ["micro", "macro", "weighted"] + (["samples"] if kind == "multi" else [])
    entries = [
        F.struct(F.lit(k).alias("average"), *[F.col(f"{k}_{n}").alias(n) for n in names]) for k in kinds
    ]
    if kind == "multi":
        exact = F.col("samples_exact")
    else:
        exact = _ratio(F.col("t_tp"), F.col("t_support"))
    entries.append(F.struct(F.lit("accuracy").alias("average"), *[exact.alias(n) for n in names]))
    return wide.select(*by, F.inline(F.array(*entries)))


def accuracy(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"))


# --------------------------------------------------------------- one entry point

def evaluate(
    df: DataFrame,
    kind: str,
    gold: Sequence[str] | str,
    predicted: Sequence[str] | str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Long metric table ``(*by, metric_group, name, metric, value)`` in one pass.

    ``kind`` is ``vad`` (r and p per axis), ``multi`` or ``single`` (classes,
    averages, and for multi the Jaccard scores).
    """
    if kind == "vad":
        scored = pearson_with_p(df, predicted, gold, by)
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("r", "p")])
        return scored.select(
            *by, F.lit("correlation").alias("metric_group"), F.concat("axis", F.lit("_cor")).alias("name"), F.inline(pairs)
        )
    if kind not in ("multi", "single"):
        raise ValueError(f"kind must be vad, multi or single, not {kind!r}")
    counter = multi_label_counts if kind == "multi" else single_label_counts
    counts, _ = bounded(counter(df, gold, predicted, by))
    report = ("precision", "recall", "f1")

    def unpivot(frame, name, metrics, group):
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return frame.select(*by, F.lit(group).alias("metric_group"), name.alias("name"), F.inline(pairs))

    means = averages(counts, kind, by)
    out = unpivot(per_class_report(counts, by), F.col("label_idx").cast("string"), (*report, "support"), "class")
    # The micro average of single labels is the accuracy, which stands on its own.
    shown = ("micro", "macro", "weighted", "samples") if kind == "multi" else ("macro", "weighted")
    out = out.unionByName(unpivot(means.filter(F.col("average").isin(*shown)), F.col("average"), report, "average"))
    if kind == "multi":
        scores = means.filter("average in ('micro', 'macro', 'samples')")
        return out.unionByName(unpivot(scores, F.col("average"), ("jaccard",), "jaccard"))
    exact = means.filter("average = 'accuracy'").withColumn("accuracy", F.col("f1"))
    return out.unionByName(unpivot(exact, F.lit("all"), ("accuracy",), "accuracy"))


def check_sizes(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Do all rows hold as many predictions as labels?"""
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.size(gold) != F.size(predicted)).alias("n_different"),
    ).withColumn("ok", F.col("n_different") == 0)


def mean_loss(df: DataFrame, loss: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"))


def batch_scaled_loss(df: DataFrame, loss: str, batch: str = "batch_id") -> DataFrame:
    """Sum of the batch means over the number of rows."""
    batches = df.groupBy(batch).agg(F.avg(loss).alias("m"), F.count("*").alias("n"))
    return batches.agg((F.sum("m") / F.sum("n")).alias("loss"))


def result_row(metrics: DataFrame, by: str, wanted: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Pivot chosen metrics of each split into one row of named columns."""
    aggs = [
        F.max(F.when((F.col("metric_group") == g) & (F.col("name") == n) & (F.col("metric") == m) & (F.col(by) == split), F.col("value"))).alias(f"{split}_{out}")
        for split in ("valid", "test")
        for out, (g, n, m) in wanted.items()
    ]
    return bounded(metrics.agg(*aggs))[0]
