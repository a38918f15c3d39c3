"""Exact-size, deterministic splits.

A row's place is fixed by the md5 of its id and a seed.  Sizes and per-stratum
counts are exact, parts are disjoint and complete, and nothing depends on the
layout of the data.  Ids must be unique and not null: a null id, and a repeated id at
a cut, are errors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from affectlake.operators.ranking import (
    cut_keys, hash_key, rank_threshold, ranked_by, small_join, skip_first, take_first,
)
from affectlake.session import bounded


def held_out_quotas(sizes: DataFrame, stratum: str, held_out: int, total: int, name: str) -> DataFrame:
    """Largest-remainder shares of ``held_out`` among strata with ``left`` rows each.

    Whole-number arithmetic; equal remainders go to the smaller stratum value.  Few strata
    are ranked in one window.  Of many, the one at the last place that gets a row more is
    found by :func:`rank_threshold`: strata may be as many as rows, and no task sees them all.
    """
    sizes, few = bounded(sizes)
    shares = sizes.withColumn("__base", F.expr(f"(left * {held_out}) div {total}"))
    rest = F.expr(f"(left * {held_out}) % {total}")
    if few:
        ranked = shares.withColumn("__rest", rest)
        missing = F.lit(held_out) - F.sum("__base").over(Window.partitionBy())
        place = F.row_number().over(Window.orderBy(F.desc("__rest"), F.asc(stratum)))
        return ranked.withColumn(name, F.col("__base") + F.when(place <= missing, 1).otherwise(0)).drop("__base", "__rest")
    # Larger remainders first, then null, then the strata in order.
    order = F.concat(F.lpad((F.lit(total) - rest).cast("string"), 19, "0"), F.when(F.col(stratum).isNull(), "0").otherwise("1"),
                     F.coalesce(_sortable(shares.schema[stratum].dataType, F.col(stratum)), F.lit("")))
    shares = shares.withColumn("__order", order)
    missing = held_out - (shares.agg(F.sum("__base")).first()[0] or 0)
    edge = rank_threshold(shares, "__order", missing) if missing else None
    more = F.lit(0) if edge is None else F.when(F.col("__order") <= edge, 1).otherwise(0)
    return shares.withColumn(name, F.col("__base") + more).drop("__base", "__order")


def _sortable(kind: T.DataType, stratum: Column) -> Column:
    """A text in the order of the values: whole numbers shifted and padded, texts as they are."""
    if isinstance(kind, T.IntegralType):
        return F.lpad((stratum.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    if isinstance(kind, (T.StringType, T.BooleanType, T.DateType, T.TimestampType)):
        return stratum.cast("string")
    raise ValueError(f"many strata must be texts, whole numbers or dates, not {kind.simpleString()}")


def _assign(
    df: DataFrame, key: str, strata: Sequence[str], cuts: DataFrame, names: Sequence[str], rest: str, rows: int
) -> DataFrame:
    """Compare every row's hash with the cut keys of its stratum."""
    found = cut_keys(df, key, strata, cuts, rows)
    if strata:
        wide = found.groupBy(*strata).pivot("cut", list(names)).agg(F.first("key"))
        out = small_join(df, wide, strata, "left")
        edges = [F.col(n) for n in names]
    else:
        at = {r["cut"]: r["key"] for r in found.collect()}
        out, edges = df, [F.lit(at.get(n)).cast("string") for n in names]
    split = F.lit(rest)
    for name, edge in reversed(list(zip(names, edges))):
        split = F.when(F.col(key) <= edge, F.lit(name)).otherwise(split)
    return out.withColumn("split", split).drop(key, *(names if strata else []))


def stratified_split(
    df: DataFrame,
    id_col: str,
    stratum: str,
    test_size: int | float,
    valid_size: int | float,
    seed: int = 42,
    rest: str = "train",
    names: Sequence[str] = ("test", "valid"),
) -> DataFrame:
    """Hold out exact numbers of rows, proportional per stratum.

    Whole numbers are row counts: first the test rows of the table, then the
    valid rows of what is left.  Fractions are taken in the other order: a part
    ``test_size + valid_size`` is held out (rounded up), then shared.
    """
    total_sizes = df.groupBy(stratum).agg(F.count("*").alias("left"))
    sizes, _ = bounded(total_sizes)
    rows = sizes.agg(F.sum("left")).first()[0] or 0
    if isinstance(test_size, float):
        held = math.ceil((test_size + valid_size) * rows)
        n_test = math.ceil(test_size / (test_size + valid_size) * held)
        n_valid = held - n_test
        quotas = held_out_quotas(sizes, stratum, held, rows, "held")
        quotas = quotas.withColumn("left", F.col("held"))
        quotas = held_out_quotas(quotas, stratum, n_test, held, "n_test")
        quotas = quotas.withColumn("n_valid", F.col("held") - F.col("n_test"))
    else:
        n_test, n_valid = test_size, valid_size
        quotas = held_out_quotas(sizes, stratum, n_test, rows, "n_test")
        quotas = quotas.withColumn("left", F.col("left") - F.col("n_test"))
        quotas = held_out_quotas(quotas, stratum, n_valid, rows - n_test, "n_valid")
    edges = F.array(
        F.struct(F.lit(names[0]).alias("cut"), F.col("n_test").cast("long").alias("k")),
        F.struct(F.lit(names[1]).alias("cut"), (F.col("n_test") + F.col("n_valid")).cast("long").alias("k")),
    )
    cuts = quotas.select(stratum, F.explode(edges).alias("e")).select(stratum, "e.cut", "e.k")
    keyed = df.withColumn("__key", hash_key(id_col, seed))
    return _assign(keyed, "__key", [stratum], cuts, names, rest, rows)


def shuffled_split(
    df: DataFrame, id_col: str, sizes: dict[str, int], rest: str, rows: int, seed: int = 42
) -> DataFrame:
    """Unstratified split: consecutive runs of the hash order, the rest last."""
    spark, edge, edges = df.sparkSession, 0, []
    for name, size in sizes.items():
        edge += size
        edges.append((name, edge))
    cuts = spark.createDataFrame(edges, "cut string, k long")
    keyed = df.withColumn("__key", hash_key(id_col, seed))
    return _assign(keyed, "__key", [], cuts, list(sizes), rest, rows)


def train_valid_split(df: DataFrame, id_col: str, valid_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Unstratified train/valid; the valid part is rounded up."""
    rows = df.count()
    return shuffled_split(df, id_col, {"valid": math.ceil(valid_share * rows)}, "train", rows, seed)


def train_valid_test_split(
    df: DataFrame, id_col: str, train: float = 0.8, valid: float = 0.1, seed: int = 42
) -> DataFrame:
    """Shuffle, then cut; train and valid are rounded down, test is the rest."""
    rows = df.count()
    sizes = {"train": int(rows * train), "valid": int(rows * valid)}
    return shuffled_split(df, id_col, sizes, "test", rows, seed)


def few_shot(df: DataFrame, id_col: str, share: float) -> DataFrame:
    """The first part of the table by id, not a sample."""
    return df if share == 1 else take_first(df, id_col, int(df.count() * share))


def epoch_order(df: DataFrame, id_col: str, epoch: int, seed: int = 42) -> DataFrame:
    """Every row's position in a shuffled epoch, the same on every run."""
    keyed = df.withColumn("__key", hash_key(id_col, f"{epoch}#{seed}"))
    return ranked_by(keyed, "__key", "position", hashed=True).drop("__key")


def sequential_batches(df: DataFrame, id_col: str, batch_size: int) -> DataFrame:
    """Consecutive batches in id order; the short last batch is kept."""
    ranked = ranked_by(df, id_col, "__rank")
    batch = F.floor((F.col("__rank") - 1) / F.lit(batch_size)).cast("long")
    return ranked.withColumn("batch_id", batch).drop("__rank")


def compare_splits(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Per split name: do both assignments hold the same ids?"""
    a = left.select(id_col, F.col("split").alias("a"))
    b = right.select(id_col, F.col("split").alias("b"))
    both = a.join(b, id_col, "full")
    sides = F.array_distinct(F.array_compact(F.array("a", "b")))
    return (
        both.select(F.explode(sides).alias("split"), F.col("a").eqNullSafe(F.col("b")).alias("ok"))
        .groupBy("split")
        .agg(F.bool_and("ok").alias("same"))
    )


__all__ = [
    "held_out_quotas", "stratified_split", "shuffled_split", "train_valid_split",
    "train_valid_test_split", "few_shot", "epoch_order", "sequential_batches",
    "compare_splits", "skip_first",
]
