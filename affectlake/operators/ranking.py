"""Exact ranks and rank cuts without a one-task window.

A rank over a whole table, or over a stratum that holds a third of it, must not
become one sort in one task.  Rows therefore get a *bucket* that is monotone in
the sort key.  Bucket counts (a map-side combined aggregate) give each bucket
its first rank, so that only rows inside one bucket are compared.

:func:`cut_keys` goes further for splits: it needs the key *at* a rank only, so
it sorts nothing but the few buckets that contain a cut.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from affectlake.session import bounded

ROWS_PER_HASH_BUCKET = 50_000
ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 16_384
SAMPLES_PER_BUCKET = 20
GROUP = 4_096


def hash_key(key: Column | str, seed: int | str = 42) -> Column:
    """The md5 text of key and seed: the same order in every engine and layout.

    A null key is an error: such a row has no place in the order.
    """
    key = F.col(key) if isinstance(key, str) else key
    named = F.coalesce(key.cast("string"), F.raise_error(F.lit("a row without id has no place in an order")).cast("string"))
    return F.md5(F.concat(named, F.lit(f"#{seed}")))


def hash_digits(rows: int) -> int:
    """Hex digits that make buckets of at most some ten thousand rows."""
    return min(6, max(2, math.ceil(math.log(max(rows, 1) / ROWS_PER_HASH_BUCKET, 16))))


def hash_bucket(hashed: Column | str, digits: int) -> Column:
    hashed = F.col(hashed) if isinstance(hashed, str) else hashed
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def small_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe equi-join that keeps the left key columns.

    The right side is broadcast only after its row count was checked.
    """
    right, is_small = bounded(right)
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__{key}"))
    side = F.broadcast(renamed) if is_small else renamed
    return left.join(side, condition, how).drop(*[f"__{k}" for k in keys])


def cut_keys(
    df: DataFrame,
    hashed: str,
    strata: Sequence[str],
    cuts: DataFrame,
    rows: int,
) -> DataFrame:
    """The hash key found at given ranks.

    ``df`` holds the strata and the column ``hashed``; ``cuts`` holds the strata,
    ``cut`` and ``k`` (1-based rank).  Returns ``(*strata, cut, key)``.  ``rows``
    is the table's size, which sets the number of buckets.  No row is shuffled
    except those in the bucket of a cut, some ten thousand each.  Two rows with the
    key of a cut are an error: no cut could part them.
    """
    strata = list(strata)
    keyed = df.select(*strata, F.col(hashed).alias("__h")).withColumn("__b", hash_bucket("__h", hash_digits(rows)))
    counts = keyed.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    placed = _running_counts(counts, strata)
    if strata:
        hit = small_join(placed, cuts, strata, "inner")
    else:
        edges = [
            F.struct(F.lit(r["cut"]).alias("cut"), F.lit(r["k"]).cast("long").alias("k"))
            for r in cuts.collect()
        ]
        hit = placed.select("*", F.inline(F.array(*edges)))
    hit = hit.filter((F.col("k") > F.col("__upto") - F.col("__n")) & (F.col("k") <= F.col("__upto")))
    hit = hit.select(
        *strata, "__b", "cut", (F.col("k") - F.col("__upto") + F.col("__n")).alias("__local")
    )
    near = small_join(keyed, hit, [*strata, "__b"], "inner")
    order = Window.partitionBy(*strata, "__b", "cut").orderBy("__h")
    repeated = F.raise_error(F.lit("an id at a cut is repeated; ids must be unique")).cast("string")
    return (
        near.withColumn("__r", F.row_number().over(order))
        .withColumn("__key", F.when(F.lead("__h").over(order) == F.col("__h"), repeated).otherwise(F.col("__h")))
        .filter(F.col("__r") == F.col("__local"))
        .select(*strata, "cut", F.col("__key").alias("key"))
    )


def _running_counts(counts: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``__upto``: rows of a stratum in a bucket and those before it, summed in two levels.

    Buckets are summed inside groups of GROUP buckets, and the groups' sums, at most
    16 ** 6 / GROUP of a stratum, in a second window; no task sees all buckets.
    """
    grouped = counts.withColumn("__g", F.floor(F.col("__b") / GROUP))
    inside = Window.partitionBy(*strata, "__g").orderBy("__b")
    sums = grouped.groupBy(*strata, "__g").agg(F.sum("__n").alias("__sum"))
    before = Window.partitionBy(*strata).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = grouped.withColumn("__inside", F.sum("__n").over(inside))
    return small_join(within, starts, [*strata, "__g"], "inner").select(
        *counts.columns, (F.col("__before") + F.col("__inside")).alias("__upto")
    )


def _bounds(df: DataFrame, key: str, buckets: int, rows: int) -> list:
    """Bucket borders from a bounded sample; they affect balance, never results."""
    share = min(1.0, SAMPLES_PER_BUCKET * buckets / max(rows, 1))
    picked = df.select(key)
    if share < 1.0:
        picked = picked.sample(share, seed=7)
    values = sorted(r[0] for r in picked.distinct().collect() if r[0] is not None)
    step = len(values) / buckets
    return sorted({values[int(i * step)] for i in range(1, buckets) if int(i * step) < len(values)})


def _bucket_of(key: Column, bounds: list, key_type: T.DataType) -> Column:
    """How many borders are not above the key: a binary search over a constant."""
    if not bounds:
        return F.lit(0)
    listed = F.from_json(F.lit(json.dumps([str(b) for b in bounds])), T.ArrayType(T.StringType()))
    table = listed.cast(T.ArrayType(key_type))
    steps = [2**i for i in reversed(range(len(bounds).bit_length()))]
    size = len(bounds)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= size) & (F.get(table, at + step - 1) <= key), at + step
        ).otherwise(at),
    )


def ranked_by(
    df: DataFrame,
    key: str,
    rank: str = "rank",
    hashed: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the exact 1-based rank of a unique key over the whole table.

    ``hashed`` says that the key is an md5 text, whose prefix is already even;
    other keys (whole numbers or strings) get borders from a sample.
    """
    rows = df.count()
    buckets = min(MAX_BUCKETS, max(8, math.ceil(rows / rows_per_bucket)))
    if hashed:
        bucket = hash_bucket(key, max(1, math.ceil(math.log(buckets, 16))))
    else:
        bounds = _bounds(df, key, buckets, rows)
        bucket = _bucket_of(F.col(key), bounds, df.schema[key].dataType)
    placed = df.withColumn("__b", bucket)
    counts = {r["__b"]: r["n"] for r in placed.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for b in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(b, 0)
    offsets = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return placed.withColumn(rank, F.get(offsets, F.col("__b")) + inside).drop("__b")


def rank_threshold(df: DataFrame, key: str, k: int, rows_per_bucket: int = ROWS_PER_BUCKET):
    """The key value at rank ``k`` (None for k < 1), found without sorting the table.

    Each round narrows the range to the one bucket that holds the rank, until it
    is small enough to be ordered in one task.  Null keys, and a key at the rank that
    is repeated, are errors.
    """
    if df.filter(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} is null in some rows, which have no rank")
    if k < 1:
        return None
    part, rank = df.select(key), k
    while True:
        rows = part.count()
        if rank > rows:
            return part.agg(F.max(key)).first()[0]
        if rows <= rows_per_bucket:
            break
        bounds = _bounds(part, key, 256, rows)
        placed = part.withColumn("__b", _bucket_of(F.col(key), bounds, df.schema[key].dataType))
        counts = {r["__b"]: r["n"] for r in placed.groupBy("__b").agg(F.count("*").alias("n")).collect()}
        bucket = 0
        while rank > counts.get(bucket, 0):
            rank -= counts.get(bucket, 0)
            bucket += 1
        low = bounds[bucket - 1] if bucket > 0 else None
        high = bounds[bucket] if bucket < len(bounds) else None
        if low is not None:
            part = part.filter(F.col(key) >= F.lit(low))
        if high is not None:
            part = part.filter(F.col(key) < F.lit(high))
        if counts[bucket] >= rows:
            break
    edge, at_edge, up_to = part.orderBy(key).limit(rank + 1).select(
        F.col(key), F.row_number().over(Window.orderBy(key)).alias("__r")
    ).agg(
        F.max(F.when(F.col("__r") == rank, F.col(key))), F.max(F.when(F.col("__r") == rank + 1, F.col(key))), F.count("*")
    ).first()
    if up_to > rank and edge == at_edge:
        raise ValueError(f"{key} {edge!r} is repeated at the cut; keys must be unique")
    return edge


def take_first(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows ranked 1..k by a unique key."""
    edge = rank_threshold(df, key, k)
    return df.filter(F.lit(False)) if edge is None else df.filter(F.col(key) <= F.lit(edge))


def skip_first(df: DataFrame, key: str, k: int) -> DataFrame:
    """All rows but those ranked 1..k by a unique key."""
    edge = rank_threshold(df, key, k)
    return df if edge is None else df.filter(F.col(key) > F.lit(edge))
