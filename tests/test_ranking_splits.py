import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectlake.operators import ranking, splits


def hashed(i, seed=42):
    return hashlib.md5(f"{i}#{seed}".encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 7])
def test_rank_of_numbers_with_many_buckets(spark, parts):
    ids = [i * i - 500 for i in range(1000)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(parts)
    out = ranking.ranked_by(rows, "id", rows_per_bucket=37).collect()
    assert {r["id"]: r["rank"] for r in out} == {v: i + 1 for i, v in enumerate(sorted(ids))}


def test_rank_of_strings_and_hashes(spark):
    rows = spark.range(500).select(F.concat(F.lit("shared_prefix_"), "id").alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    keys = sorted(r["k"] for r in rows.collect())
    out = ranking.ranked_by(rows, "k", rows_per_bucket=20).collect()
    assert {r["k"]: r["rank"] for r in out} == {v: i + 1 for i, v in enumerate(keys)}
    hashes = sorted(r["h"] for r in rows.collect())
    out = ranking.ranked_by(rows, "h", hashed=True, rows_per_bucket=20).collect()
    assert {r["h"]: r["rank"] for r in out} == {v: i + 1 for i, v in enumerate(hashes)}


@pytest.mark.parametrize("k", [0, 1, 17, 999, 1000, 5000])
def test_threshold_narrows_to_the_rank(spark, k):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    first = sorted(r["id"] for r in ranking.take_first(rows.withColumn("x", F.lit(1)), "id", k).collect())
    assert first == list(range(min(k, 1000)))
    assert ranking.rank_threshold(rows, "id", k, rows_per_bucket=50) == (None if k < 1 else min(k, 1000) - 1)


def test_rank_window_is_per_bucket(spark):
    rows = spark.range(1000)
    plan = ranking.ranked_by(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    plan = splits.train_valid_split(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def quotas(sizes, held, total):
    base = {s: n * held // total for s, n in sizes.items()}
    rest = sorted(sizes, key=lambda s: (-(sizes[s] * held % total), s))
    for s in rest[: held - sum(base.values())]:
        base[s] += 1
    return base


@pytest.mark.parametrize("parts", [1, 8])
def test_stratified_exact_sizes_with_a_hot_stratum(spark, parts):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(9000, "only")]
    df = spark.createDataFrame(rows, "id long, c string").repartition(parts)
    out = splits.stratified_split(df, "id", "c", 100, 90).collect()
    got = Counter((r["c"], r["split"]) for r in out)
    sizes = Counter(c for _, c in rows)
    test = quotas(sizes, 100, 901)
    left = {s: n - test[s] for s, n in sizes.items()}
    valid = quotas(left, 90, 801)
    for s, n in sizes.items():
        assert got[(s, "test")] == test[s] and got[(s, "valid")] == valid[s]
        assert got[(s, "train")] == n - test[s] - valid[s]
    place = {r["id"]: r["split"] for r in out}
    order = sorted((i for i, c in rows if c == "hot"), key=hashed)
    assert all(place[i] == "test" for i in order[: test["hot"]])
    assert len(place) == 901


def test_split_when_nothing_is_small_enough_to_broadcast(spark, monkeypatch):
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("c"))
    usual = {r["id"]: r["split"] for r in splits.stratified_split(rows, "id", "c", 60, 50).collect()}
    monkeypatch.setattr(ranking, "bounded", lambda df: (df, False))
    monkeypatch.setattr(splits, "bounded", lambda df: (df, False))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = splits.stratified_split(rows, "id", "c", 60, 50)
        assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
        assert {r["id"]: r["split"] for r in shuffled.collect()} == usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stratified_shares(spark):
    rows = [(i, "abc"[i % 3]) for i in range(101)]
    out = splits.stratified_split(spark.createDataFrame(rows, "id long, c string"), "id", "c", 0.15, 0.15).collect()
    held = math.ceil(0.3 * 101)
    got = Counter(r["split"] for r in out)
    assert got["train"] == 101 - held and got["test"] == math.ceil(held * 0.5)


def test_null_stratum_is_a_stratum(spark):
    rows = [(i, None if i % 2 else "x") for i in range(40)]
    out = splits.stratified_split(spark.createDataFrame(rows, "id long, c string"), "id", "c", 10, 10).collect()
    assert Counter((r["c"], r["split"]) for r in out)[(None, "test")] == 5


def test_shuffle_cut_and_train_valid(spark):
    df = spark.range(103)
    got = Counter(r["split"] for r in splits.train_valid_test_split(df, "id").collect())
    assert got == {"train": 82, "valid": 10, "test": 11}
    got = Counter(r["split"] for r in splits.train_valid_split(df, "id").collect())
    assert got == {"valid": 21, "train": 82}


def test_tiny_tables(spark):
    got = Counter(r["split"] for r in splits.train_valid_test_split(spark.range(3), "id").collect())
    assert got == {"train": 2, "test": 1}
    assert splits.train_valid_test_split(spark.range(0), "id").count() == 0


def test_few_shot_epochs_and_batches(spark):
    df = spark.range(50)
    assert sorted(r["id"] for r in splits.few_shot(df, "id", 0.31).collect()) == list(range(15))
    one = {r["id"]: r["position"] for r in splits.epoch_order(df, "id", 1).collect()}
    two = {r["id"]: r["position"] for r in splits.epoch_order(df.repartition(5), "id", 2).collect()}
    assert sorted(one.values()) == sorted(two.values()) == list(range(1, 51)) and one != two
    sizes = Counter(r["batch_id"] for r in splits.sequential_batches(df, "id", 16).collect())
    assert sizes == {0: 16, 1: 16, 2: 16, 3: 2}


def test_compare_splits(spark):
    a = spark.createDataFrame([(1, "train"), (2, "test"), (3, "valid")], "id long, split string")
    b = spark.createDataFrame([(1, "train"), (2, "valid"), (3, "valid")], "id long, split string")
    got = {r["split"]: r["same"] for r in splits.compare_splits(a, b, "id").collect()}
    assert got == {"train": True, "test": False, "valid": False}


# ------------------------------------------------------------- rows without a place

def test_null_ids_are_errors(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, "s") for i in range(100)], "id int, s string")
    for cut in (ranking.take_first, ranking.skip_first):
        with pytest.raises(ValueError, match="null"):
            cut(rows, "id", 20)
    with pytest.raises(Exception, match="without id"):
        splits.stratified_split(rows, "id", "s", 20, 20).collect()


def test_repeated_ids_at_a_cut_are_errors(spark):
    rows = spark.createDataFrame([(i // 20, "s") for i in range(100)], "id int, s string")
    with pytest.raises(ValueError, match="repeated"):
        ranking.take_first(rows, "id", 10)
    assert ranking.take_first(rows, "id", 20).count() == 20
    with pytest.raises(Exception, match="repeated"):
        splits.stratified_split(rows, "id", "s", 10, 10).collect()


def test_bucket_sums_in_two_levels(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(600)], "id int, s string")
    sizes = {"x": 100, "y": 150}
    plain = splits.shuffled_split(rows, "id", sizes, "rest", 600).collect()
    by_stratum = splits.stratified_split(rows, "id", "s", 60, 60).collect()
    monkeypatch.setattr(ranking, "GROUP", 5)
    assert sorted(splits.shuffled_split(rows, "id", sizes, "rest", 600).collect()) == sorted(plain)
    assert sorted(splits.stratified_split(rows, "id", "s", 60, 60).collect()) == sorted(by_stratum)
    assert Counter(r["split"] for r in plain) == {"x": 100, "y": 150, "rest": 350}


def test_quotas_of_many_strata_need_no_single_task(spark):
    """A million strata; the plans deal them to many tasks, and the shares are exact."""
    sizes = spark.range(1_000_000).select(F.col("id").alias("s"), (F.col("id") % 7 + 1).alias("left"))
    total = sizes.agg(F.sum("left")).first()[0]
    held = total // 3
    got = splits.held_out_quotas(sizes, "s", held, total, "n")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    left = np.arange(1_000_000) % 7 + 1
    base, rest = left * held // total, left * held % total
    order = np.lexsort((np.arange(1_000_000), -rest))
    base[order[: held - base.sum()]] += 1
    rows = got.select("s", "n").toArrow()
    found = np.empty(1_000_000, np.int64)
    found[rows.column("s").to_numpy()] = rows.column("n").to_numpy()
    assert (found == base).all() and found.sum() == held


@pytest.mark.parametrize("few", [True, False])
def test_quotas_order_equal_remainders(spark, monkeypatch, few):
    monkeypatch.setattr(splits, "bounded", lambda df: (df, few))
    for values in ([None, "a", "b", "ä"], [None, -5, 3, 10]):
        kind = "string" if isinstance(values[1], str) else "int"
        sizes = spark.createDataFrame([(v, 10) for v in values], f"s {kind}, left long")
        got = {r.s: r.n for r in splits.held_out_quotas(sizes, "s", 6, 40, "n").collect()}
        assert [got[v] for v in values] == [2, 2, 1, 1]
    if not few:
        with pytest.raises(ValueError, match="strata"):
            splits.held_out_quotas(spark.createDataFrame([(1.5, 10)], "s double, left long"), "s", 6, 10, "n")
