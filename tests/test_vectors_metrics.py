import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectlake.functions import vectors as X
from affectlake.operators import metrics

K = 4
ORDERS = [[2, 0, 1, 3], [0, 1, 2, 3], [3, 2, 1, 0]]
GAPS = [[0.1, 0.2, 0.3, 0.0], [0.05, 0.4, 0.1, 0.0], [0.2, 0.0, 0.2, 0.0]]
SCORES = [[0.1, 0.2, 0.4, 0.7], [0.3, 0.35, 0.75, 0.85], [0.2, 0.4, 0.4, 0.6]]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [
        (i, [rng.uniform(-3, 3) for _ in range(3 * K)], [rng.randrange(2) for _ in range(K)], rng.randrange(K))
        for i in range(40)
    ]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "id int, logits array<double>, gold array<int>, idx int").repartition(3)


def sig(x):
    return 1 / (1 + math.exp(-x))


def soft(x):
    e = [math.exp(v) for v in x]
    return [v / sum(e) for v in e]


def emd(logits, gold, single=False):
    """The definition, cell by cell."""
    loss = 0.0
    for axis in range(3):
        part = logits[axis * K:(axis + 1) * K]
        p = soft(part) if single else [sig(x) for x in part]
        y = [gold[i] for i in ORDERS[axis]]
        between = 0.0
        for j in range(K):
            cp = sum(p[: j + 1]) / (sum(p) + 1e-5)
            cy = sum(y[: j + 1]) / (sum(y) + 1e-5)
            between += GAPS[axis][j] * (cp - cy) ** 2
        loss += between + sum((a - b) ** 2 for a, b in zip(p, y)) / K
    return loss / 3


def collect(rows, col):
    return {r["id"]: r["o"] for r in rows.select("id", col.alias("o")).collect()}


def test_distribution_loss(rows, data):
    got = collect(rows, X.emd_loss("logits", "gold", ORDERS, GAPS))
    assert all(math.isclose(got[i], emd(z, g), rel_tol=1e-9) for i, z, g, _ in data)
    hot = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: (i == F.col("idx")).cast("int"))
    got = collect(rows, X.emd_loss("logits", hot, ORDERS, GAPS, "single"))
    assert all(math.isclose(got[i], emd(z, [int(j == c) for j in range(K)], True), rel_tol=1e-9) for i, z, _, c in data)


def test_loss_without_cumulative_difference_is_the_within_part(spark):
    """Probabilities that all equal one half against all-one labels: same shape."""
    row = spark.createDataFrame([(0, [0.0] * 3 * K, [1] * K)], "id int, logits array<double>, gold array<int>")
    got = row.select(X.emd_loss("logits", "gold", ORDERS, GAPS, parts=True).alias("o")).select("o.*").first()
    assert abs(got["between_v"]) < 1e-10 and got["within_v"] == 0.25 and math.isclose(got["loss"], 0.25, rel_tol=1e-9)


def test_cross_entropy_losses(rows, data):
    def bce(x, y):
        return -(y * math.log(sig(x)) + (1 - y) * math.log(1 - sig(x)))

    got = collect(rows, X.axis_cross_entropy("logits", "gold", ORDERS))
    own = collect(rows, X.binary_loss(X.axis_part("logits", 0, K), "gold"))
    ce = collect(rows, X.class_loss(X.axis_part("logits", 0, K), "idx"))
    for i, z, g, c in data:
        want = sum(bce(z[a * K + j], g[ORDERS[a][j]]) for a in range(3) for j in range(K)) / K
        assert math.isclose(got[i], want, rel_tol=1e-9)
        assert math.isclose(own[i], sum(bce(z[j], g[j]) for j in range(K)) / K, rel_tol=1e-9)
        assert math.isclose(ce[i], -math.log(soft(z[:K])[c]), rel_tol=1e-9)


def test_predictions(rows, data):
    multi = collect(rows, X.vad_and_classes("logits", ORDERS, SCORES))
    single = collect(rows, X.vad_and_classes("logits", ORDERS, SCORES, "single"))
    native = collect(rows, X.weighted_sum(X.sigmoid(X.axis_part("logits", 1, K)), SCORES[1]))
    for i, z, _, _ in data:
        want = sum(sig(z[K + j]) * SCORES[1][j] for j in range(K))
        assert math.isclose(multi[i]["a"], want, rel_tol=1e-9) and math.isclose(native[i], want, rel_tol=1e-9)
        assert math.isclose(single[i]["v"], sum(p * s for p, s in zip(soft(z[:K]), SCORES[0])), rel_tol=1e-9)
        plain = [[z[a * K + ORDERS[a].index(c)] for a in range(3)] for c in range(K)]
        assert multi[i]["classes"] == [int(math.prod(map(sig, x)) ** (1 / 3) >= 0.5) for x in plain]
        sums = [sum(x) for x in plain]
        assert single[i]["classes"] == [sums.index(max(sums))]


def test_small_functions(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0], [5, 6, 7, 0])], "x array<double>, ids array<int>")
    got = row.select(
        X.softmax("x").alias("s"), X.normalise("x").alias("n"), X.first_argmax("x").alias("m"),
        X.shift_left("ids").alias("t"), X.combined_objective(F.lit(2.0), F.lit(1.0)).alias("c"),
        X.threshold_classes(F.array(F.lit(-0.1), F.lit(0.0))).alias("h"),
        X.regression_loss([F.lit(-1.0), F.lit(2.0)], [F.lit(1.0), F.lit(1.0)]).alias("r"),
    ).first()
    assert np.allclose(got["s"], soft([1, 3, 3])) and np.allclose(got["n"], np.array([1, 3, 3]) / 7.00001)
    assert got["m"] == 1 and got["t"] == [6, 7, 0, 0] and math.isclose(got["c"], 2 * math.exp(-4.6) + 1)
    assert got["h"] == [0, 1] and got["r"] == 1.0


def test_linear_head_keeps_nulls_in_place(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.5, -1.0])], "id int, v array<float>").coalesce(1)
    got = collect(rows, X.linear_head("v", [[1, 1], [2, 0], [0, 3]], [0, 0, 1]))
    assert got == {0: [3.0, 2.0, 7.0], 1: None, 2: [-0.5, 1.0, -2.0]}


# ---------------------------------------------------------------------- metrics

def prf(tp, predicted, support):
    def div(a, b):
        return a / b if b else 0.0

    return div(tp, predicted), div(tp, support), div(2 * tp, predicted + support), div(tp, predicted + support - tp)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    data = [([rng.randrange(2) for _ in range(4)] + [0], [rng.randrange(2) for _ in range(4)] + [0]) for _ in range(60)]
    data += [([0] * 5, [0] * 5)]
    return data, spark.createDataFrame(data, "g array<int>, p array<int>").repartition(4)


def test_multi_label_metrics(labelled):
    data, rows = labelled
    counts = metrics.multi_label_counts(rows, "g", "p")
    report = {r["label_idx"]: r for r in metrics.per_class_report(counts).collect()}
    sums = []
    for c in range(5):
        tp, np_, ng = (sum(f(g[c], p[c]) for g, p in data) for f in (lambda g, p: g * p, lambda g, p: p, lambda g, p: g))
        sums.append((tp, np_, ng))
        got = report[c]
        assert np.allclose([got["precision"], got["recall"], got["f1"], got["jaccard"]], prf(tp, np_, ng)) and got["support"] == ng
    means = {r["average"]: [r["precision"], r["recall"], r["f1"], r["jaccard"]] for r in metrics.averages(counts, "multi").collect()}
    assert np.allclose(means["micro"], prf(*map(sum, zip(*sums))))
    assert np.allclose(means["macro"], np.mean([prf(*s) for s in sums], axis=0))
    assert np.allclose(means["weighted"], np.average([prf(*s) for s in sums], axis=0, weights=[s[2] for s in sums]))
    per_row = [prf(sum(a * b for a, b in zip(g, p)), sum(p), sum(g)) for g, p in data]
    assert np.allclose(means["samples"], np.mean(per_row, axis=0))
    assert means["accuracy"][0] == sum(g == p for g, p in data) / len(data)


def test_single_label_metrics_skip_unseen_classes(spark):
    data = [(0, 0), (0, 1), (1, 1), (3, 1), (0, 0)]
    rows = spark.createDataFrame(data, "g int, p int")
    counts = metrics.single_label_counts(rows, "g", "p")
    assert sorted(r["label_idx"] for r in counts.collect()) == [0, 1, 3]
    means = {r["average"]: r["f1"] for r in metrics.averages(counts, "single").collect()}
    f1 = [prf(2, 2, 3)[2], prf(1, 3, 1)[2], prf(0, 0, 1)[2]]
    assert math.isclose(means["macro"], sum(f1) / 3) and math.isclose(means["accuracy"], 0.6)
    assert math.isclose(means["weighted"], (3 * f1[0] + f1[1] + f1[2]) / 5)
    table = {(r["metric_group"], r["name"], r["metric"]): r["value"] for r in metrics.evaluate(rows, "single", "g", "p").collect()}
    assert table[("accuracy", "all", "accuracy")] == 0.6 and ("jaccard", "micro", "jaccard") not in table


def test_evaluation_shuffles_class_sums_only(labelled):
    _, rows = labelled
    plan = metrics.multi_label_counts(rows, "g", "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan and "Python" not in plan


def test_pearson_and_p_value(spark):
    rng = random.Random(2)
    data = [(x := rng.gauss(0, 1), 0.3 * x + rng.gauss(0, 1), 1.0) for _ in range(60)]
    rows = spark.createDataFrame(data, "x double, y double, one double")
    got = {r["axis"]: r for r in metrics.pearson_with_p(rows, ["x", "x", "y"], ["y", "one", "y"]).collect()}
    r = np.corrcoef([d[0] for d in data], [d[1] for d in data])[0, 1]
    assert math.isclose(got["v"]["r"], r, rel_tol=1e-9)
    assert got["a"]["r"] is None and got["a"]["p"] is None
    assert math.isclose(got["d"]["r"], 1.0) and got["d"]["p"] < 1e-12

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    frame = VectorAssembler(inputCols=["x"], outputCol="f").transform(rows)
    p = LinearRegression(solver="normal", featuresCol="f", labelCol="y").fit(frame).summary.pValues[0]
    assert math.isclose(got["v"]["p"], p, rel_tol=1e-6)


def test_incomplete_beta_against_known_values():
    assert math.isclose(metrics.incomplete_beta(1.0, 0.5, 0.19), 1 - math.sqrt(0.81), rel_tol=1e-12)
    assert math.isclose(metrics.incomplete_beta(2.0, 3.0, 0.4), 0.5248, rel_tol=1e-12)
    assert math.isclose(metrics.incomplete_beta(0.5, 0.5, 0.5), 0.5, rel_tol=1e-12)


def test_losses(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "batch_id int, l double")
    assert metrics.mean_loss(rows, "l").first()["loss"] == 3.0
    assert math.isclose(metrics.batch_scaled_loss(rows, "l").first()["loss"], 7 / 3)
    sizes = spark.createDataFrame([([1], [1, 2]), ([1], [1])], "g array<int>, p array<int>")
    assert tuple(metrics.check_sizes(sizes, "g", "p").first()) == (2, 1, False)
