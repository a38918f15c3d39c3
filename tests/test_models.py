import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectlake.functions import vectors as X
from affectlake.operators import heads, jobs, lexicon, sequences, solvers, splits
from affectlake.sinks import results
from affectlake.sources import files


@pytest.fixture(scope="module")
def axes(spark):
    labels = spark.createDataFrame([(0, "a", 0.1, 0.5, 0.2), (1, "b", 0.7, 0.3, 0.2), (2, "c", 0.4, 0.9, 0.8)], "label_idx int, label string, v double, a double, d double")
    return lexicon.label_axes(labels)


def test_label_axes(axes):
    assert axes.names == ["a", "b", "c"] and axes.orders == [[0, 2, 1], [1, 0, 2], [0, 1, 2]]
    assert np.allclose(axes.gaps, [[0.3, 0.3, 0.0], [0.2, 0.4, 0.0], [0.6, 0.6, 0.0]])


def numeric(fn, point, columns, eps=1e-6):
    out = np.zeros_like(point)
    for i in range(len(point)):
        up, down = point.copy(), point.copy()
        up[i] += eps
        down[i] -= eps
        out[i] = (fn(up, columns)[0] - fn(down, columns)[0]) / (2 * eps)
    return out


@pytest.mark.parametrize("kind", ["multi", "single"])
def test_distribution_gradient(axes, kind):
    rng = np.random.default_rng(1)
    fn = heads.emd_loss_and_gradient(axes, 2, kind)
    gold = np.eye(3)[[0, 2, 1, 1]] if kind == "single" else rng.integers(0, 2, (4, 3)).astype(float)
    point, columns = rng.normal(size=9 * 3), [rng.normal(size=(4, 2)), gold]
    assert np.allclose(fn(point, columns)[1], numeric(fn, point, columns), atol=1e-6)


def test_regression_gradient():
    rng = np.random.default_rng(2)
    fn = heads.regression_loss_and_gradient(3, 2)
    point, columns = rng.normal(size=9 * 3 + 9), [rng.normal(size=(5, 2)), rng.normal(size=(5, 3)) + 1]
    assert np.allclose(fn(point, columns)[1], numeric(fn, point, columns), atol=1e-5)


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(3)
    centers = np.array([[3.0, 0, 0], [0, 3.0, 0], [0, 0, 3.0]])
    data = []
    for i in range(240):
        c = i % 3
        x = centers[c] + rng.normal(size=3) * 0.3
        data.append((i, [float(v) for v in x], c, [int(j == c) for j in range(3)], float(2 + x[0]), float(1 + x[1]), float(3 - x[2] / 2)))
    return spark.createDataFrame(data, "id int, x array<double>, c int, hot array<int>, v double, a double, d double").repartition(4)


def test_distribution_head_learns(clusters, axes):
    weights, bias, losses = heads.fit_vad_from_categories(clusters, "x", "hot", axes, 3, steps=25)
    assert min(losses) < 0.5 * losses[0]
    out = clusters.select("c", X.vad_and_classes(X.linear_head("x", weights, bias), axes.orders, axes.scores, "single")["classes"][0].alias("p"))
    assert out.filter("c = p").count() / 240 > 0.95
    mean = clusters.select(X.emd_loss(X.linear_head("x", weights, bias), "hot", axes.orders, axes.gaps).alias("l")).agg(F.avg("l")).first()[0]
    assert math.isclose(mean, min(losses), rel_tol=1e-9)


def test_descent_does_not_depend_on_the_layout(clusters, axes):
    one = heads.fit_vad_from_categories(clusters.coalesce(1), "x", "hot", axes, 3, steps=4)
    many = heads.fit_vad_from_categories(clusters.repartition(7), "x", "hot", axes, 3, steps=4)
    assert np.allclose(one[0], many[0]) and np.allclose(one[2], many[2])


def test_ml_heads(clusters):
    model = heads.fit_single_label(clusters, "x", "c")
    scored = heads.single_label_scores(model, clusters, "x")
    assert scored.filter("c = class").count() / 240 > 0.95
    models = heads.fit_multi_label(clusters, "x", "hot", 3, maxIter=10)
    weights, bias = heads.multi_label_weights(models)
    pred = clusters.select("hot", X.threshold_classes(X.linear_head("x", weights, bias)).alias("p"))
    assert pred.filter("hot = p").count() / 240 > 0.9
    weights, bias = heads.fit_vad_regression(clusters, "x", ["v", "a", "d"])
    assert np.allclose(weights, [[1, 0, 0], [0, 1, 0], [0, 0, -0.5]], atol=1e-3) and np.allclose(bias, [2, 1, 3], atol=1e-3)


def test_two_stage_regression(clusters):
    head = np.vstack([np.eye(3)] * 3)
    bias = np.zeros(9)
    rows = clusters.withColumn("z", X.linear_head("x", head, bias))
    axis = heads.axis_regression(rows, "z", ["v", "a", "d"], 3)
    w, b, u, losses = heads.fit_two_stage(clusters, "x", ["v", "a", "d"], head, bias, axis, 3, steps=15, rate=0.2)
    assert min(losses) < losses[0] and w.shape == (9, 3) and u.shape == (3, 3)


def test_saved_weights_drop_the_old_head(spark, tmp_path):
    tensors = {"head.weight": np.ones((2, 2)), "head.bias": np.ones(2), "v": np.arange(6.0).reshape(2, 3)}
    heads.save_weights(spark, tensors, str(tmp_path / "w"))
    loaded = heads.load_weights(spark, str(tmp_path / "w"))
    assert list(loaded) == ["v"] and np.array_equal(loaded["v"], tensors["v"])
    assert len(heads.load_weights(spark, str(tmp_path / "w"), drop=[])) == 3


def test_ml_model_round_trip(clusters, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    model = heads.fit_single_label(clusters, "x", "c", maxIter=5)
    model.write().save(str(tmp_path / "m"))
    again = LogisticRegressionModel.load(str(tmp_path / "m"))
    assert np.allclose(model.coefficientMatrix.toArray(), again.coefficientMatrix.toArray())


# -------------------------------------------------------------------- sequences

@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(0, "train", "a b a c"), (1, "valid", "a b"), (2, "test", ""), (3, "train", None), (4, "train", "b z")], "id int, split string, text string").repartition(3)


def test_vocabulary_holds_every_token(texts):
    vocab = sequences.vocabulary(texts)
    assert [(r["token"], r["token_id"], r["n"]) for r in vocab.orderBy("token_id").collect()] == [
        ("a", 4, 3), ("b", 5, 3), ("c", 6, 1), ("z", 7, 1)]


@pytest.mark.parametrize("frequent", [0, 2, 2_000])
def test_every_token_is_encoded(texts, monkeypatch, frequent):
    monkeypatch.setattr(sequences, "FREQUENT", frequent)
    vocab = sequences.vocabulary(texts)
    rows = {(r["id"], r["window_no"]): r for r in sequences.encode(texts, vocab, ["id", "split"], 5).collect()}
    assert sorted(rows) == [(0, 0), (0, 1), (1, 0), (4, 0)]
    assert rows[0, 0]["input_ids"] == [2, 4, 5, 4, 3] and rows[0, 0]["attention_mask"] == [1] * 5
    assert rows[0, 1]["input_ids"] == [2, 6, 3, 0, 0] and rows[0, 1]["split"] == "train"
    assert rows[1, 0]["input_ids"] == [2, 4, 5, 3, 0] and rows[1, 0]["attention_mask"] == [1, 1, 1, 1, 0]


def test_tokens_outside_the_vocabulary(texts):
    vocab = sequences.vocabulary(texts).filter("token <> 'z'")
    rows = {r["id"]: r for r in sequences.encode(texts, vocab, ["id"], 6).collect()}
    assert rows[4]["input_ids"] == [2, 5, 1, 3, 0, 0]


def test_decoding(texts):
    vocab = sequences.vocabulary(texts)
    rows = sequences.encode(texts, vocab, ["id"], 6)
    shown = {r["id"]: r["text"] for r in sequences.decode(rows, vocab, ["id"]).collect()}
    assert shown[1] == "<s> a b </s> <pad> <pad>"
    plain = {r["id"]: r["text"] for r in sequences.decode(rows, vocab, ["id"], special=False).collect()}
    assert plain == {0: "a b a c", 1: "a b", 4: "b z"}


def test_blocks_of_any_size_encode_the_same(spark):
    rows = [(i, None if i % 7 == 3 else " ".join(f"w{j % (i + 1)}" for j in range(i * 3 % 40)), "k") for i in range(60)]
    rows += [(5, "w1 w2", None), (None, "w1  new ", "k"), (5, "   ", "k"), (70, "w1 " * 3_000, "k")]
    df = spark.createDataFrame(rows, "id int, text string, key string")
    vocab = sequences.vocabulary(df.filter("id <= 60")).cache()
    number = {r["token"]: r["token_id"] for r in vocab.collect()}

    def brute(window):
        out = []
        for i, text, key in rows:
            words = [w for w in (text or "").split(" ") if w]
            for at in range(0, len(words), window - 2):
                ids = [2, *(number.get(w, 1) for w in words[at : at + window - 2]), 3]
                out.append((i, key, at // (window - 2), tuple(ids + [0] * (window - len(ids))), tuple([1] * len(ids) + [0] * (window - len(ids)))))
        return sorted(out, key=str)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for records in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            got = sequences.encode(df, vocab, ["id", "key"], 9).collect()
            assert sorted([(r.id, r.key, r.window_no, tuple(r.input_ids), tuple(r.attention_mask)) for r in got], key=str) == brute(9)
            back = sequences.decode(spark.createDataFrame(got), vocab, ["id", "key", "window_no"], special=False).collect()
            spelled = {v: k for k, v in number.items()}
            want = [(i, k, n, " ".join(spelled[x] for x in ids if x > 3)) for i, k, n, ids, _ in brute(9)]
            assert sorted([tuple(r) for r in back], key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sequences.encode(df.limit(0), vocab, ["id"], 9).collect() == []
    same = sequences.block_vocabulary(sequences.token_blocks(df, ["id"])).collect()
    assert sorted(same) == sorted(sequences.vocabulary(df).collect())


def test_no_token_is_exploded(texts):
    """Tokens travel as codes: the plan explodes blocks' distinct tokens only."""
    vocab = sequences.vocabulary(texts)
    plan = sequences.encode(texts, vocab, ["id"], 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(entries") == plan.count("Generate")


def test_bigram_loss(texts):
    vocab = sequences.vocabulary(texts)
    rows = sequences.encode(texts, vocab, ["id"], 6)
    pairs = []
    for r in rows.collect():
        ids = r["input_ids"]
        pairs += [(a, b) for a, b in zip(ids, [*ids[1:], 0]) if b != 0]
    loss = -sum(math.log(pairs.count(p) / sum(1 for q in pairs if q[0] == p[0])) for p in pairs) / len(pairs)
    assert math.isclose(sequences.bigram_loss(sequences.bigram_counts(rows)).first()[0], loss, rel_tol=1e-9)


def test_descent_says_why_it_cannot_start(spark):
    empty = spark.createDataFrame([], "x double")
    with pytest.raises(ValueError, match="no rows"):
        heads.descend(empty, np.zeros(1), lambda p, c: (0.0, p), 1, 1.0)
    one = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError, match="nan"):
        heads.descend(one, np.zeros(1), lambda p, c: (float("nan"), p), 1, 1.0)


def test_null_arrays_have_no_loss(spark):
    rows = spark.createDataFrame([(0, [0.0] * 9, [1, 0, 0]), (1, None, [1, 0, 0]), (2, [0.0] * 9, None)],
                                 "i int, z array<double>, y array<int>").coalesce(1)
    orders, gaps = [[0, 1, 2]] * 3, [[0.1, 0.1, 0.0]] * 3
    got = rows.select("i", X.emd_loss("z", "y", orders, gaps).alias("a"), X.axis_cross_entropy("z", "y", orders).alias("b"),
                      X.vad_and_classes("z", orders, gaps).alias("c")).orderBy("i").collect()
    assert [r.a is None for r in got] == [False, True, True] and [r.b is None for r in got] == [False, True, True]
    assert [r.c is None for r in got] == [False, True, False]


@pytest.mark.parametrize("task,kind,label", [
    ("vad-regression", "vad", "s"), ("category-classification", "single", "c"), ("category-classification", "multi", "hot"),
    ("vad-from-categories", "multi", "hot"),
])
def test_jobs_fill_the_logs(spark, clusters, axes, tmp_path, task, kind, label):
    from affectlake.operators import jobs
    from affectlake.sinks import results

    split = F.when(F.col("id") % 5 == 0, "valid").when(F.col("id") % 5 == 1, "test").otherwise("train")
    rows = clusters.withColumn("split", split).withColumn("s", F.struct("v", "a", "d"))
    other = rows.drop("hot").withColumnRenamed("s", "scores").withColumnRenamed("scores", label)
    jobs.run_job(task, kind, rows, "x", label, 3, str(tmp_path), axes, other)
    logs = ["multi", "vad"] if task == "vad-from-categories" else [kind]
    for log in logs:
        (line,) = results.read_log(spark, log, f"{tmp_path}/{log}").collect()
        assert line.valid_size == 48 and line.test_size == 48
        assert all(line[c] is not None and math.isfinite(line[c]) for c in ("valid_loss", "test_loss"))
    with pytest.raises(ValueError, match="unknown task"):
        jobs.run_job("clustering", kind, rows, "x", label, 3, str(tmp_path))


def test_least_squares_and_moments(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=(200, 2))
    rows = spark.createDataFrame([(a.tolist(), *b.tolist()) for a, b in zip(x, y)], "x array<double>, p double, q double").repartition(7)
    full = solvers.moments(rows, 6)
    z = np.column_stack([x, y, np.ones(200)])
    assert np.allclose(full, z.T @ z)
    weights, bias = solvers.least_squares(rows, 4, 2, 0.0)
    want = np.linalg.lstsq(np.column_stack([x, np.ones(200)]), y, rcond=None)[0]
    assert np.allclose(np.column_stack([weights, bias]), want.T)
    plain, zero = solvers.least_squares(rows, 4, 2, 0.1, intercept=False)
    assert np.allclose(plain.T, np.linalg.solve(x.T @ x + 200 * 0.1 * np.eye(4), x.T @ y)) and not zero.any()
    with pytest.raises(ValueError, match="no rows"):
        solvers.least_squares(rows.limit(0), 4, 2, 0.1)
    twice = rows.select(F.concat("x", "x").alias("x"), "p")
    with pytest.raises(ValueError, match="depend"):
        solvers.least_squares(twice, 8, 1, 0.0)


def test_newton_fits_end_where_the_gradient_is_zero(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    label = (x @ rng.normal(size=(3, 4)) + rng.gumbel(size=(300, 4))).argmax(axis=1)
    hot = (x @ rng.normal(size=(3, 2)) + rng.normal(size=(300, 2)) > 0).astype(int)
    rows = spark.createDataFrame([(a.tolist(), int(b), c.tolist()) for a, b, c in zip(x, label, hot)], "x array<double>, c int, hot array<int>").repartition(5)
    w, b, norm = heads.fit_multinomial(rows, "x", "c", 4, 0.01)
    z = np.exp(x @ w.T + b)
    off = z / z.sum(axis=1, keepdims=True) - np.eye(4)[label]
    assert norm < 1e-9 and np.abs(off.T @ x / 300 + 0.01 * w).max() < 1e-9 and np.abs(off.mean(axis=0)).max() < 1e-9
    assert abs(b.sum()) < 1e-6
    w, b, norm = heads.fit_binomials(rows, "x", "hot", 2, 0.01)
    off = 1 / (1 + np.exp(-(x @ w.T + b))) - hot
    assert norm < 1e-9 and np.abs(off.T @ x / 300 + 0.01 * w).max() < 1e-9
    one, _, _ = heads.fit_multinomial(rows.coalesce(1), "x", "c", 4, 0.01)
    assert np.allclose(one, heads.fit_multinomial(rows.repartition(6), "x", "c", 4, 0.01)[0])


def test_mini_batches_as_a_plain_loop(clusters, axes):
    rows = clusters.select("id", "x", F.array("v", "a", "d").alias("g")).coalesce(2)
    fn = heads.regression_loss_and_gradient(3, 3)
    start = np.concatenate([np.hstack([np.vstack([np.eye(3)] * 3), np.zeros((9, 1))]).ravel(), np.full(9, 0.5)])
    frozen = np.arange(len(start)) < 36
    schedule = heads.batch_schedule(240, 100, 3, 1, 0.1, 0.05)
    assert [(e["epoch"], e["steps"], e["n_updates"], e["frozen"], e["rate"]) for e in schedule] == [
        (1, 3, 3, True, 0.1), (2, 3, 6, False, 0.05), (3, 3, 9, False, 0.05)]
    got, losses = heads.descend_batches(rows, "id", start, fn, schedule, 100, frozen)
    point, data = start, {r.id: r for r in rows.collect()}
    for entry, want in zip(schedule, losses):
        order = [r.id for r in splits.epoch_order(rows, "id", entry["epoch"]).orderBy("position").collect()]
        total = 0
        for at in range(0, 240, 100):
            part = [data[i] for i in order[at : at + 100]]
            loss, gradient = fn(point, [np.array([r.x for r in part]), np.array([r.g for r in part])])
            point = point - entry["rate"] * np.where(frozen & entry["frozen"], 0, gradient / len(part))
            total += loss / len(part)
        assert math.isclose(total / 3, want, rel_tol=1e-9)
    assert np.allclose(got, point)


def test_jobs_go_on_where_they_ended(spark, tmp_path, write, axes):
    """Job files of two tasks; a finished epoch is not run again, a broken log is completed."""
    rows = [(i, "train" if i % 5 > 1 else "dev" if i % 5 else "test", 1 + i % 7 / 2, 1 + i % 5 / 2, 2.0 + i % 3, "abc"[i % 3] * (i % 4 + 1) + "xyz"[: i % 3]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "id int, split string, V double, A double, D double, text string")
    results.write_split_corpus(corpus, str(tmp_path / "emobank" / "emobank.csv"))
    for part in files.FORUM_FILES.values():
        corpus.select("text", F.concat_ws(",", F.col("id") % 7, (F.col("id") * 3 + 1) % 7).alias("l"), F.concat(F.lit(part), "id").alias("i")).write.option("sep", "\t").csv(str(tmp_path / "ekman" / f"{part}.tsv"))
    job = {"model": "bert", "load_model": "pretrained_lm", "label_type": "dimensional", "optimizer_type": "trans", "max_epoch": 2, "train_batch_size": 10}
    write("jobs/a.json", json.dumps({**job, "task": "vad-regression", "dataset": "emobank", "csv_file_name": "scores"}))
    write("jobs/b.json", json.dumps({**job, "task": "vad-from-categories", "dataset": "ekman", "csv_file_name": "zero", "few_shot_ratio": 0.5}))
    labels = spark.createDataFrame([(i, f"l{i}", 0.1 * i, 0.5 + 0.07 * (i * 3 % 7), 0.2 + 0.1 * (i * 2 % 7)) for i in range(7)], "label_idx int, label string, v double, a double, d double")

    def vectorise(df):
        return df.withColumn("vector", F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double") for c in "abcxyz"]))

    def run():
        return jobs.run_jobs(spark, str(tmp_path / "jobs"), {n: str(tmp_path / n) for n in ("emobank", "ekman")}, str(tmp_path / "out"),
                             vectorise, lambda name: lexicon.label_axes(labels))

    def logged():
        return {log: sorted(tuple(r) for r in results.read_log(spark, log, str(tmp_path / "out" / log)).collect()) for log in ("vad", "multi")}

    assert run() == [("scores", 1), ("scores", 2), ("zero", 1), ("zero", 2)]
    first = logged()
    assert [(r[0], r[1]) for r in first["vad"]] == [(1, "scores"), (1, "zero"), (2, "scores"), (2, "zero")] and len(first["multi"]) == 2
    assert run() == [] and logged() == first
    results.read_log(spark, "vad", str(tmp_path / "out" / "vad")).filter("not (file_name = 'zero' and epoch = 2)").write.partitionBy(
        "file_name", "epoch").parquet(str(tmp_path / "out" / "kept"))
    (tmp_path / "out" / "vad").rename(tmp_path / "out" / "whole")
    (tmp_path / "out" / "kept").rename(tmp_path / "out" / "vad")
    assert run() == [("zero", 2)]
    again = logged()
    numbers = lambda row: np.array(row[2:], dtype=float)
    assert all(np.allclose(numbers(a), numbers(b), equal_nan=True) for log in first for a, b in zip(first[log], again[log]))
    write("jobs/c.json", json.dumps({**job, "task": "clustering", "dataset": "emobank", "csv_file_name": "bad"}))
    with pytest.raises(ValueError, match="task=clustering"):
        run()
