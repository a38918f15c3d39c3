import numpy as np
import pytest
from pyspark.sql import functions as F

from affectlake.functions import labels as L
from affectlake.functions.rounding import round_even
from affectlake.operators import annotators, joins, lexicon, stats


def test_encodings(spark):
    row = spark.createDataFrame([([3, 1], 2, "joy")], "ids array<int>, i int, name string")
    got = row.select(
        L.multi_hot("ids", 5).alias("hot"), L.one_hot("i", 3).alias("one"),
        L.label_index("name", L.STATEMENT_LABELS).alias("idx"), L.rename_codes(F.lit("xxx")).alias("same"),
        L.rename_codes(F.lit("exc")).alias("word"),
    ).first()
    assert (got["hot"], got["one"], got["idx"], got["same"], got["word"]) == ([0, 1, 0, 1, 0], [0, 0, 1], 3, "xxx", "excite")
    with pytest.raises(Exception, match="unknown label"):
        row.select(L.label_index(F.lit("bliss"), L.STATEMENT_LABELS)).collect()


def test_label_list_sizes():
    assert [len(x) for x in (L.TWEET_LABELS, L.STATEMENT_LABELS, L.STANCE_LABELS, L.DIALOGUE_LABELS, L.FORUM_LABELS, L.EKMAN_LABELS)] == [11, 7, 8, 9, 28, 7]


def test_permutation_and_its_inverse(spark):
    order = [2, 0, 3, 1]
    row = spark.createDataFrame([([10, 11, 12, 13],)], "x array<int>")
    got = row.select(L.permute("x", order).alias("p"), L.permute(L.permute("x", order), L.invert(order)).alias("b")).first()
    assert got["p"] == [12, 10, 13, 11] and got["b"] == [10, 11, 12, 13]


def test_round_is_half_even_on_the_scaled_double(spark):
    values = [2.345, 2.675, 0.125, 2.5, 1.005, -0.375, 3.14159] + [i / 1000 + 0.0005 for i in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 3):
        got = [r[0] for r in rows.select(round_even("x", digits)).collect()]
        assert got == [float(np.round(v, digits)) for v in values]


def table(spark, scores):
    return spark.createDataFrame([(i, f"l{i}", float(s), i / 10, float(-i)) for i, s in enumerate(scores)], "label_idx int, label string, v double, a double, d double")


def gaps(spark, scores, mode="reference"):
    rows = lexicon.gap_weights(table(spark, scores), mode).filter("axis = 'v'").orderBy("position").collect()
    return [round(r["gap"], 6) for r in rows], [r["label_idx"] for r in rows]


def test_gap_weights_and_ties(spark):
    assert gaps(spark, [0.9, 0.1, 0.5]) == ([0.4, 0.4, 0.0], [1, 2, 0])
    assert gaps(spark, [0.5, 0.1, 0.5, 0.9])[0] == [0.4, 0.4, 0.4, 0.0]
    assert gaps(spark, [0.5, 0.5, 0.5, 0.9])[0] == [0.0, 0.4, 0.4, 0.0]
    assert gaps(spark, [0.1, 0.9, 0.9])[0] == [0.8, -0.8, 0.0]
    assert gaps(spark, [0.1, 0.9, 0.9], "safe")[0] == [0.8, 0.0, 0.0]
    with pytest.raises(Exception, match="all labels are equal"):
        gaps(spark, [0.3, 0.3, 0.3])


def test_label_coordinates(spark):
    words = spark.createDataFrame([("joy", 0.98, 0.8, 0.7), ("joy", 0.5, 0.5, 0.5), ("anger", 0.1, 0.9, 0.6)], "word string, v double, a double, d double")
    lines = words.withColumn("line_no", F.monotonically_increasing_id())
    lex = lexicon.lexicon_scores(lines)
    labels = spark.createDataFrame([(0, "anger"), (1, "joy")], "label_idx int, label string")
    got = {r["label"]: r["v"] for r in lexicon.label_coordinates(labels, lex).collect()}
    assert got == {"anger": 0.1, "joy": 0.5}
    more = spark.createDataFrame([(0, "anger"), (1, "bliss")], "label_idx int, label string")
    assert [r["label"] for r in lexicon.unknown_labels(more, lex).collect()] == ["bliss"]
    with pytest.raises(Exception, match="no coordinates"):
        lexicon.label_coordinates(more, lex).collect()


def test_combined_annotations(spark):
    schema = "id string, V double, A double, D double, N int"
    reader = spark.createDataFrame([("a", 2.6, 3.0, 2.6, 5), ("b", 3.6, 3.0, 3.0, 5), ("c", 1.0, 1.0, 1.0, 1)], schema)
    writer = spark.createDataFrame([("a", 3.0, 3.2, 3.0, 5), ("b", 3.25, 3.0, 3.0, 4), ("d", 1.0, 1.0, 1.0, 1)], schema)
    both = annotators.combine_perspectives(reader, writer)
    got = {r["id"]: (r["V"], r["A"], r["D"]) for r in both.collect()}
    assert got == {"a": (2.8, 3.1, 2.8), "b": (3.44, 3.0, 3.0)}
    long = reader.withColumn("perspective", F.lit("reader")).unionByName(writer.withColumn("perspective", F.lit("writer")))
    assert {tuple(r) for r in annotators.combine_raters(long, 2).collect()} == {tuple(r) for r in both.collect()}
    twice = long.unionByName(long.filter("id in ('a', 'c')"))  # two rows of one perspective are no second perspective
    assert {tuple(r) for r in annotators.combine_raters(twice, 2).collect()} == {tuple(r) for r in both.collect()}
    raw = spark.createDataFrame([("a", "x"), ("b", None)], "id string, text string")
    assert {r["id"]: r["text"] for r in annotators.attach_text(both, raw).collect()} == {"a": "x", "b": None}
    with pytest.raises(Exception, match="no text for id"):
        annotators.attach_text(both, raw.filter("id = 'a'")).collect()
    shape = {r["check"]: r["ok"] for r in annotators.check_shape(both, 2, 5).collect()}
    assert shape == {"rows": True, "columns": False}


def test_extreme_rows_take_the_first_id(spark):
    df = spark.createDataFrame([("b", 1.0, 1.0, 5.0), ("a", 1.0, 2.0, 5.0), ("c", 0.5, 2.0, 1.0)], "id string, V double, A double, D double")
    got = {(r["axis"], r["side"]): r["id"] for r in annotators.extreme_rows(df).collect()}
    assert got == {("V", "min"): "c", ("V", "max"): "a", ("A", "min"): "b", ("A", "max"): "a", ("D", "min"): "c", ("D", "max"): "a"}


def test_statistics(spark):
    rows = spark.createDataFrame([("train", "x", [1, 0, 0]), ("train", "", [0, 1, 0]), ("test", None, [1, 1, 0])], "split string, text string, label array<int>")
    assert {r["split"]: r["n_empty"] for r in stats.empty_texts(rows).collect()} == {"train": 1, "test": 1}
    assert stats.drop_empty(rows).count() == 1
    counts = stats.multi_hot_counts(rows, "label", 3)
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 2), (1, 2), (2, 0)]
    entropy = stats.label_entropy(counts, 3).first()
    assert abs(entropy["entropy"] - 0.6931471805599453) < 1e-12
    sizes = {(r["split"], r["field"]): r["n"] for r in stats.split_sizes(rows).collect()}
    assert sizes[("all", "label")] == 3 and sizes[("all", "text")] == 2


def test_dropping_empty_texts_cleans_once(spark):
    from affectlake.functions.text import clean_basic

    rows = spark.createDataFrame([(1, "\" \"", 7), (2, None, 8), (3, "a", 9)], "id int, text string, x int")
    kept = stats.drop_empty(rows.withColumn("text", clean_basic("text")))
    assert kept.columns == ["id", "text", "x"] and [tuple(r) for r in kept.collect()] == [(3, "a", 9)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


def test_lookup_joins_are_broadcast(spark):
    big = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 5).alias("name"))
    labels = spark.createDataFrame([(i, f"k{i}") for i in range(4)], "label_idx int, label string")
    out = joins.with_label_index(big, "name", labels)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 800
    assert [tuple(r) for r in joins.unlisted_labels(big, "name", labels).collect()] == [("k4", 200)]


def test_indexes_outside_the_labels_are_errors(spark):
    row = spark.range(1)
    hot = lambda *ids: row.select(L.multi_hot(F.array(*map(F.lit, ids)), 3).alias("h")).first().h
    assert hot(1, -1) == [0, 1, 1]
    for bad in (3, 28, -4):
        with pytest.raises(Exception, match="outside 0..2"):
            hot(1, bad)
    listed = spark.createDataFrame([(0,), (1,)], "label_idx int")
    with pytest.raises(Exception, match="not listed: 99"):
        stats.index_counts(spark.createDataFrame([([0, 99],)], "ids array<int>"), "ids", listed).collect()
