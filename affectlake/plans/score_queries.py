"""Array mathematics, predictions and evaluation on the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from affectlake.functions import vectors as X
from affectlake.operators import metrics, splits
from affectlake.plans import views as V
from affectlake.plans.registry import query

K = V.K


def _cells(rows, array, name="x"):
    return rows.select("vec_id", F.posexplode(array).alias("pos", "value")).select(
        "vec_id", "pos", V.r6("value").alias(name)
    )


def _axis_cells(spark, sf, made, name="x"):
    """What ``made`` gives for the logits of each of the three axes."""
    parts = F.array(*[made(X.axis_part("logits", i, K)) for i in range(3)])
    rows = V.logit_rows(spark, sf).select("vec_id", F.posexplode(parts).alias("ax_no", "part"))
    return rows.select("vec_id", "ax_no", F.posexplode("part").alias("pos", "value")).select(
        "vec_id", "ax_no", "pos", V.r6("value").alias(name)
    )


# ---------------------------------------------------------------- element-wise

@query("m15_linear_head", "WITH" + V.LOGITS + f" SELECT vec_id, ax_no * {K} + pos AS pos, {V.sql_r6('x')} AS x FROM lg")
def m15(spark, sf):
    return _cells(V.logit_rows(spark, sf), "logits")


@query("m1_axis_parts", "WITH" + V.LOGITS + f" SELECT vec_id, ax_no, pos, {V.sql_r6('x')} AS x FROM lg")
def m1(spark, sf):
    return _axis_cells(spark, sf, lambda part: part)


@query("m2_sigmoid", "WITH" + V.PROBS + f" SELECT vec_id, ax_no, pos, {V.sql_r6('p')} AS p FROM pr")
def m2(spark, sf):
    return _axis_cells(spark, sf, X.sigmoid, "p")


@query("m2_softmax", "WITH" + V.SOFT + f" SELECT vec_id, ax_no, pos, {V.sql_r6('p')} AS p FROM sm")
def m2_softmax(spark, sf):
    return _axis_cells(spark, sf, X.softmax, "p")


@query("m2_relu", "WITH" + V.LOGITS + f" SELECT vec_id, ax_no, pos, {V.sql_r6('greatest(x, 0)')} AS x FROM lg")
def m2_relu(spark, sf):
    return _axis_cells(spark, sf, lambda part: F.transform(part, X.relu))


@query("m3_normalise", "WITH" + V.PROBS + f""" SELECT vec_id, ax_no, pos,
    {V.sql_r6('p / (sum(p) OVER (PARTITION BY vec_id, ax_no) + 1e-5)')} AS p FROM pr""")
def m3(spark, sf):
    return _axis_cells(spark, sf, lambda part: X.normalise(X.sigmoid(part)), "p")


# ---------------------------------------------------------------------- losses

EMD = "WITH" + V.GAP + "," + V.GOLD + "," + "{probs}" + """,
j AS (
  SELECT t.vec_id, t.ax_no, t.pos, t.p, g.y, gaps.gap
  FROM {source} t JOIN gaps ON gaps.ax_no = t.ax_no AND gaps.pos = t.pos
  JOIN gold_k g ON g.vec_id = t.vec_id AND g.label_idx = gaps.label_idx),
n AS (
  SELECT *, p / (sum(p) OVER w + 1e-5) - y / (sum(y) OVER w + 1e-5) AS diff
  FROM j WINDOW w AS (PARTITION BY vec_id, ax_no)),
cm AS (
  SELECT *, sum(diff) OVER (PARTITION BY vec_id, ax_no ORDER BY pos) AS cum FROM n),
per AS (
  SELECT vec_id, ax_no, sum(gap * cum * cum) AS between_, sum((p - y) * (p - y)) / 10 AS within_
  FROM cm GROUP BY vec_id, ax_no)
"""
MULTI_EMD = EMD.format(probs=V.PROBS + ", gold_k AS (SELECT vec_id, label_idx, y FROM gold)", source="pr")
SINGLE_EMD = EMD.format(probs=V.SOFT + ", gold_k AS (SELECT vec_id, label_idx, (label_idx = label)::INT AS y FROM gold)", source="sm")


def _emd(spark, sf, kind="multi", parts=False):
    rows, axes = V.logit_rows(spark, sf), V.axes(spark, sf)
    gold = F.col("gold")
    if kind == "single":
        from affectlake.functions.labels import one_hot

        gold = one_hot("label", K)
    return rows.select("vec_id", X.emd_loss("logits", gold, axes.orders, axes.gaps, kind, parts).alias("e"))


@query("m4_between_class_loss", MULTI_EMD + f"SELECT vec_id, ax_no::INT AS ax_no, {V.sql_r6('between_')} AS loss FROM per")
def m4(spark, sf):
    parts = F.array(*[F.col(f"e.between_{a}") for a in "vad"])
    return _emd(spark, sf, parts=True).select("vec_id", F.posexplode(parts).alias("ax_no", "l")).select("vec_id", "ax_no", V.r6("l").alias("loss"))


@query("m5_within_class_loss", MULTI_EMD + f"SELECT vec_id, ax_no::INT AS ax_no, {V.sql_r6('within_')} AS loss FROM per")
def m5(spark, sf):
    from affectlake.functions.labels import permute

    losses = [
        X.within_class_loss(X.sigmoid(X.axis_part("logits", i, K)), permute("gold", order), K)
        for i, order in enumerate(V.axes(spark, sf).orders)
    ]
    rows = V.logit_rows(spark, sf).select("vec_id", F.posexplode(F.array(*losses)).alias("ax_no", "l"))
    return rows.select("vec_id", "ax_no", V.r6("l").alias("loss"))


@query("m6_emd_loss", MULTI_EMD + f"SELECT vec_id, {V.sql_r6('sum(between_ + within_) / 3')} AS loss FROM per GROUP BY vec_id")
def m6(spark, sf):
    return _emd(spark, sf).select("vec_id", V.r6("e").alias("loss"))


@query("m6_emd_loss_single", SINGLE_EMD + f"SELECT vec_id, {V.sql_r6('sum(between_ + within_) / 3')} AS loss FROM per GROUP BY vec_id")
def m6_single(spark, sf):
    return _emd(spark, sf, "single").select("vec_id", V.r6("e").alias("loss"))


BCE = "greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))"
AXIS_GOLD = "," + V.GOLD + "," + V.LOGITS + """,
j AS (
  SELECT t.vec_id, t.ax_no, t.pos, t.x, g.y, (g.label = g.label_idx)::INT AS own
  FROM lg t JOIN ord ON ord.ax_no = t.ax_no AND ord.pos = t.pos
  JOIN gold g ON g.vec_id = t.vec_id AND g.label_idx = ord.label_idx)"""


@query("m7_axis_cross_entropy", "WITH" + V.ORD + AXIS_GOLD + f" SELECT vec_id, {V.sql_r6(f'sum({BCE}) / 10')} AS loss FROM j GROUP BY vec_id")
def m7(spark, sf):
    axes = V.axes(spark, sf)
    return V.logit_rows(spark, sf).select("vec_id", V.r6(X.axis_cross_entropy("logits", "gold", axes.orders)).alias("loss"))


@query("m7_axis_cross_entropy_single", "WITH" + V.ORD + AXIS_GOLD + """,
    l AS (SELECT vec_id, ax_no, ln(sum(exp(x))) - sum(x * own) AS l FROM j GROUP BY vec_id, ax_no)
    SELECT vec_id, """ + V.sql_r6("sum(l)") + " AS loss FROM l GROUP BY vec_id")
def m7_single(spark, sf):
    from affectlake.functions.labels import one_hot

    axes = V.axes(spark, sf)
    return V.logit_rows(spark, sf).select(
        "vec_id", V.r6(X.axis_cross_entropy("logits", one_hot("label", K), axes.orders, "single")).alias("loss")
    )


CLASS_LOGITS = "WITH" + V.GOLD + "," + V.LOGITS + """,
j AS (SELECT lg.vec_id, lg.pos, lg.x, g.y, g.label FROM lg JOIN gold g ON g.vec_id = lg.vec_id AND g.label_idx = lg.pos
      WHERE lg.ax_no = 0)"""


@query("m8_class_loss_multi", CLASS_LOGITS + f" SELECT vec_id, {V.sql_r6(f'avg({BCE})')} AS loss FROM j GROUP BY vec_id")
def m8(spark, sf):
    return V.logit_rows(spark, sf).select("vec_id", V.r6(X.binary_loss(X.axis_part("logits", 0, K), "gold")).alias("loss"))


@query("m8_class_loss_single", CLASS_LOGITS + f" SELECT vec_id, {V.sql_r6('ln(sum(exp(x))) - sum(CASE WHEN pos = label THEN x ELSE 0 END)')} AS loss FROM j GROUP BY vec_id")
def m8_single(spark, sf):
    return V.logit_rows(spark, sf).select("vec_id", V.r6(X.class_loss(X.axis_part("logits", 0, K), "label")).alias("loss"))


@query("m9_regression_loss", "WITH" + V.LOGITS + """,
    w AS (SELECT vec_id, max(x) FILTER (pos = 0) AS v, max(x) FILTER (pos = 1) AS a, max(x) FILTER (pos = 2) AS d
          FROM lg WHERE ax_no = 0 GROUP BY vec_id)
    SELECT vec_id, """ + V.sql_r6("(pow(greatest(v, 0) - embedding[11], 2) + pow(greatest(a, 0) - embedding[12], 2) + pow(greatest(d, 0) - embedding[13], 2)) / 3") + """ AS loss
    FROM w JOIN embeddings USING (vec_id)""")
def m9(spark, sf):
    outputs = [F.col("logits")[i] for i in range(3)]
    return V.logit_rows(spark, sf).select("vec_id", V.r6(X.regression_loss(outputs, ["gv", "ga", "gd"])).alias("loss"))


# ------------------------------------------------------------------ predictions

def predictions(spark, sf, kind="multi"):
    """Logit rows with the struct of expected scores and classes."""
    axes = V.axes(spark, sf)
    return V.logit_rows(spark, sf).withColumn("e", X.vad_and_classes("logits", axes.orders, axes.scores, kind))


@query("m10_expected_vad", V.EXPECTED + " SELECT vec_id, " + ", ".join(f"{V.sql_r6(f'e_{a}')} AS e_{a}" for a in "vad") + " FROM wide")
def m10(spark, sf):
    return predictions(spark, sf).select("vec_id", *[V.r6(f"e.{a}").alias(f"e_{a}") for a in "vad"])


@query("m10_expected_vad_native", V.EXPECTED + " SELECT vec_id, " + ", ".join(f"{V.sql_r6(f'e_{a}')} AS e_{a}" for a in "vad") + " FROM wide")
def m10_native(spark, sf):
    scores = V.axes(spark, sf).scores
    return V.logit_rows(spark, sf).select("vec_id", *[
        V.r6(X.weighted_sum(X.sigmoid(X.axis_part("logits", i, K)), scores[i])).alias(f"e_{a}") for i, a in enumerate("vad")
    ])


@query("m11_multi_classes", V.PRED + " SELECT vec_id, label_idx, p FROM pred")
def m11(spark, sf):
    return predictions(spark, sf).select("vec_id", F.posexplode("e.classes").alias("label_idx", "p"))


@query("m12_single_class", V.PRED + " SELECT vec_id, c AS class FROM cls")
def m12(spark, sf):
    return predictions(spark, sf, "single").select("vec_id", F.col("e.classes")[0].alias("class"))


@query("m13_threshold_classes", "WITH" + V.LOGITS + " SELECT vec_id, pos, (x >= 0)::INT AS p FROM lg WHERE ax_no = 0")
def m13(spark, sf):
    return V.logit_rows(spark, sf).select("vec_id", F.posexplode(X.threshold_classes(X.axis_part("logits", 0, K))).alias("pos", "p"))


@query("m14_argmax_class", "WITH" + V.LOGITS + " SELECT vec_id, arg_min(pos, (-x, pos)) AS class FROM lg WHERE ax_no = 0 GROUP BY vec_id")
def m14(spark, sf):
    return V.logit_rows(spark, sf).select("vec_id", X.first_argmax(X.axis_part("logits", 0, K)).alias("class"))


@query("m16_axis_head", V.EXPECTED + " SELECT vec_id, " + ", ".join(f"{V.sql_r6(f'greatest(e_{a}, 0)')} AS e_{a}" for a in "vad") + " FROM wide")
def m16(spark, sf):
    """Axis weights start as the sorted lexicon scores."""
    start = V.axes(spark, sf).scores
    rows = V.logit_rows(spark, sf)
    return rows.select("vec_id", *[
        V.r6(X.relu(X.weighted_sum(X.sigmoid(X.axis_part("logits", i, K)), start[i]))).alias(f"e_{a}")
        for i, a in enumerate("vad")
    ])


@query("m18_rounding", "SELECT o_orderkey, " + V.sql_even("o_totalprice / 8", 2) + " AS two, " + V.sql_even("o_totalprice / 16", 3) + " AS three FROM orders")
def m18(spark, sf):
    from affectlake.functions.rounding import round_even

    return V.table(spark, sf, "orders").select(
        "o_orderkey", round_even(F.col("o_totalprice") / 8, 2).alias("two"), round_even(F.col("o_totalprice") / 16, 3).alias("three")
    )


# ---------------------------------------------------------------------- metrics

CORRELATION = V.EXPECTED + """,
    g AS (SELECT w.*, embedding[11]::DOUBLE AS gv, embedding[12]::DOUBLE AS ga, embedding[13]::DOUBLE AS gd, vec_id % 3 AS part
          FROM wide w JOIN embeddings USING (vec_id))"""


def _vad(spark, sf):
    return predictions(spark, sf).select("vec_id", "gv", "ga", "gd", "e.v", "e.a", "e.d")


@query("a11_pearson", CORRELATION + f"""
    SELECT 'v' AS axis, count(*) AS n, {V.sql_r6('corr(e_v, gv)')} AS r FROM g
    UNION ALL SELECT 'a', count(*), {V.sql_r6('corr(e_a, ga)')} FROM g
    UNION ALL SELECT 'd', count(*), {V.sql_r6('corr(e_d, gd)')} FROM g""")
def a11(spark, sf):
    out = metrics.pearson(_vad(spark, sf), ["v", "a", "d"], ["gv", "ga", "gd"])
    return out.select("axis", "n", V.r6("r").alias("r"))


# The two-sided p-value of a correlation by the finite sums of Student's distribution
# for even and for odd degrees of freedom; the code under test uses the beta function.
P_VALUES = CORRELATION + """,
    pc AS (SELECT 'v' AS axis, count(*) AS n, corr(e_v, gv) AS r FROM g
           UNION ALL SELECT 'a', count(*), corr(e_a, ga) FROM g
           UNION ALL SELECT 'd', count(*), corr(e_d, gd) FROM g),
    ks AS (SELECT k, CASE WHEN k > 0 THEN ln((2 * k - 1) / (2 * k)::DOUBLE) ELSE 0 END AS le,
             CASE WHEN k > 0 THEN ln(2 * k / (2 * k + 1)::DOUBLE) ELSE 0 END AS lo
           FROM range(0, (SELECT max(n) FROM pc)) t(k)),
    cs AS (SELECT k, sum(le) OVER (ORDER BY k) AS ce, sum(lo) OVER (ORDER BY k) AS co FROM ks),
    sums AS (SELECT axis, n, r, sum(CASE
               WHEN n % 2 = 0 AND k <= (n - 4) // 2 THEN exp(ce + k * ln(1 - r * r))
               WHEN n % 2 = 1 AND k <= (n - 5) // 2 THEN exp(co + k * ln(1 - r * r)) ELSE 0 END) AS s
             FROM pc CROSS JOIN cs GROUP BY axis, n, r)"""


@query("a12_pearson_p_value", P_VALUES + f"""
    SELECT axis, n, {V.sql_r6('r')} AS r, {V.sql_r6('''1 - CASE WHEN n % 2 = 0 THEN abs(r) * s
      ELSE 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * s) END''')} AS p FROM sums""")
def a12(spark, sf):
    out = metrics.pearson_with_p(_vad(spark, sf), ["v", "a", "d"], ["gv", "ga", "gd"])
    return out.select("axis", "n", V.r6("r").alias("r"), V.r6("p").alias("p"))


CLASSES = V.PRED + """,
    k AS (SELECT label_idx, sum(y * p)::DOUBLE AS tp, sum(p)::DOUBLE AS np, sum(y)::DOUBLE AS ng FROM yp GROUP BY label_idx),
    f AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(ng, 0), 0) AS recall,
            coalesce(2 * tp / nullif(np + ng, 0), 0) AS f1, coalesce(tp / nullif(np + ng - tp, 0), 0) AS jaccard FROM k),
    rw AS (SELECT vec_id, sum(y * p)::DOUBLE AS i, sum(p)::DOUBLE AS np, sum(y)::DOUBLE AS ng FROM yp GROUP BY vec_id)"""
NAMES = ("precision", "recall", "f1", "jaccard")


def _select(average, source, exprs):
    return f"SELECT '{average}' AS average, " + ", ".join(f"{V.sql_r6(e)} AS {n}" for e, n in zip(exprs, NAMES)) + f" FROM {source}"


MICRO = _select("micro", "k", ["coalesce(sum(tp) / nullif(sum(np), 0), 0)", "coalesce(sum(tp) / nullif(sum(ng), 0), 0)", "coalesce(2 * sum(tp) / nullif(sum(np + ng), 0), 0)", "coalesce(sum(tp) / nullif(sum(np + ng - tp), 0), 0)"])
MACRO = _select("macro", "f", [f"avg({n})" for n in NAMES])
WEIGHTED = _select("weighted", "f", [f"sum({n} * ng) / sum(ng)" for n in NAMES])
SAMPLES = _select("samples", "rw", ["avg(coalesce(i / nullif(np, 0), 0))", "avg(coalesce(i / nullif(ng, 0), 0))", "avg(coalesce(2 * i / nullif(np + ng, 0), 0))", "avg(coalesce(i / nullif(np + ng - i, 0), 0))"])
EXACT = _select("accuracy", "rw", ["avg((np = ng AND np = i)::INT)"] * 4)


def _multi(spark, sf):
    return predictions(spark, sf).select("vec_id", "gold", F.col("e.classes").alias("pred"))


def _averages(spark, sf, wanted):
    means = metrics.averages(metrics.multi_label_counts(_multi(spark, sf), "gold", "pred"), "multi")
    return means.filter(F.col("average").isin(wanted)).select("average", *[V.r6(n).alias(n) for n in NAMES])


@query("a13_class_report", CLASSES + " SELECT label_idx, " + ", ".join(f"{V.sql_r6(n)} AS {n}" for n in NAMES) + ", ng::BIGINT AS support FROM f")
def a13(spark, sf):
    report = metrics.per_class_report(metrics.multi_label_counts(_multi(spark, sf), "gold", "pred"))
    return report.select("label_idx", *[V.r6(n).alias(n) for n in NAMES], "support")


for _name, _sql, _wanted in (
    ("a14_micro_average", MICRO, ["micro"]),
    ("a15_macro_average", MACRO, ["macro"]),
    ("a16_weighted_average", WEIGHTED, ["weighted"]),
    ("a17_samples_average", SAMPLES, ["samples"]),
):
    query(_name, CLASSES + " " + _sql)(lambda spark, sf, wanted=_wanted: _averages(spark, sf, wanted))


@query("a19_jaccard_samples", CLASSES + f" SELECT {V.sql_r6('avg(coalesce(i / nullif(np + ng - i, 0), 0))')} AS acc FROM rw")
def a19(spark, sf):
    return _averages(spark, sf, ["samples"]).select(F.col("jaccard").alias("acc"))


@query("a20_jaccard_scores", CLASSES + f""" SELECT (SELECT {V.sql_r6('avg(jaccard)')} FROM f) AS macro,
    (SELECT {V.sql_r6('sum(tp) / sum(np + ng - tp)')} FROM k) AS micro""")
def a20(spark, sf):
    rows = _averages(spark, sf, ["micro", "macro"])
    return rows.agg(*[F.max(F.when(F.col("average") == a, F.col("jaccard"))).alias(a) for a in ("macro", "micro")])


@query("a18_accuracy", V.PRED + f" SELECT {V.sql_r6('avg((c = label)::INT)')} AS accuracy FROM cls JOIN embeddings USING (vec_id)")
def a18(spark, sf):
    rows = predictions(spark, sf, "single").select("label", F.col("e.classes")[0].alias("class"))
    return metrics.accuracy(rows, "label", "class").select(V.r6("accuracy").alias("accuracy"))


SINGLE = V.PRED + """,
    s AS (SELECT label AS g, c AS p FROM cls JOIN embeddings USING (vec_id)),
    ids AS (SELECT g AS label_idx FROM s UNION SELECT p FROM s),
    k AS (SELECT label_idx, count(*) FILTER (g = label_idx AND p = label_idx)::DOUBLE AS tp,
            count(*) FILTER (p = label_idx)::DOUBLE AS np, count(*) FILTER (g = label_idx)::DOUBLE AS ng
          FROM ids, s GROUP BY label_idx),
    f AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(ng, 0), 0) AS recall,
            coalesce(2 * tp / nullif(np + ng, 0), 0) AS f1, coalesce(tp / nullif(np + ng - tp, 0), 0) AS jaccard FROM k)"""


@query("a15_single_label_averages", SINGLE + " " + MICRO + " UNION ALL " + MACRO + " UNION ALL " + WEIGHTED)
def a15_single(spark, sf):
    rows = predictions(spark, sf, "single").select("label", F.col("e.classes")[0].alias("class"))
    means = metrics.averages(metrics.single_label_counts(rows, "label", "class"), "single")
    return means.filter("average <> 'accuracy'").select("average", *[V.r6(n).alias(n) for n in NAMES])


@query("a21_mean_loss", MULTI_EMD + f", r AS (SELECT vec_id, sum(between_ + within_) / 3 AS l FROM per GROUP BY vec_id) SELECT {V.sql_r6('avg(l)')} AS loss FROM r")
def a21(spark, sf):
    return metrics.mean_loss(_emd(spark, sf), "e").select(V.r6("loss").alias("loss"))


@query("a21_batch_scaled_loss", MULTI_EMD + f""",
    r AS (SELECT vec_id, sum(between_ + within_) / 3 AS l, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS b FROM per GROUP BY vec_id),
    m AS (SELECT avg(l) AS m, count(*) AS n FROM r GROUP BY b) SELECT {V.sql_r6('sum(m) / sum(n)')} AS loss FROM m""")
def a21_scaled(spark, sf):
    batched = splits.sequential_batches(_emd(spark, sf), "vec_id", 16)
    return metrics.batch_scaled_loss(batched, "e").select(V.r6("loss").alias("loss"))


@query("a22_size_check", "SELECT count(*) AS n, 0::BIGINT AS n_different, true AS ok FROM embeddings")
def a22(spark, sf):
    return metrics.check_sizes(_multi(spark, sf), "gold", "pred")


AVG_LONG = " UNION ALL ".join(
    f"SELECT 'average' AS metric_group, average AS name, '{m}' AS metric, {m} AS value FROM av" for m in ("precision", "recall", "f1")
)


@query("a23_evaluate_multi", CLASSES + f""",
    av AS ({MICRO} UNION ALL {MACRO} UNION ALL {WEIGHTED} UNION ALL {SAMPLES}),
    cl AS (""" + " UNION ALL ".join(f"SELECT 'class' AS metric_group, label_idx::VARCHAR AS name, '{m}' AS metric, {V.sql_r6(m if m != 'support' else 'ng')} AS value FROM f" for m in ("precision", "recall", "f1", "support")) + f""")
    SELECT * FROM cl UNION ALL {AVG_LONG}
    UNION ALL SELECT 'jaccard', average, 'jaccard', jaccard FROM av WHERE average <> 'weighted'""")
def a23(spark, sf):
    return metrics.evaluate(_multi(spark, sf), "multi", "gold", "pred").withColumn("value", V.r6("value"))


@query("a23_evaluate_single", SINGLE + f""",
    av AS ({MACRO} UNION ALL {WEIGHTED}),
    cl AS (""" + " UNION ALL ".join(f"SELECT 'class' AS metric_group, label_idx::VARCHAR AS name, '{m}' AS metric, {V.sql_r6(m if m != 'support' else 'ng')} AS value FROM f" for m in ("precision", "recall", "f1", "support")) + f""")
    SELECT * FROM cl UNION ALL {AVG_LONG}
    UNION ALL SELECT 'accuracy', 'all', 'accuracy', {V.sql_r6('avg((g = p)::INT)')} FROM s""")
def a23_single(spark, sf):
    rows = predictions(spark, sf, "single").select("label", F.col("e.classes")[0].alias("class"))
    return metrics.evaluate(rows, "single", "label", "class").withColumn("value", V.r6("value"))


G7_SPLIT = "CASE vec_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END"


def with_split(rows):
    part = F.when(F.col("vec_id") % 3 == 0, "valid").when(F.col("vec_id") % 3 == 1, "test").otherwise("train")
    return rows.withColumn("split", part)


@query("g7_evaluate_splits", CORRELATION + f""", s AS (SELECT *, {G7_SPLIT} AS split FROM g)
    SELECT """ + ", ".join(f"{V.sql_r6(f'''corr(e_{a}, g{a}) FILTER (split = '{s}')''')} AS {s}_{a}" for s in ("valid", "test") for a in "vad") + " FROM s")
def g7(spark, sf):
    from affectlake.sinks.results import METRIC_SOURCES

    table = metrics.evaluate(with_split(_vad(spark, sf)), "vad", ["gv", "ga", "gd"], ["v", "a", "d"], ["split"])
    wanted = {k: v for k, v in METRIC_SOURCES["vad"].items() if not k.endswith("_p")}
    row = metrics.result_row(table, "split", wanted)
    return row.select(*[V.r6(c).alias(c) for c in row.columns])


@query("g6_batch_scoring", V.PRED + """,
    ev AS (SELECT pr.vec_id, """ + ", ".join(f"sum(pr.p * ord.score) FILTER (pr.ax_no = {i}) AS {a}" for i, a in enumerate("vad")) + """
           FROM pr JOIN ord ON pr.ax_no = ord.ax_no AND pr.pos = ord.pos GROUP BY pr.vec_id)
    SELECT ev.vec_id, """ + ", ".join(f"{V.sql_r6(a)} AS {a}" for a in "vad") + """, string_agg(p::VARCHAR, ',' ORDER BY label_idx) AS classes
    FROM ev JOIN pred USING (vec_id) GROUP BY ev.vec_id, v, a, d""")
def g6(spark, sf):
    """The flagship of the bench: vectors to scores and classes in one scan."""
    return predictions(spark, sf).select(
        "vec_id", *[V.r6(f"e.{a}").alias(a) for a in "vad"],
        F.array_join(F.col("e.classes").cast("array<string>"), ",").alias("classes"),
    )


# ----------------------------------------------------- the same work on more rows

LINE_K = 8
LINE_SCORES = [[((i * 5 + s * 3) % 11) / 10 for i in range(LINE_K)] for s in range(3)]


def _line_axes():
    orders = [sorted(range(LINE_K), key=lambda i, s=s: (s[i], i)) for s in LINE_SCORES]
    scores = [[s[i] for i in o] for s, o in zip(LINE_SCORES, orders)]
    gaps = [[b - a for a, b in zip(s, s[1:])] + [0.0] for s in scores]
    return orders, scores, gaps


def line_rows(spark, sf):
    """Every order line as 3 x 8 logits and an 8-label gold array."""
    logits = [
        f"(l_quantity / 25 - 1) * {(j * 7) % 5 - 2} + (l_discount * 20 - 1) * {((j * 3) % 7 - 3) / 2} + (l_tax * 25 - 1) * {((j * 11) % 9 - 4) / 4}"
        for j in range(3 * LINE_K)
    ]
    gold = [f"int((l_linenumber + l_suppkey * {j + 1}) % 4 = 0)" for j in range(LINE_K)]
    return V.spread_table(spark, sf, "lineitem", "l_orderkey").select(
        "l_returnflag", F.expr(f"array({', '.join(logits)})").alias("logits"), F.expr(f"array({', '.join(gold)})").alias("gold")
    )


def _line_sql():
    orders, scores, gaps = _line_axes()
    cells = ", ".join(
        f"({a}, {p}, {orders[a][p]}, {scores[a][p]!r}::DOUBLE, {gaps[a][p]!r}::DOUBLE)" for a in range(3) for p in range(LINE_K)
    )
    return f"""
    WITH cells(ax_no, pos, label_idx, score, gap) AS (VALUES {cells}),
    li AS (SELECT row_number() OVER () AS id, * FROM lineitem),
    pr AS (
      SELECT id, l_returnflag, ax_no, pos, label_idx, gap, ((l_linenumber + l_suppkey * (label_idx + 1)) % 4 = 0)::INT AS y,
        (l_quantity / 25 - 1) * ((j * 7) % 5 - 2) + (l_discount * 20 - 1) * (((j * 3) % 7 - 3) / 2::DOUBLE) + (l_tax * 25 - 1) * (((j * 11) % 9 - 4) / 4::DOUBLE) AS x
      FROM li, (SELECT *, ax_no * {LINE_K} + pos AS j FROM cells) c),
    pp AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM pr)"""


LINE_SQL = _line_sql()


@query("m6_emd_loss_lines", LINE_SQL + f""",
    n AS (SELECT *, p / (sum(p) OVER w + 1e-5) - y / (sum(y) OVER w + 1e-5) AS diff FROM pp WINDOW w AS (PARTITION BY id, ax_no)),
    c AS (SELECT *, sum(diff) OVER (PARTITION BY id, ax_no ORDER BY pos) AS cum FROM n),
    per AS (SELECT id, any_value(l_returnflag) AS f, sum(gap * cum * cum + (p - y) * (p - y) / {LINE_K}) / 3 AS l FROM c GROUP BY id)
    SELECT f AS l_returnflag, count(*) AS n, {V.sql_r6('avg(l)')} AS loss FROM per GROUP BY f""")
def m6_lines(spark, sf):
    orders, _, gaps = _line_axes()
    rows = line_rows(spark, sf).select("l_returnflag", X.emd_loss("logits", "gold", orders, gaps).alias("l"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), V.r6(F.avg("l")).alias("loss"))


@query("a13_class_report_lines", LINE_SQL + f""",
    pred AS (SELECT id, label_idx, any_value(l_returnflag) AS f, any_value(y) AS y, (exp(sum(ln(p)) / 3) >= 0.5)::INT AS p FROM pp GROUP BY id, label_idx),
    k AS (SELECT f, label_idx, sum(y * p)::DOUBLE AS tp, sum(p)::DOUBLE AS np, sum(y)::DOUBLE AS ng FROM pred GROUP BY f, label_idx)
    SELECT f AS l_returnflag, label_idx, {V.sql_r6('coalesce(tp / nullif(np, 0), 0)')} AS precision,
      {V.sql_r6('coalesce(tp / nullif(ng, 0), 0)')} AS recall, {V.sql_r6('coalesce(2 * tp / nullif(np + ng, 0), 0)')} AS f1,
      {V.sql_r6('coalesce(tp / nullif(np + ng - tp, 0), 0)')} AS jaccard, ng::BIGINT AS support FROM k""")
def a13_lines(spark, sf):
    orders, scores, _ = _line_axes()
    rows = line_rows(spark, sf).withColumn("pred", X.vad_and_classes("logits", orders, scores)["classes"])
    counts = metrics.multi_label_counts(rows, "gold", "pred", ["l_returnflag"])
    report = metrics.per_class_report(counts, ["l_returnflag"])
    return report.select("l_returnflag", "label_idx", *[V.r6(n).alias(n) for n in NAMES], "support")
