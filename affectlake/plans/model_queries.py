"""Token sequences and heads fitted on the vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from affectlake.functions import text as T
from affectlake.functions import vectors as X
from affectlake.operators import heads, metrics, sequences, splits
from affectlake.plans import views as V
from affectlake.plans.registry import query
from affectlake.plans.score_queries import MULTI_EMD
from affectlake.session import saved, shared_folder

WINDOW = 256
KEYS = ["conv_id", "turn", "role"]


# ------------------------------------------------------------------- sequences

def cleaned_turns(spark, sf):
    turns = V.table(spark, sf, "conversations")
    return turns.select(*KEYS, T.clean_dialogue(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))


def encoded_turns(spark, sf):
    blocks = sequences.token_blocks(cleaned_turns(spark, sf), KEYS)
    vocab = saved(sequences.block_vocabulary(blocks))
    return sequences.encode_blocks(blocks, vocab, WINDOW), vocab


TURN_TEXT = V.sql_dialogue("replace(text, chr(10), ' ')")
BODY = WINDOW - 2
SEQUENCE = f"""
WITH c AS (SELECT conv_id, turn, role, {TURN_TEXT} AS text FROM conversations),
tk AS (SELECT conv_id, turn, role, list_filter(string_split(text, ' '), lambda t: t <> '') AS ws FROM c WHERE text <> ''),
cnt AS (SELECT token, count(*) AS n FROM (SELECT unnest(ws) AS token FROM tk) GROUP BY token),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM cnt),
body AS (
  SELECT conv_id, turn, role, (place - 1) // {BODY} AS window_no, (place - 1) % {BODY} + 1 AS pos, token_id AS id FROM (
    SELECT conv_id, turn, role, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS place FROM tk) JOIN vocab USING (token)),
lens AS (SELECT conv_id, turn, role, window_no, count(*) AS n FROM body GROUP BY ALL),
seq AS (
  SELECT lens.conv_id, lens.turn, lens.role, lens.window_no, p::INT AS pos,
    CASE WHEN p = 0 THEN 2 WHEN p = n + 1 THEN 3 WHEN p > n + 1 THEN 0 ELSE id END::INT AS id, (p <= n + 1)::INT AS mask
  FROM lens CROSS JOIN range({WINDOW}) t(p) LEFT JOIN body
    ON body.conv_id = lens.conv_id AND body.turn = lens.turn AND body.role = lens.role
    AND body.window_no = lens.window_no AND body.pos = p)"""


@query("t1_vocabulary", SEQUENCE + " SELECT token, token_id, n FROM vocab")
def t1_vocabulary(spark, sf):
    return sequences.vocabulary(cleaned_turns(spark, sf))


@query("t1_block_vocabulary", SEQUENCE + " SELECT token, token_id, n FROM vocab")
def t1_block_vocabulary(spark, sf):
    return sequences.block_vocabulary(sequences.token_blocks(cleaned_turns(spark, sf), KEYS))


@query("t1_input_ids", SEQUENCE + " SELECT conv_id, turn, window_no, pos, id FROM seq")
def t1(spark, sf):
    rows, _ = encoded_turns(spark, sf)
    return rows.select("conv_id", "turn", "window_no", F.posexplode("input_ids").alias("pos", "id"))


@query("t1_no_token_lost", SEQUENCE + """
    SELECT (SELECT sum(len(ws))::BIGINT FROM tk) AS n_words, (SELECT sum(n)::BIGINT FROM vocab) AS n_counted,
           (SELECT count(*) FROM seq WHERE id > 3) AS n_encoded, (SELECT count(*) FROM seq WHERE id = 1) AS n_unknown""")
def t1_total(spark, sf):
    """Words of the texts, of the vocabulary and of the windows: one number three times."""
    rows, vocab = encoded_turns(spark, sf)
    words = cleaned_turns(spark, sf).agg(F.sum(F.size(sequences.tokens("text"))).alias("n_words"))
    known = F.size(F.filter("input_ids", lambda i: i > sequences.END))
    unknown = F.size(F.filter("input_ids", lambda i: i == sequences.UNKNOWN))
    return words.join(vocab.agg(F.sum("n").alias("n_counted")), how="cross").join(
        rows.agg(F.sum(known).alias("n_encoded"), F.sum(unknown).alias("n_unknown")), how="cross")


@query("t2_attention_mask", SEQUENCE + " SELECT conv_id, turn, window_no, sum(mask)::BIGINT AS n_real, count(*) AS n FROM seq GROUP BY ALL")
def t2(spark, sf):
    rows, _ = encoded_turns(spark, sf)
    ones = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return rows.select("conv_id", "turn", "window_no", ones.cast("long").alias("n_real"), F.size("attention_mask").cast("long").alias("n"))


@query("t3_decode", SEQUENCE + """
    SELECT conv_id, turn, window_no, string_agg(token, ' ' ORDER BY pos) AS text
    FROM body JOIN vocab ON id = token_id GROUP BY ALL""")
def t3(spark, sf):
    rows, vocab = encoded_turns(spark, sf)
    return sequences.decode(rows, vocab, ["conv_id", "turn", "window_no"], special=False)


@query("t4_encode_splits", SEQUENCE + " SELECT role AS split, count(*) FILTER (mask = 1) AS n_tokens, count(DISTINCT (conv_id, turn, window_no)) AS n_rows FROM seq GROUP BY role")
def t4(spark, sf):
    rows, _ = encoded_turns(spark, sf)
    ones = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return rows.groupBy(F.col("role").alias("split")).agg(F.sum(ones).alias("n_tokens"), F.count("*").alias("n_rows"))


SHIFTED = "lead(id) OVER (PARTITION BY conv_id, turn, window_no ORDER BY pos)"


@query("m17_shift_left", SEQUENCE + f" SELECT conv_id, turn, window_no, pos, coalesce({SHIFTED}, 0)::INT AS target FROM seq")
def m17(spark, sf):
    rows, _ = encoded_turns(spark, sf)
    return rows.select("conv_id", "turn", "window_no", F.posexplode(X.shift_left("input_ids")).alias("pos", "target"))


BIGRAM = SEQUENCE + f""",
nx AS (SELECT id AS cur, {SHIFTED} AS target FROM seq),
pc AS (SELECT cur, target, count(*) AS n FROM nx WHERE target <> 0 GROUP BY cur, target),
lm AS (SELECT n, ln(n / sum(n) OVER (PARTITION BY cur)) AS log_p FROM pc)"""


@query("m20_bigram_loss", BIGRAM + f" SELECT {V.sql_r6('-sum(n * log_p) / sum(n)')} AS lm_loss FROM lm")
def m20(spark, sf):
    rows, _ = encoded_turns(spark, sf)
    return sequences.bigram_loss(sequences.bigram_counts(rows)).select(V.r6("lm_loss").alias("lm_loss"))


@query("m20_bigram_counts", BIGRAM + " SELECT cur, target, n FROM pc")
def m20_counts(spark, sf):
    rows, _ = encoded_turns(spark, sf)
    return sequences.bigram_counts(rows)


@query("m19_combined_objective", BIGRAM + "," + MULTI_EMD.replace("WITH", "", 1) + f""",
    r AS (SELECT vec_id, sum(between_ + within_) / 3 AS l FROM per GROUP BY vec_id)
    SELECT vec_id, {V.sql_r6('(SELECT -sum(n * log_p) / sum(n) FROM lm) * exp(-4.6::DOUBLE) + l')} AS loss FROM r""")
def m19(spark, sf):
    axes = V.axes(spark, sf)
    rows, _ = encoded_turns(spark, sf)
    lm = sequences.bigram_loss(sequences.bigram_counts(rows)).first()["lm_loss"]
    scored = V.logit_rows(spark, sf).select("vec_id", X.emd_loss("logits", "gold", axes.orders, axes.gaps).alias("e"))
    return scored.select("vec_id", V.r6(X.combined_objective(F.lit(lm), "e")).alias("loss"))


# ----------------------------------------------------------------------- heads

def vectors(spark, sf):
    rows = V.table(spark, sf, "embeddings")
    gold = [(3 + 4 * F.col("embedding")[i].cast("double")).alias(n) for i, n in ((10, "gv"), (11, "ga"), (12, "gd"))]
    # All components but the three that the gold scores are made of.
    vector = F.concat(F.slice("embedding", 1, 10), F.slice("embedding", 14, V.WIDTH - 13)).cast("array<double>").alias("vector")
    part = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "valid").otherwise("train")
    return rows.select("vec_id", "label", V.gold_array().alias("gold"), vector, part.alias("split"), *gold)


# Twins of the fitted heads: the same rows in SQL, sums of products, and elimination.
SQL_ROWS = f"""
WITH rw AS (
  SELECT vec_id, label, CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split,
    embedding[1:10]::DOUBLE[] || embedding[14:{V.WIDTH}]::DOUBLE[] || [1.0::DOUBLE] AS x,
    [3 + 4 * embedding[11]::DOUBLE, 3 + 4 * embedding[12]::DOUBLE, 3 + 4 * embedding[13]::DOUBLE] AS y
  FROM embeddings)"""
PLACES = V.WIDTH - 2  # components but three, and the bias


def sql_solved(size: int) -> str:
    """From ``gram (key, i, j, v)``, symmetric in the first ``size`` columns, to ``solved (key, m)``."""
    return f""",
m0 AS (SELECT key, list(r ORDER BY i) AS m FROM (SELECT key, i, list(v ORDER BY j) AS r FROM gram GROUP BY key, i) GROUP BY key),
solved AS (SELECT key, m FROM (
  WITH RECURSIVE e AS (
    SELECT key, 1 AS k, m FROM m0
    UNION ALL SELECT key, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
      ELSE list_transform(r, lambda x, j: x - r[k] / m[k][k] * m[k][j]) END) FROM e WHERE k <= {size})
  SELECT * FROM e) WHERE k = {size + 1})"""


@query("g2_vad_scores", SQL_ROWS + f""",
    z AS (SELECT x || y AS z FROM rw WHERE split = 'train'),
    gram AS (SELECT 0 AS key, i, j, sum(z[i] * z[j]) + CASE WHEN i = j AND i < {PLACES} THEN count(*) * 1e-6 ELSE 0 END AS v
      FROM z, range(1, {PLACES + 1}) a(i), range(1, {PLACES + 4}) b(j) GROUP BY i, j)""" + sql_solved(PLACES) + """
    SELECT vec_id, """ + ", ".join(
        V.sql_r6(f"greatest(list_sum(list_transform(x, lambda e, i: e * m[i][{PLACES + t + 1}])), 0)") + f" AS {a}"
        for t, a in enumerate("vad")) + " FROM rw, solved")
def g2_scores(spark, sf):
    """Scores of all rows by least squares on the train rows."""
    rows = vectors(spark, sf)
    weights, bias = heads.fit_vad_regression(rows.filter("split = 'train'"), "vector", ["gv", "ga", "gd"])
    scored = rows.select("vec_id", X.linear_head("vector", weights, bias).alias("o"))
    return scored.select("vec_id", *[V.r6(X.relu(F.col("o")[i])).alias(a) for i, a in enumerate("vad")])


@query("g4_frozen_stage", "WITH" + V.PROBS + f""",
    pl AS (SELECT vec_id, ax_no, list(p ORDER BY pos) || [any_value(3 + 4 * embedding[11 + ax_no]::DOUBLE)] AS z
           FROM pr JOIN embeddings USING (vec_id) GROUP BY vec_id, ax_no),
    gram AS (SELECT ax_no AS key, i, j, sum(z[i] * z[j]) + CASE WHEN i = j THEN count(*) * 1e-6 ELSE 0 END AS v
      FROM pl, range(1, {V.K + 1}) a(i), range(1, {V.K + 2}) b(j) WHERE vec_id % 5 > 1 GROUP BY ax_no, i, j)""" + sql_solved(V.K) + f"""
    SELECT key::INT AS axis, (i - 1)::INT AS label_idx, {V.sql_r6(f'm[i][{V.K + 1}]')} AS weight FROM solved, range(1, {V.K + 1}) t(i)""")
def g4_frozen(spark, sf):
    """Axis weights on the label probabilities of the fixed head, which stays frozen."""
    rows = vectors(spark, sf).select("vec_id", "split", "gv", "ga", "gd").join(V.logit_rows(spark, sf).select("vec_id", "logits"), "vec_id")
    axis = heads.axis_regression(rows.filter("split = 'train'"), "logits", ["gv", "ga", "gd"], V.K)
    cells = [(i, j, float(w)) for i, row in enumerate(axis) for j, w in enumerate(row)]
    return spark.createDataFrame(cells, "axis int, label_idx int, weight double").select("axis", "label_idx", V.r6("weight").alias("weight"))


RIDGE = 1e-3


def _class_moments(rows, weights, bias, probabilities):
    """Mean product of every class's probability with every component, plus what the penalty adds.

    At the best weights this is the mean over the rows that have the class.
    """
    listed = [[float(v) for v in (*w * RIDGE, 0.0)] for w in weights]
    z = X.linear_head("vector", weights, bias)
    p = rows.select(F.concat("vector", F.array(F.lit(1.0))).alias("x"), probabilities(z).alias("p"))
    one = p.select("x", F.posexplode("p").alias("class_idx", "p")).select("class_idx", "p", F.posexplode("x").alias("place", "x"))
    penalty = F.get(F.get(F.lit(listed), F.col("class_idx")), F.col("place"))
    means = one.groupBy("class_idx", "place").agg(F.avg(F.col("p") * F.col("x")).alias("m"))
    return means.select("class_idx", "place", V.r6(F.col("m") + penalty).alias("moment"))


def _sql_class_moments(rows: str, has: str) -> str:
    return f"""
    SELECT c::INT AS class_idx, (j - 1)::INT AS place, {V.sql_r6(f"sum(CASE WHEN {has} THEN x[j] ELSE 0 END) / count(*)")} AS moment
    FROM {rows}, range({V.K}) k(c), range(1, {PLACES + 1}) t(j) GROUP BY c, j"""


def _fitted_moments(rows):
    weights, bias, norm = heads.fit_multinomial(rows, "vector", "label", V.K, RIDGE)
    if norm > 1e-9:
        raise RuntimeError(f"the fit did not end: gradient {norm}")
    return _class_moments(rows, weights, bias, X.softmax)


@query("g1_single_label_moments", SQL_ROWS + _sql_class_moments("(FROM rw WHERE split = 'train')", "label = c"))
def g1_moments(spark, sf):
    """The fitted classifier's moments, which are those of the labels only at the best weights."""
    return _fitted_moments(vectors(spark, sf).filter("split = 'train'"))


@query("g5_few_shot_moments", SQL_ROWS + """,
    few AS (SELECT * FROM rw WHERE split = 'train' QUALIFY row_number() OVER (ORDER BY vec_id) <= floor(0.2 * count(*) OVER ()))""" +
    _sql_class_moments("few", "label = c"))
def g5_moments(spark, sf):
    """The same on the first fifth of the training rows."""
    return _fitted_moments(splits.few_shot(vectors(spark, sf).filter("split = 'train'"), "vec_id", 0.2))


@query("g1_multi_label_moments", SQL_ROWS + _sql_class_moments("(FROM rw WHERE split = 'train')", "label = c OR (vec_id * 7 + c * 13) % 10 < 2"))
def g1_multi_moments(spark, sf):
    rows = vectors(spark, sf).filter("split = 'train'")
    weights, bias, norm = heads.fit_binomials(rows, "vector", "gold", V.K, RIDGE)
    if norm > 1e-9:
        raise RuntimeError(f"the fit did not end: gradient {norm}")
    return _class_moments(rows, weights, bias, X.sigmoid)


BATCH, EPOCHS, FROZEN = 2_000, 4, 2


@query("g4_batched_stages", f"""
    WITH n AS (SELECT ceil(count(*) / {BATCH}::DOUBLE)::INT AS steps FROM embeddings WHERE vec_id % 5 > 1)
    SELECT e::INT AS epoch, steps, (steps * e)::INT AS n_updates, e <= {FROZEN} AS frozen,
      CASE WHEN e <= {FROZEN} THEN 0.05 ELSE 0.02 END::DOUBLE AS rate, e > 1 AS lower FROM n, range(1, {EPOCHS + 1}) t(e)""")
def g4_batched(spark, sf):
    """Mini-batches, frozen epochs, the switched rate: a row per epoch, and that its loss is below the first one's."""
    axes = V.axes(spark, sf)
    rows = vectors(spark, sf).filter("split = 'train'").select("vec_id", "vector", "gv", "ga", "gd")
    head, bias = np.zeros((3 * V.K, V.WIDTH - 3)), np.zeros(3 * V.K)
    axis = np.array([axes.scores[i] for i in range(3)])
    *_, logged = heads.fit_two_stage_batches(
        rows, "vec_id", "vector", ["gv", "ga", "gd"], head, bias, axis, V.K, BATCH, EPOCHS, FROZEN, 0.05, 0.02)
    listed = [(e["epoch"], e["steps"], e["n_updates"], e["frozen"], e["rate"], bool(e["loss"] < logged[0]["loss"])) for e in logged]
    return spark.createDataFrame(listed, "epoch int, steps int, n_updates int, frozen boolean, rate double, lower boolean")


@query("g1_single_label_head")
def g1(spark, sf):
    """Class index from the vector; accuracy and F1 per split."""
    rows = vectors(spark, sf)
    model = heads.fit_single_label(rows.filter("split = 'train'"), "vector", "label")
    scored = heads.single_label_scores(model, rows, "vector")
    return metrics.evaluate(scored, "single", "label", "class", ["split"])


@query("g1_multi_label_head")
def g1_multi(spark, sf):
    """One binary classifier per label, scored as one dense head."""
    rows = vectors(spark, sf)
    models = heads.fit_multi_label(rows.filter("split = 'train'"), "vector", "gold", V.K)
    weights, bias = heads.multi_label_weights(models)
    scored = rows.withColumn("pred", X.threshold_classes(X.linear_head("vector", weights, bias)))
    return metrics.evaluate(scored, "multi", "gold", "pred", ["split"])


@query("g2_vad_regression_head")
def g2(spark, sf):
    rows = vectors(spark, sf)
    weights, bias = heads.fit_vad_regression(rows.filter("split = 'train'"), "vector", ["gv", "ga", "gd"])
    scored = rows.withColumn("o", X.linear_head("vector", weights, bias))
    scored = scored.select("split", "gv", "ga", "gd", *[X.relu(F.col("o")[i]).alias(a) for i, a in enumerate("vad")])
    return metrics.evaluate(scored, "vad", ["gv", "ga", "gd"], ["v", "a", "d"], ["split"])


def _category_head(spark, sf, steps=12):
    axes, rows = V.axes(spark, sf), vectors(spark, sf)
    weights, bias, losses = heads.fit_vad_from_categories(
        rows.filter("split = 'train'").select("vector", "gold"), "vector", "gold", axes, V.WIDTH - 3, steps=steps
    )
    return axes, rows, weights, bias, losses


@query("g3_vad_from_categories")
def g3(spark, sf):
    """Fit on categories with the distribution loss, evaluate scores zero-shot."""
    axes, rows, weights, bias, losses = _category_head(spark, sf)
    if not min(losses) < losses[0]:
        raise RuntimeError(f"the loss did not fall: {losses}")
    scored = rows.withColumn("e", X.vad_and_classes(X.linear_head("vector", weights, bias), axes.orders, axes.scores))
    scored = scored.select("split", "gv", "ga", "gd", "e.v", "e.a", "e.d")
    return metrics.evaluate(scored, "vad", ["gv", "ga", "gd"], ["v", "a", "d"], ["split"])


@query("g4_two_stage_regression")
def g4(spark, sf):
    """Frozen head with fitted axis weights, then everything together."""
    axes, rows, weights, bias, _ = _category_head(spark, sf, steps=6)
    train = rows.filter("split = 'train'")
    probed = train.withColumn("logits", X.linear_head("vector", weights, bias))
    axis = heads.axis_regression(probed, "logits", ["gv", "ga", "gd"], V.K)
    weights, bias, axis, losses = heads.fit_two_stage(train, "vector", ["gv", "ga", "gd"], weights, bias, axis, V.K, steps=6)
    if not min(losses[1:]) <= losses[0]:
        raise RuntimeError(f"the loss rose: {losses}")
    logits = X.linear_head("vector", weights, bias)
    outputs = rows.withColumn("logits", logits)
    scored = outputs.select("split", "gv", "ga", "gd", *[
        X.relu(X.weighted_sum(X.sigmoid(X.axis_part("logits", i, V.K)), axis[i])).alias(a) for i, a in enumerate("vad")
    ])
    return metrics.evaluate(scored, "vad", ["gv", "ga", "gd"], ["v", "a", "d"], ["split"])


@query("g5_few_shot_head")
def g5(spark, sf):
    """The first fifth of the training rows only."""
    rows = vectors(spark, sf)
    few = splits.few_shot(rows.filter("split = 'train'"), "vec_id", 0.2)
    model = heads.fit_single_label(few, "vector", "label", maxIter=10)
    scored = heads.single_label_scores(model, rows, "vector")
    return metrics.accuracy(scored, "label", "class", ["split"])


@query("g6_model_batches", "WITH" + V.LOGITS + f" SELECT vec_id, ax_no * {V.K} + pos AS pos, {V.sql_r6('x')} AS x FROM lg")
def g6_model(spark, sf):
    """A user's model, here the fixed head, applied batch by batch."""
    weights, bias = np.array(V.WEIGHTS).T, np.array(V.BIAS)

    def make_model():
        return lambda batch: batch.astype("float64") @ weights + bias

    rows = heads.score_batches(V.table(spark, sf, "embeddings"), "embedding", make_model, V.WIDTH)
    return rows.select("vec_id", F.posexplode("logits").alias("pos", "v")).select("vec_id", "pos", V.r6("v").alias("x"))


@query("g8_saved_head", "WITH" + V.LOGITS + f" SELECT vec_id, ax_no * {V.K} + pos AS pos, {V.sql_r6('x')} AS x FROM lg")
def g8(spark, sf):
    """Save the fixed head under two names, reload without the old output head."""
    path = shared_folder(spark)
    weights, bias = np.array(V.WEIGHTS), np.array(V.BIAS)
    tensors = {"head.weight": weights * 0, "head.bias": bias * 0, "v.weight": weights, "v.bias": bias}
    heads.save_weights(spark, tensors, path)
    loaded = heads.load_weights(spark, path)
    if sorted(loaded) != ["v.bias", "v.weight"]:
        raise RuntimeError(f"unexpected tensors: {sorted(loaded)}")
    head = X.linear_head("embedding", loaded["v.weight"], loaded["v.bias"][0])
    rows = V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(head).alias("pos", "v"))
    return rows.select("vec_id", "pos", V.r6("v").alias("x"))
