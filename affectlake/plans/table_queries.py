"""Labels, joins, splits, statistics, annotators and the lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from affectlake.functions import labels as L
from affectlake.functions import text as T
from affectlake.operators import annotators, joins, lexicon, ranking, splits, stats
from affectlake.plans import views as V
from affectlake.plans.registry import query
from affectlake.session import saved, spread

SEED = 42


# ---------------------------------------------------------------------- splits

def _key(id_expr: str, seed=SEED) -> str:
    return f"md5(concat(({id_expr})::VARCHAR, '#{seed}'))"


def _quota(source: str, stratum: str, left: str, held: str, total: str, out: str) -> str:
    """One largest-remainder step over a stratum table."""
    return f"""
    SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, {stratum}) <= {held} - sum(base) OVER ()
      THEN 1 ELSE 0 END AS {out}
    FROM (SELECT * EXCLUDE (base, rest), ({left} * {held}) // {total} AS base, ({left} * {held}) % {total} AS rest
          FROM (SELECT *, 0 AS base, 0 AS rest FROM {source}))"""


SP1_CTE = f"""
tot AS (SELECT count(*) AS n, count(*) // 10 AS held FROM documents),
s0 AS (SELECT lang, count(*) AS m, any_value(tot.n) AS n, any_value(tot.held) AS held FROM documents, tot GROUP BY lang),
s1 AS ({_quota('s0', 'lang', 'm', 'held', 'n', 'n_test')}),
s2 AS (SELECT lang, m - n_test AS m, n - held AS n, held, n_test FROM s1),
s3 AS ({_quota('s2', 'lang', 'm', 'held', 'n', 'n_valid')}),
sp AS (
  SELECT d.*, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_valid THEN 'valid' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_key('doc_id')}) AS r FROM documents) d
  JOIN s3 USING (lang))"""


def split_documents(spark, sf, clean=False):
    """Documents with a tenth held out for test and a tenth for validation, by language."""
    docs = V.table(spark, sf, "documents")
    if clean:
        docs = spread(docs.select("doc_id", "lang", "text"), "doc_id")
        docs = stats.drop_empty(docs.withColumn("text", T.clean_basic("text")))
        docs = saved(docs.select("doc_id", "lang"))
    held = docs.count() // 10
    return splits.stratified_split(docs, "doc_id", "lang", held, held)


_clean = V.sql_basic("text")
FLAGSHIP = "WITH cleaned AS (SELECT * FROM (SELECT doc_id, lang, " + _clean + " AS text FROM documents) WHERE text <> '')," + SP1_CTE.replace("FROM documents", "FROM cleaned") + """
SELECT lang, """ + ", ".join(
    V.sql_even(f"nullif(count(*) FILTER (split = '{s}'), 0) / (SELECT count(*) FROM sp WHERE split = '{s}')::DOUBLE", 3) + f" AS {s}"
    for s in ("train", "valid", "test")
) + " FROM sp GROUP BY lang"


@query("flagship_split_frequencies", FLAGSHIP)
def flagship(spark, sf):
    return stats.relative_frequencies(split_documents(spark, sf, clean=True), "lang")


@query("sp1_stratified_exact", "WITH" + SP1_CTE + " SELECT doc_id, lang, split FROM sp")
def sp1(spark, sf):
    return split_documents(spark, sf).select("doc_id", "lang", "split")


@query("sp2_stratified_shares", f"""
    WITH ids AS (SELECT o_orderkey AS id, o_orderpriority AS label FROM orders),
    tot AS (SELECT count(*) AS n, ceil(0.3::DOUBLE * count(*))::BIGINT AS held FROM ids),
    s0 AS (SELECT label, count(*) AS m, any_value(tot.n) AS n, any_value(tot.held) AS held FROM ids, tot GROUP BY label),
    s1 AS ({_quota('s0', 'label', 'm', 'held', 'n', 'n_held')}),
    s2 AS (SELECT label, n_held, held, ceil(0.5::DOUBLE * held)::BIGINT AS t FROM s1),
    s3 AS ({_quota('s2', 'label', 'n_held', 't', 'held', 'n_test')})
    SELECT id, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_held THEN 'valid' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key('id')}) AS r FROM ids) JOIN s3 USING (label)""")
def sp2(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return splits.stratified_split(rows, "id", "label", 0.15, 0.15).select("id", "split")


@query("sp3_train_valid", f"""
    SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {_key('event_id')}) <= ceil(0.2::DOUBLE * count(*) OVER ())
      THEN 'valid' ELSE 'train' END AS split FROM events""")
def sp3(spark, sf):
    return splits.train_valid_split(V.table(spark, sf, "events"), "event_id").select("event_id", "split")


SP4 = f"""
    SELECT event_id, event_type, value, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train'
      WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {_key('event_id')}) AS r, count(*) OVER () AS n FROM events)"""


def split_events(spark, sf):
    return splits.train_valid_test_split(V.table(spark, sf, "events"), "event_id")


@query("sp4_shuffle_cut", f"SELECT event_id, split FROM ({SP4})")
def sp4(spark, sf):
    return split_events(spark, sf).select("event_id", "split")


@query("sp5_few_shot", """
    SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS n FROM events)
    WHERE r <= floor(n * 0.3::DOUBLE)""")
def sp5(spark, sf):
    return splits.few_shot(V.table(spark, sf, "events"), "event_id", 0.3).select("event_id")


@query("sp6_epoch_order", f"SELECT event_id, row_number() OVER (ORDER BY {_key('event_id', '3#42')}) AS position FROM events")
def sp6(spark, sf):
    return splits.epoch_order(V.table(spark, sf, "events"), "event_id", epoch=3).select("event_id", "position")


@query("sp7_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS batch_id FROM orders")
def sp7(spark, sf):
    return splits.sequential_batches(V.table(spark, sf, "orders"), "o_orderkey", 16).select("o_orderkey", "batch_id")


@query("sp8_validate_splits", "WITH" + SP1_CTE + """,
    stored AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 AND split = 'valid' THEN 'train' ELSE split END AS split FROM sp),
    pairs AS (SELECT a.split AS a, b.split AS b FROM sp a FULL JOIN stored b USING (doc_id)),
    sides AS (SELECT a AS split, a = b AS ok FROM pairs UNION ALL SELECT b, a = b FROM pairs)
    SELECT split, bool_and(ok) AS same FROM sides GROUP BY split""")
def sp8(spark, sf):
    regenerated = split_documents(spark, sf).select("doc_id", "split")
    moved = (F.col("doc_id") % 97 == 5) & (F.col("split") == "valid")
    stored = regenerated.withColumn("split", F.when(moved, "train").otherwise(F.col("split")))
    return splits.compare_splits(regenerated, stored, "doc_id")


# ------------------------------------------------------- projections and filters

@query("p1_projection", "SELECT doc_id AS id, lang, n_chars FROM documents")
def p1(spark, sf):
    return V.table(spark, sf, "documents").drop("text", "source").select(F.col("doc_id").alias("id"), "lang", "n_chars")


@query("p2_filter_relabel", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'valid' WHEN 'O' THEN 'test' ELSE 'train' END AS split
    FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""")
def p2(spark, sf):
    rows = V.table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O", "P"))
    return rows.select("o_orderkey", annotators.relabel({"P": "valid", "O": "test", "F": "train"}, "o_orderstatus").alias("split"))


_half_empty = "CASE WHEN doc_id % 7 = 0 THEN '\" \"' ELSE text END"


@query("p3_drop_empty", f"SELECT doc_id, {V.sql_basic(_half_empty)} AS text FROM documents WHERE {V.sql_basic(_half_empty)} <> ''")
def p3(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", T.clean_basic(F.expr(_half_empty)).alias("text"))
    return stats.drop_empty(rows)


@query("p3_empty_report", f"SELECT lang, count(*) FILTER ({V.sql_basic(_half_empty)} = '') AS n_empty FROM documents GROUP BY lang")
def p3_report(spark, sf):
    rows = V.table(spark, sf, "documents").select("lang", T.clean_basic(F.expr(_half_empty)).alias("text"))
    return stats.empty_texts(rows, split="lang")


_rename = "CASE event_type WHEN 'click' THEN 'happy' WHEN 'error' THEN 'anger' WHEN 'purchase' THEN 'excite' WHEN 'signup' THEN 'xxx' ELSE 'neutral' END"


def event_codes(spark, sf):
    pairs = [F.lit(x) for kv in V.EVENT_CODES.items() for x in kv]
    return V.table(spark, sf, "events").withColumn("code", F.element_at(F.create_map(*pairs), F.col("event_type")))


@query("j6_rename_codes", f"SELECT event_id, {_rename} AS emotion FROM events")
def j6(spark, sf):
    return event_codes(spark, sf).select("event_id", L.rename_codes("code").alias("emotion"))


@query("p4_keep_labels", f"SELECT * FROM (SELECT event_id, {_rename} AS emotion FROM events) WHERE emotion <> 'xxx'")
def p4(spark, sf):
    rows = event_codes(spark, sf).select("event_id", L.rename_codes("code").alias("emotion"))
    return joins.keep_labels(rows, "emotion", L.DIALOGUE_LABELS)


@query("p5_positional_names", "SELECT p_partkey AS c0, p_name AS c1, p_brand AS c2, p_type AS c3, p_size AS c4, p_retailprice AS c5 FROM part")
def p5(spark, sf):
    return V.table(spark, sf, "part").toDF(*[f"c{i}" for i in range(6)])


@query("p6_skip_rows", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r > 182")
def p6(spark, sf):
    return ranking.skip_first(V.table(spark, sf, "events"), "event_id", 182).select("event_id", "value")


@query("p7_set_split", """
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'test' ELSE lower(o_orderstatus) END AS split FROM orders""")
def p7(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lower("o_orderstatus").alias("split"))
    new = rows.filter("o_totalprice > 300000").select("o_orderkey", F.lit("test").alias("split"))
    return joins.set_split(rows, new, "o_orderkey").select("o_orderkey", "split")


# ----------------------------------------------------------------------- joins

@query("j1_metadata", "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j1(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return joins.with_metadata(docs, V.table(spark, sf, "labels"), "doc_id")


@query("j2_align_annotators", "WITH" + V.ANNOTATORS + """
    SELECT id, reader.V AS rV, writer.V AS wV, reader.N AS rN, writer.N AS wN FROM reader JOIN writer USING (id)""")
def j2(spark, sf):
    r = V.annotator_rows(spark, sf, "O").select("id", F.col("V").alias("rV"), F.col("N").alias("rN"))
    w = V.annotator_rows(spark, sf, "F").select("id", F.col("V").alias("wV"), F.col("N").alias("wN"))
    return r.join(w, "id", "inner")


def combined(spark, sf):
    return annotators.combine_perspectives(V.annotator_rows(spark, sf, "O"), V.annotator_rows(spark, sf, "F"))


COMBINED = "WITH" + V.ANNOTATORS + """,
combined AS (
  SELECT id, """ + ", ".join(
    V.sql_even(f"(reader.{c} * reader.N + writer.{c} * writer.N) / (reader.N + writer.N)", 2) + f" AS {c}" for c in "VAD"
) + """
  FROM reader JOIN writer USING (id))"""


@query("a6_combine_annotators", COMBINED + " SELECT * FROM combined")
def a6(spark, sf):
    return combined(spark, sf)


@query("a6_combine_raters", "WITH" + V.ANNOTATORS + """,
    long AS (SELECT * FROM reader UNION ALL SELECT * FROM writer)
    SELECT id, """ + ", ".join(V.sql_even(f"sum({c} * N) / sum(N)", 2) + f" AS {c}" for c in "VAD") + """
    FROM long GROUP BY id HAVING count(*) = 2""")
def a6_long(spark, sf):
    reader, writer = (
        V.annotator_rows(spark, sf, status).withColumn("perspective", F.lit(name))
        for name, status in (("reader", "O"), ("writer", "F")))
    return annotators.combine_raters(reader.unionByName(writer), 2)


@query("j3_attach_text", COMBINED + """
    SELECT id, V, A, D, o_orderpriority AS text FROM combined JOIN orders ON id = o_orderkey""")
def j3(spark, sf):
    raw = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    return annotators.attach_text(combined(spark, sf), raw)


@query("j3_missing_text", COMBINED + """
    SELECT id FROM combined WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def j3_missing(spark, sf):
    raw = V.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return annotators.missing_ids(combined(spark, sf), raw)


@query("j4_attach_transcript", """
    SELECT conv_id AS id, turn, text AS transcription FROM conversations""")
def j4(spark, sf):
    turns = V.table(spark, sf, "conversations").withColumn("id", F.concat_ws("_", "conv_id", "turn"))
    spoken = turns.select("id", F.col("text").alias("transcription"))
    out = annotators.attach_transcripts(turns.select("id", "conv_id", "turn"), spoken)
    return out.select(F.col("conv_id").alias("id"), "turn", "transcription")


@query("j4_missing_transcript", "SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS id FROM conversations WHERE role = 'system'")
def j4_missing(spark, sf):
    turns = V.table(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), "role")
    return annotators.missing_transcripts(turns.select("id"), turns.filter("role <> 'system'"))


@query("j7_select_keys", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j7(spark, sf):
    keys = V.table(spark, sf, "labels").filter("quality = 1")
    return joins.select_keys(V.table(spark, sf, "documents").select("doc_id", "lang"), keys, "doc_id")


# ------------------------------------------------------------------ set operations

@query("u1_common_ids", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F'")
def u1(spark, sf):
    lines = V.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id")
    return annotators.common_ids(lines.filter("l_linestatus = 'O'"), lines.filter("l_linestatus = 'F'"))


@query("u2_set_difference", """
    (SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def u2(spark, sf):
    a, b = (V.table(spark, sf, n).select("doc_id") for n in ("documents", "labels"))
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


@query("u3_union_splits", """
    SELECT doc_id AS id, 'train' AS split, text FROM documents
    UNION ALL SELECT item_id, 'valid', text FROM benchmark
    UNION ALL SELECT conv_id, 'test', text FROM conversations""")
def u3(spark, sf):
    parts = [("documents", "doc_id", "train"), ("benchmark", "item_id", "valid"), ("conversations", "conv_id", "test")]
    frames = [
        V.table(spark, sf, name).select(F.col(key).alias("id"), F.lit(split).alias("split"), "text")
        for name, key, split in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("w5_sorted_ids", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events")
def w5(spark, sf):
    return ranking.ranked_by(V.table(spark, sf, "events"), "event_id", "place").select("event_id", "place")


@query("w6_sorted_common_ids", "SELECT DISTINCT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def w6(spark, sf):
    a, b = (V.table(spark, sf, n) for n in ("documents", "labels"))
    return annotators.common_ids(a, b, "doc_id").orderBy("doc_id")


@query("w7_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def w7(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5)


# ------------------------------------------------------------------- statistics

@query("a1_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a1(spark, sf):
    return stats.value_counts(V.table(spark, sf, "documents"), "lang")


@query("a2_relative_frequencies", f"""
    SELECT event_type, """ + ", ".join(
    V.sql_even(f"nullif(count(*) FILTER (split = '{s}'), 0) / any_value((SELECT count(*) FROM ({SP4}) WHERE split = '{s}'))::DOUBLE", 3) + f" AS {s}"
    for s in ("train", "valid", "test")) + f" FROM ({SP4}) GROUP BY event_type")
def a2(spark, sf):
    return stats.relative_frequencies(split_events(spark, sf), "event_type")


@query("a3_split_sizes", f"""
    WITH e AS ({SP4}), c AS (
      SELECT coalesce(split, 'all') AS split, count(event_type) AS text, count(CASE WHEN value > 5 THEN 1 END) AS label
      FROM e GROUP BY GROUPING SETS ((split), ()))
    SELECT split, 'text' AS field, text AS n FROM c UNION ALL SELECT split, 'label', label FROM c""")
def a3(spark, sf):
    rows = split_events(spark, sf).select("split", F.col("event_type").alias("text"), F.when(F.col("value") > 5, 1).alias("label"))
    return stats.split_sizes(rows)


@query("a4_multi_hot_counts", "WITH" + V.GOLD + " SELECT label_idx, sum(y)::BIGINT AS n FROM gold GROUP BY label_idx")
def a4(spark, sf):
    return stats.multi_hot_counts(V.gold_rows(spark, sf), "gold", V.K)


def _index_lists(spark, sf):
    """Line numbers as label lists; index 0 and those above 7 never occur."""
    lines = V.table(spark, sf, "lineitem")
    return lines.select(T.int_list(F.concat_ws(",", "l_linenumber", F.lit("9"))).alias("ids"), "l_linenumber")


@query("a5_index_counts", """
    SELECT i::INT AS label_idx, count(l_linenumber) FILTER (l_linenumber = i OR i = 9) AS n
    FROM lineitem, range(11) t(i) GROUP BY i""")
def a5(spark, sf):
    labels = spark.range(11).select(F.col("id").cast("int").alias("label_idx"))
    return stats.index_counts(_index_lists(spark, sf), "ids", labels)


@query("a5_single_index_counts", """
    SELECT i::INT AS label_idx, count(*) FILTER (l_linenumber = i) AS n FROM lineitem, range(11) t(i) GROUP BY i""")
def a5_single(spark, sf):
    labels = spark.range(11).select(F.col("id").cast("int").alias("label_idx"))
    return stats.index_counts(_index_lists(spark, sf), "l_linenumber", labels)


@query("a7_entropy", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT " + V.sql_r6("-sum(p * ln(p))") + " AS entropy FROM p")
def a7(spark, sf):
    counts = stats.value_counts(V.table(spark, sf, "events"), "event_type")
    return stats.label_entropy(counts, 5).select(V.r6("entropy").alias("entropy"))


@query("a8_normalised_entropy", "WITH" + V.GOLD + ", c AS (SELECT label_idx, sum(y) AS n FROM gold GROUP BY 1 UNION ALL SELECT 10, 0), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT " + V.sql_r6("-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)") + " AS entropy, " + V.sql_r6("-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(11)") + " AS normalised FROM p")
def a8(spark, sf):
    rows = V.gold_rows(spark, sf).withColumn("gold", F.concat("gold", F.array(F.lit(0))))
    out = stats.label_entropy(stats.multi_hot_counts(rows, "gold", 11), 11)
    return out.select(V.r6("entropy").alias("entropy"), V.r6("normalised").alias("normalised"))


_extreme = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS axis, '{side}' AS side, id, V, A, D FROM combined ORDER BY {c} {'ASC' if side == 'min' else 'DESC'}, id LIMIT 1)"
    for c in "VAD" for side in ("min", "max")
)


@query("a9_extreme_rows", COMBINED + " " + _extreme)
def a9(spark, sf):
    return annotators.extreme_rows(combined(spark, sf))


@query("a10_check_shape", COMBINED + """, c AS (SELECT count(*) AS n FROM combined)
    SELECT 'rows' AS "check", 10062::BIGINT AS expected, n AS actual, n = 10062 AS ok FROM c
    UNION ALL SELECT 'columns', 4, 4, true FROM c""")
def a10(spark, sf):
    return annotators.check_shape(combined(spark, sf), 10062, 4)


@query("corpus_statistics", "WITH" + SP1_CTE + """,
    sizes AS (SELECT coalesce(split, 'all') AS split, count(*)::DOUBLE AS n FROM sp GROUP BY GROUPING SETS ((split), ())),
    hot AS (SELECT i::INT AS i, count(*) FILTER ((doc_id * 3 + i) % 4 = 0)::DOUBLE AS n FROM sp, range(4) t(i) GROUP BY i),
    p AS (SELECT n / sum(n) OVER () AS p FROM hot)
    SELECT 'documents' AS dataset, split, 'n_text' AS stat, NULL::INT AS label_idx, n AS value FROM sizes
    UNION ALL SELECT 'documents', split, 'n_label', NULL, n FROM sizes
    UNION ALL SELECT 'documents', 'all', 'label_count', i, n FROM hot
    UNION ALL SELECT 'documents', 'all', 'entropy', NULL, """ + V.sql_r6("-sum(p * ln(p))") + """ FROM p
    UNION ALL SELECT 'documents', 'all', 'normalised', NULL, """ + V.sql_r6("-sum(p * ln(p)) / ln(4)") + " FROM p")
def corpus_statistics(spark, sf):
    hot = F.array(*[((F.col("doc_id") * 3 + i) % 4 == 0).cast("int") for i in range(4)])
    rows = split_documents(spark, sf).select("split", "text", hot.alias("label"))
    return stats.corpus_stats(rows, "documents", 4).withColumn("value", V.r6("value"))


LANGUAGES = ["de", "en", "es", "fr", "it"]


@query("corpus_statistics_single", "WITH" + SP1_CTE + """,
    sizes AS (SELECT coalesce(split, 'all') AS split, count(*)::DOUBLE AS n FROM sp GROUP BY GROUPING SETS ((split), ())),
    names AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang, unnest([0, 1, 2, 3, 4])::INT AS i),
    one AS (SELECT i, count(sp.doc_id)::DOUBLE AS n FROM names LEFT JOIN sp USING (lang) GROUP BY i),
    p AS (SELECT n / sum(n) OVER () AS p FROM one)
    SELECT 'documents' AS dataset, split, 'n_text' AS stat, NULL::INT AS label_idx, n AS value FROM sizes
    UNION ALL SELECT 'documents', split, 'n_label', NULL, n FROM sizes
    UNION ALL SELECT 'documents', 'all', 'label_count', i, n FROM one
    UNION ALL SELECT 'documents', 'all', 'entropy', NULL, """ + V.sql_r6("-sum(p * ln(p))") + """ FROM p WHERE p > 0
    UNION ALL SELECT 'documents', 'all', 'normalised', NULL, """ + V.sql_r6("-sum(p * ln(p)) / ln(5)") + " FROM p WHERE p > 0")
def corpus_statistics_single(spark, sf):
    rows = split_documents(spark, sf).select("split", "text", L.label_index("lang", LANGUAGES).alias("label"))
    return stats.corpus_stats(rows, "documents", 5, "single").withColumn("value", V.r6("value"))


# --------------------------------------------------------------------- encodings

@query("e1_multi_hot", "WITH" + V.GOLD + " SELECT vec_id, label_idx, y FROM gold")
def e1(spark, sf):
    hot = V.gold_rows(spark, sf)
    ids = F.filter(F.sequence(F.lit(0), F.lit(V.K - 1)), lambda i: F.get(F.col("gold"), i) == 1)
    text = hot.select("vec_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    return text.select("vec_id", F.posexplode(L.multi_hot(T.int_list("ids"), V.K)).alias("label_idx", "y"))


@query("e2_label_index", "SELECT event_id, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 END)::INT AS label_idx FROM events")
def e2(spark, sf):
    order = ["view", "click", "signup", "error", "purchase"]
    return V.table(spark, sf, "events").select("event_id", L.label_index("event_type", order).alias("label_idx"))


@query("e2_label_index_join", "SELECT event_id, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 END)::INT AS label_idx FROM events WHERE event_type IN ('view', 'click', 'error')")
def e2_join(spark, sf):
    labels = spark.createDataFrame(list(enumerate(["view", "click", "error"])), "label_idx int, label string")
    return joins.with_label_index(V.table(spark, sf, "events"), "event_type", labels).select("event_id", "label_idx")


@query("e2_unlisted_labels", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'error') GROUP BY 1")
def e2_unlisted(spark, sf):
    labels = spark.createDataFrame(list(enumerate(["view", "click", "error"])), "label_idx int, label string")
    return joins.unlisted_labels(V.table(spark, sf, "events"), "event_type", labels)


@query("e3_columns_to_array", "SELECT doc_id, concat_ws(',', quality, toxic, 1 - quality) AS hot FROM labels")
def e3(spark, sf):
    rows = V.table(spark, sf, "labels").withColumn("bad", 1 - F.col("quality"))
    return rows.select("doc_id", F.concat_ws(",", L.columns_to_multi_hot(["quality", "toxic", "bad"]).cast("array<string>")).alias("hot"))


@query("e4_one_hot", "SELECT vec_id, i::INT AS label_idx, (i = label)::INT AS y FROM embeddings, range(10) t(i)")
def e4(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(L.one_hot("label", V.K)).alias("label_idx", "y"))


@query("e5_vad_triple", COMBINED + " SELECT id, V AS v, A AS a, D AS d FROM combined")
def e5(spark, sf):
    return combined(spark, sf).select("id", L.vad_struct("V", "A", "D").alias("s")).select("id", "s.*")


@query("e6_permute", "WITH" + V.ORD + "," + V.GOLD + " SELECT vec_id, ax_no, pos::INT AS pos, y, y AS back FROM gold JOIN ord USING (label_idx)")
def e6(spark, sf):
    both = []
    for order in V.axes(spark, sf).orders:
        there = L.permute("gold", order)
        again = L.permute(L.permute(there, L.invert(order)), order)
        both.append(F.arrays_zip(there.alias("y"), again.alias("back")))
    rows = V.gold_rows(spark, sf).select("vec_id", F.posexplode(F.array(*both)).alias("ax_no", "cells"))
    return rows.select("vec_id", "ax_no", F.posexplode("cells").alias("pos", "e")).select(
        "vec_id", "ax_no", "pos", F.col("e.y").alias("y"), F.col("e.back").alias("back")
    )


# ----------------------------------------------------------------------- lexicon

_word_scores = ", ".join(f"{V.sql_md5_share('word || doc_id::VARCHAR', 1 + 4 * i)} AS {n}" for i, n in enumerate("vad"))


def raw_lexicon(spark, sf):
    """Every word of every document as a lexicon line; equal words must collapse."""
    rows = V.word_rows(spark, sf)
    seed = F.concat("word", F.col("doc_id").cast("string"))
    return rows.select(
        "word", (F.col("doc_id") * 100_000 + F.col("pos")).alias("line_no"),
        *[V.md5_share(seed, 1 + 4 * i).alias(n) for i, n in enumerate("vad")],
    )


LEXICON = "WITH" + V.WORDS + f""",
lines AS (SELECT word, doc_id * 100000 + pos AS line_no, {_word_scores} FROM words),
lex AS (SELECT word, """ + ", ".join(V.sql_even(f"arg_max({n}, line_no)", 3) + f" AS {n}" for n in "vad") + " FROM lines GROUP BY word)"


@query("s11_lexicon", LEXICON + " SELECT * FROM lex")
def s11(spark, sf):
    return lexicon.lexicon_scores(raw_lexicon(spark, sf))


LABEL_WORDS = """,
named AS (
  SELECT row_number() OVER (ORDER BY n DESC, word) - 1 AS label_idx, word AS label
  FROM (SELECT word, count(*) AS n FROM words GROUP BY word) ORDER BY n DESC, word LIMIT 8)"""


def frequent_words(spark, sf):
    counts = V.word_rows(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(8).collect()
    return spark.createDataFrame([(i, r["word"]) for i, r in enumerate(top)], "label_idx int, label string")


@query("j5_label_coordinates", LEXICON + LABEL_WORDS + " SELECT label_idx::INT AS label_idx, label, v, a, d FROM named JOIN lex ON label = word")
def j5(spark, sf):
    labels = frequent_words(spark, sf)
    scores = lexicon.lexicon_scores(raw_lexicon(spark, sf), only=labels)
    return lexicon.label_coordinates(labels, scores).select("label_idx", "label", "v", "a", "d")


@query("j5_unknown_labels", LEXICON + """, named AS (SELECT DISTINCT p_type AS t, lower(p_type) AS label FROM part)
    SELECT label FROM named WHERE label NOT IN (SELECT word FROM lex)""")
def j5_unknown(spark, sf):
    types = V.table(spark, sf, "part").select(F.lower("p_type").alias("label"), F.lit(0).alias("label_idx")).distinct()
    return lexicon.unknown_labels(types, s11(spark, sf)).select("label")


@query("w1_label_order", "WITH" + V.ORD + " SELECT axis, pos::INT AS position, label_idx, score FROM ord")
def w1(spark, sf):
    return lexicon.label_order(V.label_table(spark, sf)).select("axis", "position", "label_idx", "score")


@query("w2_inverse_order", "WITH" + V.ORD + " SELECT axis, label_idx, pos::INT AS position FROM ord")
def w2(spark, sf):
    """The same frame keyed by label: sorted position of each label per axis."""
    return lexicon.label_order(V.label_table(spark, sf)).select("axis", "label_idx", "position")


@query("w3_gap_weights", "WITH" + V.GAP + " SELECT axis, pos::INT AS position, " + V.sql_r6("gap") + " AS gap FROM gaps")
def w3(spark, sf):
    return lexicon.gap_weights(V.label_table(spark, sf)).select("axis", "position", V.r6("gap").alias("gap"))


@query("w4_running_sum", "WITH" + V.ORD + "," + V.GOLD + """
    SELECT vec_id, ax_no, pos::INT AS position, sum(y) OVER (PARTITION BY vec_id, ax_no ORDER BY pos)::BIGINT AS c
    FROM gold JOIN ord USING (label_idx)""")
def w4(spark, sf):
    sorted_by_axis = F.array(*[L.permute("gold", order) for order in V.axes(spark, sf).orders])
    rows = V.gold_rows(spark, sf).select("vec_id", F.posexplode(sorted_by_axis).alias("ax_no", "ys"))
    rows = rows.select("vec_id", "ax_no", F.posexplode("ys").alias("position", "y"))
    return rows.select("vec_id", "ax_no", "position", lexicon.running_sum("y", ["vec_id", "ax_no"], "position").alias("c"))
