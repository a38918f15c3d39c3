"""Views of the test tables that queries share, in Spark and as SQL.

The tables have no emotions, so every emotion column is a plain formula over
whole tables: labels and vectors come from ``embeddings``, texts from
``documents``, ``pages`` and ``conversations``, annotators from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affectlake.functions.rounding import round_even
from affectlake.functions.text import PUNCTUATION, WHITESPACE, WS
from affectlake.functions.vectors import linear_head
from affectlake.operators.lexicon import LabelAxes, label_axes
from affectlake.session import spread

K = 10
WIDTH = 64
WEIGHTS = [[((o * 31 + d * 17) % 23 - 11) / 10 for d in range(WIDTH)] for o in range(3 * K)]
BIAS = [(o % 5 - 2) / 10 for o in range(3 * K)]

# Dialogue codes given to events and turns (two are unknown).
EVENT_CODES = {"click": "hap", "error": "ang", "purchase": "exc", "signup": "xxx", "view": "neu"}
TURN_CODES = ["ang", "hap", "sad", "fru", "exc", "fea", "sur", "dis", "neu", "xxx", "oth"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table whose rows get costly work: see :func:`affectlake.session.spread`."""
    return spread(table(spark, sf, name), key)


def r6(value: Column | str) -> Column:
    """Doubles for comparison: six places, no negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, 6) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE)"


def sql_even(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


# ------------------------------------------------------------------ text as SQL

def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_strip_space(e: str) -> str:
    return f"trim({e}, {sql_text(WHITESPACE)})"


def sql_strip_quotes(e: str) -> str:
    return sql_strip_space(f"trim(trim({e}, '\"'), '''')")


def sql_pad(e: str) -> str:
    return f"regexp_replace({e}, {sql_text(f'([{PUNCTUATION}])')}, ' \\1 ', 'g')"


def sql_squeeze(e: str) -> str:
    return f"regexp_replace({e}, '[{WS}]{{2,}}', ' ', 'g')"


def sql_escaped_newline(e: str) -> str:
    return f"replace({e}, '\\n', ' ')"


def sql_blanks(e: str) -> str:
    return f"regexp_replace({e}, ' +', ' ', 'g')"


def sql_urls(e: str) -> str:
    out = f"regexp_replace({e}, '(?:https?://|www\\.)[^{WS}]+', '', 'gi')"
    out = f"regexp_replace({out}, '@[\\p{{L}}\\p{{N}}_]*', '', 'g')"
    return sql_strip_space(f"regexp_replace({out}, '[{WS}]+', ' ', 'g')")


# What the twin of the HTML cleaning hides and decodes, apart from the code under test.
SQL_HIDDEN = ("script", "style", "textarea", "select", "button", "applet", "iframe", "frameset", "noframes")
SQL_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#8217;", "’"), ("&#x27;", "'"),
    ("&nbsp;", "\xa0"), ("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&eacute;", "é"), ("&#233;", "é"), ("&euro;", "€"),
    ("&mdash;", "—"), ("&amp;", "&"),
)


def sql_html(e: str) -> str:
    hidden = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in SQL_HIDDEN) + r"|<!--.*?(?:-->|\z)"
    out = f"regexp_replace({e}, {sql_text(hidden)}, '', 'gis')"
    tag = r"""</?[A-Za-z!?](?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*>"""
    out = f"regexp_replace({out}, {sql_text(tag)}, '', 'gs')"
    for entity, char in SQL_ENTITIES:
        out = f"replace({out}, {sql_text(entity)}, {sql_text(char)})"
    return out


def sql_straight(e: str) -> str:
    return f"translate({e}, '“”', '\"\"')"


def sql_emoji_pad(e: str) -> str:
    out = f"regexp_replace({e}, '(:[^{WS}]+:)', ' \\1 ', 'g')"
    return sql_squeeze(f"replace({out}, '::', ': :')")


def sql_basic(e: str) -> str:
    return sql_strip_space(sql_squeeze(sql_pad(sql_strip_quotes(e))))


def sql_statement(e: str) -> str:
    joined = f"replace(replace({e}, 'á' || chr(10), chr(10)), chr(10), '')"
    return sql_strip_space(sql_squeeze(sql_pad(sql_blanks(sql_strip_quotes(joined)))))


def sql_dialogue(e: str) -> str:
    return sql_strip_space(sql_blanks(sql_escaped_newline(sql_squeeze(sql_pad(e)))))


def sql_tweet(e: str, demojize) -> str:
    out = sql_strip_quotes(sql_straight(sql_html(sql_urls(e))))
    out = sql_blanks(sql_escaped_newline(sql_squeeze(sql_pad(out))))
    return sql_strip_space(sql_emoji_pad(demojize(out)))


# ------------------------------------------------------- labels, vectors, logits

def label_table(spark: SparkSession, sf: str) -> DataFrame:
    """Ten labels with V, A, D from the mean vectors; D is coarse, so it has ties."""
    e = table(spark, sf, "embeddings")

    def score(i, digits):
        return round_even(F.lit(0.5) + 5 * F.avg(F.col("embedding")[i].cast("double")), digits)

    return e.groupBy(F.col("label").alias("label_idx")).agg(
        F.concat(F.lit("label_"), F.first("label")).alias("label"),
        score(0, 3).alias("v"), score(1, 3).alias("a"), score(2, 2).alias("d"),
    )


def axes(spark: SparkSession, sf: str) -> LabelAxes:
    return label_axes(label_table(spark, sf))


def gold_array(vec_id: str = "vec_id", label: str = "label") -> Column:
    return F.array(*[
        F.when((F.col(label) == i) | ((F.col(vec_id) * 7 + i * 13) % 10 < 2), 1).otherwise(0)
        for i in range(K)
    ])


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", gold_array().alias("gold"))


def logit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(vec_id, label, gold, logits, gv, ga, gd)``: 3K logits of a fixed dense head."""
    e = table(spark, sf, "embeddings")
    third = [F.col("embedding")[i].cast("double").alias(n) for i, n in ((10, "gv"), (11, "ga"), (12, "gd"))]
    return e.select(
        "vec_id", "label", gold_array().alias("gold"),
        linear_head("embedding", WEIGHTS, BIAS).alias("logits"), *third,
    )


LAB = f"""
lab AS (
  SELECT label AS label_idx, 'label_' || label AS label,
    {sql_even('0.5 + 5 * avg(embedding[1]::DOUBLE)', 3)} AS v,
    {sql_even('0.5 + 5 * avg(embedding[2]::DOUBLE)', 3)} AS a,
    {sql_even('0.5 + 5 * avg(embedding[3]::DOUBLE)', 2)} AS d
  FROM embeddings GROUP BY label)"""
ORD = LAB + """,
ax AS (
  SELECT label_idx, label, 'v' AS axis, 0 AS ax_no, v AS score FROM lab
  UNION ALL SELECT label_idx, label, 'a', 1, a FROM lab
  UNION ALL SELECT label_idx, label, 'd', 2, d FROM lab),
ord AS (
  SELECT *, row_number() OVER (PARTITION BY axis ORDER BY score, label_idx) - 1 AS pos FROM ax)"""
GAP = ORD + """,
raw AS (
  SELECT *, coalesce(lead(score) OVER w, first_value(score) OVER w) - score AS r
  FROM ord WINDOW w AS (PARTITION BY axis ORDER BY pos)),
gaps AS (
  SELECT *, CASE WHEN lead(pos) OVER w IS NULL THEN 0
                 WHEN r = 0 THEN lead(r) OVER w ELSE r END AS gap
  FROM raw WINDOW w AS (PARTITION BY axis ORDER BY pos))"""
GOLD = f"""
gold AS (
  SELECT vec_id, label, i::INT AS label_idx,
    CASE WHEN i = label OR (vec_id * 7 + i * 13) % 10 < 2 THEN 1 ELSE 0 END AS y
  FROM embeddings, range({K}) t(i))"""
LOGITS = f"""
lg AS (
  SELECT vec_id, (o // {K})::INT AS ax_no, (o % {K})::INT AS pos,
    sum(e.val::DOUBLE * (((o * 31 + e.d * 17) % 23 - 11) / 10::DOUBLE)) + any_value((o % 5 - 2) / 10::DOUBLE) AS x
  FROM (SELECT vec_id, unnest(embedding) AS val, generate_subscripts(embedding, 1) - 1 AS d
        FROM embeddings) e, range({3 * K}) r(o)
  GROUP BY vec_id, o)"""
PROBS = LOGITS + """,
pr AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM lg)"""
SOFT = LOGITS + """,
sm0 AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id, ax_no)) AS e FROM lg),
sm AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, ax_no) AS p FROM sm0)"""
PRED = "WITH" + ORD + "," + GOLD + "," + PROBS + """,
pred AS (
  SELECT pr.vec_id, ord.label_idx,
    CASE WHEN exp(sum(ln(pr.p)) / 3) >= 0.5 THEN 1 ELSE 0 END AS p,
    sum(pr.x) AS xs
  FROM pr JOIN ord ON pr.ax_no = ord.ax_no AND pr.pos = ord.pos
  GROUP BY pr.vec_id, ord.label_idx),
cls AS (
  SELECT vec_id, arg_min(label_idx, (-xs, label_idx)) AS c FROM pred GROUP BY vec_id),
yp AS (
  SELECT g.vec_id, g.label, g.label_idx, g.y, pred.p FROM gold g JOIN pred USING (vec_id, label_idx))"""
EXPECTED = "WITH" + ORD + "," + PROBS + """,
ev AS (
  SELECT pr.vec_id, pr.ax_no, sum(pr.p * ord.score) AS e
  FROM pr JOIN ord ON pr.ax_no = ord.ax_no AND pr.pos = ord.pos
  GROUP BY pr.vec_id, pr.ax_no),
wide AS (
  SELECT vec_id, max(e) FILTER (ax_no = 0) AS e_v, max(e) FILTER (ax_no = 1) AS e_a,
    max(e) FILTER (ax_no = 2) AS e_d
  FROM ev GROUP BY vec_id)"""


# ------------------------------------------------------------------- annotators

def annotator_rows(spark: SparkSession, sf: str, status: str) -> DataFrame:
    """One perspective: per order, scores from its lines with the given status."""
    lines = table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status)
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        round_even(1 + F.avg("l_quantity") / 12.5, 2).alias("V"),
        round_even(1 + F.avg("l_discount") * 40, 2).alias("A"),
        round_even(1 + F.avg("l_tax") * 50, 2).alias("D"),
        F.count("*").cast("int").alias("N"),
    )


def sql_annotator(name: str, status: str) -> str:
    return f"""
{name} AS (
  SELECT l_orderkey AS id, {sql_even('1 + avg(l_quantity) / 12.5', 2)} AS V,
    {sql_even('1 + avg(l_discount) * 40', 2)} AS A, {sql_even('1 + avg(l_tax) * 50', 2)} AS D,
    count(*)::INT AS N
  FROM lineitem WHERE l_linestatus = '{status}' GROUP BY l_orderkey)"""


ANNOTATORS = sql_annotator("reader", "O") + "," + sql_annotator("writer", "F")


# ------------------------------------------------------------------------ words

def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, pos, word)`` for all words of all documents."""
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return (
        spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
        .select("doc_id", F.posexplode(words).alias("pos", "word"))
        .filter("word <> ''")
    )


WORDS = """
words AS (
  SELECT doc_id, (u.pos - 1)::INT AS pos, u.word FROM (
    SELECT doc_id, unnest(list_zip(range(1, len(ws) + 1), ws)) AS z FROM (
      SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents)) q,
    LATERAL (SELECT z[1] AS pos, z[2] AS word) u
  WHERE u.word <> '')"""


def md5_share(value: Column, start: int) -> Column:
    """Four hex digits of an md5 as a number between 0 and 1."""
    return F.conv(F.substring(F.md5(value), start, 4), 16, 10).cast("int") / F.lit(65535.0)


def sql_md5_share(expr: str, start: int) -> str:
    return f"(('0x' || substr(md5({expr}), {start}, 4))::INT / 65535::DOUBLE)"
