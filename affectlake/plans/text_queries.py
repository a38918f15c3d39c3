"""Text functions and cleanings over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from affectlake.functions import text as T
from affectlake.functions.labels import rename_codes
from affectlake.plans import views as V
from affectlake.plans.registry import query
from affectlake.session import spread

# Text with quotes, tabs and doubled blanks around and inside.
DECORATED = (
    "concat('\"\"''', chr(9), ' ', replace(text, 'en ', concat('en', chr(9), ' ')), "
    "'  \\\\n ', replace(text, ' ', '  '), '''\"')"
)
SQL_DECORATED = DECORATED.replace("\\\\n", "\\n")

# Letters that stand in for emoji, and the names they must get.
EMOJI_FOR = {"é": "\U0001f602", "ü": "\U0001f62d", "ó": "\U0001f525", "ß": "\U0001f44d"}
EMOJI_TEXT = {
    "\U0001f602": ":face_with_tears_of_joy:", "\U0001f62d": ":loudly_crying_face:",
    "\U0001f525": ":fire:", "\U0001f44d": ":thumbs_up:",
}


def _emojified(e: str) -> str:
    return f"translate({e}, '{''.join(EMOJI_FOR)}', '{''.join(EMOJI_FOR.values())}')"


def _sql_demojize(e: str) -> str:
    for char, name in EMOJI_TEXT.items():
        e = f"replace({e}, '{char}', '{name}')"
    return e


def _over_documents(name, spark_text, fn, sql_text, sql_fn):
    sql = f"SELECT doc_id, {sql_fn(sql_text)} AS out FROM documents"

    @query(name, sql)
    def run(spark, sf):
        return spread(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", fn(F.expr(spark_text)).alias("out"))


def _over_pages(name, fn, sql_fn, text="html", sql_text="html"):
    @query(name, f"SELECT page_id, {sql_fn(sql_text)} AS out FROM pages")
    def run(spark, sf):
        return V.spread_table(spark, sf, "pages", "page_id").select("page_id", fn(F.expr(text)).alias("out"))


_over_documents("f1_strip_quotes", DECORATED, T.strip_quotes, SQL_DECORATED, V.sql_strip_quotes)
_over_documents("f2_pad_punctuation", "text", T.pad_punctuation, "text", V.sql_pad)
_over_documents("f3_squeeze_space", DECORATED, T.squeeze_space, SQL_DECORATED, V.sql_squeeze)
_over_documents("f4_escaped_newline", DECORATED, T.drop_escaped_newline, SQL_DECORATED, V.sql_escaped_newline)
_over_documents("f5_squeeze_blanks", DECORATED, T.squeeze_blanks, SQL_DECORATED, V.sql_blanks)
_over_documents("f6_urls_mentions", "text", T.drop_urls_mentions, "text", V.sql_urls)
_over_pages("f6_urls_mentions_pages", T.drop_urls_mentions, V.sql_urls, "concat(url, ' ', html, ' @a ', url)", "concat(url, ' ', html, ' @a ', url)")
_over_pages("f7_html_text", T.strip_html, V.sql_html)
_over_pages("f7_html_text_exact", T.strip_html_exact, V.sql_html)
# Numeric and named references, a quoted ">", an element that is never closed.
HARD_HTML = (
    "concat('it&#8217;s &euro;5 &#233; &eacute; &unknown; <p title=\"a>b\">y</p> ', html, ' z<BUTTON class=b>hidden')"
)
_over_pages("f7_html_text_hard", T.strip_html, V.sql_html, HARD_HTML.replace('"', '\\"'), HARD_HTML)
# Ten thousand quoted attributes with ">" in them, and references of any length.
_over_pages(
    "f7_html_text_long", T.strip_html,
    lambda e: f"concat('zA\u00e9\ufffd <', {V.sql_html('html')}, '!')",
    "concat('<p', repeat(' a=\"x>y\"', 10000), '>z', '&#', repeat('0', 500), '65;&#x', repeat('0', 500), 'e9;&#', repeat('9', 50), "
    "'; <', html, '<b c=\"', repeat('>', 5000), '\">!')",
)
_over_documents("f8_straight_quotes", "concat('“', replace(text, ' ', '” '))", T.straighten_quotes, "concat('“', replace(text, ' ', '” '))", V.sql_straight)
_over_documents("f9_demojize", _emojified("text"), T.demojize, _emojified("text"), _sql_demojize)
# Symbols that are no emoji stay; a skin tone joins its emoji.
SYMBOLS = "concat(text, ' 5 ★ hotel ✓ ♪ ☐ ⭐ ⏰ 😍 😘 🙏 👍🏽 ❤️')"
_over_documents(
    "f9_demojize_symbols", SYMBOLS, T.demojize,
    "concat(text, ' 5 ★ hotel ✓ ♪ ☐ :star: :alarm_clock: :smiling_face_with_heart-eyes: :face_blowing_a_kiss: "
    ":folded_hands: :thumbs_up_medium_skin_tone: :red_heart:')", lambda e: e,
)
# Flags, keycaps, joined people with tones, families; a lone regional letter stays.
_over_documents(
    "f9_demojize_sequences", "concat('🇫🇷', text, ' 🇺🇸🇯🇵 1️⃣ 👩🏽‍⚕️ 🤷‍♀️ 👨‍👩‍👧‍👦 🏳️‍🌈 ❤️‍🔥 🇫')", T.demojize,
    "concat(':France:', text, ' :United_States::Japan: :keycap_1: :woman_health_worker_medium_skin_tone: :woman_shrugging: "
    ":family_man_woman_girl_boy: :rainbow_flag: :heart_on_fire: 🇫')", lambda e: e,
)


@query("f9_demojize_table", """
    SELECT doc_id, text || ' :' || n_name || ':!' AS out FROM documents JOIN nation ON n_nationkey = doc_id % 25""")
def f9_table(spark, sf):
    """Sequences and their names from a table: two regional letters stand for a nation."""
    letters = "decode(unhex(lpad(hex(127462 + {}), 8, '0')), 'UTF-32')"
    both = F.expr(f"concat({letters.format('n_nationkey div 5')}, {letters.format('n_nationkey % 5')})")
    table = V.table(spark, sf, "nation").select("n_nationkey", both.alias("emoji"), F.col("n_name").alias("name"))
    texts = V.table(spark, sf, "documents").join(F.broadcast(table), F.col("doc_id") % 25 == F.col("n_nationkey"))
    return texts.select("doc_id", T.demojize(F.concat("text", F.lit(" "), "emoji", F.lit("!")), T.names_from(table)).alias("out"))


_over_documents("f10_pad_emoji_names", _sql_demojize(_emojified("text")), T.pad_emoji_names, _sql_demojize(_emojified("text")), V.sql_emoji_pad)
_over_documents(
    "f11_join_lines", "replace(text, '.\\n', 'á\\n')", T.join_statement_lines,
    "replace(text, '.' || chr(10), 'á' || chr(10))",
    lambda e: f"replace(replace({e}, 'á' || chr(10), chr(10)), chr(10), '')",
)
_over_documents("c1_clean_basic", "text", T.clean_basic, "text", V.sql_basic)
_over_documents("c1_clean_basic_decorated", DECORATED, T.clean_basic, SQL_DECORATED, V.sql_basic)
_over_documents("c2_clean_tweet", _emojified("text"), T.clean_tweet, _emojified("text"), lambda e: V.sql_tweet(e, _sql_demojize))
_over_pages("c2_clean_tweet_pages", T.clean_tweet, lambda e: V.sql_tweet(e, lambda x: x))
_over_pages("c2_clean_tweet_exact", lambda c: T.clean_tweet(c, html="exact"), lambda e: V.sql_tweet(e, lambda x: x))
_over_documents("c3_clean_statement", "text", T.clean_statement, "text", V.sql_statement)


@query("c4_clean_dialogue", f"SELECT conv_id, turn, {V.sql_dialogue('text')} AS out FROM conversations")
def c4(spark, sf):
    return V.spread_table(spark, sf, "conversations", "conv_id").select("conv_id", "turn", T.clean_dialogue("text").alias("out"))


@query("f12_own_name", """
    SELECT event_id, CASE WHEN lower(upper(event_type)) = 'click' THEN 1 ELSE 0 END AS click,
      CASE WHEN lower(upper(event_type)) = 'view' THEN 1 ELSE 0 END AS view_
    FROM events""")
def f12(spark, sf):
    kind = F.upper("event_type")
    return V.table(spark, sf, "events").select(
        "event_id", T.is_own_name(kind, "click").alias("click"), T.is_own_name(kind, "view").alias("view_")
    )


@query("f13_int_list", """
    SELECT l_orderkey, l_partkey, l_linenumber + l_suppkey AS total, 2::INT AS n
    FROM lineitem""")
def f13(spark, sf):
    ids = T.int_list(F.concat_ws(",", "l_linenumber", "l_suppkey"))
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", ids.alias("ids")).select(
        "l_orderkey", "l_partkey", (F.col("ids")[0] + F.col("ids")[1]).cast("long").alias("total"), F.size("ids").alias("n")
    )


CODES_SPARK = "element_at(array('" + "','".join(V.TURN_CODES) + "'), int((conv_id * 3 + turn) % 11) + 1)"
CODES_SQL = "(['" + "','".join(V.TURN_CODES) + "'])[(conv_id * 3 + turn) % 11 + 1]"
SCORE_SQL = "format('{:.4f}', 1 + (length(text) % 9) / 2.0::DOUBLE)"
SCORE_SPARK = "format_string('%.4f', 1 + (length(text) % 9) / 2.0D)"


def evaluation_files(spark, sf):
    """Turns as evaluation files: a heading, then a block per turn."""
    head = F.expr(
        "concat('[0.0000 - 1.0000]\\tSes', lpad(conv_id, 8, '0'), '_T', lpad(turn, 3, '0'), '\\t', "
        f"{CODES_SPARK}, '\\t[', {SCORE_SPARK}, ', 2.5000, ', {SCORE_SPARK}, ']')"
    )
    heading = F.lit("% [START_TIME - END_TIME]\tTURN_NAME\tEMOTION\t[V, A, D]\n\n")
    turns = V.table(spark, sf, "conversations")
    return turns.select(
        F.expr("concat('Ses', lpad(conv_id, 8, '0'))").alias("file"),
        F.concat(heading, head, F.lit("\nC-E2:\tNeutral;\t()\n\n")).alias("value"),
    )


def transcript_rows(spark, sf):
    """Turns as transcript lines, each id twice; the second one must win."""
    line = F.expr(
        "concat('Ses', lpad(conv_id, 8, '0'), '_T', lpad(turn, 3, '0'), ' [000.0-001.0]: ', "
        "replace(text, '\\n', ' '))"
    )
    turns = V.table(spark, sf, "conversations").select(
        F.expr("concat('Ses', lpad(conv_id, 8, '0'))").alias("file"), "turn", line.alias("line")
    )
    both = F.array(
        F.struct((F.col("turn") * 2).alias("line_no"), F.regexp_replace("line", ": .*$", ": old").alias("line")),
        F.struct((F.col("turn") * 2 + 1).alias("line_no"), F.col("line")),
    )
    return turns.select("file", F.inline(both))


ID_SQL = "'Ses' || lpad(conv_id::VARCHAR, 8, '0') || '_T' || lpad(turn::VARCHAR, 3, '0')"


@query("s9_evaluation_blocks", f"""
    SELECT {ID_SQL} AS id, {CODES_SQL} AS emotion, {SCORE_SQL}::DOUBLE AS v, 2.5::DOUBLE AS a,
      {SCORE_SQL}::DOUBLE AS d
    FROM conversations""")
def s9(spark, sf):
    from affectlake.sources.files import parse_evaluations

    return parse_evaluations(evaluation_files(spark, sf)).drop("file")


@query("s10_transcript_lines", f"""
    SELECT {ID_SQL} AS id, replace(text, chr(10), ' ') AS transcription FROM conversations""")
def s10(spark, sf):
    from affectlake.sources.files import transcript_lines

    return transcript_lines(transcript_rows(spark, sf), ["file"]).drop("file")


@query("f14_evaluation_head", f"""
    SELECT 'Ses' || lpad(conv_id::VARCHAR, 8, '0') AS file, 'T' || lpad(turn::VARCHAR, 3, '0') AS utterance,
      {CODES_SQL} AS emotion, {SCORE_SQL}::DOUBLE AS v
    FROM conversations""")
def f14(spark, sf):
    head = F.substring_index(F.element_at(F.split("value", "\n\n"), 2), "\n", 1)
    return evaluation_files(spark, sf).select(T.evaluation_head(head).alias("e")).select(
        "e.file", "e.utterance", "e.emotion", "e.v"
    )


@query("f15_utterance_id", f"SELECT conv_id, turn, {ID_SQL} AS id FROM conversations")
def f15(spark, sf):
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        T.utterance_id(
            F.concat(F.lit("Ses"), F.lpad(F.col("conv_id").cast("string"), 8, "0")),
            F.concat(F.lit("T"), F.lpad(F.col("turn").cast("string"), 3, "0")),
        ).alias("id"),
    )


@query("f16_base_name", "SELECT page_id, page_id::VARCHAR || '_' || split_part(url, '/', 4) AS file FROM pages")
def f16(spark, sf):
    name = F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit("_"), F.split_part("url", F.lit("/"), F.lit(4)), F.lit(".txt"))
    return V.table(spark, sf, "pages").select("page_id", T.base_name(name).alias("file"))


DIALOGUE_SQL = f"""
    WITH t AS (SELECT {ID_SQL} AS id, {CODES_SQL} AS code, text FROM conversations),
    m(code, word) AS (VALUES ('ang','anger'),('hap','happy'),('sad','sadness'),('fru','frustrate'),
      ('exc','excite'),('fea','fear'),('sur','surprise'),('dis','disgust'),('neu','neutral'))"""


@query("s8_dialogue_corpus", DIALOGUE_SQL + f"""
    SELECT t.id, m.word AS emotion, {V.sql_dialogue("replace(t.text, chr(10), ' ')")} AS text
    FROM t JOIN m USING (code)""")
def s8(spark, sf):
    """Evaluations and transcripts to labelled, cleaned utterances."""
    from affectlake.functions.labels import DIALOGUE_LABELS
    from affectlake.operators.annotators import attach_transcripts
    from affectlake.sources.files import parse_evaluations, transcript_lines

    rows = parse_evaluations(evaluation_files(spark, sf)).withColumn("emotion", rename_codes("emotion"))
    rows = rows.filter(F.col("emotion").isin(DIALOGUE_LABELS))
    spoken = transcript_lines(transcript_rows(spark, sf), ["file"])
    return attach_transcripts(rows, spoken).select("id", "emotion", T.clean_dialogue("transcription").alias("text"))
