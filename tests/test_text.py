import random
import re
import string

import pytest
from pyspark.sql import functions as F

from affectlake.functions import text as T

PAD = re.compile("([" + re.escape(string.punctuation.replace("\\", "")) + "])")


def column(spark, texts, fn):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["o"] for r in rows.select("i", fn("t").alias("o")).orderBy("i").collect()]


def expected_basic(t):
    t = PAD.sub(r" \1 ", t.strip('"').strip("'").strip())
    return re.sub(r"\s{2,}", " ", t).strip()


def expected_dialogue(t):
    t = re.sub(r"\s{2,}", " ", PAD.sub(r" \1 ", t))
    return re.sub(" +", " ", t.replace("\\n", " ")).strip()


def expected_statement(t):
    t = t.replace("á\n", "\n").replace("\n", "").strip('"').strip("'").strip()
    t = PAD.sub(r" \1 ", re.sub(" +", " ", t))
    return re.sub(r"\s{2,}", " ", t).strip()


@pytest.fixture(scope="module")
def noise():
    rng = random.Random(3)
    alphabet = string.punctuation + string.ascii_letters + T.WHITESPACE + "éßá日😂\\n\"'\"'  \t\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    return texts + ["", " ", '""', "a\tb", "  x  ", string.punctuation, "á\nfoo\nbar", "x\\ny"]


@pytest.mark.parametrize(
    "fn, expected",
    [
        (T.clean_basic, expected_basic),
        (T.clean_dialogue, expected_dialogue),
        (T.clean_statement, expected_statement),
        (T.squeeze_space, lambda t: re.sub(r"\s{2,}", " ", t)),
        (T.squeeze_blanks, lambda t: re.sub(" +", " ", t)),
        (T.strip_quotes, lambda t: t.strip('"').strip("'").strip()),
        (T.pad_emoji_names, lambda t: re.sub(r"\s{2,}", " ", re.sub(r"(:\S+:)", r" \1 ", t).replace("::", ": :"))),
    ],
)
def test_same_as_plain_strings(spark, noise, fn, expected):
    assert column(spark, noise, fn) == [expected(t) for t in noise]


def test_backslash_is_not_padded(spark):
    assert column(spark, ["a\\b/c"], T.pad_punctuation) == ["a\\b / c"]


def test_white_space_is_the_unicode_set():
    assert set(T.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_white_space_patterns_agree_on_every_character(spark):
    codes = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}{chr(c)}" for c in codes[i:i + 64]) for i in range(0, len(codes), 64)]
    assert column(spark, texts, T.squeeze_space) == [re.sub(r"\s{2,}", " ", t) for t in texts]
    collapsed = column(spark, texts, T.drop_urls_mentions)
    assert collapsed == [" ".join(re.sub(r"@\w*", "", t).split()) for t in texts]


def test_tweet_cleaning(spark):
    tweet = "“see” https://t.co/x @joe &amp; <b>bold</b><style>p{}</style><!-- no --> 😂😂❤️ 日本!"
    want = 'see " & bold :face_with_tears_of_joy: :face_with_tears_of_joy: :red_heart: 日本 !'
    for html in ("native", "exact"):
        assert column(spark, [tweet], lambda c: T.clean_tweet(c, html)) == [want]


def test_exact_html_handles_what_patterns_cannot(spark):
    out = column(spark, ["a &lt;b&gt; &#233; <p title='x>y'>t</p>", None, "plain"], T.strip_html_exact)
    assert out == ["a <b> é t", None, "plain"]


def test_emoji_table_is_pluggable(spark):
    out = column(spark, ["x★y", "none"], lambda c: T.demojize(c, {"★": "star"}))
    assert out == ["x:star:y", "none"]
    longest = {"ab": "two", "abc": "three", "abcde": "five", "a": "one", "x": "single"}
    out = column(spark, ["abcd abab xabcdea b", "bc", None], lambda c: T.demojize(c, longest))
    assert out == [":three:d :two::two: :single::five::one: b", "bc", None]
    assert column(spark, ["ab a"], lambda c: T.demojize(c, {"ab": "two"})) == [":two: a"]


def test_emoji_sequences(spark):
    texts = {
        "🇫🇷 🇺🇸🇯🇵 🇧🇦": ":France: :United_States::Japan: :Bosnia_&_Herzegovina:", "🇫 x": "🇫 x",
        "1️⃣ #⃣ 1 #": ":keycap_1: :keycap_#: 1 #", "👩🏽‍⚕️👨‍💻 🧑‍🎓": ":woman_health_worker_medium_skin_tone::man_technologist: :student:",
        "🤷‍♀️ 🏃🏿‍♂️": ":woman_shrugging: :man_running_dark_skin_tone:", "👨‍👩‍👧‍👦 👩‍❤️‍👨": ":family_man_woman_girl_boy: :couple_with_heart_woman_man:",
        "🏳️‍🌈 🏴‍☠️ ❤️‍🔥": ":rainbow_flag: :pirate_flag: :heart_on_fire:", "🏴\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f": ":Scotland:",
        "😀\u200d😀": ":grinning_face:\u200d:grinning_face:", "👍🏽": ":thumbs_up_medium_skin_tone:",
        "🇫🇷" * 3_000: ":France:" * 3_000,
    }
    assert column(spark, list(texts), T.demojize) == list(texts.values())


def test_names_from_a_table(spark):
    table = spark.createDataFrame([("❤\ufe0f\u200d🔥", "burning"), ("❤", "heart")], "emoji string, name string")
    assert column(spark, ["❤️‍🔥❤️🔥"], lambda c: T.demojize(c, T.names_from(table))) == [":burning::heart:🔥"]
    with pytest.raises(ValueError, match="small"):
        T.names_from(spark.range(200_000).select(F.col("id").cast("string").alias("emoji"), F.lit("x").alias("name")))


def test_cleaning_uses_no_python_worker(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    for name, fn in T.CLEANERS.items():
        plan = rows.select(fn("t"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan, name


def test_evaluation_head(spark):
    head = "[6.2901 - 8.2357]\tSes01F_script01_1_F000\tneu\t[2.5000, 3.0000, 1.5000]"
    rows = spark.createDataFrame([(head,)], "h string").select(T.evaluation_head("h").alias("e")).select("e.*")
    assert tuple(rows.first()) == ("Ses01F_script01_1", "F000", "neu", 2.5, 3.0, 1.5)


def test_int_list_rejects_garbage(spark):
    rows = spark.createDataFrame([("3,17",)], "t string").select(T.int_list("t").alias("i"))
    assert rows.first()["i"] == [3, 17]
    with pytest.raises(Exception):
        spark.createDataFrame([("3,x",)], "t string").select(F.size(T.int_list("t")), T.int_list("t")).collect()


def test_html_entities_and_tags(spark):
    texts = {
        "it&#8217;s &euro;5 &#233; &eacute; &#x1F600; &amp;lt; &nope; &#0;": "it’s €5 é é 😀 &lt; &nope; �",
        "<p title='a>b'>y</p>": "y", "<a b=c'd>x</a>": "x", "a <button>never closed": "a ", "x<!-- open": "x",
        "&#0000000000065;&#x00000000041;&#99999999999;&#x110000;&#xD800;&#x1F6000;": "AA\ufffd\ufffd\ufffd\ufffd",
        "<p" + " a=\"x>y\"" * 10_000 + ">z</p>": "z", "<p" + " a = '<b>'" * 10_000 + " c=d>z</p> = \"<i>q</i>\"": "z = \"q\"",
        "a = \"<b>x</b>\" > y": "a = \"x\" > y", "<b>=\"<i>\"</b>": "=\"\"", "1 <2 <a b='c>' d": "1 <2 <a b= d",
        "<a b='it>x</a>": "x", "<a =\"q>\" =r=\"s>\">x<br/>y": "xy", "<p title=" + "x" * 100_000 + ">z": "z",
    }
    rows = spark.createDataFrame(list(texts.items()), "t string, want string")
    for r in rows.select("want", T.strip_html("t").alias("got")).collect():
        assert r.got == r.want


def test_symbols_are_no_emoji(spark):
    text = "5 ★ hotel ✓ ♪ ☐ ⭐ ⏰ 😍 🙏 👍🏽 1 #"
    got = spark.createDataFrame([(text,)], "t string").select(T.demojize("t").alias("o")).first().o
    assert got == ("5 ★ hotel ✓ ♪ ☐ :star: :alarm_clock: :smiling_face_with_heart-eyes: :folded_hands: "
                   ":thumbs_up_medium_skin_tone: 1 #")


def test_tables_of_names_are_searched_in_small_maps(spark):
    names = {**T.emoji_names(), **T.emoji_sequences()}
    rows = spark.createDataFrame([*names.items(), ("no", None)], "k string, want string")
    found = T._looked_up(F.col("k"), names)
    assert not rows.select("want", found.alias("got")).filter("not (want <=> got)").count()
    plan = rows.select(T.demojize("k"), T.decode_entities("k"))._jdf.queryExecution().analyzed().toString()
    assert "map<string,string>" not in plan.replace("array<map<string,string>>", "")


def test_texts_are_split_by_no_pattern_of_names(spark):
    """``split`` compiles its pattern for every row."""
    plan = spark.createDataFrame([("a",)], "t string").select(T.demojize("t"))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan and "regexp_extract_all(" in plan


def test_pieces_between_emoji_stay_whole(spark):
    texts = {
        "a#b*1 1️⃣2😂→️∑日本\n5\u20e3\u200d😂": "a#b*1 :keycap_1:2:face_with_tears_of_joy:→∑日本\n:keycap_5:\u200d:face_with_tears_of_joy:",
        "∑️ plain": None, "1️ 2": None, "": "", "👩🏽\u200d": ":woman_medium_skin_tone:\u200d", "𝒳😂𝒳\U000e0067": "𝒳:face_with_tears_of_joy:𝒳\U000e0067",
    }
    got = column(spark, list(texts), T.demojize)
    assert got == [t if want is None else want for t, want in texts.items()]
    assert column(spark, ["a😂️", None], lambda c: T.demojize(c, {})) == ["a😂️", None]
