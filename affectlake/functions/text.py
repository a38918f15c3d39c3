"""Text cleaning as native column expressions.

Python workers are used by :func:`strip_html_exact` only.  The patterns are
written so that they mean the same in Java and in RE2.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections.abc import Callable, Iterable
from html.entities import html5

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from affectlake.session import bounded

# The characters that count as Unicode white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same set for Java: a property test and a range, much faster than the ranges.
UNICODE = "(?U)"
SPACE = r"\s\x1c-\x1f"
# ASCII punctuation that gets padded (the backslash does not).
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~"""

URL_PATTERN = rf"(?i)(?:https?://|www\.)[^{WS}]+"
MENTION_PATTERN = r"@[\p{L}\p{N}_]*"

# Elements whose content is not visible text.
HIDDEN_ELEMENTS = (
    "script", "style", "textarea", "select", "button",
    "applet", "iframe", "frameset", "noframes",
)
ENTITY = r"&(#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]{1,31});"
# A tag is read as a start and then, each where the last match ended, its attribute values:
# a quote holds a value only after "=", and may then hold ">".  No loop, so no length is too long.
TAG_PARTS = r"""(</?[A-Za-z!?][^>=]*+)|\G(?!\A)(=)\s*+(?:"[^"]*+"|'[^']*+')?+([^>=]*+)"""
TAG = r"</?[A-Za-z!?][^>]*+>"
# Code points with the Emoji property, as ranges, and the gaps within the long ones.
EMOJI_RANGES = (
    "203c 2049 2122 2139 2194-2199 21a9-21aa 231a-231b 2328 23cf 23e9-23f3 23f8-23fa 24c2 25aa-25ab 25b6 25c0 "
    "25fb-25fe 2600-2604 260e 2611 2614-2615 2618 261d 2620 2622-2623 2626 262a 262e-262f 2638-263a 2640 2642 "
    "2648-2653 265f-2660 2663 2665-2666 2668 267b 267e-267f 2692-2697 2699 269b-269c 26a0-26a1 26a7 26aa-26ab "
    "26b0-26b1 26bd-26be 26c4-26c5 26c8 26ce-26cf 26d1 26d3-26d4 26e9-26ea 26f0-26f5 26f7-26fa 26fd 2702 2705 "
    "2708-270d 270f 2712 2714 2716 271d 2721 2728 2733-2734 2744 2747 274c 274e 2753-2755 2757 2763-2764 2795-2797 "
    "27a1 27b0 27bf 2934-2935 2b05-2b07 2b1b-2b1c 2b50 2b55 3030 303d 3297 3299 1f004 1f0cf 1f170-1f171 1f17e-1f17f "
    "1f18e 1f191-1f19a 1f201-1f202 1f21a 1f22f 1f232-1f23a 1f250-1f251 1f300-1f64f 1f680-1f6ff 1f7e0-1f7eb "
    "1f90c-1f9ff 1fa70-1faff"
)
NOT_EMOJI_RANGES = (
    "1f322-1f323 1f394-1f395 1f398 1f39c-1f39d 1f3f1-1f3f2 1f3f6 1f4fe 1f53e-1f548 1f54f 1f568-1f56e 1f571-1f572 "
    "1f57b-1f586 1f588-1f589 1f58e-1f58f 1f591-1f594 1f597-1f5a3 1f5a6-1f5a7 1f5a9-1f5b0 1f5b3-1f5bb 1f5bd-1f5c1 "
    "1f5c5-1f5d0 1f5d4-1f5db 1f5df-1f5e0 1f5e2 1f5e4-1f5e7 1f5e9-1f5ee 1f5f0-1f5f2 1f5f4-1f5f9 1f6c6-1f6ca "
    "1f6d3-1f6d4 1f6e6-1f6e8 1f6ea 1f6f1-1f6f2 1f93b 1f946"
)
# Emoji whose short name is not their character name.
EMOJI_NAMES = {
    "❤": "red_heart", "☺": "smiling_face", "☹": "frowning_face", "⭐": "star", "⏰": "alarm_clock", "✨": "sparkles",
    "✅": "check_mark_button", "✔": "check_mark", "❌": "cross_mark", "⚡": "high_voltage", "☀": "sun", "☕": "hot_beverage",
    "✌": "victory_hand", "☝": "index_pointing_up", "✊": "raised_fist", "✋": "raised_hand", "❗": "red_exclamation_mark",
    "❓": "red_question_mark", "⚽": "soccer_ball", "♥": "heart_suit",
    "😀": "grinning_face", "😁": "beaming_face_with_smiling_eyes", "😂": "face_with_tears_of_joy",
    "😃": "grinning_face_with_big_eyes", "😄": "grinning_face_with_smiling_eyes", "😅": "grinning_face_with_sweat",
    "😆": "grinning_squinting_face", "😇": "smiling_face_with_halo", "😉": "winking_face",
    "😊": "smiling_face_with_smiling_eyes", "😋": "face_savoring_food", "😌": "relieved_face",
    "😍": "smiling_face_with_heart-eyes", "😎": "smiling_face_with_sunglasses", "😏": "smirking_face",
    "😐": "neutral_face", "😑": "expressionless_face", "😒": "unamused_face", "😓": "downcast_face_with_sweat",
    "😔": "pensive_face", "😕": "confused_face", "😖": "confounded_face", "😘": "face_blowing_a_kiss",
    "😙": "kissing_face_with_smiling_eyes", "😚": "kissing_face_with_closed_eyes", "😛": "face_with_tongue",
    "😜": "winking_face_with_tongue", "😝": "squinting_face_with_tongue", "😞": "disappointed_face",
    "😟": "worried_face", "😠": "angry_face", "😡": "enraged_face", "😢": "crying_face",
    "😣": "persevering_face", "😤": "face_with_steam_from_nose", "😥": "sad_but_relieved_face",
    "😦": "frowning_face_with_open_mouth", "😧": "anguished_face", "😨": "fearful_face", "😩": "weary_face",
    "😪": "sleepy_face", "😫": "tired_face", "😬": "grimacing_face", "😭": "loudly_crying_face",
    "😮": "face_with_open_mouth", "😯": "hushed_face", "😰": "anxious_face_with_sweat", "😱": "face_screaming_in_fear",
    "😲": "astonished_face", "😳": "flushed_face", "😴": "sleeping_face", "😷": "face_with_medical_mask",
    "🙂": "slightly_smiling_face", "🙁": "slightly_frowning_face", "🙃": "upside-down_face",
    "🙄": "face_with_rolling_eyes", "🤔": "thinking_face", "🤣": "rolling_on_the_floor_laughing",
    "👍": "thumbs_up", "👎": "thumbs_down", "👏": "clapping_hands", "🙏": "folded_hands", "🙌": "raising_hands",
    "👌": "OK_hand", "💪": "flexed_biceps", "👀": "eyes", "🔥": "fire", "💔": "broken_heart", "💕": "two_hearts",
    "💙": "blue_heart", "💜": "purple_heart", "💚": "green_heart", "💛": "yellow_heart", "🎉": "party_popper",
    "💯": "hundred_points", "🎶": "musical_notes", "😻": "smiling_cat_with_heart-eyes", "💀": "skull",
    "\U0001f3fb": "light_skin_tone", "\U0001f3fc": "medium-light_skin_tone", "\U0001f3fd": "medium_skin_tone",
    "\U0001f3fe": "medium-dark_skin_tone", "\U0001f3ff": "dark_skin_tone",
}
# Code points that make sequences of emoji.
JOINER, VARIATION, KEYCAP, FIRST_REGIONAL = "\u200d", "\ufe0f", "\u20e3", 0x1F1E6
SKIN_TONES = ("\U0001f3fb", "\U0001f3fc", "\U0001f3fd", "\U0001f3fe", "\U0001f3ff")
# Roles by the sign joined to a person, what people with a gender sign do, and other sequences.
ROLES = {
    "⚕": "health_worker", "🎓": "student", "🏫": "teacher", "⚖": "judge", "🌾": "farmer", "🍳": "cook",
    "🔧": "mechanic", "🏭": "factory_worker", "💼": "office_worker", "🔬": "scientist", "💻": "technologist",
    "🎤": "singer", "🎨": "artist", "✈": "pilot", "🚀": "astronaut", "🚒": "firefighter",
    "🦰": "red_hair", "🦱": "curly_hair", "🦳": "white_hair", "🦲": "bald",
    "🦯": "with_white_cane", "🦼": "in_motorized_wheelchair", "🦽": "in_manual_wheelchair",
}
DOING = {
    "🙍": "frowning", "🙎": "pouting", "🙅": "gesturing_NO", "🙆": "gesturing_OK", "💁": "tipping_hand",
    "🙋": "raising_hand", "🧏": "deaf", "🙇": "bowing", "🤦": "facepalming", "🤷": "shrugging",
    "👮": "police_officer", "🕵": "detective", "💂": "guard", "👷": "construction_worker", "👳": "wearing_turban",
    "👱": "blond_hair", "🤵": "in_tuxedo", "👰": "with_veil", "🦸": "superhero", "🦹": "supervillain",
    "🧙": "mage", "🧚": "fairy", "🧛": "vampire", "🧝": "elf", "💆": "getting_massage", "💇": "getting_haircut",
    "🚶": "walking", "🧍": "standing", "🧎": "kneeling", "🏃": "running", "🧖": "in_steamy_room", "🧗": "climbing",
    "🏌": "golfing", "🏄": "surfing", "🚣": "rowing_boat", "🏊": "swimming", "⛹": "bouncing_ball",
    "🏋": "lifting_weights", "🚴": "biking", "🚵": "mountain_biking", "🤸": "cartwheeling",
    "🤽": "playing_water_polo", "🤾": "playing_handball", "🤹": "juggling", "🧘": "in_lotus_position",
}
DOING_TOGETHER = {"👯": "with_bunny_ears", "🤼": "wrestling"}
OTHER_SEQUENCES = {
    "❤\u200d🔥": "heart_on_fire", "❤\u200d🩹": "mending_heart", "🏳\u200d🌈": "rainbow_flag",
    "🏳\u200d⚧": "transgender_flag", "🏴\u200d☠": "pirate_flag", "👁\u200d🗨": "eye_in_speech_bubble",
    "🐕\u200d🦺": "service_dog", "🐈\u200d⬛": "black_cat", "🐻\u200d❄": "polar_bear", "🐦\u200d⬛": "black_bird",
    "😮\u200d💨": "face_exhaling", "😵\u200d💫": "face_with_spiral_eyes", "😶\u200d🌫": "face_in_clouds",
    "🧑\u200d🎄": "mx_claus", "🧑\u200d🤝\u200d🧑": "people_holding_hands",
    "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f": "England",
    "🏴\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f": "Scotland",
    "🏴\U000e0067\U000e0062\U000e0077\U000e006c\U000e0073\U000e007f": "Wales",
}
SKIN_TONE = r":([^:\s]+)::((?:medium-)?(?:light|dark)_skin_tone|medium_skin_tone):"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, however often ``use`` mentions it.

    A condition with the text in its test and its branches would otherwise run
    the whole cleaning before it several times.
    """
    return F.get(F.transform(F.array(value), use), 0)


def _looked_up(key: Column, table: dict[str, str], per_map: int = 4) -> Column:
    """The entry of a constant table, or null.

    A map is searched entry by entry, so the table is an array of small maps, and the
    key's crc32 says which one may hold it.
    """
    n = max(len(table) // per_map, 1)
    maps: list[dict[str, str]] = [{} for _ in range(n)]
    for name, value in table.items():
        maps[zlib.crc32(name.encode()) % n][name] = value
    listed = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return F.try_element_at(F.get(listed, (F.crc32(key) % n).cast("int")), key)


# ---------------------------------------------------------------- single steps

def strip_space(col: Column | str) -> Column:
    return F.btrim(_c(col), F.lit(WHITESPACE))


def strip_quotes(col: Column | str) -> Column:
    """Runs of double quotes, then of single quotes, then white space; once each."""
    return strip_space(F.btrim(F.btrim(_c(col), F.lit('"')), F.lit("'")))


def pad_punctuation(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), f"([{PUNCTUATION}])", " $1 ")


def squeeze_space(col: Column | str) -> Column:
    """Two or more white-space characters become one space; a single tab stays."""
    return F.regexp_replace(_c(col), f"{UNICODE}[{SPACE}]{{2,}}", " ")


def drop_escaped_newline(col: Column | str) -> Column:
    """The two characters backslash and n become a space."""
    return F.replace(_c(col), F.lit("\\n"), F.lit(" "))


def squeeze_blanks(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), " {2,}", " ")


def drop_urls_mentions(col: Column | str) -> Column:
    out = F.regexp_replace(_c(col), URL_PATTERN, "")
    out = F.regexp_replace(out, MENTION_PATTERN, "")
    return strip_space(F.regexp_replace(out, f"{UNICODE}[{SPACE}]+", " "))


def hidden_html_pattern() -> str:
    """Hidden elements and comments, to their end or the text's; one leading ``<`` rejects most positions."""
    parts = [rf"{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)" for tag in HIDDEN_ELEMENTS]
    return "(?is)<(?:" + "|".join(parts) + r"|!--.*?(?:-->|\z))"


def entity_characters() -> dict[str, str]:
    """All named character references of HTML, without their semicolon."""
    return {name[:-1]: value for name, value in html5.items() if name.endswith(";")}


def decode_entities(col: Column | str) -> Column:
    """Character references, named or numeric, to their characters; unknown ones stay."""
    def char_of(name):
        hexadecimal = F.regexp_extract(name, "^#[xX]0*+([0-9a-fA-F]{1,6})$", 1)
        decimal = F.regexp_extract(name, "^#0*+([0-9]{1,7})$", 1)  # longer ones are beyond all code points
        digits = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).otherwise("0").cast("bigint")
        valid = (digits > 0) & (digits <= 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")
        numeric = F.when(valid, point).otherwise("\ufffd")
        return F.when(name.startswith("#"), numeric).otherwise(
            F.coalesce(_looked_up(name, entity_characters()), F.concat(F.lit("&"), name, F.lit(";"))))

    def rename(text):
        found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))
        joined = F.zip_with(
            F.split(text, ENTITY), found, lambda p, e: F.concat(p, F.coalesce(char_of(e), F.lit("")))
        )
        held = F.contains(text, F.lit("&")) & F.rlike(text, F.lit(ENTITY))
        return F.when(held, F.array_join(joined, "")).otherwise(text)

    return _once(_c(col), rename)


def strip_html(col: Column | str) -> Column:
    """HTML fragment to visible text with patterns only (no Python worker).

    Tags may have any number of attributes of any length, and their quoted values may
    hold any character.  A tag that is never closed stays, without its quoted values.
    """
    def without_tags(text):
        out = F.regexp_replace(text, hidden_html_pattern(), "")
        out = F.regexp_replace(out, f"(?s){TAG_PARTS}", "$1$2$3")
        return F.when(F.contains(text, F.lit("<")), F.regexp_replace(out, f"(?s){TAG}", "")).otherwise(text)

    return decode_entities(_once(_c(col), without_tags))


def strip_html_exact(col: Column | str) -> Column:
    """HTML to visible text with a real parser, one Arrow batch at a time.

    Texts without markup never leave the JVM as values: they are sent as null.
    """
    hidden = frozenset(HIDDEN_ELEMENTS)

    @F.arrow_udf("string")
    def parse(batch):
        import pyarrow as pa
        from html.parser import HTMLParser

        class Visible(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.depth, self.parts = 0, []

            def handle_starttag(self, tag, attrs):
                self.depth += tag in hidden

            def handle_endtag(self, tag):
                if tag in hidden and self.depth:
                    self.depth -= 1

            def handle_data(self, data):
                if not self.depth:
                    self.parts.append(data)

        def visible(text):
            if text is None:
                return None
            parser = Visible()
            parser.feed(text)
            parser.close()
            return "".join(parser.parts)

        return pa.array([visible(t) for t in batch.to_pylist()], pa.string())

    col = _c(col)
    markup = col.contains("<") | col.contains("&")
    return F.when(markup, parse(F.when(markup, col))).otherwise(col)


def straighten_quotes(col: Column | str) -> Column:
    return F.replace(F.replace(_c(col), F.lit("“"), F.lit('"')), F.lit("”"), F.lit('"'))


def _points(ranges: str) -> set[int]:
    ends = [r.split("-") for r in ranges.split()]
    return {c for e in ends for c in range(int(e[0], 16), int(e[-1], 16) + 1)}


def emoji_names() -> dict[str, str]:
    """Single-character emoji and their names; other symbols are no emoji.

    Names not listed are the character's own; a table of short names can be passed to
    :func:`demojize` instead.
    """
    names = {}
    for code in sorted(_points(EMOJI_RANGES) - _points(NOT_EMOJI_RANGES)):
        name = unicodedata.name(chr(code), "")
        if name:
            names[chr(code)] = name.lower().replace(" ", "_")
    return {**names, **EMOJI_NAMES}


def _code_blocks(codes: list[int], gap: int = 256) -> list[tuple[int, int]]:
    """Code points as few ranges; gaps up to ``gap`` are bridged."""
    blocks: list[list[int]] = []
    for code in sorted(codes):
        if blocks and code <= blocks[-1][1] + gap:
            blocks[-1][1] = code
        else:
            blocks.append([code, code])
    return [(a, b) for a, b in blocks]


def _in_class(blocks: Iterable[tuple[int, int]]) -> str:
    """A pattern's class; Java tests single ASCII characters together, but every range by itself."""
    singly = [(c, c) for a, b in blocks for c in range(a, min(b, 127) + 1)]
    ranges = singly + [(max(a, 128), b) for a, b in blocks if b >= 128]
    return "[" + "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


def _code_class(chars: Iterable[str]) -> str:
    """Exactly these characters, as the inside of a pattern's class."""
    return _in_class(_code_blocks([ord(c) for c in chars], 1))[1:-1]


def _wide_blocks(chars: Iterable[str], blocks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Few ranges that hold the characters and the blocks, but no other ASCII."""
    ends = [*map(ord, chars), *(code for block in blocks for code in block)]
    ascii_codes = {c for c in ends if c < 128} | {c for a, b in blocks for c in range(a, min(b, 127) + 1)}
    return _code_blocks([*ascii_codes], 1) + _code_blocks([max(c, 128) for c in ends if c >= 128], 4096)


def flag_names() -> dict[str, str]:
    """Flags, two regional letters each, and the names of the regions, from the Java runtime's tables."""
    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    names = {}
    for code in [*locale.getISOCountries(), "EU", "UN", "XK"]:
        region = locale("", code).getDisplayCountry(locale.ENGLISH)
        names["".join(chr(FIRST_REGIONAL + ord(c) - ord("A")) for c in code)] = region.replace(" ", "_")
    return names


@functools.cache
def emoji_sequences() -> dict[str, str]:
    """Emoji of several code points and their names, without variation selectors.

    Flags, keycaps, people with roles or genders in all skin tones, families, couples,
    and the sequences listed in OTHER_SEQUENCES.
    """
    names = {**flag_names(), **OTHER_SEQUENCES}
    names.update({f"{c}{KEYCAP}": f"keycap_{c}" for c in "0123456789#*"})
    tones = {"": "", **{tone: f"_{EMOJI_NAMES[tone]}" for tone in SKIN_TONES}}
    for tone, toned in tones.items():
        for person, who in {"👨": "man_", "👩": "woman_", "🧑": ""}.items():
            for sign, role in ROLES.items():
                names[f"{person}{tone}{JOINER}{sign}"] = f"{who}{role}{toned}"
        for sign, who in {"♂": "man", "♀": "woman"}.items():
            for base, doing in DOING.items():
                names[f"{base}{tone}{JOINER}{sign}"] = f"{who}_{doing}{toned}"
    for sign, who in {"♂": "men", "♀": "women"}.items():
        names.update({f"{base}{JOINER}{sign}": f"{who}_{doing}" for base, doing in DOING_TOGETHER.items()})
    grown, young = {"👨": "man", "👩": "woman"}, {"👦": "boy", "👧": "girl"}
    parents = [[a] for a in grown] + [["👨", "👩"], ["👨", "👨"], ["👩", "👩"]]
    children = [["👦"], ["👧"], ["👧", "👦"], ["👦", "👦"], ["👧", "👧"]]
    for family in (p + c for p in parents for c in children):
        names[JOINER.join(family)] = "_".join(["family", *({**grown, **young}[x] for x in family)])
    for a, b in (("👩", "👨"), ("👨", "👨"), ("👩", "👩")):
        names[JOINER.join([a, "❤", b])] = f"couple_with_heart_{grown[a]}_{grown[b]}"
        names[JOINER.join([a, "❤", "💋", b])] = f"kiss_{grown[a]}_{grown[b]}"
    return names


def trie_pattern(sequences: Iterable[str]) -> str:
    """A pattern that matches the longest of the sequences, as a trie of code points."""
    root: dict = {}
    for sequence in sequences:
        node = root
        for char in sequence:
            node = node.setdefault(char, {})
        node[None] = None

    def shown(node: dict) -> str:
        kids = [rf"\x{{{ord(c):x}}}{shown(kid)}" for c, kid in sorted((c, k) for c, k in node.items() if c)]
        return f"(?:{'|'.join(kids)}){'?' if None in node else ''}" if kids else ""

    return shown(root)


def names_from(table: DataFrame, emoji: str = "emoji", name: str = "name") -> dict[str, str]:
    """A table of emoji, of one code point or more, and names, for :func:`demojize`."""
    rows, small = bounded(table.select(emoji, name))
    if not small:
        raise ValueError("a table of emoji names is a small one")
    return {r[0].replace(VARIATION, ""): r[1] for r in rows.collect()}


def demojize(col: Column | str, names: dict[str, str] | None = None) -> Column:
    """Emoji to ``:name:``; of several that begin at one place the longest is taken.

    Only texts that hold one are taken apart, in one scan: the emoji, and the pieces
    between them.  ``names`` takes the place of all built-in names.
    """
    names = {**emoji_names(), **emoji_sequences()} if names is None else names
    shown = {k: f":{v}:" for k, v in names.items()}
    singles, longer = [k for k in names if len(k) == 1], [k for k in names if len(k) > 1]
    blocks = _code_blocks([ord(k) for k in singles])
    firsts, seconds = (_code_class({k[i] for k in longer}) for i in (0, 1))
    found = "|".join([f"(?=[{firsts}][{seconds}]){trie_pattern(longer)}"] * bool(longer) + [_in_class(blocks)] * bool(singles))
    # Few wide ranges hold all that an emoji can begin with; all other places are passed over at once.
    wide = _in_class(_wide_blocks({k[0] for k in longer}, blocks))
    inside = f"(?={wide})(?:{found})" if names else "(?!)"
    pieces = f"(?s){inside}|[^{wide[1:-1]}]++|." if names else "(?s).++"

    def rename(plain, text):
        named = F.transform(
            F.regexp_extract_all(plain, F.lit(pieces), F.lit(0)), lambda p: F.coalesce(_looked_up(p, shown), p))
        toned = F.regexp_replace(F.array_join(named, ""), SKIN_TONE, ":$1_$2:")
        return F.when(F.rlike(plain, F.lit(inside)), toned).otherwise(text)

    def without_variations(text):
        return _once(F.replace(text, F.lit(VARIATION), F.lit("")), lambda plain: rename(plain, text))

    return _once(_c(col), without_variations)


def pad_emoji_names(col: Column | str) -> Column:
    out = F.regexp_replace(_c(col), f"{UNICODE}(:[^{SPACE}]+:)", " $1 ")
    return squeeze_space(F.replace(out, F.lit("::"), F.lit(": :")))


def join_statement_lines(col: Column | str) -> Column:
    """``á`` before a newline goes, then every newline goes without a space."""
    out = F.replace(_c(col), F.lit("á\n"), F.lit("\n"))
    return F.replace(out, F.lit("\n"), F.lit(""))


def is_own_name(col: Column | str, name: str) -> Column:
    """1 where the cell holds the column's own name in any case, else 0."""
    return F.when(F.lower(_c(col)) == F.lit(name), 1).otherwise(0)


def int_list(col: Column | str) -> Column:
    """``"3,17"`` to an integer array; bad input raises under ANSI mode."""
    return F.transform(F.split(_c(col), ","), lambda x: x.cast("int"))


HEAD_PATTERN = r"\t([^\t\n]+)_([^\t\n]{4})\t([^\t\n]{3})\t\[([^,\n]+), ([^,\n]+), ([^\]\n]+)\]"


def evaluation_head(head: Column | str) -> Column:
    """Fields of a block header ``[..]\\t<file>_<utt>\\t<code>\\t[v, a, d]``."""
    head = _c(head)

    def part(i):
        return F.regexp_extract(head, HEAD_PATTERN, i)

    return F.struct(
        part(1).alias("file"),
        part(2).alias("utterance"),
        part(3).alias("emotion"),
        *[part(i).cast("double").alias(n) for i, n in ((4, "v"), (5, "a"), (6, "d"))],
    )


def utterance_id(file: Column | str, utterance: Column | str) -> Column:
    return F.concat_ws("_", _c(file), _c(utterance))


def base_name(col: Column | str) -> Column:
    """File name without folder and without its last four characters."""
    return F.regexp_extract(_c(col), r"([^/]*)....$", 1)


# ------------------------------------------------------------- whole cleanings

def clean_basic(col: Column | str) -> Column:
    return strip_space(squeeze_space(pad_punctuation(strip_quotes(col))))


def clean_tweet(col: Column | str, html: str = "native") -> Column:
    """Tweet cleaning; ``html`` is ``"native"`` (patterns) or ``"exact"`` (parser)."""
    if html not in ("native", "exact"):
        raise ValueError(f"html must be native or exact, not {html!r}")
    unhtml = strip_html if html == "native" else strip_html_exact
    out = strip_quotes(straighten_quotes(unhtml(drop_urls_mentions(col))))
    out = squeeze_blanks(drop_escaped_newline(squeeze_space(pad_punctuation(out))))
    return strip_space(pad_emoji_names(demojize(out)))


def clean_statement(col: Column | str) -> Column:
    out = squeeze_blanks(strip_quotes(join_statement_lines(col)))
    return strip_space(squeeze_space(pad_punctuation(out)))


def clean_dialogue(col: Column | str) -> Column:
    out = drop_escaped_newline(squeeze_space(pad_punctuation(col)))
    return strip_space(squeeze_blanks(out))


CLEANERS = {
    "basic": clean_basic,
    "tweet": clean_tweet,
    "statement": clean_statement,
    "dialogue": clean_dialogue,
}
