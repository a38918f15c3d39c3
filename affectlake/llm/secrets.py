"""Secret scan: candidates by form, false positives removed by a random forest.

A candidate is a run of at least LEAST key-like characters with a digit among them, a part
of a run in the format of a known issuer, or the whole value, quoted or not, that is
assigned to a name with one of SECRET_WORDS, of any length and with any characters.
Candidates may lie inside others; those inside a secret are not judged.  Its features are its length, its characters and their
transitions, how much of it dictionary words cover, the path it stands in, and the words
and signs around it.  The forest is Spark's and judges all but the formats of known
issuers, which are secrets by form, and values that stand for another one (literals,
templates, blanks, calls and references), which are none by form.  It is fitted on labelled findings: given ones, or
those that ``weak_label`` is sure of (formats of known issuers and assigned random
values, against addresses, numbers and dates).  All documents are searched for findings;
the forest is fitted on at most SAMPLE_FINDINGS of them, half for each label, chosen by
hash: that bound is the only sample here.

The fitted trees are saved in the shared folder and read back as a table of nodes, at
most TREES * 2 ** (DEPTH + 1) rows, so that one scan finds, judges and masks candidates
where the text is; texts are never shuffled.

Defined results: null and empty texts have no findings; a missing path is an empty one;
texts of any length are scanned whole; rows that repeat are scanned each; if the labelled
findings lack one of the two labels, findings are judged by ``weak_label`` alone; an
empty table gives no rows; other columns stay inside ``row``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from affectlake.llm.common import arrow_map
from affectlake.llm.language import VOCABULARY, pieces
from affectlake.session import saved, shared_folder

LEAST = 8
SAMPLE_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5
AROUND = 48
MASK = "[SECRET]"

CANDIDATE = re.compile(rb"[A-Za-z0-9_+/.@-]{%d,}={0,2}" % LEAST)
DIGIT = re.compile(rb"[0-9]")
ASSIGNED = re.compile(r"([A-Za-z0-9_-]{2,64})[\"'`\])\\]{0,4}\s{0,3}(?:=>|:=|={1,3}|:)\s{0,3}"
                      r"(?:[Bb]earer |[Bb]asic )?[rbfuRBFU]{0,2}\\?[\"'`]?$")
WORD = re.compile(r"[A-Za-z]+")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Assignments: the sign, the name before it (with or without a type), and the value after it.
SIGN = re.compile(rb"=>|:=|={1,3}|:")
NAME = re.compile(rb"([A-Za-z0-9_-]+)[\"'`\])\\]{0,4}[ \t]*$")
TYPED_NAME = re.compile(rb"([A-Za-z0-9_-]+)[ \t]*:[ \t]*[A-Za-z_][A-Za-z0-9_.\[\]|?]*[ \t]*$")
TYPE = re.compile(rb"[ \t]*[A-Za-z_][A-Za-z0-9_.\[\]|?]*[ \t]+=[ \t]")
LEAD = re.compile(rb"[ \t]*(?:\r?\n[ \t]*(?=[\"'`]))?(?:[Bb]earer[ \t]+|[Bb]asic[ \t]+)?(?:[rbfuRBFU]{1,2}(?=[\"']))?")
QUOTED = re.compile(
    rb'"((?:[^"\\\n]++|\\.)*+)"|\'((?:[^\'\\\n]++|\\.)*+)\'|`((?:[^`\\\n]++|\\.)*+)`|'
    rb'\\"((?:[^"\\\n]++|\\[^"\n])*+)\\"|\\\'((?:[^\'\\\n]++|\\[^\'\n])*+)\\\'')
# Up to the next pair of the same run; a quote belongs to it inside a word and inside brackets.
BARE = re.compile(rb"(?:[\[(](?:\"[^\"\n]*+\"|'[^'\n]*+')[^\s\"'`()\[\]]*+[\])]|"
                  rb"(?![;,&][A-Za-z_][A-Za-z0-9_.-]*+=)[^\s\"'`]|(?<=[^\s\"'`=:])[\"'`](?=[A-Za-z0-9]))+")
SPACES = re.compile(rb"[ \t\r\n]+")
BRACKETS = [(b"(", b")"), (b"[", b"]"), (b"{", b"}"), (b"<", b">")]
NAME_REACH = 128
RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")

# Formats of issuers, forms that are no secrets, words that name secrets or examples.
# Inside a run an issuer's sign must not be the end of a word ("risk_", "AKIA" in a longer upper-case run).
ISSUED = re.compile(
    r"(?<![0-9A-Z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}|"
    r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|(?<![A-Za-z0-9])sk[-_][A-Za-z0-9_-]{20,}|"
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"
)
ISSUED_BYTES = re.compile(ISSUED.pattern.encode())
HARMLESS = re.compile(
    r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|[0-9.+/_-]+|v?[0-9]+(\.[0-9]+)+[A-Za-z0-9.-]*|"
    r"(www\.)?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(/[A-Za-z0-9_./-]*)?"
)
# Assigned values that are no secrets by form: literals, templates and blanks; without quotes, calls and references
# too, and words of a sentence ("the key: value of ...").
STANDS_IN = re.compile(
    r"(?i:true|false|null|none|nil|undefined)|\$[A-Z_][A-Z0-9_]*|\$\{[^{}]*\}|\$\([^()]*\)|\{\{.*\}\}|"
    r"\{[A-Za-z_0-9.]*\}|<[^<>]*>|%\(?[A-Za-z_]*\)?[sdr]|%[A-Za-z_]+%|([*xX.#?_-])\1*", re.DOTALL)
REFERENCE = re.compile(
    r"[A-Za-z_][A-Za-z0-9_.]*(?:\(.*\)|\[.*\])|(?:self|this|args|os|config|settings|env|process|request|options)"
    r"(?:\.[A-Za-z_][A-Za-z0-9_]*)+", re.DOTALL)
SENTENCE = re.compile(r"[A-Z]?[a-z]+\s+[A-Za-z]")
RANDOM = re.compile(r"(?=.*[0-9])(?:[0-9a-fA-F]{16,}|[A-Za-z0-9+/_-]{16,}={0,2})")
SECRET_WORDS = set("password passwd pwd pass secret token key apikey auth authorization bearer credential credentials "
                   "private access".split())
EXAMPLE_WORDS = set("example sample dummy test fake placeholder doc docs fixture mock changeme".split())

FEATURES = [
    "length", "digits", "upper", "lower", "distinct", "entropy", "transitions", "longest_run", "dictionary",
    "path_example", "path_depth", "assigned", "quoted", "secret_word", "example_word", "at_or_dot",
]
FINDING = "struct<start:bigint,end:bigint,score:double,secret:boolean,value_sha256:string>"
FINDING_ARROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                           ("secret", pa.bool_()), ("value_sha256", pa.string())])


def dictionary(vocabulary: str = VOCABULARY) -> frozenset[str]:
    """Words of four letters or more in the public vocabulary."""
    return frozenset(p[1:].lower() for p in pieces(vocabulary) if len(p) > 4 and p[0] == "▁" and p[1:].isalpha())


def named_words(name: str) -> set[str]:
    """The words of a name, by case too ("dbPassword"), in lower case."""
    return {w.lower() for part in WORD.findall(name.replace("_", " ")) for w in (part, *NAME_WORD.findall(part))}


def assigned_values(text: bytes):
    """``(start, end, from)`` of each value of a name with a secret word; ``from`` is where the name begins."""
    signs = []
    for sign in SIGN.finditer(text):
        low = max(0, sign.start() - NAME_REACH)
        before = text[low : sign.start()]
        found = [m for m in (NAME.search(before), sign.group() != b":" and TYPED_NAME.search(before)) if m]
        named = [m for m in found if named_words(m.group(1).decode()) & SECRET_WORDS]
        if named and not (sign.group() == b":" and TYPE.match(text, sign.end())):
            signs.append((low + named[0].start(), sign.end()))
    for at, (name, after) in enumerate(signs):
        start = LEAD.match(text, after).end()
        quoted = QUOTED.match(text, start)
        if quoted:
            start, end = quoted.span(quoted.lastindex)
        else:
            start += text[start : start + 1] in (b'"', b"'", b"`")  # a quote that is not closed
            bare = BARE.match(text, start, signs[at + 1][0] if at + 1 < len(signs) else len(text))
            end = start + len(_unclosed(bare.group())) if bare else start
        if text[start:end].strip():
            yield start, end, name


def _unclosed(value: bytes) -> bytes:
    """``value`` without the signs of the text around it: stops, and brackets it does not open."""
    spare = {close: value.count(close) - value.count(open_) for open_, close in BRACKETS}
    end = len(value)
    while end:
        last = value[end - 1 : end]
        if last not in (b".", b",", b";", b":") and spare.get(last, 0) <= 0:
            break
        if last in spare:
            spare[last] -= 1
        end -= 1
    return value[:end]


def _parts(text: bytes, start: int, end: int):
    """``(start, end)`` of the issued keys in a run, and of its other parts that are long enough and have a digit."""
    at = start
    for low, high in [*(k.span() for k in ISSUED_BYTES.finditer(text, start, end)), (end, end)]:
        other = text[at:low].rstrip(b".-/@")
        if len(other) >= LEAST and DIGIT.search(other):
            yield at, at + len(other)
        if low < high:
            yield low, high
        at = high


def candidates(text: bytes):
    """``(start, end, value, before, after)`` of each candidate, places in bytes.

    In order of their starts, the longest first; one may lie inside another.
    """
    spans = {(start, end): name for start, end, name in assigned_values(text)}
    for run in CANDIDATE.finditer(text):
        for span in _parts(text, run.start(), run.start() + len(run.group().rstrip(b".-/@"))):
            spans.setdefault(span, None)
    for (start, end), name in sorted(spans.items(), key=lambda s: (s[0][0], -s[0][1])):
        before = text[max(0, start - AROUND) : start]
        if name is not None:
            before = SPACES.sub(b" ", text[min(name, max(0, start - AROUND)) : start])
        yield (start, end, text[start:end].decode(), before.decode(errors="ignore"),
               text[end : end + AROUND].decode(errors="ignore"))


def features(value: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    n, counts, runs = len(value), Counter(value), RUNS.findall(value)
    lowered = value.lower()
    covered = [False] * n
    for run in WORD.finditer(lowered):
        a, b = run.span()
        i = a
        while i < b:
            size = next((k for k in range(min(b - i, 14), 3, -1) if lowered[i : i + k] in words), 0)
            for j in range(i, i + size):
                covered[j] = True
            i += size or 1
    assigned = ASSIGNED.search(before)
    near = {w.lower() for w in WORD.findall(f"{before[-24:]} {after[:16]}")}
    named = named_words(assigned.group(1)) if assigned else set()
    return [
        float(n), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n,
        sum(c.islower() for c in value) / n, len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), (len(runs) - 1) / n, max(map(len, runs)) / n,
        sum(covered) / n, float(bool({w.lower() for w in WORD.findall(path)} & EXAMPLE_WORDS)),
        float(path.count("/")), float(bool(assigned)), float(before[-1:] in ("'", '"', "`")),
        float(bool((near | named) & SECRET_WORDS)), float(bool(near & EXAMPLE_WORDS)),
        (value.count("@") + value.count(".")) / n,
    ]


def stands_in(value: str, before: str) -> bool:
    """Whether a value is none of its own, by its form."""
    return bool(STANDS_IN.fullmatch(value) or before[-1:] not in ("'", '"', "`") and REFERENCE.fullmatch(value))


def weak_label(value: str, before: str, after: str = "") -> bool | None:
    """True or False where the form leaves no doubt, else None."""
    if ISSUED.search(value):
        return True
    if HARMLESS.fullmatch(value):
        return False
    assigned = ASSIGNED.search(before)
    if assigned and named_words(assigned.group(1)) & SECRET_WORDS:
        if RANDOM.fullmatch(value):
            return True
        return False if stands_in(value, before) or before[-2:] == ": " and SENTENCE.match(value + after) else None
    return None


def labelled_findings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
    vocabulary: str = VOCABULARY, sample: int = SAMPLE_FINDINGS,
) -> DataFrame:
    """``(label, features)`` of the sure findings of all documents, at most half of ``sample`` per label, by hash.

    Written once: counting them and every pass of the fit read the findings, not the texts.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("#secrets")))
    words = dictionary(vocabulary)

    def work():
        def find(texts: list, paths: list) -> tuple[list]:
            out = []
            for text, path in zip(texts, paths, strict=True):
                rows = []
                for _, _, value, before, after in candidates(text or b""):
                    label = weak_label(value, before, after)
                    if label is not None:
                        rows.append({"label": float(label), "features": features(value, before, after, path or "", words)})
                out.append(rows)
            return (out,)

        return find

    kind = pa.list_(pa.struct([("label", pa.float64()), ("features", pa.list_(pa.float64()))]))
    chosen = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    found = arrow_map(chosen, "text", work, [("found", "array<struct<label:double,features:array<double>>>", kind)],
                      also=["path"])
    listed = found.filter(F.size("found") > 0).select("row.key", F.posexplode("found").alias("at", "one")).select("key", "at", "one.*")
    place = F.row_number().over(Window.partitionBy("label").orderBy("key", "at", "features"))
    return saved(listed.withColumn("place", place).filter(F.col("place") <= max(sample // 2, 1)).select("label", "features"))


def train(findings: DataFrame) -> list[list[tuple]]:
    """Fit the forest on ``(label, features)``; each tree as ``(feature, threshold, left, right, share)``."""
    counts = {r["label"]: r["n"] for r in findings.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0.0, 1.0}:
        return []
    from pyspark.ml.classification import RandomForestClassifier  # imports pandas, which tasks do without
    from pyspark.ml.functions import array_to_vector

    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="vector")
    model = forest.fit(findings.select("label", array_to_vector("features").alias("vector")))
    path = shared_folder(findings.sparkSession)
    model.write().save(path)
    return read_trees(findings.sparkSession, path)


def read_trees(spark: SparkSession, path: str) -> list[list[tuple]]:
    """The saved forest's nodes, by tree and in order of their ids."""
    trees: dict[int, dict[int, tuple]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        node = row["nodeData"]
        split, stats = node["split"], node["impurityStats"]
        threshold = split["leftCategoriesOrThreshold"][0] if node["leftChild"] >= 0 else 0.0
        trees.setdefault(row["treeID"], {})[node["id"]] = (
            split["featureIndex"], threshold, node["leftChild"], node["rightChild"], stats[1] / sum(stats))
    return [[nodes[i] for i in range(len(nodes))] for _, nodes in sorted(trees.items())]


def score(trees: list[list[tuple]], x: list[float]) -> float:
    """Mean share of secrets in the leaves that ``x`` falls into."""
    total = 0.0
    for nodes in trees:
        at = 0
        while nodes[at][2] >= 0:
            feature, threshold, left, right, _ = nodes[at]
            at = left if x[feature] <= threshold else right
        total += nodes[at][4]
    return total / len(trees)


def scan(
    docs: DataFrame, trees: list[list[tuple]], text_col: str = "text", path_col: str = "source",
    vocabulary: str = VOCABULARY, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(row, findings, masked)``: judged candidates, places in code points, and the text without secrets."""
    words = dictionary(vocabulary)

    def judge(text: bytes | None, path: str) -> tuple[list[dict], str | None]:
        if text is None:
            return [], None
        findings, parts, done, at, chars = [], [], 0, 0, 0
        for start, end, value, before, after in candidates(text):
            if end <= done:  # inside a secret
                continue
            sure = weak_label(value, before, after)
            odds = score(trees, features(value, before, after, path, words)) if trees else float(bool(sure))
            if ISSUED.search(value):
                odds = 1.0
            elif sure is False and stands_in(value, before):
                odds = 0.0
            chars += len(text[at:start].decode())
            at = start
            secret = odds >= threshold
            findings.append({"start": chars, "end": chars + len(value), "score": odds, "secret": secret,
                             "value_sha256": hashlib.sha256(value.encode()).hexdigest()})
            if secret:
                parts += [text[done:start].decode(), MASK] if start >= done else []
                done = end
        if not parts:
            return findings, None
        return findings, "".join([*parts, text[done:].decode()])

    def work():
        def each(texts: list, paths: list) -> tuple[list, list]:
            made = [judge(text, path or "") for text, path in zip(texts, paths, strict=True)]
            return [m[0] for m in made], [m[1] for m in made]

        return each

    fields = [("findings", f"array<{FINDING}>", pa.list_(FINDING_ARROW)), ("masked", "string", pa.string())]
    found = arrow_map(docs, text_col, work, fields, also=[path_col])  # texts without secrets do not travel twice
    return found.withColumn("masked", F.coalesce("masked", F.col("row")[text_col].cast("string")))


def secrets_only(findings: Column | str = "findings") -> Column:
    return F.filter(findings, lambda f: f["secret"])
