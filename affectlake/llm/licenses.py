"""Licence notices: a positional index of templates' rare words.

A template is the word sequence of a notice, with a key phrase it must hold.  Words are
weighed by their inverse document frequency over all documents, and indexed with their
positions in each template.  A file that has a template's key words looks up the RARE
highest-weighed of that template's words that it has: every occurrence votes for the
place where the template would start, and places with two votes of different words are
candidates.  A candidate counts if the key phrase
stands at its place, word by word; its score is the share of the template's words that
stand at theirs.

Beside it, base phrases are counted wherever their words stand consecutively.

Defined results: null or empty texts have no words, no labels and score 0; files that
repeat are judged each; an empty table gives no rows and needs no weights; ties in
rarity go to the smaller word; extra columns stay inside ``row``.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from affectlake.llm.common import WORD_TABLE, arrow_map

RARE = 4
VOTES = 2

# Base phrases and their labels, notices and their key phrases.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files", "granted free of charge to any person"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]


def document_frequencies(docs: DataFrame, words: set[str], text_col: str = "text") -> dict[str, int]:
    """In how many of all documents each of the template words occurs; one scan."""
    wanted = frozenset(w.encode() for w in words)

    def work():
        def seen(texts: list) -> tuple[list]:
            return ([[w.decode() for w in wanted.intersection((t or b"").translate(WORD_TABLE).split())]
                     for t in texts],)

        return seen

    found = arrow_map(docs.select(text_col), text_col, work, [("words", "array<string>", pa.list_(pa.string()))])
    rows = found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def build_index(templates: list[tuple[str, str, str]], idf: dict[str, float]) -> list[dict[bytes, list[int]]]:
    """Per template: word -> positions, words in order of falling weight."""
    index = []
    for _, text, _ in templates:
        words = text.split()
        ranked = sorted(set(words), key=lambda w: (-idf[w], w))
        index.append({w.encode(): [i for i, x in enumerate(words) if x == w] for w in ranked})
    return index


def scan(
    docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE,
    rare: int = RARE, votes: int = VOTES, text_col: str = "text",
) -> DataFrame:
    """``(row, n_words, base_starts, base_labels, matches, score)`` for every document.

    ``base_starts`` are the word places of all base phrases in order; ``matches`` are
    ``(label, first, score)`` of verified templates, first possibly below 0 if the notice
    is cut at the text's start.
    """
    vocabulary = {w for _, text, _ in templates for w in text.split()}
    total = docs.count()
    df = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}
    index = build_index(templates, idf)
    match = pa.struct([("label", pa.string()), ("first", pa.int64()), ("score", pa.float64())])
    fields = [
        ("n_words", "bigint", pa.int64()),
        ("base_starts", "array<bigint>", pa.list_(pa.int64())),
        ("base_labels", "array<string>", pa.list_(pa.string())),
        ("matches", "array<struct<label:string,first:bigint,score:double>>", pa.list_(match)),
        ("score", "double", pa.float64()),
    ]
    phrases = [(f" {' '.join(p.split())} ".encode(), label) for p, label in base.items()]
    shapes = []
    for label, text, key in templates:
        words, wanted = text.encode().split(), key.encode().split()
        at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        shapes.append((label, words, wanted, at))
    indexed = frozenset(w for postings in index for w in postings)

    def work():
        def match_templates(words: list[bytes]) -> list[dict]:
            present = indexed.intersection(words)
            if not present:
                return []
            looked_up = defaultdict(list)
            for number, (_, _, key, _) in enumerate(shapes):
                if present.issuperset(key):
                    for word in [w for w in index[number] if w in present][:rare]:
                        looked_up[word].append(number)
            if not looked_up:
                return []
            places = defaultdict(set)
            for place, word in enumerate(words):
                for number in looked_up.get(word, ()):
                    for position in index[number][word]:
                        places[number, place - position].add(word)
            found = []
            for (number, first), voters in places.items():
                label, shape, key, at = shapes[number]
                begin = first + at
                if len(voters) >= votes and begin >= 0 and words[begin : begin + len(key)] == key:
                    same = sum(0 <= first + i < len(words) and words[first + i] == w for i, w in enumerate(shape))
                    found.append({"label": label, "first": first, "score": same / len(shape)})
            return sorted(found, key=lambda m: (m["first"], m["label"], m["score"]))

        def judge(texts: list) -> tuple[list, ...]:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text in texts:
                words = (text or b"").translate(WORD_TABLE).split()
                line = b" " + b" ".join(words) + b" "
                starts, labels = [], set()
                for phrase, label in phrases:
                    at, before, blanks = line.find(phrase), 0, 0
                    while at >= 0:
                        blanks += line.count(b" ", before, at)
                        before = at
                        starts.append(blanks)
                        labels.add(label)
                        at = line.find(phrase, at + 1)
                found = match_templates(words)
                values = (len(words), sorted(starts), sorted(labels), found,
                          max([float(bool(starts)), *(m["score"] for m in found)]) if starts or found else 0.0)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            return out

        return judge

    return arrow_map(docs, text_col, work, fields)


def labels(scanned: DataFrame) -> DataFrame:
    """The scan with ``labels``: base and template labels, distinct and sorted."""
    all_labels = F.array_sort(F.array_union("base_labels", F.transform("matches", lambda m: m["label"])))
    return scanned.withColumn("labels", F.array_distinct(all_labels))
