"""Licence notices: base phrases against a plain search, templates on cut and changed notices."""

import re

from affectlake.llm import licenses as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "This work is licensed under the GNU General Public License, version 3."
TEXTS = [
    "x Released under the MIT License. y", "Licensed under the Apache License, Version 2.0!", "CC BY-NC CC-BY-NC 4.0",
    NOTICE, "Something is licensed under the GNU General Public License, version 3 or later",
    "GNU General Public License version 2", None, "", "license general work this the", "undertheMITlicense",
    "cc by nc cc by nc", "word " * 50_000 + NOTICE,
]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as labels", "0 as score")
    return {r.doc_id: r for r in C.labels(C.scan(docs)).selectExpr(
        "row.doc_id", "n_words", "base_starts", "base_labels", "labels", "score", "matches").collect()}


def test_base_phrases_and_templates(spark):
    got = scanned(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        w, starts, names = words(text), [], set()
        for phrase, label in C.BASE.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += here
            names |= {label} if here else set()
        assert got[i].n_words == len(w)
        assert list(got[i].base_starts) == sorted(starts)
        assert list(got[i].base_labels) == sorted(names)
        assert names <= set(got[i].labels)
    assert list(got[3].labels) == ["gpl-3"] and got[3].score == 1.0
    assert list(got[4].labels) == ["gpl-3"] and 0.5 < got[4].score < 1
    assert list(got[5].labels) == ["gpl-2"]
    assert list(got[8].labels) == [] and got[8].score == 0
    assert [m.first for m in got[11].matches] == [50_000]


def test_empty_table(spark):
    assert scanned(spark, []) == {}
