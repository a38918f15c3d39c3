"""Passages against a plain search, in one block of windows and in many."""

import re

import pytest

from affectlake.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for _, text, _ in docs:
        w, hit, ids = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            if item is None or not p:
                continue
            n = min(10, len(p))
            windows = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


SENTENCE = "The quick brown fox, jumps over the lazy dog while 12 Übergrößen schlafen -- and more words follow here"
ITEMS = [(1, SENTENCE), (2, "short Item"), (3, None), (4, "..."), (5, SENTENCE + " extra"), (None, "nothing at all"),
         (10, "a a a a a a a a a a a")]
DOCS = [
    (0, "Before it. THE QUICK brown   fox jumps over the lazy dog WHILE 12 Übergrößen schlafen. After.", "x"),
    (1, None, "x"), (2, "", "x"), (3, "a short item and a short\nitem", "x"), (3, "a short item and a short\nitem", "x"),
    (4, "a " * 40, "x"), (5, "quick brown fox jumps over the lazy dog while 12", "x"), (6, SENTENCE * 3, "x"),
    (7, "日本語 short item 日本語", None), (8, "shortitem", "x"),
]


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 300])
def test_hits_are_those_of_a_plain_search(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, spans string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.find_passages(docs, items, block_bytes=block).select(
        "row.doc_id", "row.text", "n_words", "spans", "items", D.hit_words("spans").alias("n_hit")).collect()
    found.sort(key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in found] == brute(DOCS, ITEMS)
    for r in found:
        for span in r.spans:
            assert words(r.text[span.start : span.end]) == words(r.text)[span.first : span.last]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, spans string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.spans for r in D.find_passages(docs, nothing).collect())
    assert D.find_passages(docs.limit(0), nothing).collect() == []
