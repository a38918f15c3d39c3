"""Mixing against a plain water filling and a plain walk over the key order."""

import hashlib
import re

import pytest

from affectlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def brute(rows):
    docs = []
    for doc_id, text, source, _ in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        key = hashlib.md5(f"mix|{'' if doc_id is None else doc_id}|{text or ''}".encode()).hexdigest()
        docs.append((source, key, doc_id, size))
    names = sorted({d[0] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(d[3] for d in docs if d[0] == s) for s in names}
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        held = {s for s in free if left * weights[s] / total > 3 * sizes[s]}
        if not held:
            target |= {s: left * weights[s] / total for s in free}
            break
        for s in held:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in held)
        free -= held
    out = []
    for s in names:
        budget = int(target[s] + 0.5)
        whole, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for d in sorted((d for d in docs if d[0] == s), key=lambda d: (d[1], d[2] is not None, d[2] or 0, d[3])):
            part = max(0, min(d[3], rest))
            rest -= d[3]
            out.append((d[2], d[3], sizes[s], round(target[s], 6), whole * d[3] + part))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


ROWS = (
    [(i, " ".join(["w"] * (i % 13)), f"s{i % 4}", "x") for i in range(400)]
    + [(1000, "one two", None, "x"), (1001, None, None, "x"), (1002, "", "zero", "x"), (None, "a b c", "s1", "x")]
    + [(7, "same words here", "s2", "x")] * 9
)


@pytest.mark.parametrize("per_range", [1, 7, 10_000])
def test_mix_is_the_plain_walk(spark, monkeypatch, per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", per_range)
    assert result(mixing.mix(spark.createDataFrame(ROWS, SCHEMA).repartition(5))) == brute(ROWS)


def test_small_sources_are_held_at_three_epochs(spark):
    rows = [(i, "a b c d", "big", "") for i in range(300)] + [(900, "a b", "tiny", ""), (901, "a", "little", "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.source: r.target for r in got}["tiny"] == 6.0
    assert all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(r.size for r in got)
    assert result(mixing.mix(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_without_words(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, "a", ""), (2, " \n", None, "")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
