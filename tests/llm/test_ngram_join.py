"""The n-gram join against all pairs, with small trees so that every level is used."""

import random
import re

import numpy as np
import pytest

from affectlake.llm import ngram_join as J
from affectlake.llm import shingles as S

SCHEMA = "doc_id long, text string, n long"


def plain_set(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, percent=90):
    sets = [(r[0], plain_set(r[1])) for r in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return sorted((i, len(s), find(i)) for i, s in sets if i is not None)


def result(df):
    return sorted(tuple(r) for r in df.filter("doc_id is not null").collect())


def corpus(seed):
    """Bases with chains of ever more changed copies, of many lengths, and common lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    line = [word() for _ in range(40)]
    texts = []
    for _ in range(14):
        base = [word() for _ in range(r.choice([1, 2, 3, 8, 11, 12, 20, 60, 200, 700]))] + line * r.choice([0, 0, 1])
        now = list(base)
        for _ in range(r.choice([1, 4, 12])):
            texts.append(" ".join(now))
            now = list(r.choice([now, base]))
            for _ in range(r.choice([0, 1, 1, max(1, len(base) // 60), max(1, len(base) // 25)])):
                at = r.randrange(len(now))
                now[at : at + r.choice([0, 1])] = [word()] if r.random() < 0.7 else []
                now = now or [word()]
    r.shuffle(texts)
    return [(i, t, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,percent", [(1, 90), (2, 90), (3, 80)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, percent):
    monkeypatch.setattr(J, "LEAF", 2)
    monkeypatch.setattr(J, "FANOUT", 2)
    monkeypatch.setattr(J, "CHUNK", 2)
    rows = corpus(seed)
    assert result(J.components(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=percent)) == brute(
        rows, percent)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "one", 0), (5, "ONE", 0), (6, "one two", 0), (7, "é é é", 0),
            (8, "É É É", 0), (None, "one", 0), (9, "x y z w", 0), (9, "x y z w", 0), (10, "long " * 30_000, 0),
            (11, "long " * 20_000, 0), (12, "a" * 100_000, 0)]
    got = J.components(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(rows)
    assert result(got) == brute(rows)


def test_an_id_of_two_texts_ties_them(spark):
    rows = [(5, "a b c d", 0), (5, "q r s t", 0), (3, "a b c d", 0), (4, "q r s t", 0)]
    got = J.components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {3}


def test_empty_table(spark):
    assert J.components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = b"Some words \xc3\xa9 and more " * 50 + b"y" * 500
    whole = S.word_hashes(text)
    monkeypatch.setattr(S, "BLOCK", 64)
    assert (S.word_hashes(text) == whole).all()
    assert len(whole) == len(text.split())


@pytest.mark.parametrize("n", [5, 10, 13, 40, 300])
def test_linked_sets_share_a_signature(n):
    r = np.random.default_rng(n)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        lost = r.integers(0, J.allowed_difference(2 * n, 90) + 1)
        b = np.unique(np.concatenate([a[lost // 2 :], r.integers(0, 2**63, lost - lost // 2).astype(np.uint64)]))
        if J._linked(a, b, 90) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(J.signatures(a, 90), J.signatures(b, 90)))


def test_copies_in_groups_are_coarse_and_lose_no_link():
    r = np.random.default_rng(7)
    for n in (1, 40, 300, 5_000, 70_000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], r.integers(0, 2**63, n // 10).astype(np.uint64)]))
        for x, y in zip(J.both_bitmaps(a), J.both_bitmaps(b), strict=True):
            size = min(len(x), len(y))
            assert np.bitwise_count(J.folded(x, size) ^ J.folded(y, size)).sum() <= len(np.setxor1d(a, b))
        coarse, fine = J.both_bitmaps(a)
        assert 8 * len(coarse) <= max(64, 2 * n) and len(fine) <= J.FINE_BYTES


def test_pairs_apart_are_dropped_before_texts_travel(spark):
    words = [f"w{i}" for i in range(300)]
    texts = {1: words, 2: [*words[:-2], "x", "y"], 3: [f"v{i}" for i in range(300)], 4: words[:100]}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3)], "leader long, id long")
    left = J._fitting(pairs, J._bitmaps(rows, 3), 90)
    assert [tuple(r) for r in left.collect()] == [(1, 2)]


@pytest.mark.parametrize("n,percent", [(5, 80), (13, 90), (40, 80), (300, 80), (300, 90), (2_000, 90)])
def test_linked_sets_share_a_signature_that_neither_leaves_out(n, percent):
    r = np.random.default_rng(n)

    def kept(shingles):  # the common order is that of the numbers
        marks, places = J.placed_signatures(shingles, percent)
        parts = [(np.sort(marks[places == p]), p % J.BAND_STEP) for p in np.unique(places)]
        return np.concatenate([part[: max(0, len(part) - loose)] for part, loose in parts])

    linked = 0
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        lost = r.integers(0, J.allowed_difference(2 * n, percent) + 1)
        b = np.unique(np.concatenate([a[lost // 2 :], r.integers(0, 2**63, lost - lost // 2).astype(np.uint64)]))
        if J._linked(a, b, percent) and len(np.setxor1d(a, b)):
            linked += 1
            assert len(np.intersect1d(kept(a), kept(b)))
    assert linked or n == 5


def test_near_copies_that_are_not_linked_make_few_pairs(spark, monkeypatch):
    r = random.Random(5)
    base, rows, made = [f"w{i}" for i in range(300)], [], []
    for i in range(60):
        now = list(base)
        for at in r.sample(range(300), 5):
            now[at] = f"x{i}y{at}"
        rows.append((i, " ".join(now), 0))
    traversed = J._traversed

    def counted(members, *rest):
        pairs = traversed(members, *rest)
        made.append((members.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(J, "_traversed", counted)
    assert result(J.components(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    [(places, pairs)] = made
    assert pairs <= len(rows), (places, pairs)


def test_groups_of_one_leader_hold_a_set_once(spark):
    members = spark.createDataFrame(
        [(m, i, 1) for m, ids in ((10, (1, 2)), (11, (1, 2, 3)), (12, (1, 3)), (13, (1, 4))) for i in ids],
        "mark long, id long, leader long")
    grouped = spark.createDataFrame([(1, 1), (4, 1)], "node long, component long")
    assert sorted(tuple(r) for r in J._open_groups(members, grouped).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_small_sets_in_a_leaf_do_not_make_others_coarse():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 8)]
    other = np.unique(np.concatenate([sets[0][60:], r.integers(0, 2**63, 60).astype(np.uint64)]))
    leaf = [{"id": i, "component": i, "n": len(s), "bits": J.bitmap(s)} for i, s in enumerate([*sets, other, sets[0][2:]])]
    assert J._close_sets(leaf, leaf, 90) == ([0], [3])
