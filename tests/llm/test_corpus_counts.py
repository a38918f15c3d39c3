"""Collocations, repeated lines and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectlake.llm import collocations, corpus_queries, double_array, lines, perfect_hash, pieces, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key string, n long, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 7, "r") for i, t, lang in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------- collocations

def brute_phrases(rows, max_words=3, least=10, percent=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for s in range(len(words) - k + 1):
                    f[lang, tuple(words[s : s + k])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    outer = Counter()
    for (lang, ws), a in candidates.items():
        for k in range(2, len(ws)):
            for s in range(len(ws) - k + 1):
                outer[lang, ws[s : s + k]] = max(outer[lang, ws[s : s + k]], a)
    out = []
    for (lang, ws), a in candidates.items():
        if 100 * outer[lang, ws] >= percent * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    return sorted(out, key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))


def got_phrases(docs, **how):
    found = collocations.ranked(collocations.collocations(docs, **how), 10**6).orderBy("lang", "rank")
    return [(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()]


def test_collocations_as_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "New", "York", "city", "a\x00b", "é", "日本", "x" * 50, "und"]
    rows = []
    for i in range(40):
        words = r.choices(vocabulary, weights=[9, 7, 3, 3, 3, 1, 1, 1, 1, 2], k=r.randint(0, 60))
        text = "".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for w in words)
        rows.append((i, text, r.choice(["en", "en", "de", None, "und"])))
    rows += [(None, None, "en"), (3, "", None), (3, " \t.,", "en"), (3, rows[0][1], "en"), (3, rows[0][1], "en")]
    docs = docs_of(spark, rows)
    assert got_phrases(docs) == brute_phrases(rows)
    # Several tries, several groups of tries, longer phrases, another threshold.
    assert got_phrases(docs, max_words=4, min_count=3, block=7) == brute_phrases(rows, 4, 3)
    assert got_phrases(docs, min_count=3, contained_percent=90) == brute_phrases(rows, 3, 3, 90)
    assert got_phrases(docs.limit(0)) == []
    assert got_phrases(docs.filter("text = ''")) == []


@pytest.mark.parametrize("block", [1, 10**6])
def test_texts_are_read_as_often_for_many_tries_as_for_one(spark, monkeypatch, block):
    """Before, every block of frequent phrases was one more scan of all texts."""
    rows = [(i, f"w{i % 9} x{i % 9} y{i % 9} z{i % 9}. common pair", "en") for i in range(120)]
    scans, scan = [], collocations._scan
    monkeypatch.setattr(collocations, "_scan", lambda *a: scans.append(1) or scan(*a))
    assert got_phrases(docs_of(spark, rows), block=block) == brute_phrases(rows)
    assert len(scans) == 5  # words, then a sketch and a list for two words and for three


def test_sketch_tells_rare_phrases_apart_in_large_inputs(spark):
    """Before, 2**25 counters held all positions, so in large inputs nearly all reached the threshold."""
    text = " ".join(f"w{i % 7_001}" for i in range(40_000))
    texts = docs_of(spark, [(i, text, "en") for i in range(2)]).select("lang", "text")

    def promising(words):  # 10 positions of a counter of before each, in other counters now
        starts = pieces.phrase_starts(words, 2)
        keys = (np.arange(len(starts), dtype=np.uint64) // np.uint64(10) << np.uint64(39)) + (
            np.arange(len(starts), dtype=np.uint64) % np.uint64(10) << np.uint64(32))
        return starts, keys

    rare = collocations._sketch(texts, 0, 2, 10, promising)
    assert not rare.any()
    often = collocations._sketch(texts, 0, 2, 2, promising)  # each of them twice
    keys = promising(next(pieces.words_of([text.encode()], collocations.TABLE, np.zeros(1, np.uint64), 1)))[1]
    assert collocations._marked_high(often, keys).all()


def test_sketch_packs():
    places = np.array([3, 4, 70_000, (1 << 23) - 1], np.uint32)
    for shift in (0, 511 << 23):
        got = collocations._unpacked(collocations._packed(places + np.uint32(shift), np.array([1, 255, 9, 10], np.uint8)))
        assert got[0].tolist() == places.tolist() and got[1].tolist() == [1, 255, 9, 10]


def test_tries_add_up_what_lists_have_met():
    rows = np.array([[1, 2, 9, 4], [5, 6, 8, 3], [1, 2, 9, 7], [1, 6, 7, 9], [5, 6, 8, 8]], np.uint64)
    found = collocations._candidates(rows, 10)
    assert sorted(map(tuple, found.tolist())) == [(1, 2, 9), (5, 6, 8)]
    for block in (1, 2, 5):
        assert sorted(collocations._tallied(rows, found, 2, block)[:, -1].tolist()) == [11, 11]


def test_collocations_of_long_texts(spark):
    text = ("a b c " * 400_000) + "w" * (pieces.BLOCK + 5) + " a b " + "w" * (pieces.BLOCK + 5)
    rows = [(1, text, "en")]
    assert got_phrases(docs_of(spark, rows)) == brute_phrases(rows)


def test_words_of_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 40)
    monkeypatch.setattr(pieces, "_UP", pieces._series(pieces._FACTOR))
    monkeypatch.setattr(pieces, "_DOWN", pieces._series(pow(pieces._FACTOR, -1, 2**64)))
    r = random.Random(1)
    texts = ["".join(r.choice("ab  .\n") * r.randint(1, 3) for _ in range(r.randint(0, 300))) + "z" * r.choice([0, 39, 40, 41, 90]) for _ in range(20)]
    salts = np.zeros(len(texts), np.uint64)
    for size in (1, 2, 3):
        got, names = Counter(), {}
        for block in pieces.words_of([t.encode() for t in texts], collocations.TABLE, salts, 2):
            for i in range(block.carried, len(block.hashes)):
                names.setdefault(int(block.hashes[i]), set()).add(block.word(i).decode())
            for s in pieces.phrase_starts(block, size).tolist():
                got[tuple(int(h) for h in block.hashes[s : s + size])] += 1
        assert all(len(v) == 1 for v in names.values())
        spelled = Counter({tuple(next(iter(names[h])) for h in k): n for k, n in got.items()})
        want = Counter()
        for t in texts:
            for piece in re.split(r"[.\n]", t):
                words = piece.split()
                want.update(tuple(words[s : s + size]) for s in range(len(words) - size + 1))
        assert spelled == want


@pytest.mark.parametrize("words,count,size", [(1, 1, 2), (3, 9, 2), (70, 2_000, 2), (5_000, 9_000, 3), (300, 20_000, 2)])
def test_double_array_holds_just_its_phrases(words, count, size):
    r = np.random.default_rng(words)
    keys = np.unique(r.integers(0, 2**64, words, np.uint64))
    phrases = np.unique(keys[np.minimum((r.pareto(0.7, (count, size)) * 2).astype(int), len(keys) - 1)], axis=0)
    r.shuffle(phrases)
    trie = double_array.build(phrases)
    text = np.concatenate([phrases[r.permutation(len(phrases))].ravel(), r.integers(0, 2**64, 50, np.uint64), keys])
    counts = np.zeros(len(phrases), np.int64)
    double_array.tally(trie, counts, text, np.arange(len(text) - size + 1))
    want = Counter(tuple(text[i : i + size].tolist()) for i in range(len(text) - size + 1))
    assert counts.tolist() == [want[tuple(p)] for p in phrases.tolist()]


# ------------------------------------------------------------------ repeated lines

def brute_lines(rows, least_chars=20, least_docs=3):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-(10**9) if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == doc_id]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(own), len(own) - len(kept), digest))
    return sorted(out, key=str)


def got_lines(docs, **how):
    found = lines.drop_repeated(docs, **how).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("sha"), "row.key")
    rows = found.collect()
    assert all(r.key == "k" for r in rows)
    return sorted([tuple(r)[:4] for r in rows], key=str)


def test_repeated_lines_as_brute_force(spark):
    r = random.Random(9)
    pool = [f"A line of words Number {i} é" for i in range(30)] + ["short", "", "ÄÖÜ " * 5, "日" * 19, "日" * 20, " \t" * 30]
    rows = [(r.choice([*range(60), None]), "\n".join(
        r.choice(["", " ", "\t\r"]) + r.choice([str, str.upper, str.title])(x) + r.choice(["", "\x0c "])
        for x in r.choices(pool, k=r.randint(0, 12)))) for _ in range(80)]
    rows += [(7, None), (None, None), (8, ""), (9, "\n\n"), (10, rows[3][1]), (10, rows[3][1]), (11, (pool[0] + "\n") * 50_000)]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    assert got_lines(docs) == brute_lines(rows)
    assert got_lines(docs, least_chars=1, least_docs=2, keys_per_shard=3) == brute_lines(rows, 1, 2)
    assert got_lines(docs.limit(0)) == []


def test_repeated_lines_without_hot_ones(spark):
    """Many keys, so that none is hot and all go through the shards."""
    rows = [(i, "\n".join(f"this line is number {(i * 7 + j * 13) % 1_500} of many" for j in range(20))) for i in range(300)]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    assert got_lines(docs, keys_per_shard=100) == brute_lines(rows)


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(3)
    for size in (0, 1, 2, 1_000, 70_000):
        low, high = r.integers(0, 2**64, (2, size), np.uint64)
        low[: size // 3] = 5  # halves may repeat
        table = perfect_hash.build(low, high)
        assert sorted(perfect_hash.number(table, low, high)) == list(range(size))
        other = perfect_hash.number(table, low + np.uint64(1), high)
        assert size == 0 or ((other >= -1) & (other < size)).all()
    with pytest.raises(ValueError):
        perfect_hash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


# ---------------------------------------------------------------- spelling variants

def brute_spelling(rows, least_chars=6, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_chars and k >= least}
    near = defaultdict(set)
    alphabet = sorted({c for w in n for c in w})
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for c in alphabet for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w)}
        near[w] = {v for v in edits if v in n and v != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def got_spelling(docs):
    found = spelling.group(spelling.vocabulary(docs))
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect())


def test_spelling_as_brute_force(spark):
    r = random.Random(6)
    words = ["banana", "bananna", "baanana", "ananas", "Àpricot", "apricot", "aapricot", "apricots", "àpricot", "÷×apric", "aaaaaa", "aaaaaaa", "aaaaab"]
    text = []
    for i, w in enumerate(words):
        text += [w.upper() if i % 3 else w] * r.choice([5, 6, 30, 40, 200, 1_200])
    for w in ("apricot", "banana"):  # chains and ties
        text += [w] * 3_000 + [w[:3] + "x" + w[4:]] * 400 + [w[:3] + "x" + w[4:5] + "y" + w[6:]] * 20 + [w[:3] + "z" + w[4:]] * 400
    r.shuffle(text)
    rows = [(i, r.choice([" ", "-", "_3"]).join(text[i::50])) for i in range(50)]
    rows += [(None, None), (1, ""), (2, "123"), (2, rows[0][1]), (2, rows[0][1])]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    want = brute_spelling([("" if i is None else i, t) for i, t in rows])
    assert got_spelling(docs) == want
    assert any(form and root != form for _, form, root, *_ in want)
    assert got_spelling(docs.limit(0)) == []


def test_spelling_query_on_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = corpus_queries.spelling_query(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == brute_spelling(rows)


def test_spelling_of_a_long_word(spark):
    word = "qwertz" * 300
    rows = [(0, f"{word} {word[:700] + word[701:]} " * 6)]
    assert got_spelling(docs_of(spark, [(i, t, "en") for i, t in rows])) == brute_spelling(rows)
