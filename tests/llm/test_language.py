"""Language ID: the forward sum against a plain one, held-out accuracy, odd inputs."""

import math
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectlake.llm import language as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def listed():
    return L.pieces()


def plain(word, p, index):
    marked = L.START + word
    sums = [1.0] + [0.0] * len(marked)
    for end in range(1, len(sums)):
        for start in range(end):
            k = index.get(marked[start:end], len(index) if end == start + 1 else None)
            if k is not None:
                sums[end] += sums[start] * p[k]
    return math.log(sums[-1])


def test_all_segmentations_are_summed(listed):
    index = {piece: i for i, piece in enumerate(listed)}
    p = np.random.default_rng(3).random((len(listed) + 1, 2)) / 500
    words = ["the", "segmentation", "übergröße", "日本語", "a", "x" * L.RUN]
    got = L.Lattice(words, L.Finder(listed)).log_totals(p)
    for k in (0, 1):
        assert got[:, k] == pytest.approx([plain(w, p[:, k], index) for w in words])


def test_long_runs_are_summed_whole(listed):
    index = {piece: i for i, piece in enumerate(listed)}
    p = np.random.default_rng(3).random((len(listed) + 1, 2)) / 500
    finder = L.Finder(listed)
    for word in ("segmentation" * 4, "überlänge" * 12, "日本語の文章" * 15, "x" * (L.RUN + 1)):
        got = L.long_log_total(word, finder, p)
        assert got == pytest.approx([plain(word, p[:, k], index) for k in (0, 1)])
    assert np.isfinite(L.long_log_total("the" * 30_000, finder, p)).all()


def test_letters_by_unicode_class():
    assert L.words_of("½ ² Ⅷ ① 12 _ ًٌ") == []
    assert L.words_of("हिन्दी Größe_x ǅ कि") == ["हिन्दी", "größe", "x", "ǆ", "कि"]
    assert L.words_of("a" * 500) == ["a" * 500]


def test_long_runs_in_texts(spark, listed):
    texts = ["thisisonelongrunofletterswithoutanyblankbetweenitswords" * 9, "the", "½²Ⅷ"]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts * 3, ["en", "en", "de"] * 3))], "doc_id long, text string, lang string")
    model = L.train(docs)
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(docs, model).collect()}
    assert got[0][0] == "en" and got[2] == (L.UNDETERMINED, 0.0)


def test_fitted_pieces_raise_the_likelihood(listed):
    finder, words, counts = L.Finder(listed), ["the", "then", "other", "thermal"], np.array([9.0, 3, 2, 1])
    totals = []
    for rounds in (1, 4):
        p = L.fit_pieces(words, counts, finder, rounds)
        assert p[:-1].sum() == pytest.approx(1, abs=1e-3)
        totals.append(float(counts @ L.Lattice(words, finder).log_totals(p[:, None])[:, 0]))
    assert totals[1] > totals[0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs.filter(~L.held_out()))
    told = L.predict(docs, model).select("row.lang", "lang_pred", "score", L.held_out("row.doc_id").alias("out"))
    right = told.filter("out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert told.filter("score < 0 or score > 1").count() == 0


def test_odd_texts_and_small_caches(spark, monkeypatch):
    monkeypatch.setattr(L, "CACHE_CELLS", 4)
    monkeypatch.setattr(L, "GROUP_BYTES", 10)
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (None, "the dog", None, "y"),
            (3, None, "en", "x"), (4, "", "fr", "x"), (5, "123 %%% ...", None, "x"), (6, "the " * 50_000, None, "x"),
            (6, "the " * 50_000, None, "x"), (7, "q" * 5_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").coalesce(1)
    told = L.predict(docs, L.train(docs)).select("row.doc_id", "lang_pred", "score").collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in told}
    assert len(told) == len(rows)
    assert got[1][0] == "en" and got[2][0] == "fr" and got[None][0] == "en" and got[6][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[7][0] in ("en", "fr")


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert L.train(docs) == {}
    assert [r.lang_pred for r in L.predict(docs, {}).collect()] == ["und"]
    assert L.predict(docs.limit(0), {}).collect() == []


def test_fit_holds_the_sums_of_few_words_only():
    alphabet = "abcdefghij"
    words = [f"{i:05d}".translate(str.maketrans("0123456789", alphabet)) * 12 for i in range(20_000)]
    counts = 1.0 + np.arange(len(words)) % 7
    finder = L.Finder([L.START, *alphabet, "ab", "bc", "cde"])
    whole = L.Lattice(words, finder)
    p = np.full((finder.size + 1, 1), 1.0 / (finder.size + 1))
    seen = np.bincount(whole.piece, weights=whole.shares(p, counts), minlength=finder.size + 1)
    tracemalloc.start()
    fitted = L.fit_pieces(words, counts, finder, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    edges = len(whole.piece) * 8
    assert fitted[:-1].tolist() == ((seen + L.SMOOTHING) / (seen.sum() + L.SMOOTHING * len(seen)))[:-1].tolist()
    assert peak < 8.5 * edges  # the sums of all words at once take over 9


def test_workers_of_the_pipeline_load_no_pandas():
    code = "import sys, corpus_pipeline; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], check=False).returncode == 0
