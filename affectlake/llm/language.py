"""Language ID by unigram pieces, summed over all segmentations.

The vocabulary is a public one and fixed; every language has its own probabilities of
its pieces.  A word (a run of letters, lower-cased, with the word-start sign) has the
probability of all its segmentations together, found by the forward algorithm.  Those
probabilities are fitted by expectation-maximisation (forward and backward) on the
words of at most SAMPLE_ROWS labelled texts per language, chosen by hash: that bound is
the only sample here, and one language's sample is one task.

Every text is scored whole.  A task keeps up to CACHE_CELLS scores of distinct words; a
word not kept is scored again.  The fitted table, at most one row per piece and
language, travels to the tasks.  Lattices are made of few words at a time, in the fit
too: Spark keeps Python workers for later tasks, and with them the most they ever held.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with
nothing to learn from every text is; equal scores go to the smaller name; labels that
are null are not learned; an empty table gives no rows; very long texts are scored whole,
a letter run of any length over all its segmentations.  Only the fit reads runs of over
RUN letters in parts of RUN, as so many words of its sample.  Letters are the code points
of the Unicode classes L, with those of the classes M that follow them.  Other columns
stay inside ``row``, so their names cannot clash.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window, functions as F

from affectlake.llm.common import VOCABULARY_DIR, arrow_map

VOCABULARY = f"{VOCABULARY_DIR}/piece_bpe_32k.model"
SAMPLE_ROWS = 400
ROUNDS = 4
SMOOTHING = 0.01
UNSEEN = 1e-7
RUN = 60
SCALE = 1e3
CACHE_CELLS = 1_600_000
LATTICE_CELLS = 4_000
GROUP_BYTES = 250_000
UNDETERMINED = "und"

START = "▁"


@functools.cache
def letters() -> re.Pattern:
    """Runs of letters (Unicode classes L) and of marks (M) behind the first of them."""

    def ranges(classes: str) -> str:
        codes = np.array([c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in classes])
        starts = np.flatnonzero(np.diff(codes, prepend=-2) > 1)
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(codes[starts], codes[np.append(starts[1:], len(codes)) - 1]))

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces, without its control and byte entries."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


def words_of(text: str) -> list[str]:
    return letters().findall(text.lower())


class Finder:
    """Finds all pieces in words at once."""

    def __init__(self, listed: list[str]) -> None:
        self.size = len(listed)
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(listed):
            self.automaton.add_word(piece, i * 256 + len(piece))
        if listed:
            self.automaton.make_automaton()

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """``(word, from, to, piece)`` of every piece in every word, by word and end.

        A character that is no piece itself is an edge of the piece number ``size``.
        """
        line = "".join(f"\n{START}{w}" for w in words)
        found = itertools.chain.from_iterable(self.automaton.iter(line)) if self.size else ()
        hits = np.fromiter(found, np.int64).reshape(-1, 2)
        last, length, piece = hits[:, 0], hits[:, 1] % 256, hits[:, 1] // 256
        begins = np.cumsum([0, *(len(w) + 2 for w in words)])[:-1]
        known = np.zeros(len(line), bool)
        known[last[length == 1]] = True
        known[begins] = True
        unknown = np.flatnonzero(~known)
        last = np.concatenate([last, unknown])
        length = np.concatenate([length, np.ones(len(unknown), np.int64)])
        piece = np.concatenate([piece, np.full(len(unknown), self.size)])
        order = np.argsort(last, kind="stable")
        last, length, piece = last[order], length[order], piece[order]
        word = np.searchsorted(begins, last, side="right") - 1
        end = last - begins[word]
        return word, end - length, end, piece


class Lattice:
    """All ways to cut words into pieces, as edges (word, from, to, piece)."""

    def __init__(self, words: list[str], finder: Finder) -> None:
        self.word, self.start, self.end, self.piece = finder.edges(words)
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Scaled sums ``[word, place, language]`` of all segmentations up to a place."""
        return self._sweep(p, self.end, self.start, range(1, int(self.lengths.max(initial=0)) + 1), None)

    def backward(self, p: np.ndarray) -> np.ndarray:
        """The same from a place to the word's end."""
        return self._sweep(p, self.start, self.end, range(int(self.lengths.max(initial=0)) - 1, -1, -1), self.lengths)

    def _sweep(self, p, at, other, places, origin):
        sums = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, p.shape[1]))
        sums[np.arange(len(self.lengths)), 0 if origin is None else origin] = 1.0
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(sums.shape[1] + 1))
        scale = SCALE ** (self.end - self.start)
        for place in places:
            own = order[bounds[place] : bounds[place + 1]]
            if not len(own):
                continue
            word = self.word[own]
            flow = sums[word, other[own]] * p[self.piece[own]] * scale[own, None]
            first = np.flatnonzero(np.diff(word, prepend=-1))  # edges of a word follow each other
            sums[word[first], place] += np.add.reduceat(flow, first, axis=0)
        return sums

    def shares(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each edge is expected, in one language, if the words occur ``counts`` times."""
        ahead, behind = self.forward(p)[..., 0], self.backward(p)[..., 0]
        total = np.maximum(ahead[np.arange(len(self.lengths)), self.lengths], 1e-300)
        scale = SCALE ** (self.end - self.start)
        return (
            ahead[self.word, self.start] * p[self.piece, 0] * scale * behind[self.word, self.end]
            / total[self.word] * counts[self.word]
        )

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        total = self.forward(p)[np.arange(len(self.lengths)), self.lengths]
        return np.log(np.maximum(total, 1e-300)) - (self.lengths * np.log(SCALE))[:, None]


def long_log_total(word: str, finder: Finder, p: np.ndarray) -> np.ndarray:
    """Log probability of one long word in each language, over all its segmentations.

    The forward sums of the places that the longest piece reaches back to are carried
    along and rescaled at every place, so memory does not grow with the word.
    """
    _, starts, ends, pieces_at = finder.edges([word])
    size = len(word) + 1
    bounds = np.searchsorted(ends, np.arange(size + 2))
    reach = int((ends - starts).max(initial=1))
    sums = np.zeros((reach + 1, p.shape[1]))  # the place's sums in row place % (reach + 1)
    sums[0] = 1.0
    logs = np.zeros(p.shape[1])
    for place in range(1, size + 1):
        own = slice(bounds[place], bounds[place + 1])
        now = (sums[starts[own] % (reach + 1)] * p[pieces_at[own]]).sum(axis=0)
        scale = np.maximum(now, 1e-300)
        logs += np.log(scale)
        sums /= scale
        sums[place % (reach + 1)] = 1.0
    return logs


def fit_pieces(words: list[str], counts: np.ndarray, finder: Finder, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language; the last entry is for unknown characters."""
    starts = range(0, len(words), LATTICE_CELLS)
    lattices = [Lattice(words[i : i + LATTICE_CELLS], finder) for i in starts]
    piece = np.concatenate([np.zeros(0, np.int64), *(lattice.piece for lattice in lattices)])
    p = np.full((finder.size + 1, 1), 1.0 / (finder.size + 1))
    for _ in range(rounds):
        shares = [lattice.shares(p, counts[i : i + LATTICE_CELLS]) for i, lattice in zip(starts, lattices, strict=True)]
        seen = np.bincount(piece, weights=np.concatenate([np.zeros(0), *shares]), minlength=finder.size + 1)
        p = ((seen + SMOOTHING) / (seen.sum() + SMOOTHING * len(seen)))[:, None]
    p[-1] = UNSEEN
    return p[:, 0]


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    vocabulary: str = VOCABULARY, sample_rows: int = SAMPLE_ROWS,
) -> dict[str, np.ndarray]:
    """Fit one language each on at most ``sample_rows`` of its labelled texts.

    Texts are thinned by hash first, so that ranking them moves few rows whatever a
    language's share of the table.
    """
    labelled = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("#lang"))).alias("key"),
    )
    shares = {r["lang"]: min(1.0, (1.5 * sample_rows + 50) / r["n"])
              for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return {}
    slot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(16**8)
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    sample = labelled.filter(slot < share).withColumn("rank", rank).filter(F.col("rank") <= sample_rows)
    listed = pieces(vocabulary)

    def fit(lang: tuple, rows: pa.Table) -> pa.Table:
        texts = (text.as_py() for text in rows.column("text"))
        parts = (w[i : i + RUN] for text in texts for w in words_of(text) for i in range(0, len(w), RUN))
        counts = Counter(parts)
        p = fit_pieces(list(counts), np.array(list(counts.values()), float), Finder(listed))
        return pa.table({"lang": pa.array([lang[0].as_py()], pa.string()), "p": pa.array([p.astype("<f8").tobytes()], pa.binary())})

    fitted = sample.select("lang", "text").groupBy("lang").applyInArrow(fit, "lang string, p binary")
    return {r["lang"]: np.frombuffer(r["p"], "<f8") for r in sorted(fitted.collect(), key=lambda r: r["lang"])}


def predict(
    docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``(row, lang_pred, score)``; the score is the language's share of the posterior."""
    names = list(model)
    listed = pieces(vocabulary)
    table = np.stack([model[n] for n in names], axis=1) if names else np.zeros((len(listed) + 1, 0))

    def work():
        finder = Finder(listed)
        room = max(1_000, CACHE_CELLS // max(1, len(names)))
        at_once = max(200, LATTICE_CELLS // max(1, len(names)))
        place: dict[str, int] = {}
        scores = np.zeros((room, len(names)))

        def learn(lists: list[list[str]]) -> None:
            nonlocal scores
            new = list({w: None for words in lists for w in words if w not in place})
            if len(place) + len(new) > room:
                place.clear()
                new = list({w: None for words in lists for w in words})
            if len(new) > len(scores):  # one text alone has more words than are kept
                scores = np.zeros((len(new), len(names)))
            base = len(place)
            for i in range(0, len(new), at_once):
                part = new[i : i + at_once]
                short = [j for j, w in enumerate(part) if len(w) <= RUN]
                if len(short) == len(part):
                    scores[base + i : base + i + len(part)] = Lattice(part, finder).log_totals(table)
                    continue
                scores[[base + i + j for j in short]] = Lattice([part[j] for j in short], finder).log_totals(table)
                for j in sorted(set(range(len(part))) - set(short)):
                    scores[base + i + j] = long_log_total(part[j], finder, table)
            place.update(zip(new, range(base, base + len(new)), strict=True))

        def verdict(words: list[str]) -> tuple[str, float]:
            if not words or not names:
                return UNDETERMINED, 0.0
            total = scores[[place[w] for w in words]].sum(axis=0)
            odds = np.exp(total - total.max())
            k = int(np.argmax(odds))
            return names[k], float(odds[k] / odds.sum())

        def judge(texts: list) -> tuple[list, list]:
            made = []
            for group in _groups(texts):
                lists = [words_of(t.decode()) if t else [] for t in group]
                learn(lists)
                made += [verdict(words) for words in lists]
            return [m[0] for m in made], [m[1] for m in made]

        return judge

    return arrow_map(docs, text_col, work, [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())])


def _groups(texts: list) -> Iterator[list]:
    """Runs of whole texts of about GROUP_BYTES."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or b"")
        if size > GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose crc32(id as text) mod 4 is 2; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
