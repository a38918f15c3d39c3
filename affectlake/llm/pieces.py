"""Words of UTF-8 texts in pieces, as 64-bit hashes made with numpy over whole batches.

A piece is what stands between two breaks; a phrase lies within one piece.  A batch of
texts is read in blocks of about BLOCK bytes that end at separators, so memory is bounded
by the batch, and a text of any length costs no more at a time than a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash

from affectlake.llm.shingles import mixed

BLOCK = 1 << 18
_SEEDED = np.random.default_rng(977)
_CODE = _SEEDED.integers(0, 2**64, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C1B | 3
_STEP = _SEEDED.integers(0, 2**64, 16, np.uint64) | np.uint64(1)


def _series(factor: int) -> np.ndarray:
    out = np.full(BLOCK + 1, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _series(_FACTOR), _series(pow(_FACTOR, -1, 2**64))


def byte_table(blanks: bytes, breaks: bytes) -> bytes:
    """A-Z lower-cased, every blank as a space and every break as a line feed."""
    return bytes(10 if b in breaks else 32 if b in blanks else b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass
class Words:
    """Words of one block: ``carried`` of them were counted with the block before."""

    hashes: np.ndarray
    pieces: np.ndarray
    owners: np.ndarray
    carried: int
    data: bytes
    starts: np.ndarray
    ends: np.ndarray

    def word(self, at: int) -> bytes:
        """The word at a place behind the carried ones."""
        return self.data[self.starts[at - self.carried] : self.ends[at - self.carried]]


def words_of(texts: Sequence[bytes | None], table: bytes, salts: np.ndarray, reach: int) -> Iterator[Words]:
    """Blocks of words; ``salts`` has a 64-bit number per text that goes into its hashes.

    The last ``reach`` words of a block stand again before the next one's, so that every
    phrase of up to ``reach + 1`` words lies whole in some block and ends in it once.
    """
    lowered = [(t or b"").translate(table) for t in texts]
    ends_of = np.cumsum([len(t) + 1 for t in lowered]) if lowered else np.zeros(0, np.int64)
    data = b"\n".join(lowered)
    del lowered
    at, breaks = 0, 0
    kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:
            end = max(data.rfind(b" ", at, at + BLOCK), data.rfind(b"\n", at, at + BLOCK)) + 1
            if end <= at:  # one word fills the block
                places = [p for p in (data.find(b" ", at), data.find(b"\n", at)) if p >= 0]
                end = min(places) + 1 if places else len(data)
        block = data[at:end]
        codes = np.frombuffer(block, np.uint8)
        inside = np.concatenate([[False], (codes != 32) & (codes != 10), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        breaks_at = np.flatnonzero(codes == 10)
        owners = np.searchsorted(ends_of, starts + at, side="right")
        hashes = mixed(_hashes(block, codes, starts, stops) ^ salts[owners])
        pieces = np.searchsorted(breaks_at, starts) + breaks
        carried = len(kept[0])
        joined = [np.concatenate([a, b]) for a, b in zip(kept, (hashes, pieces, owners), strict=True)]
        yield Words(*joined, carried, block, starts, stops)
        kept = tuple(x[max(len(x) - reach, 0) :] for x in joined)
        breaks += len(breaks_at)
        at = end


def _hashes(block: bytes, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    lengths = stops - starts
    if len(codes) <= BLOCK:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[codes] * _UP[: len(codes)])])
        out = mixed((sums[stops] - sums[starts]) * _DOWN[starts] + lengths.astype(np.uint64) * _STEP[0])
    else:
        out = np.zeros(len(starts), np.uint64)
    for i in np.flatnonzero(lengths >= BLOCK - 1):  # such a word always stands alone in its block
        out[i] = xxhash.xxh3_64_intdigest(block[starts[i] : stops[i]])
    return out


def phrase_keys(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit key for the ``size`` words from each start; one word keeps its hash."""
    if size == 1:
        return hashes[starts]
    total = np.full(len(starts), size, np.uint64)
    for i in range(size):
        total += hashes[starts + i] * _STEP[i + 1]
    return mixed(total)


def phrase_starts(words: Words, size: int) -> np.ndarray:
    """Starts of all phrases of ``size`` words inside a piece that end behind the carried words."""
    first = max(words.carried - size + 1, 0)
    starts = np.arange(first, max(len(words.hashes) - size + 1, first))
    return starts[words.pieces[starts] == words.pieces[starts + size - 1]] if size > 1 else starts
