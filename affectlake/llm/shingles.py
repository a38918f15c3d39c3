"""Word shingles of UTF-8 texts as sorted 64-bit hashes, with numpy over whole texts."""

from __future__ import annotations

import numpy as np

from affectlake.llm.common import SPACE_TABLE

BLOCK = 1 << 20
_RANDOM = np.random.default_rng(20_240_229)
_ODD = np.uint64(0x9E3779B97F4A7C1B)  # leaves 3 when divided by 4, so powers keep their distance
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(int(_ODD))
_INVERSE = _powers(pow(int(_ODD), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """One hash per white-space separated word, A-Z lower-cased; from prefix sums of byte codes."""
    data = (text or b"").translate(SPACE_TABLE)
    parts, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= BLOCK else data.rfind(b" ", at, at + BLOCK)
        if end <= at:  # a word longer than a block: hashed by itself
            end = data.find(b" ", at + BLOCK)
            end = len(data) if end < 0 else end
        parts.append(_block(data[at:end]))
        at = end + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _block(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], codes != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(codes) > BLOCK:
        return np.array([_long(data[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[codes] * _POWER[: len(codes)])])
    return mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64) * _PLACE[0])


def _long(word: bytes) -> int:
    """The same hash for a word of any length."""
    total, factor = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(word), BLOCK):
            codes = np.frombuffer(word[at : at + BLOCK], np.uint8)
            total += np.sum(_BYTE[codes] * _POWER[: len(codes)], dtype=np.uint64) * factor
            factor *= _POWER[BLOCK]
        return int(mixed(np.array([total + np.uint64(len(word)) * _PLACE[0]], np.uint64))[0])


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words; a shorter text is one shingle, no words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for i in range(width):
        total += words[i : i + count] * _PLACE[i % 48 + 1]
    return np.unique(mixed(total))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs: equal for equal sets."""
    both = [int(np.sum(mixed(shingles ^ salt), dtype=np.uint64)) + len(shingles) for salt in _PLACE[50:52]]
    return tuple((x + 2**63) % 2**64 - 2**63 for x in both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
