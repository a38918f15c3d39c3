"""Minimal perfect hashes over 128-bit keys, with numpy.

Keys are tried level by level: at each level those that fall alone on a bit keep it, and
the others go on to a smaller level.  A key's number is the count of set bits before its
own.  Keys outside the set get a number of some other key or none, so the caller keeps a
fingerprint per number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from affectlake.llm.shingles import mixed

SPACE = 2  # bits per key at each level
LEVELS = 64


@dataclass
class PerfectHash:
    sizes: list[int]  # bits of each level, a multiple of 64
    bits: np.ndarray
    before: np.ndarray  # set bits before each word


def _place(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    salted = mixed(low ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) + high
    return (mixed(salted) % np.uint64(size)).astype(np.int64)


def build(low: np.ndarray, high: np.ndarray) -> PerfectHash:
    """For distinct keys, given as two columns of uint64."""
    sizes, parts = [], []
    while len(low):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-len(low) * SPACE // 64) * 64
        place = _place(low, high, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = ~alone[place]
        low, high = low[left], high[left]
    bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))[:-1]]) if len(bits) else np.zeros(0, np.int64)
    return PerfectHash(sizes, bits, before)


def number(table: PerfectHash, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Each key's number, -1 for keys that meet no bit."""
    out = np.full(len(low), -1, np.int64)
    open_, offset = np.arange(len(low)), 0
    for level, size in enumerate(table.sizes):
        place = _place(low[open_], high[open_], level, size) + offset
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        found = (table.bits[word] >> bit) & np.uint64(1) == 1
        below = table.bits[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
        out[open_[found]] = table.before[word[found]] + np.bitwise_count(below)
        open_, offset = open_[~found], offset + size
    return out
