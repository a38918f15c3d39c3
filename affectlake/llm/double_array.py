"""Double-array tries over phrases of word keys, built and walked with numpy.

A word is its place in the sorted ``alphabet`` of 64-bit word keys, written as letters of
LETTER_BITS bits.  State 0 is the root.  The child of state ``s`` for letter ``c`` is slot
``base[s] + c`` if ``check`` of that slot is ``s``.  The first and the last slot are never
a child, so that places outside the array can be clipped to them.  ``accepts`` gives the
phrase's number at the states that end one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTER_BITS = 6
LETTERS = 1 << LETTER_BITS
WIDE = 12  # nodes with so many children get a window of LETTERS slots of their own
ROOM = 2.5  # slots per transition of smaller nodes
AT_ONCE = 1 << 16


@dataclass
class Trie:
    alphabet: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray
    words: int
    letters: int  # letters of a word

    @property
    def nbytes(self) -> int:
        return self.alphabet.nbytes + self.base.nbytes + self.check.nbytes + self.accepts.nbytes


def build(phrases: np.ndarray) -> Trie:
    """A trie of distinct phrases, a row of word keys (uint64) each, numbered by row."""
    count, words = phrases.shape
    alphabet, places = np.unique(phrases, return_inverse=True)
    places = places.reshape(phrases.shape)
    order = np.lexsort(places.T[::-1])
    letters = max(1, -(-int(max(len(alphabet) - 1, 1)).bit_length() // LETTER_BITS))
    spelled = np.concatenate([_letter(places[order, w, None], np.arange(letters), letters) for w in range(words)], axis=1)
    fresh = np.ones(spelled.shape, bool)  # whether a row has a new node at a level
    fresh[1:] = np.logical_or.accumulate(spelled[1:] != spelled[:-1], axis=1)
    base, check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
    state = np.zeros(count, np.int64)
    random = np.random.default_rng(count)
    for level in range(words * letters):
        rows = np.flatnonzero(fresh[:, level])
        base, check = _placed(state[rows], spelled[rows, level].astype(np.int64), base, check, random)
        state = base[state] + spelled[:, level]
    base, check = np.append(base, 0), np.append(check, -1)
    accepts = np.full(len(base), -1, np.int32)
    accepts[state] = order
    return Trie(alphabet, base.astype(np.int32), check.astype(np.int32), accepts, words, letters)


def _letter(places: np.ndarray, at: int | np.ndarray, letters: int) -> np.ndarray:
    return ((places >> (LETTER_BITS * (letters - 1 - at))) & (LETTERS - 1)).astype(np.uint8)


def _placed(parents, kids, base, check, random) -> tuple[np.ndarray, np.ndarray]:
    """The arrays with a base for every parent, whose rows stand together.

    Wide nodes get windows behind the array; smaller ones try random bases together, and
    of two that want a slot the first has it; single children fill whatever is free.
    """
    starts = np.flatnonzero(np.diff(parents, prepend=-1))
    sizes = np.diff(np.append(starts, len(parents)))
    wide, single = starts[sizes >= WIDE], starts[sizes == 1]
    middle = int(sizes[(sizes < WIDE) & (sizes > 1)].sum())
    window = len(base)
    region = window + LETTERS * len(wide)
    more = LETTERS * len(wide) + (int(ROOM * middle) + LETTERS if middle else 0)
    more += max(0, len(single) + len(parents) + 1 - int((check < 0).sum()) - more)
    base, check = np.append(base, np.zeros(more, np.int64)), np.append(check, np.full(more, -1, np.int64))

    base[parents[wide]] = window + LETTERS * np.arange(len(wide))
    own = np.repeat(sizes >= WIDE, sizes)
    check[base[parents[own]] + kids[own]] = parents[own]
    for size in range(WIDE - 1, 1, -1):
        left = starts[sizes == size]
        while len(left):
            now = left[:AT_ONCE]
            bases = random.integers(region, len(base) - LETTERS + 1, len(now))
            spots = bases[:, None] + kids[now[:, None] + np.arange(size)]
            good = (check[spots] < 0).all(axis=1)
            flat = spots[good].ravel()
            first = np.zeros(len(flat), bool)
            first[np.unique(flat, return_index=True)[1]] = True
            good[np.flatnonzero(good)[~first.reshape(-1, size).all(axis=1)]] = False
            base[parents[now[good]]] = bases[good]
            check[spots[good]] = parents[now[good]][:, None]
            left = np.concatenate([now[~good], left[len(now) :]])
    free = np.flatnonzero(check < 0)
    free = free[free > 0][: len(single)]
    base[parents[single]] = free - kids[single]
    check[free] = parents[single]
    return base, check


def walk(trie: Trie, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the phrases that begin at ``starts``: all positions advance level by level."""
    return trie.accepts[_ends(trie, hashes, starts)[0]]


def _ends(trie: Trie, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The accepting states that are reached, and the starts they are reached from."""
    place = np.searchsorted(trie.alphabet, hashes)
    place[place == len(trie.alphabet)] = 0
    known = trie.alphabet[place] == hashes
    state, at = np.zeros(len(starts), np.int64), starts
    for word in range(trie.words):
        live = known[at + word]
        state, at = state[live], at[live]
        for letter in range(trie.letters):
            slot = trie.base[state] + _letter(place[at + word], letter, trie.letters)
            np.clip(slot, 0, len(trie.base) - 1, out=slot)
            live = trie.check[slot] == state
            state, at = slot[live], at[live]
    return state, at


def tally(trie: Trie, counts: np.ndarray, hashes: np.ndarray, starts: np.ndarray, times: np.ndarray | None = None) -> None:
    """Add to ``counts`` how often each phrase begins at one of ``starts``.

    ``times`` says of every place in ``hashes`` how often a phrase was met that begins there.
    """
    state, at = _ends(trie, hashes, starts)
    if len(state):
        np.add.at(counts, trie.accepts[state], 1 if times is None else times[at])
