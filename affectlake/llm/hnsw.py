"""Hierarchical navigable small-world graph over the unit vectors of one shard, in numpy.

Nodes are taken in the order of a hash.  Each is linked, on every level up to its own, to
diverse near neighbours among the nodes before it, and they to it, so that early nodes
carry the long links.  Searches run for many queries in step, on single precision; what
they find is checked in double precision.
"""

from __future__ import annotations

import numpy as np

LINKS = 12
CANDIDATES = 48
AT_ONCE = 512
CELLS = 1 << 22
EXPANDED = 4
SLACK = 1e-4


def levels_of(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the id, so that reruns build the same graph."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2.0**53
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(int)


class Graph:
    """Levels from the lowest up: the nodes of each, and their neighbours (padded with -1)."""

    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]) -> None:
        self.vectors, self.nodes, self.links = vectors, nodes, links
        self.short = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray) -> Graph:
        level = levels_of(ids)
        nodes, links = [], []
        for at in range(int(level.max(initial=0)) + 1):
            own = np.flatnonzero(level >= at)
            nodes.append(own)
            local = _linked(vectors[own].astype(np.float32), 2 * LINKS if at == 0 else LINKS)
            links.append(np.where(local >= 0, own[np.maximum(local, 0)], -1))
        return cls(vectors, nodes, links)

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) found with a product of at least ``least``.

        A beam filled with such nodes may hide more: those queries go on with the whole
        shard, whose products cost less than the search with a wider beam.
        """
        found_q, found_n = [], []
        step = _at_once(len(self.vectors))
        for start in range(0, len(queries), step):
            open_ = np.arange(start, min(start + step, len(queries)))
            width = min(beam, len(self.vectors))
            while len(open_):
                ids, sims = self._search(queries[open_], width)
                good = (sims >= least - SLACK) & (ids >= 0)
                full = good.all(axis=1) & (width < len(self.vectors))
                q, c = np.nonzero(good & ~full[:, None])
                q, node = open_[q], ids[q, c]
                exact = np.einsum("ed,ed->e", queries[q], self.vectors[node]) >= least
                found_q.append(q[exact])
                found_n.append(node[exact])
                open_, width = open_[full], len(self.vectors)
        return np.concatenate(found_q or [np.zeros(0, int)]), np.concatenate(found_n or [np.zeros(0, int)])

    def _search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width >= len(self.vectors):
            sims = queries @ self.vectors.T
            return np.broadcast_to(np.arange(len(self.vectors)), sims.shape), sims
        at = np.full(len(queries), self.nodes[-1][0])
        for level in range(len(self.nodes) - 1, 0, -1):
            at = self._descend(queries, at, level)
        return self._beam(queries, at, width)

    def _descend(self, queries: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        place = np.full(len(self.vectors), -1)
        place[self.nodes[level]] = np.arange(len(self.nodes[level]))
        best = np.einsum("qd,qd->q", queries, self.vectors[at])
        moving = np.arange(len(queries))
        while len(moving):
            near = self.links[level][place[at[moving]]]
            sims = np.einsum("qd,qnd->qn", queries[moving], self.vectors[near])
            sims[near < 0] = -2
            top = sims.argmax(axis=1)
            value = sims[np.arange(len(moving)), top]
            better = value > best[moving]
            moving = moving[better]
            at[moving], best[moving] = near[better, top[better]], value[better]
        return at

    def _beam(self, queries: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        count, rows = len(queries), np.arange(len(queries))
        ids = np.full((count, width), -1, np.int32)
        sims = np.full((count, width), -3.0, np.float32)
        done = np.ones((count, width), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, np.einsum("qd,qd->q", queries, self.vectors[at]), False
        seen = np.zeros(count * len(self.vectors), bool)
        seen[rows * len(self.vectors) + at] = True
        writer = np.empty(count * len(self.vectors), np.int32)
        short_queries = queries.astype(np.float32)
        active = rows
        while len(active):
            own_ids, own_sims, own_done = ids[active], sims[active], done[active]
            rank = np.where(own_done, np.float32(-4.0), own_sims)
            pick = np.argpartition(-rank, min(EXPANDED, width) - 1, axis=1)[:, :EXPANDED]
            line = np.arange(len(active))[:, None]
            chosen = ~own_done[line, pick]
            own_done[line, pick] = True
            near = np.where(chosen[..., None], self.links[0][np.maximum(own_ids[line, pick], 0)], -1)
            near = near.reshape(len(active), -1)
            q, c = np.nonzero(near >= 0)
            node = near[q, c]
            cell = active[q] * len(self.vectors) + node
            turn = np.arange(len(cell), dtype=np.int32)
            writer[cell] = turn  # of a node met twice in this step one entry is kept
            fresh = (writer[cell] == turn) & ~seen[cell]
            q, node, cell = q[fresh], node[fresh], cell[fresh]
            seen[cell] = True
            value = np.einsum("ed,ed->e", short_queries[active[q]], self.short[node])
            slot = np.arange(len(q)) - np.searchsorted(q, q)
            extra = int(slot.max(initial=-1)) + 1
            new_ids = np.full((len(active), extra), -1, np.int32)
            new_sims = np.full((len(active), extra), -3.0, np.float32)
            new_ids[q, slot], new_sims[q, slot] = node, value
            all_ids = np.concatenate([own_ids, new_ids], axis=1)
            all_sims = np.concatenate([own_sims, new_sims], axis=1)
            all_done = np.concatenate([own_done, new_ids < 0], axis=1)
            if extra:
                top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
                all_ids, all_sims, all_done = all_ids[line, top], all_sims[line, top], all_done[line, top]
            ids[active], sims[active], done[active] = all_ids, all_sims, all_done
            active = active[~all_done.all(axis=1)]
        return ids, sims


def _at_once(nodes: int) -> int:
    """Rows whose products with all nodes a task holds: fewer, the larger the shard."""
    return max(16, min(AT_ONCE, CELLS // max(nodes, 1)))


def _linked(vectors: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of every node, by place: diverse ones among earlier nodes, and back."""
    n = len(vectors)
    near, step = np.full((n, LINKS), -1), _at_once(n)
    for start in range(0, n, step):
        stop = min(start + step, n)
        sims = vectors[start:stop] @ vectors[:stop].T
        sims[np.arange(stop)[None, :] >= np.arange(start, stop)[:, None]] = -2
        k = min(CANDIDATES, stop)
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        top[sims[np.arange(stop - start)[:, None], top] <= -2] = -1
        near[start:stop] = _diverse(vectors, np.arange(start, stop), top, LINKS)
    i, c = np.nonzero(near >= 0)
    ends = np.append(i, near[i, c]), np.append(near[i, c], i)
    order = np.argsort(ends[0], kind="stable")
    other, counts = ends[1][order], np.bincount(ends[0], minlength=n)
    starts, out = np.cumsum(counts) - counts, np.full((n, most), -1)
    by_size = np.argsort(counts, kind="stable")
    at = int((counts[by_size] <= most).sum())
    few = by_size[:at]
    slots = starts[few][:, None] + np.arange(most)
    out[few] = np.where(np.arange(most) < counts[few][:, None], other[np.minimum(slots, max(len(other) - 1, 0))] if len(other) else -1, -1)
    while at < n:
        width = int(counts[by_size[min(at + step, n) - 1]])
        now = by_size[at : at + max(1, min(step, CELLS // (width * width)))]
        slots = starts[now][:, None] + np.arange(width)
        held = np.where(np.arange(width) < counts[now][:, None], other[np.minimum(slots, len(other) - 1)], -1)
        out[now] = _diverse(vectors, now, held, most)
        at += len(now)
    return out


def _diverse(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """For every node its candidates (padded with -1), nearest first, each nearer to it than to any kept before.

    The rest fills up to ``most``.
    """
    out = np.full((len(nodes), most), -1)
    width = candidates.shape[1]
    step = max(1, CELLS // (width * (width + vectors.shape[1])))
    for start in range(0, len(nodes), step):
        held = candidates[start : start + step]
        to_node = np.einsum("ncd,nd->nc", vectors[held], vectors[nodes[start : start + step]])
        to_node[held < 0] = -3
        order = np.argsort(-to_node, axis=1, kind="stable")
        held, to_node = np.take_along_axis(held, order, axis=1), np.take_along_axis(to_node, order, axis=1)
        among = vectors[held]
        among = among @ among.transpose(0, 2, 1)
        nearest_kept = np.full(held.shape, -2.0, np.float32)
        kept, count = np.zeros(held.shape, bool), np.zeros(len(held), int)
        for c in range(width):
            now = np.flatnonzero((to_node[:, c] > nearest_kept[:, c]) & (held[:, c] >= 0) & (count < most))
            kept[now, c] = True
            count[now] += 1
            nearest_kept[now] = np.maximum(nearest_kept[now], among[now, c])
        first = np.argsort(np.where(held < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :most]
        out[start : start + step, : first.shape[1]] = np.take_along_axis(held, first, axis=1)
    return out
