"""Near-duplicate embeddings: a small-world graph per shard, queried by the vectors routed to it.

Equal vectors are one class, so copies cost nothing.  About one class in SHARD_ROWS is a
pivot; the classes nearest to a pivot are its shard.  A vector is also sent to the shards
whose border it lies near enough to.  Of two linked vectors in different shards, one lies
within ``sqrt((1 - threshold) / 2)`` of the border, so at that reach no link is lost; the
reach used is the smallest step of REACHES that parts at most one in 10,000 of the links
of a sample, whose links are found by all products.

A shard's graph is searched with a beam of BEAM; AUDITED of the queries are compared with
the exact products and the beam is doubled until their recall is at least RECALL; a beam
that is full of near vectors is widened whatever the audit says, up to the whole shard.
Products are taken in double precision between unit vectors, and only pairs at or above
the threshold are links.  A link belongs to one shard, which counts it and joins its ends,
so links are never written: a shard gives the linked classes with their counts and a root.
Vectors that are sent to further shards travel in half precision; pairs that this leaves
undecided are written, and decided by the vectors themselves.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing; vectors of different length do not link; rows that share
an id are one vector in components, each with its own links; rows without id count in
their class and get no component of their own; an empty table gives no rows; labels and
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from affectlake.llm.common import connected_components, join_hot, maybe_in
from affectlake.llm.hnsw import AT_ONCE, Graph
from affectlake.session import saved

SHARD_ROWS = 8_192
BEAM = 16
AUDITED = 1_024
RECALL = 0.999

SAMPLED = 4_096  # classes whose links say how far vectors are sent
ROUTED = 0.9999
REACHES = np.array([1 / 6, 1 / 4, 1 / 3, 1 / 2, 2 / 3, 5 / 6, 1.0])  # parts of the reach that loses no link
ROWS_ROUTED = 1_000
CELLS = 1 << 22  # products that a task holds at a time
ROUNDING = 1e-5  # of single precision, on the safe side
HALF_ROUNDING = 5e-4  # at most the length of what a unit vector loses in half precision


def has_direction(vector: Column) -> Column:
    """Whether a vector has components, all finite, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows that have a direction, in doubles at length 1."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, initial=0.0)[:, None]
    return v / np.sqrt(np.einsum("ed,ed->e", v, v))[:, None] + 0.0


def components(
    embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, beam: int = BEAM,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``embeddings``."""
    single = isinstance(embeddings.schema[vector_col].dataType.elementType, T.FloatType)
    raw = F.col(vector_col).cast("array<float>" if single else "array<double>")
    same = F.transform(vector_col, lambda x: x.cast("double") + 0.0)
    source = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("raw"), F.xxhash64(same).alias("f1"),
                               F.xxhash64(F.lit(1), same).alias("f2"))
    rows = saved(source.select("vec_id", "f1", "f2", has_direction(F.col("raw")).alias("ok")))
    valid = rows.filter("ok").select("vec_id", "f1", "f2")
    total = valid.count()
    classes = saved(valid.groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("k")))
    vectors = _class_vectors(source.filter(has_direction(F.col("raw"))), classes)
    count = classes.filter("rep is not null").count()
    linked = saved(linked_classes(vectors, count, threshold, shard_rows, beam, np.float32 if single else np.float64))

    grouped = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(
        _ties(valid, classes, total)))
    degrees = linked.groupBy("rep").agg(F.sum("n").alias("others"))
    described = saved(classes.join(degrees, "rep", "left").join(
        grouped.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "k", (F.coalesce("others", F.lit(0)) + F.col("k") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id")))
    found = join_hot(valid, described, ["f1", "f2"], "k", total).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _class_vectors(source: DataFrame, classes: DataFrame) -> DataFrame:
    """``(rep, k, raw)`` of every class with an id; vectors are moved only where there may be copies."""
    copies = classes.filter("k > 1")
    named = F.col("vec_id").isNotNull()
    alone = [F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("k"), "raw"]
    if copies.isEmpty():
        return source.filter(named).select(*alone)
    maybe = maybe_in(copies, "f1")("f1")
    several = saved(source.filter(maybe).groupBy("f1", "f2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("k"), F.any_value("raw").alias("raw")).filter(
        "rep is not null").select("rep", "k", "raw"))
    return source.filter(~maybe & named).select(*alone).unionByName(several)


def _ties(valid: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Edges ``(a, b)`` from an id whose rows lie in several classes to those classes."""
    shared = saved(valid.filter("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1"))
    few = valid.join(shared, "vec_id", "left_semi")
    placed = join_hot(few, classes.select("f1", "f2", "rep", "k"), ["f1", "f2"], "k", total).select("vec_id", "rep")
    repeated = placed.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    return placed.join(repeated.select("vec_id"), "vec_id", "left_semi").select(
        F.col("vec_id").alias("a"), F.col("rep").alias("b"))


def _picked(vectors: DataFrame, wanted: int, count: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """About ``wanted`` of ``count`` classes, chosen by hash: ``(reps, unit vectors)`` by length."""
    share = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30))
    found = vectors.filter(share < F.lit(-(-(wanted << 30) // max(count, 1)))).select("rep", "raw").toArrow().combine_chunks()
    reps, raw = found.column("rep").to_numpy(), found.column("raw")
    return {dim: (reps[at], unit(rows)) for dim, at, rows in _by_length(raw)} if len(reps) else {}


def _by_length(raw: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of every length: ``(length, their places, a matrix)``."""
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    lengths = pc.list_value_length(raw).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, raw.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


class Router:
    """Pivots by vector length; their numbers are the shards.  A length without pivots is one shard."""

    def __init__(self, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.first, self.pivots, at = {}, {}, 0
        for dim, (_, vectors) in sorted(pivots.items()):
            self.first[dim], self.pivots[dim] = at, vectors.astype(np.float32)
            at += len(vectors)

    def homes(self, v: np.ndarray) -> np.ndarray:
        """The shard of every unit vector."""
        pivots = self.pivots.get(v.shape[1])
        if pivots is None:
            return np.full(len(v), -v.shape[1])
        short, step = v.astype(np.float32), max(1, CELLS // len(pivots))
        return self.first[v.shape[1]] + np.concatenate(
            [(short[i : i + step] @ pivots.T).argmax(axis=1) for i in range(0, len(v), step)] or [np.zeros(0, int)])

    def beyond(self, v: np.ndarray, homes: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """How far vectors lie from the border between their own shard and another."""
        if v.shape[1] not in self.pivots:
            return np.zeros(len(v))
        pivots, first = self.pivots[v.shape[1]], self.first[v.shape[1]]
        across = (pivots[homes - first] - pivots[shards - first]).astype(np.float64)
        width = np.sqrt(np.einsum("ed,ed->e", across, across))
        return np.einsum("ed,ed->e", v, across) / np.maximum(width, 1e-12)

    def visits(self, v: np.ndarray, homes: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, other shard) for borders within ``reach``, by row."""
        pivots = self.pivots.get(v.shape[1])
        if pivots is None or len(pivots) < 2:
            return np.zeros(0, int), np.zeros(0, int)
        first, short, step = self.first[v.shape[1]], v.astype(np.float32), max(1, CELLS // len(pivots))
        found = []
        for i in range(0, len(v), step):
            sims = short[i : i + step] @ pivots.T
            own = homes[i : i + step] - first
            best = sims[np.arange(len(sims)), own]
            q, c = np.nonzero(sims >= (best - 2 * reach - ROUNDING)[:, None])  # pivots are at most 2 apart
            other = c != own[q]
            q, c = q[other] + i, c[other] + first
            near = self.beyond(v[q], homes[q], c) <= reach + ROUNDING
            found.append((q[near], c[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _reach(vectors: DataFrame, router: Router, count: int, threshold: float) -> float:
    """The smallest reach that keeps the links of a sample, by all their products."""
    most = float(np.sqrt(max(0.0, 1 - threshold) / 2))
    sample = {dim: (reps, v, router.homes(v)) for dim, (reps, v) in _picked(vectors, SAMPLED, count, 2).items() if dim in router.pivots}
    sent = vectors.sparkSession.sparkContext.broadcast((router, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, sample = sent.value
        kept, wanted = np.zeros(len(REACHES), np.int64), 0
        for batch in batches:
            for dim, _, raw in _by_length(batch.column(0)):
                if dim not in sample:
                    continue
                _, picked, homes = sample[dim]
                short, step = picked.astype(np.float32).T, max(1, CELLS // len(picked))
                for start in range(0, len(raw), step):
                    v = unit(raw[start : start + step])
                    n, s = np.nonzero(v.astype(np.float32) @ short >= threshold - ROUNDING)
                    good = np.einsum("ed,ed->e", v[n], picked[s]) >= threshold
                    n, s = n[good], s[good]
                    linked, n = np.unique(n, return_inverse=True)
                    own = router.homes(v[linked])[n]
                    apart = own != homes[s]
                    wanted += len(n)
                    kept += (~apart).sum()
                    v, n, s, own = v[linked], n[apart], s[apart], own[apart]
                    need = np.minimum(router.beyond(v[n], own, homes[s]), router.beyond(picked[s], homes[s], own))
                    kept += (need[:, None] <= REACHES * most + ROUNDING).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(REACHES) + 1)), pa.array(np.append(kept, wanted))], names=["at", "n"])

    counts = dict(vectors.select("raw").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).toArrow().to_pandas().to_numpy())
    sent.destroy()
    for at, part in enumerate(REACHES[:-1]):
        if counts.get(at, 0) >= ROUTED * counts.get(len(REACHES), 0):
            return float(part * most)
    return most


def linked_classes(
    vectors: DataFrame, count: int, threshold: float, shard_rows: int, beam: int, kind: type = np.float64,
) -> DataFrame:
    """``(rep, n, root)`` of linked classes by shard: rows that they link with, and a class they are joined to.

    ``vectors`` holds ``count`` classes ``(rep, k, raw)``.
    """
    shards = -(-count // shard_rows)
    router = Router(_picked(vectors, shards, count, 1) if shards > 1 else {})
    reach = _reach(vectors, router, count, threshold) if router.pivots else 0.0
    sent = vectors.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS_ROUTED) for whole in batches for i in range(0, whole.num_rows, ROWS_ROUTED)):
            reps, ks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for _, at, raw in _by_length(batch.column(2)):
                v = unit(raw)
                homes = sent.value.homes(v)
                q, c = sent.value.visits(v, homes, reach)
                ends = np.append(0, np.cumsum(np.bincount(q, minlength=len(v))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int32()))
                raw = raw.astype(kind)
                yield _routed(homes, homes, reps[at], ks[at], np.zeros(len(v)), lists, raw)
                if len(q):
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(q) + 1), pa.int32()), pa.array([], pa.int32()))
                    yield _routed(c, homes[q], reps[at][q], ks[at][q], _marks(raw)[q], none, v.astype(np.float16)[q])

    routed = vectors.select("rep", "k", "raw").mapInArrow(
        route, "shard int, home int, rep bigint, k bigint, mark bigint, visits array<int>, v binary")

    def search(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        shard, home, reps, ks, marks = (part.column(i).to_numpy() for i in range(5))
        own, guests = np.flatnonzero(home == shard), np.flatnonzero(home != shard)
        if not len(own):
            return _linked_rows()
        own = own[np.argsort(reps[own], kind="stable")]
        own = own[np.argsort(_spread(reps[own]), kind="stable")]

        def matrix(rows: np.ndarray, kind: type) -> np.ndarray:
            held = part.column("v").take(pa.array(rows)).to_pylist()
            return np.frombuffer(b"".join(held), kind).reshape(len(rows), -1 if len(rows) else 0)

        raw = matrix(own, kind)
        visits = part.column("visits").take(pa.array(own)).combine_chunks()
        places = np.repeat(np.arange(len(own)), pc.list_value_length(visits).to_numpy(zero_copy_only=False))
        sent_to = visits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # A link of two rows that visit each other's shard belongs to the shard with the smaller number.
        others = np.sort((places + (sent_to << 32))[sent_to < shard[0]])
        v = unit(raw)
        v = np.concatenate([v, matrix(guests, np.float16).astype(np.float64).reshape(len(guests), v.shape[1])])
        order = np.append(own, guests)
        reps, ks, home, marks = reps[order], ks[order], home[order].astype(np.int64), marks[order]
        graph = Graph.build(v[: len(own)], reps[: len(own)])
        wide = beam_for(graph, v, threshold, beam)
        degrees, roots, open_ = np.zeros(len(reps), np.int64), np.arange(len(reps)), []
        for start in [*range(0, len(own), AT_ONCE), *range(len(own), len(reps), AT_ONCE)]:
            guest = start >= len(own)
            stop = min(start + AT_ONCE, len(reps) if guest else len(own))
            q, n = graph.within(v[start:stop], threshold - HALF_ROUNDING * guest, wide)
            q = q + start
            mine = (reps[q] != reps[n]) & ~_holds(others, n + (home[q] << 32)) if guest else reps[q] < reps[n]
            q, n = q[mine], n[mine]
            if guest:
                sure = np.einsum("ed,ed->e", v[q], v[n]) >= threshold + HALF_ROUNDING
                open_.append((q[~sure], n[~sure]))
                q, n = q[sure], n[sure]
            np.add.at(degrees, q, ks[n])
            np.add.at(degrees, n, ks[q])
            roots = _joined(roots, q, n)
        some = np.flatnonzero(degrees)
        q, n = (np.concatenate([x[i] for x in open_] or [np.zeros(0, int)]) for i in (0, 1))
        return pa.concat_tables([
            _linked_rows(reps[some], degrees[some], reps[roots[some]]),
            _linked_rows(reps[n], ks[n], reps[q], marks[q], [raw[i].tobytes() for i in n])])

    found = saved(routed.groupBy("shard").applyInArrow(search, "rep bigint, n bigint, root bigint, mark bigint, v binary"))
    return found.filter("v is null").select("rep", "n", "root").unionByName(_decided(found.filter("v is not null"), vectors, threshold, kind))


def _decided(open_: DataFrame, vectors: DataFrame, threshold: float, kind: type) -> DataFrame:
    """The links among undecided pairs: a class ``(rep, n, v)`` of a shard and one (``root``, ``mark``) sent to it."""
    schema = "rep bigint, n bigint, root bigint"
    if open_.isEmpty():
        return open_.sparkSession.createDataFrame([], schema)
    guests = vectors.filter(maybe_in(open_, "root")("rep")).select(F.col("rep").alias("root"), "k", "raw")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, raw in _by_length(batch.column(5)):
                rep, n, root, mark, k = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in range(5))
                raw = raw.astype(kind)
                v = np.stack([np.frombuffer(x, kind) for x in batch.column(6).take(pa.array(at)).to_pylist()])
                own = (_marks(raw) == mark) & (v.shape[1] == raw.shape[1])
                own[own] = np.einsum("ed,ed->e", unit(raw[own]), unit(v[own])) >= threshold
                rep, n, root, k = rep[own], n[own], root[own], k[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(x, y), pa.int64()) for x, y in ((rep, root), (k, n), (root, rep))], names=["rep", "n", "root"])

    return open_.join(guests, "root").select("rep", "n", "root", "mark", "k", "raw", "v").mapInArrow(decide, schema)


def _marks(raw: np.ndarray) -> np.ndarray:
    """Tell the vectors of classes that share an id apart."""
    return np.array([zlib.crc32(row.tobytes()) for row in raw], np.int64)


def _routed(shard, home, reps, ks, marks, visits: pa.Array, v: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(v) + 1) * v.shape[1] * v.itemsize, pa.int32())
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, offsets.buffers()[1], pa.py_buffer(v.tobytes())])
    columns = [pa.array(x, t) for x, t in ((shard, pa.int32()), (home, pa.int32()), (reps, pa.int64()), (ks, pa.int64()), (marks, pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, visits, packed], names=["shard", "home", "rep", "k", "mark", "visits", "v"])


def _linked_rows(reps=(), n=(), roots=(), marks=None, v=None) -> pa.Table:
    numbers = [pa.array(x, pa.int64()) for x in (reps, n, roots, [None] * len(reps) if marks is None else marks)]
    return pa.Table.from_arrays([*numbers, pa.array([None] * len(reps) if v is None else v, pa.binary())], names=["rep", "n", "root", "mark", "v"])


def _holds(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of the forest after edges ``(a, b)``: the smaller place of two trees is the root of both."""
    while len(a):
        at_a, at_b = roots[a], roots[b]
        open_ = at_a != at_b
        a, b, at_a, at_b = a[open_], b[open_], at_a[open_], at_b[open_]
        np.minimum.at(roots, np.maximum(at_a, at_b), np.minimum(at_a, at_b))
        while ((above := roots[roots]) != roots).any():
            roots = above
    return roots


def beam_for(graph: Graph, queries: np.ndarray, threshold: float, beam: int) -> int:
    """The beam, widened until the recall of the audited queries is reached."""
    checked = queries[:: max(1, len(queries) // AUDITED)]
    q, n = np.nonzero(checked @ graph.vectors.T >= threshold)
    wanted = q * len(graph.vectors) + n
    while beam < len(graph.vectors):
        found_q, found_n = graph.within(checked, threshold, beam)
        if np.isin(wanted, found_q * len(graph.vectors) + found_n).sum() >= RECALL * len(wanted):
            break
        beam *= 2
    return beam


def audited(graph: Graph, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a beam that reaches the recall of the audited queries."""
    return graph.within(queries, threshold, beam_for(graph, queries, threshold, beam))


def _spread(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
