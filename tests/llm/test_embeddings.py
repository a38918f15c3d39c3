"""Embedding links against all products."""

import numpy as np
import pytest

from affectlake.llm import embedding_dedup as E
from affectlake.llm.hnsw import Graph

SCHEMA = "vec_id long, embedding array<float>, n_links int"


def brute(rows, threshold=0.9):
    vectors = []
    for _, v, _ in rows:
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, np.float32).astype(float) if good else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None
             and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= threshold * np.linalg.norm(vectors[i])
             * np.linalg.norm(vectors[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def rows_of(seed, n=300, dim=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim))
    out = []
    for i in range(n):
        v = centres[r.integers(20)] + r.normal(size=dim) * r.choice([0.0, 0.1, 0.25, 2.0])
        out.append((i, [float(x) for x in v * r.choice([1.0, 1e-3, 50.0])], 0))
    return out


@pytest.mark.parametrize("shard", [30, 5_000])
def test_links_and_components(spark, shard):
    rows = rows_of(5)
    got = E.components(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_rows=shard).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0),
            (7, [1.0, 0.0], 0), (8, [1.0, -0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [-1.0, 0.0], 0),
            (12, [1e-30, 0.0], 0)]
    got = E.components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_repeated_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0)] * 3 + [(2, [0.0, 1.0], 0)]
    got = E.components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1)] * 3 + [(2, 0, 2)]
    assert E.components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_graph_recall_and_audit():
    r = np.random.default_rng(0)
    x = np.repeat(r.normal(size=(150, 16)), 10, axis=0) + r.normal(size=(1_500, 16)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[r.permutation(len(x))]
    graph = Graph.build(x, np.arange(len(x)))
    want = x @ x.T >= 0.9
    q, n = E.audited(graph, x, 0.9, 4)
    assert len(set(zip(q.tolist(), n.tolist(), strict=True))) == len(q)
    assert want[q, n].all() and len(q) >= 0.99 * want.sum()


def test_links_near_the_threshold_between_shards(spark):
    """Copies in half precision leave these pairs undecided; ids in two classes, and lengths in a few rows, beside them."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(120):
        v, u = (x / np.linalg.norm(x) for x in r.normal(size=(2, 16)))
        u = u - (u @ v) * v
        u /= np.linalg.norm(u)
        sim = 0.9 + r.choice([-3e-4, -1e-6, 1e-6, 3e-4])
        rows += [(2 * i, v.tolist(), 0), (2 * i + 1, (sim * v + np.sqrt(1 - sim * sim) * u).tolist(), 0)]
    rows += [(1_000 + i, [1.0, float(i)], 0) for i in range(12)]
    table = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = E.components(table, shard_rows=8).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute64(rows)


def brute64(rows, threshold=0.9):
    lengths = [np.linalg.norm(v) for _, v, _ in rows]
    near = [[j for j in range(len(rows)) if j != i and len(rows[i][1]) == len(rows[j][1])
             and np.dot(rows[i][1], rows[j][1]) / lengths[i] / lengths[j] >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def test_vectors_are_not_sent_to_every_shard(spark):
    """Before, every shard's vectors and graph went to a task with those of every other shard."""
    r = np.random.default_rng(2)
    centres = np.repeat(np.eye(32)[:24], 40, axis=0)
    x = centres + r.normal(size=centres.shape) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    router = E.Router({32: (np.arange(24), x[::40])})
    homes = router.homes(x)
    q, _ = router.visits(x, homes, np.sqrt(0.05))
    assert len(q) < len(x)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if homes[a] != homes[b]}
    q, c = router.visits(x, homes, np.sqrt(0.05))
    sent = set(zip(q.tolist(), c.tolist(), strict=True))
    assert all((a, homes[b]) in sent or (b, homes[a]) in sent for a, b in want)
    y = r.normal(size=(400, 6))  # at the widest reach no link is lost, wherever the pivots lie
    y /= np.linalg.norm(y, axis=1)[:, None]
    router = E.Router({6: (np.arange(20), y[:20])})
    homes = router.homes(y)
    sent = set(zip(*(z.tolist() for z in router.visits(y, homes, np.sqrt(0.05))), strict=True))
    assert all(homes[a] == homes[b] or (a, homes[b]) in sent or (b, homes[a]) in sent
               for a, b in zip(*np.nonzero(y @ y.T >= 0.9), strict=True))


def test_beside_a_shard_nothing_grows_with_the_square(spark):
    """The rows that reach the shards' tasks: each vector once, and to few shards more."""
    r = np.random.default_rng(4)
    x = np.repeat(np.eye(64), 20, axis=0) + r.normal(size=(1_280, 64)) * 0.02
    vectors = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep long, k long, raw array<double>")
    linked = E.linked_classes(vectors, len(x), 0.9, 32, 16)
    assert linked.count() < 12_160 // 2  # counts and roots; there are 12,160 links
    assert sum(row.n for row in linked.collect()) == 2 * 12_160
