"""Minimum cut of a page's blocks into content and boilerplate, by Dinic's maximum flow."""

from __future__ import annotations

from collections import deque


def content_side(content_cost: list[float], boiler_cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: a node's own cost, and an edge's weight where its ends differ.

    The source stands for content.  A node's common cost is paid either way, so only the
    difference becomes a capacity, to the source or to the sink.
    """
    n = len(content_cost)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def connect(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        gap = boiler_cost[i] - content_cost[i]
        if gap > 0:
            connect(source, i, gap, 0.0)
        elif gap < 0:
            connect(i, sink, -gap, 0.0)
    for a, b, weight in edges:
        connect(a, b, weight, weight)

    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if room[e] <= tiny)
                node = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[node] < len(heads[node]):
                e = heads[node][at[node]]
                if room[e] > tiny and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(heads[node]):
                path.append(heads[node][at[node]])
                node = to[path[-1]]
            elif path:
                e = path.pop()
                node = to[e ^ 1]
                at[node] += 1
            else:
                break
