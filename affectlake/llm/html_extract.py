"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut.

A page becomes a row of text blocks.  A logistic classifier over a block's form and its
place in the document tree gives each block the cost of either label (the terminal
capacities); neighbours in page order, and neighbours under one parent, are tied by
edges that weigh more the more of the tree they share.  The cut of least cost labels the
page, and the content blocks are joined in page order.

The classifier is fitted on at most SAMPLE_PAGES pages chosen by hash.  Its labels come
from pages that say what their blocks are (``article`` and ``main``, against ``nav``,
``footer``, adverts and the like); each block is learned twice, once without what the
page says, so that form alone decides where a page says nothing.

Defined results: null or empty html, and pages without content, have an empty text;
unfinished tags at the end are dropped; rows that repeat are read each; with nothing to
learn from the classifier keeps its prior weights; an empty table gives no rows; a very
long page is read whole; of cuts of equal cost the one with the fewest content blocks
counts; other columns stay inside ``row``, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from affectlake.llm.common import arrow_map
from affectlake.llm.html_blocks import Block, blocks_of
from affectlake.llm.min_cut import content_side

SAMPLE_PAGES = 1_500
TIE = 0.7
LEAST_SHARE = 0.02
# Prior weights: bias, log length, linked share, sentence ends, heading, list item, names itself boilerplate, in article.
PRIOR = [-1.0, 0.3, -3.0, 1.0, 0.5, -1.0, -6.0, 3.0]
STRENGTH = 5.0


def features(block: Block) -> list[float]:
    length = len(block.text)
    ends = sum(block.text.count(c) for c in ".!?")
    return [
        1.0, math.log1p(length), block.linked / length, min(1.0, 20.0 * ends / length),
        float(block.tag in ("h1", "h2", "h3")), float(block.tag in ("li", "td", "th", "dt")),
        float(block.boiler), float(block.content and not block.boiler),
    ]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> list[float]:
    """Weights of the classifier, from at most ``sample`` pages; one bounded task."""
    keyed = pages.filter(F.col(html_col).isNotNull()).select(
        F.col(html_col).alias("html"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("#pages"))).alias("key"))
    share = min(1.0, (1.5 * sample + 50) / max(1, keyed.count()))
    slot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(16**8)
    rank = F.row_number().over(Window.partitionBy("one").orderBy("key", "html"))
    chosen = keyed.filter(slot < share).withColumn("one", F.lit(1)).withColumn("rank", rank).filter(
        F.col("rank") <= sample).select("one", "html")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        x, y = [], []
        for html in part["html"]:
            for block in blocks_of(html):
                if block.boiler or block.content:
                    row = features(block)
                    x += [row, [*row[:-2], 0.0, 0.0]]
                    y += [float(not block.boiler)] * 2
        return pd.DataFrame({"w": [_logistic(np.array(x).reshape(-1, len(PRIOR)), np.array(y)).tolist()]})

    rows = chosen.groupBy("one").applyInPandas(lambda part: learn(part), "w array<double>").collect()
    return list(rows[0]["w"]) if rows else list(PRIOR)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps towards the labels, held to the prior weights."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(25 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - STRENGTH * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + STRENGTH * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def label(blocks: list[Block], weights: list[float]) -> list[bool]:
    """Which blocks are content."""
    scores = [sum(a * b for a, b in zip(features(block), weights, strict=True)) for block in blocks]
    share = [min(1 - LEAST_SHARE, max(LEAST_SHARE, 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))) for s in scores]
    edges, last_under = [], {}
    for i, block in enumerate(blocks):
        tied = set()
        if i:
            tied.add(i - 1)
        parent = block.path[:-1]
        if parent in last_under:
            tied.add(last_under[parent])
        last_under[parent] = i
        edges += [(j, i, TIE * _shared(blocks[j].path, block.path)) for j in tied]
    return content_side([-math.log(p) for p in share], [-math.log(1 - p) for p in share],
                        [e for e in edges if e[2] > 0])


def _shared(a: tuple, b: tuple) -> float:
    """Share of the longer path that two blocks have in common, apart from the page's root."""
    common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return max(0, common - 2) / max(1, max(len(a), len(b)) - 2)


def extract(pages: DataFrame, weights: list[float], html_col: str = "html") -> DataFrame:
    """``(row, text)``: every row of ``pages`` with its main text."""

    def work():
        def read(batch: list) -> tuple[list]:
            out = []
            for html in batch:
                blocks = blocks_of(html.decode()) if html else []
                kept = label(blocks, weights) if blocks else []
                out.append(" ".join(b.text for b, k in zip(blocks, kept, strict=True) if k))
            return (out,)

        return read

    return arrow_map(pages, html_col, work, [("text", "string", pa.string())])
