"""Benchmark passages in documents: one Aho-Corasick automaton, one scan per text.

An item's windows are its runs of ``window`` consecutive words (all its words if it has
fewer).  All distinct windows go into one automaton over normalised text: A-Z
lower-cased, words parted by one space, a space at both ends, so that matches begin and
end at words.  Matches become word spans and, through the words' places, spans of code
points of the original text.

The automaton is built in every task from a list that the driver ships.  BLOCK_BYTES
bounds that list: windows beyond it are dealt to further blocks by hash, texts are
scanned once per block, and the spans are joined.  Nothing else passes the driver.

Defined results: null or empty texts have no words; an item without words has no window
and occurs nowhere; equal windows of several items count for each of them; a null item
id is left out; empty tables give no hits or no rows; rows that repeat are judged each.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from affectlake.llm.common import WORD_PATTERN, WORD_TABLE, arrow_map, lower_ascii
from affectlake.session import saved

WINDOW = 10
BLOCK_BYTES = 4_000_000

WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPAN = "struct<first:bigint,last:bigint,start:bigint,end:bigint>"
SPAN_ARROW = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])


def windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``(passage, items)``: every distinct window with the sorted ids of its items."""
    words = F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(WORD_PATTERN), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    passages = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, window)))
    return (
        items.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("item"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item", F.explode(F.array_distinct(passages)).alias("passage"))
        .groupBy("passage").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _scanner(passages: list[tuple[str, list[str]]]):
    """Returns the per-task work: an automaton and the function over texts."""

    def work():
        automaton = ahocorasick.Automaton()
        for passage, items in passages:  # latin-1 gives every byte a character of its own
            key = f" {passage} ".encode().decode("latin-1")
            automaton.add_word(key, (len(key), items))
        automaton.make_automaton()

        def scan(texts: list) -> tuple[list, list, list]:
            counts, spans, found = [], [], []
            for text in texts:
                words = (text or b"").translate(WORD_TABLE).split()
                line = b" " + b" ".join(words) + b" "
                hits = list(automaton.iter(line.decode("latin-1"))) if passages and words else []
                counts.append(len(words))
                spans.append(_spans(text, line, hits) if hits else [])
                found.append(sorted({item for _, (_, items) in hits for item in items}))
            return counts, spans, found

        return scan

    return work


def _spans(text: bytes, line: bytes, hits: list) -> list[dict]:
    """Hit words as disjoint spans, with their places in the original text."""
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.array([end for end, _ in hits])
    lengths = np.array([length for _, (length, _) in hits])
    first, last = np.searchsorted(gaps, ends - lengths + 1), np.searchsorted(gaps, ends)
    step = np.zeros(len(gaps), np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    inside = np.concatenate([[0], np.cumsum(step)[:-1] > 0, [0]]).astype(np.int8)
    begins, stops = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    places = [m.span() for m in WORD_BYTES.finditer(text)]
    spans, at, chars = [], 0, 0
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
        start, end = places[a][0], places[b - 1][1]
        before = chars + len(text[at:start].decode())
        chars, at = before + len(text[start:end].decode()), end
        spans.append({"first": a, "last": b, "start": before, "end": chars})
    return spans


def find_passages(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(row, n_words, spans, items)`` for every row of ``docs``.

    ``row`` holds the document's columns; spans are ``first, last`` (words, last
    excluded) and ``start, end`` (code points, end excluded); items are sorted ids.
    """
    passages = saved(windows(items, window, item_id, item_text))
    size = passages.agg(F.sum(F.octet_length("passage") + 8 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    fields = [
        ("n_words", "bigint", pa.int64()),
        ("spans", f"array<{SPAN}>", pa.list_(SPAN_ARROW)),
        ("items", "array<string>", pa.list_(pa.string())),
    ]
    found = None
    for block in range(blocks):
        own = passages.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == block) if blocks > 1 else passages
        listed = [tuple(r) for r in own.toArrow().to_pandas().itertuples(index=False)]
        work = _scanner([(p, [str(i) for i in ids]) for p, ids in listed])
        if found is None:
            found = arrow_map(docs, text_col, work, fields)
        else:
            # The texts go through once more; what earlier blocks found travels inside the row.
            wide = saved(found).select(F.col(f"row.{text_col}").alias("__text"), F.struct("*").alias("__found"))
            found = arrow_map(wide, "__text", work, fields).select(
                "row.__found.row", "n_words",
                _union(F.concat("row.__found.spans", "spans")).alias("spans"),
                F.array_sort(F.array_union("row.__found.items", "items")).alias("items"),
            )
    return found


def _union(spans: Column) -> Column:
    """Overlapping or touching word spans as one; the span's ends come from its parts."""

    def put(done: Column, span: Column) -> Column:
        tail = F.element_at(done, -1)
        joined = F.struct(
            tail["first"].alias("first"), F.greatest(tail["last"], span["last"]).alias("last"),
            tail["start"].alias("start"), F.greatest(tail["end"], span["end"]).alias("end"),
        )
        head = F.slice(done, 1, F.size(done) - 1)
        return F.when((F.size(done) > 0) & (tail["last"] >= span["first"]), F.concat(head, F.array(joined))).otherwise(
            F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), put)


def hit_words(spans: Column | str) -> Column:
    """Number of words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
