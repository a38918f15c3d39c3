"""Quoted records of large delimited files, read by as many tasks as a file has blocks.

A line may begin inside a quoted field or outside, which depends on all lines before it.
Every block is therefore read for both cases, which agree from the first line on that
ends outside for both.  What a block makes of each case (a few values) is composed along
the file, and that chooses the case of every block.  A record that goes on over the end
of a block is put together from its parts, two a block at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from affectlake.session import bounded, saved

OUTSIDE, INSIDE, BOTH = 0, 1, 2
HEAD, RECORD, TAIL, SUMMARY = range(4)

PIECE = ("file bigint, block bigint, case int, kind int, no_outside bigint, no_inside bigint, "
         "end_outside int, end_inside int, name string, record string")
_ARROW = pa.schema([
    ("file", pa.int64()), ("block", pa.int64()), ("case", pa.int32()), ("kind", pa.int32()), ("no_outside", pa.int64()),
    ("no_inside", pa.int64()), ("end_outside", pa.int32()), ("end_inside", pa.int32()), ("name", pa.string()), ("record", pa.string())])


def line_ends(sep: str):
    """``(outside, inside)``: where a line with quotes ends if it begins outside or inside a field."""
    s = re.escape(sep)
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{s}]*+|[^"{s}][^{s}]*+|)'
    closed = re.compile(rf"(?s:(?:{field}{s})*+{field}\Z)")
    rest = re.compile(rf'(?s:[^"]*+(?:""[^"]*+)*+"[^{s}]*+({s}|\Z))')

    def ends(line: str) -> tuple[int, int]:
        outside = OUTSIDE if closed.match(line) else INSIDE
        found = rest.match(line)
        if not found:
            return outside, INSIDE
        return outside, OUTSIDE if found[1] == "" or closed.match(line, found.end()) else INSIDE

    return ends


class _Case:
    """One reading of a block: its open record and how many records began."""

    def __init__(self, state: int):
        self.state, self.open, self.began, self.headed = state, [], 0, state == INSIDE


class _Block:
    """Pieces of one block, read for both cases until they agree."""

    def __init__(self, key: tuple, edges: bool):
        self.key, self.edges, self.agreed = key, edges, False
        self.cases = [_Case(OUTSIDE), _Case(INSIDE)]

    def add(self, line: str, ends: tuple[int, int] | None) -> Iterator[tuple]:
        if self.agreed:
            yield from self._step(self.cases[0], BOTH, line, ends)
            return
        for at, case in enumerate(self.cases):
            yield from self._step(case, at, line, ends)
        if self.cases[0].state == self.cases[1].state == OUTSIDE:
            self.agreed, self.before = True, self.cases[1].began - self.cases[0].began

    def _step(self, case: _Case, which: int, line: str, ends: tuple[int, int] | None) -> Iterator[tuple]:
        if case.state == OUTSIDE and not case.open and line in ("", "\r"):
            return
        case.open.append(line)
        case.state = case.state if ends is None else ends[case.state]
        if case.state == OUTSIDE:
            yield from self._closed(case, which, RECORD)

    def _closed(self, case: _Case, which: int, kind: int) -> Iterator[tuple]:
        text, case.open = "\n".join(case.open), []
        if case.headed:
            kind, case.headed = HEAD, False
        else:
            case.began += 1
        if (kind == RECORD) != self.edges:
            yield self._piece(which, kind, case, text.removesuffix("\r") if kind != TAIL else text)

    def _piece(self, which: int, kind: int, case: _Case, text: str | None) -> tuple:
        inside = case.began + self.before if which == BOTH else case.began
        return (*self.key[:2], which, kind, case.began, inside, None, None, None, text)

    def end(self) -> Iterator[tuple]:
        first, second = self.cases
        last = [(first, BOTH)] if self.agreed else [(first, OUTSIDE), (second, INSIDE)]
        states = [first.state, first.state if self.agreed else second.state]
        for case, which in last:
            if case.open:
                yield from self._closed(case, which, TAIL)
        if self.edges:
            inside = first.began + self.before if self.agreed else second.began
            yield (*self.key[:2], BOTH, SUMMARY, first.began, inside, *states, self.key[2], None)


def _pieces(lines: DataFrame, sep: str, edges: bool) -> DataFrame:
    """Whole records (``edges`` off), or the blocks' summaries and parts of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, block = line_ends(sep), None
        for batch in batches:
            out = []
            quoted = pc.match_substring(batch.column(3), '"').to_pylist()
            for *key, line, has_quote in zip(*(batch.column(i).to_pylist() for i in range(4)), quoted, strict=True):
                if block is None or key != block.key:
                    if block is not None:
                        out.extend(block.end())
                    block = _Block(key, edges)
                out.extend(block.add(line, ends(line) if has_quote else None))
            if out:
                yield _batch(out)
        if block is not None:
            yield _batch(list(block.end()))

    name = "_metadata.file_name" if edges else "cast(null as string)"
    source = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.expr(name).alias("name"), "value")
    return source.mapInArrow(run, PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def quoted_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """``(file, row_no, record)``: the records of every file, numbered from 1 in the file's order.

    Quotes are doubled inside quoted fields, records end at a line feed, before which one
    carriage return is left out; empty lines are none.  A field that is never closed
    reaches to the end of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    edges = saved(_pieces(lines, sep, True))
    blocks, small = bounded(_chosen(edges.filter(F.col("kind") == SUMMARY)))
    blocks = F.broadcast(blocks) if small else blocks
    own = F.when(F.col("start") == INSIDE, F.col("no_inside")).otherwise(F.col("no_outside"))

    def placed(pieces: DataFrame) -> DataFrame:
        return pieces.drop("name").join(blocks, ["file", "block"]).filter(
            (F.col("case") == BOTH) | (F.col("case") == F.col("start"))).withColumn("row_no", F.col("before") + own)

    parts = placed(edges.filter(F.col("kind") != SUMMARY))
    in_order = Window.partitionBy("file").orderBy("block", "kind")
    chained = parts.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(in_order))
    joined = chained.groupBy("file", "chain").agg(
        F.first("name").alias("name"), F.max(F.when(F.col("kind") == TAIL, F.col("row_no"))).alias("row_no"),
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "kind", "record")))["record"], "\n").alias("record"))
    whole = placed(_pieces(lines, sep, False))
    columns = [F.col("name").alias("file"), "row_no", "record"]
    return whole.select(columns).unionByName(joined.select(columns))


def _chosen(summaries: DataFrame) -> DataFrame:
    """``(file, block, name, start, before)``: the case of every block and the records that began before it."""
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    agrees = F.col("end_outside") == F.col("end_inside")
    turns = summaries.withColumn("turns", F.sum((F.col("end_outside") > F.col("end_inside")).cast("int")).over(in_order))
    known = F.when(agrees, F.struct(F.col("end_outside").alias("state"), "turns"))
    last = F.last(known, ignorenulls=True).over(before)
    start = (F.coalesce(last["state"], F.lit(OUTSIDE)) + F.coalesce(F.lag("turns").over(in_order), F.lit(0))
             - F.coalesce(last["turns"], F.lit(0))) % 2
    started = turns.select("file", "block", "name", start.alias("start"), "no_outside", "no_inside")
    began = F.when(F.col("start") == INSIDE, F.col("no_inside")).otherwise(F.col("no_outside"))
    return started.select("file", "block", "name", "start", F.coalesce(F.sum(began).over(before), F.lit(0)).alias("before"))


def read_quoted(
    spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", header: bool = True, places: bool = False,
) -> DataFrame:
    """Columns of ``schema`` by position; ``places`` adds ``file`` (its name) and ``row_no``, from 1 behind a header."""
    records = quoted_records(spark, path, sep)
    if header:
        records = records.filter("row_no > 1").withColumn("row_no", F.col("row_no") - 1)
    row = F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("row")
    parsed = records.select("file", "row_no", row)
    return parsed.select("row.*", "file", "row_no") if places else parsed.select("row.*")
