"""Shared helpers: table access, byte-level words, joins with hot keys, components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from affectlake.session import saved

VOCABULARY_DIR = os.environ.get("AFFECTLAKE_TOKENIZERS", "/opt/tokenizers")

# The two word patterns of the contracts.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_SPACE_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of UTF-8 with A-Z lower-cased and every byte outside a word as a space.
#: Bytes from 0x80 belong to words, so the table is right for whole code points.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
#: The same for words that end at white space only.
SPACE_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256)
)

#: A key with more than one part in HOT_SHARE of all rows is joined by broadcast;
#: there are fewer than HOT_SHARE such keys, whatever the input.
HOT_SHARE = 2_000

#: Texts that a task holds as Python objects at a time.
ROWS_AT_ONCE = 500
BATCH_BYTES = 1_000_000

FILTER_BITS, FILTER_HASHES = 1 << 25, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column | str) -> Column:
    """A-Z in lower case, other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_hot(rows: DataFrame, counted: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, without a hot task.

    ``counted`` holds in column ``n`` how many of the ``total`` rows have the key; it is
    read twice, so it should be a written table or cheap.  Keys above one part in
    HOT_SHARE, fewer than HOT_SHARE by count, become a local table that is broadcast;
    every other key is too small to make a task large, and is shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    listed = counted.filter(F.col(n) * HOT_SHARE > total).drop(n)
    found = listed.toArrow()
    if not found.num_rows:
        return rows.join(counted.drop(n), keys)
    hot = rows.sparkSession.createDataFrame(found, listed.schema)
    cold = counted.filter(F.col(n) * HOT_SHARE <= total).drop(n)
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    )


def roots(parents: DataFrame) -> DataFrame:
    """``(node, component)`` of a forest ``(parent, child)`` with one smaller parent a child.

    Pointer doubling: every round a node points at its parent's parent, so a path of any
    length needs the logarithm of its length in rounds, and stars need none.
    """
    now = saved(parents.select("parent", "child"))
    while True:
        above = now.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        table = saved(now.groupBy("parent").agg(F.count("*").alias("k")).join(above, "parent", "left").select(
            "parent", "k", F.coalesce("above", "parent").alias("above")))
        total, deep = table.agg(F.sum("k"), F.count_if(F.col("above") != F.col("parent"))).first()
        if not deep:
            break
        now = saved(join_hot(now, table, "parent", "k", total).select(F.col("above").alias("parent"), "child"))
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(
        table.select(F.col("parent").alias("node"), F.col("parent").alias("component")))


def maybe_in(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """A test for a long column that every value of ``keys`` passes, and few others do.

    A Bloom filter of FILTER_BITS bits, whatever the input, is built by aggregates and
    travels to the tasks.  It only keeps rows from a shuffle before an exact join; as it
    fills up, more rows take the shuffle and the result stays the same.
    """

    def places(column: str) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)]

    words = keys.select(F.explode(F.array(*places(key))).alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def test(*ats: pa.Array) -> pa.Array:
        found = True
        for at in ats:
            place = at.to_numpy(zero_copy_only=False)
            found &= (shared.value[place >> 6] >> (place & 63)) & 1 == 1
        return pa.array(found)

    return lambda column: test(*places(column))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node on an edge ``(a, b)`` of longs.

    Large-star and small-star in turns: every round points each node at the
    smallest id it knows of, until the edges are stars around the smallest id of a
    component.  Each round is written to the shared folder, which cuts the lineage
    and lets a lost executor cost a re-read.  A hub's edges never meet in one task.
    Null ends and loops are no edges; an empty input gives an empty result.
    """
    now = saved(_pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = _fingerprint(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = saved(both.groupBy("u").agg(
            F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")
        ).filter("n > 0"))
        above = join_hot(both.filter("v > u"), low, "u", "n", seen[0])
        large = saved(_pairs(above.select(F.col("v").alias("a"), F.col("m").alias("b"))))
        low = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_hot(large, low, "a", "n", seen[0])  # large has no more rows than the edges had
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        now = saved(_pairs(moved))
        before, seen = seen, _fingerprint(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def joined_components(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """Components ``(node, component)`` after further edges ``(a, b)``, on the components alone."""
    edges = saved(edges)
    if edges.isEmpty():
        return grouped

    def root(end: str) -> DataFrame:
        return grouped.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}"))

    between = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    merged = saved(connected_components(between))
    table = saved(grouped.groupBy("component").agg(F.count("*").alias("k")).join(
        merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left"))
    moved = join_hot(grouped, table, "component", "k", grouped.count()).select(
        "node", F.coalesce("new", "component").alias("component"))
    return moved.unionByName(merged.join(grouped.select("node"), "node", "left_anti"))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most BATCH_BYTES: a task has several of them outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(
    docs: DataFrame, text_col: str, work: Callable[[], Callable], fields: Sequence[tuple[str, str, pa.DataType]],
    also: Sequence[str] = (), keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (all columns of ``docs``, or those in ``keep``) beside what ``work`` makes of each text.

    ``work()`` runs once per task and returns a function from a list of texts, as
    UTF-8 bytes or None, and the values of the columns in ``also``, to one list per field
    ``(name, SQL type, Arrow type)``.  Rows travel in Arrow batches and stay where they are: no shuffle, no state between
    tasks.  Input columns are kept inside ``row``, so their names cannot clash.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.struct("*").alias("row"))
    at, others = docs.columns.index(text_col), [docs.columns.index(c) for c in also]
    made_schema = T.StructType.fromDDL(", ".join(f"{name} {sql_type}" for name, sql_type, _ in fields))
    kept = [docs.columns.index(c) for c in (docs.columns if keep is None else keep)]
    row_type = T.StructType([source.schema["row"].dataType.fields[i] for i in kept])
    schema = T.StructType([T.StructField("row", row_type, False), *made_schema.fields])
    names, types = ["row", *(f[0] for f in fields)], [f[2] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.column(0).slice(start, ROWS_AT_ONCE)
                values = each(
                    pc.struct_field(rows, at).cast(pa.large_binary()).to_pylist(),
                    *(pc.struct_field(rows, i).to_pylist() for i in others))
                made = [pa.array(x, type=t) for x, t in zip(values, types, strict=True)]
                if keep is not None:  # a text that is not needed any more does not travel back
                    rows = pa.StructArray.from_arrays(
                        [pc.struct_field(rows, i) for i in kept], fields=[rows.type.field(i) for i in kept])
                yield pa.RecordBatch.from_arrays([rows, *made], names=names)

    return source.mapInArrow(run, schema)
