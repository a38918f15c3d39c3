"""Documents whose word shingle sets have a Jaccard similarity of at least T percent.

The method is a signature tree over token bitmaps and size ranges, traversed against
itself; node pairs whose largest possible overlap is too small are dropped.  It is laid
out in levels so that no task, and nothing on the driver, holds more than a node:

1. Equal sets become one class, known by its smallest document id.
2. Top of the tree.  By size, sets fall into bands; a band's token space is cut into
   more segments than two linked sets can differ in tokens.  Two sets that differ in
   every segment overlap too little, so only sets with an equal segment can be linked:
   the upper node pairs that survive are found by an equi-join on segment signatures.
3. Inside a group with an equal signature, every set is first compared with the group's
   leader it shares most signatures with.  That is linear in the copies, and joins
   groups of copies into components, whose inner pairs need no further look.
4. Linked sets agree in more segments than one, so a set leaves its most common
   signatures out.  Groups that still span several components are merged by their leader
   and get the lower tree: leaves of LEAF sets with the OR and the AND of their bitmaps,
   their size range and their components, and parents over FANOUT nodes.  The traversal
   starts at the root pair and goes down by joins; a pair of nodes is dropped if sizes,
   overlap bound or a common component rule out a new link.  Nodes are coarse bitmaps,
   leaves that meet are fine ones.
5. Texts travel only for pairs that fine bitmaps leave possible, at the leaves or with a
   leader, and these are compared exactly.

Every bound is a proof, not an estimate: no link between different texts is lost.
Comparison is on 64-bit shingle hashes of whole texts.

Defined results: null or empty texts, and texts without words, have 0 shingles and stand
alone; a text with fewer words than a shingle is one shingle; rows that share an id are
one document; a row without id takes its class's component, or null; equal sets are
linked, whatever their texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from affectlake.llm.common import arrow_map, bound_batches, join_hot, joined_components, maybe_in, roots
from affectlake.llm.shingles import fingerprint, mixed, overlap, shingle_set
from affectlake.session import saved

BAND_RATIO = 1.5
SPARE = 2  # segments beyond need, so that an equal one is not empty
SPARE_SHARE, MOST_SPARE = 4, 1_000  # and one for so many needed, up to so many: a set leaves its most common ones out
BAND_STEP = 10_000  # above the spare ones
CHUNK = 1_000  # sets compared with one copy of a leader
LEAF = 1_024  # most signature groups are one leaf, which no join copies
FANOUT = 8
BITS_PER_TOKEN = 4  # with fewer, pairs just below the threshold are not told from links
COARSER = 4  # a coarse bitmap has so many times fewer bits
FINE_BYTES = 8_192  # of the largest fine bitmap, as hot leaders' are broadcast


def allowed_difference(size_sum: int, percent: int) -> int:
    """Most tokens by which two sets with this sum of sizes may differ."""
    return size_sum * (100 - percent) // (100 + percent)


def band_tops(largest: int, percent: int) -> list[int]:
    """Upper sizes of the bands; up to the first, linked sets are equal."""
    top = 1
    while allowed_difference(2 * (top + 1), percent) == 0:
        top += 1
    tops = [top]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_RATIO)))
    return tops


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Segment signatures of a set, for its own band and those of larger partners."""
    return placed_signatures(shingles, percent)[0]


def placed_signatures(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment signatures, and beside each its band and how many of that band the set may leave out.

    Two linked sets agree in more than ``spare`` segments of a band, of which at most as
    many are empty as one of them has empty ones.  So if each leaves out as many as it has
    spare ones that are not empty, and all sets choose by one order of the signatures, the
    last of the common ones in that order is left out by neither.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = n * 100 // percent
    tops = np.array(band_tops(reach, percent))
    own, last = np.searchsorted(tops, [n, reach])
    out, places = [], []
    for band in range(max(own, 1), last + 1):  # below band 1 only equal sets are linked
        allowed = allowed_difference(2 * int(tops[band]), percent)
        spare = SPARE + min(allowed // SPARE_SHARE, MOST_SPARE)
        m = allowed + 1 + spare
        segment = ((shingles >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        salt = mixed(np.array([band], np.uint64))
        order = np.argsort(segment, kind="stable")
        starts = np.flatnonzero(np.diff(segment[order], prepend=-1))
        sums = np.add.reduceat(mixed(shingles[order] ^ salt), starts)
        filled = segment[order][starts]
        loose = max(0, spare - (m - len(filled)))
        if m - len(filled) > spare:  # so many are empty that equal ones may all be
            empty = np.setdiff1d(np.arange(m), filled)
            filled, sums = np.concatenate([filled, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        out.append(mixed(sums + mixed(filled.astype(np.uint64) * np.uint64(1_000_003) + salt)).view(np.int64))
        places.append(np.full(len(filled), band * BAND_STEP + loose))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out, places))


def bitmap(shingles: np.ndarray) -> bytes:
    """Token bitmap of BITS_PER_TOKEN or more bits a token; its length is a power of two."""
    bits = 1 << max(6, int(len(shingles) * BITS_PER_TOKEN - 1).bit_length())
    marked = np.zeros(bits, bool)
    marked[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marked, bitorder="little").tobytes()


def both_bitmaps(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """The coarse and the fine bitmap of a set."""
    bits = bitmap(shingles)
    sizes = max(8, len(bits) // COARSER), min(len(bits), FINE_BYTES)
    return tuple(folded(bits, size).tobytes() for size in sizes)


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of the same tokens with ``size`` bytes, as words."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def components(
    docs: DataFrame, shingle_words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = _hashed(texts, shingle_words, percent)
    rows = saved(hashed.drop("marks", "places"))
    filled = rows.filter("n > 0")
    classes = saved(filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")))
    total = filled.count()

    # Signatures are many more bytes than texts: they are made again rather than written.  A text without copies
    # stands for its class; a copy that passes the filter beside its representative is linked to it like any other.
    copied = maybe_in(classes.filter("k > 1"), "f1")
    shown = classes.filter(copied("f1") & F.col("rep").isNotNull()).select(F.xxhash64("rep", "f1", "f2").alias("own"))
    stands = maybe_in(shown, "own")
    own = hashed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).withColumn("own", F.xxhash64("doc_id", "f1", "f2"))
    both = F.explode(F.arrays_zip("marks", "places")).alias("at")
    marks = own.filter(~copied("f1") | stands("own")).select(both, F.col("doc_id").alias("id")).select(
        F.col("at.marks").alias("mark"), "id", F.col("at.places").alias("place"))
    ordered = Window.partitionBy("mark").orderBy("id")
    leader = F.first("id").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    size = F.count("*").over(Window.partitionBy("mark"))
    members = saved(marks.select("mark", "id", "place", leader.alias("leader"), size.alias("size")).filter("size > 1"))
    ids = saved(members.select(F.col("id").alias("doc_id")).distinct())
    maps = saved(_bitmaps(_of_ids(texts, ids), shingle_words))
    votes = members.filter("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    first = votes.groupBy("id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    links = saved(_compared(_fitting(first, maps, percent), texts, shingle_words, percent))
    grouped = saved(roots(links.select(F.col("a").alias("parent"), F.col("b").alias("child")).distinct()))

    more = links.select("a", "b").limit(0)
    open_groups = _open_groups(_needed(members), grouped)
    if not open_groups.isEmpty():
        pairs = _fitting(_traversed(open_groups, maps, percent), maps, percent)
        more = _compared(pairs, texts, shingle_words, percent)

    # An id that stands for several classes, or is a copy in some, ties them together.
    shown = filled.select("doc_id", "f1", "f2")
    both_prints = F.struct("f1", "f2")
    repeated = shown.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min(both_prints).alias("lo"), F.max(both_prints).alias("hi")).filter("lo < hi")
    tied = saved(shown.join(repeated.select("doc_id"), "doc_id", "left_semi"))
    if not tied.isEmpty():
        more = more.unionByName(join_hot(tied, classes, ["f1", "f2"], "k", total).select(
            F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = joined_components(grouped, more)

    of_class = saved(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "k", F.coalesce("component", "rep").alias("component_id")))
    kept = join_hot(filled.select("doc_id", "n", "f1", "f2"), of_class, ["f1", "f2"], "k", total)
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return kept.select("doc_id", "n", "component_id").unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")


def _hashed(texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """``(doc_id, n, f1, f2, marks)``: set size, set fingerprint, segment signatures."""

    def work():
        def hash_one(text: bytes | None) -> tuple:
            own = shingle_set(text, shingle_words)
            return (len(own), *fingerprint(own), *placed_signatures(own, percent))

        def hash_all(batch: list) -> list:
            return list(zip(*map(hash_one, batch), strict=True))

        return hash_all

    fields = [("n", "bigint", pa.int64()), ("f1", "bigint", pa.int64()), ("f2", "bigint", pa.int64()),
              ("marks", "array<bigint>", pa.list_(pa.int64())), ("places", "array<int>", pa.list_(pa.int32()))]
    return arrow_map(texts, "text", work, fields, keep=["doc_id"]).select("row.doc_id", "n", "f1", "f2", "marks", "places")


def _of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, text)`` of the texts with one of the ids ``doc_id``, and few others."""
    return texts.filter(F.col("doc_id").isNotNull() & maybe_in(ids, "doc_id")("doc_id")).select(
        F.col("doc_id").alias("id"), "text")


def _bitmaps(texts: DataFrame, shingle_words: int) -> DataFrame:
    """``(id, n, coarse, fine)``: set sizes and bitmaps."""

    def work():
        def mark_all(batch: list) -> list[list]:
            sets = [shingle_set(t, shingle_words) for t in batch]
            return [[len(s) for s in sets], *map(list, zip(*map(both_bitmaps, sets), strict=True))]

        return mark_all

    fields = [("n", "bigint", pa.int64()), ("coarse", "binary", pa.binary()), ("fine", "binary", pa.binary())]
    return arrow_map(texts, "text", work, fields, keep=["id"]).select("row.id", "n", "coarse", "fine")


def _fitting(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(leader, id)`` that sizes and fine bitmaps leave possible."""

    @F.arrow_udf("boolean")
    def fit(n_x: pa.Array, x: pa.Array, n_y: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for *ns, bits_x, bits_y in zip(*(column.to_pylist() for column in (n_x, n_y, x, y)), strict=True):
            size = min(len(bits_x), len(bits_y))
            apart = np.bitwise_count(folded(bits_x, size) ^ folded(bits_y, size)).sum()
            out.append(bool(apart <= allowed_difference(sum(ns), percent)))
        return pa.array(out, pa.bool_())

    pairs = saved(pairs.select("leader", "id"))
    x, y = (maps.select(F.col("id").alias(key), F.col("n").alias(f"n_{s}"), F.col("fine").alias(s))
            for key, s in (("leader", "x"), ("id", "y")))
    leaders = saved(pairs.groupBy("leader").agg(F.count("*").alias("k")).join(x, "leader"))
    both = join_hot(pairs, leaders, "leader", "k", pairs.count()).join(y, "id")
    sizes = (F.col("n_x") * percent <= F.col("n_y") * 100) & (F.col("n_y") * percent <= F.col("n_x") * 100)
    return both.filter(sizes & fit("n_x", "x", "n_y", "y")).select("leader", "id").distinct()


def _compared(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` among pairs ``(leader, id)``, by exact intersection.

    A leader's text is copied once per CHUNK partners, so a hot leader's partners are
    spread over tasks; a task streams partners past one leader's sets.
    """
    pairs = saved(pairs.select("leader", "id"))
    counts = saved(pairs.groupBy("leader").agg(F.count("*").alias("k")).withColumn("chunks", F.ceil(F.col("k") / CHUNK)))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
    partners = join_hot(pairs, counts, "leader", "k", pairs.count()).select("leader", "id", chunk.alias("chunk"))
    heads = counts.select("leader", F.col("leader").alias("id"), F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    both = heads.withColumn("side", F.lit(0)).unionByName(partners.withColumn("side", F.lit(1)))
    ids = saved(pairs.select(F.explode(F.array("leader", "id")).alias("doc_id")).distinct())
    streams = both.join(_of_ids(texts, ids), "id").repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for batch in batches:
            a, b = [], []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for leader, chunk, side, id_, text in zip(*columns, batch.column(4).cast(pa.large_binary()).to_pylist(),
                                                      strict=True):
                if (leader, chunk) != now:
                    now, heads = (leader, chunk), []
                own = shingle_set(text, shingle_words)
                if side == 0:
                    heads.append(own)
                elif any(_linked(head, own, percent) for head in heads):
                    a.append(leader)
                    b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return streams.select("leader", "chunk", "side", "id", "text").mapInArrow(compare, "a bigint, b bigint")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return both * 100 >= percent * (len(a) + len(b) - both)


def _needed(members: DataFrame) -> DataFrame:
    """Members ``(mark, id, leader)`` without each set's most common marks, as many of a band as it may leave out."""
    common = Window.partitionBy("id", F.floor(F.col("place") / BAND_STEP)).orderBy(F.desc("size"), F.desc("mark"))
    return members.repartition("id").withColumn("at", F.row_number().over(common)).filter(
        F.col("at") > F.col("place") % BAND_STEP).select("mark", "id", "leader")


def _open_groups(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Members ``(mark, id, component)`` of groups that span components.

    Groups with the same members say the same; one of them is kept.  Those that are left
    and have one leader become one group, known by it, that holds a set once: near copies
    share most of their marks, but these have few leaders.  A leader has as many marks as
    it has segments, so that many groups at most become one.
    """
    placed = saved(members.join(grouped.withColumnRenamed("node", "id"), "id", "left").select(
        "mark", "id", "leader", F.coalesce("component", "id").alias("component")))
    groups = placed.groupBy("mark").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s1"),
        F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("s2"),
    ).filter("lo < hi")
    chosen = saved(groups.groupBy("k", "s1", "s2").agg(F.min("mark").alias("mark")).select("mark", "k"))
    return saved(join_hot(placed, chosen, "mark", "k", placed.count()).select(
        F.col("leader").alias("mark"), "id", "component").distinct())


def _traversed(members: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(leader, id)`` of sets in different components that the tree cannot rule out."""
    place = F.row_number().over(Window.partitionBy("mark").orderBy("component", "id")) - 1
    placed = saved(members.select("mark", "id", "component", F.floor(place / LEAF).alias("node")))
    deep = saved(placed.filter("node > 0").select("mark").distinct())

    def leaves(rows: DataFrame, bits: str) -> DataFrame:
        item = F.struct("id", "component", "n", F.col(bits).alias("bits"))
        return rows.join(maps.select("id", "n", bits), "id").groupBy("mark", "node").agg(F.collect_list(item).alias("sets"))

    close = leaves(placed.join(deep, "mark", "left_anti"), "fine").withColumn("others", F.lit(None).cast("array<struct<"
        "id:bigint,component:bigint,n:bigint,bits:binary>>")).select(F.col("sets").alias("sx"), F.col("others").alias("sy"))
    if not deep.isEmpty():
        below = placed.join(deep, "mark", "left_semi")
        pairs, inner = _leaf_pairs(leaves(below, "coarse"), percent), saved(leaves(below, "fine"))
        close = close.unionByName(
            pairs.join(inner.select("mark", F.col("node").alias("node_x"), F.col("sets").alias("sx")), ["mark", "node_x"])
            .join(inner.select("mark", F.col("node").alias("node_y"), F.col("sets").alias("sy")), ["mark", "node_y"])
            .select("sx", "sy"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys in zip(batch.column(0), batch.column(1), strict=True):
                x = xs.as_py()  # a leaf without another meets itself
                a, b = _close_sets(x, ys.as_py() if ys.is_valid else x, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                 names=["leader", "id"])

    return close.select("sx", "sy").mapInArrow(match, "leader bigint, id bigint").distinct()


def _leaf_pairs(leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaves ``(mark, node_x, node_y)`` that the dual traversal reaches."""
    values = F.transform("sets", lambda s: s["bits"])
    nodes = leaves.select(
        "mark", "node", F.array_min(F.transform("sets", lambda s: s["n"])).alias("n_lo"),
        F.array_max(F.transform("sets", lambda s: s["n"])).alias("n_hi"),
        F.array_min(F.transform("sets", lambda s: s["component"])).alias("c_lo"),
        F.array_max(F.transform("sets", lambda s: s["component"])).alias("c_hi"),
        values.alias("somes"), values.alias("everys"))
    levels = [saved(_combined(nodes))]
    while not levels[-1].filter("node > 0").isEmpty():
        up = levels[-1].groupBy("mark", F.col("parent").alias("node")).agg(
            F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"), F.min("c_lo").alias("c_lo"),
            F.max("c_hi").alias("c_hi"), F.collect_list("some").alias("somes"), F.collect_list("every").alias("everys"))
        levels.append(saved(_combined(up)))

    pairs = None
    for level in reversed(levels):
        x, y = (level.select("mark", *(F.col(c).alias(f"{c}_{s}") for c in level.columns if c != "mark")) for s in "xy")
        if pairs is None:  # one root a group
            pairs = x.join(y, "mark")
        else:
            pairs = pairs.select("mark", F.col("node_x").alias("parent_x"), F.col("node_y").alias("parent_y")).join(
                x, ["mark", "parent_x"]).join(y, ["mark", "parent_y"])
        pairs = saved(pairs.filter(F.col("node_x") <= F.col("node_y")).filter(_possible(percent)).select(
            "mark", "node_x", "node_y"))
    return pairs


def _combined(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's number, and the OR (``some``) and AND (``every``) of their parts' bitmaps."""

    @F.arrow_udf("struct<some:binary,every:binary>")
    def combine(somes: pa.Array, everys: pa.Array) -> pa.Array:
        some, every = [], []
        for parts, alls in zip(somes.to_pylist(), everys.to_pylist(), strict=True):
            size = min(map(len, [*parts, *alls]))
            some.append(np.bitwise_or.reduce([folded(p, size) for p in parts]).tobytes())
            every.append(_and(alls, size))
        return pa.StructArray.from_arrays([pa.array(some, pa.binary()), pa.array(every, pa.binary())], names=["some", "every"])

    return nodes.withColumn("made", combine("somes", "everys")).select(
        "mark", "node", "n_lo", "n_hi", "c_lo", "c_hi", "made.some", "made.every",
        F.floor(F.col("node") / FANOUT).alias("parent"))


def _and(parts: list[bytes], size: int) -> bytes:
    """AND of bitmaps; folded bits say "some token", which an AND of whole sets allows."""
    return np.bitwise_and.reduce([folded(p, size) for p in parts]).tobytes()


def _possible(percent: int) -> Column:
    """Whether two nodes can hold a link between components."""

    @F.arrow_udf("boolean")
    def overlaps(ns: pa.Array, sx: pa.Array, ex: pa.Array, sy: pa.Array, ey: pa.Array) -> pa.Array:
        out = []
        for total, some_x, every_x, some_y, every_y in zip(*(x.to_pylist() for x in (ns, sx, ex, sy, ey)), strict=True):
            size = min(len(some_x), len(some_y))
            some_x, every_x, some_y, every_y = (folded(b, size) for b in (some_x, every_x, some_y, every_y))
            apart = np.bitwise_count(every_x & ~some_y).sum() + np.bitwise_count(every_y & ~some_x).sum()
            out.append(bool(apart <= allowed_difference(total, percent)))
        return pa.array(out, pa.bool_())

    one = (F.col("c_lo_x") == F.col("c_hi_x")) & (F.col("c_lo_x") == F.col("c_lo_y")) & (
        F.col("c_lo_y") == F.col("c_hi_y"))
    sizes = (F.col("n_lo_x") * percent <= F.col("n_hi_y") * 100) & (F.col("n_lo_y") * percent <= F.col("n_hi_x") * 100)
    return ~one & sizes & overlaps(F.col("n_hi_x") + F.col("n_hi_y"), "some_x", "every_x", "some_y", "every_y")


def _close_sets(xs: list[dict], ys: list[dict], percent: int) -> tuple[list[int], list[int]]:
    """Pairs of sets of two leaves that sizes and bitmaps leave possible, across components.

    Linked sets' bitmaps differ by few lengths, so each two lengths meet by themselves.
    """
    a, b = [], []
    parts_x, parts_y = ({k: [s for s in side if len(s["bits"]) == k] for k in {len(s["bits"]) for s in side}}
                        for side in (xs, ys))
    for k, some in parts_x.items():
        for other, more in parts_y.items():
            if xs is ys and other < k:
                continue  # met the other way round
            i, j = _close_rows(some, more, min(k, other), percent, xs is ys and other == k)
            a += np.minimum(i, j).tolist()
            b += np.maximum(i, j).tolist()
    return a, b


def _close_rows(xs: list[dict], ys: list[dict], size: int, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these pairs among sets that are compared with ``size`` bytes."""
    n_x, n_y = (np.array([s["n"] for s in side])[:, None] for side in (xs, ys))
    c_x, c_y = (np.array([s["component"] for s in side])[:, None] for side in (xs, ys))
    id_x, id_y = (np.array([s["id"] for s in side]) for side in (xs, ys))
    fits = (np.minimum(n_x, n_y.T) * 100 >= percent * np.maximum(n_x, n_y.T)) & (c_x != c_y.T)
    if not fits.any():
        return id_x[:0], id_y[:0]
    x, y = (np.stack([folded(s["bits"], size) for s in side]) for side in (xs, ys))
    for i in range(len(xs)):
        fits[i] &= np.bitwise_count(x[i] ^ y).sum(axis=1) <= allowed_difference(n_x[i] + n_y[:, 0], percent)
    i, j = np.nonzero(np.triu(fits) if same else fits)
    return id_x[i], id_y[j]
