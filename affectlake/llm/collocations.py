"""Collocations: phrases that occur more often than their parts suggest, per language.

Words are counted first, then phrases of 2, 3, ... words, level by level:

1. A phrase can be frequent only if both phrases of one word less in it are.  A bitmap of
   fixed size over the keys of the frequent ones tells which positions are worth a look,
   and a sketch of saturated counters over those positions tells which keys can reach
   ``min_count``: tasks send the counters they met, and bits of fixed size come back.
   Neither ever says no to a frequent phrase.
2. Tasks list the phrases that pass, with how often they met them, packed by shard.  Phrases
   whose sum is too small cannot be frequent.  The others are the shard's candidates; they
   are made into double-array tries of at most BLOCK phrases.
3. The lists of a shard advance through its tries letter by letter, and the accepting states
   add up how often their phrases were met.

So a level reads the texts twice whatever the number of its frequent phrases, no trie is
broadcast, and what a task holds of a shard does not grow with the input.

Words are 64-bit hashes of language and word.  The table of all words shows whether two
words share one; then everything is hashed anew with another seed, so counts are exact.

Defined results: a null text is empty; a null language is ``und``; empty texts, and
texts of separators only, have no words; rows that repeat are counted each; ties are
broken by the phrase's bytes; an empty table gives no rows; very long texts are read in
blocks, and a word of any length is one word; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from affectlake.llm import double_array
from affectlake.llm.common import bound_batches, join_hot
from affectlake.llm.pieces import byte_table, phrase_keys, phrase_starts, words_of
from affectlake.session import saved

# The contract's separators of words and of pieces.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
TABLE = byte_table(BLANKS, BREAKS)

BITMAP_BITS = 25  # log2 of the bits that say "may be frequent"
PLACE_BITS = 32  # log2 of the saturated counters
SLICE_BITS = 9  # log2 of their slices
MARK_BITS = 27  # log2 of the bits that say "a counter here reaches the threshold"
HELD_PLACES = 1 << 21  # counters that a task holds before it sends them on
HELD_WORDS = 150_000  # distinct words, and phrases, that a task holds before it sends them on
HELD_PHRASES = 300_000
ROWS_SENT = 50_000
SHARDS = 4
BLOCK = 1_000_000  # phrases of a trie
TOP_GROUPS = 64
SEEDS = 8

UNKNOWN = "und"


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, contained_percent: int = 50,
    text_col: str = "text", lang_col: str = "lang", block: int = BLOCK,
) -> DataFrame:
    """``(lang, phrase, words, a, l, r, n, score)`` of every candidate not inside a longer one.

    ``a``: the phrase's count, ``l`` and ``r``: those of the parts at its lowest-scoring
    cut, ``n``: all words of the language, ``score``: ``floor(1000000 a a / (l r))``.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, seed = _words(texts)
    levels = [saved(words.filter(F.col("n") >= min_count).select(F.array("key").alias("ws"), "key", "n"))]
    for size in range(2, max_words + 1):
        levels.append(_level(texts, seed, levels[-1], size, min_count, block))
    counts, candidates = levels[0], None
    for level in levels[1:]:
        counts = counts.unionByName(level)
        candidates = level if candidates is None else candidates.unionByName(level)
    scored = saved(_scored(_outer(candidates, max_words, contained_percent), counts))
    return _spelled(scored, words)


def ranked(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` phrases of every language, with ``rank`` from 1.

    They are chosen in TOP_GROUPS groups of a language first, so the last choice reads
    that many times ``first`` rows at most, whatever a language's share.
    """
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(TOP_GROUPS))
    inside = F.row_number().over(Window.partitionBy("lang", "group").orderBy(*best))
    few = found.withColumn("group", group).withColumn("rank", inside).filter(F.col("rank") <= first).drop("group")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    return few.withColumn("rank", place).filter(F.col("rank") <= first).withColumn("rank", F.col("rank").cast("bigint"))


def _scan(texts: DataFrame, seed: int, reach: int, schema: str, start: Callable) -> DataFrame:
    """What ``start()``, run per task, makes of the texts: ``(each, end)``.

    ``each(words, langs)`` takes a block of words, ``end()`` what is left; both give
    Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, end = start()
        salts_of: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in langs:
                if lang not in salts_of:
                    salts_of[lang] = xxhash.xxh3_64_intdigest(lang.encode(), seed)
            salts = np.array([salts_of[lang] for lang in langs], np.uint64)
            for block in words_of(batch.column(1).cast(pa.large_binary()).to_pylist(), TABLE, salts, reach):
                yield from each(block, langs)
        yield from end()

    return texts.select("lang", "text").mapInArrow(run, schema)


def _words(texts: DataFrame) -> tuple[DataFrame, int]:
    """``(key, lang, word, n)`` of all words, and the seed under which no two share a key."""

    def start():
        counts: dict[int, int] = {}
        spelled: dict[int, tuple[str, bytes]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            langs, words = zip(*spelled.values(), strict=True)
            yield from _sliced([
                pa.array(list(counts), pa.int64()), pa.array(langs, pa.string()),
                pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["key", "lang", "word", "n"])
            counts.clear()
            spelled.clear()

        def each(words, langs):
            keys, first, n = np.unique(words.hashes.view(np.int64), return_index=True, return_counts=True)
            for key, at, k in zip(keys.tolist(), first.tolist(), n.tolist(), strict=True):
                if key in counts:
                    counts[key] += k
                else:
                    counts[key] = k
                    spelled[key] = (langs[words.owners[at]], words.word(at))
            if len(counts) > HELD_WORDS:
                yield from send()

        def end():
            if counts:
                yield from send()

        return each, end

    for seed in range(SEEDS):
        found = _scan(texts, seed, 0, "key bigint, lang string, word string, n bigint", start)
        # A task's words are combined before they leave it, so they are dealt by key at once.
        spelled = found.repartition("key").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
        words = saved(spelled.groupBy("key").agg(
            F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"), F.count("*").alias("spellings")))
        if words.filter("spellings > 1").isEmpty():
            return words.drop("spellings"), seed
    raise RuntimeError("no seed parts the words of this table")


def _sliced(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, ROWS_SENT):
        yield whole.slice(at, ROWS_SENT)


def _level(texts: DataFrame, seed: int, below: DataFrame, size: int, min_count: int, block: int) -> DataFrame:
    """``(ws, key, n)`` of all phrases of ``size`` words with ``min_count`` or more occurrences."""
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(_bitmap(below.select("key")))

    def promising(words) -> tuple[np.ndarray, np.ndarray]:
        """Starts of phrases whose parts may be frequent, and the phrases' keys."""
        starts = phrase_starts(words, size)
        for at in (0, 1):
            part = phrase_keys(words.hashes, starts + at, size - 1)
            starts = starts[_marked(frequent.value, part)]
        return starts, phrase_keys(words.hashes, starts, size)

    sketch = spark.sparkContext.broadcast(_sketch(texts, seed, size, min(min_count, 255), promising))
    counted = _counted(texts, seed, size, promising, sketch, min_count, block)
    frequent.destroy()
    sketch.destroy()
    return counted


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit per place, set if some key falls there."""
    place = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.expr(
        "shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    size = np.uint64(len(bits) * 64 - 1)
    place = (keys & size).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def _sketch(texts: DataFrame, seed: int, size: int, least: int, promising: Callable) -> np.ndarray:
    """A bit per MARK_BITS of a key, set if a counter under it reaches ``least``.

    There is a counter for every PLACE_BITS of a key, so that they stay apart in large
    inputs.  Tasks send the counters that they met, up to 255 of each, by slices; one task
    holds a slice at a time, and gives bits of fixed size.
    """

    def start():
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            places, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            ends = np.searchsorted(places, np.arange(1 << SLICE_BITS, dtype=np.uint64) << np.uint64(PLACE_BITS - SLICE_BITS))
            parts = zip(np.split(places, ends[1:]), np.split(np.minimum(n, 255).astype(np.uint8), ends[1:]), strict=True)
            packed = [(at, _packed(*part)) for at, part in enumerate(parts) if len(part[0])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at for at, _ in packed]), pa.array([x for _, x in packed], pa.binary())], names=["slice", "counters"])

        def each(words, langs):
            held.append((promising(words)[1] >> np.uint64(64 - PLACE_BITS)).astype(np.uint32))
            if sum(map(len, held)) > HELD_PLACES:
                yield from send()

        def end():
            if sum(map(len, held)):
                yield from send()

        return each, end

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked() -> pa.RecordBatch:
            bits = (total.reshape(-1, 1 << (PLACE_BITS - MARK_BITS)) >= least).any(axis=1)
            bits = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits], pa.binary())], names=["slice", "bits"])

        now, total = None, None
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    if now is not None:
                        yield marked()
                    now, total = at, np.zeros(1 << (PLACE_BITS - SLICE_BITS), np.int32)
                places, n = _unpacked(part)
                total[places] = np.minimum(total[places] + n, 255)
        if now is not None:
            yield marked()

    slices = _scan(texts, seed, size - 1, "slice bigint, counters binary", start)
    reached = slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(reach, "slice bigint, bits binary")
    out = np.zeros((1 << SLICE_BITS, (1 << (MARK_BITS - SLICE_BITS)) // 8), np.uint8)
    for row in reached.toArrow().to_pylist():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel().view(np.int64)


def _packed(places: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places of one slice and their counts: byte by byte of the steps between them."""
    steps = np.diff(places & np.uint32((1 << (PLACE_BITS - SLICE_BITS)) - 1), prepend=np.uint32(0)).astype(np.uint32)
    return zlib.compress(np.concatenate([steps.view(np.uint8).reshape(-1, 4).T.ravel(), n]).tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(5, -1)
    steps = np.ascontiguousarray(rows[:4].T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.int64), rows[4].astype(np.int32)


def _columns(size: int) -> list[str]:
    return [f"w{i}" for i in range(size)]


def _counted(
    texts: DataFrame, seed: int, size: int, promising: Callable, sketch, min_count: int, block: int,
) -> DataFrame:
    """``(ws, key, n)``: the frequent phrases.

    A task packs its phrases and how often it met them into one row per shard, by the
    phrases' keys.  The rows of a shard meet in one task, which makes tries of those that
    can be frequent and counts with them.  There are SHARDS shards per task of the scan, so
    a shard does not grow with the input.
    """
    names = [*_columns(size), "key", "n"]
    shards = SHARDS * max(1, texts.rdd.getNumPartitions())

    def start():
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            shard = (rows[:, -2] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            first = np.flatnonzero(np.diff(shard[order], prepend=-1))
            packs = [part.tobytes() for part in np.split(rows[order], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][first]), pa.array(packs, pa.binary())], names=["shard", "pack"])

        def each(words, langs):
            starts, keys = promising(words)
            sure = _marked_high(sketch.value, keys)
            starts, keys = starts[sure], keys[sure]
            if not len(keys):
                return
            ones = np.ones(len(keys), np.uint64)
            held.append(_combined(np.stack([*(words.hashes[starts + i] for i in range(size)), keys, ones], axis=1)))
            if sum(map(len, held)) > 2 * HELD_PHRASES:
                held[:] = [_combined(np.concatenate(held))]
                if len(held[0]) > HELD_PHRASES:
                    yield from send()

        def end():
            if held:
                held[:] = [_combined(np.concatenate(held))]
                yield from send()

        return each, end

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            found = _tallied(rows, _candidates(rows, min_count), size, block)
            found = found[found[:, -1] >= min_count]
            yield from _sliced([pa.array(c) for c in found.view(np.int64).T.copy()], names)

        now, held = None, []
        for batch in batches:
            for shard, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now and held:
                    yield from frequent()
                    held = []
                now = shard
                held.append(np.frombuffer(pack, np.uint64).reshape(-1, size + 2))
                if sum(map(len, held)) > 2 * max(HELD_PHRASES, len(held[0])):
                    held = [_summed(np.concatenate(held))]
        if held:
            yield from frequent()

    packs = _scan(texts, seed, size - 1, "shard bigint, pack binary", start)
    added = packs.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, ", ".join(f"{c} bigint" for c in names))
    return saved(added.select(F.array(*_columns(size)).alias("ws"), "key", "n"))


def _candidates(rows: np.ndarray, min_count: int) -> np.ndarray:
    """The distinct phrases ``(words, key)`` whose counts reach ``min_count`` together."""
    rows = _summed(rows)
    return rows[rows[:, -1] >= min_count, :-1]


def _tallied(rows: np.ndarray, candidates: np.ndarray, size: int, block: int) -> np.ndarray:
    """Candidates ``(words, key, n)`` with how often the rows ``(words, key, times)`` met them.

    The rows are walked through a trie per ``block`` candidates.
    """
    hashes, times = np.ascontiguousarray(rows[:, :size]).ravel(), np.repeat(rows[:, -1].astype(np.int64), size)
    starts, counts = np.arange(len(rows)) * size, np.zeros(len(candidates), np.int64)
    for at in range(0, len(candidates), block):
        trie = double_array.build(np.ascontiguousarray(candidates[at : at + block, :size]))
        double_array.tally(trie, counts[at : at + block], hashes, starts, times)
    return np.column_stack([candidates, counts.astype(np.uint64)])


def _summed(rows: np.ndarray) -> np.ndarray:
    """Distinct rows with the sums of their last column, in the order of all their columns."""
    rows = rows[np.lexsort(rows[:, :-1].T)]
    first = np.flatnonzero(np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)))
    out = rows[first]
    out[:, -1] = np.add.reduceat(rows[:, -1], first)
    return out


def _marked_high(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def _combined(rows: np.ndarray) -> np.ndarray:
    """Rows sorted by key, the last column but one; equal ones are one row with the sum of their counts.

    Different rows with one key all stay; so may a few equal ones between them.
    """
    rows = rows[np.argsort(rows[:, -2], kind="stable")]
    first = np.flatnonzero(np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1))[: len(rows)])
    out = rows[first]
    if len(first):
        out[:, -1] = np.add.reduceat(rows[:, -1], first)
    return out


def _outer(candidates: DataFrame, max_words: int, percent: int) -> DataFrame:
    """Candidates that no longer one with at least ``percent`` of their count holds."""
    size = F.size("ws")

    def inner(length: int) -> Column:
        return F.when(size > length, F.transform(
            F.sequence(F.lit(1), size - length + 1), lambda i: F.slice("ws", i, length)))

    if max_words < 3:
        return candidates
    parts = F.flatten(F.filter(F.array(*(inner(n) for n in range(2, max_words))), F.isnotnull))
    longer = candidates.filter(size > 2).select("n", F.explode(F.array_distinct(parts)).alias("ws")).groupBy("ws").agg(
        F.max("n").alias("outer"))
    return candidates.join(longer, "ws", "left").filter(
        F.col("outer").isNull() | (F.col("outer").cast("decimal(20,0)") * 100 < F.col("n").cast("decimal(20,0)") * percent)
    ).select("ws", "key", "n")


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``(ws, a, l, r, score)`` at the lowest-scoring cut; ties go to the earlier one."""
    size = F.size("ws")
    cuts = phrases.select("ws", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    parts = saved(cuts.select("ws", "a", "cut", F.posexplode(F.array(
        F.slice("ws", 1, F.col("cut")), F.slice("ws", F.col("cut") + 1, size))).alias("side", "part")))
    known = counts.select(F.col("ws").alias("part"), F.col("n").alias("f"))
    counted = saved(parts.groupBy("part").agg(F.count("*").alias("k")).join(known, "part"))
    both = join_hot(parts, counted, "part", "k", parts.count()).groupBy("ws", "a", "cut").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    # Up to 10^15 occurrences: products of two have 30 digits, and a million times that 36.
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r"))
    up, down = (a * a * F.lit(1_000_000).cast("decimal(7,0)")), l * r
    score = F.call_function("div", up, down).cast("bigint")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return both.groupBy("ws", "a").agg(best).select("ws", "a", "best.l", "best.r", "best.score")


def _spelled(scored: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with their words and language in place of keys."""
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    places = saved(scored.select("ws", F.posexplode("ws").alias("at", "key")))
    counted = saved(places.groupBy("key").agg(F.count("*").alias("k")).join(words.select("key", "lang", "word"), "key"))
    spelled = join_hot(places, counted, "key", "k", places.count()).groupBy("ws").agg(
        F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word")))["word"].alias("words"))
    return scored.join(spelled, "ws").join(totals, "lang").select(
        "lang", F.concat_ws(" ", "words").alias("phrase"), "words", "a", "l", "r", "n", "score")
