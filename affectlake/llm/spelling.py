"""Spelling variants: words that differ by one replaced, inserted or deleted code point.

Words are marked with a terminator and all their rotations are sorted.  A rotation that
ends in the character ``c`` stands for the word ``x c y`` turned to ``y $ x c``; the
words that agree in the prefix ``y $ x`` differ in that character only, and the word
``x y``, whose own rotation is that prefix, lacks it.  So every range of rotations with a
common prefix holds words near to each other, at most one per character of the alphabet
and one without it.  Ranges are scanned once and give each member the number of its
neighbours there and the most frequent of them; pairs are never written.

A character inside a run of equal ones can be left out at several places with the same
result; only the first place counts, so every pair is counted once.

Defined results: a null or empty text has no words; repeated rows are counted each; ties
for the form go to the smaller word in code-point order; an empty table gives no rows;
other columns are not read; a text of any length is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from affectlake.llm.common import bound_batches, join_hot, roots
from affectlake.session import saved

# The contract's runs, of lower-cased texts, and its typing slips.
RUN = re.compile("[a-zÀ-ÿ]+")
SLIP = 199
LEAST_CHARS, LEAST_COUNT, FORM_RATIO = 6, 5, 5

TERMINATOR = "$"
HELD = 500_000  # distinct words a task counts before it sends them on


def slipped(run: str, digest: int) -> str:
    """The run with a code point left out, if its digest says so."""
    if digest % SLIP:
        return run
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(word, n)`` of all words of ``least_chars`` code points and ``least_count`` occurrences."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                own = Counter(RUN.findall((text or b"").lower().decode()))  # bytes: A-Z only
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in own.items():
                    if len(run) >= least_chars:
                        word = slipped(run, zlib.crc32(run.encode(), start))
                        if len(word) >= least_chars:
                            held[word] += n
                if len(held) > HELD:
                    yield send()
        yield send()

    found = texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``(prefix, ending, first, word, n)``: each rotation without its ending, and each whole one.

    ``ending`` is null for whole rotations; ``first`` says that the character before the
    ending, in the word, is another one.
    """
    size = F.char_length("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    head, tail = F.expr("left(word, at)"), F.expr("substring(word, at + 1)")
    whole = places.select(F.concat(tail, F.lit(TERMINATOR), head).alias("prefix"), F.lit(None).cast("string").alias("ending"),
                          F.lit(False).alias("first"), "word", "n")
    ending, before = F.expr("substring(word, at, 1)"), F.expr("substring(word, at - 1, 1)")
    turned = places.filter("at > 0").select(
        F.concat(tail, F.lit(TERMINATOR), F.expr("left(word, at - 1)")).alias("prefix"), ending.alias("ending"),
        ((F.col("at") == 1) | (before != ending)).alias("first"), "word", "n")
    return whole.unionByName(turned)


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words that have near ones, from the sorted rotations."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
            prefix = table.column("prefix")
            fresh = np.append(True, pc.not_equal(prefix[1:], prefix[:-1]).to_numpy()) if table.num_rows else np.zeros(0, bool)
            last = int(np.flatnonzero(fresh)[-1]) if len(fresh) else 0
            left = table.slice(last)
            yield from _ranges(table.slice(0, last), fresh[:last])
        if left is not None and left.num_rows:
            yield from _ranges(left, np.append(True, np.zeros(left.num_rows - 1, bool)))

    partial = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix", "ending").mapInArrow(
        scan, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return partial.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _ranges(table: pa.Table, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per member of every range of two or more: near words not counted elsewhere, and the best one."""
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(fresh)))
    group = np.repeat(np.arange(len(starts)), sizes)
    wanted = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if not len(wanted):
        return
    table, group = table.take(pa.array(wanted)), group[wanted]
    group = np.cumsum(np.append(0, np.diff(group) != 0))
    n, words = table.column("n").to_numpy(), table.column("word")
    whole = table.column("ending").is_null().to_numpy(zero_copy_only=False) if table.num_rows else None
    first = table.column("first").to_numpy()
    wholes, firsts, members = (np.bincount(group, weights=w).astype(np.int64) for w in (whole, first, ~whole))
    near = np.where(whole, firsts[group], members[group] - 1 + wholes[group] * first)
    # Best of the range, and the second for the best itself: by falling count, then by word.
    order_of_word = np.empty(len(n), np.int64)
    order_of_word[pc.sort_indices(words).to_numpy()] = np.arange(len(n))
    order = np.lexsort((order_of_word, -n, group))
    heads = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    best, second = order[heads][group], order[heads + 1][group]
    other = np.where(best == np.arange(len(n)), second, best)
    yield from pa.Table.from_arrays(
        [words, pa.array(near), pa.array(n[other]), words.take(pa.array(other))],
        names=["word", "near", "best_n", "best"]).combine_chunks().to_batches()


def group(words: DataFrame, form_ratio: int = FORM_RATIO) -> DataFrame:
    """``(word, n, form, form_n, n_near, root)`` of every word of a vocabulary ``(word, n)``."""
    words = saved(words.select("word", "n"))
    near = neighbours(words)
    good = F.col("best_n") >= F.col("n") * form_ratio
    formed = saved(words.join(near, "word", "left").select(
        "word", "n", F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near")))
    last = roots(formed.filter("form is not null").select(F.col("form").alias("parent"), F.col("word").alias("child")))
    return formed.join(last.withColumnsRenamed({"node": "word", "component": "root"}), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))
