"""Lines that many documents share, dropped everywhere but in one document.

A line's key is the line without white space at its ends, A-Z lower-cased, as a 128-bit
hash.  Keys are counted once (documents that hold them, the largest id among them), and
the distinct ones are dealt by hash to shards of about KEYS_PER_SHARD.  A shard is a
minimal perfect hash with arrays of fingerprints, counts and largest ids, some 20 bytes a
key.  Documents do not meet lines in a join: a task packs the hashes of its documents into
one row per shard, the rows stream past the shard's arrays, and what comes back is the
hashes to drop, per document.  Only documents that drop something are shuffled.

The keys that hold more than one in HOT_SHARE of all occurrences (fewer than HOT_SHARE, by
count) ship with the tasks, so no shard has a hot line to answer for.

Whether a line goes depends on its key and its document's id only.  Defined results: a
null or empty text is one empty line; rows that share an id are one document when
documents are counted, and each keeps its row; rows without id are together one document,
below every id; a line that is repeated in the document with the largest id stays there as
often as it stands; an empty table gives no rows; other columns stay inside ``row``; a
text of any length is split whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from affectlake.llm import perfect_hash
from affectlake.llm.common import HOT_SHARE, arrow_map, bound_batches, maybe_in
from affectlake.session import saved

# The contract's white space.
SPACE = b" \t\n\x0b\x0c\r"

LEAST_CHARS, LEAST_DOCS = 20, 3
KEYS_PER_SHARD = 1 << 16
NO_ID = -(2**63)


def line_key(line: bytes, least_chars: int) -> tuple[int, int] | None:
    """Two signed longs for a line that is long enough."""
    key = line.strip(SPACE)
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode()) < least_chars:
        return None
    both = xxhash.xxh3_128_intdigest(key.lower())  # bytes: A-Z only
    return (both >> 64) - 2**63, (both & (2**64 - 1)) - 2**63


def line_counts(hashed: DataFrame) -> DataFrame:
    """``(low, high, n, last)`` per key: documents that hold it and the largest id."""
    repeated = saved(hashed.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"))
    # Only rows whose id is repeated can hold a key twice.
    again = maybe_in(repeated, "doc_id")("doc_id")
    keys = F.inline("keys")
    pairs = hashed.filter(~again).select("doc_id", keys).unionByName(hashed.filter(again).select("doc_id", keys).distinct())
    return pairs.groupBy("low", "high").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def drop_repeated(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
    id_col: str = "doc_id", text_col: str = "text", keys_per_shard: int = KEYS_PER_SHARD,
) -> DataFrame:
    """``(row, n_lines, n_dropped, kept)`` for every row of ``docs``."""
    named = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    hashed = saved(_hashed(named.select("doc_id", "text"), least_chars))
    counts = saved(line_counts(hashed))
    keys, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-keys // keys_per_shard))
    hot = {(r["low"], r["high"]): r["last"] for r in
           counts.filter((F.col("n") * HOT_SHARE > total) & (F.col("n") >= least_docs)).toArrow().to_pylist()}

    dropped = saved(_probed(hashed, _index(counts, shards), shards, least_docs, hot).groupBy("doc_id").agg(
        F.collect_set(F.struct("low", "high")).alias("drops")))
    marked = maybe_in(dropped, "doc_id")("doc_id")
    none = F.array().cast("array<struct<low:bigint,high:bigint>>").alias("drops")
    whole = named.filter(~marked).select("doc_id", "text", "row", none)
    # Always by shuffle, as at any other size: the lists to drop grow with the input.
    cut = named.filter(marked).join(dropped.hint("merge"), "doc_id", "left").select("doc_id", "text", "row", F.coalesce("drops", none).alias("drops"))
    fields = [("n_lines", "bigint", pa.int64()), ("n_dropped", "bigint", pa.int64()), ("kept", "string", pa.string())]
    work = partial(_cutter, least_chars, hot)
    out = [arrow_map(part, "text", work, fields, ["doc_id", "drops"]) for part in (whole, cut)]
    return out[0].unionByName(out[1]).select(F.col("row.row").alias("row"), "n_lines", "n_dropped", "kept")


def _hashed(texts: DataFrame, least_chars: int) -> DataFrame:
    """``(doc_id, keys)``: the distinct line keys of every row."""

    def work():
        def hash_all(batch: list, ids: list) -> tuple[list]:
            return ([[{"low": k[0], "high": k[1]} for k in {line_key(x, least_chars) for x in set((t or b"").split(b"\n"))} - {None}]
                     for t in batch],)

        return hash_all

    pair = pa.struct([("low", pa.int64()), ("high", pa.int64())])
    fields = [("keys", "array<struct<low:bigint,high:bigint>>", pa.list_(pair))]
    return arrow_map(texts, "text", work, fields, ["doc_id"]).select("row.doc_id", "keys")


def _index(counts: DataFrame, shards: int) -> DataFrame:
    """``(shard, part)``: per shard the perfect hash and its arrays, in the order of its numbers."""

    def make(table: pa.Table) -> pa.Table:
        low, high, n, last = (table.column(c).to_numpy() for c in ("low", "high", "n", "last"))
        hashed = perfect_hash.build(low.view(np.uint64), high.view(np.uint64))
        at = perfect_hash.number(hashed, low.view(np.uint64), high.view(np.uint64))
        prints, sums, lasts = np.empty(len(at), np.int64), np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
        prints[at], sums[at], lasts[at] = low, np.minimum(n, 2**32 - 1), last
        return pa.table({"shard": table.column("shard")[:1],
                         "part": pa.array([pickle.dumps((hashed.sizes, hashed.bits, hashed.before, prints, sums, lasts))], pa.binary())})

    return counts.withColumn("shard", F.pmod("high", F.lit(shards))).groupBy("shard").applyInArrow(
        make, "shard bigint, part binary")


def _probed(hashed: DataFrame, index: DataFrame, shards: int, least_docs: int, hot: dict) -> DataFrame:
    """``(doc_id, low, high)`` of the keys that go, except the hot ones."""
    bound_batches(hashed.sparkSession)
    hot_lows = np.array(sorted({low for low, _ in hot}), np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            ids = batch.column(0).to_numpy()[pc.list_parent_indices(lists).to_numpy()]
            low, high = (flat.field(i).to_numpy() for i in (0, 1))
            shard = high % shards
            order = np.argsort(shard, kind="stable")
            order = order[~np.isin(low[order], hot_lows)] if len(hot_lows) else order
            rows = np.stack([ids, low, high], axis=1)[order]
            starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
            parts = [p.tobytes() for p in np.split(rows, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[order][starts]), pa.array(parts, pa.binary())], names=["shard", "part"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrays = None, None
        for batch in batches:
            for shard, side, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if side == 0:
                    now, arrays = shard, pickle.loads(part)
                    continue
                if shard != now:  # no key of the shard is counted
                    continue
                *parts, prints, sums, lasts = arrays
                ids, low, high = np.frombuffer(part, np.int64).reshape(-1, 3).T
                at = perfect_hash.number(perfect_hash.PerfectHash(*parts), low.view(np.uint64), high.view(np.uint64))
                gone = (at >= 0) & (prints[at] == low) & (sums[at] >= least_docs) & (lasts[at] != ids)
                yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (ids, low, high)], names=["doc_id", "low", "high"])

    probes = hashed.select("doc_id", "keys").mapInArrow(pack, "shard bigint, part binary")
    both = index.withColumn("side", F.lit(0)).unionByName(probes.withColumn("side", F.lit(1)))
    return both.select("shard", "side", "part").repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(
        probe, "doc_id bigint, low bigint, high bigint")


def _cutter(least_chars: int, hot: dict):
    def cut(texts: list, ids: list, drops: list) -> tuple[list, list, list]:
        counts, gone, kept = [], [], []
        for text, doc_id, own in zip(texts, ids, drops, strict=True):
            lines = (text or b"").split(b"\n")
            listed = {(d["low"], d["high"]) for d in own}
            stays = lines
            if listed or hot:
                keys = {line: line_key(line, least_chars) for line in set(lines)}
                goes = {line for line, key in keys.items() if key in listed or hot.get(key, doc_id) != doc_id}
                stays = [line for line in lines if line not in goes] if goes else lines
            counts.append(len(lines))
            gone.append(len(lines) - len(stays))
            kept.append(b"\n".join(stays))
        return counts, gone, kept

    return cut
