"""Token sequences: vocabulary, windows of ids, masks, decoding and a bigram loss.

Every token of every text is encoded.  A text longer than a window becomes several
windows; the vocabulary holds every token of the corpus and stays a table.  Texts become
dictionary-encoded blocks once; only a block's distinct tokens meet the vocabulary, and
ids are put in place of codes, so no token is exploded, sorted or grouped back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from affectlake.functions.vectors import shift_left
from affectlake.operators.blocks import encoded_blocks, expanded, listed_entries, with_found
from affectlake.operators.ranking import ranked_by
from affectlake.operators.stats import drop_empty
from affectlake.session import saved

# Special tokens and their ids; 0 is padding and is never a target.
SPECIAL_TOKENS = ("<pad>", "<unk>", "<s>", "</s>")
PAD, UNKNOWN, START, END = range(4)
WINDOW = 256
#: The most frequent tokens, which few texts lack, are looked up by broadcast.
FREQUENT = 2_000


def tokens(text: Column | str) -> Column:
    """Words of a cleaned text (single blanks between them)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, " "), lambda t: t != "")


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """``(token, token_id, n)`` of every token, by falling count and then token order.

    Ids follow the special ones.  The rank is exact and bucketed, so that no task sorts
    the whole vocabulary.
    """
    counts = saved(
        df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    )
    return _numbered(counts)


def _numbered(counts: DataFrame) -> DataFrame:
    key = F.concat(F.lpad((F.lit(10**18) - F.col("n")).cast("string"), 19, "0"), F.lit(" "), "token")
    ranked = ranked_by(counts.withColumn("__key", key), "__key", "__rank")
    return ranked.select("token", (F.col("__rank") + len(SPECIAL_TOKENS) - 1).alias("token_id"), "n")


def _looked_up(rows: DataFrame, vocab: DataFrame, key: str, value: str) -> DataFrame:
    """Left join of exploded rows with the vocabulary.

    The FREQUENT first ids are broadcast, a bounded table that takes the hot keys; each
    of the other tokens is too rare to make a task large, and is shuffled.
    """
    edge = FREQUENT + len(SPECIAL_TOKENS)
    frequent = F.broadcast(vocab.filter(F.col("token_id") < edge).select(key, value))
    rest = vocab.filter(F.col("token_id") >= edge).select(key, value)
    return rows.join(frequent, key).unionByName(
        rows.join(frequent.select(key), key, "left_anti").join(rest, key, "left")
    )


def token_blocks(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """All rows with text as dictionary-encoded blocks of tokens, written once."""
    return encoded_blocks(drop_empty(df, text), keys, tokens(text))


def block_vocabulary(blocks: DataFrame) -> DataFrame:
    """:func:`vocabulary` of the texts in blocks, from the blocks' own counts."""
    entries = blocks.select(F.inline(F.arrays_zip(F.col("entries").alias("token"), F.col("counts").alias("k"))))
    return _numbered(saved(entries.groupBy("token").agg(F.sum("k").alias("n"))))


def encode(df: DataFrame, vocab: DataFrame, keys: Sequence[str], window: int = WINDOW, text: str = "text") -> DataFrame:
    """``(*keys, window_no, input_ids, attention_mask)``: all tokens, in windows of ``window`` ids.

    A window holds a start mark, up to ``window - 2`` tokens, an end mark and padding.
    ``keys`` travel with their row, null or repeated ones too; rows without text are left
    out.  Tokens outside the vocabulary are ``<unk>``.
    """
    return encode_blocks(token_blocks(df, keys, text), vocab, window)


def encode_blocks(blocks: DataFrame, vocab: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`encode` for blocks: their distinct tokens meet the vocabulary, ids replace codes in place."""
    body = window - 2
    known = _looked_up(listed_entries(blocks, "token"), vocab, "token", "token_id")

    def windows(sizes: np.ndarray, codes: np.ndarray, found: pa.Array) -> tuple:
        ids = found.fill_null(UNKNOWN).to_numpy()[codes] if len(codes) else codes
        first = np.cumsum(sizes) - sizes
        parts = -(-sizes // body)
        begins = np.cumsum(parts) - parts
        place = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(place)) - begins[place]
        real = np.minimum(sizes[place] - number * body, body)
        out = np.full((len(place), window), PAD, np.int32)
        inside = np.arange(len(ids)) - np.repeat(first, sizes)
        out[np.repeat(begins, sizes) + inside // body, inside % body + 1] = ids
        out[:, 0] = START
        out[np.arange(len(place)), real + 1] = END
        mask = (np.arange(window) < (real + 2)[:, None]).astype(np.int32)
        ends = pa.array(np.arange(len(place) + 1, dtype=np.int32) * window)
        return place, [pa.array(number.astype(np.int64)), *(
            pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (out, mask))]

    return expanded(with_found(blocks, known, "token_id"),
                    "window_no bigint, input_ids array<int>, attention_mask array<int>", windows)


def decode(df: DataFrame, vocab: DataFrame, keys: Sequence[str], ids: str = "input_ids", special: bool = True) -> DataFrame:
    """``(*keys, text)``: the ids of every row back to a text.

    Special tokens are shown unless ``special`` is off; ids that nothing names are left out.
    """
    shown = F.col(ids) if special else F.filter(ids, lambda i: i >= len(SPECIAL_TOKENS))
    blocks = encoded_blocks(df, keys, F.transform(shown, lambda i: i.cast("bigint")))
    marks = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, token_id bigint")
    names = vocab.select("token", "token_id").unionByName(marks)
    known = _looked_up(listed_entries(blocks, "token_id"), names, "token_id", "token")

    def joined(sizes: np.ndarray, codes: np.ndarray, found: pa.Array) -> tuple:
        words = found.take(pa.array(codes))
        named = words.is_valid().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(named))[np.append(0, np.cumsum(sizes))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), words.drop_null())
        return np.arange(len(sizes)), [pc.binary_join(lists, " ")]

    return expanded(with_found(blocks, known, "token"), "text string", joined)


def bigram_counts(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """How often each target follows each token; target 0 is ignored.

    Counts combine before the shuffle, so a frequent pair costs one row per task.
    """
    pairs = F.arrays_zip(F.col(ids).alias("cur"), shift_left(ids).alias("target"))
    kept = F.filter(pairs, lambda e: e["target"] != PAD)
    return df.select(F.inline(kept)).groupBy("cur", "target").agg(F.count("*").alias("n"))


def bigram_loss(counts: DataFrame) -> DataFrame:
    """Mean cross-entropy of all targets under the counts' own model.

    With N occurrences of a token and n of a pair it is
    (sum N ln N - sum n ln n) / sum n: two aggregates, no window over a token's targets.
    """
    per_token = counts.groupBy("cur").agg(F.sum("n").alias("mass"), F.sum(F.col("n") * F.log("n")).alias("pairs"))
    mass = F.col("mass").cast("double")
    return per_token.agg(((F.sum(mass * F.log(mass)) - F.sum("pairs")) / F.sum(mass)).alias("lm_loss"))
