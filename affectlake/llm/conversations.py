"""Preference formatting: one prompt for the turns two conversations share, two masked completions.

DataFrame functions only.  A pair is a chosen and a rejected conversation.  Turns that
are equal in role and text from the first turn on are rendered once as the prompt; what
follows is rendered per side.  The mask of a completion lists the spans of its assistant
texts, ``start:end`` in code points of the completion, joined by ``;``: those are the
spans a loss would count.

Defined results: a turn without conversation id belongs to none and is left out; null
roles and texts read as empty; an equal turn row given twice counts once; turns with
equal numbers follow by role and text; a side that is missing has a null id and an
empty completion, and then nothing is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _rendered(turn: Column) -> Column:
    head, tail = OPEN.split("{}")
    return F.concat(F.lit(head), turn["role"], F.lit(tail), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Spans of trained texts, by one pass that carries the length rendered so far."""
    head, tail = OPEN.split("{}")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + len(head) + F.length(turn["role"]) + len(tail)
        end = begin + F.length(turn["text"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(
            (end + len(CLOSE)).cast("long").alias("at"),
            F.when(turn["role"] == TRAINED_ROLE, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"]).alias("spans"),
        )

    return F.array_join(F.aggregate(turns, start, step)["spans"], ";")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Format turns ``(pair_id, side, conv_id, turn, role, text)``, side ``chosen`` or ``rejected``.

    One row per pair: ``pair_id, chosen_id, rejected_id, n_shared, prompt, chosen,
    rejected, chosen_mask, rejected_mask``.  Rows of a pair meet in one group, which is
    as large as two conversations.
    """
    item = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )

    def side(name: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("side") == name, item)))

    def id_of(name: str) -> Column:
        return F.min(F.when(F.col("side") == name, F.col("conv_id")))

    pairs = turns.filter("conv_id is not null").groupBy("pair_id").agg(
        id_of("chosen").alias("chosen_id"), id_of("rejected").alias("rejected_id"),
        side("chosen").alias("a"), side("rejected").alias("b"),
    )
    either = F.least(F.size("a"), F.size("b"))
    same = F.transform(
        F.slice(F.arrays_zip("a", "b"), F.lit(1), either),
        lambda x: (x["a"]["role"] == x["b"]["role"]) & (x["a"]["text"] == x["b"]["text"]),
    )
    first_other = F.array_position(same, False)
    shared = F.when(first_other > 0, first_other - 1).otherwise(either).cast("long")
    cut = pairs.withColumn("n_shared", shared)
    rest = {
        name: F.slice(F.col(name), (F.col("n_shared") + 1).cast("int"), F.greatest(F.size(name), F.lit(1)))
        for name in ("a", "b")
    }
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", "n_shared",
        _text(F.slice("a", F.lit(1), F.col("n_shared").cast("int"))).alias("prompt"),
        _text(rest["a"]).alias("chosen"), _text(rest["b"]).alias("rejected"),
        _mask(rest["a"]).alias("chosen_mask"), _mask(rest["b"]).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pair conversations 2k and 2k + 1: the even one as chosen, the odd one as rejected.

    The table has no preferences, so neighbours by id stand in for them.  Every
    conversation is in exactly one pair, and no key gathers more than two.
    """
    return conversations.select(
        F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "conv_id", "turn", "role", "text",
    )
