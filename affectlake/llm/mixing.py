"""Mixing sources to target weights, by distributed prefix sums over hash-random keys.

DataFrame functions only.  Sizes are words; a source's target is its share of all
words by weight, held at ``max_epochs`` times its own size, and what it cannot take
is shared again by weight among the others (water filling).

Each source's documents are ordered by an md5 key.  Keys are cut into ranges of
about ROWS_PER_RANGE rows, whatever the source's size, so a source with a third of
all rows has a third of all ranges.  A range's word count is an ordinary aggregate;
the running sum over ranges gives every range its offset, and rows are sorted inside
their range only.  The budget is met to the word: whole epochs first, then documents
in key order, the last one in part.

Defined results: null or empty text has size 0 and takes 0; a null source is a source
of its own, ordered last; rows that repeat each count; rows that are equal in key, id
and size are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from affectlake.llm.common import NON_SPACE_PATTERN
from affectlake.operators.ranking import small_join
from affectlake.session import saved

ROWS_PER_RANGE = 2_000
KEY_DIGITS = 12


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE_PATTERN)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """md5 of seed, id and text: the same order on every run and layout."""
    return F.md5(F.concat_ws(
        "|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    ))


def source_targets(sizes: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """``(source, source_size, n_rows, target)`` from rows of ``(source, size, n)``.

    One row per source.  Sources are ordered by code point, null last, and take the
    weights in turn.  With sources in order of ``max_epochs * size / weight``, the
    held ones come first; ``level`` is what a unit of weight gets if exactly the
    sources before this one are held.  From the first source that its level does not
    fill, levels only fall, so the greatest such level is the one that holds.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    cap = max_epochs * F.col("source_size")
    ranked = per_source.select("*", weight.alias("weight"), cap.alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(
        "double") / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return levels.withColumn("final", final).select(
        "source", "source_size", "n_rows",
        F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, weights: list[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per row of ``docs``."""
    rows = saved(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        random_key(F.col(id_col), F.col(text_col), seed).alias("key"),
    ).groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")))
    targets = saved(source_targets(rows, list(weights), max_epochs))

    # A range is a slice of the key space; as many slices as the source has rows for.
    slot = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("long") / F.lit(16.0**KEY_DIGITS)
    ranges = F.ceil(F.col("n_rows") / ROWS_PER_RANGE)
    placed = small_join(rows, targets, ["source"], "inner").select(
        "*", F.floor(slot * ranges).alias("range"), F.floor(F.col("target") + 0.5).cast("long").alias("budget")
    )
    ordered = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words")).select(
        F.col("source").alias("s"), F.col("range").alias("r"),
        F.coalesce(F.sum("words").over(ordered), F.lit(0)).alias("offset"),
    )
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    whole = F.coalesce(F.floor(F.col("budget") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    copies = placed.withColumn("start", start).withColumn("epochs", whole).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    )
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("copy") * F.col("size")
    return copies.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", left))).cast("long").alias("taken"),
    )
