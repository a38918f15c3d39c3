"""Dictionary-encoded blocks of rows: look up the distinct values of many lists in a table.

A block is an Arrow batch of rows.  Its lists become codes into the block's own list of
distinct values; only those values meet the table, and the found values come back as one
array per block.  Nothing is exploded per list element, and what is shuffled is a code
per element and the distinct values of each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from affectlake.session import saved

ROWS_OUT = 2_000


def encoded_blocks(df: DataFrame, keys: Sequence[str], values: Column) -> DataFrame:
    """``(block, rows, sizes, codes, entries, counts)``, one row per block, written once.

    ``rows`` holds the keys of the block's rows, ``sizes`` their lists' lengths, ``codes``
    all their elements as places in ``entries``, ``counts`` how often each entry occurs.
    A null list is an empty one.
    """
    source = df.select(F.struct(*keys).alias("row"), values.alias("values"))
    element = source.schema["values"].dataType.elementType
    schema = T.StructType.fromDDL("block bigint, sizes array<int>, codes array<int>, counts array<bigint>")
    schema = schema.add("rows", T.ArrayType(source.schema["row"].dataType)).add("entries", T.ArrayType(element))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for at, batch in enumerate(batches):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            sizes = np.diff(lists.offsets.to_numpy())
            sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
            codes = coded.indices.to_numpy()
            columns = [_one(pa.array(x)) for x in (
                sizes.astype(np.int32), codes.astype(np.int32), np.bincount(codes, minlength=len(coded.dictionary)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + at]), *columns, _one(batch.column(0)), _one(coded.dictionary)], names=schema.names)

    return saved(source.mapInArrow(run, schema))


def _one(values: pa.Array) -> pa.ListArray:
    """All values as a single list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def with_found(blocks: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """Blocks with the array ``found``: ``value`` of each entry, null for entries without one.

    ``entries`` holds ``(block, at, value)`` of the blocks' entries.
    """
    pair = F.struct("at", F.col(value).alias("value"))
    found = entries.groupBy("block").agg(F.array_sort(F.collect_list(pair))["value"].alias("found"))
    return blocks.drop("entries", "counts").join(found, "block", "left")


def listed_entries(blocks: DataFrame, name: str) -> DataFrame:
    """``(block, at, name)`` of every block's distinct values."""
    return blocks.select("block", F.posexplode("entries").alias("at", name))


def expanded(blocks: DataFrame, fields: str, make: Callable, chosen: str = "row.*") -> DataFrame:
    """Rows again: ``make(sizes, codes, found)`` gives the place of each result's row and the columns of ``fields``."""
    row = blocks.schema["rows"].dataType.elementType
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([T.StructField("row", row), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sizes, codes, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                if not len(rows.values):
                    continue
                known = found.values if found.is_valid else pa.nulls(0, batch.column(3).type.value_type)
                place, columns = make(sizes.values.to_numpy(), codes.values.to_numpy(), known)
                out = pa.RecordBatch.from_arrays([rows.values.take(pa.array(place)), *columns], names=schema.names)
                for at in range(0, out.num_rows, ROWS_OUT):
                    yield out.slice(at, ROWS_OUT)

    return blocks.select("rows", "sizes", "codes", "found").mapInArrow(run, schema).select(chosen, *made.names)
