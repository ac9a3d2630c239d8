"""Ordered computations within a key: pairing, change detection, forward fill, greedy packing.

Windows partition by session, file or user, whose size is bounded by one log; greedy packing streams
each key in order and holds one counter, so that a large key costs time but no memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomlark.session import ship


def over(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def latest_before(keys: list[str], order: list, value: Column) -> Column:
    """The last non-null value strictly before each row."""
    return F.last(value, ignorenulls=True).over(over(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def filled(keys: list[str], order: list, value: Column, default: str | None = None) -> Column:
    """Forward fill, the row itself included."""
    out = F.last(value, ignorenulls=True).over(over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out if default is None else F.coalesce(out, F.lit(default))


def changed(keys: list[str], order: list, value: Column) -> Column:
    """True where a non-null value differs from the last one before it."""
    return value.isNotNull() & ~value.eqNullSafe(latest_before(keys, order, value))


def open_call(keys: list[str], order: list, is_call: Column, call: Column) -> Column:
    """For each result among calls and results with the same keys: the call that it answers, else null. A result takes the row just before it if that is a
    call: an earlier call was superseded, and after a result none is open. So one window replaces the join and its self-product."""
    return F.lag(F.when(is_call, call)).over(over(keys, order))


def islands(keys: list[str], order: list, is_break: Column) -> Column:
    """Number of breaks up to and with each row."""
    return F.sum(F.when(is_break, 1).otherwise(0)).over(over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def greedy_chunks(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int, separator: int = 0, break_before: str | None = None, out: str = "chunk") -> DataFrame:
    """Number of the chunk (from 0 within the key) that each row falls in: rows join the open chunk while its sizes, plus ``separator`` for
    each row in it, stay within ``budget``; a larger row stands alone. ``break_before``: a boolean column that closes the chunk.

    One exchange by key, a sort within partitions, then a stream that holds a counter."""
    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField(out, IntegerType())])
    at = [rows.columns.index(k) for k in keys]
    size_at, break_at = rows.columns.index(size), rows.columns.index(break_before) if break_before else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, used, n = None, 0, 0, 0
        for batch in batches:
            found = []
            own = list(zip(*[batch.column(k).to_pylist() for k in at]))
            breaks = batch.column(break_at).to_pylist() if break_at is not None else [False] * batch.num_rows
            for k, s, b in zip(own, batch.column(size_at).to_pylist(), breaks):
                if k != key:
                    key, chunk, used, n = k, 0, 0, 0
                elif n and (b or used + n * separator + s > budget):
                    chunk, used, n = chunk + 1, 0, 0
                used, n = used + s, n + 1
                found.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [f.name for f in schema.fields])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
