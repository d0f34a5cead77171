"""Kernels with state that is carried from firing to firing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..stream import BLOCK, SEQ, Stream


def running(column: str, out: str = "v", how: str = "sum", block: int = BLOCK) -> Callable[[Stream], Stream]:
    """An associative accumulator (sum, min, max, count) after each firing.

    Two levels: a scan inside each block, and one over the blocks' totals (a
    row for each block), joined back on the block.
    """
    fold: Callable[[Column], Column] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]

    def merge(a: Column, b: Column) -> Column:
        if how in ("sum", "count"):
            return F.coalesce(a, F.lit(0)) + b
        return (F.least if how == "min" else F.greatest)(a, b)

    def apply(s: Stream) -> Stream:
        rows = s.df.withColumn("__b", F.floor(F.col(SEQ) / block).cast("bigint"))
        inner = fold(F.col(column)).over(Window.partitionBy("__b").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0))
        totals = rows.groupBy("__b").agg(fold(F.col(column)).alias("__t"))
        outer = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        again = F.sum if how == "count" else fold
        offsets = totals.select("__b", again(F.col("__t")).over(outer).alias("__o"))
        joined = rows.withColumn("__i", inner).join(offsets, "__b")
        value = merge(F.col("__o"), F.col("__i"))
        keep = [c for c in s.df.columns if c != out]
        return s.derive(joined.select(*keep, value.alias(out)), "running", size=s.size, pop=1, push=1)

    return apply


def ordered_fold(step: Callable[[object, tuple], tuple[object, list[tuple]]], init: object, schema: StructType | str) -> Callable[[Stream], Stream]:
    """A general recurrence: ``step(state, row) -> (state, rows to push)``.

    The state passes through every element, so this is serial by definition
    and runs in one task, streaming with constant memory.  Use ``running`` for
    associative state and ``keyed_fold`` where the state is kept by key.
    """

    def apply(s: Stream) -> Stream:
        columns = s.columns

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, at = init, 0
            for batch in batches:
                rows: list[tuple] = []
                for row in batch[columns].itertuples(index=False, name=None):
                    state, pushed = step(state, row)
                    rows.extend((at + len(rows), *p) for p in pushed)
                at += len(rows)
                yield pd.DataFrame(rows, columns=names)

        from pyspark.sql.types import LongType, StructField, _parse_datatype_string

        fields = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
        whole = StructType([StructField(SEQ, LongType()), *fields.fields])
        names = whole.names
        single = s.df.repartition(1).sortWithinPartitions(SEQ)
        return s.derive(single.mapInPandas(work, whole), "fold")

    return apply


def keyed_fold(key: str, step: Callable[[object, tuple], tuple[object, list[tuple]]], init: object, schema: StructType | str) -> Callable[[Stream], Stream]:
    """``ordered_fold`` with one state for each key.

    Rows are partitioned by key and sorted by (key, seq); the partition is
    then streamed, so a hot key needs no more memory than any other.  Output
    keeps the ``seq`` of the element that caused it plus ``k``, its number
    among that firing's pushes.
    """

    def apply(s: Stream) -> Stream:
        from pyspark.sql.types import LongType, StructField, _parse_datatype_string

        fields = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
        whole = StructType([StructField(SEQ, LongType()), StructField("k", LongType()), s.df.schema[key], *fields.fields])
        names, columns, where_key = whole.names, s.columns, s.df.columns.index(key)
        where_seq = s.df.columns.index(SEQ)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state, started = None, init, False
            for batch in batches:
                rows: list[tuple] = []
                for row in batch.itertuples(index=False, name=None):
                    k = row[where_key]
                    if not started or k != now:
                        now, state, started = k, init, True
                    payload = tuple(v for i, v in enumerate(row) if i != where_seq)
                    state, pushed = step(state, payload)
                    rows.extend((row[where_seq], j, k, *p) for j, p in enumerate(pushed))
                yield pd.DataFrame(rows, columns=names)

        assert columns
        dealt = s.df.repartition(key).sortWithinPartitions(key, SEQ)
        return s.derive(dealt.mapInPandas(work, whole), "keyed fold")

    return apply
