"""Source kernels: bounded generators, arrays, raw binary files and tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wrap_i32
from ..stream import SEQ, Length, Stream, from_dense, from_table

RAW = {"int32": ("<i4", "int", pa.int32()), "float32": ("<f4", "float", pa.float32())}


def counter(spark: SparkSession, n: int, start: int = 0) -> Stream:
    """start, start + 1, ... as wrapping 32-bit integers, ``n`` of them."""
    df = spark.range(n).select(F.col("id").alias(SEQ), wrap_i32(F.col("id") + start).alias("v"))
    return Stream(df, ("counter", (("push", 1),), ()), Length(str(n)))


def countdown(spark: SparkSession, n: int) -> Stream:
    """n, n - 1, ..., 1; a start of 0 or less is still emitted once."""
    df = spark.range(max(n, 1)).select(F.col("id").alias(SEQ), wrap_i32(F.lit(n) - F.col("id")).alias("v"))
    return Stream(df, ("countdown", (("push", 1),), ()), Length(str(max(n, 1))))


def array_source(spark: SparkSession, values: Sequence, repeats: int = 1, kind: str = "int") -> Stream:
    """The elements of a constant array, again and again."""
    n = len(values)
    array = F.array(*(F.lit(v).cast(kind) for v in values))
    df = spark.range(n * repeats).select(F.col("id").alias(SEQ), F.get(array, F.pmod("id", F.lit(n)).cast("int")).alias("v"))
    return Stream(df, ("array", (("push", n),), ()), Length(str(n * repeats)))


def table(df: DataFrame, *order_by: str, dense: bool = False) -> Stream:
    """A table as a stream; ``dense`` says that the key already counts from 0."""
    return from_dense(df, order_by[0]) if dense else from_table(df, *order_by)


def raw_file(spark: SparkSession, path: str, kind: str = "int32", repeats: int = 1) -> Stream:
    """Raw little-endian 4-byte elements, files in path order, then repeated.

    Each file is one Spark input row (2 GB at most), decoded in Arrow batches.
    A trailing partial element is dropped; nothing is emitted at the end of file.
    """
    dtype, sql, arrow = RAW[kind]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 1 << 16
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = content.as_buffer()
                values = np.frombuffer(buffer, dtype, count=buffer.size // 4)
                for at in range(0, len(values), step):
                    part = values[at : at + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part, arrow)],
                        names=["path", "at", "v"],
                    )

    files = spark.read.format("binaryFile").load(path)
    offsets = files.select("path", F.expr("length div 4").alias("n"))
    # one row for each file of the list
    from pyspark.sql import Window

    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = files.select("path", "content").mapInArrow(decode, f"path string, at long, v {sql}")
    df = rows.join(offsets.select("path", "off"), "path").select((F.col("off") + F.col("at")).alias(SEQ), "v")
    if repeats > 1:
        total = offsets.agg(F.sum("n").alias("total"))
        again = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        df = again.join(F.broadcast(total)).select((F.col("r") * F.col("total") + F.col(SEQ)).alias(SEQ), "v")
    return Stream(df, ("raw file", (("push", 1),), ()))


def user_source(spark: SparkSession, step, init: object, limit: int, kind: str = "int") -> Stream:
    """A source kernel of the user: ``step(state) -> (state, values)`` until it gives no state, or ``limit`` elements.

    State passes from firing to firing, so it runs in one streaming task.
    """

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        for _ in batches:
            state, at, rows = init, 0, []
            while state is not None and at + len(rows) < limit:
                state, made = step(state)
                rows += made
                if len(rows) >= 8192 or state is None or at + len(rows) >= limit:
                    rows = rows[: limit - at]
                    yield pd.DataFrame({SEQ: range(at, at + len(rows)), "v": rows})
                    at, rows = at + len(rows), []

    return Stream(spark.range(0, 1, 1, 1).mapInPandas(work, f"{SEQ} long, v {kind}"), ("user source", (), ()))


def hello(spark: SparkSession, state: int) -> DataFrame:
    """A kernel without streams: it says hello once and finishes."""
    return spark.range(1).select(F.format_string("hello from %d", F.lit(state)).alias("line"))
