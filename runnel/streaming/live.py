"""Unbounded sources, stateful operators and sinks.

Maps, round-robin splits and fixed-rate operators need no state: their batch
forms work on a streaming DataFrame that carries ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..stream import SEQ, Stream


def rate_stream(spark: SparkSession, rows_per_batch: int = 1000) -> Stream:
    """An endless counter: 0, 1, 2, ..."""
    df = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    return Stream(df.select(F.col("value").alias(SEQ), F.col("value").cast("int").alias("v")), ("rate", (), ()))


def file_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 16) -> DataFrame:
    """Parquet files as they arrive; ``max_files`` bounds a micro-batch (backpressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, then stop; the result is the memory table ``name``."""
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)


def deliver(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Send all that is there through ``sink(batch, batch_id)``, a kernel without outputs, then stop.

    Run again with the same ``checkpoint``, it goes on where it stopped: that
    is pause and resume.
    """
    df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(df: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event-time tumbling counts with a watermark (beyond the stream language)."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def keyed_running(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, total) after each micro-batch: a kernel whose state is kept by key."""
    kind = df.schema[key].dataType.simpleString()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0)
        for batch in batches:
            n, total = n + len(batch), total + int(batch[column].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return (
        df.select(key, F.col(column).cast("bigint").alias(column))
        .groupBy(key)
        .applyInPandasWithState(work, f"{key} {kind}, n long, total long", "n long, total long", "update", GroupStateTimeout.NoTimeout)
    )


class LiveFir:
    """A FIR kernel over a live stream, as a ``foreachBatch`` sink.

    The last n - 1 elements before a batch are the history of its first ones.
    They are read from the output's own input log, a Parquet folder with one
    part for each batch, so a batch that is run again gives the same result.
    """

    def __init__(self, taps: int, path: str, column: str = "v") -> None:
        self.taps, self.path, self.column = taps, path, column

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from ..operators import fir

        spark = batch.sparkSession
        rows = batch.select(SEQ, self.column)
        log = f"{self.path}/log"
        rows.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        rows = spark.read.parquet(f"{log}/batch={batch_id}")
        first = rows.agg(F.min(SEQ)).first()[0]
        if first is None:
            return
        need = spark.read.parquet(log).where((F.col(SEQ) < first) & (F.col(SEQ) >= first - self.taps + 1) & (F.col("batch") < batch_id))
        whole = rows.unionByName(need.select(SEQ, self.column))
        out = fir(self.taps, self.column)(Stream(whole)).df.where(F.col(SEQ) >= first)
        out.write.mode("overwrite").parquet(f"{self.path}/out/batch={batch_id}")
