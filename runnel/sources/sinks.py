"""Sink kernels: printers, raw files, throughput reports."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..stream import SEQ, Stream


def lines(s: Stream, column: str = "v", prefix: str = "") -> DataFrame:
    """(seq, line): integers as %d, floats as %f, strings as they are."""
    kind = s.df.schema[column].dataType.simpleString()
    spec = "%f" if kind in ("float", "double") else "%s" if kind == "string" else "%d"
    return s.df.select(SEQ, F.format_string((prefix + spec), F.col(column)).alias("line"))


def write_lines(s: Stream, path: str, column: str = "v", prefix: str = "") -> None:
    """Text files whose names sort in stream order (a range sort, no single task)."""
    lines(s, column, prefix).orderBy(SEQ).select("line").write.mode("overwrite").text(path)


def write_raw(s: Stream, path: str, kind: str = "int32", column: str = "v") -> int:
    """Raw 4-byte elements as part files in stream order; returns their number.

    ``path`` must be a folder that every executor mounts.  A part is written
    under a temporary name and renamed, so a task that is run again is harmless.
    """
    import os

    from .readers import RAW

    dtype = RAW[kind][0]
    os.makedirs(path, exist_ok=True)
    ranged = s.df.repartitionByRange(SEQ).sortWithinPartitions(SEQ)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(path, f"part-{context.partitionId():06d}.bin")
        draft, count = f"{name}.{context.taskAttemptId()}", 0
        with open(draft, "wb") as out:
            for batch in batches:
                out.write(batch[column].to_numpy().astype(dtype).tobytes())
                count += len(batch)
        os.replace(draft, name)
        yield pd.DataFrame({"n": [count]})

    return ranged.select(SEQ, column).mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def noop(s: Stream) -> None:
    """Run the graph and drop its output."""
    s.df.write.format("noop").mode("overwrite").save()


def rate_report(s: Stream) -> dict[str, float]:
    """The throughput sink: elements, seconds, elements a second."""
    seen, began = Observation("rate"), time.time()
    s.df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    took = time.time() - began
    n = seen.get["n"]
    return {"samples": n, "seconds": took, "rate": n / took if took else 0.0}


def rate_reports(s: Stream, every: int) -> DataFrame:
    """(report, samples): what the throughput sink says after each ``every`` elements; a rest says nothing."""
    counts = s.df.groupBy(F.expr(f"{SEQ} div {every}").alias("report")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") == every).select("report", ((F.col("report") + 1) * every).alias("samples"))


class RateSink:
    """The throughput sink of a live stream, for ``foreachBatch``.

    ``reports`` gets (samples, rate, seconds) whenever an interval is full; the
    interval is then set to what arrives in about a second.
    """

    def __init__(self, every: int = 1_000_000) -> None:
        self.every, self.samples, self.reports = every, 0, []
        self.since, self.began = 0, time.time()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        n = batch.count()
        self.samples, self.since = self.samples + n, self.since + n
        took = time.time() - self.began
        if self.since >= self.every and took > 0:
            rate = self.since / took
            self.reports.append((self.samples, rate, took))
            self.every = max(1, round(rate))
            self.since, self.began = 0, time.time()
