"""Shared pieces of the corpus operators.

Every operator reads only the columns it is told to, so extra columns of any
name do no harm, and gives its working columns names that begin with ``__``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir

__all__ = ["Memory", "cut", "few", "map_rows", "settle", "shared_dir", "short_batches", "span_digest", "texts"]

#: Most bytes of rows that are broadcast instead of shuffled.
SMALL = 32 << 20


class Memory(dict):
    """A bounded memo of ``make(key)``: two generations, so words in use stay."""

    def __init__(self, make: Callable, limit: int) -> None:
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _bytes(df: DataFrame):
    """A row's size as Spark holds it: eight bytes a field, and what strings, binaries and arrays have beside."""
    total = F.lit(8 + 8 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            total = total + F.coalesce(8 * F.size(name) + 16, F.lit(0))
    return total


def few(df: DataFrame) -> DataFrame:
    """Mark a checkpointed side for broadcast if its rows are measured to be small; else it is shuffled."""
    return F.broadcast(df) if (df.agg(F.sum(_bytes(df))).first()[0] or 0) <= SMALL else df


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a narrow result, read in partitions that fit its number of rows.

    What shuffles read next then has few map tasks where rows are few, and as
    many as are needed where they are many.
    """
    made = cut(df)
    spread = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    rows = made.coalesce(spread).count()
    return made.coalesce(rows // 250_000 + 4)


def short_batches(df: DataFrame, rows: int = 1000) -> None:
    """Bound what an Arrow batch of texts holds; a session that has set its own size keeps it."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(rows))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text) with null texts as empty ones, and the columns ``keep``; the scan reads no others."""
    short_batches(docs)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(keep or [])
    )


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterable[tuple]]], schema: str, step: int = 512) -> DataFrame:
    """Map rows to rows in Arrow batches.

    ``make()`` runs once in each task and returns ``work(rows)``: a list of
    input tuples (``step`` at most) to output tuples.  Short slices keep the
    Python objects of a batch few, however long its texts are.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                out = list(work(rows))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], names=names)

    return df.mapInArrow(run, schema)


def span_digest(spans: list[tuple[str, int, int]], kinds: list[str]) -> tuple[str, str]:
    """(joined, sha256) of kind:start:end, by start and then by the order of ``kinds``."""
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)
    return joined, hashlib.sha256(joined.encode()).hexdigest()
