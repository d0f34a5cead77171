"""The ordered stream: a DataFrame plus a dense 64-bit ``seq`` starting at 0.

Spark rows have no order, so position is data.  ``seq`` is assigned once, from a
unique total order, and every later position is derived from it arithmetically.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQ = "seq"


_names = count()


@dataclass(frozen=True)
class Length:
    """A number of elements: SQL arithmetic over the counts of a few sources.

    Operators with fixed rates change the arithmetic only, so a source is
    counted once however many splits and joins lie behind it.
    """

    expr: str
    bases: tuple[tuple[str, DataFrame], ...] = ()

    @classmethod
    def counted(cls, rows: DataFrame) -> "Length":
        """The number of rows of a dense stream or table: no column is read."""
        name = f"__n{next(_names)}"
        return cls(name, ((name, rows.agg(F.count(F.lit(1)).alias(name))),))

    def then(self, template: str) -> "Length":
        """``template`` with this length in place of N."""
        return Length(template.replace("N", f"({self.expr})"), self.bases)

    @classmethod
    def least(cls, lengths: "list[Length]") -> "Length":
        each = list(dict.fromkeys(x.expr for x in lengths))
        bases = dict(b for x in lengths for b in x.bases)
        return cls(each[0] if len(each) == 1 else f"least({', '.join(each)})", tuple(bases.items()))

    def frame(self, name: str = "n") -> DataFrame | None:
        """One row with the number; None if it is a constant."""
        out = None
        for _, base in self.bases:
            out = base if out is None else out.crossJoin(base)  # one row each
        return None if out is None else out.select(F.expr(f"CAST({self.expr} AS BIGINT)").alias(name))

    def bound(self, rows: DataFrame) -> DataFrame:
        """The rows whose ``seq`` is below the number.  A constant is pushed to the scan."""
        end = self.frame("__end")
        if end is None:
            return rows.where(F.col(SEQ) < F.expr(f"CAST({self.expr} AS BIGINT)"))
        return rows.join(F.broadcast(end), F.col(SEQ) < F.col("__end")).drop("__end")


@dataclass(frozen=True)
class Stream:
    """An ordered stream.  ``trace`` names the operators that made it (see ``graph``)."""

    df: DataFrame
    trace: tuple = field(default=(), compare=False)
    size: Length | None = field(default=None, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def columns(self) -> list[str]:
        """Payload columns."""
        return [c for c in self.df.columns if c != SEQ]

    @property
    def long(self) -> Length:
        """How many elements there are; counted where no arithmetic tells."""
        if self.size is None:
            object.__setattr__(self, "size", Length.counted(self.df))
        return self.size

    def derive(self, df: DataFrame, op: str, *others: "Stream", size: Length | None = None, **rates) -> "Stream":
        """A stream made from this one (and others) by the operator called ``op``."""
        node = (op, tuple(sorted(rates.items())), (self.trace, *(o.trace for o in others)))
        return Stream(df, node, size)

    def pipe(self, *stages: Callable[["Stream"], "Stream"]) -> "Stream":
        out = self
        for stage in stages:
            out = stage(out)
        return out

    def ordered(self) -> DataFrame:
        """The rows in stream order."""
        return self.df.orderBy(SEQ)

    def length(self) -> DataFrame:
        """One row: the number of elements."""
        frame = self.long.frame()
        return self.spark.range(1).select(F.expr(f"CAST({self.long.expr} AS BIGINT)").alias("n")) if frame is None else frame


def from_dense(df: DataFrame, key: str, *payload: Column) -> Stream:
    """A table whose ``key`` is already dense from 0: a projection, no shuffle."""
    columns = payload or [F.col(c) for c in df.columns if c != key]
    return Stream(df.select(F.col(key).cast("bigint").alias(SEQ), *columns), ("source", (("key", key),), ()), Length.counted(df))


#: Rows of a stream that are numbered together.
BLOCK = 65_536


def renumber(rows: DataFrame, pushes: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Close the gaps of a stream whose rows have their old ``seq``; lazy, with one shuffle.

    Rows are counted by block of old positions.  A position is the row's rank
    in its block plus what the blocks before hold, a table of one row for each
    block.  Every part is a function of the data, so a lost executor's work
    comes out the same again.  With ``pushes`` each row stands for that many,
    and the result is the first one's position.
    """
    weight = F.lit(1) if pushes is None else pushes
    placed = rows.withColumn("__b", F.expr(f"{SEQ} div {block}")).withColumn("__w", weight.cast("bigint"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__b").agg(F.sum("__w").alias("__t")).select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    within = F.sum("__w").over(Window.partitionBy("__b").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")
    joined = placed.withColumn("__r", within).join(offsets, "__b")
    return joined.withColumn(SEQ, (F.col("__off") + F.col("__r")).cast("bigint")).select(*rows.columns)


def from_table(df: DataFrame, *order_by: str | Column, parts: int | None = None) -> Stream:
    """A table in the order of ``order_by``, which must be a unique total order."""
    return Stream(densify(df, *order_by, parts=parts), ("source", (("order", str(order_by)),), ()))


def densify(df: DataFrame, *order_by: str | Column, parts: int | None = None) -> DataFrame:
    """Assign a dense ``seq`` in the given order.

    One range shuffle sorts the rows into ordered partitions.  The position is
    the row's rank in its partition plus the number of rows before it; the
    offsets table has one row for each partition, which bounds the broadcast.
    Nothing runs through a single task.  The range shuffle samples its input,
    so the sorted rows are pinned by a reliable checkpoint before they are
    counted: both uses then see the same partitions, also after a lost executor.
    """
    from .session import cut

    keys = [F.col(c) if isinstance(c, str) else c for c in order_by] or [F.col(SEQ)]
    body = df.drop(SEQ) if order_by else df
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = body.columns
    ranged = body.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    ranks = [f"__k{i}" for i in range(len(keys))]
    ranged = ranged.repartitionByRange(n, *ranks).withColumn("__part", F.spark_partition_id())
    pinned = cut(ranged)
    counts = pinned.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*ranks))
    placed = pinned.withColumn("__r", within).join(F.broadcast(offsets), "__part")
    rest = [c for c in names if c != SEQ]
    return placed.select((F.col("__off") + F.col("__r") - 1).cast("bigint").alias(SEQ), *rest)
