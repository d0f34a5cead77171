"""Element-wise operators and operators with fixed rates.

A firing that pops P and pushes U maps positions by arithmetic on ``seq``; only
data-dependent rates (``where``, ``route``, ``explode_each``) assign it anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..stream import SEQ, Length, Stream, renumber


def map_stream(*columns: Column, **named: Column) -> Callable[[Stream], Stream]:
    """One in, one out.  Chains collapse into a single projection."""

    def apply(s: Stream) -> Stream:
        outs = [*columns, *(c.alias(n) for n, c in named.items())]
        return s.derive(s.df.select(SEQ, *outs), "map", size=s.size, pop=1, push=1)

    return apply


def where(predicate: Column) -> Callable[[Stream], Stream]:
    """Conditional push: keeps order and closes the gaps."""
    return lambda s: s.derive(renumber(s.df.where(predicate)), "where", pop=1)


def route(branch: Column, n: int) -> Callable[[Stream], list[Stream]]:
    """Push each element to the branch whose number ``branch`` gives at run time."""
    return lambda s: [s.derive(renumber(s.df.where(branch == i)), "route", branch=i) for i in range(n)]


def decimate(pop: int, aggregates: dict[str, Column] | None = None, offset: int = 0) -> Callable[[Stream], Stream]:
    """Pop ``pop``, push one.  Incomplete last firings are discarded.

    Without aggregates, the element at ``offset`` in each firing is pushed: a
    filter and a projection, no shuffle.  With aggregates, each firing is one
    group; map-side combine keeps the shuffle to a row for each firing.
    """
    if not 0 <= offset < pop:
        raise ValueError("offset must lie within the firing")

    def apply(s: Stream) -> Stream:
        firing = F.floor(F.col(SEQ) / pop).cast("bigint")
        full = s.long.then(f"N div {pop}")
        if aggregates is None:
            body = s.df.where(F.pmod(F.col(SEQ), F.lit(pop)) == offset).withColumn(SEQ, firing)
            # the last element of a firing is only there if the firing is full
            out = (body if offset == pop - 1 else full.bound(body)).select(*s.df.columns)
        else:
            aggs = [c.alias(name) for name, c in aggregates.items()]
            grouped = s.df.groupBy(firing.alias("__f")).agg(F.count(F.lit(1)).alias("__n"), *aggs)
            out = grouped.where(F.col("__n") == pop).select(F.col("__f").alias(SEQ), *aggregates)
        return s.derive(out, "decimate", size=full, pop=pop, push=1)

    return apply


def expand(*pushes: Column, name: str = "v") -> Callable[[Stream], Stream]:
    """Pop one, push ``len(pushes)`` values: narrow, no shuffle."""
    n = len(pushes)

    def apply(s: Stream) -> Stream:
        rows = s.df.select(F.col(SEQ).alias("__s"), F.posexplode(F.array(*pushes)).alias("__j", name))
        return s.derive(rows.select((F.col("__s") * n + F.col("__j")).alias(SEQ), name), "expand", size=s.long.then(f"N * {n}"), pop=1, push=n)

    return apply


def explode_each(values: Column, name: str = "v") -> Callable[[Stream], Stream]:
    """Pop one, push as many values as the array has (a data-dependent rate)."""

    def apply(s: Stream) -> Stream:
        rows = s.df.select(SEQ, values.alias("__all")).where(F.size("__all") > 0)
        first = renumber(rows, F.size("__all"))
        flat = first.select(F.col(SEQ).alias("__s"), F.posexplode("__all").alias("__j", name))
        return s.derive(flat.select((F.col("__s") + F.col("__j")).alias(SEQ), name), "explode", pop=1)

    return apply


def zip_streams(streams: Sequence[Stream], combine: Callable[..., dict[str, Column]] | None = None) -> Stream:
    """Take one element from each input at a time; the shortest input ends it.

    Payload columns of input i are available as ``s{i}_<name>``.  Equi-joins on
    ``seq`` keep one partitioning throughout.
    """
    frames = [
        s.df.select(SEQ, *(F.col(c).alias(f"s{i}_{c}") for c in s.columns)) for i, s in enumerate(streams)
    ]
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, SEQ)
    if combine:
        names = [c for c in out.columns if c != SEQ]
        out = out.select(SEQ, *(c.alias(n) for n, c in combine(*(F.col(c) for c in names)).items()))
    return streams[0].derive(out, "zip", *streams[1:], size=Length.least([s.long for s in streams]), pop=1, push=1)


def become(at: int, before: dict[str, Column], after: dict[str, Column]) -> Callable[[Stream], Stream]:
    """A kernel that replaces itself by another after ``at`` firings."""

    def apply(s: Stream) -> Stream:
        cols = [F.when(F.col(SEQ) < at, before[n]).otherwise(after[n]).alias(n) for n in before]
        return s.derive(s.df.select(SEQ, *cols), "become", size=s.size, pop=1, push=1)

    return apply


def become_when(signal: Column, before: dict[str, Column], after: dict[str, Column]) -> Callable[[Stream], Stream]:
    """A kernel that replaces itself when an element says so: the first with ``signal`` is its last.

    One aggregate finds the place, a single row that is broadcast.
    """

    def apply(s: Stream) -> Stream:
        place = s.df.where(signal).agg(F.min(SEQ).alias("__at"))
        rows = s.df.crossJoin(F.broadcast(place))
        old = F.col("__at").isNull() | (F.col(SEQ) <= F.col("__at"))
        return s.derive(rows.select(SEQ, *(F.when(old, before[n]).otherwise(after[n]).alias(n) for n in before)), "become", size=s.size, pop=1, push=1)

    return apply


def take(n: int) -> Callable[[Stream], Stream]:
    """The first n elements.  A predicate on ``seq``, pushed to the scan."""
    return lambda s: s.derive(s.df.where(F.col(SEQ) < n), "take", size=s.long.then(f"least(N, {n})"))
