"""Look-ahead and look-back windows over stream positions.

A window without a partition would run in one task.  Positions are cut into
blocks instead, and each block also receives the few rows of its neighbour that
its frames reach (a halo), so every block is evaluated on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wrap_i32
from ..stream import BLOCK, SEQ, Stream

#: Longest list of given taps that is one column a tap; longer ones are convolved block by block.
COLUMNS = 32


def _halo(df: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """Rows with ``__b``, the block that evaluates them; ``__home`` marks the block's own."""
    size = max(block, before, after, 1)
    at = lambda shift: F.floor((F.col(SEQ) + shift) / size).cast("bigint")
    blocks = F.array_distinct(F.array(at(0), at(before), F.greatest(at(-after), F.lit(0))))
    spread = df.withColumn("__b", F.explode(blocks))
    return spread.withColumn("__home", F.col("__b") == at(0))


def peek(k: int, aggregates: dict[str, Column], pop: int = 1, block: int = BLOCK) -> Callable[[Stream], Stream]:
    """Each firing sees the next ``k`` elements and consumes ``pop``.

    ``aggregates`` are aggregate expressions over those k elements.  Firings
    that would look past the end don't happen: N - k + 1 of them for pop 1.
    """

    def apply(s: Stream) -> Stream:
        w = Window.partitionBy("__b").orderBy(SEQ).rowsBetween(0, k - 1)
        rows = _halo(s.df, 0, k - 1, block)
        out = rows.select(SEQ, "__home", F.count(F.lit(1)).over(w).alias("__n"), *(c.over(w).alias(n) for n, c in aggregates.items()))
        out = out.where(F.col("__home") & (F.col("__n") == k))
        if pop > 1:
            out = out.where(F.pmod(F.col(SEQ), F.lit(pop)) == 0)
            out = out.withColumn(SEQ, F.floor(F.col(SEQ) / pop).cast("bigint"))
        size = s.long.then(f"greatest(N - {k} + {pop}, 0) div {pop}")
        return s.derive(out.select(SEQ, *aggregates), "peek", size=size, peek=k, pop=pop, push=1)

    return apply


def fir(taps: int | Sequence[int], column: str = "v", wrap: bool = True, block: int = BLOCK) -> Callable[[Stream], Stream]:
    """Finite impulse response over a history that starts as zeros.

    An integer means that many taps of 1.  Otherwise ``taps[0]`` weighs the
    newest element, ``taps[1]`` the oldest in the window and ``taps[-1]`` the
    second newest, the order in which a ring buffer is read after a store.
    ``wrap`` keeps 32-bit wrapping arithmetic; without it the sum is a bigint.

    Taps of 1 cost the same however many: a running sum of the block, less
    what it was n elements back.
    """
    n = taps if isinstance(taps, int) else len(taps)
    if n > COLUMNS and not isinstance(taps, int):
        return _convolved(taps, column, wrap, block)

    def apply(s: Stream) -> Stream:
        w = Window.partitionBy("__b").orderBy(SEQ)
        rows = _halo(s.df.select(SEQ, F.col(column).cast("bigint").alias("__v")), n - 1, 0, block)
        if isinstance(taps, int):
            rows = rows.withColumn("__p", F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            value = F.col("__p") - F.coalesce(F.lag("__p", n).over(w), F.lit(0).cast("bigint"))
        else:
            # the weight of the element d places back
            weights = [taps[0], *(taps[n - d] for d in range(1, n))]
            # A reduced product keeps the total of any frame far from 64 bits.
            terms = [
                (lambda x: wrap_i32(x).cast("bigint") if wrap else x)(
                    F.coalesce(F.lag("__v", d).over(w), F.lit(0).cast("bigint")) * F.lit(int(t)).cast("bigint")
                )
                for d, t in enumerate(weights)
                if t
            ]
            value = F.lit(0).cast("bigint")
            for term in terms:
                value = value + term
        value = wrap_i32(value) if wrap else value
        out = rows.select(SEQ, "__home", value.alias(column)).where("__home").select(SEQ, column)
        return s.derive(out, "fir", size=s.size, taps=n, pop=1, push=1)

    return apply


def _convolved(taps: Sequence[int], column: str, wrap: bool, block: int) -> Callable[[Stream], Stream]:
    """``fir`` with many given taps: each block and its halo is one numpy convolution of 64-bit integers.

    A block is as long as BLOCK and the taps at most, whatever the stream; sums
    wrap at 64 bits, which leaves their low 32 bits exact.
    """
    import numpy as np
    import pyarrow as pa

    n = len(taps)
    weights = np.array([taps[0], *(taps[n - d] for d in range(1, n))], np.int64)

    def one(table: pa.Table) -> pa.Table:
        seq = table.column(SEQ).to_numpy()
        order = np.argsort(seq)
        values, home = table.column("__v").to_numpy()[order], table.column("__home").to_numpy()[order]
        out = np.convolve(values, weights)[: len(values)]
        if wrap:
            out = out.astype(np.int32)
        return pa.table({SEQ: seq[order][home], column: out[home]})

    def apply(s: Stream) -> Stream:
        rows = _halo(s.df.select(SEQ, F.coalesce(F.col(column).cast("bigint"), F.lit(0)).alias("__v")), n - 1, 0, block)
        out = rows.groupBy("__b").applyInArrow(one, f"{SEQ} long, {column} {'int' if wrap else 'long'}")
        return s.derive(out, "fir", size=s.size, taps=n, pop=1, push=1)

    return apply
