"""Splitters, joiners and the hierarchical composites built from them.

With weights w and S their sum, branch i owns the residues [o_i, o_i + w_i) of
``seq`` modulo S.  Splitting and joining are arithmetic on ``seq``: narrow, with
no shuffle and no buffering, for any number of branches and any weights.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import functions as F

from ..stream import SEQ, Length, Stream

Stage = Callable[[Stream], Stream]


def _weights(n: int, weights: int | Sequence[int]) -> list[int]:
    out = [weights] * n if isinstance(weights, int) else list(weights)
    if len(out) != n or any(w < 0 for w in out) or not sum(out):
        raise ValueError("one weight of 0 or more for each branch, not all 0")
    return out


def _starts(w: Sequence[int]) -> list[int]:
    return [0, *accumulate(w)][:-1]


def _div(x, n: int):
    """x // n for x >= 0, in 64-bit integers throughout."""
    return F.expr(f"{x} div {n}")


def identity(s: Stream) -> Stream:
    return s


def split_duplicate(n: int) -> Callable[[Stream], list[Stream]]:
    """Every branch sees every element: the same plan, reused."""
    return lambda s: [s.derive(s.df, "duplicate", size=s.long, branch=i) for i in range(n)]


def split_rr(n: int, weights: int | Sequence[int] = 1) -> Callable[[Stream], list[Stream]]:
    """Deal w_i elements to branch i in turn; a short last round is delivered."""
    w = _weights(n, weights)

    def apply(s: Stream) -> list[Stream]:
        total, out = sum(w), []
        for i, (wi, oi) in enumerate(zip(w, _starts(w), strict=True)):
            place = F.pmod(F.col(SEQ), F.lit(total))
            mine = s.df.where((place >= oi) & (place < oi + wi))
            seq = (_div(SEQ, total) * wi + place - oi).cast("bigint")
            size = s.long.then(f"N div {total} * {wi} + least(greatest(N % {total} - {oi}, 0), {wi})")
            out.append(s.derive(mine.withColumn(SEQ, seq), "split", size=size, branch=i, weight=wi))
        return out

    return apply


def join_rr(weights: int | Sequence[int] = 1, full_rounds: bool = False) -> Callable[[Sequence[Stream]], Stream]:
    """Take w_i elements from input i in turn.

    Stops at the first missing element (the longest contiguous prefix), or with
    ``full_rounds`` after the last whole round.  Inputs of weight 0 are never read.
    """

    def apply(branches: Sequence[Stream]) -> Stream:
        w = _weights(len(branches), weights)
        total = sum(w)
        parts, ends, read = [], [], []
        for s, wi, oi in zip(branches, w, _starts(w), strict=True):
            if not wi:
                continue
            seq = (_div(SEQ, wi) * total + oi + F.pmod(F.col(SEQ), F.lit(wi))).cast("bigint")
            parts.append(s.df.withColumn(SEQ, seq))
            read.append(s.long)
            ends.append(s.long.then(f"N div {wi} * {total}" if full_rounds else f"N div {wi} * {total} + {oi} + N % {wi}"))
        union = reduce(lambda a, b: a.unionByName(b), parts)
        if len({x.expr for x in read}) == 1 and set(w) <= {0, 1}:
            # branches of one length, one element at a time: every element is in a full round
            return branches[0].derive(union, "join", *branches[1:], size=read[0].then(f"N * {total}"), weights=tuple(w))
        end = Length.least(ends)
        return branches[0].derive(end.bound(union), "join", *branches[1:], size=end, weights=tuple(w))

    return apply


def pipeline(*stages: Stage) -> Stage:
    return lambda s: reduce(lambda x, stage: stage(x), stages, s)


def splitjoin(splitter: Callable[[Stream], list[Stream]], branches: Sequence[Stage], joiner: Callable[[Sequence[Stream]], Stream]) -> Stage:
    """Split, run each branch, join.  The split must have as many branches."""

    def apply(s: Stream) -> Stream:
        parts = splitter(s)
        if len(parts) != len(branches):
            raise ValueError("the splitter and the branches differ in number")
        return joiner([stage(part) for stage, part in zip(branches, parts, strict=True)])

    return apply


def feedback(body: Stage, rounds: int, until: Callable[[Stream], bool] | None = None) -> Stage:
    """Send a stream through ``body`` again and again, at most ``rounds`` times.

    Loops are bounded: Spark plans are acyclic.  The lineage is cut with a
    reliable checkpoint each round where ``until`` has to be evaluated.
    """

    def apply(s: Stream) -> Stream:
        from ..session import cut

        for _ in range(rounds):
            s = body(s)
            if until is not None:
                s = s.derive(cut(s.df), "feedback")
                if until(s):
                    break
        return s

    return apply
