"""Scalar semantics of the stream language as Column expressions.

Integers are 32 bits wide and wrap; floats are single precision; comparisons
with NaN are false.  All of it stays in whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BIAS, _MASK = 2**31, 2**32 - 1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _long(x) -> Column:
    return _c(x).cast("bigint")


def wrap_i32(x) -> Column:
    """A bigint reduced to a wrapping 32-bit integer."""
    return ((_long(x) + F.lit(_BIAS)).bitwiseAND(F.lit(_MASK)) - F.lit(_BIAS)).cast("int")


def i_add(a, b) -> Column:
    return wrap_i32(_long(a) + _long(b))


def i_sub(a, b) -> Column:
    return wrap_i32(_long(a) - _long(b))


def i_mul(a, b) -> Column:
    return wrap_i32(_long(a) * _long(b))


def i_neg(a) -> Column:
    return wrap_i32(-_long(a))


def i_not(a) -> Column:
    return F.bitwise_not(_c(a).cast("int"))


def i_div(a, b) -> Column:
    """Division truncated towards zero; null where the divisor is 0."""
    a, b = _long(a), _long(b)
    q = F.call_function("div", F.abs(a), F.nullif(F.abs(b), F.lit(0).cast("bigint")))
    return wrap_i32(F.when((a < 0) != (b < 0), -q).otherwise(q))


def i_rem(a, b) -> Column:
    """Remainder with the dividend's sign; null where the divisor is 0."""
    return (_long(a) % F.nullif(_long(b), F.lit(0).cast("bigint"))).cast("int")


def i_shl(a, n: int) -> Column:
    return F.shiftleft(_c(a).cast("int"), n)


def i_shr(a, n: int) -> Column:
    """Arithmetic shift."""
    return F.shiftright(_c(a).cast("int"), n)


def b_and(a, b) -> Column:
    return _c(a).cast("int").bitwiseAND(_c(b).cast("int"))


def b_or(a, b) -> Column:
    return _c(a).cast("int").bitwiseOR(_c(b).cast("int"))


def b_xor(a, b) -> Column:
    return _c(a).cast("int").bitwiseXOR(_c(b).cast("int"))


def truth(x) -> Column:
    """The language's boolean value of a number."""
    return _c(x) != 0


def logical_and(a, b) -> Column:
    return truth(a) & truth(b)


def logical_or(a, b) -> Column:
    return truth(a) | truth(b)


def _ordered(a, b, test: Column) -> Column:
    return ~F.isnan(_c(a).cast("double")) & ~F.isnan(_c(b).cast("double")) & test


def f_eq(a, b) -> Column:
    return _ordered(a, b, _c(a) == _c(b))


def f_ne(a, b) -> Column:
    """Ordered inequality: false where either side is NaN."""
    return _ordered(a, b, _c(a) != _c(b))


def f_lt(a, b) -> Column:
    return _ordered(a, b, _c(a) < _c(b))


def f_le(a, b) -> Column:
    return _ordered(a, b, _c(a) <= _c(b))


def f_gt(a, b) -> Column:
    return f_lt(b, a)


def f_ge(a, b) -> Column:
    return f_le(b, a)


def to_float(x) -> Column:
    return _c(x).cast("float")


def to_int(x) -> Column:
    """Truncating conversion; null where the value has no 32-bit integer."""
    return _c(x).try_cast("int")


def round_half_up(x) -> Column:
    """The rounding converter: floor(x + 0.5)."""
    return F.floor(_c(x) + F.lit(0.5)).try_cast("int")


def select(cond, a, b) -> Column:
    return F.when(truth(cond) if not isinstance(cond, Column) else cond, _c(a)).otherwise(_c(b))


def array_at(arr: Column, *index) -> Column:
    """Zero-based, possibly nested, array access; null out of bounds."""
    for i in index:
        arr = F.get(arr, _c(i).cast("int"))
    return arr


def _single(fn):
    return lambda x: fn(_c(x).cast("double")).cast("float")


def to_long(x) -> Column:
    """A bigint; null where the value has none (NaN, the infinities, beyond 64 bits)."""
    return _c(x).try_cast("bigint")


def _floor(d: Column) -> Column:
    """The largest whole double below; from 2^52 on all are whole, and a bigint has neither NaN nor the infinities."""
    return F.when(F.abs(d) < F.lit(2.0**52), F.floor(d).cast("double")).otherwise(d)


def f_log(x) -> Column:
    """Natural logarithm with -Infinity at 0 and NaN below, as in C."""
    d = _c(x).cast("double")
    return (
        F.when(F.isnan(d) | (d < 0), F.lit(float("nan")))
        .when(d == 0, F.lit(float("-inf")))
        .otherwise(F.ln(d))
        .cast("float")
    )


def f_atan2(y, x) -> Column:
    return F.atan2(_c(y).cast("double"), _c(x).cast("double")).cast("float")


def f_round(x) -> Column:
    """Half away from zero."""
    d = _c(x).cast("double")
    return (F.signum(d) * _floor(F.abs(d) + 0.5)).cast("float")


#: The language's one-argument functions, all single precision.
MATH = {
    "sin": _single(F.sin),
    "cos": _single(F.cos),
    "atan": _single(F.atan),
    "abs": _single(F.abs),
    "round": f_round,
    "sqrt": _single(F.sqrt),
    "exp": _single(F.exp),
    "log": f_log,
    "floor": _single(_floor),
}
