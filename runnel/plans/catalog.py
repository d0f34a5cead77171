"""The registered queries on stream operators, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as S
from ..operators import (
    become,
    decimate,
    expand,
    explode_each,
    feedback,
    fir,
    join_rr,
    keyed_fold,
    map_stream,
    ordered_fold,
    peek,
    pipeline,
    route,
    running,
    split_duplicate,
    split_rr,
    splitjoin,
    take,
    where,
    zip_streams,
)
from ..sources import array_source, counter, countdown, lines, rate_report
from ..stream import Stream, from_dense, from_table
from .text import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def events(spark: SparkSession, d: str) -> Stream:
    """The main stream: event amounts in cents, in event order."""
    return from_dense(spark.read.parquet(f"{d}/events.parquet"), "event_id", _cents("value").alias("v"))


def orders(spark: SparkSession, d: str) -> Stream:
    return from_dense(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey", _cents("o_totalprice").alias("v"))


def _bump(k: int):
    return map_stream(v=F.col("v") + k)


E = "SELECT event_id AS seq, CAST(ROUND(value * 100) AS BIGINT) AS v FROM events"
O = "SELECT o_orderkey AS seq, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS v FROM orders"


@query(f"WITH e AS ({E}) SELECT seq, v + 14 AS v FROM e")
def map_chain(spark, d):
    return events(spark, d).pipe(_bump(2), _bump(3), _bump(4), _bump(5)).df


@query(f"WITH e AS ({E}) SELECT ROW_NUMBER() OVER (ORDER BY seq) - 1 AS seq, v FROM e WHERE v % 3 = 0")
def cond_filter(spark, d):
    return where(F.col("v") % 3 == 0)(events(spark, d)).df


@query(
    """SELECT branch, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY event_id) - 1 AS seq, v FROM (
    SELECT event_id, CAST(ROUND(value * 100) AS BIGINT) AS v, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS branch FROM events)"""
)
def route_case(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    s = from_dense(t, "event_id", _cents("value").alias("v"), F.col("event_type"))
    branch = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    parts = [p.df.select(F.lit(i).alias("branch"), "seq", "v") for i, p in enumerate(route(branch, 3)(s))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _split_sql(weights: list[int]) -> str:
    total, at, parts = sum(weights), 0, []
    for i, w in enumerate(weights):
        parts.append(f"SELECT {i} AS branch, (seq // {total}) * {w} + seq % {total} - {at} AS seq, v FROM e WHERE seq % {total} >= {at} AND seq % {total} < {at + w}")
        at += w
    return f"WITH e AS ({E}) " + " UNION ALL ".join(parts)


def _branches(parts: list[Stream]) -> DataFrame:
    out = None
    for i, p in enumerate(parts):
        rows = p.df.select(F.lit(i).alias("branch"), "seq", "v")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(_split_sql([16, 16, 16, 16]))
def split_rr_uniform(spark, d):
    return _branches(split_rr(4, 16)(events(spark, d)))


@query(_split_sql([384, 16, 3]))
def split_rr_weighted(spark, d):
    return _branches(split_rr(3, [384, 16, 3])(events(spark, d)))


@query(f"WITH e AS ({E}) SELECT 0 AS branch, seq, v FROM e UNION ALL SELECT 1, seq, v FROM e")
def split_dup(spark, d):
    return _branches(split_duplicate(2)(events(spark, d)))


def _join_sql(a: int, b: int) -> str:
    """Round-robin of events (weight a) and orders (weight b), cut at the first gap."""
    t = a + b
    return f"""WITH e AS ({E}), o AS ({O}), n AS (SELECT (SELECT COUNT(*) FROM e) AS ne, (SELECT COUNT(*) FROM o) AS no),
    lim AS (SELECT LEAST((ne // {a}) * {t} + ne % {a}, (no // {b}) * {t} + {a} + no % {b}) AS g FROM n),
    u AS (SELECT (seq // {a}) * {t} + seq % {a} AS seq, v FROM e UNION ALL SELECT (seq // {b}) * {t} + {a} + seq % {b}, v FROM o)
    SELECT seq, v FROM u, lim WHERE seq < g"""


@query(_join_sql(1, 1))
def join_rr_uniform(spark, d):
    return join_rr(1)([events(spark, d), orders(spark, d)]).df


@query(_join_sql(1, 16))
def join_rr_weighted(spark, d):
    return join_rr([1, 16])([events(spark, d), orders(spark, d)]).df


@query(
    f"""WITH e AS ({E}), n AS (SELECT COUNT(*) AS n FROM e),
    b AS (SELECT 0 AS b, (seq // 6) * 4 + seq % 6 AS q, v FROM e WHERE seq % 6 < 4 UNION ALL SELECT 1, (seq // 6) * 2 + seq % 6 - 4, v FROM e WHERE seq % 6 >= 4),
    c AS (SELECT SUM(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS n0, SUM(b) AS n1 FROM b),
    u AS (SELECT CASE WHEN b = 0 THEN (q // 2) * 3 + q % 2 ELSE q * 3 + 2 END AS seq, v FROM b)
    SELECT CAST(seq AS BIGINT) AS seq, v FROM u, c WHERE seq < LEAST((n0 // 2) * 3 + n0 % 2, n1 * 3 + 2)"""
)
def permute_4_2_to_2_1(spark, d):
    return splitjoin(split_rr(2, [4, 2]), [_bump(0), _bump(0)], join_rr([2, 1]))(events(spark, d)).df


@query(f"WITH e AS ({E}) SELECT seq * 3 AS seq, v + 1 AS v FROM e UNION ALL SELECT seq * 3 + 1, v * 2 FROM e UNION ALL SELECT seq * 3 + 2, -v FROM e")
def splitjoin_dup(spark, d):
    branches = [_bump(1), map_stream(v=F.col("v") * 2), map_stream(v=-F.col("v"))]
    return splitjoin(split_duplicate(3), branches, join_rr(1))(events(spark, d)).df


@query(
    f"""WITH e AS ({E}) SELECT seq * 2 AS seq, v + 1 AS v FROM e
    UNION ALL SELECT seq * 2 + 1, CAST(SUM(v) OVER (ORDER BY seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS BIGINT) FROM e"""
)
def flagship(spark, d):
    """Duplicate, map beside a 64-tap FIR, round-robin join."""
    branches = [_bump(1), fir(64, wrap=False)]
    return splitjoin(split_duplicate(2), branches, join_rr(1))(events(spark, d)).df


@query(f"WITH o AS ({O}), n AS (SELECT COUNT(*) // 7 AS f FROM o) SELECT seq // 7 AS seq, CAST(SUM(v) AS BIGINT) AS v FROM o, n WHERE seq // 7 < f GROUP BY seq // 7")
def decimate_sum(spark, d):
    return decimate(7, {"v": F.sum("v")})(orders(spark, d)).df


@query(f"WITH o AS ({O}), n AS (SELECT COUNT(*) // 4 AS f FROM o) SELECT seq // 4 AS seq, v FROM o, n WHERE seq % 4 = 1 AND seq // 4 < f", name="decimate")
def decimate_pick(spark, d):
    return decimate(4, offset=1)(orders(spark, d)).df


@query(f"WITH o AS ({O}) SELECT seq * 3 AS seq, v FROM o UNION ALL SELECT seq * 3 + 1, v + 1 FROM o UNION ALL SELECT seq * 3 + 2, -v FROM o", name="expand")
def expand_three(spark, d):
    return expand(F.col("v"), F.col("v") + 1, -F.col("v"))(orders(spark, d)).df


@query(
    f"""WITH e AS ({E}), x AS (SELECT seq, UNNEST(RANGE(CAST(v % 3 AS BIGINT))) AS j, v FROM e)
    SELECT ROW_NUMBER() OVER (ORDER BY seq, j) - 1 AS seq, v + j AS v FROM x"""
)
def variable_push(spark, d):
    values = F.expr("CASE WHEN v % 3 = 0 THEN array() ELSE transform(sequence(0, CAST(v % 3 AS INT) - 1), j -> v + j) END").cast("array<bigint>")
    return explode_each(values)(events(spark, d)).df


@query(
    f"""WITH e AS ({E}), w AS (SELECT seq, SUM(v) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS v,
    COUNT(*) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM e) SELECT seq, CAST(v AS BIGINT) AS v FROM w WHERE n = 10"""
)
def peek_sum(spark, d):
    return peek(10, {"v": F.sum("v")})(events(spark, d)).df


@query(
    f"""WITH e AS ({E}), w AS (SELECT seq, MAX(v) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS v,
    COUNT(*) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM e) SELECT seq // 2 AS seq, v FROM w WHERE n = 5 AND seq % 2 = 0"""
)
def peek_pop2(spark, d):
    return peek(5, {"v": F.max("v")}, pop=2)(events(spark, d)).df


@query(f"WITH e AS ({E}) SELECT seq, CAST(SUM(v) OVER (ORDER BY seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS BIGINT) AS v FROM e")
def fir_sum(spark, d):
    return fir(64, wrap=False)(events(spark, d)).df


@query(
    f"""WITH e AS ({E}) SELECT seq, 3 * v + 4 * COALESCE(LAG(v, 1) OVER (ORDER BY seq), 0) - 2 * COALESCE(LAG(v, 2) OVER (ORDER BY seq), 0)
    + 5 * COALESCE(LAG(v, 3) OVER (ORDER BY seq), 0) AS v FROM e"""
)
def fir_taps(spark, d):
    return fir([3, 5, -2, 4], wrap=False)(events(spark, d)).df


WRAP = "CAST((({x}) + 2147483648) % 4294967296 + CASE WHEN (({x}) + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END - 2147483648 AS INTEGER)"


@query(
    f"""WITH e AS ({E}), w AS (SELECT seq, SUM(v * 100000) OVER (ORDER BY seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS s FROM e)
    SELECT seq, {WRAP.format(x="s")} AS v FROM w"""
)
def fir_wrap(spark, d):
    return pipeline(map_stream(v=F.col("v") * 100000), fir(16))(events(spark, d)).df


@query(f"WITH e AS ({E}), o AS ({O}) SELECT e.seq, e.v + o.v AS v FROM e JOIN o ON e.seq = o.seq")
def zip_add(spark, d):
    return zip_streams([events(spark, d), orders(spark, d)], lambda a, b: {"v": a + b}).df


@query(f"""WITH e AS ({E}), o AS ({O}), z AS (SELECT e.seq, e.v + o.v AS v FROM e JOIN o ON e.seq = o.seq)
    SELECT seq, CAST(SUM(v) OVER (ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS BIGINT) AS v FROM z""")
def fir_two_inputs(spark, d):
    return fir(8, wrap=False)(zip_streams([events(spark, d), orders(spark, d)], lambda a, b: {"v": a + b})).df


@query(f"WITH o AS ({O}) SELECT seq, CAST(SUM(v) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM o")
def running_state(spark, d):
    return running("v")(orders(spark, d)).df


@query(f"WITH o AS ({O}) SELECT seq, MAX(v) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS v FROM o")
def running_max(spark, d):
    return running("v", how="max")(orders(spark, d)).df


def _hash_step(state, row):
    state = (state * 31 + row[0]) % 1009
    return state, [(state,)]


@query(
    f"""WITH RECURSIVE e AS ({E}), f(seq, v) AS (SELECT seq, v % 1009 FROM e WHERE seq = 0
    UNION ALL SELECT e.seq, (f.v * 31 + e.v) % 1009 FROM f JOIN e ON e.seq = f.seq + 1 WHERE e.seq < 2000) SELECT seq, v FROM f"""
)
def ordered_fold_hash(spark, d):
    """A recurrence over the first 2000 elements: a serial kernel's early stop."""
    return ordered_fold(_hash_step, 0, "v long")(take(2000)(events(spark, d))).df


@query()
def ordered_fold_whole(spark, d):
    """The same recurrence over every element; a recursive oracle is too slow for it, a loop in the tests isn't."""
    return ordered_fold(_hash_step, 0, "v long")(events(spark, d)).df


@query(
    """SELECT event_id AS seq, 0 AS k, user_id, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events"""
)
def keyed_state(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    s = from_dense(t, "event_id", F.col("user_id"), _cents("value").alias("v"))
    return keyed_fold("user_id", lambda state, row: (state + row[1], [(state + row[1],)]), 0, "total long")(s).df


@query(f"WITH e AS ({E}) SELECT seq, {WRAP.format(x='v * 1000003')} AS mul, {WRAP.format(x='2147483000 + v')} AS add_, {WRAP.format(x='-2147483000 - v')} AS sub FROM e")
def i32_wrap(spark, d):
    v = F.col("v")
    top = F.lit(2147483000)
    return map_stream(mul=S.i_mul(v, 1000003), add_=S.i_add(top, v), sub=S.i_sub(-top, v))(events(spark, d)).df


@query(
    f"""WITH e AS (SELECT seq, CAST(v AS INTEGER) AS v FROM ({E})) SELECT seq, v & 255 AS a, v | 4096 AS o, xor(v, 21845) AS x,
    CAST(v * 8 AS INTEGER) AS l, (-v) >> 3 AS r, -v - 1 AS c FROM e"""
)
def bitops(spark, d):
    v = F.col("v")
    return map_stream(a=S.b_and(v, 255), o=S.b_or(v, 4096), x=S.b_xor(v, 21845), l=S.i_shl(v, 3), r=S.i_shr(-v, 3), c=S.i_not(v))(events(spark, d)).df


@query(
    f"""WITH e AS (SELECT seq, v, v - 25000 AS w FROM ({E})) SELECT seq, CAST(CASE WHEN w < 0 THEN -((-w) // 7) ELSE w // 7 END AS INTEGER) AS q,
    CAST(w % 7 AS INTEGER) AS r, CASE WHEN v % 5 = 0 THEN NULL ELSE CAST(v // (v % 5) AS INTEGER) END AS z FROM e"""
)
def trunc_divmod(spark, d):
    w = F.col("v") - 25000
    return map_stream(q=S.i_div(w, 7), r=S.i_rem(w, 7), z=S.i_div(F.col("v"), F.col("v") % 5))(events(spark, d)).df


@query("""SELECT event_id AS seq, CAST(FLOOR(value - 250 + 0.5) AS INTEGER) AS up, CAST(TRUNC(value - 250) AS INTEGER) AS cut FROM events""")
def float_to_int(spark, d):
    s = from_dense(spark.read.parquet(f"{d}/events.parquet"), "event_id", F.col("value").alias("v"))
    x = F.col("v") - 250
    return map_stream(up=S.round_half_up(x), cut=S.to_int(x))(s).df


def _scaled(f: str, k: int) -> str:
    return f"CAST(ROUND(CAST(CAST({f} AS FLOAT) AS DOUBLE) * {k}) AS BIGINT)"


@query(
    f"""WITH f AS (SELECT event_id AS seq, CAST(CAST(value AS FLOAT) AS DOUBLE) AS x, CAST(CAST(-value AS FLOAT) / 100 AS DOUBLE) AS y FROM events)
    SELECT seq, {_scaled("SIN(x)", 10000)} AS sin_, {_scaled("COS(x)", 10000)} AS cos_, {_scaled("ATAN(x)", 10000)} AS atan_, {_scaled("ABS(-x)", 100)} AS abs_,
    {_scaled("FLOOR(x + 0.5)", 1)} AS round_, {_scaled("SQRT(x)", 1000)} AS sqrt_, {_scaled("EXP(y)", 10000)} AS exp_, {_scaled("LN(x)", 10000)} AS log_,
    {_scaled("FLOOR(x)", 1)} AS floor_, {_scaled("ATAN2(x, 3)", 10000)} AS atan2_ FROM f"""
)
def math_builtins(spark, d):
    """The language's functions in single precision; values are scaled to integers, null where there is none (the log of 0)."""
    s = from_dense(spark.read.parquet(f"{d}/events.parquet"), "event_id", F.col("value").cast("float").alias("v"))
    v, m = F.col("v"), S.MATH
    low = ((-v).cast("float") / F.lit(100)).cast("float")
    scale = lambda c, k: S.to_long(F.round(c.cast("double") * k))
    return map_stream(
        sin_=scale(m["sin"](v), 10000), cos_=scale(m["cos"](v), 10000), atan_=scale(m["atan"](v), 10000), abs_=scale(m["abs"](-v), 100),
        round_=scale(m["round"](v), 1), sqrt_=scale(m["sqrt"](v), 1000), exp_=scale(m["exp"](low), 10000), log_=scale(m["log"](v), 10000),
        floor_=scale(m["floor"](v), 1), atan2_=scale(S.f_atan2(v, F.lit(3.0)), 10000),
    )(s).df


@query(
    f"""WITH e AS ({E}) SELECT seq, v = v % 1000 AS eq_, v <> 5 AS ne_, v < 20000 AS lt_, v <= 20000 AS le_, v > 20000 AS gt_, v >= 20000 AS ge_,
    (v % 2 <> 0) AND (v % 3 <> 0) AS and_, (v % 2 <> 0) OR (v % 3 <> 0) AS or_, CASE WHEN v % 2 <> 0 THEN v ELSE -v END AS sel FROM e"""
)
def comparisons(spark, d):
    v = F.col("v")
    return map_stream(
        eq_=S.f_eq(v, v % 1000), ne_=S.f_ne(v, F.lit(5)), lt_=S.f_lt(v, F.lit(20000)), le_=S.f_le(v, F.lit(20000)), gt_=S.f_gt(v, F.lit(20000)), ge_=S.f_ge(v, F.lit(20000)),
        and_=S.logical_and(v % 2, v % 3), or_=S.logical_or(v % 2, v % 3), sel=S.select(S.truth(v % 2), v, -v),
    )(events(spark, d)).df


@query(f"WITH e AS ({E}) SELECT seq, CASE seq % 3 WHEN 0 THEN [10, 11] WHEN 1 THEN [-1, -2] ELSE [14, 15] END[CAST(seq % 2 AS INTEGER) + 1] AS v FROM e")
def array_lookup(spark, d):
    a = F.array(*(F.array(*(F.lit(x) for x in row)) for row in ((10, 11), (-1, -2), (14, 15))))
    return map_stream(v=S.array_at(a, F.col("seq") % 3, F.col("seq") % 2))(events(spark, d)).df


@query(f"WITH e AS ({E}) SELECT seq, CASE WHEN seq < 500 THEN v + 1 ELSE v * 2 END AS v FROM e")
def become_switch(spark, d):
    return become(500, {"v": F.col("v") + 1}, {"v": F.col("v") * 2})(events(spark, d)).df


@query("SELECT COUNT(*) AS n FROM lineitem")
def rate_count(spark, d):
    """The throughput sink's count of a stream that is run for nothing else."""
    rows = Stream(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey"))
    return spark.range(1).select(F.lit(rate_report(rows)["samples"]).cast("bigint").alias("n"))


@query("SELECT i AS seq, CAST(1000 - i AS INTEGER) AS v FROM RANGE(1000) t(i)")
def countdown_source(spark, d):
    return countdown(spark, 1000).df


@query("SELECT i AS seq, CAST(i + 14 AS INTEGER) AS v FROM RANGE(10) t(i)")
def golden_pipe(spark, d):
    add = lambda k: map_stream(v=S.i_add(F.col("v"), k))
    return take(10)(counter(spark, 1000).pipe(add(2), add(3), add(4), add(5))).df


@query("SELECT i AS seq, CAST(i // 3 + 1 AS INTEGER) AS v FROM RANGE(15) t(i)")
def golden_splitjoin(spark, d):
    one = map_stream(v=S.i_add(F.col("v"), 1))
    return take(15)(splitjoin(split_duplicate(3), [one] * 3, join_rr(1))(counter(spark, 100))).df


@query("SELECT i AS seq, CAST([10, 0, 11, 0, -1, 20, -2, 21, 14, 30, 15, 31][i % 12 + 1] AS INTEGER) AS v FROM RANGE(24) t(i)")
def golden_array(spark, d):
    a, b = array_source(spark, [10, 11, -1, -2, 14, 15], 4), array_source(spark, [0, 0, 20, 21, 30, 31], 4)
    return take(24)(join_rr(1)([a, b])).df


@query(f"WITH e AS ({E}) SELECT seq, 'v=' || CAST(v AS VARCHAR) AS line FROM e")
def printed_lines(spark, d):
    return lines(events(spark, d), prefix="v=")


@query(f"WITH e AS ({E}) SELECT seq, v * 16 + 15 AS v FROM e")
def bounded_feedback(spark, d):
    return feedback(map_stream(v=F.col("v") * 2 + 1), 4)(events(spark, d)).df


@query("SELECT ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS seq, quality FROM labels")
def densify_gaps(spark, d):
    return from_table(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").df.select("seq", "quality")


@query("SELECT vec_id AS seq, CAST(ROUND(SUM(CAST(x AS DOUBLE)) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, UNNEST(embedding) AS x FROM embeddings) GROUP BY vec_id")
def array_sum(spark, d):
    s = from_dense(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", F.col("embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return map_stream(v=F.round(total * 1000).cast("bigint"))(s).df


@query(f"WITH e AS ({E}) SELECT seq * 2 AS seq, v AS v FROM e WHERE seq < 100 UNION ALL SELECT seq * 2 + 1, v FROM e WHERE seq < 100")
def early_stop(spark, d):
    """A consumer that finishes ends its producers: a bound on seq reaches the scan."""
    return take(200)(splitjoin(split_duplicate(2), [_bump(0), _bump(0)], join_rr(1))(events(spark, d))).df


TEXT = """
int->int filter Add(int k) { work push 1 pop 1 { push(pop() + k); } }
int->int splitjoin Both {
  split roundrobin(2, 1);
  add Add(1);
  add int->int filter { work { push(pop() * 2); } };
  join roundrobin(2, 1);
}
int->int pipeline Main { for (int i = 1; i < 3; i++) add Add(i); add Both; }
int->int filter Window(int n) {
  work { int t = 0; for (int i = 0; i < n; i++) t += peek(i) * (i + 1); push(t); pop(); }
}
int->int filter Swap { work { int a = pop(); int b = pop(); push(b); push(a); push(a < b ? 1 : 0); } }
"""


@query(f"WITH e AS ({E}) SELECT seq, CASE WHEN seq % 3 < 2 THEN v + 4 ELSE (v + 3) * 2 END AS v FROM e")
def text_program(spark, d):
    """A program in the stream language, from text to one plan."""
    return load(spark, TEXT, "Main")(events(spark, d)).df


@query(f"WITH e AS ({E}) SELECT a.seq, a.v + 2 * b.v + 3 * c.v AS v FROM e a JOIN e b ON b.seq = a.seq + 1 JOIN e c ON c.seq = a.seq + 2")
def text_peek(spark, d):
    return load(spark, TEXT, "Window", 3)(events(spark, d)).df


@query(
    f"""WITH e AS ({E}), p AS (SELECT a.seq // 2 AS f, a.v AS a, b.v AS b FROM e a JOIN e b ON b.seq = a.seq + 1 WHERE a.seq % 2 = 0)
    SELECT f * 3 AS seq, b AS v FROM p UNION ALL SELECT f * 3 + 1, a FROM p UNION ALL SELECT f * 3 + 2, CASE WHEN a < b THEN 1 ELSE 0 END FROM p"""
)
def text_rates(spark, d):
    return load(spark, TEXT, "Swap")(events(spark, d)).df
