"""More registered queries: files, printers, programs as text and by calls, large filters, live graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as S
from ..operators import become, become_when, fir, identity, join_rr, map_stream, pipeline, split_duplicate, split_rr, splitjoin, zip_streams
from ..session import shared_dir
from ..sources import countdown, hello, lines, raw_file, rate_reports, user_source, write_raw
from ..stream import Stream, from_dense
from ..streaming import LiveFir, deliver, file_stream, keyed_running, run_available
from .catalog import E, O, WRAP, _bump, events, orders, query
from .graph import Program, nodes
from .text import load


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _floats(spark, d):
    return from_dense(spark.read.parquet(f"{d}/events.parquet"), "event_id", F.col("value").cast("float").alias("v"))


# -- files and printers ---------------------------------------------------
@query(f"WITH e AS ({E}) SELECT seq, CAST(v AS INTEGER) AS v FROM e")
def raw_int32(spark, d):
    """Written as raw 4-byte integers and read again."""
    path = _folder(spark, "raw")
    write_raw(events(spark, d), path.removeprefix("file://"))
    return raw_file(spark, path).df


@query("SELECT event_id AS seq, CAST(value AS FLOAT) AS v FROM events")
def raw_float32(spark, d):
    path = _folder(spark, "raw")
    write_raw(_floats(spark, d), path.removeprefix("file://"), "float32")
    return raw_file(spark, path, "float32").df


@query("SELECT event_id AS seq, 'x=' || printf('%.6f', value) AS line FROM events")
def float_printer(spark, d):
    return lines(from_dense(spark.read.parquet(f"{d}/events.parquet"), "event_id", F.col("value").alias("v")), prefix="x=")


@query("SELECT 'hello from ' || i AS line FROM RANGE(3) t(i)")
def hello_kernels(spark, d):
    return hello(spark, 0).unionAll(hello(spark, 1)).unionAll(hello(spark, 2))


@query("SELECT i AS report, (i + 1) * 7000 AS samples FROM RANGE((SELECT COUNT(*) // 7000 FROM orders)) t(i)")
def rate_intervals(spark, d):
    """The throughput sink's reports after each 7000 elements."""
    return rate_reports(orders(spark, d), 7000)


@query("SELECT i AS seq, CAST(i * i % 1009 AS INTEGER) AS v FROM RANGE(20000) t(i)")
def user_kernel_source(spark, d):
    return user_source(spark, lambda i: (i + 1, [i * i % 1009]), 0, 20_000).df


# -- scalars ----------------------------------------------------------------
@query("SELECT event_id AS seq, CAST(CAST(ROUND(value * 100) AS BIGINT) AS FLOAT) AS f, CAST(CAST(ROUND(value * 100) AS BIGINT) % 97 AS FLOAT) AS g FROM events")
def int_to_float(spark, d):
    return map_stream(f=S.to_float(F.col("v")), g=S.to_float(F.col("v") % 97))(events(spark, d)).df


@query(
    """WITH f AS (SELECT event_id AS seq, event_id % 5 = 0 AS a, event_id % 7 = 0 AS b, CAST(value AS FLOAT) AS x FROM events)
    SELECT seq, NOT a AND NOT b AS eq_, FALSE AS ne_, NOT a AND x < 100 AS lt_, NOT a AND x <= 100 AS le_, NOT a AND x > 100 AS gt_, NOT a AND x >= 100 AS ge_ FROM f"""
)
def nan_compare(spark, d):
    """Every comparison with NaN is false, the inequality too."""
    nan, hundred = F.lit(float("nan")).cast("float"), F.lit(100.0).cast("float")
    seen = map_stream(x=F.when(F.col("seq") % 5 == 0, nan).otherwise(F.col("v")), y=F.when(F.col("seq") % 7 == 0, nan).otherwise(F.col("v")))(_floats(spark, d))
    x, y = F.col("x"), F.col("y")
    return map_stream(eq_=S.f_eq(x, y), ne_=S.f_ne(x, y), lt_=S.f_lt(x, hundred), le_=S.f_le(x, hundred), gt_=S.f_gt(x, hundred), ge_=S.f_ge(x, hundred))(seen).df


@query("SELECT event_id AS seq, CAST(value AS FLOAT) + CAST(0.5 AS FLOAT) AS s, CAST(value AS FLOAT) * CAST(3 AS FLOAT) AS p, CAST(value AS FLOAT) / CAST(7 AS FLOAT) AS q FROM events")
def float_arithmetic(spark, d):
    v, f = F.col("v"), lambda x: F.lit(x).cast("float")
    return map_stream(s=v + f(0.5), p=v * f(3.0), q=(v / f(7.0)).cast("float"))(_floats(spark, d)).df


# -- filters with many taps ---------------------------------------------------
def _moving(n: int, source: str = E) -> str:
    return f"WITH e AS ({source}) SELECT seq, CAST(SUM(v) OVER (ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS v FROM e"


def _sized(n: int):
    def run(spark, d):
        return fir(n, wrap=False)(events(spark, d)).df

    query(_moving(n), name=f"fir_sum_{n}")(run)


for _n in (128, 256, 512, 1024):
    _sized(_n)

TAPS = [i * 7 % 11 - 5 for i in range(1024)]


@query(
    f"""WITH e AS ({E}) SELECT a.seq, CAST(SUM(b.v * (CASE WHEN a.seq = b.seq THEN -5 ELSE (1024 - (a.seq - b.seq)) * 7 % 11 - 5 END)) AS BIGINT) AS v
    FROM e a JOIN e b ON b.seq BETWEEN a.seq - 1023 AND a.seq GROUP BY a.seq"""
)
def fir_taps_1024(spark, d):
    return fir(TAPS, wrap=False)(events(spark, d)).df


def _chain(n: int, taps: int, stages: int) -> str:
    parts = [f"s0 AS (SELECT i AS seq, {n} - i AS v FROM RANGE({n}) t(i))"]
    for k in range(stages):
        parts.append(f"t{k} AS (SELECT seq, SUM(v) OVER (ORDER BY seq ROWS BETWEEN {taps - 1} PRECEDING AND CURRENT ROW) AS s FROM s{k})")
        parts.append(f"s{k + 1} AS (SELECT seq, {WRAP.format(x='s')} AS v FROM t{k})")
    return f"WITH {', '.join(parts)} SELECT seq, v FROM s{stages}"


@query(_chain(10_000, 1024, 16))
def fir_pipe_16x1024(spark, d):
    """16 chained filters of 1024 taps over a countdown of 10,000; each stage wraps."""
    return pipeline(*[fir(1024)] * 16)(countdown(spark, 10_000)).df


@query(
    f"""WITH e AS ({E}), o AS ({O}), z AS (SELECT e.seq, e.v + o.v AS v FROM e JOIN o ON e.seq = o.seq)
    SELECT seq, CAST(SUM(v) OVER (ORDER BY seq ROWS BETWEEN 1023 PRECEDING AND CURRENT ROW) AS BIGINT) AS v FROM z"""
)
def fir_two_inputs_1024(spark, d):
    return fir(1024, wrap=False)(zip_streams([events(spark, d), orders(spark, d)], lambda a, b: {"v": a + b})).df


# -- composites -----------------------------------------------------------------
@query(
    f"""WITH e AS ({E}) SELECT seq * 4 AS seq, v + 2 AS v FROM e UNION ALL SELECT seq * 4 + 1, v + 1 FROM e
    UNION ALL SELECT seq * 4 + 2, v + 1 FROM e UNION ALL SELECT seq * 4 + 3, v FROM e"""
)
def nested_splitjoin(spark, d):
    """A split-join of split-joins; its source is read once a branch and never counted."""
    inner = splitjoin(split_duplicate(2), [_bump(1), identity], join_rr(1))
    return splitjoin(split_duplicate(2), [pipeline(_bump(1), inner), inner], join_rr(2))(events(spark, d)).df


@query(f"WITH e AS ({E}) SELECT seq, v FROM e")
def identity_rr(spark, d):
    return splitjoin(split_rr(3, [3, 1, 2]), [identity] * 3, join_rr([3, 1, 2]))(events(spark, d)).df


@query(f"WITH e AS ({E}), p AS (SELECT MIN(seq) AS p FROM e WHERE v % 1000 = 7) SELECT seq, CASE WHEN p IS NULL OR seq <= p THEN v + 1 ELSE v * 2 END AS v FROM e, p")
def become_on_signal(spark, d):
    """A kernel that an element tells to become another."""
    return become_when(F.col("v") % 1000 == 7, {"v": F.col("v") + 1}, {"v": F.col("v") * 2})(events(spark, d)).df


# -- programs by calls --------------------------------------------------------
@query(f"WITH e AS ({E}) SELECT seq, CASE WHEN seq < 300 THEN (v + 1) * 3 ELSE -(v + 1) END AS v FROM e")
def program_calls(spark, d):
    """Kernels, streams, calls; one kernel is detached, another makes calls of its own and becomes a third."""
    p = Program()
    a, b, c = p.stream("a"), p.stream("b"), p.stream("c")
    p.call(lambda: events(spark, d), [], [a])

    def inner(s: Stream) -> Stream:
        own = Program()
        own.call(lambda: s, [], [own.stream("in")])
        own.call(_bump(1), ["in"], [own.stream("out")])
        return own.output("out")

    wrong = _bump(100)
    p.call(wrong, [a], [b])
    p.uncall(wrong)
    p.call(inner, [a], [b])
    p.call(become(300, {"v": F.col("v") * 3}, {"v": -F.col("v")}), [b], [c])
    return p.wait(c)


@query("SELECT * FROM (VALUES (0, 'source', ''), (1, 'map', '0'), (2, 'duplicate', '1'), (3, 'map', '2'), (4, 'duplicate', '1'), (5, 'fir', '4'), (6, 'join', '3 5')) t(node, op, inputs)")
def graph_nodes(spark, d):
    """The program graph, sorted topologically, without running it."""
    s = pipeline(_bump(1), splitjoin(split_duplicate(2), [_bump(1), fir(4)], join_rr(1)))(events(spark, d))
    return spark.createDataFrame([(i, op, " ".join(map(str, above))) for i, op, _, above in nodes(s)], "node int, op string, inputs string")


# -- programs as text -----------------------------------------------------------
TEXT = """
static { int shift; int[4] weights = {1, 0, 2, 5}; init { shift = 3; weights[1] = 4; } }
int twice(int x) { return x * 2; }
int clip(int x, int top) { int y = x; y = y > top ? top : y; return y; }
int->int filter Shared { work { push(pop() * weights[1] + weights[3] + shift); } }
int->int filter Ready(int n) { int[n] table; init { for (int i = 0; i < n; i++) table[i] = i * i; } work { push(pop() + table[n - 1]); } }
int->int pipeline Captured(int n) { int own = 10; for (int i = 0; i < n; i++) { add int->int filter { work { push(pop() + own * i); } }; } }
int->int filter Calls { work { push(twice(clip(pop(), 20000)) + 1); } }
int->int filter Branches { work { int x = pop(); int y = 1; if (x % 3 == 0) { y = x; push(x); } else if (x % 3 == 1) y = 2; push(y); } }
int->int filter Odd { work { int x = pop(); if (x % 2 != 0) push(x); } }
int->int filter Precedence { work { int x = pop() % 1000; push(x + 2 * 3 << 1 | x & 0x0F ^ 5); push(!(x > 500) && x != 3 ? -x : ~x); } }
int->int filter Leaves { work { int x = pop(); int t = 0; for (int i = 0; i < 10; i++) { if (i == 2) continue; if (i == 5) break; t += x + i; } do { t--; } while (false); push(t); } }
float->float filter Floats { work { push(pop() * 1.5e1 + .5 - 2.); } }
int->void filter Show { work { println(pop()); } }
float->void filter ShowFloat { work { println(pop()); } }
void->int filter Count { int x; work { push(x++); } }
int->int filter Add(int k) { work { push(pop() + k); } }
void->int pipeline From(int k) { add Count; add Add(k); }
void->int splitjoin Sources { split roundrobin(0); add From(0); add From(100); join roundrobin(2, 1); }
int->int splitjoin Same { split roundrobin(2, 3); add Identity<int>; add Identity<int>; join roundrobin(2, 3); }
int->int filter First { int t; prework { t = pop(); push(-t); } work { push(pop() - t); } }
"""


def _text(name: str, sql: str, *args, source=events, limit=None, key: str = ""):
    def run(spark, d):
        return load(spark, TEXT, name, *args, limit=limit)(source(spark, d) if source else None).df

    query(sql, name=key)(run)


_V = f"WITH e AS (SELECT seq, CAST(v AS INTEGER) AS v FROM ({E}))"
_text("Shared", f"{_V} SELECT seq, CAST(v * 4 + 8 AS INTEGER) AS v FROM e", key="text_static")
_text("Ready", f"{_V} SELECT seq, CAST(v + 36 AS INTEGER) AS v FROM e", 7, key="text_init")
_text("Captured", f"{_V} SELECT seq, CAST(v + 60 AS INTEGER) AS v FROM e", 4, key="text_capture")
_text("Calls", f"{_V} SELECT seq, CAST(LEAST(v, 20000) * 2 + 1 AS INTEGER) AS v FROM e", key="text_functions")
_text(
    "Branches",
    f"""{_V}, p AS (SELECT seq, 0 AS j, v FROM e WHERE v % 3 = 0 UNION ALL SELECT seq, 1, CASE v % 3 WHEN 0 THEN v WHEN 1 THEN 2 ELSE 1 END FROM e)
    SELECT ROW_NUMBER() OVER (ORDER BY seq, j) - 1 AS seq, CAST(v AS INTEGER) AS v FROM p""",
    key="text_branches",
)
_text("Odd", f"{_V} SELECT ROW_NUMBER() OVER (ORDER BY seq) - 1 AS seq, v FROM e WHERE v % 2 <> 0", key="text_predicate")
_text(
    "Precedence",
    f"""{_V}, p AS (SELECT seq, v % 1000 AS x FROM e) SELECT seq * 2 AS seq, CAST(xor(((x + 12) | x) & 15, 5) AS INTEGER) AS v FROM p
    UNION ALL SELECT seq * 2 + 1, CAST(CASE WHEN x <= 500 AND x <> 3 THEN -x ELSE -x - 1 END AS INTEGER) FROM p""",
    key="text_precedence",
)
_text("Leaves", f"{_V} SELECT seq, CAST(4 * v + 7 AS INTEGER) AS v FROM e", key="text_leave")
_text("Floats", "SELECT event_id AS seq, CAST(value AS FLOAT) * CAST(15 AS FLOAT) + CAST(0.5 AS FLOAT) - CAST(2 AS FLOAT) AS v FROM events", source=_floats, key="text_floats")
_text("Show", f"{_V} SELECT seq, CAST(v AS VARCHAR) AS v FROM e", key="text_println")
_text("ShowFloat", "SELECT event_id AS seq, printf('%.6f', CAST(CAST(ROUND(value * 4) / 4 AS FLOAT) AS DOUBLE)) AS v FROM events", source=lambda s, d: map_stream(v=(F.round(F.col("value") * 4) / 4).cast("float"))(from_dense(s.read.parquet(f"{d}/events.parquet"), "event_id", F.col("value"))), key="text_println_float")
_text("Sources", "SELECT i AS seq, CAST(CASE i % 3 WHEN 2 THEN i // 3 + 100 ELSE i // 3 * 2 + i % 3 END AS INTEGER) AS v FROM RANGE(1500) t(i)", source=None, limit=1000, key="text_sources_rr0")
_text("Same", f"{_V} SELECT seq, CAST(v AS BIGINT) AS v FROM e", key="text_identity")
_text("First", f"{_V} SELECT seq, CAST(CASE WHEN seq = 0 THEN -v ELSE v - (SELECT v FROM e WHERE seq = 0) END AS INTEGER) AS v FROM e", key="text_prework")


# -- live graphs ------------------------------------------------------------------
def _live(spark, d):
    path = f"{d}/events*.parquet"
    return file_stream(spark, path, spark.read.parquet(f"{d}/events.parquet").schema)


@query(f"WITH e AS ({E}) SELECT seq, v + 1 AS v FROM e")
def live_map(spark, d):
    """A live source, a map and a sink of the user's, until all that is there has passed."""
    out = _folder(spark, "live")
    rows = _live(spark, d).select(F.col("event_id").alias("seq"), (F.round(F.col("value") * 100).cast("bigint") + 1).alias("v"))
    deliver(rows, lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/out/batch={k}"), f"{out}/log")
    return spark.read.parquet(f"{out}/out").select("seq", "v")


@query("SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def live_keyed_state(spark, d):
    """State by key over a live stream; the last update of each key."""
    out = _folder(spark, "live")
    rows = _live(spark, d).withColumn("value", F.round(F.col("value") * 100))
    updates = run_available(keyed_running(rows, "event_type", "value"), f"live_{uuid.uuid4().hex}", f"{out}/log", "update")
    return updates.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


@query(f"WITH e AS ({E}) SELECT seq, CAST(SUM(v) OVER (ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS INTEGER) AS v FROM e")
def live_fir(spark, d):
    """A filter with a history over micro-batches."""
    out = _folder(spark, "live")
    rows = _live(spark, d).select(F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("int").alias("v"))
    deliver(rows, LiveFir(4, out), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/out").select("seq", "v")
