"""Random graphs against the simulator, algebraic laws, edge shapes, sinks, live graphs."""

import random

import numpy as np
import pytest
import simulator as sim
from pyspark.sql import functions as F

from runnel import functions as S
from runnel.operators import decimate, fir, join_rr, map_stream, peek, pipeline, running, split_duplicate, split_rr, splitjoin, take, where, zip_streams
from runnel.plans import Program, check_rates, to_dot
from runnel.sources import counter, countdown, hello, raw_file, rate_report, write_raw
from runnel.stream import Stream


def make(spark, values, parts=3):
    rows = [(i, v) for i, v in enumerate(values)]
    return Stream(spark.createDataFrame(rows, "seq long, v int").repartition(parts))


def values(s):
    rows = s.ordered().collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    return [r.v for r in rows]


def test_random_splits_and_joins(spark):
    rng = random.Random(7)
    for _ in range(6):
        n, k = rng.randrange(0, 60), rng.randrange(1, 4)
        w = [rng.randrange(0, 5) for _ in range(k - 1)] + [rng.randrange(1, 5)]
        u = [rng.randrange(1, 4) for _ in range(k)]
        data = [rng.randrange(-(2**31), 2**31) for _ in range(n)]
        parts = split_rr(k, w)(make(spark, data))
        assert [values(p) for p in parts] == sim.split(data, w)
        for full in (False, True):
            assert values(join_rr(u, full)(parts)) == sim.join(sim.split(data, w), u, full)


@pytest.mark.parametrize("n", [0, 1, 5, 40])
def test_windows(spark, n):
    rng = random.Random(n)
    data = [rng.randrange(-(2**31), 2**31) for _ in range(n)]
    s = make(spark, data)
    taps = [rng.randrange(-5, 6) for _ in range(7)]
    assert values(fir(taps, block=8)(s)) == sim.fir(data, taps)
    assert values(fir(9, block=4)(s)) == sim.fir(data, [1] * 9)
    for pop in (1, 2, 3):
        got = values(peek(4, {"v": F.max("v")}, pop=pop, block=6)(s))
        assert got == sim.peek(data, 4, pop, max)
    total = [sum(data[: i + 1]) for i in range(n)]
    assert values(running("v", block=8)(s)) == total


def test_chained_fir_wraps(spark):
    want = list(range(200, 0, -1))
    for _ in range(3):
        want = sim.fir(want, [1] * 64)
    assert values(pipeline(*[fir(64, block=70)] * 3)(countdown(spark, 200))) == want


def test_laws(spark):
    data = list(range(37))
    for parts in (1, 4, 16):
        s = make(spark, data, parts)
        assert values(splitjoin(split_rr(3, [3, 1, 2]), [lambda x: x] * 3, join_rr([3, 1, 2]))(s)) == data
        assert values(splitjoin(split_duplicate(2), [lambda x: x] * 2, join_rr(1))(s)) == [x for x in data for _ in range(2)]
        assert values(where(F.col("v") % 2 == 1)(s)) == data[1::2]
        assert values(decimate(5)(s)) == data[:35:5]
    fused = pipeline(map_stream(v=F.col("v") + 1), map_stream(v=F.col("v") * 3))(make(spark, data))
    assert fused.df._jdf.queryExecution().optimizedPlan().toString().count("Project") <= 1
    assert values(zip_streams([make(spark, data), make(spark, data[:9])], lambda a, b: {"v": a + b})) == [2 * x for x in range(9)]


def test_nested_splitjoins_read_each_branch_once(spark, data):
    """Reads grow with the branches; lengths are arithmetic, so a source is counted at most once a join."""
    from runnel.stream import from_dense

    events = spark.read.parquet(f"{data}/events.parquet")

    def nest(depth, weights):
        stage = map_stream(v=F.col("v") + 1)
        for _ in range(depth):
            stage = splitjoin(split_duplicate(2), [stage, stage], join_rr(weights))
        return stage(from_dense(events, "event_id", F.col("user_id").alias("v")))

    def scans(s):
        return s.df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert [scans(nest(k, 1)) for k in (1, 2, 3, 4)] == [2, 4, 8, 16]
    assert [scans(nest(k, 2)) for k in (1, 2, 3, 4)] == [3, 7, 15, 31]


def test_lengths(spark):
    """The arithmetic of lengths against what operators give."""
    for n in (0, 1, 7, 23):
        s = make(spark, list(range(n)))
        made = [decimate(3)(s), decimate(3, offset=2)(s), decimate(4, {"v": F.sum("v")})(s), peek(5, {"v": F.max("v")}, pop=2)(s), *split_rr(3, [2, 1, 4])(s)]
        made += [join_rr([1, 3, 2])(split_rr(3, [2, 1, 4])(s)), zip_streams([s, made[0].pipe(lambda x: x)], lambda a, b: {"v": a + b}), take(5)(s), where(F.col("v") % 3 == 1)(s)]
        for x in made:
            assert x.length().first()[0] == len(values(x))


def test_renumber_and_long_taps(spark):
    from runnel.operators import explode_each
    from runnel.stream import renumber

    rng = random.Random(5)
    data = [rng.randrange(-(2**31), 2**31) for _ in range(200)]
    s = make(spark, data)
    kept = renumber(s.df.where("v % 3 = 0"), block=16).orderBy("seq").collect()
    assert [(r.seq, r.v) for r in kept] == list(enumerate(x for x in data if x % 3 == 0))
    twice = explode_each(F.expr("IF(v % 2 = 0, array(v, v), array())"))(s)
    assert values(twice) == [x for x in data if x % 2 == 0 for _ in range(2)]
    assert "Checkpoint" not in str(where(F.col("v") > 0)(s).df._jdf.queryExecution().optimizedPlan()) and values(where(F.lit(None).cast("boolean"))(s)) == []
    taps = [rng.randrange(-9, 9) for _ in range(45)]
    assert values(fir(taps, block=64)(s)) == sim.fir(data, taps)


def test_rate_sink():
    from runnel.sources import RateSink

    class Batch:
        def count(self):
            return 40

    sink = RateSink(100)
    for k in range(3):
        sink(Batch(), k)
    assert [r[0] for r in sink.reports] == [120] and sink.every >= 1


def test_scalars(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, -2.5, -7)], "a double, b double, i int")
    a, b, i = F.col("a"), F.col("b"), F.col("i")
    row = df.select(
        S.f_ne(a, b), S.f_gt(a, b), S.round_half_up(b), S.f_round(b), S.i_div(i, F.lit(2)), S.i_rem(i, F.lit(2)), S.i_div(i, F.lit(0)),
        S.i_mul(F.lit(2**31 - 1), F.lit(2)), S.i_shr(i, 1), S.f_log(F.lit(0.0)), S.f_log(F.lit(-1.0)), S.to_int(F.lit(1e20)),
    ).first()
    assert tuple(row)[:10] == (False, False, -2, -3.0, -3, -1, None, -2, -4, float("-inf"))
    assert np.isnan(row[10]) and row[11] is None
    one = {k: f(F.lit(0.25)) for k, f in S.MATH.items()}
    got = spark.range(1).select(*(c.alias(k) for k, c in one.items())).first().asDict()
    want = {"sin": np.sin, "cos": np.cos, "atan": np.arctan, "abs": abs, "round": lambda x: 0.0, "sqrt": np.sqrt, "exp": np.exp, "log": np.log, "floor": np.floor}
    assert all(abs(got[k] - f(0.25)) < 1e-6 for k, f in want.items())


def test_files_and_sinks(spark, tmp_path):
    s = counter(spark, 1000, start=-3)
    assert write_raw(s, str(tmp_path / "raw")) == 1000
    again = raw_file(spark, str(tmp_path / "raw"), repeats=2)
    assert values(again) == [*range(-3, 997)] * 2
    assert rate_report(s)["samples"] == 1000
    assert hello(spark, 3).first()[0] == "hello from 3"


def test_program(spark):
    p = Program()
    a, b = p.stream("a"), p.stream("b")
    p.call(lambda: counter(spark, 10), [], [a])
    double = map_stream(v=F.col("v") * 2)
    p.call(double, [a], [b])
    assert [r.v for r in p.wait(b).collect()] == list(range(0, 20, 2))
    with pytest.raises(ValueError):
        p.call(double, [a], [b])
    assert "map" in to_dot(p.output(b)) and check_rates(p.output(b), {"map": {"push": 2}}) == ["map: push is 1, declared 2"]
    p.uncall(double)
    with pytest.raises(ValueError):
        p.output(b)


def test_live(spark, data, tmp_path):
    from runnel.streaming import LiveFir, file_stream, keyed_running, run_available

    source = spark.read.parquet(f"{data}/events.parquet").limit(600)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    live = file_stream(spark, str(tmp_path / "in"), source.schema, max_files=1)
    got = run_available(keyed_running(live.withColumn("value", F.round(F.col("value") * 100)), "event_type", "value"), "totals", str(tmp_path / "cp"), "update")
    last = {r.event_type: r.n for r in got.groupBy("event_type").agg(F.max("n").alias("n")).collect()}
    want = {r.event_type: r["count"] for r in source.groupBy("event_type").count().collect()}
    assert last == want
    op = LiveFir(4, str(tmp_path / "fir"))
    for k in range(3):
        op(spark.range(k * 10, k * 10 + 10).selectExpr("id AS seq", "CAST(id AS INT) AS v"), k)
    out = spark.read.parquet(str(tmp_path / "fir/out")).orderBy("seq").collect()
    assert [r.v for r in out] == sim.fir(list(range(30)), [1] * 4)
