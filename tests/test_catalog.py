import pytest
from oracle import assert_same

from runnel.plans import catalog_kernels  # noqa: F401
from runnel.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        assert_same(df, ORACLES[name], data)
    else:
        assert df.count()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fold_of_all_events(spark, tmp_path):
    """Past the first 2000 elements and the first Arrow batch."""
    from pyspark.sql import functions as F

    spark.range(25_000).select(F.col("id").alias("event_id"), ((F.col("id") * 7919) % 50_021 / 100).alias("value")).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    state, want = 0, []
    for i in range(25_000):
        state = (state * 31 + i * 7919 % 50_021) % 1009
        want.append((i, state))
    assert sorted(tuple(r) for r in QUERIES["ordered_fold_whole"](spark, str(tmp_path)).collect()) == want


def test_math_of_zero_and_beyond(spark, tmp_path):
    """A log of 0, NaN and values past 64 bits have no integer: null, as in the SQL with a cast that may fail."""
    import math

    rows = list(enumerate([0.0, 0.01, 7.25, -3.2, 2.0**62, 1e30, math.inf, math.nan]))
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["math_builtins"](spark, str(tmp_path))
    assert_same(df, ORACLES["math_builtins"].replace("CAST(ROUND", "TRY_CAST(ROUND"), str(tmp_path))
    got = {r.seq: r for r in df.collect()}
    assert got[0].log_ is None and got[0].cos_ == 10000 and got[1].log_ == -46052
    assert got[4].floor_ == got[4].round_ == 2**62 and got[7].floor_ is got[7].round_ is None
