"""Compare a query with its SQL on the same tables, without regard to row order."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tolist"):
        return tuple(value.tolist())
    return tuple(normal(v) for v in value) if isinstance(value, list) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql, sf_dir):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = connect(sf_dir).sql(sql)
    want = rows_of(answer.columns, answer.fetchall())
    assert sorted(df.columns) == sorted(answer.columns)
    assert len(got) == len(want)
    assert got == want
