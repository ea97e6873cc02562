"""Every query with an oracle gives DuckDB's rows; every query runs."""

import glob
import math
import os
import threading

import duckdb
import pytest

from tesserae import catalog


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


def near_balances(spark, folder, supplier, customer):
    supplier.toDF("s_suppkey", "s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    customer.toDF("c_custkey", "c_acctbal").write.parquet(f"{folder}/customer.parquet")
    return catalog.queries()["range_join_buckets"](spark, str(folder)).select("s_suppkey", "near")


def test_range_join_buckets_on_odd_inputs(spark, tmp_path):
    """Null and repeated keys, null, infinite and NaN balances, balances on the bounds."""
    nan, inf = float("nan"), float("inf")
    supplier = [(1, 0.0), (1, 40.0), (2, None), (None, 10.0), (None, 500.0), (3, inf), (4, -inf), (5, nan), (6, 1e6)]
    customer = [(1, 0.0), (2, -50.0), (3, 50.0), (4, 50.01), (5, None), (None, 1.0), (6, inf), (7, nan), (8, -inf), (9, 90.0), (9, 90.0)]
    got = near_balances(spark, tmp_path, *[spark.createDataFrame(r, "k long, v double") for r in (supplier, customer)]).collect()
    c = duckdb.connect()
    for t in ("supplier", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, c.sql(catalog.oracle_sql()["range_join_buckets"]).fetchall()))


def test_range_join_buckets_does_not_form_pairs(spark, tmp_path):
    """400,000 suppliers and as many customers, all near each other: 160 billion pairs, on which it is stopped after a minute."""
    n = 400_000
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = near_balances(spark, tmp_path, *[spark.range(n).selectExpr("id", f"id % {k} / 4D") for k in (50, 70)]).groupBy("near").count().collect()
    finally:
        stop.cancel()
    assert [tuple(r) for r in got] == [(n, n)]


def test_names_are_unique():
    with pytest.raises(ValueError):
        catalog.query(next(iter(catalog.queries())))(lambda s, d: None)
