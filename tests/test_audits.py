"""Audits against SQL and on small frames."""

import datetime as dt

import duckdb
import pytest

from tidemark import registry
from tidemark.functions import audit
from tidemark.plans import audits
from tidemark.sources import retail

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(audits.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in retail.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    show = lambda rows: sorted(tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert show(registry.queries()[name](spark, DIR).select(*names).collect()) == show(got.fetchall())


def test_small_frames(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("a", d, None), ("a", d + dt.timedelta(3), 1.0), (None, d, 2.0)], "k string, sales_date date, `odd name` double")
    assert {(r.key, r.value) for r in audit.nulls(df).collect()} == {("k", 1 / 3), ("sales_date", 0.0), ("odd name", 1 / 3)}
    assert [(r.key, r.value) for r in audit.gaps(df, ["k"]).collect()] == [("a 2020-01-04", 3.0)]
    empty = {r.key: r.value for r in audit.profile(df.limit(0)).collect()}
    assert empty["n_rows"] == 0 and empty["first_day"] is None and empty["n_columns"] == 3
    counts = audit.row_counts(spark, {"df": lambda: df, "gone": lambda: spark.read.parquet("/tmp/no/such/table")})
    assert {(r.key, r.value) for r in counts.collect()} == {("df", 3.0), ("gone", -1.0)}
    roles = audit.contract(df, {"key": ["k"], "other": ["k", "missing"]})
    assert {(r.key, r.value) for r in roles.collect()} == {("k", 1.0), ("missing", -1.0), ("sales_date", 0.0), ("odd name", 0.0)}
    assert audit.summary(counts, roles).count() == 6


def test_mean_importance(spark):
    rows = [("m", "revenue", "x", 10.0), ("m", "revenue", "y", 0.05), ("m", "cogs", "x", 4.0), ("m", "cogs", "y", 0.02), ("n", "cogs", "x", 0.0), ("n", "cogs", "y", 0.0)]
    got = {r.feature: r for r in audit.mean_importance(spark.createDataFrame(rows, "model string, target string, feature string, importance double")).collect()}
    assert got["x"].mean_share == pytest.approx(2 / 3) and not got["x"].is_weak
    assert got["y"].mean_share == pytest.approx(0.01 / 3) and got["y"].is_weak
