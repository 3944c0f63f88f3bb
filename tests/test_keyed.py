"""Keyed series against SQL, and against the national series' queries where there are no keys."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import keyed
from tidemark.plans import regional
from tidemark.sources import retail

DIR = "/root/testdata/sf0.001"


def rows(df, names):
    return sorted(tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in retail.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(regional.CHECKS))
def test_against_sql(spark, views, name):
    got = views.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = sorted(tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in got.fetchall())
    assert rows(registry.queries()[name](spark, DIR), names) == want


def test_no_keys_are_one_series(spark):
    """The national queries' rows, from the keyed functions without keys."""
    sales = retail.load(spark, DIR, ("sales",))["sales"].select("sales_date", "revenue", "cogs")
    full = keyed.features(sales).cache()
    renamed = {
        "F17": {f"revenue_{g}_growth": f"lag_1d_rev_{g}_growth" for g in ("wow", "mom", "yoy")} | {"revenue_diff_7d": "revenue_diff_7d", "cogs_diff_7d": "cogs_diff_7d"},
        "F20": {f"revenue_mean_{k}": f"roll_mean_{k}d_revenue" for k in (7, 28, 365)} | {f"revenue_std_{k}": f"roll_std_{k}d_revenue" for k in (7, 28, 365)} | {f"{c}_mean_{k}": f"roll_mean_{k}d_{c}" for c in ("cogs", "cogs_ratio") for k in (7, 28)},
        "F23": {"ewm_deviation": "volatility"},
    }
    mine = full.withColumn("volatility", F.sqrt("ewm_vol_7d_revenue"))
    for query, names in renamed.items():
        theirs = registry.queries()[query](spark, DIR).select("sales_date", *[F.col(c).alias(f"w_{c}") for c in names])
        both = mine.join(theirs, "sales_date")
        assert both.count() == theirs.count() == sales.count()
        for want, own in names.items():
            off = both.filter(~(F.col(own).isNull() & F.col(f"w_{want}").isNull())).filter(F.coalesce(F.abs(F.col(own) - F.col(f"w_{want}")) > 1e-3, F.lit(True)))
            assert off.count() == 0, (query, want)
    full.unpersist()


def test_null_keys_gaps_and_short_series(spark):
    d = dt.date(2020, 2, 28)
    data = [(None, d, 1.0, 2.0), (None, d + dt.timedelta(3), 3.0, 1.0), ("a", d, 0.0, 1.0), ("a", d + dt.timedelta(1), 5.0, None)]
    df = spark.createDataFrame(data, "k string, sales_date date, revenue double, cogs double")
    full = keyed.dense(df, ["k"])
    assert sorted((str(r.k), str(r.sales_date), r.revenue) for r in full.collect()) == [("None", "2020-02-28", 1.0), ("None", "2020-02-29", 0.0), ("None", "2020-03-01", 0.0), ("None", "2020-03-02", 3.0), ("a", "2020-02-28", 0.0), ("a", "2020-02-29", 5.0)]
    out = {(r.k, str(r.sales_date)): r for r in keyed.features(full, ["k"]).collect()}
    assert len(out) == 6 and out[None, "2020-03-02"].lag_3d_revenue == 1.0 and out["a", "2020-02-29"].lag_1d_cogs_ratio is None
    assert out[None, "2020-03-01"].trend_7d_revenue == pytest.approx(-1.0) and out[None, "2020-02-29"].trend_7d_revenue is None
    naive = {(r.k, r.step): r.revenue for r in keyed.seasonal_naive(full, ["k"], horizon=5, period=3).collect()}
    assert [naive[None, i] for i in range(1, 6)] == [0.0, 0.0, 3.0, 0.0, 0.0] and [naive["a", i] for i in range(1, 6)] == [5.0] * 5
    assert keyed.features(full.limit(0), ["k"]).count() == keyed.seasonal_naive(full.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("transform", ["identity", "residual", "log", "log_residual"])
@pytest.mark.parametrize("cogs", ["absolute", "ratio"])
def test_inverse_undoes_forward(spark, transform, cogs):
    df = spark.createDataFrame([(10.0, 4.0), (0.0, 0.0), (3.0, 9.0)], "revenue double, cogs double").withColumns({"revenue_baseline": F.lit(2.0), "cogs_baseline": F.lit(1.0), "log_revenue_baseline": F.lit(0.5), "log_cogs_baseline": F.lit(0.25)})
    labels = keyed.forward(df, transform, cogs).withColumns({"revenue_prediction": F.col("revenue_label"), "cogs_prediction": F.col("cogs_label")})
    for r in keyed.inverse(labels, transform, cogs).collect():
        assert r.predicted_revenue == pytest.approx(r.revenue)
        assert r.predicted_cogs == pytest.approx(min(r.cogs, 2 * r.revenue) if cogs == "ratio" else r.cogs)
    below = keyed.inverse(df.withColumns({"revenue_prediction": F.lit(-99.0), "cogs_prediction": F.lit(-99.0)}), transform, cogs)
    assert all(r.predicted_revenue == 0 and r.predicted_cogs == 0 for r in below.collect())
