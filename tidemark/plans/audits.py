"""Audits of the regional series as queries; the checking SQL is written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import audit, keyed
from tidemark.operators import models
from tidemark.plans import forecasts, regional
from tidemark.plans.regional import DAY, KEYS, rounded
from tidemark.sources import retail, shared

ROLES = {"key": ["region"], "day": [DAY], "target": ["revenue", "cogs"], "derived": ["cogs_ratio", "lag_1d_revenue", "order_count"]}


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed.ratio(regional.series(spark, sf_dir))
    return rows.withColumn("lag_1d_revenue", F.lag("revenue", 1).over(keyed.over(KEYS))).withColumn("day_of_week", F.weekday(DAY))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit.row_counts(spark, {name: table(name) for name in ("orders", "lineitem", "customer", "submission_sample")})


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 over a boosted and a forest model of both targets."""
    s = shared.written(regional.series(spark, sf_dir), "series")
    rows, found = forecasts.dated(s, s), []
    for kind in ("gbt", "forest"):
        model = models.fit(rows, models.STATIC, models.Settings(kind=kind, rounds=5, depth=3))
        found += [(kind, t, f, float(m.featureImportances[i])) for t, m in (("revenue", model.revenue), ("cogs", model.cogs)) for i, f in enumerate(model.features)]
    return audit.mean_importance(spark.createDataFrame(found, "model string, target string, feature string, importance double"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    return audit.summary(audit.profile(f), audit.nulls(f), audit.gaps(f.filter("revenue > 0"), KEYS), counts(spark, sf_dir), audit.contract(f, ROLES))


BUILD = {
    "D1": lambda spark, sf_dir: audit.profile(frame(spark, sf_dir)),
    "D2_all": lambda spark, sf_dir: audit.nulls(frame(spark, sf_dir)),
    "D3_keyed": lambda spark, sf_dir: audit.gaps(frame(spark, sf_dir).filter("revenue > 0"), KEYS),
    "D4": counts, "D9": importances, "D11": whole,
    "D10": lambda spark, sf_dir: audit.contract(frame(spark, sf_dir), ROLES),
}
NULL_SQL = " union all ".join(f"select 'nulls' as section, '{c}' as key, round({share}, 6) as value from s" for c, share in (("region", "0.0::double"), ("sales_date", "0.0::double"), ("revenue", "0.0::double"), ("cogs", "0.0::double"), ("cogs_ratio", "avg(case when cogs_ratio is null then 1.0 else 0.0 end)"), ("lag_1d_revenue", "avg(case when n = 1 then 1.0 else 0.0 end)"), ("day_of_week", "0.0::double"))).replace("round(0.0::double, 6) as value from s", "0.0::double as value")
SQL = {
    "D1": "select 'schema' as section, key, value from (select unnest(['n_rows', 'first_day', 'last_day', 'n_columns', 'columns_date', 'columns_double', 'columns_int', 'columns_string']) as key, unnest([count(*)::double, min(date_diff('day', date '1970-01-01', sales_date))::double, max(date_diff('day', date '1970-01-01', sales_date))::double, 7.0::double, 1.0::double, 4.0::double, 1.0::double, 1.0::double]) as value from s) x",
    "D2_all": NULL_SQL,
    "D3_keyed": "select 'gaps' as section, region || ' ' || strftime(sales_date, '%Y-%m-%d') as key, cast(date_diff('day', before, sales_date) as double) as value from (select region, sales_date, lag(sales_date) over (partition by region order by sales_date) as before from s where revenue > 0) x where date_diff('day', before, sales_date) > 1",
    "D4": "select 'rows' as section, 'orders' as key, count(*)::double as value from orders union all select 'rows', 'lineitem', count(*)::double from lineitem union all select 'rows', 'customer', count(*)::double from customer union all select 'rows', 'submission_sample', -1.0",
    "D10": "select 'columns' as section, unnest(['region', 'sales_date', 'revenue', 'cogs', 'cogs_ratio', 'lag_1d_revenue', 'order_count', 'day_of_week']) as key, unnest([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, -1.0, 0.0]::double[]) as value",
}
SQL["D11"] = " union all ".join(f"select * from ({SQL[k]}) {k}" for k in ("D1", "D2_all", "D3_keyed", "D4", "D10"))


def queries():
    return {k: (lambda spark, sf_dir, make=make: rounded(make(spark, sf_dir))) for k, make in BUILD.items()}


def oracle_sql():
    return {k: f"{retail.ctes(*regional.INPUTS)}{regional.REGIONAL} {sql}" for k, sql in SQL.items()}
