"""Promotion months, sale seasons, peaks and audits of the daily series as functions from DataFrame to DataFrame; the checking SQL is written apart.

A calendar has some dates for each year, so windows over days and dates stay small whatever the number of orders."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.sources import retail

# fixed values: month, first day, length in days and rank of each sale season; months whose first day is a peak; distance where no event is
SEASONS = ((1, 30, 30, 1), (3, 18, 30, 2), (6, 23, 29, 3), (7, 30, 34, 5), (8, 30, 32, 4), (11, 18, 45, 6))
PEAKS = (4, 5, 11)
FAR = 999

FEATURES = ("cogs_ratio", "dow_mean", "month_mean", "dom_mean", "revenue_lag_1", "revenue_lag_7")


def promo_months(promotions: DataFrame) -> DataFrame:
    """each month's distinct promotion days, their chance over the years with promotions, and the mean discount."""
    days = promotions.select("discount_value", F.explode(F.sequence("start_date", "end_date")).alias("d"))
    length = F.when(F.col("month") == 2, 28.25).when(F.col("month").isin(4, 6, 9, 11), 30.0).otherwise(31.0)
    return (
        days.groupBy(F.month("d").alias("month"))
        .agg(F.countDistinct("d").alias("promo_days"), F.countDistinct(F.year("d")).alias("promo_years"), F.round(F.avg("discount_value"), 6).alias("mean_discount"))
        .withColumn("promo_probability", F.round(F.col("promo_days") / F.col("promo_years") / length, 6))
    )


def years(sales: DataFrame) -> DataFrame:
    """A row for each year from the one before the series to the one after it."""
    span = sales.agg(F.year(F.min("sales_date")).alias("lo"), F.year(F.max("sales_date")).alias("hi")).filter("lo is not null")
    return span.select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("y"))


def season_days(sales: DataFrame) -> DataFrame:
    """each day of a sale season with the highest rank of the seasons that it is in."""
    season = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("n"), F.lit(r).alias("r")) for m, d, n, r in SEASONS]))
    first = years(sales).select("y", season.alias("s")).select(F.make_date("y", "s.m", "s.d").alias("first"), "s.n", "s.r")
    day = F.explode(F.sequence("first", F.date_add("first", F.col("n") - 1))).alias("sales_date")
    return first.select("r", day).groupBy("sales_date").agg(F.max("r").alias("sale_rank"))


def sale_flags(sales: DataFrame) -> DataFrame:
    """whether a day is in a sale season, and its highest rank."""
    joined = sales.select("sales_date").join(season_days(sales), "sales_date", "left")
    return joined.select("sales_date", F.col("sale_rank").isNotNull().cast("int").alias("is_sale_season"), F.coalesce("sale_rank", F.lit(0)).alias("sale_rank"))


def nearest_events(sales: DataFrame, events: DataFrame) -> DataFrame:
    """Days to the next event and since the last one, 0 on its day, FAR where there is none; by one sort of days and events, not a range join."""
    both = sales.select("sales_date", F.lit(None).cast("date").alias("event")).unionByName(events.select("sales_date", F.col("sales_date").alias("event")))
    order = Window.orderBy("sales_date")
    before, after = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    seen = both.select("sales_date", "event", F.max("event").over(before).alias("last"), F.min("event").over(after).alias("next")).filter("event is null")
    gap = lambda a, b: F.coalesce(F.datediff(a, b), F.lit(FAR))
    return seen.select("sales_date", gap("next", "sales_date").alias("days_to_next"), gap("sales_date", "last").alias("days_since_last"))


def peak_proximity(sales: DataFrame) -> DataFrame:
    """whether a day's month has a peak, and the reciprocal of one more than the days to the nearest peak."""
    peaks = years(sales).select(F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(1)) for m in PEAKS])).alias("sales_date"))
    near = F.least("days_to_next", "days_since_last")
    return nearest_events(sales, peaks).select(
        "sales_date", F.month("sales_date").isin(*PEAKS).cast("int").alias("is_peak_season"), F.round(1.0 / (1.0 + near), 8).alias("peak_proximity")
    )


def target_stats(features: DataFrame) -> DataFrame:
    """Mean and deviation of the targets and of the residual, and the residual's deviation over the revenue's."""
    named = ("revenue", "cogs", "residual")
    wide = features.agg(
        *[(F.round(f(c), 4) + 0.0).alias(f"{c}_{n}") for c in named for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.round(F.stddev_samp("residual") / F.stddev_samp("revenue"), 6).alias("residual_std_over_revenue_std"),
    )
    return wide.unpivot([], wide.columns, "statistic", "value")


def top_correlations(features: DataFrame, target: str = "revenue", top: int = 5) -> DataFrame:
    """The features with the highest absolute correlations with a target, from one scan; ties by name."""
    wide = features.agg(*[F.round(F.abs(F.corr(c, target)), 6).alias(c) for c in FEATURES])
    return wide.unpivot([], list(FEATURES), "feature", "correlation").filter("correlation is not null").orderBy(F.desc("correlation"), "feature").limit(top)


def redundant_pairs(features: DataFrame, least: float = 0.95) -> DataFrame:
    """Pairs of columns whose absolute correlation is over least, from one scan."""
    pairs = list(combinations(("revenue", "cogs", "baseline", *FEATURES), 2))
    wide = features.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    part = F.split("pair", r"\|")
    return wide.unpivot([], wide.columns, "pair", "correlation").filter(F.abs("correlation") > least).select(part[0].alias("left_column"), part[1].alias("right_column"), "correlation")


def correlation_sql() -> str:
    named = ("revenue", "cogs", "baseline", *FEATURES)
    return " union all ".join(f"select '{a}' as left_column, '{b}' as right_column, round(corr({a}, {b}), 6) as correlation from features" for i, a in enumerate(named) for b in named[i + 1 :])


SEASON_SQL = f"""season_days as (select s.sales_date, v.r from sales s cross join (values (0), (1)) as back(k)
 join (values {", ".join(str(x) for x in SEASONS)}) as v(m, d, n, r)
 on date_diff('day', make_date(year(s.sales_date) - back.k, v.m, v.d), s.sales_date) between 0 and v.n - 1)"""
EVENT_SQL = f"""events_days as (select distinct cast(make_date(cast(y as int), m, d) + to_days(cast(i as int)) as date) as event from range((select min(year(sales_date)) - 1 from sales), (select max(year(sales_date)) + 2 from sales)) t(y)
 cross join (values {", ".join(str(x) for x in SEASONS)}) as v(m, d, n, r) cross join range(60) k(i) where i < n)"""
PEAK_SQL = f"""peaks as (select make_date(cast(y as int), m, 1) as peak from range((select min(year(sales_date)) - 1 from sales), (select max(year(sales_date)) + 2 from sales)) t(y) cross join (values {", ".join(f"({m})" for m in PEAKS)}) p(m))"""
STATS_SQL = " union all ".join(f"select '{c}_{n}' as statistic, round({f}({c}), 4) + 0.0 as value from features" for c in ("revenue", "cogs", "residual") for n, f in (("mean", "avg"), ("std", "stddev_samp")))
CHECKS = {
    "F10": (("promotions",), "", "select month(d) as month, count(distinct d) as promo_days, count(distinct year(d)) as promo_years, round(avg(discount_value), 6) as mean_discount, round(count(distinct d)::double / count(distinct year(d)) / any_value(case when month(d) = 2 then 28.25 else day(last_day(make_date(2001, month(d), 1))) end), 6) as promo_probability from (select discount_value, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as d from promotions) x group by 1"),
    "F12": (("sales",), f", {SEASON_SQL}", "select s.sales_date, cast(count(r) > 0 as int) as is_sale_season, coalesce(max(r), 0) as sale_rank from sales s left join season_days x using (sales_date) group by s.sales_date"),
    "F13": (("sales",), f", {EVENT_SQL}", f"select sales_date, cast(coalesce(min(date_diff('day', sales_date, event)) filter (where event >= sales_date), {FAR}) as int) as days_to_next, cast(coalesce(min(date_diff('day', event, sales_date)) filter (where event <= sales_date), {FAR}) as int) as days_since_last from sales cross join events_days group by sales_date"),
    "F14": (("sales",), f", {PEAK_SQL}", f"select sales_date, cast(month(sales_date) in {PEAKS} as int) as is_peak_season, round(1.0::double / (1 + min(abs(date_diff('day', sales_date, peak)))), 8) as peak_proximity from sales cross join peaks group by sales_date"),
    "D5": (("features",), "", f"{STATS_SQL} union all select 'residual_std_over_revenue_std', round(stddev_samp(residual) / stddev_samp(revenue), 6) from features"),
    "D6": (("features",), "", f"select case when left_column = 'revenue' then right_column end as feature, abs(correlation) as correlation from ({correlation_sql()}) x where left_column = 'revenue' and right_column in {FEATURES} and correlation is not null order by 2 desc, 1 limit 5"),
    "D8": (("features",), "", f"select * from ({correlation_sql()}) x where abs(correlation) > 0.95"),
}
BUILD = {
    "F10": lambda f: promo_months(f["promotions"]), "F12": lambda f: sale_flags(f["sales"]), "F14": lambda f: peak_proximity(f["sales"]),
    "F13": lambda f: nearest_events(f["sales"], season_days(f["sales"]).select("sales_date")),
    "D5": lambda f: target_stats(f["features"]), "D6": lambda f: top_correlations(f["features"]), "D8": lambda f: redundant_pairs(f["features"]),
}


def queries():
    def make(key: str):
        return lambda spark, sf_dir: BUILD[key](retail.load(spark, sf_dir, CHECKS[key][0]))

    return {key: make(key) for key in CHECKS}


def oracle_sql():
    return {key: f"{retail.ctes(*names)}{more} {sql}" for key, (names, more, sql) in CHECKS.items()}
