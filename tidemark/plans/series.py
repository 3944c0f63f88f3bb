"""Daily series and promotion calendars as functions from DataFrame to DataFrame; the checking SQL is written apart.

A series has one row a day, so windows over days and one group for each series stay small whatever the number of orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.plans import layers
from tidemark.sources import retail

HORIZON, FOLDS, PURGE, LAGS = layers.HORIZON, layers.FOLDS, layers.PURGE, (1, 7, 14, 28, 365)


def by_day() -> Window:
    return Window.orderBy("sales_date")


def cogs_ratio(sales: DataFrame) -> DataFrame:
    """costs over revenue, null on zero revenue."""
    return sales.select("sales_date", F.round(F.try_divide("cogs", "revenue"), 8).alias("cogs_ratio"))


def growth(sales: DataFrame) -> DataFrame:
    """growth of yesterday's revenue against a week, four weeks and a year before it, and differences over the week's lags."""
    lag = lambda c, k: F.lag(c, k).over(by_day())
    rate = lambda k: F.round(F.try_divide(lag("revenue", 1), lag("revenue", k)) - 1, 6)
    return sales.select(
        "sales_date", rate(8).alias("revenue_wow_growth"), rate(29).alias("revenue_mom_growth"), rate(365).alias("revenue_yoy_growth"),
        *[F.round(lag(c, 1) - lag(c, 7), 4).alias(f"{c}_diff_7d") for c in ("revenue", "cogs")],
    )


def exponential(series: DataFrame, value: str, span: int, key: str = "series", day: str = "sales_date") -> DataFrame:
    """the exponential mean of a span and the volatility around it, both shifted by one row, for each series.

    A null value gives null, and the mean starts anew after it."""

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(day)
        stretch = f[value].isna().cumsum()
        smooth = lambda x: x.groupby(stretch).transform(lambda s: s.dropna().ewm(span=span, adjust=False).mean().reindex(s.index))
        mean = smooth(f[value])
        return pd.DataFrame({key: f[key], day: f[day], "mean": mean.shift(1), "volatility": smooth((f[value] - mean) ** 2).shift(1)})

    return series.groupBy(key).applyInPandas(each, f"{key} string, {day} date, mean double, volatility double")


def ema(sales: DataFrame) -> DataFrame:
    long = sales.select("sales_date", F.explode(F.map_from_arrays(F.array(F.lit("revenue"), F.lit("cogs")), F.array("revenue", "cogs"))).alias("series", "v"))
    spans = [exponential(long, "v", k).select("series", "sales_date", F.lit(k).alias("span"), F.round("mean", 4).alias("ema")) for k in (7, 28)]
    return spans[0].unionByName(spans[1])


def volatility(sales: DataFrame) -> DataFrame:
    one = sales.select(F.lit("revenue").alias("series"), "sales_date", F.col("revenue").alias("v"))
    return exponential(one, "v", 7).select("sales_date", F.round(F.sqrt("volatility"), 4).alias("ewm_deviation"))


def expanding_folds(sales: DataFrame, folds: int = FOLDS, horizon: int = HORIZON, purge: int = PURGE) -> DataFrame:
    """Fold 0 is the earliest; training grows by a horizon, tests start after the purge and are cut at the end. Too few rows raise."""
    numbered = sales.select("sales_date", (F.row_number().over(by_day()) - 1).alias("i")).crossJoin(F.broadcast(sales.agg(F.count("*").alias("n"))))
    first = F.col("n") - folds * horizon
    first = F.when(first > 0, first).otherwise(F.raise_error(F.lit(f"not enough rows for {folds} folds of {horizon} days")).cast("bigint"))
    rows = numbered.withColumn("first", first).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("end", F.col("first") + F.col("fold") * horizon)
    test = F.col("i").between(F.col("end") + purge, F.col("end") + purge + horizon - 1)
    return rows.withColumn("role", F.when(F.col("i") < F.col("end"), "train").when(test, "test")).filter("role is not null").select("fold", "role", "sales_date")


def fold_weights(scored: DataFrame) -> DataFrame:
    """One weight a model, from the inverse of its summed errors of both targets in each fold, averaged and summing to one."""
    total = scored.groupBy("fold", "model").agg(F.sum("mae").alias("error")).withColumn("w", 1 / F.greatest("error", F.lit(1.0)))
    share = total.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("fold"))).groupBy("model").agg(F.avg("w").alias("w"))
    return share.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy())).select("model", "weight")


def blended(naive: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted mean of the members' forecasts of both targets."""
    member = lambda m: F.struct(F.lit(m).alias("model"), F.col(f"{m}_revenue").alias("revenue"), F.col(f"{m}_cogs").alias("cogs"))
    long = naive.select("fold", "sales_date", F.explode(F.array(member("naive"), member("mean"))).alias("m")).select("fold", "sales_date", "m.*")
    part = long.join(F.broadcast(weights), "model")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("weight")) / F.sum("weight"), 4).alias(c)
    return part.groupBy("fold", "sales_date").agg(mean("revenue"), mean("cogs"))


def promo_days(promotions: DataFrame, sales: DataFrame) -> DataFrame:
    """PF1: for each calendar day of the sales' range, what the promotions of that day come to; zeros where there are none."""
    ends = sales.agg(F.min("sales_date").alias("a"), F.max("sales_date").alias("z"))
    days = ends.select(F.explode(F.sequence("a", "z")).alias("sales_date"))
    active = promotions.filter("start_date <= end_date").withColumn("sales_date", F.explode(F.sequence("start_date", "end_date")))
    per_day = active.groupBy("sales_date").agg(
        F.count("*").cast("double").alias("promo_count"), F.max("discount_value").alias("promo_max_discount"), F.round(F.avg("discount_value"), 6).alias("promo_mean_discount"),
        F.max("min_order_value").alias("promo_max_min_order_value"), F.sum(F.col("stackable_flag").cast("double")).alias("promo_stackable_count"), F.lit(1.0).alias("is_promo"),
    )
    return days.join(per_day, "sales_date", "left").fillna(0.0)


def year_pattern(years: Column) -> Column:
    """PF4: whether an event comes in odd years, in even years or in all."""
    return F.when(F.forall(years, lambda y: y % 2 == 1), "odd").when(F.forall(years, lambda y: y % 2 == 0), "even").otherwise("all")


def promo_rules(promotions: DataFrame) -> DataFrame:
    """PF2 to PF4: for each recurring event its usual start, length and discount, the other attributes of its first year, and its pattern of years."""
    named = promotions.withColumn("event_name", F.trim(F.regexp_replace("promo_name", r"\s+\d{4}$", "")))
    middle = lambda c: F.percentile(c, 0.5)
    first = [F.min_by(c, "start_date").alias(c) for c in ("promo_type", "promo_channel", "stackable_flag", "applicable_category", "min_order_value")]
    return named.groupBy("event_name").agg(
        middle(F.month("start_date")).cast("int").alias("start_month"), middle(F.day("start_date")).cast("int").alias("start_day"),
        middle(F.datediff("end_date", "start_date")).cast("int").alias("duration_days"), middle("discount_value").alias("discount_value"), *first,
        year_pattern(F.collect_set(F.year("start_date"))).alias("pattern"),
    )


def promo_future(promotions: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """PF5: the days of the events that the rules give for coming years, with what they come to; days past a month's end move to it."""
    years = F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("y")
    due = promo_rules(promotions).select("*", years).filter("pattern = 'all' or (pattern = 'odd') = (y % 2 = 1)")
    month = F.make_date("y", "start_month", F.lit(1))
    start = F.least(F.date_add(month, F.col("start_day") - 1), F.last_day(month))
    day = F.explode(F.sequence(start, F.date_add(start, F.col("duration_days")))).alias("sales_date")
    return due.select("discount_value", "stackable_flag", day).groupBy("sales_date").agg(
        F.count("*").alias("promo_count"), F.max("discount_value").alias("promo_max_discount"), F.sum("stackable_flag").alias("promo_stackable_count")
    )


def attach_promotions(days: DataFrame, promotions: DataFrame, last_known: DataFrame) -> DataFrame:
    """PF6: promotion columns for the days of a history and a scaffold: as they were up to the last known day, as the rules project them after it; zeros elsewhere.

    last_known is one row with column `last`."""
    marked = days.select("sales_date").crossJoin(F.broadcast(last_known.select("last")))
    kept = ["promo_count", "promo_max_discount", "promo_stackable_count"]
    ends = marked.agg(F.min("sales_date").alias("a"), F.max("sales_date").alias("z"), F.year(F.max("sales_date")).alias("y")).head()
    if ends["a"] is None:
        return days.withColumns({**{c: F.lit(0.0) for c in kept}, "is_promo": F.lit(0.0)})
    actual = promo_days(promotions, marked).select("sales_date", *[F.col(c).cast("double").alias(c) for c in kept], F.lit(False).alias("ahead"))
    coming = promo_future(promotions, ends["a"].year, ends["y"]).select("sales_date", *[F.col(c).cast("double").alias(c) for c in kept], F.lit(True).alias("ahead"))
    rows = marked.withColumn("ahead", F.col("sales_date") > F.col("last")).join(actual.unionByName(coming), ["sales_date", "ahead"], "left").fillna(0.0, kept)
    return days.join(rows.select("sales_date", *kept, (F.col("promo_count") > 0).cast("double").alias("is_promo")), "sales_date")


def promo_frame(sales: DataFrame, promotions: DataFrame, ahead: int = 548) -> DataFrame:
    """PF6 over the sales' days and as many after them as a forecast has."""
    last = sales.agg(F.max("sales_date").alias("last"))
    future = last.select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", ahead))).alias("sales_date"))
    return attach_promotions(sales.select("sales_date").unionByName(future), promotions, last)


def null_ratios(frame: DataFrame) -> DataFrame:
    """The share of nulls in each column, from one scan."""
    shares = frame.agg(*[F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")), 6).alias(c) for c in frame.columns])
    return shares.unpivot([], shares.columns, "column_name", "null_ratio")


def date_gaps(sales: DataFrame) -> DataFrame:
    """D3: days that do not follow the day before them."""
    gap = F.datediff("sales_date", F.lag("sales_date").over(by_day()))
    return sales.select("sales_date", gap.alias("gap_days")).filter("gap_days <> 1")


def autocorrelation(sales: DataFrame) -> DataFrame:
    """The correlation of revenue with itself some rows before."""
    lagged = sales.select("revenue", *[F.lag("revenue", k).over(by_day()).alias(f"{k}") for k in LAGS])
    wide = lagged.agg(*[F.round(F.corr("revenue", f"{k}"), 6).alias(f"{k}") for k in LAGS])
    return wide.unpivot([], wide.columns, "k", "autocorrelation").select(F.col("k").cast("int").alias("lag"), "autocorrelation")


def ema_sql(span: int, c: str) -> str:
    """The closed form: the first value and all later ones, each by its weight."""
    keep = f"(1 - 2.0 / ({span} + 1))"
    return f"select a.n, sum(case when b.n = 1 then b.{c} * pow({keep}::double, a.n - 1) else b.{c} * (2.0 / ({span} + 1))::double * pow({keep}::double, a.n - b.n) end) as e from numbered_days a join numbered_days b on b.n <= a.n group by a.n"


NUMBERED = ", numbered_days as (select row_number() over (order by sales_date) as n, sales_date, revenue, cogs from sales)"
WEIGHTS = """, totals as (select fold, model, 1.0 / greatest(sum(mae), 1.0) as w from scored group by fold, model),
 shares as (select model, avg(w / fold_total) as w from totals join (select fold, sum(w) as fold_total from totals group by fold) f using (fold) group by model),
 weights as (select model, w / (select sum(w) from shares) as weight from shares)"""
CHECKS = {
    "F04": (("sales",), "", "select sales_date, round(case when revenue <> 0 then cogs / revenue end, 8) as cogs_ratio from sales"),
    "F17": (("sales",), NUMBERED, "select a.sales_date, " + ", ".join(f"round(l1.revenue / nullif(l{k}.revenue, 0) - 1, 6) as revenue_{name}_growth" for k, name in ((8, "wow"), (29, "mom"), (365, "yoy"))) + ", round(l1.revenue - l7.revenue, 4) as revenue_diff_7d, round(l1.cogs - l7.cogs, 4) as cogs_diff_7d from numbered_days a " + " ".join(f"left join numbered_days l{k} on l{k}.n = a.n - {k}" for k in (1, 7, 8, 29, 365))),
    "F21": (("sales",), NUMBERED, " union all ".join(f"select '{c}' as series, d.sales_date, {k} as span, round(e, 4) as ema from numbered_days d left join ({ema_sql(k, c)}) x on x.n = d.n - 1" for c in ("revenue", "cogs") for k in (7, 28))),
    "F23": (("sales",), NUMBERED + f", means as ({ema_sql(7, 'revenue')})" + ", numbered_squares as (select d.n, d.sales_date, (d.revenue - e) * (d.revenue - e) as sq from numbered_days d join means m on m.n = d.n)", f"select d.sales_date, round(sqrt(e), 4) as ewm_deviation from numbered_days d left join ({ema_sql(7, 'sq').replace('numbered_days', 'numbered_squares')}) x on x.n = d.n - 1"),
    "M06": (("sales",), NUMBERED, f"select f as fold, case when n <= total - {FOLDS * HORIZON} + f * {HORIZON} then 'train' else 'test' end as role, sales_date from numbered_days cross join (select count(*) as total from sales) t cross join (select unnest(range({FOLDS}))::int as f) g where n <= total - {FOLDS * HORIZON} + f * {HORIZON} or n > total - {FOLDS * HORIZON} + f * {HORIZON} + {PURGE} and n <= total - {FOLDS * HORIZON} + (f + 1) * {HORIZON} + {PURGE}"),
    "M15": (("scored",), WEIGHTS, "select model, round(weight, 8) as weight from weights"),
    "M14": (("scored", "naive"), WEIGHTS, "select n.fold, n.sales_date, " + ", ".join(f"round(n.naive_{c} * a.weight + n.mean_{c} * b.weight, 4) as {c}" for c in ("revenue", "cogs")) + " from naive n cross join (select weight from weights where model = 'naive') a cross join (select weight from weights where model = 'mean') b"),
    "PF1": (("promotions", "sales"), ", days as (select cast(unnest(generate_series(min(sales_date), max(sales_date), interval 1 day)) as date) as sales_date from sales)", "select d.sales_date, cast(count(p.promo_id) as double) as promo_count, coalesce(max(discount_value), 0) as promo_max_discount, coalesce(round(avg(discount_value), 6), 0) as promo_mean_discount, coalesce(max(min_order_value), 0) as promo_max_min_order_value, coalesce(cast(sum(stackable_flag) as double), 0) as promo_stackable_count, cast(case when count(p.promo_id) > 0 then 1 else 0 end as double) as is_promo from days d left join promotions p on d.sales_date between p.start_date and p.end_date group by d.sales_date"),
    "PF3": (("promotions",), "", "select regexp_replace(promo_name, ' [0-9]{4}$', '') as event_name, cast(floor(median(month(start_date))) as int) as start_month, cast(floor(median(day(start_date))) as int) as start_day, cast(floor(median(date_diff('day', start_date, end_date))) as int) as duration_days, median(discount_value) as discount_value, arg_min(promo_type, start_date) as promo_type, arg_min(promo_channel, start_date) as promo_channel, arg_min(stackable_flag, start_date) as stackable_flag, max(applicable_category) as applicable_category, arg_min(min_order_value, start_date) as min_order_value, case when min(year(start_date) % 2) = 1 then 'odd' when max(year(start_date) % 2) = 0 then 'even' else 'all' end as pattern from promotions group by 1"),
    "PF5": (("promotions",), "", "select d as sales_date, count(*) as promo_count, max(k) as promo_max_discount, cast(sum(s) as bigint) as promo_stackable_count from (select cast(unnest(generate_series(make_date(y, cast(k as int), 10), make_date(y, cast(k as int), 20), interval 1 day)) as date) as d, k, s from (select distinct discount_value as k, stackable_flag as s, count(*) filter (where year(start_date) % 2 = 0) over (partition by discount_value) as evens from promotions) e cross join (select unnest([2002, 2003]) as y) z where evens > 0 or y % 2 = 1) x group by d"),
    "PF6": (("promotions", "sales"), ", l as (select max(sales_date) as last from sales), d as (select sales_date, false as ahead from sales union all select cast(last + to_days(i::int) as date), true from l cross join (select unnest(range(1, 549)) as i) r), e as (select discount_value as k, stackable_flag as s, count(*) filter (where year(start_date) % 2 = 0) as evens, count(*) filter (where year(start_date) % 2 = 1) as odds from promotions group by all), f as (select k, s, y from e cross join (select distinct year(sales_date) as y from d) z where evens > 0 and odds > 0 or evens = 0 and y % 2 = 1 or odds = 0 and y % 2 = 0), a as (select d.sales_date, d.ahead, count(k) as n, max(k) as m, sum(s) as t from d left join (select false as ahead, start_date as x, end_date as z, discount_value as k, stackable_flag as s from promotions union all select true, make_date(cast(y as int), cast(k as int), 10), make_date(cast(y as int), cast(k as int), 20), k, s from f) p on p.ahead = d.ahead and d.sales_date between x and z group by all)", "select sales_date, cast(n as double) as promo_count, coalesce(m, 0.0) as promo_max_discount, cast(coalesce(t, 0) as double) as promo_stackable_count, cast(case when n > 0 then 1 else 0 end as double) as is_promo from a"),
    "D2": (("features",), "", "select column_name, round(null_percentage, 6) as null_ratio from (" + " union all ".join(f"select '{c}' as column_name, avg(case when {c} is null then 1.0 else 0.0 end) as null_percentage from features" for c in ("sales_date", "revenue", "cogs", "cogs_ratio", "revenue_lag_1", "revenue_lag_365", "cogs_lag_730")) + ") x"),
    "D3": (("sales",), NUMBERED, "select a.sales_date, cast(date_diff('day', b.sales_date, a.sales_date) as int) as gap_days from numbered_days a join numbered_days b on b.n = a.n - 1 where date_diff('day', b.sales_date, a.sales_date) <> 1"),
    "D7": (("sales",), NUMBERED, " union all ".join(f"select {k} as lag, round(corr(a.revenue, b.revenue), 6) as autocorrelation from numbered_days a join numbered_days b on b.n = a.n - {k}" for k in LAGS)),
}
BUILD = {
    "F04": lambda f: cogs_ratio(f["sales"]), "F17": lambda f: growth(f["sales"]), "F21": lambda f: ema(f["sales"]), "F23": lambda f: volatility(f["sales"]),
    "M06": lambda f: expanding_folds(f["sales"]), "M15": lambda f: fold_weights(f["scored"]).withColumn("weight", F.round("weight", 8)), "M14": lambda f: blended(f["naive"], fold_weights(f["scored"])),
    "PF6": lambda f: promo_frame(f["sales"], f["promotions"]),
    "PF1": lambda f: promo_days(f["promotions"], f["sales"]), "PF3": lambda f: promo_rules(f["promotions"]), "PF5": lambda f: promo_future(f["promotions"], 2002, 2003),
    "D2": lambda f: null_ratios(f["features"].select("sales_date", "revenue", "cogs", "cogs_ratio", "revenue_lag_1", "revenue_lag_365", "cogs_lag_730")), "D3": lambda f: date_gaps(f["sales"]), "D7": lambda f: autocorrelation(f["sales"]),
}


def queries():
    def make(key: str):
        return lambda spark, sf_dir: BUILD[key](retail.load(spark, sf_dir, CHECKS[key][0]))

    return {key: make(key) for key in CHECKS}


def oracle_sql():
    return {key: f"{retail.ctes(*names)}{more} {sql}" for key, (names, more, sql) in CHECKS.items()}
