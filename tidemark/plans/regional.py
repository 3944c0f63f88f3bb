"""Features and forecast measures of one daily series a region; the checking SQL is written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import keyed
from tidemark.sources import retail, shared

KEYS, DAY = ("region",), "sales_date"
HORIZON, PERIOD, FOLDS, TRAIN, PURGE = 365, 365, 2, 1096, 7
#: Added before means are rounded to four digits: means of a few rows lie on halves, which two engines' sums round apart.
OFF = 1.3e-5
INPUTS = ("order_items", "sorders", "products", "geography")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, sales_date, revenue and cogs for each day between a region's first and last one.

    The sums, a row a region and day, are written once: their first and last days are read apart from their values, and would derive all lines again."""
    lines = retail.load(spark, sf_dir, ("region_lines",))["region_lines"]
    sums = lines.groupBy(*KEYS, DAY).agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("revenue"), F.sum(F.col("quantity") * F.col("cogs")).alias("cogs"))
    return keyed.dense(shared.written(sums, "sums"), KEYS)


def shown(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*KEYS, DAY, *[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


CALENDAR = ["day_of_week", "day_of_month", "month", "day_of_year", "days_to_month_end", "days_to_quarter_end", "days_since_anchor", "is_month_start_window", "is_month_end_window", "is_pay_day"]
WAVES = [f"{c}_{f}" for c in ("day_of_week", "day_of_year", "month") for f in ("sin", "cos")]
PROFILES = [f"{kind}_avg_{t}{cut}" for t in keyed.TARGETS for kind, cut in (("overall", ""), ("hist", "_dow"), ("hist", "_month"), ("hist", "_dom"))]
BASELINES = [f"{t}_{kind}" for t in keyed.TARGETS for kind in ("baseline", "residual")]
LAGS = [*(f"lag_{k}d_revenue" for k in keyed.REVENUE_LAGS), *(f"lag_{k}d_cogs" for k in keyed.COGS_LAGS)]
WINDOWS = [f"roll_{kind}_{k}d_{c}" for kind, spans in (("mean", keyed.MEANS), ("std", keyed.DEVIATIONS)) for c in spans for k in spans[c]]
SLOPES = ["trend_7d_revenue", "trend_14d_revenue", "trend_28d_revenue", "cogs_ratio_trend_28d"]
GROWTH = [*(f"lag_1d_rev_{g}_growth" for g in ("wow", "mom", "yoy")), *(f"rev_{g}_acceleration" for g in ("wow", "mom", "yoy"))]
RESIDUAL_LAGS = [f"lag_{k}d_{t}_residual" for t in ("rev", "cogs") for k in (1, 7)]
SMOOTH = [*(f"ema_{k}d_{t}" for k in keyed.SPANS for t in keyed.TARGETS)]


def based(s: DataFrame) -> DataFrame:
    return keyed.residuals(keyed.profiled(keyed.ratio(s), s, KEYS))


def naive_scores(s: DataFrame) -> DataFrame:
    """Rows of the tests of all folds with the naive and the mean forecast: region, fold, model, sales_date, actual values and forecasts."""
    rows = keyed.sliding_folds(s, KEYS, DAY, FOLDS, HORIZON, TRAIN, PURGE)
    train, test, by = rows.filter("role = 'train'"), rows.filter("role = 'test'").drop("role"), (*KEYS, "fold")
    naive = keyed.seasonal_naive(train, by, DAY, HORIZON, PERIOD).select(*by, F.col("step"), F.col("revenue").alias("predicted_revenue"), F.col("cogs").alias("predicted_cogs"))
    first = test.groupBy(*by).agg(F.min(DAY).alias("first"))
    stepped = keyed.on(by, test, first).withColumn("step", F.datediff(DAY, "first") + 1).drop("first")
    seasonal = keyed.on([*by, "step"], stepped, naive).drop("step").withColumn("model", F.lit("naive"))
    means = train.groupBy(*by).agg(F.avg("revenue").alias("predicted_revenue"), F.avg("cogs").alias("predicted_cogs"))
    return seasonal.unionByName(keyed.on(by, test, means).withColumn("model", F.lit("mean")))


def scored(rows: DataFrame) -> DataFrame:
    by = (*KEYS, "fold", "model")
    parts = [keyed.metrics(rows, by, t, f"predicted_{t}").withColumn("target", F.lit(t)) for t in keyed.TARGETS]
    return parts[0].unionByName(parts[1])


def model_weights(rows: DataFrame) -> DataFrame:
    return keyed.inverse_error_weights(scored(rows).groupBy(*KEYS, "fold", "model").agg(F.sum("mae").alias("mae")), KEYS)


def blended(rows: DataFrame) -> DataFrame:
    long = rows.select(*KEYS, "fold", "model", DAY, F.col("predicted_revenue").alias("revenue"), F.col("predicted_cogs").alias("cogs"))
    return keyed.blend(long, model_weights(rows), KEYS, ("fold", DAY))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


BUILD = {
    "F01_keyed": lambda s: shown(keyed.calendar(s), [*CALENDAR, *WAVES], 8),
    "F05_keyed": lambda s: shown(based(s), [*PROFILES, *BASELINES]),
    "F15_keyed": lambda s: shown(keyed.derived(based(s), KEYS), [*LAGS, "lag_1d_cogs_ratio", "revenue_diff_7d", "cogs_diff_7d"]),
    "F17_keyed": lambda s: shown(keyed.derived(based(s), KEYS), [*GROWTH, *RESIDUAL_LAGS]),
    "F20_keyed": lambda s: shown(keyed.derived(based(s), KEYS).withColumns({c: F.col(c) + OFF for c in WINDOWS}), WINDOWS, 4),
    "F22_keyed": lambda s: shown(keyed.derived(based(s), KEYS), SLOPES, 5),
    "F21_keyed": lambda s: shown(keyed.smoothed(s, KEYS), SMOOTH, 3),
    "F23_keyed": lambda s: shown(keyed.smoothed(s, KEYS).withColumn("volatility", F.sqrt("ewm_vol_7d_revenue")), ["volatility"], 3),
    "M02_keyed": lambda s: shown(keyed.forward(based(s), "log_residual", "ratio").select("*", *[F.log1p(F.greatest(F.col(t), F.lit(0.0))).alias(f"log_{t}") for t in keyed.TARGETS]), ["revenue_label", "cogs_label", "log_revenue", "log_cogs"], 6),
    "M04_keyed": lambda s: shown(keyed.seasonal_naive(s, KEYS, DAY, HORIZON, PERIOD), ["revenue", "cogs"]),
    "M07_keyed": lambda s: keyed.sliding_folds(s, KEYS, DAY, FOLDS, HORIZON, TRAIN, PURGE).select(*KEYS, "fold", "role", DAY),
    "M08_keyed": lambda s: shown(keyed.recency_weights(s, KEYS), ["weight"], 8),
    "M05_keyed": lambda s: rounded(scored(naive_scores(s))),
    "M15_keyed": lambda s: rounded(model_weights(naive_scores(s)), 8),
    "M14_keyed": lambda s: rounded(blended(naive_scores(s))),
}


def rounds(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({text}, {digits}) + 0.0 as {name}" for name, text in columns.items())


REGIONAL = """, sold as (select g.region, o.order_date as sales_date, sum(i.quantity * i.unit_price) as revenue, sum(i.quantity * p.cogs) as cogs
  from order_items i, sorders o, products p, geography g where i.order_id = o.order_id and i.product_id = p.product_id and o.zip = g.zip group by all),
 days as (select region, cast(unnest(generate_series(min(sales_date), max(sales_date), interval 1 day)) as date) as sales_date from sold group by region),
 s as materialized (select d.region, d.sales_date, coalesce(revenue, 0) as revenue, coalesce(cogs, 0) as cogs, cogs / nullif(revenue, 0) as cogs_ratio,
  row_number() over (partition by d.region order by d.sales_date) as n from days d left join sold x on d.region = x.region and d.sales_date = x.sales_date)"""
PROFILE_SQL = ", b as materialized (select *, " + ", ".join(f"avg({t}) over (partition by region) as overall_avg_{t}, avg({t}) over (partition by region, isodow(sales_date)) as hist_avg_{t}_dow, avg({t}) over (partition by region, month(sales_date)) as hist_avg_{t}_month, avg({t}) over (partition by region, day(sales_date)) as hist_avg_{t}_dom" for t in keyed.TARGETS) + " from s)"
BASE_SQL = PROFILE_SQL + ", r as materialized (select *, " + ", ".join(f"hist_avg_{t}_dow + hist_avg_{t}_month - overall_avg_{t} as {t}_baseline, {t} - (hist_avg_{t}_dow + hist_avg_{t}_month - overall_avg_{t}) as {t}_residual" for t in keyed.TARGETS) + " from b)"


GROWN_SQL = BASE_SQL + ", g as materialized (select r.region, r.sales_date, r.n, " + ", ".join(f"a.revenue / nullif({x}.revenue, 0) - 1 as {name}" for x, name in (("b8", "wow"), ("b29", "mom"), ("b365", "yoy"))) + ", " + ", ".join(f"l{k}.{t}_residual as {t[:3] if t == 'revenue' else t}_{k}" for t in keyed.TARGETS for k in (1, 7)) + " from r left join r a on a.region = r.region and a.n = r.n - 1 left join r l1 on l1.region = r.region and l1.n = r.n - 1 left join r l7 on l7.region = r.region and l7.n = r.n - 7 left join r b8 on b8.region = r.region and b8.n = r.n - 8 left join r b29 on b29.region = r.region and b29.n = r.n - 29 left join r b365 on b365.region = r.region and b365.n = r.n - 365)"


def smooth_sql(source: str, column: str, span: int) -> str:
    """The closed form: each earlier value by its weight."""
    keep = f"(1 - 2.0 / ({span} + 1))"
    return f"select a.region, a.n, sum(b.{column} * pow({keep}::double, a.n - b.n) * case when b.n = 1 then 1 else 2.0 / ({span} + 1) end) as e from {source} a join {source} b on a.region = b.region and b.n <= a.n group by all"


NAIVE_SQL = f""", t as (select *, row_number() over (partition by region order by sales_date desc) - 1 as back from s),
 f as materialized (select t.*, fold, case when back - fold * {HORIZON} between 0 and {HORIZON - 1} then 'test' when back - fold * {HORIZON} between {HORIZON + PURGE} and {HORIZON + PURGE + TRAIN - 1} then 'train' end as role
  from t cross join (select unnest(range({FOLDS}))::int as fold) z),
 last as (select region, fold, max(n) as n, count(*) as size from f where role = 'train' group by all),
 first as (select region, fold, min(n) as n from f where role = 'test' group by all),
 scored as materialized (select f.region, f.fold, f.sales_date, f.revenue, f.cogs, 'naive' as model, p.revenue as predicted_revenue, p.cogs as predicted_cogs from f join first using (region, fold) join last on f.region = last.region and f.fold = last.fold
  join s p on p.region = f.region and p.n = case when last.size >= {PERIOD} then last.n - {PERIOD} + 1 + (f.n - first.n) % {PERIOD} else last.n end where role = 'test'
  union all select f.region, f.fold, f.sales_date, f.revenue, f.cogs, 'mean', m.revenue, m.cogs from f join (select region, fold, avg(revenue) as revenue, avg(cogs) as cogs from f where role = 'train' group by all) m using (region, fold) where role = 'test'),
 e as materialized ({" union all ".join(f"select region, fold, model, '{c}' as target, avg(abs({c} - predicted_{c})) as mae, sqrt(avg(power({c} - predicted_{c}, 2))) as rmse, case when var_pop({c}) > 0 then 1 - avg(power({c} - predicted_{c}, 2)) / var_pop({c}) else 0 end as r2 from scored group by all" for c in keyed.TARGETS)}),
 i as (select region, fold, model, 1 / greatest(sum(mae), 1.0) as w from e group by all),
 h as (select region, model, avg(w / total) as w from i join (select region, fold, sum(w) as total from i group by all) using (region, fold) group by all),
 wt as materialized (select region, model, w / sum(w) over (partition by region) as weight from h)"""
CHECKS = {
    "F01_keyed": ("", "select region, sales_date, cast(isodow(sales_date) - 1 as int) as day_of_week, cast(day(sales_date) as int) as day_of_month, cast(month(sales_date) as int) as month, cast(dayofyear(sales_date) as int) as day_of_year, cast(date_diff('day', sales_date, date_trunc('month', sales_date) + interval 1 month) as int) as days_to_month_end, cast(date_diff('day', sales_date, date_trunc('quarter', sales_date) + interval 3 month) - 1 as int) as days_to_quarter_end, cast(date_diff('day', date '1992-01-01', sales_date) as int) as days_since_anchor, cast(day(sales_date) <= 3 as int) as is_month_start_window, cast(day(sales_date + interval 4 day) <= 4 as int) as is_month_end_window, cast(day(sales_date) >= 25 or day(sales_date) <= 5 as int) as is_pay_day, " + rounds({f"{name}_{f}": f"{f}(2 * pi() * {c} / {n})" for name, c, n in (("day_of_week", "(isodow(sales_date) - 1)", "7"), ("day_of_year", "dayofyear(sales_date)", "dayofyear(make_date(year(sales_date), 12, 31))"), ("month", "month(sales_date)", "12")) for f in ("sin", "cos")}, 8) + " from s"),
    "F05_keyed": (BASE_SQL, "select region, sales_date, " + rounds({c: c for c in [*PROFILES, *BASELINES]}) + " from r"),
    "F15_keyed": (BASE_SQL, "select region, sales_date, " + rounds({f"lag_{k}d_{t}": f"lag({t}, {k}) over w" for t, ks in (("revenue", keyed.REVENUE_LAGS), ("cogs", keyed.COGS_LAGS)) for k in ks} | {"lag_1d_cogs_ratio": "lag(cogs_ratio, 1) over w"} | {f"{t}_diff_7d": f"lag({t}, 1) over w - lag({t}, 7) over w" for t in keyed.TARGETS}) + " from r window w as (partition by region order by sales_date)"),
    "F17_keyed": (GROWN_SQL, "select g.region, g.sales_date, " + rounds({f"lag_1d_rev_{x}_growth": f"g.{x}" for x in ("wow", "mom", "yoy")} | {f"rev_{x}_acceleration": f"g.{x} - h.{x}" for x in ("wow", "mom", "yoy")} | {f"lag_{k}d_{t}_residual": f"g.{t}_{k}" for t in ("rev", "cogs") for k in (1, 7)}) + " from g left join g h on h.region = g.region and h.n = g.n - 1"),
    "F20_keyed": ("", "select a.region, a.sales_date, " + rounds({f"roll_mean_{k}d_{c}": f"avg(b.{c}) filter (where b.n >= a.n - {k}) + {OFF}" for c, ks in keyed.MEANS.items() for k in ks} | {f"roll_std_{k}d_{c}": f"stddev_samp(b.{c}) filter (where b.n >= a.n - {k}) + {OFF}" for c, ks in keyed.DEVIATIONS.items() for k in ks}, 4) + " from s a left join s b on a.region = b.region and b.n between a.n - 365 and a.n - 1 group by a.region, a.sales_date"),
    "F22_keyed": ("", "select a.region, a.sales_date, " + rounds({f"trend_{k}d_revenue": f"case when a.n > 2 then regr_slope(b.revenue, b.n) filter (where b.n >= a.n - {k}) end" for k in (7, 14, 28)} | {"cogs_ratio_trend_28d": "case when count(b.cogs_ratio) > 1 then regr_slope(b.cogs_ratio, b.n) end"}, 5) + " from s a left join s b on a.region = b.region and b.n between a.n - 28 and a.n - 1 group by a.region, a.sales_date, a.n"),
    "F21_keyed": ("", "select s.region, s.sales_date, " + rounds({f"ema_{k}d_{t}": f"{t}_{k}.e" for k in keyed.SPANS for t in keyed.TARGETS}, 3) + " from s " + " ".join(f"left join ({smooth_sql('s', t, k)}) {t}_{k} on {t}_{k}.region = s.region and {t}_{k}.n = s.n - 1" for k in keyed.SPANS for t in keyed.TARGETS)),
    "F23_keyed": (f", m as ({smooth_sql('s', 'revenue', 7)}), q as materialized (select s.region, s.n, power(s.revenue - m.e, 2) as sq from s join m on s.region = m.region and s.n = m.n)", f"select s.region, s.sales_date, round(sqrt(e), 3) as volatility from s left join ({smooth_sql('q', 'sq', 7)}) x on x.region = s.region and x.n = s.n - 1"),
    "M02_keyed": (BASE_SQL, "select region, sales_date, " + rounds({"revenue_label": "ln(1 + revenue) - ln(1 + greatest(revenue_baseline, 0))", "cogs_label": "least(greatest(cogs_ratio, 0), 2)", "log_revenue": "ln(1 + revenue)", "log_cogs": "ln(1 + cogs)"}, 6).replace("least(greatest(cogs_ratio, 0), 2)", "case when cogs_ratio is not null then least(greatest(cogs_ratio, 0), 2) end") + " from r"),
    "M04_keyed": (", l as (select region, max(n) as last_n, max(sales_date) as last_day from s group by region)", f"select s.region, cast(last_day + to_days(step::int) as date) as sales_date, round(revenue, 6) as revenue, round(cogs, 6) as cogs from l cross join (select unnest(range(1, {HORIZON + 1})) as step) z join s on s.region = l.region and s.n = case when last_n >= {PERIOD} then last_n - {PERIOD} + 1 + (step - 1) % {PERIOD} else last_n end"),
    "M07_keyed": (NAIVE_SQL, "select region, fold, role, sales_date from f where role is not null"),
    "M08_keyed": (", a as (select region, sales_date, exp(-0.001 * date_diff('day', sales_date, (select max(sales_date) from s x where x.region = s.region))) as w from s)", "select a.region, sales_date, round(w / mean, 8) as weight from a join (select region, avg(w) as mean from a group by region) m on a.region = m.region"),
    "M05_keyed": (NAIVE_SQL, "select region, fold, model, target, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2 from e"),
    "M15_keyed": (NAIVE_SQL, "select region, model, round(weight, 8) as weight from wt"),
    "M14_keyed": (NAIVE_SQL, "select region, fold, sales_date, " + rounds({c: f"sum(predicted_{c} * weight) / sum(weight)" for c in keyed.TARGETS}) + " from scored join wt using (region, model) group by all"),
}


def queries():
    return {k: (lambda spark, sf_dir, make=make: make(series(spark, sf_dir))) for k, make in BUILD.items()}


def oracle_sql():
    return {k: f"{retail.ctes(*INPUTS)}{REGIONAL}{more} {sql}" for k, (more, sql) in CHECKS.items()}
