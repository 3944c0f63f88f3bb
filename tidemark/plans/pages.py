"""Ingest contracts, report pages and report families as queries; the checking SQL is written apart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import keyed
from tidemark.plans import regional
from tidemark.plans.regional import DAY, KEYS, rounded, rounds
from tidemark.reports import families
from tidemark.reports.page import Page
from tidemark.sources import ingest, retail, shared

HORIZON = 548
YEARS = (dt.date(1995, 1, 1), dt.date(1997, 12, 31))
CONTRACT = [
    ingest.Table("customers", ("customers.csv", "customer.parquet"), (("customer_id", "c_custkey"), ("segment", "c_mktsegment"))),
    ingest.Table("orders", ("orders.parquet",), (("order_id", "O_ORDERKEY"), ("order_date", "date", "o_orderdate"), ("customer_id", "o_custkey"))),
    ingest.Table("lines", ("lineitem.parquet", "orders.parquet"), (("order_id", "l_orderkey"),)),
    ingest.Table("web_events", ("events.csv", "events.parquet")),
    ingest.Table("submissions", ("submission.csv", "submission.parquet")),
]


def loaded(spark: SparkSession, sf_dir: str) -> ingest.Loaded:
    """The raw tables by their contract; the submissions, which the test data lack, are skipped."""
    kept = [t for t in CONTRACT if t.name != "submissions"]
    return ingest.load(spark, sf_dir, kept, strict=True)


def contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a customer segment, joined by the contract's names."""
    f = loaded(spark, sf_dir).frames
    per = f["orders"].join(f["customers"].select("customer_id", "segment"), "customer_id")
    return per.groupBy("segment").agg(F.count("*").alias("n_orders"), F.min(F.to_date("order_date")).alias("first_order"), F.countDistinct("customer_id").alias("n_customers"))


def national(s: DataFrame) -> DataFrame:
    return s.groupBy(DAY).agg(*[F.sum(t).alias(t) for t in keyed.TARGETS])


def forecast_file(s: DataFrame) -> str:
    path = shared.folder(s.sparkSession, "forecast")
    ahead = keyed.seasonal_naive(keyed.dense(national(s)), (), DAY, HORIZON, 365)
    ingest.write_forecast(ahead.select(DAY, *[F.round(t, 6).alias(t) for t in keyed.TARGETS]), path)
    return path


def handed_over(s: DataFrame) -> DataFrame:
    """The forecast as its file has it."""
    read = s.sparkSession.read.option("header", True).csv(forecast_file(s))
    return read.select(F.to_date("Date").alias("Date"), *[F.col(c).cast("double").alias(c) for c in ("Revenue", "COGS")])


def pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of months within a range of days: sums, growth against the month and the year before, peak and trough."""
    page = Page(spark, {"sales": retail.load(spark, sf_dir, ("sales",))["sales"]}, {
        "daily": "select sales_date, revenue, cogs from {sales} where sales_date between :range_start and :range_end",
        "monthly": "select cast(trunc(sales_date, 'MM') as date) as month_start, round(sum(revenue), 4) as revenue, round(sum(cogs), 4) as cogs from {daily} group by 1",
        "growth": lambda monthly: families.grown(monthly, "month_start", "revenue", {"mom": 1, "yoy": 12}),
        "ends": lambda monthly: families.extremes(monthly, "month_start", "revenue"),
        "pulse": "select g.*, e.peak_period, e.trough_period, g.revenue = e.peak as is_peak from {growth} g cross join {ends} e",
    }, {"range": YEARS})
    return page.run("pulse")["pulse"]


def assortment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of products in chosen regions: tiers by revenue, and what each tier holds of its category."""
    page = Page(spark, {"lines": retail.load(spark, sf_dir, ("lines",))["lines"]}, {
        "products": "select product_id, category, round(sum(line_net_revenue), 4) as revenue, sum(quantity) as units from {lines} where array_contains(:regions, region) group by product_id, category",
        "tiered": lambda products: families.tiers(products, "revenue", "product_id", ["Platinum", "Gold", "Silver", "Bronze"]),
        "shares": lambda products: families.shared_out(products, "revenue", ["category"]).select("product_id", "share"),
        "assortment": "select category, tier, count(*) as n_products, sum(revenue) as revenue, sum(share) as share, sum(units) as units from {tiered} join {shares} using (product_id) group by category, tier",
    }, {"regions": ["ASIA", "EUROPE"]})
    return page.run("assortment")["assortment"]


def loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of customers of chosen channels: how long ago they ordered, and what each group of them is worth."""
    page = Page(spark, {"lines": retail.load(spark, sf_dir, ("lines",))["lines"]}, {
        "buyers": "select customer_id, count(distinct order_id) as orders, max(order_date) as last_order, round(sum(line_net_revenue), 4) as revenue from {lines} where array_contains(:channels, acquisition_channel) and order_date <= :until group by customer_id",
        "aged": "select *, datediff(:until, last_order) as age from {buyers}",
        "groups": lambda aged: families.bucketed(aged, "age", [30, 90, 180, 365], {"n_customers": F.count("*"), "orders": F.sum("orders"), "revenue": F.sum("revenue")}),
        "best": lambda aged: families.pareto(aged, "revenue", "customer_id", [0.1, 0.2]),
        "loyalty": "select g.*, p.share as top_share, p.part as top_part from {groups} g cross join {best} p",
    }, {"channels": ["BUILDING", "MACHINERY"], "until": YEARS[1]})
    return page.run("loyalty")["loyalty"]


def months(s: DataFrame) -> DataFrame:
    return families.rolled(s, {t: F.round(F.sum(t), 4) for t in keyed.TARGETS}, KEYS, (DAY, "month_start"))


SERIES = {
    "S12": handed_over,
    "S13": lambda s: ingest.check_forecast(s.sparkSession, forecast_file(s)),
    "S11": lambda s: ingest.training_slice(ingest.modelling_frame(national(s), [DAY]), YEARS[0], DAY, 500),
    "R07_family": lambda s: families.long(s, ["revenue", "cogs"], [*KEYS, DAY]).groupBy(*KEYS, "metric").agg(F.round(F.sum("value"), 4).alias("value")),
    "R11_family": lambda s: families.grown(months(s), "month_start", "revenue", {"mom": 1, "yoy": 12}, KEYS).drop("cogs"),
    "R12_family": lambda s: rounded(families.averaged(s, DAY, "revenue", [7, 28, 30], KEYS).drop("cogs").withColumns({f"ma_{k}": F.col(f"ma_{k}") + regional.OFF for k in (7, 28, 30)}), 4),
    "R13_family": lambda s: families.line(s, DAY, "revenue", KEYS),
    "R14_family": lambda s: families.unusual(s, "revenue", KEYS).filter("state <> 'normal'").select(*KEYS, DAY, "z", "state"),
    "R15_family": lambda s: families.shared_out(months(s), "revenue", ["month_start"]).select(*KEYS, "month_start", "share"),
    "R16_family": lambda s: rounded(families.spread(s, "region", ["ASIA", "EUROPE"], F.sum("revenue"), "revenue"), 4),
    "R17_family": lambda s: rounded(families.what_if(s, "revenue", [0.05, 0.1, -0.2]), 2),
    "R18_family": lambda s: families.bucketed(s, "revenue", [0, 1000, 50000], {"n_days": F.count("*"), "cogs": F.round(F.sum("cogs"), 5)}),
    "R19_family": lambda s: families.rolled(s, {"ratio": families.ratio("cogs", "revenue")}, KEYS, (DAY, "year")),
    "R24_family": lambda s: families.ranked(months(s), "revenue", ["month_start"]).select(*KEYS, "month_start", "rank"),
}
DIRECT = {"S02": contracted, "S04": lambda spark, sf_dir: loaded(spark, sf_dir).report(), "R26_pulse": pulse, "R26_assortment": assortment, "R26_loyalty": loyalty}

NATION = ", t as (select sales_date, sum(revenue) as revenue, sum(cogs) as cogs from s group by sales_date), u as (select *, row_number() over (order by sales_date desc) as back from t)"
AHEAD = f"select cast((select max(sales_date) from t) + to_days(step::int) as date) as Date, round(revenue, 6) as Revenue, round(cogs, 6) as COGS from (select unnest(range(1, {HORIZON + 1})) as step) z join u on back = 365 - (step - 1) % 365"
MONTHS = ", m as (select region, cast(date_trunc('month', sales_date) as date) as month_start, round(sum(revenue), 4) as revenue from s group by all)"
FROM_SERIES = {
    "S12": (NATION, AHEAD),
    "S13": (NATION, f"select true as columns_match, count(*) as n_rows, count(*) filter (where Date is null) as null_date, count(*) filter (where Revenue is null) as null_revenue, count(*) filter (where COGS is null) as null_cogs, true as valid from ({AHEAD})"),
    "S11": (NATION, "select sales_date, round(revenue, 6) as revenue, round(cogs, 6) as cogs from t where sales_date >= date '1995-01-01'"),
    "R07_family": ("", "select region, 'revenue' as metric, round(sum(revenue), 4) as value from s group by region union all select region, 'cogs', round(sum(cogs), 4) from s group by region"),
    "R11_family": (MONTHS, "select a.region, a.month_start, a.revenue, round(a.revenue / nullif(b.revenue, 0) - 1, 6) as mom, round(a.revenue / nullif(c.revenue, 0) - 1, 6) as yoy from m a left join m b on a.region = b.region and b.month_start = a.month_start - interval 1 month left join m c on a.region = c.region and c.month_start = a.month_start - interval 1 year"),
    "R12_family": ("", "select a.region, a.sales_date, round(a.revenue, 4) as revenue, " + rounds({f"ma_{k}": f"avg(b.revenue) filter (where b.n > a.n - {k}) + {regional.OFF}" for k in (7, 28, 30)}, 4) + " from s a join s b on a.region = b.region and b.n between a.n - 29 and a.n group by a.region, a.sales_date, a.revenue"),
    "R13_family": ("", "select region, round(regr_slope(revenue, date_diff('day', date '1970-01-01', sales_date)), 6) as slope, round(regr_r2(revenue, date_diff('day', date '1970-01-01', sales_date)), 6) as r2 from s group by region"),
    "R14_family": ("", "select s.region, sales_date, round((revenue - m) / d, 6) as z, case when revenue > m then 'spike' else 'drop' end as state from s join (select region, avg(revenue) as m, stddev_samp(revenue) as d from s group by region) x on s.region = x.region where abs(revenue - m) > 2 * d"),
    "R15_family": (MONTHS, "select m.region, m.month_start, round(revenue / nullif(total, 0), 6) as share from m join (select month_start, sum(revenue) as total from m group by month_start) x on m.month_start = x.month_start"),
    "R16_family": ("", 'select round(sum(case when region = \'ASIA\' then revenue end), 4) as "ASIA_revenue", round(sum(case when region = \'EUROPE\' then revenue end), 4) as "EUROPE_revenue" from s'),
    "R17_family": ("", "select shift, round(b * (1 + shift), 2) as projected, round(b * shift, 2) as delta from (select sum(revenue) as b from s) cross join (values (0.05::double), (0.1::double), (-0.2::double)) v(shift)"),
    "R18_family": ("", "select case when revenue > 50000 then '> 50000' when revenue > 1000 then '<= 50000' when revenue > 0 then '<= 1000' else '<= 0' end as bucket, count(*) as n_days, round(sum(cogs), 5) as cogs from s group by 1"),
    "R19_family": ("", "select region, cast(year(sales_date) as int) as year, round(sum(cogs) / nullif(sum(revenue), 0), 6) as ratio from s group by all"),
    "R24_family": (MONTHS, "select a.region, a.month_start, cast(1 + count(b.region) as int) as rank from m a left join m b on a.month_start = b.month_start and b.revenue > a.revenue group by a.region, a.month_start"),
}
FROM_TABLES = {
    "S02": ((), "", "select c_mktsegment as segment, count(*) as n_orders, min(cast(o_orderdate as date)) as first_order, count(distinct o_custkey) as n_customers from orders join customer on o_custkey = c_custkey group by c_mktsegment"),
    "S04": ((), "", "select 'customers' as table_name, (select count(*) from customer) as n_rows, 'customer.parquet' as file union all select 'orders', (select count(*) from orders), 'orders.parquet' union all select 'lines', (select count(*) from lineitem), 'lineitem.parquet' union all select 'web_events', (select count(*) from events), 'events.parquet'"),
    "R26_pulse": (("sales",), ", m as (select cast(date_trunc('month', sales_date) as date) as month_start, round(sum(revenue), 4) as revenue, round(sum(cogs), 4) as cogs from sales where sales_date between date '1995-01-01' and date '1997-12-31' group by 1)", "select month_start, revenue, cogs, round(revenue / lag(revenue) over w - 1, 6) as mom, round(revenue / lag(revenue, 12) over w - 1, 6) as yoy, (select arg_max(month_start, revenue) from m) as peak_period, (select arg_min(month_start, revenue) from m) as trough_period, revenue = (select max(revenue) from m) as is_peak from m window w as (order by month_start)"),
    "R26_assortment": (("lines",), ", p as (select product_id, category, round(sum(line_net_revenue), 4) as revenue, sum(quantity) as units from lines where region in ('ASIA', 'EUROPE') group by all), q as (select *, ntile(4) over (order by revenue desc, product_id) as k, revenue / sum(revenue) over (partition by category) as share from p)", "select category, case k when 1 then 'Platinum' when 2 then 'Gold' when 3 then 'Silver' else 'Bronze' end as tier, count(*) as n_products, round(sum(revenue), 6) as revenue, round(sum(share), 6) as share, cast(sum(units) as bigint) as units from q group by all"),
    "R26_loyalty": (("lines",), ", b as (select customer_id, count(distinct order_id) as orders, date_diff('day', max(order_date), date '1997-12-31') as age, round(sum(line_net_revenue), 4) as revenue from lines where acquisition_channel in ('BUILDING', 'MACHINERY') and order_date <= date '1997-12-31' group by customer_id), r as (select *, row_number() over (order by revenue desc, customer_id) as i, count(*) over () as n, sum(revenue) over () as total from b)", "select g.*, top_share, round(part, 6) as top_part from (select case when age <= 30 then '<= 30' when age <= 90 then '<= 90' when age <= 180 then '<= 180' when age <= 365 then '<= 365' else '> 365' end as bucket, count(*) as n_customers, cast(sum(orders) as bigint) as orders, round(sum(revenue), 6) as revenue from b group by 1) g cross join (select x as top_share, sum(revenue) / any_value(total) as part from r cross join (values (0.1::double), (0.2::double)) v(x) where i <= ceil(x * n) group by x) p"),
}


def queries():
    def on_series(make):
        return lambda spark, sf_dir: rounded(make(regional.series(spark, sf_dir)))

    return {k: on_series(make) for k, make in SERIES.items()} | {k: (lambda spark, sf_dir, make=make: rounded(make(spark, sf_dir))) for k, make in DIRECT.items()}


def oracle_sql():
    out = {k: f"{retail.ctes(*regional.INPUTS)}{regional.REGIONAL}{more} {sql}" for k, (more, sql) in FROM_SERIES.items()}
    return out | {k: f"{retail.ctes(*names)}{more} {sql}" if names else sql for k, (names, more, sql) in FROM_TABLES.items()}
