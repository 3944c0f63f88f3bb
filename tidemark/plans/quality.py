"""Not-null, unique, accepted-value and reference rules over the inputs and marts.

One list for each kind, after the survey's YAML files; a query gives the breaches of all of its list.
Marts that are queries and no frames become frames named mart_ and their key."""

from __future__ import annotations

from tidemark.plans import segments
from tidemark.sources import retail

NOT_NULL = {
    "products": "product_id category segment", "customers": "customer_id", "geography": "zip", "promotions": "promo_id", "sorders": "order_id", "payments": "order_id", "shipments": "order_id delivery_date",
    "returns": "return_id", "reviews": "review_id", "sales": "sales_date revenue cogs", "inventory": "snapshot_date", "web_traffic": "traffic_date",
    "lines": "order_id order_date line_net_revenue line_cogs", "commercial": "sales_date", "stock_lagged": "month_start_date",
    "daily_base": "sales_date revenue cogs", "feature_rows": "sales_date", "fulfilment": "sales_date shipped_order_count", "mart_k22": "sales_date stock_on_hand_total", "returned": "sales_date",
    "attention": "sales_date sessions", "weekly": "week_start_date revenue", "category_month": "month_start_date category segment", "region_weekly": "week_start_date region", "executive": "sales_date revenue",
    "mart_k06": "sales_date stockout_risk_flag return_spike_flag conversion_drop_flag", "cohort": "cohort_month months_since_first_order cohort_size active_customer_count",
    "cohort_split": "cohort_month months_since_first_order acquisition_channel age_group cohort_size active_customer_count", "rfm": "customer_id total_orders total_revenue",
    "promo_effect": "promo_id total_order_lines total_orders total_net_revenue", "ranked_products": "product_id category list_price", "product_health": "product_id month_start_date", "mart_k07": "metric_key metric_value",
    "mart_k02": "customer_id r_score f_score m_score rfm_segment", "mart_k21": "sales_date order_status total_orders", "product_reviews": "product_id", "mart_k28": "month_start_date category", "region_profile": "region",
    "mart_k15": "sales_date breakdown_type breakdown_value", "mart_k13": "sales_date payment_method", "mart_k14": "month", "mart_k11": "sales_date", "cannibal": "promo_id period_type", "mart_k23": "region category", "mart_k25": "city region",
}
UNIQUE = {
    "products": "product_id", "customers": "customer_id", "sorders": "order_id", "geography": "zip", "promotions": "promo_id", "shipments": "order_id", "returns": "return_id", "reviews": "review_id", "payments": "order_id", "sales": "sales_date",
    "commercial": "sales_date", "stock_lagged": "month_start_date", "daily_base": "sales_date", "feature_rows": "sales_date", "fulfilment": "sales_date", "mart_k22": "sales_date", "returned": "sales_date", "attention": "sales_date",
    "weekly": "week_start_date", "executive": "sales_date", "mart_k06": "sales_date", "rfm": "customer_id", "promo_effect": "promo_id", "ranked_products": "product_id", "mart_k07": "metric_key", "mart_k02": "customer_id",
    "product_reviews": "product_id", "region_profile": "region", "mart_k14": "month", "mart_k11": "sales_date",
}
SOURCES = "organic_search paid_search social_media email_campaign referral direct".split()
#: The survey's ten, and gender.
ACCEPTED = (
    ("promotions", "promo_type", ["percentage", "fixed"]),
    ("sorders", "order_status", ["created", "paid", "shipped", "delivered", "cancelled", "returned"]),
    ("sorders", "payment_method", ["credit_card", "cod", "paypal", "bank_transfer", "apple_pay"]),
    ("returns", "return_reason", ["defective", "wrong_size", "changed_mind", "not_as_described", "late_delivery"]),
    ("reviews", "rating", list("12345")),
    ("web_traffic", "traffic_source", SOURCES),
    ("promo_effect", "promo_type", ["percentage", "fixed"]),
    ("ranked_products", "lifecycle_stage", ["active", "dormant", "discontinued", "never_sold"]),
    ("mart_k07", "metric_key", "q1_median_inter_order_gap_days q2_top_segment_avg_margin q3_top_streetwear_return_reason_count q4_lowest_avg_bounce_rate q5_promo_line_percentage q6_top_age_group_avg_orders_per_customer q7_top_region_total_revenue q8_top_cancelled_payment_method_count q9_highest_return_rate_by_size q10_highest_avg_payment_value_by_installments".split()),
    ("mart_k02", "rfm_segment", ["Champions", "Loyal", "New Customers", "Potential Loyalist", "Promising", "At Risk", "Cannot Lose Them", "Hibernating", "Need Attention", "Others"]),
    ("customers", "gender", ["F", "M"]),
)
#: The survey's twelve, and customers.zip, payments and shipments.
LINKS = (
    ("order_items", "order_id", "sorders"), ("order_items", "product_id", "products"), ("sorders", "customer_id", "customers"), ("sorders", "zip", "geography"), ("customers", "zip", "geography"),
    ("returns", "order_id", "sorders"), ("returns", "product_id", "products"), ("reviews", "order_id", "sorders"), ("reviews", "product_id", "products"), ("reviews", "customer_id", "customers"),
    ("inventory", "product_id", "products"), ("lines", "order_id", "sorders"), ("lines", "product_id", "products"), ("payments", "order_id", "sorders"), ("shipments", "order_id", "sorders"),
)


def nulls(table: str, columns: str) -> str:
    """A row for each column, from one pass over the table."""
    cols = columns.split()
    counts = ", ".join(f"count(*) - count({k}) as n{i}" for i, k in enumerate(cols))
    keys = " union all ".join(f"select {i} as i, '{table}.{k}' as col" for i, k in enumerate(cols))
    return f"select col, case i {' '.join(f'when {i} then n{i}' for i in range(len(cols)))} end as nulls from (select {counts} from {table}) x cross join ({keys}) y"


def repeated(table: str, key: str) -> str:
    return f"select '{table}' as tab, cast({key} as varchar(60)) as key_value, count(*) as n from {table} where {key} is not null group by {key} having count(*) > 1"


def unaccepted(table: str, column: str, values: list[str]) -> str:
    held = ", ".join(f"'{v}'" for v in values)
    return f"select '{table}.{column}' as col, cast({column} as varchar(60)) as value, count(*) as n from {table} where cast({column} as varchar(60)) not in ({held}) group by {column}"


def orphans(table: str, key: str, parent: str) -> str:
    return f"select '{table}.{key}' as link, count(*) as orphans from {table} a left join {parent} b on a.{key} = b.{key} where a.{key} is not null and b.{key} is null"


RULES = {
    "Q01": (tuple(NOT_NULL), " union all ".join(nulls(t, c) for t, c in NOT_NULL.items())),
    "Q02": (tuple(UNIQUE), " union all ".join(repeated(t, k) for t, k in UNIQUE.items())),
    "Q03": (tuple(dict.fromkeys(t for t, _, _ in ACCEPTED)), " union all ".join(unaccepted(*r) for r in ACCEPTED)),
    "Q04": (tuple(dict.fromkeys(x for a, _, b in LINKS for x in (a, b))), " union all ".join(orphans(*r) for r in LINKS)),
}


def register(marts: dict[str, tuple[tuple[str, ...], str]]) -> None:
    """The marts that the rules read by key become frames."""
    for name in {n for names, _ in RULES.values() for n in names if n.startswith("mart_")} - {"mart_k02"}:
        retail.ADAPTER[name] = marts[name.removeprefix("mart_").upper()][1]


#: Inputs that many marts read: a query of rules derives each of them once.
KEPT = ("sorders", "payments", "order_items", "lines", "returns", "reviews", "sales", "inventory", "web_traffic", "promotions", "rfm", "first_month", "active_month", "attention", "snapshots", "daily_base", "executive", "lifetime")


def queries():
    def make(names, text):
        def rule(spark, sf_dir):
            frames = retail.load(spark, sf_dir, ["rfm" if n == "mart_k02" else n for n in names], KEPT, (text, segments.BASE))
            if "mart_k02" in names:  # its tiles are exact without one task over all customers, so it is no SQL
                frames["mart_k02"] = segments.segmented(spark, frames)
            return retail.run(spark, frames, text)

        return rule

    return {k: make(*r) for k, r in RULES.items()}


def oracle_sql():
    tiled = segments.oracle_sql()["K02"].removeprefix(retail.ctes("rfm"))
    read = lambda names: [n if n != "mart_k02" else "rfm" for n in names]
    return {k: f"{retail.ctes(*read(names))}{f', mart_k02 as ({tiled})' if 'mart_k02' in names else ''} {retail.spelled(text, 1)}" for k, (names, text) in RULES.items()}
