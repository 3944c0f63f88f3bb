"""Customer segments and revenue tiers from exact tiles over all customers or products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.ranking import tiles
from tidemark.plans import layers  # noqa: F401  registers the frames
from tidemark.sources import retail

#: The first rule that fits names the segment.
SEGMENT = """case when r_score >= 4 and f_score >= 4 and m_score >= 4 then 'Champions' when r_score >= 3 and f_score >= 3 and m_score >= 3 then 'Loyal'
 when r_score >= 4 and f_score <= 2 then 'New Customers' when r_score >= 3 and f_score <= 2 and m_score >= 3 then 'Potential Loyalist' when r_score >= 3 and f_score <= 2 and m_score <= 2 then 'Promising'
 when r_score <= 2 and f_score >= 3 then 'At Risk' when r_score <= 2 and f_score <= 2 and m_score >= 3 then 'Cannot Lose Them' when r_score <= 2 and f_score <= 2 and m_score <= 2 then 'Hibernating'
 when r_score >= 3 and f_score >= 3 and m_score <= 2 then 'Need Attention' else 'Others' end"""
SCORES = {"r_score": "recency_days", "f_score": "total_orders", "m_score": "revenue_4"}
BASE = "select customer_id, acquisition_channel, age_group, total_orders, recency_days, round(total_revenue, 4) as revenue_4 from rfm"
SHOWN = "customer_id, acquisition_channel, age_group, cast(total_orders as bigint) as total_orders, revenue_4 as total_revenue, cast(recency_days as bigint) as recency_days, r_score, f_score, m_score"


def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark, retail.load(spark, sf_dir, ("rfm",)))


def segmented(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    df = retail.run(spark, frames, BASE).persist()
    for score, value in SCORES.items():
        df = tiles(df, value, "customer_id", 5, score)
    return df.withColumn("rfm_segment", F.expr(SEGMENT)).selectExpr(*[c.strip() for c in SHOWN.split(",")], "rfm_segment")


def revenue_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles of products by revenue with each decile's share of all revenue."""
    df = retail.run(spark, retail.load(spark, sf_dir, ("lifetime",)), "select product_id, round(total_revenue, 4) as revenue from lifetime")
    per = tiles(df, "revenue", "product_id", 10, "tier").groupBy("tier").agg(F.count("*").alias("n"), F.sum("revenue").alias("r"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("r").alias("total")))).selectExpr("tier", "n", "round(r, 4) as revenue", "round(r / total, 6) as share")


def queries():
    return {"K02": rfm_segments, "R09": revenue_tiers}


def oracle_sql():
    scores = ", ".join(f"cast(ntile(5) over (order by {v}, customer_id) as int) as {s}" for s, v in SCORES.items())
    return {
        "K02": f"{retail.ctes('rfm')} select {SHOWN}, {SEGMENT} as rfm_segment from (select *, {scores} from ({BASE}) b) s",
        "R09": f"{retail.ctes('lifetime')} select tier, count(*) as n, round(sum(revenue), 4) as revenue, round(sum(revenue) / max(total), 6) as share from (select *, sum(revenue) over () as total, cast(ntile(10) over (order by revenue, product_id) as int) as tier from (select product_id, round(total_revenue, 4) as revenue from lifetime) b) s group by tier",
    }
