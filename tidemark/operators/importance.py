"""What features a fitted model leans on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import keyed
from tidemark.operators import models
from tidemark.operators.ranking import row_numbers


def last_part(rows: DataFrame, day: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the day on that starts the last share of all days."""
    dates = rows.select(day).distinct().withColumn("__at", F.percent_rank().over(Window.partitionBy().orderBy(day)))  # one row a day
    first = dates.filter(F.col("__at") >= 1 - share).agg(F.min(day).alias("__first"))
    marked = rows.crossJoin(F.broadcast(first))
    return marked.filter(F.col(day) < F.col("__first")).drop("__first"), marked.filter(F.col(day) >= F.col("__first")).drop("__first")


def permuted(model: models.Dual, rows: DataFrame, order: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """By how much the summed mae of both targets grows when a feature's values are dealt out anew: feature, perm_importance
    (mean over repeats), perm_std (of the population), perm_importance_pct of the plain error, and tier.

    Rows are numbered by `order`, whose values are unique, and once a repeat by a seeded hash; the row of equal number in the other
    numbering lends its values. All features of a repeat take the same deal, each for itself, so that there are as
    many self-joins as repeats and no group of rows meets in one task."""
    held = [c for c in dict.fromkeys([*keyed.TARGETS, *model.features, *[c for c in rows.columns if c.endswith("_baseline")]]) if c in rows.columns]
    named = rows.select(*held, F.struct(*order).alias("__key"), F.xxhash64(F.lit(seed), *order).alias("__hash"))
    base = row_numbers(named, "__hash", "__key", "__n").drop("__key", "__hash")
    base = base.cache()
    features = model.features
    vector = F.array(*[F.col(c).cast("double") for c in features])
    try:
        plain = mae(model.predict(base), [])
        total = None
        for r in range(repeats):
            dealt = row_numbers(base.select("__n", vector.alias("__lent")).withColumn("__deal", F.xxhash64(F.lit(seed + r + 1), "__n")), "__deal", "__n", "__m")
            pairs = base.withColumn("__own", vector).join(dealt.select(F.col("__m").alias("__n"), "__lent"), "__n")
            pairs = pairs.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
            at = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
            mixed = pairs.withColumn("__row", F.transform("__own", lambda v, i: F.when(i == at, F.element_at("__lent", (at + 1).cast("int"))).otherwise(v)))
            shuffled = mixed.select("feature", *[c for c in held if c not in features], *[F.col("__row")[i].alias(f) for i, f in enumerate(features)])
            own = mae(model.predict(shuffled), ["feature"]).withColumn("repeat", F.lit(r))
            total = own if total is None else total.unionByName(own)
        grown = total.crossJoin(F.broadcast(plain.withColumnRenamed("mae", "plain"))).withColumn("d", F.col("mae") - F.col("plain"))
        out = grown.groupBy("feature").agg(F.avg("d").alias("perm_importance"), F.stddev_pop("d").alias("perm_std"), F.first("plain").alias("plain"))
        out = out.withColumn("perm_importance_pct", F.round(100 * F.try_divide("perm_importance", "plain"), 4)).drop("plain")
        rows_out = out.withColumn("tier", models.tier("perm_importance_pct")).collect()  # one row a feature
    finally:
        base.unpersist()
    return rows.sparkSession.createDataFrame(rows_out, "feature string, perm_importance double, perm_std double, perm_importance_pct double, tier string")


def mae(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.avg(F.abs(F.col("revenue") - F.col("predicted_revenue"))) + F.avg(F.abs(F.col("cogs") - F.col("predicted_cogs")))).alias("mae"))


def merged(gains: DataFrame, permutation: DataFrame) -> DataFrame:
    """Both reports by feature; features of one report only are kept, and the order is by gain, then by permutation."""
    out = gains.join(permutation.drop("tier"), "feature", "full")
    order = Window.partitionBy().orderBy(F.col("gain_pct").desc_nulls_last(), F.col("perm_importance").desc_nulls_last(), "feature")
    return out.withColumn("rank", F.row_number().over(order))
