"""Exact global row numbers and tiles without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPLITS = 200


def row_numbers(df: DataFrame, value: str, tie: str, out: str, splits: int = SPLITS) -> DataFrame:
    """Number rows from 1 by value (nulls last), then by tie, which is unique.

    Rows go to buckets between approximate quantiles of the value. Any split points give
    exact numbers: each bucket numbers its own rows and adds the sizes of the buckets before it.
    Only the split points and one count per bucket leave the executors' partitions."""
    points = df.select(F.percentile_approx(F.col(value).cast("double"), [i / splits for i in range(1, splits)], 10_000)).head()[0] or []
    edges = F.array(*[F.lit(float(p)) for p in sorted(set(points))]).cast("array<double>")
    bucket: Column = F.when(F.col(value).isNull(), F.lit(splits)).otherwise(F.size(F.filter(edges, lambda e: e < F.col(value).cast("double"))))
    placed = df.withColumn("_bucket", bucket)
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(value).asc_nulls_last(), F.col(tie)))
    return placed.withColumn("_within", within).join(F.broadcast(starts), "_bucket").withColumn(out, F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before")


def tiles(df: DataFrame, value: str, tie: str, n: int, out: str) -> DataFrame:
    """ntile(n) over (order by value, tie): the first rows mod n tiles hold one row more."""
    total = df.agg(F.count("*").alias("_rows"))
    numbered = row_numbers(df, value, tie, "_rn").join(F.broadcast(total))
    small, big = F.floor(F.col("_rows") / n), F.col("_rows") % n
    tile = F.when(F.col("_rn") <= big * (small + 1), F.ceil(F.col("_rn") / (small + 1))).otherwise(big + F.ceil((F.col("_rn") - big * (small + 1)) / small))
    return numbered.withColumn(out, tile.cast("int")).drop("_rn", "_rows")
