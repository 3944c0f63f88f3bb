"""Audits of a modelling table and of what models make of it, as rows of section, key and value."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import keyed


def section(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
    return df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))


def profile(df: DataFrame, day: str = "sales_date") -> DataFrame:
    """Rows, columns, columns of each type, and the first and last day, counted from 1970-01-01; days are null in an empty table."""
    since = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    kinds = [kind for _, kind in df.dtypes]
    counts = {"n_columns": float(len(kinds)), **{f"columns_{kind}": float(kinds.count(kind)) for kind in sorted(set(kinds))}}
    wide = df.agg(F.count("*").cast("double").alias("n_rows"), since(F.min(day)).alias("first_day"), since(F.max(day)).alias("last_day")).select("*", *[F.lit(v).alias(k) for k, v in counts.items()])
    return section(wide.unpivot([], wide.columns, "key", "value"), "schema", "key", "value")


def nulls(df: DataFrame) -> DataFrame:
    """The share of nulls of every column, from one scan; null for an empty table."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    return section(shares.unpivot([], shares.columns, "key", "value"), "nulls", "key", "value")


def gaps(df: DataFrame, keys: Sequence[str] = (), day: str = "sales_date") -> DataFrame:
    """D3: days that do not follow their series' day before, with the days between."""
    gap = F.datediff(day, F.lag(day).over(keyed.over(keys, day)))
    return section(df.select(F.concat_ws(" ", *keys, day).alias("key"), gap.alias("value")).filter("value <> 1"), "gaps", "key", "value")


def row_counts(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Rows of related tables, -1 for one that cannot be read; counted in one job."""
    out = spark.createDataFrame([], "section string, key string, value double")
    for name, read in tables.items():
        try:
            rows = read().agg(F.count("*").cast("double").alias("value"))
        except AnalysisException:
            rows = spark.range(1).select(F.lit(-1.0).alias("value"))
        out = out.unionByName(section(rows.withColumn("key", F.lit(name)), "rows", "key", "value"))
    return out


def mean_importance(importances: DataFrame, weak: float = 0.01) -> DataFrame:
    """(model, target, feature, importance) to each feature's mean share of its model's and target's highest importance, and whether that is weak.

    Where all importances of a model are zero, its shares are zero."""
    top = F.max("importance").over(Window.partitionBy("model", "target"))
    share = importances.withColumn("share", F.coalesce(F.try_divide("importance", top), F.lit(0.0)))
    return share.groupBy("feature").agg(F.avg("share").alias("mean_share"), F.avg("importance").alias("mean_importance")).withColumn("is_weak", F.col("mean_share") < weak)


def contract(df: DataFrame, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """Declared columns that are missing (-1), columns that no role declares (0), and the others (1)."""
    declared = [c for names in roles.values() for c in names]
    rows = [(c, 1.0 if c in df.columns else -1.0) for c in dict.fromkeys(declared)] + [(c, 0.0) for c in df.columns if c not in declared]
    return section(df.sparkSession.createDataFrame(rows, "key string, value double"), "columns", "key", "value")


def summary(*parts: DataFrame) -> DataFrame:
    """All sections in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
