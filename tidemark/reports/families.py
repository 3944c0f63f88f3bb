"""The families of report queries as functions of a frame and their parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ranking import row_numbers

Sums = Mapping[str, Column]
PARTS = {"year": lambda c: F.year(c), "quarter": lambda c: F.quarter(c), "month": lambda c: F.month(c), "month_start": lambda c: F.trunc(c, "MM"), "day_of_month": lambda c: F.day(c), "day_of_week": lambda c: F.weekday(c)}


def sliced(df: DataFrame, columns: Sequence[str] = (), day: str | None = None, between: tuple[dt.date, dt.date] | None = None, **within: Sequence) -> DataFrame:
    """Columns of the rows of a range of days and of lists of values; an empty list keeps no row."""
    if between:
        df = df.filter(F.col(day).between(*map(F.lit, between)))
    for name, values in within.items():
        df = df.filter(F.col(name).isin(list(values)) if values else F.lit(False))
    return df.select(*columns) if columns else df


def rolled(df: DataFrame, sums: Sums, by: Sequence[str] = (), part: tuple[str, str] | None = None) -> DataFrame:
    """Aggregates in one row, by columns, and by a part (of PARTS) of a date column."""
    keys = [F.col(c) for c in by] + ([PARTS[part[1]](F.col(part[0])).alias(part[1])] if part else [])
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])


def ratio(above: str, below: str) -> Column:
    """A ratio of sums, null where the lower one is zero."""
    return F.try_divide(F.sum(F.col(above).cast("double")), F.sum(F.col(below).cast("double")))


def long(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A row for each metric, from one scan."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def top(df: DataFrame, value: str, ties: Sequence[str], k: int, bottom: bool = False) -> DataFrame:
    """The k highest or lowest rows; nulls come last, ties go by the given columns."""
    c = F.col(value)
    return df.orderBy(c.asc_nulls_last() if bottom else c.desc_nulls_last(), *ties).limit(k)


def tiers(df: DataFrame, value: str, tie: str, names: Sequence[str]) -> DataFrame:
    """As many tiers of equal size as there are names, the highest values in the first; the first ones hold the rest's rows."""
    n, total = len(names), df.agg(F.count("*").alias("__rows"))
    ranked = row_numbers(df.withColumn("__down", -F.col(value).cast("double")), "__down", tie, "__rn").drop("__down").join(F.broadcast(total))
    small, big = F.floor(F.col("__rows") / n), F.col("__rows") % n
    at = F.when(F.col("__rn") <= big * (small + 1), F.floor((F.col("__rn") - 1) / (small + 1))).otherwise(big + F.floor(F.try_divide(F.col("__rn") - 1 - big * (small + 1), small)))
    return ranked.withColumn("tier", F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))).drop("__rn", "__rows")


def pareto(df: DataFrame, value: str, tie: str, shares: Sequence[float]) -> DataFrame:
    """What part of the value's sum the highest shares of rows hold: share, rows, part."""
    both = df.agg(F.count("*").alias("__rows"), F.sum(F.col(value).cast("double")).alias("__sum"))
    ranked = row_numbers(df.select(F.col(value).cast("double").alias("__v"), F.col(tie), (-F.col(value).cast("double")).alias("__down")), "__down", tie, "__rn").join(F.broadcast(both))
    marked = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).filter(F.col("__rn") <= F.ceil(F.col("share") * F.col("__rows")))
    return marked.groupBy("share").agg(F.count("*").alias("n_rows"), F.try_divide(F.sum("__v"), F.first("__sum")).alias("part"))


def extremes(df: DataFrame, period: str, value: str) -> DataFrame:
    """The periods of the highest and the lowest value; the earliest of equal ones."""
    high, low = F.max(F.struct(F.col(value), -F.datediff(F.col(period), F.lit("1970-01-01")))), F.min(F.struct(F.col(value), F.col(period).alias("p")))
    some = df.filter(F.col(value).isNotNull())
    peak = some.agg(high.alias("h"), low.alias("l"))
    return peak.select(F.date_add(F.lit("1970-01-01").cast("date"), -F.col("h")["col2"]).alias("peak_period"), F.col("h")[value].alias("peak"), F.col("l")["p"].alias("trough_period"), F.col("l")[value].alias("trough"))


def grown(df: DataFrame, period: str, value: str, lags: Mapping[str, int], keys: Sequence[str] = ()) -> DataFrame:
    """Growth over so many periods back, null where there is none or it is zero."""
    w = Window.partitionBy(*keys).orderBy(period)
    return df.withColumns({n: F.try_divide(F.col(value), F.lag(value, k).over(w)) - 1 for n, k in lags.items()})


def averaged(df: DataFrame, day: str, value: str, spans: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Means over the last so many rows, the row itself among them."""
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumns({f"ma_{k}": F.avg(value).over(w.rowsBetween(1 - k, 0)) for k in spans})


def line(df: DataFrame, day: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope a day and r2 of a straight line; a constant series has r2 null."""
    x = F.datediff(F.col(day), F.lit("1970-01-01")).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(F.col(value).cast("double"), x).alias("slope"), F.when(F.var_pop(value) > 0, F.regr_r2(F.col(value).cast("double"), x)).alias("r2"))


def unusual(df: DataFrame, value: str, keys: Sequence[str] = (), limit: float = 2.0) -> DataFrame:
    """Z of each row within its group, and whether it is a spike, a drop or normal."""
    w = Window.partitionBy(*keys)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.withColumn("z", z).withColumn("state", F.when(F.col("z") > limit, "spike").when(F.col("z") < -limit, "drop").otherwise("normal"))


def shared_out(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Each row's share of its group's sum."""
    return df.withColumn("share", F.try_divide(F.col(value).cast("double"), F.sum(F.col(value).cast("double")).over(Window.partitionBy(*within))))


def spread(df: DataFrame, column: str, values: Sequence, value: Column, name: str) -> DataFrame:
    """One row with an aggregate for each of the column's given values."""
    return df.groupBy().pivot(column, list(values)).agg(value).select(*[F.col(f"`{v}`").alias(f"{v}_{name}") for v in values])


def what_if(df: DataFrame, base: str, shifts: Sequence[float]) -> DataFrame:
    """The base sum after each relative shift, and the difference."""
    one = df.agg(F.sum(F.col(base).cast("double")).alias("__b")).withColumn("shift", F.explode(F.array(*[F.lit(float(s)) for s in shifts])))
    return one.select("shift", (F.col("__b") * (1 + F.col("shift"))).alias("projected"), (F.col("__b") * F.col("shift")).alias("delta"))


def bucketed(df: DataFrame, value: str, edges: Sequence[float], sums: Sums) -> DataFrame:
    """Aggregates of rows between edges; each bucket takes its upper edge, values above the last are in one more, nulls in none."""
    bucket = F.lit(None).cast("string")
    low = None
    for e in reversed(edges):
        bucket = F.when(F.col(value) <= e, F.lit(f"<= {e:g}")).otherwise(F.lit(f"> {e:g}") if low is None else bucket)
        low = e
    return df.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(*[c.alias(n) for n, c in sums.items()])


def ranked(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rank from the highest value down within each group, equal values alike."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())))
