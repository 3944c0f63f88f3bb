"""Trend and season baselines of keyed series, and forecasts without a model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.functions import keyed

YEAR, WEEK = 365.25, 7.0


def design(t: np.ndarray, span: float, yearly: int, weekly: int, bends: int) -> np.ndarray:
    """One, a straight trend, `bends` later changes of its slope, and waves of the year and the week; t in days, span the history's length."""
    u = t / span
    columns = [np.ones_like(u), u, *(np.maximum(u - (b + 1) / (bends + 1) * 0.8, 0.0) for b in range(bends))]
    for period, n in ((YEAR, yearly), (WEEK, weekly)):
        columns += [f(2 * np.pi * k * t / period) for k in range(1, n + 1) for f in (np.sin, np.cos)]
    return np.stack(columns, 1)


def baseline(
    history: DataFrame, future: DataFrame | None = None, keys: Sequence[str] = (), day: str = "sales_date", log: bool = False, yearly: int = 6, weekly: int = 3, bends: int = 3, ridge: float = 1e-6
) -> DataFrame:
    """Keys, day, trend_revenue_baseline and trend_cogs_baseline of the history's and the future's days, and residuals where there are values.

    Least squares for each series by itself, of the values or of log(1 + value), both from zero up; a log baseline stays a logarithm,
    and residuals are in the same scale. Waves of the year are left out where a series has less than two years, and the slope's
    bends where it has less than one; days without a value are not fitted. Each series is one group of one row a day."""
    names = [f"trend_{t}_baseline" for t in keyed.TARGETS]
    left = [f"trend_{t}_residual" for t in keyed.TARGETS]
    one = history.select(*keys, day, *[F.col(t).cast("double").alias(t) for t in keyed.TARGETS])
    rows = one if future is None else one.unionByName(future.select(*keys, day), allowMissingColumns=True)

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(day, ignore_index=True)
        dates = pd.to_datetime(f[day])
        known = f[list(keyed.TARGETS)].notna().any(axis=1)
        start = dates[known].min() if known.any() else dates.min()
        t = (dates - start).dt.days.to_numpy(float)
        span = max(1.0, float(t[known].max(initial=0.0)))
        x = design(t, span, yearly if span >= 2 * YEAR else 0, weekly if span >= 2 * WEEK else 0, bends if span >= YEAR else 0)
        for target, name, rest in zip(keyed.TARGETS, names, left, strict=True):
            y = np.maximum(f[target].to_numpy(float), 0.0)
            y = np.log1p(y) if log else y
            ok = ~np.isnan(y)
            if not ok.any():
                f[name], f[rest] = np.nan, np.nan
                continue
            a = x[ok].T @ x[ok] + ridge * np.eye(x.shape[1])
            f[name] = x @ np.linalg.solve(a, x[ok].T @ y[ok])
            f[rest] = y - f[name]
        return f[[*keys, day, *names, *left]]

    schema = T.StructType([*rows.select(*keys, day).schema.fields, *(T.StructField(n, T.DoubleType()) for n in (*names, *left))])
    out = rows.groupBy(*keys).applyInPandas(each, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in (*names, *left)})


def held_out(series: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", share: float = 0.8, period: int = 365) -> DataFrame:
    """Errors of the seasonal naive forecast of each series' last rows from its first `share` of rows: keys, target, n_train, n_test, mae, rmse, r2."""
    w = Window.partitionBy(*keys)
    rows = series.withColumns({"__n": F.row_number().over(w.orderBy(day)), "__size": F.count("*").over(w)}).withColumn("__cut", F.floor(F.col("__size") * share))
    train, test = rows.filter("__n <= __cut"), rows.filter("__n > __cut").withColumn("__step", F.col("__n") - F.col("__cut"))
    back = F.row_number().over(w.orderBy(F.desc(day)))
    tail = train.withColumn("__back", back).select(*keys, "__back", *[F.col(t).alias(f"predicted_{t}") for t in keyed.TARGETS])
    source = F.when(F.col("__cut") >= period, period - F.pmod(F.col("__step") - 1, F.lit(period))).otherwise(1)
    both = keyed.on([*keys, "__back"], test.withColumn("__back", source.cast("int")), tail)
    sizes = rows.groupBy(*keys).agg(F.max("__cut").alias("n_train"), (F.max("__size") - F.max("__cut")).alias("n_test"))
    parts = [keyed.metrics(both, list(keys), t, f"predicted_{t}").withColumn("target", F.lit(t)) for t in keyed.TARGETS]
    return keyed.on(keys, parts[0].unionByName(parts[1]), sizes)
