"""Features and measures of many daily series at once.

A series is the rows of one value of the key columns; no key columns make one series of all rows. Windows are partitioned by the
keys, so that one plan serves any number of series, and a task holds the days of whole series only. Every function takes and
returns DataFrames; `day` names the date column, and targets are the columns revenue and cogs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

REVENUE_LAGS, COGS_LAGS = (1, 2, 3, 7, 14, 28, 90, 180, 365, 730), (1, 7, 28, 365, 730)
MEANS = {"revenue": (7, 28, 365), "cogs": (7, 28), "cogs_ratio": (7, 28)}
DEVIATIONS = {"revenue": (7, 28, 365), "cogs": (28,), "cogs_ratio": (28,)}
SLOPES = {"revenue": (7, 14, 28), "cogs_ratio": (28,)}
SPANS = (7, 28)
TARGETS = ("revenue", "cogs")


def over(keys: Sequence[str], day: str = "sales_date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(day)


def on(keys: Sequence[str], left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by the keys, each a match of nulls too; without keys the right side is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*[f"__{k}" for k in keys])


def dense(series: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", values: Sequence[str] = TARGETS) -> DataFrame:
    """A row for each day between a series' first and last one; days without a row get zeros."""
    ends = series.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("z")).filter("a is not null")
    days = ends.select(*keys, F.explode(F.sequence("a", "z")).alias(day))
    return on([*keys, day], days, series.select(*keys, day, *values), "left").fillna(0, list(values))


def ratio(series: DataFrame) -> DataFrame:
    """cogs over revenue, null where revenue is zero."""
    return series.withColumn("cogs_ratio", F.try_divide("cogs", "revenue"))


def calendar(rows: DataFrame, day: str = "sales_date", anchor: str = "1992-01-01") -> DataFrame:
    """Parts of the date, cycles, and days since an anchor; the week starts at Monday = 0."""
    d, turn = F.col(day), lambda c, n: 2 * np.pi * c / n
    last, year = F.last_day(d), F.dayofyear(F.date_sub(F.add_months(F.trunc(d, "YEAR"), 12), 1))
    quarter = F.date_sub(F.add_months(F.trunc(d, "QUARTER"), 3), 1)
    parts = {
        "day_of_week": F.weekday(d), "day_of_month": F.day(d), "month": F.month(d), "day_of_year": F.dayofyear(d),
        "days_to_month_end": F.datediff(last, d) + 1, "days_to_quarter_end": F.datediff(quarter, d), "days_since_anchor": F.datediff(d, F.lit(anchor).cast("date")),
    }
    flags = {"is_month_start_window": F.day(d) <= 3, "is_month_end_window": F.datediff(last, d) <= 3, "is_pay_day": (F.day(d) >= 25) | (F.day(d) <= 5)}
    cycles = {"day_of_week": (F.weekday(d), 7), "day_of_year": (F.dayofyear(d), year), "month": (F.month(d), 12)}
    waves = {f"{name}_{f.__name__}": f(turn(c, n)) for name, (c, n) in cycles.items() for f in (F.sin, F.cos)}
    return rows.withColumns({**parts, **{k: v.cast("int") for k, v in flags.items()}, **waves})


def profiled(rows: DataFrame, history: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", targets: Sequence[str] = TARGETS) -> DataFrame:
    """Means of the history by weekday, month and day of month, the additive baseline of each target and its logarithm.

    Weekdays, months and days that a history lacks take its overall mean."""
    cuts = {"dow": F.weekday(day), "month": F.month(day), "dom": F.day(day)}
    out = on(keys, rows, history.groupBy(*keys).agg(*[F.avg(t).alias(f"overall_avg_{t}") for t in targets]), "left")
    for name, part in cuts.items():
        means = history.groupBy(*keys, part.alias("__part")).agg(*[F.avg(t).alias(f"hist_avg_{t}_{name}") for t in targets])
        out = on([*keys, "__part"], out.withColumn("__part", part), means, "left").drop("__part")
        out = out.withColumns({f"hist_avg_{t}_{name}": F.coalesce(f"hist_avg_{t}_{name}", f"overall_avg_{t}") for t in targets})
    base = lambda t: F.col(f"hist_avg_{t}_dow") + F.col(f"hist_avg_{t}_month") - F.col(f"overall_avg_{t}")
    return out.withColumns({f"{t}_baseline": base(t) for t in targets}).withColumns({f"log_{t}_baseline": F.log1p(F.greatest(F.col(f"{t}_baseline"), F.lit(0.0))) for t in targets})


def residuals(rows: DataFrame) -> DataFrame:
    """what the baselines leave."""
    return rows.withColumns({f"{t}_residual": F.col(t) - F.col(f"{t}_baseline") for t in TARGETS})


def derived(rows: DataFrame, keys: Sequence[str] = (), day: str = "sales_date") -> DataFrame:
    """Lags, windows that end the day before, slopes, growth and differences; rows hold cogs_ratio and residuals."""
    w = over(keys, day)
    lag = lambda c, k: F.lag(c, k).over(w)
    number = F.row_number().over(w).cast("double")
    before = lambda k: w.rowsBetween(-k, -1)
    few = lambda c, k, value: F.when(F.count(c).over(before(k)) >= 2, value)
    first = {f"lag_{k}d_revenue": lag("revenue", k) for k in REVENUE_LAGS} | {f"lag_{k}d_cogs": lag("cogs", k) for k in COGS_LAGS}
    first |= {"lag_1d_cogs_ratio": lag("cogs_ratio", 1), "__n": number, "__lag_8": lag("revenue", 8), "__lag_29": lag("revenue", 29)}
    first |= {f"lag_{k}d_{name}_residual": lag(f"{t}_residual", k) for t, name in (("revenue", "rev"), ("cogs", "cogs")) for k in (1, 7)}
    first |= {f"roll_mean_{k}d_{c}": F.avg(c).over(before(k)) for c, spans in MEANS.items() for k in spans}
    first |= {f"roll_std_{k}d_{c}": few(c, k, F.stddev_samp(c).over(before(k))) for c, spans in DEVIATIONS.items() for k in spans}
    out = rows.withColumns(first)
    grown = lambda base: F.when(F.col(base) != 0, F.col("lag_1d_revenue") / F.col(base) - 1)
    second = {f"trend_{k}d_revenue" if c == "revenue" else f"{c}_trend_{k}d": few(c, k, F.regr_slope(F.col(c), F.col("__n")).over(before(k))) for c, spans in SLOPES.items() for k in spans}
    second |= {f"lag_1d_rev_{name}_growth": grown(base) for name, base in (("wow", "__lag_8"), ("mom", "__lag_29"), ("yoy", "lag_365d_revenue"))}
    second |= {f"{t}_diff_7d": F.col(f"lag_1d_{t}") - F.col(f"lag_7d_{t}") for t in TARGETS}
    out = out.withColumns(second)
    return out.withColumns({f"rev_{g}_acceleration": F.col(f"lag_1d_rev_{g}_growth") - lag(f"lag_1d_rev_{g}_growth", 1) for g in ("wow", "mom", "yoy")}).drop("__n", "__lag_8", "__lag_29")


def ema(values: np.ndarray, span: int) -> np.ndarray:
    """The exponential mean up to each value; it starts at the first value, and anew after a missing one."""
    a, out = 2.0 / (span + 1), np.full(len(values), np.nan)
    for i, v in enumerate(values):
        before = out[i - 1] if i else np.nan
        out[i] = v if np.isnan(before) else a * v + (1 - a) * before
    return out


def shifted(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], values[:-1]])


def smoothed(rows: DataFrame, keys: Sequence[str] = (), day: str = "sales_date") -> DataFrame:
    """exponential means of spans 7 and 28 and the volatility around the shorter one, all up to the day before."""
    names = [*(f"ema_{k}d_{t}" for k in SPANS for t in TARGETS), "ewm_vol_7d_revenue"]

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(day, ignore_index=True)
        revenue = f["revenue"].to_numpy(float)
        columns = {f"ema_{k}d_{t}": shifted(ema(f[t].to_numpy(float), k)) for k in SPANS for t in TARGETS}
        return f.assign(**columns, ewm_vol_7d_revenue=shifted(ema((revenue - ema(revenue, 7)) ** 2, 7)))

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    out = rows.groupBy(*keys).applyInPandas(each, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def features(series: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", history: DataFrame | None = None) -> DataFrame:
    """All of the above for dense series; profiles come from the history, the series itself by default."""
    rows = residuals(profiled(calendar(ratio(series), day), history if history is not None else series, keys, day))
    return smoothed(derived(rows, keys, day), keys, day)


# Forecast measures


def forward(rows: DataFrame, transform: str = "identity", cogs: str = "absolute") -> DataFrame:
    """The labels revenue_label and cogs_label of a transform; cogs may be a ratio to revenue, held within 0 and 2."""

    def label(t: str) -> Column:
        plain, base = F.col(t), f"{t}_baseline"
        return {
            "identity": lambda: plain, "residual": lambda: plain - F.coalesce(base, F.lit(0.0)), "log": lambda: F.log1p(F.greatest(plain, F.lit(0.0))),
            "log_residual": lambda: F.log1p(F.greatest(plain, F.lit(0.0))) - F.coalesce(f"log_{base}", F.lit(0.0)),
        }[transform]()

    share = F.try_divide("cogs", "revenue")
    second = F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(2.0))) if cogs == "ratio" else label("cogs")
    return rows.withColumns({"revenue_label": label("revenue"), "cogs_label": second})


def inverse(rows: DataFrame, transform: str = "identity", cogs: str = "absolute") -> DataFrame:
    """predicted_revenue and predicted_cogs from predictions of the labels, never below zero."""

    def value(t: str) -> Column:
        p, base = F.col(f"{t}_prediction"), f"{t}_baseline"
        back = {
            "identity": lambda: p, "residual": lambda: p + F.coalesce(base, F.lit(0.0)), "log": lambda: F.expm1(p),
            "log_residual": lambda: F.expm1(p + F.coalesce(f"log_{base}", F.lit(0.0))),
        }[transform]()
        return F.greatest(back, F.lit(0.0))

    out = rows.withColumn("predicted_revenue", value("revenue"))
    second = F.col("predicted_revenue") * F.least(F.greatest("cogs_prediction", F.lit(0.0)), F.lit(2.0)) if cogs == "ratio" else value("cogs")
    return out.withColumn("predicted_cogs", second)


def sliding_folds(series: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", folds: int = 2, horizon: int = 548, train: int | None = 1096, purge: int = 7) -> DataFrame:
    """Rows with fold and role; fold 0 tests the last horizon of each series, training ends a purge before it and takes `train` rows, or all of them."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day))) - 1
    rows = series.withColumn("__back", back).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("__at", F.col("__back") - F.col("fold") * horizon)
    known = F.col("__at") >= horizon + purge
    if train is not None:
        known &= F.col("__at") < horizon + purge + train
    role = F.when(F.col("__at").between(0, horizon - 1), "test").when(known, "train")
    return rows.withColumn("role", role).filter("role is not null").drop("__back", "__at")


def recency_weights(rows: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", decay: float = 0.001) -> DataFrame:
    """Weights that fall with a row's age and average to one in each series."""
    whole = Window.partitionBy(*keys)
    aged = rows.withColumn("weight", F.exp(-decay * F.datediff(F.max(day).over(whole), F.col(day))))
    return aged.withColumn("weight", F.col("weight") / F.avg("weight").over(whole))


def seasonal_naive(history: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", horizon: int = 548, period: int = 365, targets: Sequence[str] = TARGETS) -> DataFrame:
    """The days after each series' last one, with its last `period` values again and again; a shorter series repeats its last value."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day)))
    size = F.count("*").over(Window.partitionBy(*keys))
    tail = history.select(*keys, day, *targets, back.alias("__back"), size.alias("__size"))
    last = tail.filter("__back = 1").select(*keys, F.col(day).alias("__last"), "__size")
    steps = last.select(*keys, "__last", F.when(F.col("__size") >= period, F.lit(period)).otherwise(1).alias("__period"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    steps = steps.withColumn("__back", F.col("__period") - F.pmod(F.col("step") - 1, F.col("__period")))
    values = tail.filter(F.col("__back") <= period).select(*keys, "__back", *targets)
    return on([*keys, "__back"], steps.withColumn(day, F.date_add("__last", F.col("step"))), values).select(*keys, day, "step", *targets)


def metrics(rows: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Mae, rmse and r2 of each group; r2 is 0 where the actual values do not vary."""
    a, gap = F.col(actual), F.col(actual) - F.col(predicted)
    return rows.groupBy(*by).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.when(F.var_pop(a) > 0, 1 - F.avg(gap * gap) / F.var_pop(a)).otherwise(0.0).alias("r2"))


def inverse_error_weights(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, model, mae of both targets summed) to one weight a model: shares of 1 / max(mae, 1) in each fold, averaged, summing to one."""
    share = errors.withColumn("w", 1 / F.greatest("mae", F.lit(1.0)))
    share = share.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "fold"))).groupBy(*keys, "model").agg(F.avg("w").alias("w"))
    return share.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(*keys))).drop("w")


def blend(forecasts: DataFrame, weights: DataFrame | None = None, keys: Sequence[str] = (), by: Sequence[str] = ("sales_date",), targets: Sequence[str] = TARGETS) -> DataFrame:
    """The mean of all models' forecasts, by weights where there are any; models without a forecast of a row do not count there."""
    rows = forecasts.withColumn("weight", F.lit(1.0)) if weights is None else on([*keys, "model"], forecasts, weights.select(*keys, "model", "weight"))
    return rows.groupBy(*keys, *by).agg(*[(F.sum(F.col(t) * F.col("weight")) / F.sum("weight")).alias(t) for t in targets])
