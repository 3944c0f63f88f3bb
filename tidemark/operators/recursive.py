"""Recursive forecasts: day by day, each from lags and windows over the days before it, forecast ones included.

Series are independent, so each is one group; a day needs the day before, so a series is worked off in order. A model
comes as a weight for each feature and an intercept, which any number of series can share or have for themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import keyed

TRANSFORMS = ("identity", "residual", "log", "log_residual")


class State:
    """A series up to some day, and the features of the next day by name."""

    def __init__(self, revenue: np.ndarray, cogs: np.ndarray, baselines: dict[str, np.ndarray]):
        self.values = {"revenue": list(revenue), "cogs": list(cogs), "cogs_ratio": [c / r if r else np.nan for r, c in zip(revenue, cogs, strict=True)]}
        self.baselines = baselines
        self.restart()

    def restart(self) -> None:
        """Take all running means from the values anew."""
        revenue, cogs = (np.array(self.values[t], float) for t in keyed.TARGETS)
        self.means = {(t, k): (keyed.ema(v, k)[-1] if len(v) else np.nan) for t, v in (("revenue", revenue), ("cogs", cogs)) for k in keyed.SPANS}
        gaps = (revenue - keyed.ema(revenue, 7)) ** 2
        self.volatility = keyed.ema(gaps, 7)[-1] if len(gaps) else np.nan

    def add(self, revenue: float, cogs: float) -> None:
        for name, v in (("revenue", revenue), ("cogs", cogs), ("cogs_ratio", cogs / revenue if revenue else np.nan)):
            self.values[name].append(v)
        for (t, k), before in self.means.items():
            self.means[t, k] = smooth(before, self.values[t][-1], k)
        self.volatility = smooth(self.volatility, (revenue - self.means["revenue", 7]) ** 2, 7)

    def lag(self, name: str, k: int) -> float:
        v = self.values[name]
        return v[-k] if k <= len(v) else np.nan

    def residual(self, name: str, k: int) -> float:
        n = len(self.values[name]) - k
        return self.values[name][n] - self.baselines[name][n] if n >= 0 else np.nan

    def tail(self, name: str, k: int) -> np.ndarray:
        v = np.array(self.values[name][-k:], float)
        return v[~np.isnan(v)]

    def growth(self, name: str, ago: int = 0) -> float:
        base = self.lag("revenue", {"wow": 8, "mom": 29, "yoy": 365}[name] + ago)
        return self.lag("revenue", 1 + ago) / base - 1 if base else np.nan

    def slope(self, name: str, k: int) -> float:
        v = np.array(self.values[name][-k:], float)
        at = np.nonzero(~np.isnan(v))[0].astype(float)
        if len(at) < 2:
            return np.nan
        x, y = at - at.mean(), v[~np.isnan(v)]
        return float(x @ (y - y.mean()) / (x @ x))

    def feature(self, name: str) -> float:
        """The next day's value of a feature of keyed.features that the series itself gives."""
        kind, _, rest = name.partition("_")
        if name == "ewm_vol_7d_revenue":
            return self.volatility
        if name.endswith("_acceleration"):
            return self.growth(rest.split("_")[0]) - self.growth(rest.split("_")[0], 1)
        if name.endswith("_growth"):
            return self.growth(name.split("_")[3])
        if name.endswith("_diff_7d"):
            return self.lag(kind, 1) - self.lag(kind, 7)
        if kind == "trend":
            return self.slope("revenue", days(rest))
        if name == "cogs_ratio_trend_28d":
            return self.slope("cogs_ratio", 28)
        if kind == "lag":
            k, of = days(rest), rest.partition("_")[2]
            return self.residual("revenue" if of.startswith("rev_") else "cogs", k) if of.endswith("_residual") else self.lag(of, k)
        if kind == "ema":
            return self.means[rest.partition("_")[2], days(rest)]
        _, what, span, of = name.split("_", 3)
        v = self.tail(of, days(span))
        if what == "mean":
            return float(v.mean()) if len(v) else np.nan
        return float(v.std(ddof=1)) if len(v) > 1 else np.nan


def smooth(before: float, value: float, span: int) -> float:
    a = 2.0 / (span + 1)
    return value if np.isnan(before) else a * value + (1 - a) * before


def days(text: str) -> int:
    return int(text.partition("_")[0].removesuffix("d"))


def from_series(name: str) -> bool:
    """Whether a feature comes from the series and not from the date."""
    return name.startswith(("lag_", "roll_", "trend_", "ema_", "ewm_")) or name.endswith(("_acceleration", "_diff_7d", "_trend_28d"))


def forecast(
    history: DataFrame, future: DataFrame, models: DataFrame, keys: Sequence[str] = (), day: str = "sales_date", transform: str = "identity", cogs: str = "absolute", restart: int | None = None
) -> DataFrame:
    """Revenue and cogs of each future day of each series, never below zero.

    history: keys, day, revenue, cogs. future: keys, day, and the features that dates give (calendar and profiles). models: target
    (revenue or cogs), feature (null for the intercept) and weight, with the keys where each series has its own. A feature without
    a value counts as zero. With `restart`, running means are taken from the whole series anew after so many days, which keeps
    rounding from adding up. Series without history or model get no rows; days are taken in order, repeated ones each as a day."""
    if transform not in TRANSFORMS:
        raise ValueError(f"transform must be one of {', '.join(TRANSFORMS)}")
    own = [k for k in keys if k in models.columns]
    weights = models.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "target", F.coalesce("feature", F.lit(""))), "weight"))).alias("__model"))
    base = [f"{t}_baseline" for t in keyed.TARGETS]
    known = [c for c in future.columns if c not in (*keys, day, *keyed.TARGETS)]
    past = [c for c in base if c in history.columns]
    one = history.select(*keys, day, *[F.col(t).cast("double").alias(t) for t in keyed.TARGETS], *past, F.lit(False).alias("__future"))
    two = future.select(*keys, day, *[F.col(c).cast("double").alias(c) for c in known], F.lit(True).alias("__future"))
    both = keyed.on(own, one.unionByName(two, allowMissingColumns=True), weights)

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["__future", day], ignore_index=True)
        n = int((~f["__future"]).sum())
        coming = f.iloc[n:].reset_index(drop=True)
        if not n or not len(coming):
            return coming[[*keys, day]].iloc[:0].assign(revenue=0.0, cogs=0.0)
        model = dict(f["__model"].iloc[0])
        # residual features need a baseline for every day, known or to come
        levels = {t: f[b].fillna(0.0).to_numpy(float) if b in f else np.zeros(len(f)) for t, b in zip(keyed.TARGETS, base, strict=True)}
        state = State(*(f[t].to_numpy(float)[:n] for t in keyed.TARGETS), levels)
        plain = {t: {name.partition(":")[2]: w for name, w in model.items() if name.startswith(f"{t}:")} for t in keyed.TARGETS}
        names = sorted({x for w in plain.values() for x in w if x})
        moving = [x for x in names if from_series(x)]
        fixed = {x: coming[x].fillna(0.0).to_numpy(float) for x in names if x not in moving}
        out = np.zeros((len(coming), 2))
        for i in range(len(coming)):
            if restart and i and i % restart == 0:
                state.restart()
            row = {x: state.feature(x) for x in moving} | {x: v[i] for x, v in fixed.items()}
            score = {t: w.get("", 0.0) + sum(v * row[x] for x, v in w.items() if x and row[x] == row[x]) for t, w in plain.items()}
            level = {t: levels[t][n + i] for t in keyed.TARGETS}
            revenue = back(score["revenue"], level["revenue"], transform)
            second = revenue * min(max(score["cogs"], 0.0), 2.0) if cogs == "ratio" else back(score["cogs"], level["cogs"], transform)
            out[i] = revenue, second
            state.add(revenue, second)
        return coming[[*keys, day]].assign(revenue=out[:, 0], cogs=out[:, 1])

    kinds = ", ".join(f"`{c}` {t}" for c, t in history.select(*keys, day).dtypes)
    return both.groupBy(*keys).applyInPandas(each, f"{kinds}, revenue double, cogs double")


def back(score: float, level: float, transform: str) -> float:
    """M02's inverse for one value."""
    if transform == "residual":
        score += level
    if transform.startswith("log"):
        score = float(np.expm1(score + (np.log1p(max(level, 0.0)) if transform == "log_residual" else 0.0)))
    return max(score, 0.0)
