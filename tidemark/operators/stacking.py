"""Weights of several models' forecasts, learnt from forecasts of days that the models have not seen."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import keyed


def gram(rows: DataFrame, members: Sequence[str], actual: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of the members with one another and with the actual values, from one aggregate; rows with a null are left out."""
    columns, k = [*members, actual], len(members)
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    whole = rows.dropna(subset=columns)
    sums = whole.agg(*[F.coalesce(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])), F.lit(0.0)) for i, j in pairs]).head()
    xx, xy = np.zeros((k, k)), np.zeros(k)
    for (i, j), s in zip(pairs, sums, strict=True):
        if j == k:
            xy[i] = s
        else:
            xx[i, j] = xx[j, i] = s
    return xx, xy


def nonnegative(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares with weights of zero and more: members join one at a time, the one with the steepest way down first, and
    leave when their weight would fall below zero, until none that is out would help."""
    k, size = len(xy), float(np.abs(np.diag(xx)).max(initial=0.0))
    w, held = np.zeros(k), np.zeros(k, bool)
    for _ in range(10 * k + 10):
        slope = xy - xx @ w
        slope[held] = -np.inf
        if held.all() or slope.max() <= 1e-10 * max(size, 1e-300):
            break
        held[int(slope.argmax())] = True
        while True:
            full = np.zeros(k)
            full[held] = np.linalg.lstsq(xx[np.ix_(held, held)], xy[held], rcond=None)[0]
            low = held & (full <= 0)
            if not low.any():
                w = full
                break
            part = min(1.0, float((w[low] / np.maximum(w[low] - full[low], 1e-300)).min()))  # as far as the first weight allows
            w = w + part * (full - w)
            held &= w > 1e-12 * max(float(w.max()), 1e-300)
            w[~held] = 0.0
    return w


def stacked(rows: DataFrame, members: Sequence[str], actual: str) -> dict[str, float]:
    """Each member's share, summing to one; equal shares where all weights are zero."""
    w = nonnegative(*gram(rows, members, actual))
    w = w / w.sum() if w.sum() > 0 else np.full(len(members), 1 / len(members))
    return dict(zip(members, w.tolist(), strict=True))


def stack_weights(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """M16 for forecasts in rows (by, model, revenue, cogs, predicted_revenue, predicted_cogs): target, model and weight."""
    names = sorted(r[0] for r in forecasts.select("model").distinct().collect())  # models, not rows
    out = []
    for t in keyed.TARGETS:
        wide = forecasts.groupBy(*by).pivot("model", names).agg(F.first(f"predicted_{t}"))
        wide = keyed.on(by, wide, forecasts.groupBy(*by).agg(F.first(t).alias("__actual")))
        out += [(t, m, w) for m, w in stacked(wide, names, "__actual").items()]
    return forecasts.sparkSession.createDataFrame(out, "target string, model string, weight double")


def compared(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each model's errors and those of the weighted blend and of the stack, and their rank by total mae; ties go by name.

    forecasts: by (with fold), model, actual values and forecasts, as in stack_weights."""
    score = lambda rows: [keyed.metrics(rows, ("fold", "model"), t, f"predicted_{t}").withColumn("target", F.lit(t)) for t in keyed.TARGETS]
    single = score(forecasts)
    weights = keyed.inverse_error_weights(single[0].unionByName(single[1]).groupBy("fold", "model").agg(F.sum("mae").alias("mae")))
    shares = stack_weights(forecasts, by)
    actual = forecasts.groupBy(*by).agg(*[F.first(t).alias(t) for t in keyed.TARGETS])

    def put_together(name: str, weight_of: dict[str, DataFrame]) -> DataFrame:
        rows = actual
        for t in keyed.TARGETS:
            part = forecasts.join(F.broadcast(weight_of[t]), "model").groupBy(*by).agg((F.sum(F.col(f"predicted_{t}") * F.col("weight")) / F.sum("weight")).alias(f"predicted_{t}"))
            rows = keyed.on(by, rows, part)
        return rows.withColumn("model", F.lit(name))

    every = [forecasts.select(*by, "model", *keyed.TARGETS, *[f"predicted_{t}" for t in keyed.TARGETS])]
    every.append(put_together("ensemble", {t: weights for t in keyed.TARGETS}))
    every.append(put_together("stacked", {t: shares.filter(F.col("target") == t).select("model", "weight") for t in keyed.TARGETS}))
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    mae = score(rows)
    total = mae[0].unionByName(mae[1]).groupBy("model", "target").agg(F.avg("mae").alias("mae")).groupBy("model").pivot("target", list(keyed.TARGETS)).agg(F.first("mae"))
    total = total.select("model", F.col("revenue").alias("mae_revenue"), F.col("cogs").alias("mae_cogs"), (F.col("revenue") + F.col("cogs")).alias("total_mae"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("total_mae", "model")))
