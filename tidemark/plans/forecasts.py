"""Fitted forecasts of one daily series a region, as queries. They are iterative or random, so their tests are written apart in place of SQL."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import keyed
from tidemark.operators import importance, models, recursive, stacking, trend
from tidemark.plans import regional
from tidemark.plans.regional import DAY, KEYS, rounded, series
from tidemark.sources import retail, shared

HORIZON, RESTART = 548, 90
FOLDS = {"n_folds": 2, "horizon": 365, "train": 1096, "purge": 7}
BOOSTED = models.Settings(kind="gbt", rounds=12, depth=3, step=0.2)
LINEAR = models.Settings(kind="linear", ridge=1.0)
SEQUENTIAL = models.Settings(kind="gbt", rounds=8, depth=3, step=0.2, transform="log_residual", cogs="ratio", sequential=True)
NEXT_DAY = [*models.CALENDAR, *models.MOVING, "revenue_baseline", "cogs_baseline"]


def scaffold(s: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The days after each series' last one."""
    last = s.groupBy(*KEYS).agg(F.max(DAY).alias("z"))
    return last.select(*KEYS, F.explode(F.sequence(F.date_add("z", 1), F.date_add("z", horizon))).alias(DAY))


def dated(rows: DataFrame, history: DataFrame) -> DataFrame:
    return keyed.profiled(keyed.calendar(rows), history, KEYS)


def recursive_forecast(s: DataFrame, horizon: int = HORIZON, transform: str = "identity", cogs: str = "absolute", restart: int | None = RESTART) -> DataFrame:
    """A linear model of lags, windows and dates over all series, then each series day by day."""
    past = keyed.features(s, KEYS)
    model = models.fit(past.filter("lag_28d_revenue is not null"), NEXT_DAY, models.replace(LINEAR, transform=transform, cogs=cogs))
    return recursive.forecast(past, dated(scaffold(s, horizon), s), model.weights(s.sparkSession), KEYS, DAY, transform, cogs, restart)


def naive_rows(s: DataFrame) -> DataFrame:
    """The naive and the mean forecast of the folds' test days, in the columns of models.validated and with the model's name."""
    return regional.naive_scores(s).select("fold", *KEYS, DAY, *keyed.TARGETS, "predicted_revenue", "predicted_cogs", "model")


def boosted_folds(s: DataFrame, settings: models.Settings = BOOSTED) -> DataFrame:
    """Errors by fold of fitted models beside those of the naive ones, and the trees kept."""
    rows, kept = models.validated(s, KEYS, settings, day=DAY, **FOLDS)
    both = rows.withColumn("model", F.lit(settings.kind)).unionByName(naive_rows(s))
    trees = s.sparkSession.createDataFrame([(f, settings.kind, t, n) for f, own in enumerate(kept) for t, n in zip(keyed.TARGETS, own, strict=True)], "fold int, model string, target string, trees int")
    return models.errors(both, ["fold", "model"]).join(F.broadcast(trees), ["fold", "model", "target"], "left")


def members(s: DataFrame) -> DataFrame:
    """Forecasts of the folds' test days by a boosted, a linear, the naive and the mean model."""
    rows = naive_rows(s)
    for settings in (BOOSTED, LINEAR):
        rows = rows.unionByName(models.validated(s, KEYS, settings, day=DAY, **FOLDS)[0].withColumn("model", F.lit(settings.kind)))
    return rows


def spiked(s: DataFrame) -> DataFrame:
    """Direct forecasts with the chance of a spike, and what it makes of the revenue."""
    history = dated(s, s)
    stage = models.spikes(history, models.STATIC, KEYS)
    ahead = models.fit(history, models.STATIC, LINEAR).predict(dated(scaffold(s), s))
    plain = ahead.withColumnsRenamed({"predicted_revenue": "revenue", "predicted_cogs": "cogs"}).withColumn("plain_revenue", F.col("revenue"))
    return stage.apply(plain).select(*KEYS, DAY, "plain_revenue", "spike_probability", "spike_factor", "revenue", "cogs")


def kept_model(s: DataFrame) -> DataFrame:
    """The final model with the best fold's rounds, saved, loaded again, and forecasting; beside the forecast of the model before it was saved."""
    spark = s.sparkSession
    _, kept = models.validated(s, KEYS, BOOSTED, day=DAY, weighted=True, **FOLDS)
    model, path = models.final(s, KEYS, BOOSTED, kept, day=DAY, weighted=True), shared.folder(spark, "model")
    model.save(path, kept=[list(k) for k in kept])
    loaded, more = models.load(spark, path)
    before, after = (models.direct(m, s, scaffold(s), KEYS, DAY) for m in (model, loaded))
    both = keyed.on([*KEYS, DAY], after, before.withColumnsRenamed({"revenue": "revenue_before", "cogs": "cogs_before"}))
    return both.withColumn("metadata", F.lit(json.dumps({"rounds": loaded.settings.rounds, **more}, sort_keys=True)))


def importances(s: DataFrame, kind: str) -> DataFrame:
    """M23 to M25 of a model fitted on the first four fifths of the days."""
    train, valid = importance.last_part(dated(s, s), DAY)
    model = models.fit(train, models.STATIC, BOOSTED)
    gains = model.importance(s.sparkSession)
    if kind == "gain":
        return gains
    deals = importance.permuted(model, valid, [*KEYS, DAY], repeats=3)
    return deals if kind == "permutation" else importance.merged(gains, deals)


BUILD = {
    "M03": lambda s: trend.baseline(s, scaffold(s), KEYS),
    "M09": lambda s: models.direct(models.fit(dated(s, s), models.STATIC, BOOSTED), s, scaffold(s), KEYS, DAY),
    "M10": recursive_forecast,
    "M11": boosted_folds,
    "M12": partial(boosted_folds, settings=SEQUENTIAL),
    "M13": spiked,
    "M19": lambda s: trend.held_out(s, KEYS, DAY),
    "M16": lambda s: stacking.stack_weights(members(s), ["fold", *KEYS, DAY]),
    "M17": lambda s: models.validated(s, KEYS, models.replace(BOOSTED, rounds=6), day=DAY, weighted=True, **FOLDS)[0],
    "M20": lambda s: stacking.compared(members(s), ["fold", *KEYS, DAY]),
    "M21": kept_model,
    "M22": lambda s: models.searched(s, KEYS, models.Settings(kind="gbt"), models.candidates(models.SPACE, 3), day=DAY, **FOLDS),
    "M23": partial(importances, kind="gain"),
    "M24": partial(importances, kind="permutation"),
    "M25": partial(importances, kind="both"),
}
CHECK_M19 = ("select s.region, f.target, n_train, n_test, " + regional.rounds({"mae": "avg(abs(f.a - p.p))", "rmse": "sqrt(avg(power(f.a - p.p, 2)))", "r2": "case when var_pop(f.a) > 0 then 1 - avg(power(f.a - p.p, 2)) / var_pop(f.a) else 0 end"}) + """ from
 (select region, cast(floor(count(*) * 0.8) as bigint) as n_train, count(*) - cast(floor(count(*) * 0.8) as bigint) as n_test from s group by region) z
 join s on s.region = z.region and s.n > n_train cross join lateral (values ('revenue', s.revenue), ('cogs', s.cogs)) f(target, a)
 join s q on q.region = s.region and q.n = case when n_train >= 365 then n_train - 364 + (s.n - n_train - 1) % 365 else n_train end
 cross join lateral (select case f.target when 'revenue' then q.revenue else q.cogs end as p) p group by s.region, f.target, n_train, n_test""")  # fmt: skip


def queries():
    def on_series(make):
        return lambda spark, sf_dir: rounded(make(shared.written(series(spark, sf_dir), "series")))

    return {k: on_series(make) for k, make in BUILD.items()}


def oracle_sql():
    return {"M19": f"{retail.ctes(*regional.INPUTS)}{regional.REGIONAL} {CHECK_M19}"}
