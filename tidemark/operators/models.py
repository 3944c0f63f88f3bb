"""Fitted models of two targets: features and labels as DataFrames, fits as Spark ML jobs over all rows of all series."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import keyed

FIRST = "predicted_revenue_label"  # the revenue model's prediction as a feature of the cogs model
CALENDAR = [
    "day_of_week", "day_of_month", "days_to_month_end", "days_to_quarter_end", "days_since_anchor", "is_month_start_window", "is_month_end_window", "is_pay_day",
    *(f"{c}_{f}" for c in ("day_of_week", "day_of_year", "month") for f in ("sin", "cos")),
]
PROFILE = [f"{kind}_avg_{t}{cut}" for t in keyed.TARGETS for kind, cut in (("hist", "_dow"), ("hist", "_month"), ("hist", "_dom"), ("overall", ""))] + [f"{t}_baseline" for t in keyed.TARGETS]
STATIC = CALENDAR + PROFILE
MOVING = [
    *(f"lag_{k}d_revenue" for k in (1, 7, 14, 28)), "lag_1d_cogs", "lag_7d_cogs", *(f"roll_mean_{k}d_{t}" for k in (7, 28) for t in keyed.TARGETS), "roll_std_28d_revenue",
    "trend_28d_revenue", "ema_7d_revenue", "ema_28d_revenue", "lag_1d_rev_residual", "lag_7d_cogs_residual", "revenue_diff_7d",
]


def feature_columns(columns: Sequence[str], direct: bool = False) -> list[str]:
    """The columns that a model may see: not the keys, dates, targets and labels; a direct forecast sees only what dates give."""
    return [c for c in columns if c in STATIC or not direct and (c.startswith(("lag_", "roll_", "trend_", "ema_", "ewm_", "rev_", "promo_")) or c.endswith(("_diff_7d", "_trend_28d")) or c in ("is_promo",))]


@dataclass(frozen=True)
class Settings:
    """kind: gbt, forest or linear. rounds are boosting steps or trees; a sequential model gives the cogs model the revenue model's prediction."""

    kind: str = "gbt"
    rounds: int = 20
    depth: int = 3
    step: float = 0.1
    ridge: float = 0.01
    transform: str = "identity"
    cogs: str = "absolute"
    sequential: bool = False
    seed: int = 7

    def estimator(self, label: str):
        shared = {"featuresCol": "features", "labelCol": label, "predictionCol": label.replace("_label", "_prediction")}
        if self.kind == "gbt":
            return GBTRegressor(**shared, maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step, seed=self.seed)
        if self.kind == "forest":
            return RandomForestRegressor(**shared, numTrees=self.rounds, maxDepth=self.depth, seed=self.seed)
        if self.kind == "linear":
            return LinearRegression(**shared, regParam=self.ridge, maxIter=100)
        raise ValueError(f"kind must be gbt, forest or linear, not {self.kind}")


LOADERS = {"gbt": GBTRegressionModel, "forest": RandomForestRegressionModel, "linear": LinearRegressionModel}


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features as one vector; missing values count as zero."""
    filled = rows.withColumns({f"__{c}": F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="features").transform(filled).drop(*[f"__{c}" for c in features])


@dataclass(frozen=True)
class Dual:
    """A revenue and a cogs model over the same features."""

    settings: Settings
    features: list[str]
    revenue: MLWritable
    cogs: MLWritable

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with predicted_revenue and predicted_cogs, in the targets' own scale."""
        out = self.revenue.transform(assembled(rows, self.features)).drop("features")
        more = [*self.features, FIRST] if self.settings.sequential else self.features
        out = self.cogs.transform(assembled(out.withColumn(FIRST, F.col("revenue_prediction")), more)).drop("features", FIRST)
        return keyed.inverse(out, self.settings.transform, self.settings.cogs).drop("revenue_prediction", "cogs_prediction")

    def rounds(self) -> tuple[int | None, int | None]:
        """The trees that each model kept, fewer than asked for where the validation rows stopped it."""
        return tuple(getattr(m, "getNumTrees", None) for m in (self.revenue, self.cogs))

    def weights(self, spark: SparkSession) -> DataFrame:
        """target, feature and weight of linear models; a null feature has the intercept."""
        if self.settings.kind != "linear" or self.settings.sequential:
            raise ValueError("only linear models that do not follow one another have weights")
        rows = [(t, None, float(m.intercept)) for t, m in (("revenue", self.revenue), ("cogs", self.cogs))]
        rows += [(t, name, float(w)) for t, m in (("revenue", self.revenue), ("cogs", self.cogs)) for name, w in zip(self.features, m.coefficients, strict=True)]
        return spark.createDataFrame(rows, "target string, feature string, weight double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """Each feature's share of the splits' gain, averaged over both models, in percent, and its tier."""
        if self.settings.kind == "linear":
            raise ValueError("linear models have no split gains")
        n = len(self.features)
        rows = [(f, (float(self.revenue.featureImportances[i]) + float(self.cogs.featureImportances[i])) / 2) for i, f in enumerate(self.features)]
        gains = spark.createDataFrame(rows, "feature string, gain double") if n else spark.createDataFrame([], "feature string, gain double")
        share = F.round(100 * F.col("gain") / F.sum("gain").over(Window.partitionBy()), 4)
        return gains.withColumn("gain_pct", F.coalesce(share, F.lit(0.0))).withColumn("tier", tier("gain_pct"))

    def save(self, path: str, **metadata) -> None:
        """Both models and what is needed to use them, under a path that all executors reach; an existing one is replaced."""
        spark = SparkSession.getActiveSession()
        for name, m in (("revenue", self.revenue), ("cogs", self.cogs)):
            m.write().overwrite().save(f"{path}/{name}")
        meta = json.dumps({"settings": asdict(self.settings), "features": self.features, "more": metadata}, sort_keys=True)
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[Dual, dict]:
    """The saved models, and the metadata that was given."""
    meta = json.loads(spark.read.text(f"{path}/metadata").head()[0])
    settings = Settings(**meta["settings"])
    revenue, cogs = (LOADERS[settings.kind].load(f"{path}/{t}") for t in keyed.TARGETS)
    return Dual(settings, meta["features"], revenue, cogs), meta["more"]


def tier(percent: str):
    """Strong from 5 percent on, medium from 1."""
    return F.when(F.col(percent) >= 5, "TIER 1 -- STRONG").when(F.col(percent) >= 1, "TIER 2 -- MEDIUM").otherwise("TIER 3 -- WEAK")


def fit(train: DataFrame, features: Sequence[str], settings: Settings = Settings(), valid: DataFrame | None = None, weight: str | None = None) -> Dual:
    """Fit both models. With validation rows boosting stops where they get no better; rows without a label are left out."""
    rows = keyed.forward(train.withColumn("__valid", F.lit(False)) if valid is None else train.withColumn("__valid", F.lit(False)).unionByName(valid.withColumn("__valid", F.lit(True)), allowMissingColumns=True), settings.transform, settings.cogs)

    def one(label: str, data: DataFrame, columns: Sequence[str]):
        e = settings.estimator(label)
        if valid is not None and settings.kind == "gbt":
            e = e.setValidationIndicatorCol("__valid")
        else:
            data = data.filter(~F.col("__valid"))
        if weight:
            e = e.setWeightCol(weight)
            data = data.fillna(0.0, [weight])
        return e.fit(assembled(data.filter(F.col(label).isNotNull()), columns))

    rows = rows.cache()
    try:
        revenue = one("revenue_label", rows, features)
        if not settings.sequential:
            return Dual(settings, list(features), revenue, one("cogs_label", rows, features))
        followed = revenue.transform(assembled(rows, features)).withColumn(FIRST, F.col("revenue_prediction")).drop("features", "revenue_prediction")
        return Dual(settings, list(features), revenue, one("cogs_label", followed, [*features, FIRST]))
    finally:
        rows.unpersist()


# Validation over time


def fold_frames(series: DataFrame, keys: Sequence[str], day: str, fold: int, **folds) -> tuple[DataFrame, DataFrame]:
    """A fold's training and test rows with calendar, profiles and baselines; profiles come from the training rows alone."""
    rows = keyed.sliding_folds(series, keys, day, **folds).filter(F.col("fold") == fold)
    train, test = (rows.filter(F.col("role") == r).drop("role", "fold") for r in ("train", "test"))
    dated = lambda df: keyed.profiled(keyed.calendar(df, day), train, keys, day)
    return dated(train), dated(test)


def validated(
    series: DataFrame, keys: Sequence[str] = (), settings: Settings = Settings(), features: Sequence[str] = tuple(STATIC), day: str = "sales_date", weighted: bool = False, n_folds: int = 2, **folds
) -> tuple[DataFrame, list[tuple[int | None, int | None]]]:
    """For each fold fit on its training rows, stopped by its test rows, and forecast these directly.

    Gives fold, keys, day, actual values and forecasts, and the trees kept in each fold; folds are few, each fit is one over all executors."""
    out, kept = [], []
    for fold in range(n_folds):
        train, test = fold_frames(series, keys, day, fold, folds=n_folds, **folds)
        if weighted:
            train = keyed.recency_weights(train, keys, day)
        model = fit(train, features, settings, test, "weight" if weighted else None)
        kept.append(model.rounds())
        out.append(model.predict(test).select(F.lit(fold).alias("fold"), *keys, day, *keyed.TARGETS, *[f"predicted_{t}" for t in keyed.TARGETS]))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows, kept


def errors(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """M05 of both targets in rows of validated()."""
    parts = [keyed.metrics(rows, by, t, f"predicted_{t}").withColumn("target", F.lit(t)) for t in keyed.TARGETS]
    return parts[0].unionByName(parts[1])


def final(series: DataFrame, keys: Sequence[str], settings: Settings, kept: Sequence[tuple[int | None, int | None]] = (), features: Sequence[str] = tuple(STATIC), day: str = "sales_date", weighted: bool = False) -> Dual:
    """Fit on all of the history, with as many rounds as the best fold kept."""
    best = [k for pair in kept for k in pair if k]
    train = keyed.profiled(keyed.calendar(series, day), series, keys, day)
    train = keyed.recency_weights(train, keys, day) if weighted else train
    return fit(train, features, replace(settings, rounds=max(best)) if best else settings, weight="weight" if weighted else None)


def direct(model: Dual, history: DataFrame, scaffold: DataFrame, keys: Sequence[str] = (), day: str = "sales_date") -> DataFrame:
    """Forecast all days of the scaffold at once, from what the dates and the history's profiles give.

    Other features of the model come from the scaffold where it has them; else each series' last value goes on."""
    rows = keyed.profiled(keyed.calendar(scaffold, day), history, keys, day)
    missing = [c for c in model.features if c not in rows.columns]
    if missing:
        last = history.groupBy(*keys).agg(*[F.max_by(c, day).alias(c) for c in missing])
        rows = keyed.on(keys, rows, last, "left")
    return model.predict(rows).select(*keys, day, F.col("predicted_revenue").alias("revenue"), F.col("predicted_cogs").alias("cogs"))


def candidates(space: dict[str, Callable[[random.Random], object]], n: int, seed: int = 42) -> list[dict]:
    """N settings drawn from a space of functions of a generator, the same for the same seed."""
    r = random.Random(seed)
    return [{name: draw(r) for name, draw in sorted(space.items())} for _ in range(n)]


SPACE: dict[str, Callable[[random.Random], object]] = {"step": lambda r: round(10 ** r.uniform(-2, -0.5), 4), "depth": lambda r: r.randint(2, 4), "rounds": lambda r: r.choice([5, 10, 15])}


def searched(series: DataFrame, keys: Sequence[str] = (), base: Settings = Settings(), drawn: Sequence[dict] | None = None, **validation) -> DataFrame:
    """Candidate, settings, mean over folds of both targets' summed mae, and rank; the first of equal candidates goes before the others."""
    drawn = candidates(SPACE, 4) if drawn is None else drawn
    spark, rows = series.sparkSession, None
    for i, chosen in enumerate(drawn):
        tried, _ = validated(series, keys, replace(base, **chosen), **validation)
        own = errors(tried, ["fold"]).groupBy("fold").agg(F.sum("mae").alias("mae")).agg(F.avg("mae").alias("total_mae")).withColumn("candidate", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    names = spark.createDataFrame([(i, json.dumps(c, sort_keys=True)) for i, c in enumerate(drawn)], "candidate int, settings string")
    order = Window.partitionBy().orderBy(F.col("total_mae").asc_nulls_last(), "candidate")
    return names.join(rows, "candidate").withColumn("rank", F.row_number().over(order))


# Spikes


@dataclass(frozen=True)
class Spikes:
    """Days above a quantile of their series' revenue, the chance of one from features, and what spikes come to against other days."""

    features: list[str]
    model: LogisticRegressionModel
    boosts: DataFrame
    keys: tuple[str, ...]
    alpha: float = 0.6
    most: float = 1.3

    def apply(self, forecasts: DataFrame, ratio: bool = False) -> DataFrame:
        """Forecasts (revenue, cogs and the features) with revenue times 1 + p * alpha * (boost - 1), held within 1 and `most`; as a ratio, cogs go along."""
        p = self.model.transform(assembled(forecasts, self.features)).drop("features")
        p = p.withColumn("spike_probability", vector_to_array("__probability")[1]).drop("__raw", "__probability", "__spike")
        out = keyed.on(self.keys, p, self.boosts, "left")
        factor = F.least(F.greatest(1 + F.col("spike_probability") * self.alpha * (F.coalesce("boost", F.lit(1.0)) - 1), F.lit(1.0)), F.lit(self.most))
        out = out.withColumn("spike_factor", factor).drop("boost")
        targets = keyed.TARGETS if ratio else keyed.TARGETS[:1]
        return out.withColumns({t: F.col(t) * F.col("spike_factor") for t in targets})


def spikes(train: DataFrame, features: Sequence[str], keys: Sequence[str] = (), quantile: float = 0.9, ridge: float = 0.01) -> Spikes:
    """Fit M13: a logistic model with each class weighted by the other one's size; a series whose days are alike has no spikes and boost 1."""
    limits = train.groupBy(*keys).agg(F.percentile("revenue", quantile).alias("limit"))
    rows = keyed.on(keys, train, limits).withColumn("__label", (F.col("revenue") > F.col("limit")).cast("double")).filter("__label is not null")
    mean = lambda on: F.avg(F.when(F.col("__label") == on, F.col("revenue")))
    boosts = rows.groupBy(*keys).agg(F.coalesce(F.try_divide(mean(1.0), mean(0.0)), F.lit(1.0)).alias("boost"))
    count = rows.agg(F.sum("__label").alias("spikes"), F.count("*").alias("n")).head()
    scale = (count["n"] - count["spikes"]) / count["spikes"] if count["spikes"] else 1.0
    weighed = rows.withColumn("__weight", F.when(F.col("__label") == 1.0, scale).otherwise(1.0))
    model = LogisticRegression(featuresCol="features", labelCol="__label", weightCol="__weight", regParam=ridge, predictionCol="__spike", rawPredictionCol="__raw", probabilityCol="__probability").fit(assembled(weighed, features))
    return Spikes(list(features), model, boosts, tuple(keys))
