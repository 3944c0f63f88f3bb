"""Fitted forecasts against loops, enumeration and known series."""

import datetime as dt
import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import keyed
from tidemark.operators import importance, models, recursive, stacking, trend

START = dt.date(2020, 1, 1)


def table(spark, series, first=START):
    """keys k; series: name -> [(revenue, cogs)] by day."""
    rows = [(k, first + dt.timedelta(i), float(r), float(c)) for k, v in series.items() for i, (r, c) in enumerate(v)]
    return spark.createDataFrame(rows, "k string, sales_date date, revenue double, cogs double")


def some(n=60, seed=0):
    rng = np.random.default_rng(seed)
    return {k: [(100 + 10 * math.sin(i / 5) + rng.normal(), 60 + rng.normal()) for i in range(n)] for k in ("a", "b", None)}


def by_hand(revenue, cogs, weights, steps, first, transform="identity", ratio=False, level=0.0):
    """The forecast from lists alone, each feature taken anew from all earlier days."""
    r, c, out = list(revenue), list(cogs), []

    def ema(v, span):
        a, m = 2 / (span + 1), None
        for x in v:
            m = x if m is None else a * x + (1 - a) * m
        return m

    def feature(name, day):
        if name == "day_of_week":
            return day.weekday()
        if name == "lag_1d_revenue":
            return r[-1]
        if name == "lag_7d_cogs":
            return c[-7]
        if name == "lag_365d_revenue":
            return 0.0  # none so far back
        if name == "roll_mean_7d_revenue":
            return statistics.fmean(r[-7:])
        if name == "roll_std_28d_cogs":
            return statistics.stdev(c[-28:])
        if name == "roll_mean_28d_cogs_ratio":
            return statistics.fmean(y / x for x, y in zip(r[-28:], c[-28:]) if x)
        if name == "trend_14d_revenue":
            return np.polyfit(range(14), r[-14:], 1)[0]
        if name == "ema_7d_revenue":
            return ema(r, 7)
        if name == "ema_28d_cogs":
            return ema(c, 28)
        if name == "ewm_vol_7d_revenue":
            return ema([(x - ema(r[: i + 1], 7)) ** 2 for i, x in enumerate(r)], 7)
        if name == "lag_1d_rev_wow_growth":
            return r[-1] / r[-8] - 1
        if name == "rev_mom_acceleration":
            return (r[-1] / r[-29] - 1) - (r[-2] / r[-30] - 1)
        if name == "revenue_diff_7d":
            return r[-1] - r[-7]
        raise AssertionError(name)

    for i in range(steps):
        day = first + dt.timedelta(i)
        score = {t: sum(w * (1.0 if f is None else feature(f, day)) for (u, f), w in weights.items() if u == t) for t in keyed.TARGETS}

        def back(s):
            if transform == "residual":
                s += level
            if transform.startswith("log"):
                s = math.expm1(s + (math.log1p(level) if transform == "log_residual" else 0.0))
            return max(0.0, s)

        x = back(score["revenue"])
        y = x * min(2.0, max(0.0, score["cogs"])) if ratio else back(score["cogs"])
        r.append(x)
        c.append(y)
        out.append((x, y))
    return out


WEIGHTS = {
    ("revenue", None): 5.0, ("revenue", "lag_1d_revenue"): 0.3, ("revenue", "roll_mean_7d_revenue"): 0.5, ("revenue", "trend_14d_revenue"): 0.4, ("revenue", "day_of_week"): -1.0, ("revenue", "ewm_vol_7d_revenue"): 0.01,
    ("revenue", "lag_1d_rev_wow_growth"): 2.0, ("revenue", "lag_365d_revenue"): 9.0, ("cogs", None): -2.0, ("cogs", "lag_7d_cogs"): 0.5, ("cogs", "roll_std_28d_cogs"): 0.7, ("cogs", "roll_mean_28d_cogs_ratio"): 3.0, ("cogs", "ema_7d_revenue"): 0.1,
    ("cogs", "ema_28d_cogs"): 0.2, ("cogs", "rev_mom_acceleration"): 1.0, ("cogs", "revenue_diff_7d"): -0.1,
}


@pytest.mark.parametrize("transform, ratio, scale", [("identity", False, 1), ("identity", True, 0.01), ("log", True, 0.001), ("residual", False, 0.5), ("log_residual", True, 0.002)])
@pytest.mark.parametrize("restart", [None, 4])
def test_recursive_equals_a_loop(spark, transform, ratio, scale, restart):
    data, steps = some(), 20
    history = table(spark, data)
    future = keyed.calendar(history.select("k").distinct().select("k", F.explode(F.sequence(F.lit(START + dt.timedelta(60)), F.lit(START + dt.timedelta(79)))).alias("sales_date")))
    weights = {k: w if transform == "log" and not k[1] else w * scale for k, w in WEIGHTS.items() if transform != "log" or k[1] != "ewm_vol_7d_revenue"}
    own = spark.createDataFrame([(t, f, w) for (t, f), w in weights.items()], "target string, feature string, weight double")
    future = future.withColumns({"revenue_baseline": F.lit(7.0), "cogs_baseline": F.lit(7.0)})
    got = recursive.forecast(history, future, own, ["k"], transform=transform, cogs="ratio" if ratio else "absolute", restart=restart).collect()
    assert len(got) == 3 * steps
    for k, v in data.items():
        want = by_hand([r for r, _ in v], [c for _, c in v], weights, steps, START + dt.timedelta(60), transform, ratio, 7.0)
        mine = [(r.revenue, r.cogs) for r in sorted((r for r in got if r.k == k), key=lambda r: r.sales_date)]
        assert np.allclose(mine, want, rtol=1e-9) and min(map(min, mine)) >= 0


def test_recursive_features_are_those_of_training(spark):
    """The state's next-day features equal the windows' features of that day."""
    data = {"a": [(50 + (i * 37) % 91, 20 + (i * 17) % 31) for i in range(420)]}
    names = [f"lag_{k}d_revenue" for k in keyed.REVENUE_LAGS if k < 700] + [c for c in models.MOVING if "residual" not in c] + ["cogs_ratio_trend_28d", "roll_std_365d_revenue", "rev_yoy_acceleration", "lag_1d_rev_mom_growth", "ewm_vol_7d_revenue", "lag_1d_cogs_ratio", "cogs_diff_7d"]
    row = keyed.features(table(spark, data), ["k"]).orderBy(F.desc("sales_date")).first()
    state = recursive.State(*(np.array(x, float) for x in zip(*data["a"][:-1])), {})
    for n in names:
        assert state.feature(n) == pytest.approx(row[n], rel=1e-9, nan_ok=False), n


def test_recursive_edges(spark):
    own = spark.createDataFrame([("revenue", None, -5.0), ("cogs", "lag_1d_cogs", 1.0)], "target string, feature string, weight double")
    history = table(spark, {"a": [(1, 2)]})
    future = spark.createDataFrame([("a", START + dt.timedelta(1)), ("b", START)], "k string, sales_date date")
    assert [(r.k, r.revenue, r.cogs) for r in recursive.forecast(history, future, own, ["k"]).collect()] == [("a", 0.0, 2.0)]
    assert recursive.forecast(history.limit(0), future, own, ["k"]).count() == recursive.forecast(history, future.limit(0), own, ["k"]).count() == 0
    alone = recursive.forecast(history.drop("k"), future.filter("k = 'a'").drop("k"), own)
    assert [(r.revenue, r.cogs) for r in alone.collect()] == [(0.0, 2.0)]
    with pytest.raises(ValueError):
        recursive.forecast(history, future, own, ["k"], transform="square")


def test_nonnegative_least_squares():
    """Against the best of all sets of members that may be above zero."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        k = int(rng.integers(1, 5))
        x, y = rng.normal(size=(12, k)) + rng.choice([0, 1]), rng.normal(size=12)
        if rng.random() < 0.2:
            x[:, -1] = x[:, 0]
        best = float(y @ y)
        for n in range(1, k + 1):
            for held in map(list, itertools.combinations(range(k), n)):
                w = np.linalg.lstsq(x[:, held], y, rcond=None)[0]
                if (w >= -1e-9).all():
                    best = min(best, float(((x[:, held] @ w - y) ** 2).sum()))
        w = stacking.nonnegative(x.T @ x, x.T @ y)
        assert (w >= 0).all() and float(((x @ w - y) ** 2).sum()) == pytest.approx(best, abs=1e-8)


def test_stack_weights(spark):
    rows = [(i, m, 10.0 + i, -5.0, p * (10.0 + i), p) for i in range(20) for m, p in (("half", 0.5), ("double", 2.0))]
    df = spark.createDataFrame(rows, "day int, model string, revenue double, cogs double, predicted_revenue double, predicted_cogs double")
    got = {(r.target, r.model): r.weight for r in stacking.stack_weights(df, ["day"]).collect()}
    assert sum(got["revenue", m] for m in ("half", "double")) == pytest.approx(1.0) and min(got.values()) >= 0
    assert got["cogs", "half"] == got["cogs", "double"] == 0.5  # nothing helps: equal shares
    table_ = {r.model: r for r in stacking.compared(df.withColumn("fold", F.lit(0)), ["fold", "day"]).collect()}
    assert set(table_) == {"half", "double", "ensemble", "stacked"} and sorted(r["rank"] for r in table_.values()) == [1, 2, 3, 4]
    assert min(table_.values(), key=lambda r: r["rank"]).total_mae == min(r.total_mae for r in table_.values())


def waves(n, key_step=0.0):
    return [(500 + key_step + 0.2 * i + 80 * math.sin(2 * math.pi * i / 365.25) + 30 * math.cos(2 * math.pi * i / 7), 200 + 10 * math.sin(2 * math.pi * i / 7)) for i in range(n)]


@pytest.mark.parametrize("log", [False, True])
def test_trend_recovers_a_known_series(spark, log):
    n, ahead = 1200, 100
    full = {"a": waves(n + ahead), "b": waves(n + ahead, 300.0)}
    if log:
        full = {k: [(math.expm1(r / 200), math.expm1(c / 200)) for r, c in v] for k, v in full.items()}
    every = table(spark, full)
    cut = START + dt.timedelta(n)
    got = trend.baseline(every.filter(F.col("sales_date") < cut), every.filter(F.col("sales_date") >= cut).select("k", "sales_date"), ["k"], log=log)
    both = got.join(every, ["k", "sales_date"]).collect()
    assert len(both) == 2 * (n + ahead)
    scale = (lambda v: 200 * math.log1p(v)) if log else (lambda v: v)
    for r in both:
        mine = r.trend_revenue_baseline * (200 if log else 1)
        assert mine == pytest.approx(scale(r.revenue), abs=2.0)
        assert (r.trend_revenue_residual is None) == (r.sales_date >= cut)


def test_models_and_artefact(spark, tmp_path):
    series = table(spark, {"a": waves(500), "b": waves(500, 200.0)})
    folds = {"n_folds": 2, "horizon": 60, "train": 300, "purge": 7}
    settings = models.Settings(kind="gbt", rounds=5, depth=3, step=0.3, sequential=True, cogs="ratio")
    rows, kept = models.validated(series, ["k"], settings, features=["day_of_week", "day_of_year_sin", "day_of_year_cos", "overall_avg_revenue"], weighted=True, **folds)
    assert rows.count() == 240 and all(1 <= t <= 5 for pair in kept for t in pair)
    table_ = {(r.fold, r.target): r for r in models.errors(rows, ["fold"]).collect()}
    assert set(table_) == {(f, t) for f in (0, 1) for t in keyed.TARGETS} and all(r.mae < 100 for r in table_.values())
    assert rows.filter("predicted_revenue < 0 or predicted_cogs < 0 or predicted_cogs > 2 * predicted_revenue + 1e-9").count() == 0
    model = models.final(series, ["k"], settings, kept, ["day_of_week", "day_of_month"])
    assert model.settings.rounds == max(t for pair in kept for t in pair)
    path = (tmp_path / "model").as_uri()
    for note in (1, 2):  # saved over
        model.save(path, note=note)
    loaded, more = models.load(spark, path)
    assert more == {"note": 2} and loaded.settings == model.settings and loaded.features == model.features
    ahead = series.select("k", F.date_add("sales_date", 500).alias("sales_date"))
    one, two = ({(r.k, r.sales_date): (r.revenue, r.cogs) for r in models.direct(m, series, ahead, ["k"]).collect()} for m in (model, loaded))
    assert one == two and len(one) == 1000


def test_linear_weights_forecast_like_the_model(spark):
    past = keyed.features(table(spark, some(90, 3)), ["k"])
    model = models.fit(past.filter("lag_28d_revenue is not null"), ["lag_1d_revenue", "day_of_week", "roll_mean_7d_cogs"], models.Settings(kind="linear"))
    w = {(r.target, r.feature): r.weight for r in model.weights(spark).collect()}
    for r in model.predict(past.filter("lag_28d_revenue is not null")).limit(20).collect():
        want = w["revenue", None] + sum(w["revenue", f] * r[f] for f in ("lag_1d_revenue", "day_of_week", "roll_mean_7d_cogs"))
        assert r.predicted_revenue == pytest.approx(max(0.0, want), rel=1e-9)


def test_permutation_importance(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), float(rng.normal()), 0.0, 0.0) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, 100 + 10 * a, 50 + 5 * a) for i, a, b, _, _ in rows], "id int, used double, useless double, revenue double, cogs double")
    model = models.fit(df, ["used", "useless"], models.Settings(kind="linear", ridge=0.0))
    got = {r.feature: r for r in importance.permuted(model, df, ["id"], repeats=3).collect()}
    assert abs(got["useless"].perm_importance) < 1e-6 and got["used"].perm_importance > 10 and got["used"].tier.startswith("TIER 1")
    gains = spark.createDataFrame([("used", 1.0, 100.0, "x"), ("other", 0.0, 0.0, "y")], "feature string, gain double, gain_pct double, tier string")
    both = {r.feature: r for r in importance.merged(gains, spark.createDataFrame(list(got.values()))).collect()}
    assert set(both) == {"used", "useless", "other"} and both["used"]["rank"] == 1 and both["other"].perm_importance is None


def test_a_shuffle_keeps_all_values(spark):
    """A model that returns its feature: sums over rows do not change when values are dealt anew, so only their places do."""
    df = spark.createDataFrame([(i, float(i % 7), float(i), 0.0) for i in range(50)], "id int, x double, revenue double, cogs double")
    model = models.fit(df.withColumn("revenue", F.col("x")), ["x"], models.Settings(kind="linear", ridge=0.0))
    (r,) = importance.permuted(model, df.withColumn("revenue", F.lit(0.0)), ["id"], repeats=2).collect()
    assert r.perm_importance == pytest.approx(0.0, abs=1e-6) and r.perm_std == pytest.approx(0.0, abs=1e-6)


def test_spikes(spark):
    rows = [("a", i, 1000.0 if i % 10 == 0 else 100.0, 50.0, float(i % 10 == 0)) for i in range(200)] + [("flat", i, 7.0, 1.0, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i int, revenue double, cogs double, flag double")
    stage = models.spikes(df, ["flag"], ["k"], quantile=0.89)
    for r in stage.apply(df.withColumns({"was": F.col("revenue"), "was_cogs": F.col("cogs")}), ratio=True).collect():
        assert 1.0 <= r.spike_factor <= 1.3 and r.revenue == pytest.approx(r.was * r.spike_factor) and r.cogs == pytest.approx(r.was_cogs * r.spike_factor)
        assert r.k == "a" or r.spike_factor == 1.0
        if r.flag:
            assert r.spike_factor == pytest.approx(1.3) and r.spike_probability > 0.8


def test_search(spark):
    series = table(spark, {"a": waves(200)})
    drawn = [{"rounds": 1, "depth": 1}, {"rounds": 6, "depth": 3}, {"rounds": 1, "depth": 1}]
    got = models.searched(series, ["k"], models.Settings(step=0.5), drawn, features=["day_of_week", "day_of_month"], n_folds=1, horizon=30, train=120, purge=0).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and [r.total_mae for r in got] == sorted(r.total_mae for r in got)
    same = [r for r in got if r.candidate != 1]
    assert same[0].total_mae == same[1].total_mae and same[0].candidate == 0
    assert models.candidates(models.SPACE, 5, 1) == models.candidates(models.SPACE, 5, 1) != models.candidates(models.SPACE, 5, 2)


def test_feature_columns():
    columns = ["region", "sales_date", "revenue", "cogs", "cogs_ratio", "revenue_residual", "day_of_week", "lag_7d_cogs", "ema_7d_revenue", "revenue_baseline", "is_promo", "cogs_diff_7d"]
    assert models.feature_columns(columns) == ["day_of_week", "lag_7d_cogs", "ema_7d_revenue", "revenue_baseline", "is_promo", "cogs_diff_7d"]
    assert models.feature_columns(columns, direct=True) == ["day_of_week", "revenue_baseline"]
