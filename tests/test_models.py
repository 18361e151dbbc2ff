import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom.operators import models, panel

LAGS = [1, 7]


def _panel(spark, keys, days=24):
    rows = spark.range(keys).select(
        F.concat(F.lit("store"), "id").alias("entity"), "id",
        F.explode(F.sequence(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 1, 1) + dt.timedelta(days=days - 1)))).alias("ds"),
    )
    return rows.select("entity", "ds", (F.col("id") % 50 + F.dayofweek("ds")).cast("double").alias("y"))


@pytest.mark.parametrize("keys", [25, 5000])
def test_panels_of_any_number_of_keys_are_fitted_and_forecast(spark, keys):
    df = _panel(spark, keys, 12)
    train, test = df.filter("ds < '2024-01-10'"), df.filter("ds >= '2024-01-10'")
    frame = models.training_frame(train, "entity", "ds", "y", LAGS)
    model = models.fit_global(frame, "y", [*models.CALENDAR, *models.lag_names(LAGS)], ["entity"], maxIter=2, maxDepth=3)
    assert model.inputs[-2:] == ["entity_mean", "entity_rows"]
    lost = "store3"  # a key without history stays, from missing lags
    out = models.forecast(train.filter(F.col("entity") != lost), test, ["entity"], "ds", "y", [model], LAGS, 3, ["entity"])
    got = out.groupBy("entity").agg(F.count("yhat").alias("n"))
    assert got.count() == keys and got.filter("n <> 3").count() == 0
    plan = frame._jdf.queryExecution().toString()
    assert "StringIndexer" not in plan


def test_families_survive_saving(spark, tmp_path):
    df = _panel(spark, 5)
    family = models.fit_direct(df, "entity", "ds", "y", LAGS, 2, ["entity"], maxIter=2, maxDepth=2)
    models.save_family(family, str(tmp_path / "f"))
    again = models.load_family(spark, str(tmp_path / "f"), 2)
    frame = models.training_frame(df, "entity", "ds", "y", LAGS)
    score = lambda m: sorted((r["entity"], r["ds"], r["yhat"]) for r in models.score(m, frame, ["entity"]).collect())
    assert score(family[0]) == score(again[0])
    unseen = frame.limit(1).withColumn("entity", F.lit("never seen"))
    row = again[0].encode(unseen, ["entity"]).first()
    assert row["entity_rows"] == 0 and abs(row["entity_mean"] - again[0].overall) < 1e-9


def test_gap_free_panel_keeps_its_tail(spark):
    held = panel.holdout_tail(_panel(spark, 3), "entity", "ds", 5)
    assert held.filter("rel > 0").count() == 15


def _plain_forecast(past, ahead, rules, horizon):
    """Rule by rule, day by day."""
    out = {}
    for key, days in ahead.items():
        known = dict(past.get(key, {}))
        for h, day in enumerate(sorted(days)[:horizon]):
            lags, weights, shift = rules[h % len(rules)]
            pairs = [(known.get(day - dt.timedelta(days=k + shift)), w) for k, w in zip(lags, weights)]
            pairs = [(v, w) for v, w in pairs if v is not None]
            known[day] = sum(v * w for v, w in pairs) / sum(w for _, w in pairs) if pairs else 5.0
            out[key, day] = (known[day], h + 1)
    return out


@pytest.mark.parametrize("n", [1, 3])
def test_forecasts_by_rules_equal_the_walk(spark, n):
    day0 = dt.date(2024, 2, 20)
    past = {k: {day0 - dt.timedelta(days=d): float((d * k) % 11) for d in range(1, 15) if (d + k) % 4} for k in range(1, 5)}
    ahead = {k: [day0 + dt.timedelta(days=d) for d in range(12) if (d * k) % 5 != 3] for k in range(0, 5)}  # key 0 has no past
    rules = [([1, 2, 7], [1.0, 2.0, 3.0], i) for i in range(n)]
    family = [models.shifted(models.lag_mean(a, w, 5.0), i) for a, w, i in rules]
    buffer = spark.createDataFrame([(k, d, v) for k, x in past.items() for d, v in x.items()], "k long, ds date, y double")
    test = spark.createDataFrame([(k, d, 1.0) for k, x in ahead.items() for d in x], "k long, ds date, y double")
    got = models.forecast_with(buffer, test, ["k"], "ds", "y", family, 8).collect()
    want = _plain_forecast(past, ahead, rules, 8)
    assert {(r["k"], r["ds"]): (pytest.approx(r["yhat"]), r["relative_horizon"]) for r in got} == want


def test_least_squares_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [1.5, -2.0, 0.25] + 4 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    model = models.fit_linear(df, "y", ["a", "b", "c"])
    want = np.linalg.lstsq(np.column_stack([x, np.ones(200)]), y, rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], want)
    scored = models.score_linear(model, df, ["a", "b", "c"]).collect()
    assert np.allclose([r["yhat"] for r in scored], np.column_stack([x, np.ones(200)]) @ want)


def test_pruning_training_rows_changes_no_forecast(spark):
    from trendloom.operators import backtest

    held = panel.holdout_tail(_panel(spark, 3, 40), "entity", "ds", 12)
    rule = models.lag_mean([1, 7], [1.0, 1.0])
    run = lambda past, ahead, keys: models.forecast_with(panel.tail(past, keys, "ds", 9), ahead, keys, "ds", "y", [rule], 6)
    whole = backtest.rolling_forecast(held, "entity", 6, [0, 3], run)
    cut = backtest.rolling_forecast(held, "entity", 6, [0, 3], run, lambda t: panel.tail(t, "entity", "ds", 9))
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_settings_depend_on_seed_trial_and_name_alone():
    space = {"a": models.Choice(1, 9, "int", 2), "b": models.Choice(0.01, 1.0, "log"), "c": models.Choice(-1.0, 1.0)}
    some, more = models.settings(space, 5, 3), models.settings(dict(reversed(space.items())), 300, 3)
    assert some == more[:5] and some != models.settings(space, 5, 4)
    assert {s["a"] for s in more} == {1, 3, 5, 7, 9}
    assert all(0.01 <= s["b"] <= 1 and -1 <= s["c"] <= 1 for s in more)
    assert abs(sum(s["b"] < 0.1 for s in more) - 150) < 45  # even by logarithm


@pytest.mark.parametrize("workers", [1, 5])
def test_search_finds_the_setting_that_fits_all_folds(spark, workers):
    """A setting is a constant forecast: the best one is nearest to the validation values; a good start alone does not win."""
    rows = [(b, float(y)) for b, ys in enumerate(([1, 2], [10, 10], [2, 2], [2, 2])) for y in ys]
    blocked = spark.createDataFrame(rows, "block long, y double")
    seen = []

    def fit(train, c):
        seen.append((c, train.count()))
        return c

    predict = lambda c, valid: valid.withColumn("yhat", F.lit(float(c)))
    chosen = [{"c": c} for c in (10.0, 4.0, 9.0, 2.0, 30.0, 40.0, 5.0, 50.0)]
    got = models.search(blocked, "y", chosen, 3, fit, predict, keep=0.5, workers=workers).orderBy("setting").collect()
    assert [r["folds"] for r in got] == [2, 3, 2, 1, 1, 1, 3, 1]
    means = [sum((c["c"] - v) ** 2 for v in (10, 2, 2)[: r["folds"]]) / r["folds"] for c, r in zip(chosen, got)]
    assert [r["mse"] for r in got] == pytest.approx(means)
    whole = [r["setting"] for r in got if r["folds"] == 3]
    assert [r["setting"] for r in got if r["best"]] == [min(whole, key=lambda n: means[n])]
    assert {n for _, n in seen} == {2, 4, 6}


def test_importance_of_all_columns_equals_the_plain_one(spark):
    import random

    from trendloom.functions import hashing

    rng = random.Random(2)
    rows = [(k, rng.random(), None if k % 9 == 0 else rng.random(), float(k % 4)) for k in range(150)]
    rows = [(*r, 3 * r[1] + rng.random()) for r in rows]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, y double").repartition(4)
    rule = F.col("a") * 3 + F.coalesce("b", F.lit(0.5)) + F.col("c") * 0
    got = models.permutation_importance(df, "key", "y", ["a", "b", "c"], lambda d: d.withColumn("yhat", rule), 5)
    rise = {r["feature"]: r["rise"] for r in got.collect()}
    order = [r["key"] for r in df.select("key", hashing.draw("key", 5).alias("h")).orderBy("h", "key").collect()]
    score = lambda a, b: a * 3 + (0.5 if b is None else b)
    base = sum((score(r[1], r[2]) - r[4]) ** 2 for r in rows) / 150
    for name, spot in (("a", 1), ("b", 2), ("c", 3)):
        turn = models.rotation(name, 150, 5)
        new = {order[(i + turn) % 150]: rows[order[i]][spot] for i in range(150)}
        mixed = [[*r[:spot], new[r[0]], *r[spot + 1 :]] for r in rows]
        assert rise[name] == pytest.approx(sum((score(r[1], r[2]) - r[4]) ** 2 for r in mixed) / 150 - base)
    assert rise["c"] == 0 and rise["a"] > 0
    plan = got._jdf.queryExecution().toString()
    assert plan.count("rangepartitioning") == 0  # rows are ordered once, before


def test_direct_models_keep_their_order():
    import time

    def work(k):
        time.sleep(0.02 * (3 - k))
        return k

    assert models.in_parallel(work, range(4), 4) == [0, 1, 2, 3] and models.in_parallel(work, [], 4) == []
