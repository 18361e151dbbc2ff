import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import backtest, baseline, metrics, panel

D = dt.date


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, ds date, y double")


def days(entity, start, offsets, value=1.0):
    return [(entity, start + dt.timedelta(days=o), value) for o in offsets]


def test_gap_is_strictly_longer(spark):
    rows = days("a", D(2020, 1, 1), [0, 7, 15]) + days("b", D(2020, 1, 1), [0, 8, 16]) + days("c", D(2020, 1, 1), [0])
    counts = {r["entity"]: r["n_gaps"] for r in panel.gap_counts(frame(spark, rows), "entity", "ds", 7).collect()}
    assert counts == {"a": 1, "b": 2}
    kept = panel.drop_gappy(frame(spark, rows), "entity", "ds", 7).select("entity").distinct()
    assert {r[0] for r in kept.collect()} == {"a", "c"}


def test_drop_inactive_keeps_the_cutoff_day(spark):
    rows = days("a", D(2020, 1, 1), [0]) + days("b", D(2020, 1, 2), [0])
    kept = panel.drop_inactive(frame(spark, rows), "entity", "ds", "2020-01-02").collect()
    assert [r["entity"] for r in kept] == ["b"]


def test_lags_are_calendar_days(spark):
    rows = [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 2), 2.0), ("a", D(2020, 1, 4), 4.0), ("a", D(2020, 1, 8), 8.0)]
    out = panel.add_date_lags(frame(spark, rows), "entity", "ds", "y", [1, 7]).orderBy("ds").collect()
    assert [r["y_lag_1"] for r in out] == [None, 1.0, None, None]
    assert [r["y_lag_7"] for r in out] == [None, None, None, 1.0]


def test_lags_share_one_exchange(spark):
    plan = panel.add_date_lags(frame(spark, days("a", D(2020, 1, 1), range(9))), "entity", "ds", "y", [1, 2, 7, 14])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [2, 3, 4])
def test_holdout_needs_more_rows_than_n(spark, n):
    out = panel.holdout_tail(frame(spark, days("a", D(2020, 1, 1), range(3))), "entity", "ds", n).orderBy("ds").collect()
    assert [r["is_test"] for r in out] == ([False, True, True] if n == 2 else [False] * 3)
    assert [r["rel"] for r in out] == ([0, 1, 2] if n == 2 else [0] * 3)


def test_duplicate_days_are_found(spark):
    rows = days("a", D(2020, 1, 1), [0, 0, 1])
    assert panel.duplicate_days(frame(spark, rows), "entity", "ds").count() == 1


def test_leap_day_looks_at_the_28th(spark):
    rows = [("a", D(2019, 2, 28), 5.0), ("a", D(2020, 2, 29), 6.0)]
    out = panel.last_year_value(frame(spark, rows), "entity", "ds", "y", F.lit(True)).orderBy("ds").collect()
    assert [r["last_year"] for r in out] == [None, 5.0]


def test_weekend_parameter_and_holiday_count(spark):
    rows = days("a", D(2024, 1, 5), range(3))  # Friday to Sunday
    both = [r["is_weekend"] for r in panel.calendar(frame(spark, rows), "ds").orderBy("ds").collect()]
    sunday = [r["is_weekend"] for r in panel.calendar(frame(spark, rows), "ds", 6).orderBy("ds").collect()]
    assert both == [0, 1, 1] and sunday == [0, 0, 1]
    flags = spark.createDataFrame([(1, 1, None), (0, None, 0)], "a int, b int, c int")
    assert [r[0] for r in flags.select(panel.holiday_count(["a", "b", "c"])).collect()] == [2, 0]


def brute_naive(train, test, m, weight, horizon):
    """Day-by-day forecast of one entity, straight from the definition."""
    history = {d: v for d, v in train}
    out = []
    for d, ly in test[:horizon]:
        past = [history[k] for k in sorted(history) if k.weekday() == d.weekday() and k < d][-m:]
        mean = sum(v * (i + 1) for i, v in enumerate(past)) / (len(past) * (len(past) + 1) / 2) if past else 0.0
        p = weight * ly + (1 - weight) * mean if ly is not None else mean
        history[d] = p
        out.append(p)
    return out


@pytest.mark.parametrize("m", [2, 5])
def test_naive_forecast_feeds_back(spark, m):
    rnd = random.Random(m)
    start = D(2021, 3, 1)
    offsets = sorted(rnd.sample(range(80), 50))
    known = [(start + dt.timedelta(days=o), float(rnd.randint(1, 99))) for o in offsets[:25]]
    ahead = [(start + dt.timedelta(days=o), 40.0 if i % 6 == 0 else None) for i, o in enumerate(offsets[25:])]
    train = frame(spark, [("a", d, v) for d, v in known])
    test = spark.createDataFrame([("a", d, 1.0, ly) for d, ly in ahead], "entity string, ds date, y double, ly double")
    out = baseline.naive_weighted(train, test, ["entity"], "ds", "y", m, "ly", 0.3, 20).orderBy("ds").collect()
    assert [r["relative_horizon"] for r in out] == list(range(1, 21))
    assert np.allclose([r["yhat"] for r in out], brute_naive(known, ahead, m, 0.3, 20))


def test_weekday_without_history_and_unknown_key(spark):
    train = frame(spark, [("a", D(2024, 1, 1), 10.0)])
    test = frame(spark, [("a", D(2024, 1, 9), 1.0), ("z", D(2024, 1, 9), 1.0)])
    out = {r["entity"]: r["yhat"] for r in baseline.naive_weighted(train, test, ["entity"], "ds", "y", 3).collect()}
    assert out == {"a": 0.0, "z": None}
    null = baseline.naive_weighted(train, test, ["entity"], "ds", "y", 3, null_if_empty=True)
    assert {r["yhat"] for r in null.collect()} == {None}


def test_origins_leave_out_the_exact_end():
    assert backtest.origins(80, 50, 5) == [0, 5, 10, 15, 20, 25]
    assert backtest.origins(50, 50, 5) == []


def test_rolling_origin_zero_is_the_single_forecast(spark):
    rows = [("a", D(2024, 1, 1) + dt.timedelta(days=i), float(i % 9 + 1)) for i in range(60)]
    held = panel.holdout_tail(frame(spark, rows), "entity", "ds", 20)
    run = lambda past, ahead, keys: baseline.naive_weighted(past, ahead, keys, "ds", "y", 3, horizon=10)
    rolled = {r["origin"]: r["rmse"] for r in backtest.rolling(held, "entity", "y", 10, [0, 5], run).collect()}
    single = run(held.filter("rel = 0"), held.filter("rel > 0"), ["entity"])
    alone = metrics.macro(metrics.by_horizon(single, "y", "yhat", "relative_horizon")).first()["rmse"]
    assert rolled[0] == pytest.approx(alone)


def test_acf_and_pacf(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=60))
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    series = spark.createDataFrame(rows, "ds date, y double")
    dev = y - y.mean()
    want = [float((dev[k:] * dev[: len(dev) - k]).sum() / (dev**2).sum()) for k in range(6)]
    got = [r["acf"] for r in panel.acf(series, "ds", "y", 5).orderBy("lag").collect()]
    assert np.allclose(got, want)
    for k in (1, 2, 5):
        toeplitz = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        solved = np.linalg.solve(toeplitz, want[1 : k + 1])[-1]
        assert panel.pacf(series, "ds", "y", 5).filter(f"lag = {k}").first()["pacf"] == pytest.approx(solved)
