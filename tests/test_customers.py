import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import clean, clv, features, rfm, samples

D = dt.date


def spend(spark, rows):
    return spark.createDataFrame(rows, "customer long, ds date, amount double")


def test_same_day_orders_merge_and_totals_must_be_positive(spark):
    rows = [
        (1, 1, dt.datetime(2020, 1, 1, 9), 10.0, 1, "X"), (1, 2, dt.datetime(2020, 1, 1, 9), 5.0, 1, "X"),
        (2, 1, dt.datetime(2020, 1, 1, 15), 7.0, 1, "X"), (3, 1, dt.datetime(2020, 1, 2, 9), -3.0, 1, "X"),
    ]
    lines = spark.createDataFrame(
        rows, "invoice long, line long, ts timestamp_ntz, amount double, customer long, country string"
    )
    orders = rfm.orders(lines, ["line"])
    assert {(r["invoice"], r["amount"]) for r in orders.collect()} == {(1, 15.0), (2, 7.0)}
    table = rfm.summary(rfm.daily_spend(orders), "2020-01-11").first()
    assert (table["frequency"], table["recency"], table["T"], table["monetary_value"]) == (0, 0, 10, 0.0)
    first = rfm.summary(rfm.daily_spend(orders), "2020-01-11", include_first=True).first()
    assert (first["frequency"], first["monetary_value"]) == (1, 22.0)


def test_calibration_and_holdout(spark):
    rows = [(1, D(2020, 1, 1), 10.0), (1, D(2020, 1, 5), 20.0), (1, D(2020, 1, 10), 30.0), (1, D(2020, 1, 11), 50.0),
            (2, D(2020, 1, 11), 5.0), (3, D(2020, 1, 2), 8.0)]
    out = {r["customer"]: r for r in rfm.calibration_holdout(spend(spark, rows), "2020-01-10", "2020-01-31").collect()}
    assert set(out) == {1, 3}
    one = out[1]
    assert (one["frequency"], one["recency"], one["T"], one["monetary_value"]) == (2, 9, 9, 25.0)
    assert (one["holdout_frequency"], one["holdout_monetary_value"]) == (1, 50.0)
    assert out[3]["holdout_frequency"] == 0
    capped = rfm.train_test(spend(spark, rows), "2020-01-10", "2020-01-31", spend_cap=20.0)
    assert [r["customer"] for r in capped.collect()] == [3]


def test_zscore_is_sequential(spark):
    rows = [(float(i % 5), 1.0) for i in range(40)] + [(1000.0, 100.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    kept = clean.zscore_filter(df, ["a", "b"], 3.0)
    # After the outlier is gone the second column is constant, so no row passes.
    assert kept.count() == 0
    assert clean.zscore_filter(df, ["a", "b"], 3.0, sequential=False).count() == 40
    assert clean.zscore_filter(df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), ["a"], 3.0).count() == 32


def test_label_and_first_seen_ids(spark):
    df = spark.createDataFrame([("b", 3), ("a", 2), (None, 1), ("b", 0)], "c string, t int")
    coded = features.label_encode(df, "c", "id")
    assert {(r["c"], r["id"]) for r in coded.collect()} == {("a", 0), ("b", 1), (None, None)}
    seen = features.first_seen_ids(df.na.drop(), "c", ["t"], "id")
    assert {(r["c"], r["id"]) for r in seen.collect()} == {("b", 0), ("a", 1)}


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = features.apply_scaler(df, features.fit_scaler(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_future_value_is_open_on_both_ends(spark):
    cut = dt.datetime(2020, 2, 25, 23, 59, 59)  # cut 0 of start 2020-01-01, step 56
    end = dt.datetime(2020, 5, 25, 23, 59, 59)
    second = dt.timedelta(seconds=1)
    rows = [(1, cut, 1.0), (1, cut + second, 2.0), (1, end - second, 4.0), (1, end, 8.0)]
    tx = spark.createDataFrame(rows, "customer long, ts timestamp_ntz, amount double")
    out = {r["cut_no"]: r["target"] for r in samples.future_value(tx, "customer", "ts", "amount", "2020-01-01", 56, 3, 3).collect()}
    assert out[0] == 6.0


def test_samples_never_see_their_target(spark):
    rng = np.random.default_rng(5)
    base = dt.datetime(2020, 1, 1)
    rows = [(int(rng.integers(0, 4)), base + dt.timedelta(hours=int(h)), 1.0) for h in rng.integers(0, 24 * 500, 300)]
    tx = spark.createDataFrame(rows, "customer long, ts timestamp_ntz, amount double")
    out = samples.clv_dataset(tx, "customer", "ts", "amount", "2020-01-01", 56, 8, 3).collect()
    for r in out:
        cut = base + dt.timedelta(days=56 * (r["cut_no"] + 1), seconds=-1)
        own = [t for c, t, _ in rows if c == r["customer"]]
        month = cut.month - 1 + 3
        stop = cut.replace(year=cut.year + month // 12, month=month % 12 + 1, day=1) + dt.timedelta(days=cut.day - 1)
        assert r["n_events"] == sum(t <= cut for t in own)
        if stop.month == month % 12 + 1:
            assert r["target"] == sum(cut < t < stop for t in own)


def loglik(x, tx, T, r, alpha, a, b):
    g = math.lgamma
    alive = -(r + x) * math.log(alpha + T)
    gone = math.log(a) - math.log(b + x - 1) - (r + x) * math.log(alpha + tx) if x else -math.inf
    mix = g(a + b) + g(b + x) - g(b) - g(a + b + x)
    return g(r + x) - g(r) + r * math.log(alpha) + mix + np.logaddexp(alive, gone)


def test_bgnbd_fit_is_a_maximum(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(1500):
        rate, drop, T = rng.gamma(0.8, 1 / 20.0), rng.beta(1.2, 3.0), int(rng.integers(100, 300))
        t, x, last = 0.0, 0, 0
        while True:
            t += rng.exponential(1 / rate)
            if t > T:
                break
            x, last = x + 1, int(t)
            if rng.random() < drop:
                break
        rows.append((x, last, T, 0.0))
    table = spark.createDataFrame(rows, "frequency long, recency long, T long, monetary_value double")
    p = clv.parameters(clv.fit_bgnbd(table))
    total = lambda **q: sum(loglik(x, tx, T, **q) for x, tx, T, _ in rows)
    best = total(**p)
    for name in p:
        for factor in (0.9, 1.1):
            assert total(**{**p, name: p[name] * factor}) < best
    assert p["r"] == pytest.approx(0.8, rel=0.3)


def test_scores_at_the_edges(spark):
    df = spark.createDataFrame([(0, 0, 100, 0.0), (5, 90, 100, 50.0)], "frequency long, recency long, T long, monetary_value double")
    p = {"r": 0.8, "alpha": 20.0, "a": 1.4, "b": 2.5}
    out = clv.score(df, p, {"p": 6.0, "q": 4.0, "v": 15.0}, 30.0).orderBy("frequency").collect()
    assert out[0]["p_alive"] == 1.0 and 0 < out[1]["p_alive"] < 1
    assert out[0]["expected_spend"] == pytest.approx(6 * 15 / 3)
    assert all(r["expected_purchases"] > 0 for r in out)


def brute_pareto(x, tx, T, r, alpha, s, beta):
    """P(alive) from the untransformed series."""
    big, gap = max(alpha, beta), abs(alpha - beta)
    A, B = r + s + x, (s + 1 if alpha >= beta else r + x)

    def series(z):
        term = total = 1.0
        for k in range(5000):
            term *= (A + k) * (B + k) / ((A + 1 + k) * (k + 1)) * z
            total += term
        return total

    a0 = series(gap / (big + tx)) / (big + tx) ** A - series(gap / (big + T)) / (big + T) ** A
    return 1 / (1 + s / A * (alpha + T) ** (r + x) * (beta + T) ** s * a0)


@pytest.mark.parametrize("alpha,beta", [(70.0, 55.0), (40.0, 90.0), (50.0, 50.0)])
def test_pareto_alive(spark, alpha, beta):
    rows = [(0.0, 0.0, 200.0), (3.0, 90.0, 200.0), (12.0, 190.0, 200.0)]
    df = spark.createDataFrame(rows, "x double, tx double, T double")
    p = {"r": 0.9, "alpha": alpha, "s": 1.3, "beta": beta}
    got = [r[0] for r in df.select(clv.pareto_alive(F.col("x"), F.col("tx"), F.col("T"), p)).collect()]
    assert np.allclose(got, [brute_pareto(*row, **p) for row in rows])


def test_busy_customer_does_not_overflow(spark):
    df = spark.createDataFrame([(5000.0, 990.0, 1000.0)], "x double, tx double, T double")
    p = {"r": 0.8, "alpha": 20.0, "a": 1.4, "b": 2.5}
    got = df.select(clv.bgnbd_purchases(F.col("x"), F.col("tx"), F.col("T"), 100.0, p)).first()[0]
    assert 0 < got < 1000


def test_hypergeometric_function_agrees_with_closed_forms(spark):
    import math

    cases = []
    for z in (0.0, 0.3, 0.9, 0.95, 1 - 1e-4, 1 - 1e-6, 1 - 1e-8, 1 - 1e-10):
        w = 1 - z  # as a double has it
        cases.append((1.0, 1.0, 2.0, z, -math.log(w) / z if z else 1.0))
        cases.append((0.5, 1.0, 1.5, z, math.atanh(math.sqrt(z)) / math.sqrt(z) if z else 1.0))
        cases.append((2.5, 3.0, 3.0, z, w**-2.5))
        cases.append((-0.7, 1.3, 1.3, z, w**0.7))
    df = spark.createDataFrame(cases, "a double, b double, c double, z double, want double")
    for r in df.withColumn("got", clv.hyp2f1(F.col("a"), F.col("b"), F.col("c"), F.col("z"))).collect():
        assert abs(r["got"] - r["want"]) <= 1e-9 * max(1.0, abs(r["want"])), r


def test_fits_say_whether_they_converged(spark):
    rows = [(float(x), float(tx), 50.0) for x, tx in [(0, 0), (1, 10), (2, 30), (5, 45), (0, 0), (3, 20), (1, 40)] * 5]
    table = spark.createDataFrame(rows, "frequency double, recency double, T double")
    done = clv.convergence(clv.fit_bgnbd(table, penalty=0.001))
    assert done["converged"] == 1 and done["gradient"] < 0.1
    assert clv.convergence(clv.fit_bgnbd(table, rounds=1, penalty=0.001))["converged"] == 0
    with pytest.raises(RuntimeError):
        clv.fit_bgnbd(table, rounds=1, penalty=0.001, strict=True)


@pytest.mark.parametrize("model", ["bgnbd", "gamma_gamma"])
def test_gradients_equal_differences(spark, model):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(int(f), int(f * 3), int(f * 3 + t), float(m)) for f, t, m in zip(rng.integers(0, 6, 60), rng.integers(0, 90, 60), rng.uniform(5, 90, 60))]
    df = spark.createDataFrame(rows, "frequency long, recency long, T long, monetary_value double")
    base = np.array([0.8, 20.0, 1.3, 2.0][: 4 if model == "bgnbd" else 3])
    eps = 1e-5
    points = [base, *[base * np.exp(s * eps * np.eye(len(base))[k]) for k in range(len(base)) for s in (1, -1)]]
    got = clv.likelihood(df, model, [p.tolist() for p in points]).orderBy("point").collect()
    slopes = [(got[1 + 2 * k]["loglik"] - got[2 + 2 * k]["loglik"]) / (2 * eps) for k in range(len(base))]
    assert np.allclose([got[0][c] for c in got[0].__fields__[2:]], slopes, atol=1e-6)


def test_fits_without_penalty_reach_a_flat_place(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 4000
    rate, leave = rng.gamma(0.9, 1 / 12.0, n), rng.beta(1.2, 3.0, n)
    rows = []
    for lam, p in zip(rate, leave):
        t, last, x, end = 0.0, 0.0, 0, float(rng.integers(60, 200))
        while True:
            t += rng.exponential(1 / max(lam, 1e-9))
            if t > end:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        rows.append((x, last, end))
    df = spark.createDataFrame(rows, "frequency long, recency double, T double")
    fit = clv.fit_bgnbd(df, strict=True)
    p = clv.parameters(fit)
    assert p["r"] == pytest.approx(0.9, rel=0.3) and p["alpha"] == pytest.approx(12, rel=0.4)
    at = clv.likelihood(df, "bgnbd", [[p[k] for k in ("r", "alpha", "a", "b")]]).first()
    assert max(abs(at[c]) for c in ("d_r", "d_alpha", "d_a", "d_b")) < 1e-3
