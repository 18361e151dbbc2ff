import random

import numpy as np
import pytest

from trendloom.operators import metrics, ordering, profile


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def rank_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_is_the_rank_formula(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 9) / 10) for _ in range(200)]
    assert metrics.auc(scored(spark, rows), "label", "score").first()["auc"] == pytest.approx(rank_auc(rows))


@pytest.mark.parametrize("sign,want", [(1, 1.0), (-1, 0.0)])
def test_perfect_and_reversed_ranking(spark, sign, want):
    rows = [(int(i >= 5), sign * float(i)) for i in range(10)]
    assert metrics.auc(scored(spark, rows), "label", "score").first()["auc"] == want


def test_one_class_has_no_auc(spark):
    assert metrics.auc(scored(spark, [(1, 0.2), (1, 0.8)]), "label", "score").first()["auc"] is None


def test_average_precision_and_youden(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    assert metrics.average_precision(scored(spark, rows), "label", "score").first()["ap"] == pytest.approx((1 + 2 / 3) / 2)
    best = metrics.youden(scored(spark, rows), "label", "score").first()
    assert (best["threshold"], best["j"]) == (0.9, 0.5)


def test_horizon_metrics_skip_undefined_percentages(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0)], "h int, y double, yhat double")
    row = metrics.by_horizon(df, "y", "yhat", "h").first()
    assert row["mae"] == 2.5 and row["mape"] == 50.0 and row["smape"] == pytest.approx(5 / 7.5 * 100)
    whole = metrics.regression(df, "y", "yhat").first()
    assert whole["smape_guarded"] == pytest.approx(5 / 7.5 * 50)


def test_report_of_a_perfect_prediction(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "b")], "y string, p string")
    for row in metrics.classification_report(df, "y", "p").collect():
        assert row["f1"] == 1.0
    missed = spark.createDataFrame([("a", "b"), ("b", "b")], "y string, p string")
    rows = {r["class"]: r for r in metrics.classification_report(missed, "y", "p").collect()}
    assert rows["a"]["f1"] == 0.0 and rows["accuracy"]["f1"] == 0.5 and rows["b"]["precision"] == 0.5


def test_quantiles_and_description(spark):
    values = [float(v) for v in np.random.default_rng(2).integers(0, 30, 101)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = ordering.exact_quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.85}).first()
    assert np.allclose(list(got), np.quantile(values, [0.1, 0.5, 0.85]))
    row = profile.describe(df, ["x"]).first()
    assert row["n"] == 101 and row["std"] == pytest.approx(np.std(values, ddof=1))


def test_histogram_keeps_the_right_edge(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 4.0)], "x double")
    got = {r["bin"]: r["n"] for r in profile.histogram(df, "x", 4).collect()}
    counts, _ = np.histogram([0.0, 1.0, 2.0, 4.0], bins=4)
    assert [got.get(b, 0) for b in range(4)] == list(counts)


@pytest.mark.parametrize("n", [7, 10, 23])
def test_tiles_differ_by_one_at_most(spark, n):
    df = spark.range(n).select(ordering.F.col("id"))
    placed = ordering.global_index(df, ["id"], "at")
    total = df.agg(ordering.F.count("id")).scalar()
    sizes = [r["count"] for r in placed.groupBy(ordering.tile_of(placed["at"], total, 5).alias("t")).count().orderBy("t").collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_global_index_with_a_hot_value(spark):
    rows = [(1 if i % 3 == 0 else i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long")
    out = ordering.global_index(df, ["k", "id"], "at", parts=7).orderBy("at").collect()
    assert [(r["k"], r["id"]) for r in out] == sorted(rows)
    assert [r["at"] for r in out] == list(range(300))


def test_running_totals_with_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", i, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    out = ordering.keyed_running_totals(df, ["k"], ["t"], ordering.F.floor(ordering.F.col("t") / 10), {"s": "v"})
    want = {}
    for k, t, v in rows:
        want[k, t] = v + max([s for (kk, tt), s in want.items() if kk == k and tt < t], default=0)
    assert {(r["k"], r["t"]): r["s"] for r in out.collect()} == want
    prev = ordering.previous_in_key(df, ["k"], "t", ordering.F.floor(ordering.F.col("t") / 10), "p").collect()
    for r in prev:
        earlier = [t for k, t, _ in rows if k == r["k"] and t < r["t"]]
        assert r["p"] == (max(earlier) if earlier else None)


def test_figures_of_one_curve_order_the_scores_once(spark, monkeypatch):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.3), (0, 0.1)]
    df = scored(spark, rows)
    want = metrics.auc(df, "label", "score").first()["auc"], metrics.average_precision(df, "label", "score").first()["ap"]
    curve = metrics.roc(df, "label", "score")
    monkeypatch.setattr(metrics, "roc", None)
    got = metrics.auc(df, "label", "score", curve).first()["auc"], metrics.average_precision(df, "label", "score", curve).first()["ap"]
    assert got == pytest.approx(want) and got[0] == pytest.approx(rank_auc(rows))
