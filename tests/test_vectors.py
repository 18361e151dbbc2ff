import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import hashing
from trendloom.operators import vectors


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(loc=c, scale=0.6, size=(60, 4)) for c in (0, 3, -4)])
    x = np.round(np.concatenate([x, np.repeat(x[:1], 90, axis=0)]) * 64) / 64  # a third are copies; sums are exact in any order
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)]
    return x, spark.createDataFrame(data, "key long, vec array<double>").repartition(5)


def plain_lloyd(x, start, rounds):
    centres = start.copy()
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else c for j, c in enumerate(centres)])
    return centres


def test_rounds_equal_numpy_for_all_numbers_of_clusters(spark, rows):
    x, df = rows
    ks = [1, 2, 3, 7, 300]  # more clusters than rows end with one each
    start = vectors.start_centres(df.filter("vec IS NOT NULL"), "key", "vec", ks)
    order = [r[0] for r in df.filter("vec IS NOT NULL").select("key", hashing.draw("key", 91).alias("h")).orderBy("h", "key").collect()]
    got = vectors.lloyd(df, "key", "vec", ks, 6)
    out = vectors.assign_nearest(df, "key", "vec", got)
    cost = {r["k"]: r["cost"] for r in vectors.costs(out).collect()}
    for k in ks:
        assert np.array_equal(start[k], x[order[:k]])
        want = plain_lloyd(x, x[order[:k]], 6)
        assert np.allclose(got[k], want)
        far = ((x[:, None] - want[None]) ** 2).sum(axis=2)
        assert cost[k] == pytest.approx(far.min(axis=1).sum())
    assert out.filter("key = 1000").count() == 0 and out.count() == len(ks) * len(x)


def test_more_rounds_never_cost_more(rows):
    _, df = rows
    cost = [vectors.costs(vectors.assign_nearest(df, "key", "vec", vectors.lloyd(df, "key", "vec", [3], r))).first()["cost"] for r in (0, 1, 4)]
    assert cost[0] >= cost[1] >= cost[2]


def test_components_are_orthogonal_and_carry_the_variance(rows):
    x, df = rows
    got = vectors.project(df.filter("vec IS NOT NULL"), "vec", 2).orderBy("key").select("projected").collect()
    scores = np.array([r[0] for r in got])
    values, directions = np.linalg.eigh(np.cov(x.T))
    top = directions[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), [0, 1]])
    assert np.allclose(scores, x @ top)
    assert np.allclose(scores.var(axis=0, ddof=1), values[::-1][:2])
    assert abs(np.cov(scores.T)[0, 1]) < 1e-9


def test_nearest_rows_of_constant_centres(spark, rows):
    x, df = rows
    centres = [(0, [0.0] * 4), (1, [3.0] * 4)]
    got = vectors.nearest(df.filter("vec IS NOT NULL"), "key", "vec", centres, 5).orderBy("centre", "rank").collect()
    for c, v in centres:
        far = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(len(x)), far))[:5]
        assert [r["key"] for r in got if r["centre"] == c] == want.tolist()


def test_centroids_are_means(spark, rows):
    x, df = rows
    by = df.filter("vec IS NOT NULL").withColumn("g", F.col("key") % 3)
    for r in vectors.centroids(by, "vec", "g", 4).collect():
        assert np.allclose(r["centre"], x[np.arange(len(x)) % 3 == r["g"]].mean(axis=0))


@pytest.mark.parametrize("block, chunk", [(2048, 4096), (20, 7)])
def test_nearest_rows_of_many_centres_equal_brute_force(spark, rows, block, chunk):
    x, df = rows
    rng = np.random.default_rng(9)
    centres = np.concatenate([x[::9], rng.normal(scale=5, size=(10, 4)), x[:1]])
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(999, None)], "c long, at array<double>")
    got = vectors.nearest_many(df, "key", "vec", table, "c", "at", 7, pivots=6, block=block, chunk=chunk).collect()
    found = {}
    for r in got:
        found.setdefault(r["centre"], []).append((r["rank"], r["key"], r["distance"]))
    assert set(found) == set(range(len(centres)))
    for c, at in enumerate(centres):
        far = ((x - at) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(len(x)), far))[:7]
        mine = sorted(found[c])
        assert [m[1] for m in mine] == want.tolist() and np.allclose([m[2] for m in mine], np.sqrt(far[want]))


def test_cells_out_of_reach_are_left_out():
    cells = np.array([(0, 0, 5, 0.0, 1.0), (0, 1, 5, 1.0, 2.0), (1, 0, 5, 0.0, 1.0)], vectors._CELL)
    assert vectors._reaches(np.array([0.1, 9.0]), cells, 3).tolist() == [0, 1]
    assert vectors._reaches(np.array([0.1, 9.0]), cells, 12).tolist() == [0, 1, 2]
    assert vectors._reaches(np.array([0.1, 9.0]), cells, 99).tolist() == [0, 1, 2]


def test_few_rows_and_no_rows(spark, rows):
    x, df = rows
    table = spark.createDataFrame([(0, [0.0] * 4)], "c long, at array<double>")
    few = vectors.nearest_many(df.filter("key < 2"), "key", "vec", table, "c", "at", 5).collect()
    assert sorted(r["key"] for r in few) == [0, 1]
    assert vectors.nearest_many(df.limit(0), "key", "vec", table, "c", "at", 5).collect() == []
    assert vectors.nearest_many(df, "key", "vec", table.limit(0), "c", "at", 5).collect() == []


def test_cells_share_groups_of_bounded_size():
    first, parts = vectors._groups(np.array([3, 4, 2, 25, 1, 9, 1]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]


@pytest.mark.parametrize("shift", [0, 1e6])
def test_nearest_in_a_block_equal_brute_force(shift):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 8)) * 8) / 8 + shift
    x = np.concatenate([x, np.repeat(x[:2], 200, axis=0), x[:50] + 1e-9])  # copies and near copies
    keys = rng.permutation(len(x))
    asked = np.concatenate([x[::7], rng.normal(size=(5, 8)) * 100])
    for k, tile in ((6, 4096), (6, 50), (2000, 300)):
        got = [np.concatenate(c) for c in zip(*vectors._nearest_in(x, keys, asked, k, tile, 64))]
        for j, at in enumerate(asked):
            far = np.sqrt(((x - at) ** 2).sum(axis=1))
            want = np.lexsort((keys, far))[:k]
            assert np.array_equal(got[1][got[0] == j], keys[want]) and np.array_equal(got[2][got[0] == j], far[want])


def test_nearest_in_a_block_measures_what_is_not_finite():
    x = np.array([[0.0, 1.0], [np.nan, 0.0], [1e200, 0.0], [2.0, 2.0]])
    (row, key, far), = vectors._nearest_in(x, np.arange(4), np.array([[0.0, 0.0], [1e200, 0.0]]), 3)
    assert key[row == 0].tolist() == [0, 3, 2] and key[row == 1][0] == 2 and (row == 1).sum() == 3


def test_a_centre_moves_once_to_a_group_of_cells(spark):
    """No cell can be left out here, and still a centre does not move to each of them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vec array<double>")
    out = vectors.nearest_many(df, "key", "vec", df, "key", "vec", 3, block=20)
    assert out.count() == 6000 and {r["key"] for r in out.filter("rank = 1").collect()} == set(range(2000))
    cells = np.array([(p, r, 20, 0.0, 9.0) for p in range(10) for r in range(10)], vectors._CELL)
    first, _ = vectors._groups(cells["n"], 250)
    met = vectors._reaches(np.full(10, 1.0), cells, 3)
    assert len(met) == 100 and len(np.unique(first[met])) == 9
