import hashlib

import pytest
from pyspark.sql import functions as F

from trendloom.functions import hashing
from trendloom.operators import sampling


def py_draw(key, seed=0):
    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:15], 16)


def test_draws_behave_like_random_numbers(spark):
    """Repeats, strides and seeds: 20,000 queries of five draws from ten places."""
    frame = spark.range(20_000).select(
        "id", *[(hashing.draw(F.col("id") * 5 + k, 7) % 10).alias(f"d{k}") for k in range(5)],
        (hashing.draw("id", 1) % 2).alias("a"), (hashing.draw("id", 2) % 2).alias("b"),
    )
    rows = frame.collect()
    repeats = sum(len({r[f"d{k}"] for k in range(5)}) < 5 for r in rows) / len(rows)
    assert abs(repeats - (1 - 10 * 9 * 8 * 7 * 6 / 10**5)) < 0.02
    steps = {tuple((r[f"d{k + 1}"] - r[f"d{k}"]) % 10 for k in range(4)) for r in rows}
    assert len(steps) > 8000
    agree = sum(r["a"] == r["b"] for r in rows) / len(rows)
    assert abs(agree - 0.5) < 0.02


@pytest.mark.parametrize("n", [0, 1, 250, 999, 1000, 5000])
def test_exact_size_and_choice(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "_BUCKETS", 16)
    got = sorted(r[0] for r in sampling.exact(spark.range(1000).toDF("id"), "id", n, 7).collect())
    want = sorted(sorted(range(1000), key=lambda k: (py_draw(k, 7), k))[:n])
    assert got == want


def test_balanced_with_a_hot_class(spark):
    df = spark.range(900).select(F.col("id"), F.when(F.col("id") % 90 == 0, 1).otherwise(0).alias("y"))
    sizes = {r["y"]: r["count"] for r in sampling.balanced(df, "y", "id", 50).groupBy("y").count().collect()}
    assert sizes == {0: 50, 1: 10}


def test_split_is_a_partition_near_its_fraction(spark):
    a, b = sampling.split(spark.range(5000).toDF("id"), "id", 0.8, 3)
    assert a.count() + b.count() == 5000 and a.join(b, "id").count() == 0
    assert abs(a.count() - 4000) < 150


def test_batches(spark):
    out = sampling.batches(spark.range(100, 123).toDF("id"), "id", 5).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in out] == [5, 5, 5, 4, 4]


def test_time_folds_follow_the_date(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-14')) ds")
    df = df.unionByName(df)
    out = sampling.time_folds(df, "ds", 3)
    sizes = {r["block"]: r["count"] for r in out.select("ds", "block").distinct().groupBy("block").count().collect()}
    assert sizes == {0: 5, 1: 3, 2: 3, 3: 3}
    train, valid = sampling.fold(out, 2)
    assert train.agg(F.max("ds")).first()[0] < valid.agg(F.min("ds")).first()[0]
