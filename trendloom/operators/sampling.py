"""Repeatable samples and splits driven by an integer hash of a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import hashing
from trendloom.operators import ordering

_BUCKETS = 65536


def _smallest(df: DataFrame, key: str, n: int, seed: int, by: Sequence[str]) -> DataFrame:
    """The n rows with the smallest (hash, key) per group, exactly, without ranking whole groups.

    Rows are counted per hash bucket; buckets wholly below the n-th row are kept as they are and only the one bucket the
    n-th row falls in is ranked. The window over bucket counts has at most ``_BUCKETS`` rows per group.
    """
    h = hashing.draw(key, seed)
    drawn = df.withColumn("_h", h).withColumn(
        "_bucket", F.call_function("div", F.col("_h"), F.lit(hashing.MODULUS // _BUCKETS)).cast("int")
    )
    sizes = drawn.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = sizes.withColumn("_upto", F.sum("_n").over(run))
    needed = upto.withColumn("_left", F.lit(n) - (F.col("_upto") - F.col("_n"))).filter(F.col("_left") > 0)
    placed = drawn.join(needed.select(*by, "_bucket", "_n", "_left"), [*by, "_bucket"])
    whole = placed.filter(F.col("_n") <= F.col("_left"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h", key)
    edge = placed.filter(F.col("_n") > F.col("_left")).withColumn("_rank", F.row_number().over(inside))
    edge = edge.filter(F.col("_rank") <= F.col("_left")).drop("_rank")
    return whole.unionByName(edge).select(*df.columns)


def exact(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same ones on every run; ``key`` is a unique whole number."""
    return _smallest(df, key, n, seed, [])


def balanced(df: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each class."""
    return _smallest(df, key, n, seed, [label])


def in_first_part(key: str, fraction: float, seed: int = 0) -> Column:
    return hashing.draw(key, seed) < int(fraction * hashing.MODULUS)


def split(df: DataFrame, key: str, fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together hold every row; needs no shuffle."""
    first = in_first_part(key, fraction, seed)
    return df.filter(first), df.filter(~first)


def batches(df: DataFrame, key: str, n: int) -> DataFrame:
    """Number of one of n nearly equal batches per row, in key order."""
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = ordering.global_index(df, [key], "_at")
    return placed.withColumn("batch", ordering.tile_of(F.col("_at"), total, n)).drop("_at")


def time_blocks(df: DataFrame, ds: str, k: int) -> DataFrame:
    """Block 0..k of each distinct date: blocks 1..k have (dates div (k + 1)) dates, block 0 takes the remainder."""
    days = df.select(ds).distinct()
    total = days.agg(F.count(F.lit(1))).scalar()
    ranked = ordering.global_index(days, [ds], "_at")
    size = F.call_function("div", total, F.lit(k + 1).cast("long"))
    head = total - size * k
    later = F.call_function("div", F.col("_at") - head, F.greatest(size, F.lit(1).cast("long"))) + 1
    return ranked.select(ds, F.when(F.col("_at") < head, F.lit(0).cast("long")).otherwise(later).alias("block"))


def time_folds(df: DataFrame, ds: str, k: int) -> DataFrame:
    """Every row with its block; fold j trains on blocks below j and validates on block j, j = 1..k."""
    return df.join(time_blocks(df, ds, k), ds)


def fold(blocked: DataFrame, j: int) -> tuple[DataFrame, DataFrame]:
    return blocked.filter(F.col("block") < j), blocked.filter(F.col("block") == j)
