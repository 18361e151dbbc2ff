"""Column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import ordering


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row, one null count per column, one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols or df.columns])


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width counts over [lo, hi] (the data's range when not given); the last bin holds hi itself."""
    edge = None
    if lo is None or hi is None:
        edge = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    low = F.lit(float(lo)) if lo is not None else edge["lo"].cast("double")
    high = F.lit(float(hi)) if hi is not None else edge["hi"].cast("double")
    x = F.col(col).cast("double")
    place = F.floor((x - low) / (high - low) * bins)
    inside = df.filter((x >= low) & (x <= high))
    return inside.groupBy(F.least(place, F.lit(bins - 1).cast("long")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    basics = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    ).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])).alias("r"))
    quartiles = reduce(
        DataFrame.unionByName,
        [
            ordering.exact_quantiles(df, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumn("column", F.lit(c))
            for c in cols
        ],
    )
    return basics.select("r.column", "r.s.*").join(quartiles, "column")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))
