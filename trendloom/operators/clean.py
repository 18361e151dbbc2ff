"""Row filters of the cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c) > 0)
    return df


def not_in(col: str, values: Sequence[object]) -> Column:
    """NOT IN that keeps a null value, as a membership mask does."""
    return ~F.coalesce(F.col(col).isin(list(values)), F.lit(False))


def before_month(df: DataFrame, ts: str, month: str) -> DataFrame:
    """Rows before the first day of a month; a plain range test, so it reaches the file scan."""
    return df.filter(F.col(ts) < F.lit(month).cast("timestamp_ntz"))


def _zscore(col: str, mean: Column, std: Column) -> Column:
    return F.abs(F.try_divide(F.col(col) - mean, std))


def zscore_filter(df: DataFrame, cols: Sequence[str], k: float = 3.0, sequential: bool = True) -> DataFrame:
    """Keep |z| < k with the population deviation; null values and constant columns pass no row.

    Sequential filters take each column's statistics after the previous filter. The statistics are scalar subqueries.
    """

    def stats(frame: DataFrame, names: Sequence[str]) -> Column:
        parts = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in names]
        return frame.agg(F.struct(*parts)).scalar()

    if not sequential:
        s = stats(df, cols)
        for c in cols:
            df = df.filter(_zscore(c, s[c]["mean"], s[c]["std"]) < k)
        return df
    for c in cols:
        s = stats(df, [c])
        df = df.filter(_zscore(c, s[c]["mean"], s[c]["std"]) < k)
    return df


def plausible(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Keep rows strictly inside every (low, high) bound; a null in a bounded column drops the row."""
    for c, (low, high) in bounds.items():
        df = df.filter(F.col(c).isNotNull())
        if low is not None:
            df = df.filter(F.col(c) > low)
        if high is not None:
            df = df.filter(F.col(c) < high)
    return df


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order; reduced map-side, so a hot key is no burden."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fill(col: str, value: object) -> Column:
    return F.coalesce(F.col(col), F.lit(value))


def fill_empty(col: str, value: str) -> Column:
    """Default for a missing or empty text."""
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(value))
