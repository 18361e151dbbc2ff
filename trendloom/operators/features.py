"""Encoders and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import ordering


def one_hot(df: DataFrame, col: str, levels: Sequence[object], drop_first: bool = False) -> DataFrame:
    """One 0/1 column per declared level: the schema never depends on the data."""
    kept = list(levels)[1:] if drop_first else list(levels)
    flag = lambda v: F.coalesce((F.col(col) == F.lit(v)).cast("long"), F.lit(0).cast("long"))
    return df.withColumns({f"{col}_{v}": flag(v) for v in kept})


def label_ids(df: DataFrame, col: str, name: str) -> DataFrame:
    """Dense 0-based id of each distinct value in sorted order."""
    return ordering.global_index(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], name)


def label_encode(df: DataFrame, col: str, name: str) -> DataFrame:
    """Attach the sorted-value id; a null category keeps a null id."""
    return df.join(label_ids(df, col, name), col, "left")


def first_seen_ids(df: DataFrame, key: str, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Dense id of each key by the place of its first row; the key itself breaks ties."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return ordering.global_index(first, ["_first", key], name, start).drop("_first")


Scaler = dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> Scaler:
    """Mean and population deviation per column over the selected rows: one aggregation, two numbers per column."""
    rows = df if where is None else df.filter(where)
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (stats[f"m_{c}"], stats[f"s_{c}"]) for c in cols}


def apply_scaler(df: DataFrame, scaler: Scaler, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Standardise columns on the rows where ``where`` holds; a zero deviation scales by 1."""
    out = {}
    for c in cols:
        mean, std = scaler[c]
        z = (F.col(c) - F.lit(mean)) / F.lit(std or 1.0)
        out[c] = z if where is None else F.when(where, z).otherwise(F.col(c))
    return df.withColumns(out)
