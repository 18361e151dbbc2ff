"""Weighted-weekday baseline forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.panel import weighted_mean


def naive_weighted(
    train: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    ds: str,
    y: str,
    m: int | Sequence[int] = 8,
    last_year: str | None = None,
    holiday_weight: float = 0.3,
    horizon: int = 50,
    null_if_empty: bool = False,
) -> DataFrame:
    """Forecast the first ``horizon`` rows of each key, each prediction joining the history of the next ones.

    A prediction uses only its own weekday, so the recursion is a fold over one (key, weekday) group: at most m past
    values and at most ``horizon`` future rows, whatever the size of the panel. Where ``last_year`` is set, it is mixed
    in with ``holiday_weight``. Keys without any training row get a null prediction. Several values of ``m`` run side by
    side on the same groups and are told apart by an extra column ``m``.
    """
    sizes = [m] if isinstance(m, int) else list(m)
    size = F.col("_m")
    group = [*keys, "_wd"]
    past_year = F.col(last_year).cast("double") if last_year else F.lit(None).cast("double")
    ahead = (
        test.withColumn("_h", F.row_number().over(Window.partitionBy(*keys).orderBy(ds)))
        .filter(F.col("_h") <= horizon)
        .withColumn("_wd", F.weekday(ds))
        .groupBy(*group)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("_h", F.col(ds).alias("ds"), F.col(y).alias("y"), past_year.alias("ly")))
            ).alias("_ahead")
        )
    )
    newest = Window.partitionBy(*group).orderBy(F.col(ds).desc())
    recent = (
        train.select(*keys, ds, y, F.weekday(ds).alias("_wd"))
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= max(sizes))
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(ds), F.col(y).cast("double").alias("v")))).alias("_recent"))
    )
    known = train.select(*keys).distinct().withColumn("_known", F.lit(True))
    every = F.transform(F.coalesce("_recent", F.array().cast("array<struct<ds:date,v:double>>")), lambda p: p["v"])

    def newest_of(values: Column) -> Column:
        return F.slice(values, F.greatest(F.size(values) - size, F.lit(0)) + 1, size)

    def step(state: Column, row: Column) -> Column:
        hist = state["hist"]
        mean = weighted_mean(hist)
        if null_if_empty:
            mean = F.when(F.size(hist) > 0, mean)
        blended = F.when(row["ly"].isNotNull(), holiday_weight * row["ly"] + (1 - holiday_weight) * mean).otherwise(mean)
        grown = F.concat(hist, F.array(blended)) if not null_if_empty else F.when(
            blended.isNull(), hist
        ).otherwise(F.concat(hist, F.array(blended)))
        kept = newest_of(grown)
        return F.struct(kept.alias("hist"), F.concat(state["out"], F.array(blended)).alias("out"))

    empty = F.array().cast("array<double>")
    folded = (
        ahead.join(recent, group, "left")
        .join(known, list(keys), "left")
        .withColumn("_m", F.explode(F.array(*[F.lit(k) for k in sizes])))
        .withColumn("_hist", newest_of(every))
        .withColumn(
            "_out", F.aggregate("_ahead", F.struct(F.col("_hist").alias("hist"), empty.alias("out")), step)["out"]
        )
    )
    rows = folded.select(*keys, "_known", "_m", F.explode(F.arrays_zip("_ahead", "_out")).alias("_r"))
    label = [] if isinstance(m, int) else [F.col("_m").cast("long").alias("m")]
    return rows.select(
        *keys,
        *label,
        F.col("_r._ahead.ds").alias(ds),
        F.col("_r._ahead.y").alias(y),
        F.when(F.col("_known"), F.col("_r._out")).alias("yhat"),
        F.col("_r._ahead._h").cast("long").alias("relative_horizon"),
    )
