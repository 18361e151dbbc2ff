"""Rolling-origin evaluation: every origin runs in one job, keyed by (origin, key)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators import metrics

Forecaster = Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]
Prune = Callable[[DataFrame], DataFrame]


def origins(n_test: int, horizon: int, step: int) -> list[int]:
    """0, step, 2 step, ... while at least one row lies beyond the horizon of the origin."""
    return list(range(0, max(n_test - horizon, 0), step))


def rolling_forecast(
    held: DataFrame, key: str, horizon: int, starts: Sequence[int], forecaster: Forecaster, prune: Prune | None = None
) -> DataFrame:
    """``held`` carries ``rel`` (0 in training, 1..n in the held-out tail); revealed rows join the history.

    ``prune`` cuts the training rows to those that a forecast can use, before rows are multiplied by the origins.
    """
    if prune is not None:
        held = prune(held.filter("rel = 0")).select(held.columns).unionByName(held.filter("rel > 0"))
    tagged = held.withColumn("origin", F.explode(F.array(*[F.lit(o).cast("long") for o in starts])))
    past = tagged.filter(F.col("rel") <= F.col("origin"))
    ahead = tagged.filter((F.col("rel") > F.col("origin")) & (F.col("rel") <= F.col("origin") + horizon))
    return forecaster(past, ahead, ["origin", key])


def rolling(
    held: DataFrame, key: str, y: str, horizon: int, starts: Sequence[int], forecaster: Forecaster, prune: Prune | None = None
) -> DataFrame:
    """Macro means of the horizon metrics, one row per origin."""
    scored = rolling_forecast(held, key, horizon, starts, forecaster, prune)
    by_step = metrics.by_horizon(scored, y, "yhat", "relative_horizon", by=["origin"])
    return metrics.macro(by_step, by=["origin"])
