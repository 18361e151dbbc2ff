"""Collects the registered queries."""

from __future__ import annotations

import functools
import importlib

from pyspark.sql import DataFrame, SparkSession

from trendloom.plans.registry import QUERIES, TWINS, Query
from trendloom.session import prepare

MODULES = [
    "forecasting", "profiling", "scoring", "customers", "snapshot_tables", "interaction_graph", "recipes",
    "sampling_plans", "modelling", "streams",
]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"trendloom.plans.{name}")


def _ready(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepare(spark), folder)

    return run


def queries() -> dict[str, Query]:
    _load()
    return {name: _ready(fn) for name, fn in QUERIES.items()}


def twins() -> dict[str, str]:
    _load()
    return dict(TWINS)
