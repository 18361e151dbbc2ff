"""A local session for tests and benchmarks; on a cluster the submitted session is used as it is."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

ROWS = 1_000_000  # rows that one task should sort at most


def local_session(cores: int | str = 8, name: str = "trendloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split a hot join key even where that costs one more shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a sort of so many rows: the session's number, or more where one would hold over ``ROWS`` of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS))


def widen(spark: SparkSession, rows: int) -> None:
    """Let shuffles grow with the input, so that what one task sorts does not; the session's number is never lowered.

    Adaptive execution joins small partitions again.
    """
    spark.conf.set("spark.sql.shuffle.partitions", str(parts_for(spark, rows)))
