"""Token counts over whole texts and list columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    """Lower-cased token counts, optionally per group; frequent tokens combine before the shuffle."""
    exploded = df.select(*by, F.explode(tokens).alias("token"))
    return exploded.groupBy(*by, F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def top(counted: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent tokens, overall or per group; the token decides between equal counts."""
    order = [F.col("n").desc(), F.col("token")]
    if not by:
        return counted.orderBy(*order).limit(k)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def prune_vocab(counted: DataFrame, stop_words: DataFrame, min_count: int = 10, drop: Sequence[str] = ("+",)) -> DataFrame:
    """Tokens seen at least ``min_count`` times that are neither stop words (column ``token``) nor in ``drop``."""
    frequent = counted.filter((F.col("n") >= min_count) & ~F.col("token").isin(list(drop)))
    return frequent.join(stop_words.select(F.lower("token").alias("token")).distinct(), "token", "left_anti")
