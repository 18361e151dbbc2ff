"""Connected components by alternating large and small stars (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.sources.work import store


#: Links that one task holds and joins by itself (16 bytes each); more are joined by rounds over all tasks.
LOCAL_LINKS = 2_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a list of links, and the smallest node that each can reach."""
    nodes, spot = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(spot, 2)
    low = np.arange(len(nodes))
    while len(x):
        least = np.minimum(low[x], low[y])
        before = low.copy()
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        while (low[low] != low).any():
            low = low[low]
        if (low == before).all():
            break
    return nodes, nodes[low]


def _by_one_task(edges: DataFrame) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in found]
        if rows:
            nodes, low = joined(*map(np.concatenate, zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], ["node", "component"])

    return store(edges.coalesce(1).mapInArrow(run, "node long, component long"), "joined")


def _print(edges: DataFrame):
    """Count and hash sum of an edge table; equal for equal tables."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL_LINKS) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node with a link to another.

    Up to ``local`` links, counted first, are joined by one task; the result is the same. Beyond, both stars replace edges by edges
    to a neighbourhood's smallest node, without changing what is connected; minima are pre-aggregated, and a hub is a hot key
    of a plain join, which adaptive execution splits. Each round is written to the shared folder, so a lost executor costs one
    round at most. Rounds grow with the logarithm of the longest chain.
    """
    edges = store(
        links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).filter("a <> b").distinct(),
        "links",
    )
    seen = _print(edges)
    if seen[0] <= local:
        return _by_one_task(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = store(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(
            least.select("a", F.col("m").alias("b"))
        )
        edges = store(small.distinct(), "small-star")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
