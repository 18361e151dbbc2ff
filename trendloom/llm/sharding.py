"""Shards cut from a Hilbert curve over metadata.

Every dimension is quantised into cells of about equal row counts, rows are sorted by the curve index of their cell, and
the sorted rows are cut into runs. Rows that are near in all dimensions share a shard, so the ranges of each column in a
shard's files are short and readers can skip files on any of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.hilbert import hilbert_index
from trendloom.operators.ordering import global_index, range_split
from trendloom.sources.work import store


def with_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the place of a text among the table's distinct texts in byte order; ``column`` has no nulls.

    The distinct values are sorted on their own and joined back, so any two of them differ, however long they agree.
    """
    values = global_index(df.select(column).distinct(), [column], name)
    return df.join(values, column)


def curve_order(df: DataFrame, dims: Mapping[str, Column], bits: int = 8, name: str = "curve") -> DataFrame:
    """Add the Hilbert index of each row's cell.

    ``dims`` maps labels to numeric columns; null counts as 0. The cell bounds are approximate quantiles over all rows
    (at most ``2**bits - 1`` numbers per dimension), so they depend on the data only, not on its size.
    """
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    held = {f"_dim_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in dims.items()}
    wide = df.withColumns(held)
    row = wide.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in held]).first()
    bounds = [np.array(row[c] or [0.0]) for c in held]  # repeated bounds keep equal counts apart

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        cells = [np.searchsorted(b, c.to_numpy(), side="right") for b, c in zip(bounds, columns)]
        return pd.Series(hilbert_index(cells, bits))

    return wide.withColumn(name, place(*held)).drop(*held)


def cut_runs(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (0-based place in it): runs of the order, counts at most one apart.

    Row counts travel as one row per range partition; no task sees more than a range. Ties in the order are cut like any
    other rows, so a value that a third of the rows share spreads over a third of the shards.
    """
    laid = range_split(df, order)
    sizes = sorted((r["_part"], r["n"]) for r in laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    start, before = 0, []
    for part, n in sizes:
        before.append((part, start))
        start += n
    small, spare = divmod(start, shards)
    base = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _base long"))  # one row per partition
    place = F.col("_base") + F.col("_row")
    edge = spare * (small + 1)
    large = F.call_function("div", place, F.lit(small + 1).cast("long"))
    rest = F.call_function("div", place - edge, F.lit(max(small, 1)).cast("long")) + spare
    first = F.when(place < edge, large * (small + 1)).otherwise((rest - spare) * small + edge)
    return (
        laid.join(base, "_part")
        .withColumn("shard", F.when(place < edge, large).otherwise(rest).cast("int"))
        .withColumn("slot", (place - first).cast("long"))
        .drop("_part", "_row", "_base")
    )


def shard_documents(docs: DataFrame, shards: int = 24, bits: int = 8) -> DataFrame:
    """Shard documents along the curve over language, source and size; the law is ``rows``: counts differ by one at most.

    Null texts have the size 8 and the checksum of the empty text; null metadata counts as empty. Ties on the curve are
    ordered by checksum, then doc_id, so equal texts of one place stay neighbours; fully equal rows are
    interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"),
    )
    narrow = store(narrow, "shard-texts")
    for k in ("lang", "source"):
        narrow = with_rank(narrow, f"_{k}", f"_{k}_rank").drop(f"_{k}")
    dims = {"lang": F.col("_lang_rank"), "source": F.col("_source_rank"), "size": F.col("size")}
    cut = cut_runs(curve_order(store(narrow, "shard-keys"), dims, bits), ["curve", "text_crc32", "doc_id"], shards)
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(sharded: DataFrame, path: str, files: int | None = None) -> None:
    """Write rows with ``shard`` and ``slot`` below one folder per shard, each file a run of the curve."""
    n = files or int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    laid.write.partitionBy("shard").parquet(path)
