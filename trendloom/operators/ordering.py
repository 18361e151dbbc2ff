"""Global order without a single-task window.

Rows are range-partitioned on the whole order key, so a hot leading value is split between partitions. What then
travels between partitions is one row per partition (row counts or sums), never data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.sources.work import settle

_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def range_split(
    df: DataFrame, order: Sequence[str | Column], parts: int | None = None, keep: Callable[[DataFrame], DataFrame] = settle
) -> DataFrame:
    """Add ``_part`` (ascending range partition) and ``_row`` (0-based place inside it).

    The layout is kept in the work folder (checkpointed, or by ``keep``): a second run of the range sampling could cut
    elsewhere, and both passes over the result must see the same cuts.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return (
        keep(laid)
        .withColumn("_part", F.shiftright("_slot", _PART_BITS))
        .withColumn("_row", F.col("_slot").bitwiseAND((1 << _PART_BITS) - 1))
        .drop("_slot")
    )


def _before(per_part: DataFrame, names: Sequence[str]) -> DataFrame:
    # One row per partition: the unpartitioned window here is bounded by the partition count.
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_base_{c}") for c in names])


def global_index(
    df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0, parts: int | None = None
) -> DataFrame:
    """Dense row number over the whole table in the given order."""
    laid = range_split(df, order, parts)
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = F.broadcast(_before(sizes, ["n"]))
    return (
        laid.join(base, "_part")
        .withColumn(name, F.col("_base_n") + F.col("_row") + F.lit(start).cast("long"))
        .drop("_part", "_row", "_base_n")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    totals: Mapping[str, str],
    parts: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = settle,
) -> DataFrame:
    """Running sums (row included) over the whole table; ``totals`` maps a new column to the summed one."""
    laid = range_split(df, order, parts, keep)
    laid = laid.repartition(parts, "_part") if parts else laid
    local = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    sums = laid.groupBy("_part").agg(*[F.sum(src).alias(out) for out, src in totals.items()])
    base = F.broadcast(_before(sums, list(totals)))
    within = laid.withColumns({out: F.sum(src).over(local) for out, src in totals.items()})
    return (
        within.join(base, "_part")
        .withColumns({out: F.col(out) + F.col(f"_base_{out}") for out in totals})
        .drop("_part", "_row", *[f"_base_{out}" for out in totals])
    )


def keyed_running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    totals: Mapping[str, str],
) -> DataFrame:
    """Running sums per key with a hot key cut into blocks.

    ``block`` must not decrease along ``order``. Each window sees one (key, block), a second one sees a key's block
    sums, and the two meet on (key, block), which is already the partitioning of the first.
    """
    blocked = df.withColumn("_block", block)
    spot = [*keys, "_block"]
    local = Window.partitionBy(*spot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*spot).agg(*[F.sum(src).alias(f"_sum_{out}") for out, src in totals.items()])
    base = sums.select(*spot, *[F.coalesce(F.sum(f"_sum_{o}").over(prior), F.lit(0)).alias(f"_base_{o}") for o in totals])
    within = blocked.withColumns({out: F.sum(src).over(local) for out, src in totals.items()})
    return (
        within.join(base, spot)
        .withColumns({out: F.col(out) + F.col(f"_base_{out}") for out in totals})
        .drop("_block", *[f"_base_{out}" for out in totals])
    )


def previous_in_key(df: DataFrame, keys: Sequence[str], tick: str, block: Column, name: str) -> DataFrame:
    """Previous tick of the same key; (keys, tick) must be unique. A hot key is cut into blocks of ticks."""
    blocked = df.withColumn("_block", block)
    spot = [*keys, "_block"]
    inside = Window.partitionBy(*spot).orderBy(tick)
    across = Window.partitionBy(*keys).orderBy("_block")
    ends = blocked.groupBy(*spot).agg(F.max(tick).alias("_end"))
    carry = ends.select(*spot, F.lag("_end").over(across).alias("_carry"))
    return (
        blocked.withColumn(name, F.lag(tick).over(inside))
        .join(carry, spot)
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_block", "_carry")
    )


def as_of(
    asked: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], block: Column, strict: bool = False
) -> DataFrame:
    """Each distinct (keys, at) of ``asked`` with the values of the key's newest version at or before it (``strict``: before it).

    ``versions`` has one row per (keys, at). Times asked for and versions share one running last value, so no time is paired with
    the versions before it; a hot key is cut into blocks, and what a block inherits is one row of the block before. Without an
    earlier version the values are null.
    """
    known = versions.select(*keys, at, F.struct(*values).alias("_v"), F.lit(1 if strict else 0).alias("_turn"))
    wanted = asked.select(*keys, at).distinct().select(
        *keys, at, F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), F.lit(0 if strict else 1).alias("_turn")
    )
    both = known.unionByName(wanted).withColumn("_block", block)
    spot = [*keys, "_block"]
    before = Window.partitionBy(*spot).orderBy(at, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_near", F.last("_v", ignorenulls=True).over(before)).filter(F.col("_turn") == (0 if strict else 1))
    newest = known.withColumn("_block", block).groupBy(*spot).agg(F.max(at).alias(at))
    ends = newest.join(known, [*keys, at]).select(*spot, F.col("_v").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(*spot).distinct().join(ends, spot, "left").select(
        *spot, F.last("_end", ignorenulls=True).over(earlier).alias("_far")
    )
    return found.join(carried, spot).withColumn("_v", F.coalesce("_near", "_far")).select(
        *keys, at, *[F.col("_v")[c].alias(c) for c in values]
    )


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles as one row; no task ever holds all distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, [value], {"_upto": "_n"})
    total = placed.agg(F.max("_upto")).scalar()
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value).cast("double")))

    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (total - 1)
        out += [at(F.floor(spot)).alias(f"_lo_{name}"), at(F.ceil(spot)).alias(f"_hi_{name}")]
        out.append(F.max(spot - F.floor(spot)).alias(f"_f_{name}"))
    picked = placed.agg(*out)
    return picked.select(
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ]
    )


def tile_of(index: Column, total: Column, tiles: int) -> Column:
    """1-based tile of a 0-based global index: tile sizes differ by one at most, larger tiles first."""
    k = F.lit(tiles).cast("long")
    small = F.call_function("div", total, k)
    spare = total - small * k
    edge = spare * (small + 1)
    in_large = F.call_function("div", index, small + 1)
    in_small = spare + F.call_function("div", index - edge, F.greatest(small, F.lit(1).cast("long")))
    return F.when(index < edge, in_large).otherwise(in_small) + 1
