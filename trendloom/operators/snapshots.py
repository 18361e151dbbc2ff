"""Monthly customer-product graph snapshots as long tables.

Every history feature is cumulative, so it comes from monthly partial aggregates and a running window per node over at
most one row per month. No snapshot rescans the lines before it, and distinct counts use the month a pair is first seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import dates
from trendloom.operators import features, rfm
from trendloom.session import parts_for
from trendloom.sources.work import store

PARTS = ("afternoon", "evening", "morning")
CUSTOMER_NUMERIC = [
    "lag1_revenue", "lag2_revenue", "lag3_revenue", "unique_per_order", "n_unique_items", "in_afternoon", "in_evening",
    "in_morning", "frequency", "recency", "T", "monetary_value", "avg_time_between_orders", "days_since_last_order",
]
PRODUCT_NUMERIC = ["quantity", "revenue", "price", "n_buyers"]
EDGE_NUMERIC = ["price", "quantity", "day_sin", "day_cos"]



def _first_pairs(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer", "product").agg(F.min("m").alias("m"))


def _least(ids: DataFrame, first: int) -> int:
    """The first month of any line, or the first snapshot month if that is earlier."""
    seen = ids.agg(F.min("_first_m")).first()[0]
    return first if seen is None else min(seen, first)


def _moved_months(parts: DataFrame, node: str, months: Column, n: int) -> DataFrame:
    """Parts of months beside their node in ``n`` partitions; a row marked ``_grid`` becomes one for each month."""
    moved = parts.repartition(n, node)
    spread = F.when(F.col("_grid"), months).otherwise(F.array("m"))
    return moved.withColumn("m", F.explode(spread)).drop("_grid")


def _monthly(lines: DataFrame) -> DataFrame:
    return lines.withColumn("m", dates.month_number("ts"))


def customer_nodes(lines: DataFrame, line_order: Sequence[str], first: int, last: int, target_months: int = 3) -> DataFrame:
    """Customer features, activity flag and later revenue of every customer at the end of each month first..last.

    Features use months up to the snapshot month, the target the ``target_months`` months after it. Customers not yet
    active get zeros and ``active`` false. The target of the last snapshots is whole only if the lines reach
    ``last`` + ``target_months``.
    """
    lines = _monthly(lines)
    stop = last + target_months
    # Lines are wide and many; what is asked of them is kept per order and per month, and they move no more after that.
    order_df = rfm.orders(lines, line_order, attributes=True).withColumn("m", dates.month_number("ts"))
    order_df = store(order_df.select("customer", "m", "ds", "amount", "n_products", "time_of_day"), "customer-orders", "zstd")
    spend = rfm.daily_spend(order_df).withColumn("m", dates.month_number("ds"))
    revenue_m = lines.groupBy("customer", "m").agg(F.sum("amount").alias("revenue"))
    revenue_m = store(revenue_m, "customer-months", "zstd")
    ids = store(revenue_m.groupBy("customer").agg(F.min("m").alias("_first_m")), "customer-ids", "zstd")
    low = _least(ids, first)
    months = F.sequence(F.lit(low).cast("long"), F.lit(stop).cast("long"))

    orders_m = order_df.groupBy("customer", "m").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("n_products").alias("n_products"),
        *[F.count_if(F.col("time_of_day") == p).alias(p) for p in PARTS],
    )
    days_m = spend.groupBy("customer", "m").agg(
        F.count(F.lit(1)).alias("days"), F.sum("amount").alias("amount"), F.min("ds").alias("d0"), F.max("ds").alias("d1")
    )
    items_m = _first_pairs(lines).groupBy("customer", "m").agg(F.count(F.lit(1)).alias("items"))

    # One grouping brings the customers and the monthly parts together; no join. It and the windows share one shuffle, whose
    # partitions grow with the grid; the months of a customer are laid out only there.
    parts = ids.select("customer", F.lit(True).alias("_grid"))
    for frame in (orders_m, days_m, revenue_m, items_m):
        parts = parts.unionByName(frame, allowMissingColumns=True)
    parts = _moved_months(parts, "customer", months, parts_for(lines.sparkSession, ids.count() * (stop - low + 1)))
    counted = ["n_orders", "n_products", *PARTS, "days", "amount", "revenue", "items"]
    merged = parts.groupBy("customer", "m").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted], F.min("d0").alias("d0"), F.max("d1").alias("d1")
    )
    by = Window.partitionBy("customer").orderBy("m")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    cum = merged.select(
        "customer",
        "m",
        *[F.sum(c).over(run).alias(c) for c in counted if c != "revenue"],
        F.min("d0").over(run).alias("d0"),
        F.max("d1").over(run).alias("d1"),
        *[F.coalesce(F.lag("revenue", k).over(by), F.lit(0.0)).alias(f"lag{k}_revenue") for k in (1, 2, 3)],
        F.coalesce(F.sum("revenue").over(by.rowsBetween(1, target_months)), F.lit(0.0)).alias("target"),
    ).filter(F.col("m").between(first, last))

    most = F.greatest(*PARTS)
    usual = F.when(F.col("afternoon") == most, "afternoon").when(F.col("evening") == most, "evening").otherwise("morning")
    active = F.col("n_orders") > 0
    end = F.last_day(dates.month_start(F.col("m")))
    recency = F.date_diff("d1", "d0").cast("long")
    age = F.date_diff(end, F.col("d0")).cast("long")

    def known(c: Column) -> Column:
        return F.coalesce(F.when(active, c), F.lit(0))

    return cum.select(
        F.to_date(dates.month_start(F.col("m"))).alias("snapshot"),
        "customer",
        active.alias("active"),
        *[known(F.col(f"lag{k}_revenue")).alias(f"lag{k}_revenue") for k in (1, 2, 3)],
        known(F.try_divide("n_products", "n_orders")).alias("unique_per_order"),
        known(F.col("items")).alias("n_unique_items"),
        *[known((usual == p).cast("long")).alias(f"in_{p}") for p in PARTS],
        known(F.col("days")).alias("frequency"),
        known(recency).alias("recency"),
        known(age).alias("T"),
        known(F.try_divide("amount", "days")).alias("monetary_value"),
        known(F.try_divide(recency, F.col("days"))).alias("avg_time_between_orders"),
        known(age - recency).alias("days_since_last_order"),
        F.col("target"),
    )


def product_nodes(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Cumulative quantity, revenue, mean line price and distinct buyers of every product at each month first..last."""
    lines = _monthly(lines)
    ids = store(lines.groupBy("product").agg(F.min("m").alias("_first_m")), "product-ids")
    low = _least(ids, first)
    months = F.sequence(F.lit(low).cast("long"), F.lit(last).cast("long"))
    sums_m = lines.filter(F.col("m") <= last).groupBy("product", "m").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("amount").alias("revenue"),
        F.sum("price").alias("price_sum"),
        F.count(F.lit(1)).alias("n"),
    )
    pairs = _first_pairs(lines).filter(F.col("m") <= last)
    buyers_m = pairs.groupBy("product", "m").agg(F.count(F.lit(1)).alias("n_buyers"))
    parts = ids.select("product", F.lit(True).alias("_grid"))
    for frame in (sums_m, buyers_m):
        parts = parts.unionByName(frame, allowMissingColumns=True)
    parts = _moved_months(parts, "product", months, parts_for(lines.sparkSession, ids.count() * (last - low + 1)))
    counted = ["quantity", "revenue", "price_sum", "n", "n_buyers"]
    merged = parts.groupBy("product", "m").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted])
    run = Window.partitionBy("product").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    cum = merged.select("product", "m", *[F.sum(c).over(run).alias(c) for c in counted]).filter(F.col("m") >= first)
    return cum.select(
        F.to_date(dates.month_start(F.col("m"))).alias("snapshot"),
        "product",
        (F.col("n") > 0).alias("active"),
        "quantity",
        "revenue",
        F.coalesce(F.try_divide("price_sum", "n"), F.lit(0.0)).alias("price"),
        "n_buyers",
    )


def edge_versions(lines: DataFrame, last: int) -> DataFrame:
    """Purchase edges with cumulative attributes, one row per change: a version holds from ``valid_from`` to ``valid_to``.

    A snapshot's edge set is the versions valid in its month, so unchanged edges are not written out month after month.
    """
    lines = _monthly(lines).filter(F.col("m") <= last)
    sine, cosine = dates.cycle(F.weekday("ts"), 7)
    latest = F.max(F.struct("ts", sine.alias("day_sin"), cosine.alias("day_cos"))).alias("_late")
    monthly = lines.groupBy("customer", "product", "m").agg(
        F.sum("price").alias("price_sum"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), latest
    )
    by = Window.partitionBy("customer", "product").orderBy("m")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("m").over(by) - 1, F.lit(last).cast("long"))
    return monthly.select(
        "customer",
        "product",
        F.to_date(dates.month_start(F.col("m"))).alias("valid_from"),
        F.to_date(dates.month_start(until)).alias("valid_to"),
        (F.sum("price_sum").over(run) / F.sum("n").over(run)).alias("price"),
        F.sum("quantity").over(run).alias("quantity"),
        F.col("_late.day_sin").alias("day_sin"),
        F.col("_late.day_cos").alias("day_cos"),
    )


def edges_at(versions: DataFrame, month: str) -> DataFrame:
    at = F.lit(month).cast("date")
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to") >= at)).drop("valid_from", "valid_to")


def self_loops(nodes: DataFrame) -> DataFrame:
    """Weight-1 edges from each active customer to itself."""
    return nodes.filter("active").select(
        "snapshot", F.col("customer").alias("src"), F.col("customer").alias("dst"), F.lit(1.0).alias("weight")
    )


def targets(nodes: DataFrame) -> DataFrame:
    return nodes.select("snapshot", "customer", "active", F.col("target").alias("y"))


def split(nodes: DataFrame, months: Sequence[str]) -> DataFrame:
    """All but the last three of the given snapshot months train, the last one tests, the two between validate."""
    ordered = sorted(months)
    place = F.when(F.col("snapshot") == F.lit(ordered[-1]).cast("date"), "test")
    place = place.when(F.col("snapshot") >= F.lit(ordered[-3]).cast("date"), "valid").otherwise("train")
    return nodes.withColumn("part", place)


def scale_customers(nodes: DataFrame, train_until: str) -> DataFrame:
    """Standardise active customers with statistics of the active training rows only."""
    train = F.col("active") & (F.col("snapshot") <= F.lit(train_until).cast("date"))
    scaler = features.fit_scaler(nodes, CUSTOMER_NUMERIC, train)
    as_double = nodes.withColumns({c: F.col(c).cast("double") for c in CUSTOMER_NUMERIC})
    return features.apply_scaler(as_double, scaler, CUSTOMER_NUMERIC, F.col("active"))


def scale_products(nodes: DataFrame, train_until: str) -> DataFrame:
    """Standardise every product row with statistics of all training rows, inactive ones included."""
    train = F.col("snapshot") <= F.lit(train_until).cast("date")
    scaler = features.fit_scaler(nodes, PRODUCT_NUMERIC, train)
    as_double = nodes.withColumns({c: F.col(c).cast("double") for c in PRODUCT_NUMERIC})
    return features.apply_scaler(as_double, scaler, PRODUCT_NUMERIC)
