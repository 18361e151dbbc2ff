"""Order roll-ups and recency / frequency / spend tables.

Spend is collapsed to (customer, day) first. Every later aggregate then sees at most one row per customer and day, and the
collapse itself is a map-side partial sum, so one customer holding a third of all lines costs one small partial row per
task and day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import dates


def orders(
    lines: DataFrame, line_order: Sequence[str], amount: Column | str = "amount", attributes: bool = False
) -> DataFrame:
    """One row per invoice: first customer and country in line order, total amount, first date; totals <= 0 are dropped.

    ``attributes`` adds the columns of ``order_attributes`` in the same aggregation.
    """
    place = F.struct(*line_order)
    total = F.col(amount) if isinstance(amount, str) else amount
    extra = [F.count_distinct("product").alias("n_products")] if attributes else []
    per = (
        lines.groupBy("invoice")
        .agg(
            F.min_by("customer", place).alias("customer"),
            F.sum(total).alias("amount"),
            F.min("ts").alias("ts"),
            F.min_by("country", place).alias("country"),
            *extra,
        )
        .filter(F.col("amount") > 0)
        .withColumn("ds", F.to_date("ts"))
    )
    if attributes:
        return per.withColumns(_time_columns())
    return per.select("invoice", "customer", "amount", "ds", "country")


def _time_columns() -> dict[str, Column]:
    sine, cosine = dates.cycle(F.weekday("ts"), 7)
    return {
        "month": F.to_date(F.trunc("ts", "MM")),
        "day_of_week": F.weekday("ts").cast("long"),
        "day_sin": sine,
        "day_cos": cosine,
        "time_of_day": dates.day_part("ts"),
    }


def order_attributes(lines: DataFrame) -> DataFrame:
    """First time stamp of an invoice with its month, weekday and weekday cycle, and its number of distinct products."""
    base = lines.groupBy("invoice").agg(F.min("ts").alias("ts"), F.count_distinct("product").alias("n_products"))
    return base.withColumns(_time_columns())


def daily_spend(orders_df: DataFrame, customer: str = "customer", ds: str = "ds", amount: str = "amount") -> DataFrame:
    return orders_df.groupBy(F.col(customer).alias("customer"), F.col(ds).alias("ds")).agg(
        F.sum(amount).alias("amount")
    )


def _summary_columns(end: Column, include_first: bool) -> dict[str, Column]:
    days, total, first = F.col("_days"), F.col("_total"), F.col("_first")
    repeat = days if include_first else days - 1
    spend = total if include_first else total - F.col("_first_amount")
    return {
        "frequency": repeat.cast("long"),
        "recency": F.date_diff(F.col("_last"), first).cast("long"),
        "T": F.date_diff(end, first).cast("long"),
        "monetary_value": F.when(repeat > 0, spend / repeat).otherwise(0.0),
    }


def summary(spend: DataFrame, end: str | date, include_first: bool = False) -> DataFrame:
    """Frequency (active days, less the first unless included), recency (last - first), T (end - first), mean day spend."""
    last = F.lit(end).cast("date")
    per = (
        spend.filter(F.col("ds") <= last)
        .groupBy("customer")
        .agg(
            F.count(F.lit(1)).alias("_days"),
            F.sum("amount").alias("_total"),
            F.min("ds").alias("_first"),
            F.max("ds").alias("_last"),
            F.min_by("amount", "ds").alias("_first_amount"),
        )
    )
    cols = _summary_columns(last, include_first)
    return per.select("customer", *[c.alias(n) for n, c in cols.items()])


def calibration_holdout(spend: DataFrame, cut: str | date, end: str | date, spend_cap: float | None = None) -> DataFrame:
    """Summary to the cut plus active days and mean day spend in (cut, end], both halves in one aggregation.

    Customers first seen after the cut are left out. ``spend_cap`` keeps customers whose mean spend is at most the cap.
    """
    at, last = F.lit(cut).cast("date"), F.lit(end).cast("date")
    before = F.col("ds") <= at
    after = ~before
    amount, ds = F.col("amount"), F.col("ds")
    per = (
        spend.filter(ds <= last)
        .groupBy("customer")
        .agg(
            F.count_if(before).alias("_days"),
            F.sum(F.when(before, amount)).alias("_total"),
            F.min(F.when(before, ds)).alias("_first"),
            F.max(F.when(before, ds)).alias("_last"),
            F.min_by(amount, F.when(before, ds)).alias("_first_amount"),
            F.count_if(after).alias("holdout_frequency"),
            F.coalesce(F.avg(F.when(after, amount)), F.lit(0.0)).alias("holdout_monetary_value"),
        )
        .filter(F.col("_days") > 0)
    )
    cols = _summary_columns(at, False)
    out = per.select(
        "customer", *[c.alias(n) for n, c in cols.items()], "holdout_frequency", "holdout_monetary_value"
    )
    return out if spend_cap is None else out.filter(F.col("monetary_value") <= spend_cap)


def train_test(spend: DataFrame, cut: str | date, end: str | date, spend_cap: float | None = None) -> DataFrame:
    """The calibration table with the later period named as a test period."""
    return calibration_holdout(spend, cut, end, spend_cap).withColumnsRenamed(
        {"holdout_frequency": "test_frequency", "holdout_monetary_value": "test_monetary_value"}
    )


def usual_day_part(attributes: DataFrame, customer: str = "customer") -> DataFrame:
    """Most common part of the day per customer (three counts each); the first name in order on a tie."""
    return attributes.groupBy(customer).agg(F.mode("time_of_day", True).alias("usual_part"))


def customer_features(lines: DataFrame, line_order: Sequence[str], end: str | date) -> DataFrame:
    """Items per order, distinct items, usual part of the day as flags, first country, and the recency table."""
    order_df = orders(lines, line_order, attributes=True)
    per_customer = order_df.groupBy("customer").agg(
        F.avg("n_products").alias("unique_per_order"),
        F.mode("time_of_day", True).alias("_part"),
        F.min_by("country", F.struct("ts", "invoice")).alias("country"),
    )
    items = lines.groupBy("customer").agg(F.count_distinct("product").alias("n_unique_items"))
    spend = daily_spend(order_df)
    table = summary(spend, end, include_first=True)
    joined = per_customer.join(items, "customer").join(table, "customer", "left")
    flags = {f"in_{p}": (F.col("_part") == p).cast("long") for p in ("afternoon", "evening", "morning")}
    return joined.withColumns(
        {
            **flags,
            "avg_time_between_orders": F.try_divide(F.col("recency"), F.col("frequency")),
            "days_since_last_order": F.col("T") - F.col("recency"),
            "total_spend": F.col("frequency") * F.col("monetary_value"),
        }
    ).drop("_part")


def with_first_order(lines: DataFrame) -> DataFrame:
    """Attach each customer's first order time; a small per-customer table joins back, so no window holds a hot customer."""
    first = lines.groupBy("customer").agg(F.min("ts").alias("first_order"))
    return lines.join(first, "customer")


def spend_correlation(table: DataFrame) -> DataFrame:
    return table.filter("frequency > 0").agg(F.corr("monetary_value", "frequency").alias("corr"))
