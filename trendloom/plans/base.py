"""Base tables shared by the registered queries, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import panel
from trendloom.sources.files import table


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per nation and day: (entity, ds, y)."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("entity"))
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return panel.daily_counts(rows, "entity", F.to_date("o_orderdate"))


DAILY = """daily AS (SELECT c_nationkey::bigint AS entity, o_orderdate::date AS ds, count(*)::bigint AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

# An order carries a date only; its clock time is derived from the order key so that time-of-day logic has work to do.
CLOCK = 7919


def orders_at(spark: SparkSession, sf: str) -> DataFrame:
    seconds = ((F.col("o_orderkey") * CLOCK) % 86400).cast("decimal(18,6)")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("invoice"),
        F.col("o_custkey").alias("customer"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("ts"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """The lines without what their order says: invoice, line, product, supplier, quantity, price, amount, returned."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("invoice"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice lines: invoice, customer, ts, product, quantity, price, amount and the line's other columns."""
    return items(spark, sf).join(orders_at(spark, sf), "invoice")


def with_country(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), "c_nationkey")
    named = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select("customer", "country")
    return df.join(named, "customer")


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("description"))


def with_description(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return df.join(descriptions(spark, sf), "product")


LINES = f"""lines AS (SELECT l_orderkey AS invoice, l_linenumber::bigint AS line, l_partkey AS product,
  l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS amount, l_returnflag = 'R' AS returned,
  o_custkey AS customer, o_orderdate + to_seconds((o_orderkey * {CLOCK}) % 86400) AS ts,
  n_name AS country, p_name AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def tidy(name: str, places: int) -> Column:
    """Round for comparison. Means of money amounts often end on a half, so they are first moved off it a little."""
    return F.round(F.col(name) + float(f"3e-{places + 3}"), places).alias(name)


def tidy_sql(expr: str, places: int) -> str:
    return f"round({expr} + 3e-{places + 3}, {places})"


def spread(df: DataFrame, col: str, n: int, places: int) -> DataFrame:
    """A fixed-length vector as n rounded columns."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.round(F.col(col)[j], places).alias(f"{col}_{j}") for j in range(n)])


def spread_sql(col: str, n: int, places: int) -> str:
    return ", ".join(f"round({col}[{j + 1}], {places}) AS {col}_{j}" for j in range(n))
