"""Monthly snapshot tables of the customer-product graph."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import snapshots
from trendloom.plans.base import LINES, items, lines, orders_at, tidy, tidy_sql, with_country
from trendloom.plans.customers import LINE_ORDER
from trendloom.plans.registry import query
from trendloom.session import widen
from trendloom.sources.files import table
from trendloom.sources.work import store

#: Months that a target covers, months before the first snapshot, and snapshots behind the last one used for scaling.
AHEAD, HISTORY, TAIL = 3, 3, 3

# The month of the last event is taken as partial and left out; a snapshot has a whole target after it.
_BASE = f"""{LINES}, cal AS (SELECT min(year(ts) * 12 + month(ts) - 1) + {HISTORY} AS first,
    max(year(ts) * 12 + month(ts) - 1) - 1 - {AHEAD} AS last, date_trunc('month', max(ts)) AS stop FROM lines),
  l AS (SELECT *, year(ts) * 12 + month(ts) - 1 AS m FROM lines WHERE ts < (SELECT stop FROM cal)),
  snap AS (SELECT m, make_date(m // 12, m % 12 + 1, 1) AS snapshot FROM (SELECT unnest(range((SELECT first FROM cal), (SELECT last + 1 FROM cal))) AS m))"""
_MONTH = "(SELECT make_date((last - {k}) // 12, (last - {k}) % 12 + 1, 1) FROM cal)"


class Span(NamedTuple):
    """First and last snapshot month, as years times 12 plus months from 0, and the end of the lines used."""

    first: int
    last: int
    stop: datetime

    def month(self, back: int) -> str:
        m = self.last - back
        return f"{m // 12}-{m % 12 + 1:02d}-01"


def span(spark: SparkSession, sf: str) -> Span:
    """The snapshots that the lines allow, whatever time they cover."""
    widen(spark, table(spark, sf, "lineitem").count())
    seen = lines(spark, sf).agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, high = (t.year * 12 + t.month - 1 for t in (seen["low"], seen["high"]))
    return Span(low + HISTORY, high - 1 - AHEAD, seen["high"].replace(day=1, hour=0, minute=0, second=0, microsecond=0))


def _lines(spark: SparkSession, sf: str, at: Span) -> DataFrame:
    return lines(spark, sf).filter(F.col("ts") < F.lit(at.stop).cast("timestamp_ntz"))


def customer_table(spark: SparkSession, sf: str, at: Span | None = None) -> DataFrame:
    at = at or span(spark, sf)
    # Orders have their country before they meet their lines, which then lie with their order.
    heads = with_country(orders_at(spark, sf).filter(F.col("ts") < F.lit(at.stop).cast("timestamp_ntz")), spark, sf)
    named = items(spark, sf).drop("price").join(heads, "invoice").withColumn("price", F.col("amount") / F.col("quantity"))
    return snapshots.customer_nodes(named, LINE_ORDER, at.first, at.last, AHEAD)


_NODES = f"""{_BASE}, o AS (SELECT invoice, customer, m, min(ts) AS ts, min(ts)::date AS ds, sum(amount) AS amount,
    count(DISTINCT product) AS np, CASE WHEN hour(min(ts)) < 12 THEN 'morning' WHEN hour(min(ts)) < 18 THEN 'afternoon'
    ELSE 'evening' END AS part FROM l GROUP BY 1, 2, 3),
  hist AS (SELECT s.m, customer, avg(np) AS unique_per_order, count(DISTINCT ds) AS frequency, min(ds) AS d0, max(ds) AS d1,
    sum(amount) / count(DISTINCT ds) AS monetary_value, count_if(part = 'afternoon') AS a, count_if(part = 'evening') AS e,
    count_if(part = 'morning') AS mo FROM snap s JOIN o ON o.m <= s.m GROUP BY 1, 2),
  items AS (SELECT s.m, customer, count(*) AS n_unique_items FROM snap s
    JOIN (SELECT customer, product, min(m) AS m FROM l GROUP BY 1, 2) f ON f.m <= s.m GROUP BY 1, 2),
  rev AS (SELECT m, customer, sum(amount) AS revenue FROM l GROUP BY 1, 2),
  grid AS (SELECT s.m, s.snapshot, c.customer FROM snap s, (SELECT DISTINCT customer FROM l) c),
  fut AS (SELECT s.m, customer, sum(revenue) AS target FROM snap s JOIN rev r ON r.m > s.m AND r.m <= s.m + {AHEAD} GROUP BY 1, 2),
  nodes AS (SELECT g.snapshot, g.customer, h.customer IS NOT NULL AS active,
    CASE WHEN h.customer IS NULL THEN 0.0 ELSE coalesce(r1.revenue, 0.0) END AS lag1_revenue,
    CASE WHEN h.customer IS NULL THEN 0.0 ELSE coalesce(r2.revenue, 0.0) END AS lag2_revenue,
    CASE WHEN h.customer IS NULL THEN 0.0 ELSE coalesce(r3.revenue, 0.0) END AS lag3_revenue,
    coalesce(unique_per_order, 0.0) AS unique_per_order, coalesce(n_unique_items, 0) AS n_unique_items,
    coalesce(a >= e AND a >= mo, false)::bigint AS in_afternoon,
    coalesce(e > a AND e >= mo, false)::bigint AS in_evening, coalesce(mo > a AND mo > e, false)::bigint AS in_morning,
    coalesce(frequency, 0) AS frequency, coalesce(date_diff('day', d0, d1), 0) AS recency,
    coalesce(date_diff('day', d0, last_day(g.snapshot)), 0) AS "T", coalesce(monetary_value, 0.0) AS monetary_value,
    coalesce(date_diff('day', d0, d1) / frequency, 0.0) AS avg_time_between_orders,
    coalesce(date_diff('day', d1, last_day(g.snapshot)), 0) AS days_since_last_order, coalesce(target, 0.0) AS target
    FROM grid g LEFT JOIN hist h USING (m, customer) LEFT JOIN items i USING (m, customer)
    LEFT JOIN rev r1 ON r1.m = g.m - 1 AND r1.customer = g.customer LEFT JOIN rev r2 ON r2.m = g.m - 2
    AND r2.customer = g.customer LEFT JOIN rev r3 ON r3.m = g.m - 3 AND r3.customer = g.customer
    LEFT JOIN fut USING (m, customer))"""
_ROUND = {
    "lag1_revenue": 2, "lag2_revenue": 2, "lag3_revenue": 2, "unique_per_order": 6, "monetary_value": 4, "avg_time_between_orders": 6,
}


@query(
    "snapshot_nodes",
    sql=f"WITH {_NODES} SELECT * EXCLUDE (target) REPLACE ("
    + ", ".join(f"{tidy_sql(c, n)} AS {c}" for c, n in _ROUND.items())
    + ") FROM nodes",
)
def snapshot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = customer_table(spark, sf).drop("target")
    return out.withColumns({c: tidy(c, n) for c, n in _ROUND.items()})


@query("snapshot_targets", sql=f"WITH {_NODES} SELECT snapshot, customer, active, round(target, 2) AS y FROM nodes")
def snapshot_targets(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.targets(customer_table(spark, sf)).withColumn("y", F.round("y", 2))


@query(
    "snapshot_self_loops",
    sql=f"WITH {_NODES} SELECT snapshot, customer AS src, customer AS dst, 1.0::double AS weight FROM nodes WHERE active",
)
def snapshot_self_loops(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.self_loops(customer_table(spark, sf))


@query(
    "snapshot_products",
    sql=f"""WITH {_BASE}, h AS (SELECT s.m, product, sum(quantity) AS quantity, sum(amount) AS revenue, avg(price) AS price,
      count(DISTINCT customer) AS n_buyers FROM snap s JOIN l ON l.m <= s.m GROUP BY 1, 2)
    SELECT snapshot, p.product, h.product IS NOT NULL AS active, coalesce(quantity, 0.0) AS quantity,
      round(coalesce(revenue, 0.0), 2) AS revenue, {tidy_sql('coalesce(price, 0.0)', 4)} AS price, coalesce(n_buyers, 0) AS n_buyers
    FROM snap s CROSS JOIN (SELECT DISTINCT product FROM l) p LEFT JOIN h ON h.m = s.m AND h.product = p.product""",
)
def snapshot_products(spark: SparkSession, sf: str) -> DataFrame:
    at = span(spark, sf)
    out = snapshots.product_nodes(_lines(spark, sf, at), at.first, at.last)
    return out.withColumns({"revenue": F.round("revenue", 2), "price": tidy("price", 4)})


_EDGES = f"""{_BASE}, k AS (SELECT customer, product, m, max(ts) AS late FROM l WHERE m <= (SELECT last FROM cal) GROUP BY 1, 2, 3),
  v AS (SELECT k.customer, k.product, k.m, coalesce(lead(k.m) OVER (PARTITION BY k.customer, k.product ORDER BY k.m) - 1,
    (SELECT last FROM cal)) AS u, k.late FROM k),
  a AS (SELECT v.customer, v.product, v.m, v.u, v.late, avg(l.price) AS price, sum(l.quantity) AS quantity
    FROM v JOIN l ON l.customer = v.customer AND l.product = v.product AND l.m <= v.m GROUP BY ALL),
  versions AS (SELECT customer, product, make_date(m // 12, m % 12 + 1, 1) AS valid_from,
    make_date(u // 12, u % 12 + 1, 1) AS valid_to, {tidy_sql('price', 4)} AS price, quantity,
    round(sin(2 * pi() * (isodow(late) - 1) / 7), 6) AS day_sin, round(cos(2 * pi() * (isodow(late) - 1) / 7), 6) AS day_cos
    FROM a)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    at = span(spark, sf)
    out = snapshots.edge_versions(_lines(spark, sf, at), at.last)
    return out.withColumns({"price": tidy("price", 4), **{c: F.round(c, 6) for c in ("day_sin", "day_cos")}})


@query("snapshot_edges", sql=f"WITH {_EDGES} SELECT * FROM versions")
def snapshot_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf)


@query(
    "snapshot_edges_at",
    sql=f"""WITH {_EDGES} SELECT * EXCLUDE (valid_from, valid_to) FROM versions
    WHERE {_MONTH.format(k=10)} BETWEEN valid_from AND valid_to""",
)
def snapshot_edges_at(spark: SparkSession, sf: str) -> DataFrame:
    """The edge set of the snapshot ten months before the last one."""
    return snapshots.edges_at(_versions(spark, sf), span(spark, sf).month(10))


_NUM = snapshots.CUSTOMER_NUMERIC
_STATS = ", ".join(f'avg("{c}") AS m_{c}, stddev_pop("{c}") AS s_{c}' for c in _NUM)
_SCALED = ", ".join(
    f'round(CASE WHEN active THEN ("{c}" - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END ELSE "{c}" END, 5) AS "{c}"'
    for c in _NUM
)


# Running sums over the months of a customer: no month meets the months before it.
_RUN = "OVER (PARTITION BY c.customer ORDER BY g.m)"
_RUNNING = f"""{_BASE}, months AS (SELECT unnest(range((SELECT min(m) FROM l), (SELECT last + 1 FROM cal))) AS m),
  o AS (SELECT invoice, customer, m, min(ts)::date AS ds, sum(amount) AS amount, count(DISTINCT product) AS np,
    CASE WHEN hour(min(ts)) < 12 THEN 'morning' WHEN hour(min(ts)) < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM l GROUP BY 1, 2, 3),
  om AS (SELECT customer, m, count(*) AS n, sum(np) AS np, count(DISTINCT ds) AS days, sum(amount) AS amount, min(ds) AS d0, max(ds) AS d1,
    count_if(part = 'afternoon') AS a, count_if(part = 'evening') AS e, count_if(part = 'morning') AS mo FROM o GROUP BY 1, 2),
  im AS (SELECT customer, m, count(*) AS items FROM (SELECT customer, product, min(m) AS m FROM l GROUP BY 1, 2) GROUP BY 1, 2),
  run AS (SELECT c.customer, g.m, sum(n) {_RUN} AS n, sum(np) {_RUN} AS np, sum(days) {_RUN} AS days, sum(om.amount) {_RUN} AS spent,
    min(d0) {_RUN} AS d0, max(d1) {_RUN} AS d1, sum(a) {_RUN} AS a, sum(e) {_RUN} AS e, sum(mo) {_RUN} AS mo, sum(items) {_RUN} AS items,
    {", ".join(f"lag(om.amount, {k}) {_RUN} AS r{k}" for k in (1, 2, 3))}
    FROM months g CROSS JOIN (SELECT DISTINCT customer FROM l) c LEFT JOIN om ON om.customer = c.customer AND om.m = g.m
    LEFT JOIN im ON im.customer = c.customer AND im.m = g.m),
  nodes AS MATERIALIZED (SELECT make_date(m // 12, m % 12 + 1, 1) AS snapshot, customer, n IS NOT NULL AS active,
    {", ".join(f"CASE WHEN n IS NULL THEN 0.0 ELSE coalesce(r{k}, 0.0) END AS lag{k}_revenue" for k in (1, 2, 3))},
    coalesce(np / n, 0.0) AS unique_per_order, coalesce(items, 0)::bigint AS n_unique_items,
    coalesce(a >= e AND a >= mo, false)::bigint AS in_afternoon, coalesce(e > a AND e >= mo, false)::bigint AS in_evening,
    coalesce(mo > a AND mo > e, false)::bigint AS in_morning, coalesce(days, 0)::bigint AS frequency,
    coalesce(date_diff('day', d0, d1), 0) AS recency, coalesce(date_diff('day', d0, last_day(make_date(m // 12, m % 12 + 1, 1))), 0) AS "T",
    coalesce(spent / days, 0.0) AS monetary_value, coalesce(date_diff('day', d0, d1) / days, 0.0) AS avg_time_between_orders,
    coalesce(date_diff('day', d1, last_day(make_date(m // 12, m % 12 + 1, 1))), 0) AS days_since_last_order
    FROM run WHERE m >= (SELECT first FROM cal))"""


@query(
    "snapshot_scaled",
    sql=f"""WITH {_RUNNING}, st AS (SELECT {_STATS} FROM nodes WHERE active AND snapshot <= {_MONTH.format(k=TAIL)})
    SELECT snapshot, customer, active, {_SCALED} FROM nodes, st""",
)
def snapshot_scaled(spark: SparkSession, sf: str) -> DataFrame:
    at = span(spark, sf)
    nodes = store(customer_table(spark, sf, at).drop("target"), "customer-nodes", "zstd")
    scaled = snapshots.scale_customers(nodes, at.month(TAIL))
    return scaled.withColumns({c: F.round(c, 5) for c in _NUM})


_PNUM = snapshots.PRODUCT_NUMERIC
_PSTATS = ", ".join(f'avg("{c}") AS m_{c}, stddev_pop("{c}") AS s_{c}' for c in _PNUM)
_PSCALED = ", ".join(f'round(("{c}" - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 5) AS "{c}"' for c in _PNUM)


_PRUN = "OVER (PARTITION BY p.product ORDER BY g.m)"


@query(
    "snapshot_scaled_products",
    sql=f"""WITH {_BASE}, months AS (SELECT unnest(range((SELECT min(m) FROM l), (SELECT last + 1 FROM cal))) AS m),
    pm AS (SELECT product, m, sum(quantity) AS quantity, sum(amount) AS revenue, sum(price) AS price, count(*) AS n FROM l GROUP BY 1, 2),
    bm AS (SELECT product, m, count(*) AS buyers FROM (SELECT customer, product, min(m) AS m FROM l GROUP BY 1, 2) GROUP BY 1, 2),
    run AS (SELECT p.product, g.m, sum(quantity) {_PRUN} AS quantity, sum(revenue) {_PRUN} AS revenue, sum(price) {_PRUN} AS price,
      sum(n) {_PRUN} AS n, sum(buyers) {_PRUN} AS n_buyers FROM months g CROSS JOIN (SELECT DISTINCT product FROM l) p
      LEFT JOIN pm ON pm.product = p.product AND pm.m = g.m LEFT JOIN bm ON bm.product = p.product AND bm.m = g.m),
    nodes AS MATERIALIZED (SELECT make_date(m // 12, m % 12 + 1, 1) AS snapshot, product, n IS NOT NULL AS active, coalesce(quantity, 0.0) AS quantity,
      coalesce(revenue, 0.0) AS revenue, coalesce(price / n, 0.0) AS price, coalesce(n_buyers, 0)::bigint AS n_buyers
      FROM run WHERE m >= (SELECT first FROM cal)),
    st AS (SELECT {_PSTATS} FROM nodes WHERE snapshot <= {_MONTH.format(k=TAIL)})
    SELECT snapshot, product, active, {_PSCALED} FROM nodes, st""",
)
def snapshot_scaled_products(spark: SparkSession, sf: str) -> DataFrame:
    at = span(spark, sf)
    nodes = store(snapshots.product_nodes(_lines(spark, sf, at), at.first, at.last), "product-nodes")
    return snapshots.scale_products(nodes, at.month(TAIL)).withColumns({c: F.round(c, 5) for c in _PNUM})


@query(
    "snapshot_split",
    sql=f"""WITH {_NODES} SELECT CASE WHEN snapshot = {_MONTH.format(k=0)} THEN 'test' WHEN snapshot >= {_MONTH.format(k=2)}
    THEN 'valid' ELSE 'train' END AS part, count(*) AS n, count_if(active)::bigint AS n_active FROM nodes GROUP BY 1""",
)
def snapshot_split(spark: SparkSession, sf: str) -> DataFrame:
    at = span(spark, sf)
    months = [f"{m // 12}-{m % 12 + 1:02d}-01" for m in range(at.first, at.last + 1)]
    parts = snapshots.split(customer_table(spark, sf, at), months)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("active")).alias("n_active"))
