"""Queries over the timestamped customer-product interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import arrays, dates
from trendloom.functions.hashing import draw_sql
from trendloom.operators import metrics, tgraph
from trendloom.plans.base import LINES, descriptions, items, orders_at, spread, spread_sql, tidy_sql, with_country
from trendloom.plans.registry import query
from trendloom.session import widen
from trendloom.sources.files import table
from trendloom.sources.work import fingerprint, store

ORDER = ["ts", "invoice", "line", "product", "supplier", "quantity", "price"]
START = "1995-01-01"
_STORED: dict[tuple[str, str], tgraph.Interactions] = {}


def _derived() -> dict[str, Column]:
    """The price of a piece orders lines, but follows from two columns that move anyway."""
    return {"price": F.col("amount") / F.col("quantity")}


def tables(spark: SparkSession, sf: str) -> tgraph.Interactions:
    """Interactions, customers and products with 1-based ids, products after customers, written once per state of their input files."""
    used = ("orders", "lineitem", "customer", "nation", "part")
    key = (spark.sparkContext.applicationId, "|".join(fingerprint(spark, f"{sf}/{t}.parquet") for t in used))
    widen(spark, 2 * table(spark, sf, "lineitem").count())  # both ends of every line
    if key not in _STORED:
        heads = with_country(orders_at(spark, sf), spark, sf).drop("country")
        keep = ["amount", "quantity"]
        named = descriptions(spark, sf)
        found = tgraph.interaction_tables(heads, items(spark, sf), "customer", "product", ORDER, keep, named, _derived())
        raw, us, its = (store(df, label, "zstd") for df, label in zip(found[:3], ("interactions", "customers", "products")))
        last = raw.agg(F.max("u")).first()[0]
        edge = tgraph.reindex(raw.withColumnRenamed("seconds", "ts"), last_user=last)
        us = us.withColumn("u", F.col("u") + 1)
        its = its.withColumn("i", F.col("i") + F.lit(last) + 2)
        _STORED[key] = tgraph.Interactions(edge, us, its, found.start)
    return _STORED[key]


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical interaction table, read by every query; ``moment`` is the time of ``ts`` and ``price`` that of a piece."""
    found = tables(spark, sf)
    moment = dates.at_second(F.col("ts") + F.lit(found.start))
    return found.edges.withColumns({"moment": moment, **_derived()})


_FIRST = "min({'a': ts, 'b': invoice, 'c': line})"
EDGES = f"""{LINES}, cu AS (SELECT customer, row_number() OVER (ORDER BY f, customer) AS u FROM
    (SELECT customer, {_FIRST} AS f FROM lines GROUP BY customer)),
  pr AS (SELECT product, row_number() OVER (ORDER BY f, product) + (SELECT count(*) FROM cu) AS i FROM
    (SELECT product, {_FIRST} AS f FROM lines GROUP BY product)),
  edges AS (SELECT row_number() OVER (ORDER BY {", ".join(ORDER)}) AS edge_idx, u, i,
    (epoch(ts) - epoch(min(ts) OVER ()))::bigint AS ts, ts AS moment, amount, quantity, price, customer, product, country,
    description FROM lines JOIN cu USING (customer) JOIN pr USING (product))"""

FEATS = tgraph.feature_columns("amount", "quantity")
_FEAT = f"""{EDGES}, feats AS (SELECT edge_idx, u, i, ts, 1.0::double AS label,
  (amount - avg(amount) OVER ()) / stddev_pop(amount) OVER () AS amount,
  (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () AS quantity,
  sin(2 * pi() * (isodow(moment) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(moment) - 1) / 7) AS day_cos,
  {", ".join(f"(month(moment) = {m})::bigint AS month_{m}" for m in range(2, 13))} FROM edges)"""


def _featured(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.event_features(edges(spark, sf), "moment", "amount", "quantity")


@query(
    "interactions",
    sql=f"""WITH {_FEAT} SELECT edge_idx - 1 AS edge_idx, u - 1 AS u, i - 1 - (SELECT count(*) FROM cu) AS i, ts, label,
    round(amount, 6) AS amount, round(quantity, 6) AS quantity, round(day_sin, 6) AS day_sin, round(day_cos, 6) AS day_cos,
    {", ".join(f"month_{m}" for m in range(2, 13))} FROM feats""",
)
def interactions(spark: SparkSession, sf: str) -> DataFrame:
    kept = ["ts", "amount", "quantity"]
    raw = tgraph.interactions(orders_at(spark, sf), items(spark, sf), "customer", "product", ORDER, kept, derived=_derived())
    out = tgraph.event_features(raw, "ts", "amount", "quantity").drop("ts").withColumnRenamed("seconds", "ts")
    return out.withColumns({c: F.round(c, 6) for c in ("amount", "quantity", "day_sin", "day_cos")})


@query("reindex_bipartite", sql=f"WITH {EDGES} SELECT edge_idx, u, i, ts FROM edges")
def reindex_bipartite(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).select("edge_idx", "u", "i", "ts")


@query("contiguous_ids", sql=f"""WITH {EDGES} SELECT 'u' AS side, max(u) - min(u) + 1 = count(DISTINCT u) AS contiguous FROM edges
    UNION ALL SELECT 'i', max(i) - min(i) + 1 = count(DISTINCT i) FROM edges""")
def contiguous_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    sides = [tgraph.contiguous(e, s).select(F.lit(s).alias("side"), "contiguous") for s in ("u", "i")]
    return sides[0].unionByName(sides[1])


_FEAT_LIST = ", ".join(f"round({c}::double, 6) AS feat_{j}" for j, c in enumerate(FEATS))


def _bundle(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.event_bundle(_featured(spark, sf).withColumnRenamed("ts", "seconds"), FEATS)


@query("event_bundle", sql=f"WITH {_FEAT} SELECT edge_idx, u, i, ts, label, {_FEAT_LIST} FROM feats")
def event_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_bundle(spark, sf), "feat", len(FEATS), 6)


@query(
    "feature_matrix",
    sql=f"""WITH {_FEAT} SELECT edge_idx AS idx, {_FEAT_LIST} FROM feats
    UNION ALL SELECT 0, {", ".join(["0.0::double"] * len(FEATS))}""",
)
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return spread(tgraph.feature_matrix(_bundle(spark, sf), len(FEATS)), "feat", len(FEATS), 6)


_ADJ = "adj AS (SELECT u AS node, i AS other, edge_idx, ts FROM edges UNION ALL SELECT i, u, edge_idx, ts FROM edges)"


@query("adjacency", sql=f"WITH {EDGES}, {_ADJ} SELECT * FROM adj")
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.adjacency(edges(spark, sf))


def _wait_sql(side: str) -> str:
    return f"""SELECT '{side}' AS side, round(avg(d), 2) AS mean, round(stddev_pop(d), 2) AS std FROM (SELECT
    ts - coalesce(lag(ts) OVER (PARTITION BY {side} ORDER BY ts, edge_idx), 0) AS d FROM edges)"""


@query("time_stats", sql=f"WITH {EDGES} {_wait_sql('u')} UNION ALL {_wait_sql('i')}")
def time_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = tgraph.time_stats(edges(spark, sf))
    return out.select("side", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


def _encode_sql(x: str, dim: int) -> str:
    step = 9.0 / max(dim - 1, 1)
    return ", ".join(f"cos({x} * {10.0 ** (-step * j)!r}::double)" for j in range(dim))


@query(
    "time_encode",
    sql=f"""WITH {EDGES}, c AS (SELECT edge_idx, [{_encode_sql("ts", 8)}] AS code FROM edges)
    SELECT edge_idx, {spread_sql("code", 8, 6)} FROM c""",
)
def time_encode(spark: SparkSession, sf: str) -> DataFrame:
    return spread(edges(spark, sf).select("edge_idx", arrays.time_encode("ts", 8).alias("code")), "code", 8, 6)


N = 5
_Q = "q AS (SELECT edge_idx AS qid, u AS node, ts AS cut FROM edges)"
_LATEST = f"""{_Q}, {_ADJ}, found AS (SELECT q.qid, q.node, q.cut, a.other, a.edge_idx, a.ts FROM q JOIN adj a
  ON a.node = q.node AND a.ts < q.cut
  QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY a.ts DESC, a.edge_idx DESC, a.other DESC) <= {N})"""


def _queries(e: DataFrame) -> DataFrame:
    """Each edge asks for its source's past, strictly before the edge."""
    return e.select(F.col("edge_idx").alias("qid"), F.col("u").alias("node"), F.col("ts").alias("cut"))


def _pad_sql(col: str) -> str:
    inner = f"list({col} ORDER BY f.ts, f.edge_idx, f.other) FILTER (WHERE f.qid IS NOT NULL)"
    return f"list_concat(list_transform(range(0, {N} - count(f.qid)), lambda v: 0::bigint), coalesce({inner}, []::bigint[]))"


_PADDED = f"""SELECT q.qid, q.node, q.cut, array_to_string({_pad_sql("f.other")}, ',') AS neighbors,
  array_to_string({_pad_sql("f.edge_idx")}, ',') AS edges, array_to_string({_pad_sql("f.ts")}, ',') AS times FROM q LEFT JOIN found f ON f.qid = q.qid GROUP BY q.qid, q.node, q.cut"""


@query("temporal_neighbors", sql=f"WITH {EDGES}, {_LATEST} {_PADDED}")
def temporal_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    found = tgraph.temporal_neighbors(tgraph.adjacency(e), _queries(e), N, together=True)
    out = tgraph.padded_neighbors(found, _queries(e), N)
    return out.withColumns({c: F.array_join(c, ",") for c in ("neighbors", "edges", "times")})


@query(
    "neighbor_sample",
    sql=f"""WITH {EDGES}, {_Q}, {_ADJ}, ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, edge_idx, other)
      AS place FROM adj), b AS (SELECT q.qid, q.node, q.cut, count(*) AS before FROM q JOIN adj a ON a.node = q.node
      AND a.ts < q.cut GROUP BY 1, 2, 3),
    d AS (SELECT *, unnest(range(0, {N})) AS draw FROM b)
    SELECT d.qid, d.node, d.cut, d.draw, r.other, r.edge_idx, r.ts FROM d JOIN ranked r ON r.node = d.node
    AND r.place = {draw_sql(f"d.qid * {N} + d.draw", 7)} % d.before + 1""",
)
def neighbor_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    found = tgraph.temporal_neighbors(tgraph.adjacency(e), _queries(e), N, "uniform", 7)
    return found.select("qid", "node", "cut", "draw", "other", "edge_idx", "ts")


DIM = 4
_HOOD = [f"sum({c}) AS s{j}" for j, c in enumerate(["x.amount / 1000", "x.quantity"])]
_HOOD += [f"sum({c}) AS s{j + 2}" for j, c in enumerate(_encode_sql("(f.cut - f.ts)", DIM).split(", "))]
_HOOD_LIST = ", ".join(f"round(coalesce(s{j}, 0.0) + 3e-8, 5) AS vec_{j}" for j in range(DIM + 2))


@query(
    "neighborhood_features",
    sql=f"""WITH {EDGES}, {_LATEST}, s AS (SELECT f.qid, count(*) AS n, {", ".join(_HOOD)} FROM found f
      JOIN edges x ON x.edge_idx = f.edge_idx GROUP BY f.qid)
    SELECT q.qid, q.node, q.cut, coalesce(n, 0) AS n, {_HOOD_LIST} FROM q LEFT JOIN s USING (qid)""",
)
def neighborhood_features(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).withColumn("kilo", F.col("amount") / 1000)
    found = tgraph.temporal_neighbors(tgraph.adjacency(e, ["kilo", "quantity"]), _queries(e), N)
    out = tgraph.neighborhood_features(found, _queries(e), ["kilo", "quantity"], DIM)
    return spread(out.withColumn("vec", F.transform("vec", lambda v: v + 3e-8)), "vec", DIM + 2, 5)


_NEG = f"""pool AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS slot FROM (SELECT DISTINCT i FROM edges)),
  neg AS (SELECT e.edge_idx, e.u, p.i, e.ts FROM edges e JOIN pool p
    ON p.slot = {draw_sql("e.edge_idx", 0)} % (SELECT count(*) FROM pool))"""
_ENDS = f"""qe AS (SELECT edge_idx AS qid, 'source' AS side, u AS node, ts AS cut FROM edges
  UNION ALL SELECT edge_idx, 'destination', i, ts FROM edges UNION ALL SELECT edge_idx, 'negative', i, ts FROM neg)"""


def _ends(e: DataFrame, own: bool = True) -> DataFrame:
    return tgraph.both_ends(e, tgraph.negative_edges(e), own)


def _by_side(e: DataFrame) -> DataFrame:
    """Destinations and drawn destinations with a number of their own."""
    place = F.when(F.col("side") == "destination", 0).otherwise(1)
    asked = _ends(e).filter("side <> 'source'")
    return asked.withColumn("qid", F.col("qid") * 2 + place).drop("side")


_Q_ENDS = f"""q AS (SELECT qid * 2 + CASE WHEN side = 'destination' THEN 0 ELSE 1 END AS qid, node, cut FROM qe
  WHERE side <> 'source')"""


_SUMS_LIST = ", ".join(f"round(coalesce(s{j}, 0.0), 5) AS vec_{j}" for j in range(DIM + 2))


def _late(q: str) -> str:
    return _LATEST.replace(_Q, q)


@query("temporal_neighbors_ends", sql=f"WITH {EDGES}, {_NEG}, {_ENDS}, {_late(_Q_ENDS)} {_PADDED}")
def temporal_neighbors_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every edge's destination and of its drawn destination before the edge."""
    e = edges(spark, sf)
    asked = _by_side(e)
    found = tgraph.temporal_neighbors(tgraph.adjacency(e), asked, N, together=True)
    out = tgraph.padded_neighbors(found, asked, N)
    return out.withColumns({c: F.array_join(c, ",") for c in ("neighbors", "edges", "times")})


@query(
    "neighborhood_sums",
    sql=f"""WITH {EDGES}, {_NEG}, {_ENDS}, {_late(_Q_ENDS)}, s AS (SELECT f.qid, count(*) AS n, {", ".join(_HOOD)} FROM found f
      JOIN edges x ON x.edge_idx = f.edge_idx GROUP BY f.qid)
    SELECT q.qid, q.node, q.cut, coalesce(n, 0) AS n, {_SUMS_LIST} FROM q LEFT JOIN s USING (qid)""",
)
def neighborhood_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over the neighbourhoods of destinations and drawn destinations, from running sums per node."""
    e = edges(spark, sf).withColumn("kilo", F.col("amount") / 1000)
    out = tgraph.neighborhood_sums(tgraph.adjacency(e, ["kilo", "quantity"]), _by_side(e), ["kilo", "quantity"], DIM, N)
    return spread(out, "vec", DIM + 2, 5)


BATCH = 200
_BEFORE = "OVER (PARTITION BY node ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_MSG = f"""adj AS (SELECT u AS node, i AS other, edge_idx, ts, amount / 1000 AS kilo, quantity,
    (edge_idx - 1) // {BATCH} AS batch FROM edges UNION ALL SELECT i, u, edge_idx, ts, amount / 1000, quantity,
    (edge_idx - 1) // {BATCH} FROM edges),
  seen AS (SELECT node, batch, coalesce(lag(max(ts)) OVER (PARTITION BY node ORDER BY batch), 0) AS last_update,
    [coalesce(sum(count(*)) {_BEFORE}, 0)::double, coalesce(sum(sum(kilo)) {_BEFORE}, 0.0), coalesce(sum(sum(quantity)) {_BEFORE}, 0.0)]
    AS state FROM adj GROUP BY node, batch),
  msgs AS (SELECT a.batch, a.edge_idx, a.node, a.other, a.ts, a.ts - s.last_update AS dt,
    list_concat(list_concat(s.state, o.state), [kilo, quantity, {_encode_sql("(a.ts - s.last_update)", DIM)}]) AS msg
    FROM adj a JOIN seen s USING (node, batch) JOIN seen o ON o.node = a.other AND o.batch = a.batch)"""
MSG_SIZE = tgraph.message_size(["kilo", "quantity"], DIM)


def _messages(spark: SparkSession, sf: str, stay: bool = True) -> DataFrame:
    e = edges(spark, sf).withColumn("kilo", F.col("amount") / 1000)
    return tgraph.messages(e, ["kilo", "quantity"], DIM, BATCH, stay)


_MSG6 = spread_sql("msg", MSG_SIZE, 6)


@query("messages", sql=f"WITH {EDGES}, {_MSG} SELECT batch, edge_idx, node, other, ts, dt, {_MSG6} FROM msgs")
def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Own and other state at the start of the batch, edge features and the encoded time since the last update."""
    return spread(_messages(spark, sf, stay=False), "msg", MSG_SIZE, 6)


@query(
    "message_last",
    sql=f"""WITH {EDGES}, {_MSG} SELECT batch, node, {_MSG6}, ts FROM msgs
    QUALIFY row_number() OVER (PARTITION BY batch, node ORDER BY edge_idx DESC) = 1""",
)
def message_last(spark: SparkSession, sf: str) -> DataFrame:
    return spread(tgraph.aggregate_messages(_messages(spark, sf), MSG_SIZE, "last"), "msg", MSG_SIZE, 6)


@query(
    "message_mean",
    sql=f"""WITH {EDGES}, {_MSG} SELECT batch, node, max(ts) AS ts, {", ".join(tidy_sql(f"avg(msg[{j + 1}])", 5)
    + f" AS msg_{j}" for j in range(MSG_SIZE))} FROM msgs GROUP BY batch, node""",
)
def message_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = tgraph.aggregate_messages(_messages(spark, sf), MSG_SIZE, "mean")
    return spread(means.withColumn("msg", F.transform("msg", lambda v: v + 3e-8)), "msg", MSG_SIZE, 5)


@query(
    "state_versions",
    sql=f"""WITH {EDGES}, {_MSG}, p AS (SELECT node, batch, count(*) AS k, max(ts) AS last_update, sum(kilo) AS a, sum(quantity) AS b
      FROM adj GROUP BY 1, 2)
    SELECT node, batch, batch + 1 AS valid_from, lead(batch) OVER w AS valid_to, (sum(k) OVER w)::bigint AS n,
      round(sum(a) OVER w, 5) AS sum_kilo, sum(b) OVER w AS sum_quantity, last_update
    FROM p WINDOW w AS (PARTITION BY node ORDER BY batch)""",
)
def state_versions(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).withColumn("kilo", F.col("amount") / 1000)
    out = tgraph.state_versions(e, ["kilo", "quantity"], BATCH)
    return out.withColumn("sum_kilo", F.round("sum_kilo", 5))


_USUAL = f"""st AS (SELECT side, avg(d) AS m, stddev_pop(d) AS s FROM (SELECT 'u' AS side, ts - coalesce(lag(ts) OVER (PARTITION BY u
    ORDER BY ts, edge_idx), 0) AS d FROM edges UNION ALL SELECT 'i', ts - coalesce(lag(ts) OVER (PARTITION BY i
    ORDER BY ts, edge_idx), 0) FROM edges) GROUP BY side)"""


@query(
    "node_state",
    sql=f"""WITH {EDGES}, {_MSG.split("  seen AS")[0]} {_NEG}, {_ENDS}, {_USUAL},
    tick AS (SELECT node, ts, (sum(count(*)) OVER w)::bigint AS n, sum(sum(kilo)) OVER w AS k, sum(sum(quantity)) OVER w AS q
      FROM adj GROUP BY node, ts WINDOW w AS (PARTITION BY node ORDER BY ts)),
    found AS (SELECT qe.*, n, k, q, coalesce(tick.ts, 0) AS last_update, CASE WHEN side = 'source' THEN 'u' ELSE 'i' END AS part
      FROM qe ASOF LEFT JOIN tick ON tick.node = qe.node AND qe.cut > tick.ts)
    SELECT qid, f.side, node, cut, coalesce(n, 0) AS n, round(coalesce(k, 0.0), 5) AS sum_kilo, coalesce(q, 0.0) AS sum_quantity,
      last_update, round((cut - last_update - m) / s, 6) AS waited FROM found f JOIN st ON st.side = f.part""",
)
def node_state(spark: SparkSession, sf: str) -> DataFrame:
    """State of each edge's source, destination and drawn destination before the edge.

    ``waited`` is the time since the last update in deviations of the usual wait of that side.
    """
    e = edges(spark, sf).withColumn("kilo", F.col("amount") / 1000)
    stats = tgraph.time_stats(e).select(F.col("side").alias("end"), "mean", "std")
    out = tgraph.state_at(e, _ends(e, own=False), ["kilo", "quantity"], ends=True)
    end = F.when(F.col("side") == "source", "u").otherwise("i")
    waited = (F.col("cut") - F.col("last_update") - F.col("mean")) / F.col("std")
    return out.withColumn("end", end).join(F.broadcast(stats), "end").select(
        "qid", "side", "node", "cut", "n", F.round("sum_kilo", 5).alias("sum_kilo"), "sum_quantity", "last_update",
        F.round(waited, 6).alias("waited"),
    )


@query(
    "static_node_features",
    sql=f"""WITH {EDGES} SELECT u AS node, 'customer' AS kind, arg_min(country, edge_idx) AS name,
      arg_min(price, edge_idx) AS price FROM edges GROUP BY u
    UNION ALL SELECT i, 'product', arg_min(description, edge_idx), arg_min(price, edge_idx) FROM edges GROUP BY i""",
)
def static_node_features(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    found = tables(spark, sf)
    names = {
        "u": with_country(found.users, spark, sf).select(F.col("u").alias("node"), F.col("country").alias("name")),
        "i": found.destinations.select(F.col("i").alias("node"), F.col("description").alias("name")),
    }

    def side(end: str, kind: str) -> DataFrame:
        # A customer or product that its table holds twice has one of its names.
        named = names[end].groupBy("node").agg(F.min("name").alias("name"))
        first = tgraph.static_node_features(e, end, ["price"], ["edge_idx"])
        return first.join(named, "node").select("node", F.lit(kind).alias("kind"), "name", "price")

    return side("u", "customer").unionByName(side("i", "product"))


_CUTS = f"""cut AS (SELECT (epoch(e - INTERVAL 6 MONTH) - epoch(s))::bigint AS val,
  (epoch(e - INTERVAL 3 MONTH) - epoch(s))::bigint AS test FROM (SELECT TIMESTAMP '{START}' AS s,
  TIMESTAMP '{START}' + to_seconds(max(ts)) AS e FROM edges))"""
_PART = "CASE WHEN ts <= val THEN 'train' WHEN ts <= test THEN 'valid' ELSE 'test' END"


@query("split_by_time", sql=f"WITH {EDGES}, {_CUTS} SELECT edge_idx, {_PART} AS part FROM edges, cut")
def split_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.split_by_time(edges(spark, sf), START).select("edge_idx", "part")


@query(
    "split_by_quantile",
    sql=f"""WITH {EDGES}, cut AS (SELECT quantile_cont(ts, 0.70) AS val, quantile_cont(ts, 0.85) AS test FROM edges)
    SELECT edge_idx, {_PART} AS part FROM edges, cut""",
)
def split_by_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.split_by_quantile(edges(spark, sf)).select("edge_idx", "part")


_HELD = f"""{_CUTS}, nodes AS (SELECT u AS node FROM edges UNION SELECT i FROM edges),
  late AS (SELECT u AS node FROM edges, cut WHERE ts > val UNION SELECT i FROM edges, cut WHERE ts > val),
  held AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY {draw_sql("node", 2020)}, node) AS b FROM late)
    WHERE b <= (SELECT floor(0.1 * count(*)) FROM nodes))"""
_SPLIT = f"""{_HELD}, marked AS (SELECT e.*, CASE WHEN ts <= val AND (u IN (SELECT node FROM held) OR i IN (SELECT node FROM held))
    THEN 'dropped' ELSE {_PART} END AS part FROM edges e, cut),
  known AS (SELECT u AS node FROM marked WHERE part = 'train' UNION SELECT i FROM marked WHERE part = 'train'),
  parted AS (SELECT *, part IN ('valid', 'test') AND (u NOT IN (SELECT node FROM known) OR i NOT IN (SELECT node FROM known))
    AS new_node FROM marked)"""


def _inductive(spark: SparkSession, sf: str, halves: bool = False) -> DataFrame:
    e = edges(spark, sf)
    val, test = tgraph.time_cuts(e, START, 6, 3)
    return tgraph.inductive_split(e, val, test, halves=halves)


@query("inductive_split", sql=f"WITH {EDGES}, {_SPLIT} SELECT edge_idx, u, i, part, new_node FROM parted")
def inductive_split(spark: SparkSession, sf: str) -> DataFrame:
    return _inductive(spark, sf).select("edge_idx", "u", "i", "part", "new_node")


@query(
    "inductive_halves",
    sql=f"""WITH {EDGES}, {_SPLIT}, half AS (SELECT node, {draw_sql("node", 2021)} % 2 AS h FROM held)
    SELECT edge_idx, u, i, part, part IN ('valid', 'test') AND EXISTS (SELECT 1 FROM half WHERE (node = u OR node = i)
      AND h = CASE WHEN part = 'valid' THEN 0 ELSE 1 END) AS new_node FROM marked""",
)
def inductive_halves(spark: SparkSession, sf: str) -> DataFrame:
    return _inductive(spark, sf, halves=True).select("edge_idx", "u", "i", "part", "new_node")


@query(
    "split_counts",
    sql=f"""WITH {EDGES}, {_SPLIT} SELECT part, count(*) AS n, count_if(new_node)::bigint AS n_new,
    (SELECT count(DISTINCT node) FROM (SELECT u AS node FROM parted x WHERE x.part = p.part UNION ALL SELECT i FROM parted x
    WHERE x.part = p.part)) AS n_nodes FROM parted p GROUP BY part""",
)
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.split_counts(_inductive(spark, sf))


@query(
    "unseen_nodes",
    sql=f"""WITH {EDGES}, {_SPLIT} SELECT (SELECT count(*) FROM (SELECT node FROM nodes EXCEPT SELECT node FROM known)) AS unseen,
    (SELECT count(*) FROM (SELECT node FROM held INTERSECT SELECT node FROM known)) AS shared""",
)
def unseen_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes less the training nodes, and the check that held-out nodes and training nodes do not meet."""
    e = edges(spark, sf)
    parted = _inductive(spark, sf)
    known = tgraph.nodes(parted.filter("part = 'train'"))
    val, _ = tgraph.time_cuts(e, START, 6, 3)
    unseen = tgraph.nodes(e).join(known, "node", "left_anti").agg(F.count(F.lit(1)).alias("unseen"))
    shared = tgraph.overlap(known, tgraph.held_out_nodes(e, val, 0.1, 2020)).agg(F.count(F.lit(1))).scalar()
    return unseen.select("unseen", shared.alias("shared"))


@query("negative_edges", sql=f"WITH {EDGES}, {_NEG} SELECT * FROM neg")
def negative_edges(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.negative_edges(edges(spark, sf))


@query(
    "negative_edges_clean",
    sql=f"WITH {EDGES}, {_NEG} SELECT * FROM neg n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = n.u AND e.i = n.i)",
)
def negative_edges_clean(spark: SparkSession, sf: str) -> DataFrame:
    return tgraph.negative_edges(edges(spark, sf), exclude=True).select("edge_idx", "u", "i", "ts")


_SCORES = f"""{_NEG}, nd AS (SELECT DISTINCT u AS node FROM edges UNION SELECT DISTINCT i FROM edges),
  vec AS (SELECT node, embedding AS v FROM nd JOIN embeddings ON vec_id = node % (SELECT count(*) FROM embeddings)),
  pairs AS (SELECT edge_idx, u, i, 1::bigint AS label FROM edges UNION ALL SELECT edge_idx, u, i, 0 FROM neg),
  scores AS (SELECT edge_idx, u, i, label, round(list_sum(list_transform(range(1, 65),
    lambda k: a.v[k]::double * b.v[k]::double)), 9) AS score FROM pairs JOIN vec a ON a.node = u JOIN vec b ON b.node = i)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Edge scores with an embedding row dealt to each node."""
    e = edges(spark, sf)
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    dealt = tgraph.nodes(e).withColumn("vec_id", F.pmod("node", total))
    return tgraph.link_scores(e, tgraph.negative_edges(e), dealt, rows).withColumn("score", F.round("score", 9))


@query("link_scores", sql=f"WITH {EDGES}, {_SCORES} SELECT * FROM scores")
def link_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


_CURVE = f"""{_SCORES}, c AS (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg_n FROM scores GROUP BY 1),
  r AS (SELECT pos, neg_n, sum(pos) OVER w AS tp, sum(neg_n) OVER w AS fp FROM c WINDOW w AS (ORDER BY score DESC))"""


@query("link_ap", sql=f"""WITH {EDGES}, {_CURVE} SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap,
    round(sum(neg_n * (tp - pos / 2)) / (sum(pos) * sum(neg_n)), 6) AS auc FROM r""")
def link_ap(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scores(spark, sf).select("label", "score")
    curve = metrics.roc(scored, "label", "score")
    area = metrics.auc(scored, "label", "score", curve).scalar()
    ap = metrics.average_precision(scored, "label", "score", curve)
    return ap.select(F.round("ap", 6).alias("ap"), F.round(area, 6).alias("auc"))


@query("link_loss", sql=f"""WITH {EDGES}, {_SCORES} SELECT label, count(*) AS n,
    round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 6) AS loss FROM scores GROUP BY label""")
def link_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = F.avg(metrics.bce(F.col("label"), F.col("score")))
    return _scores(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(loss, 6).alias("loss"))
