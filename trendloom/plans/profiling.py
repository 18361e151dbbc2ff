"""Profiles, cleaning steps and elementary column work over the invoice lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import dates
from trendloom.operators import clean, features, profile
from trendloom.plans.base import LINES, lines, with_country, with_description
from trendloom.plans.registry import query
from trendloom.sources.files import numeric_or_null, table


@query(
    "null_profile",
    sql="""SELECT count_if(doc_id IS NULL)::bigint AS doc_id, count_if(lang IS NULL)::bigint AS lang,
    count_if(quality IS NULL)::bigint AS quality, count_if(toxic IS NULL)::bigint AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return profile.null_counts(joined, ["doc_id", "lang", "quality", "toxic"])


@query("count_where", sql="""SELECT count_if(y = 0)::bigint AS zero, count_if(y < 0)::bigint AS negative
    FROM (SELECT c_acctbal AS y FROM customer)""")
def count_where(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("c_acctbal")
    return profile.count_where(table(spark, sf, "customer"), zero=y == 0, negative=y < 0)


@query("value_counts", sql="SELECT source, count(*) AS n FROM documents GROUP BY source")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "documents"), "source")


@query(
    "distinct_counts",
    sql=f"""WITH {LINES} SELECT country, count(DISTINCT customer) AS customers, count(DISTINCT product) AS products
    FROM lines GROUP BY country""",
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    base = with_country(lines(spark, sf).select("customer", "product"), spark, sf)
    return base.groupBy("country").agg(
        F.count_distinct("customer").alias("customers"), F.count_distinct("product").alias("products")
    )


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
    min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
    round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice")
)


@query("summary_stats", sql=_DESCRIBE)
def summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")]
    return out.select("column", "n", "min", "max", *rounded)


@query(
    "histogram",
    sql="""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 50), 49)::bigint AS bin, count(*) AS n
    FROM lineitem, e GROUP BY 1""",
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)


@query(
    "log_histogram",
    sql="""SELECT least(floor((ln(l_extendedprice + 1) - 0.0) / (15.0 - 0.0) * 30), 29)::bigint AS bin, count(*) AS n
    FROM lineitem WHERE ln(l_extendedprice + 1) BETWEEN 0 AND 15 GROUP BY 1""",
)
def log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    logged = table(spark, sf, "lineitem").select(F.log1p("l_extendedprice").alias("x"))
    return profile.histogram(logged, "x", 30, 0.0, 15.0)


_BAD_BRANDS = ["Brand#3", "Brand#7", "Brand#11"]


@query(
    "clean_lines",
    sql=f"""WITH {LINES} SELECT DISTINCT l.invoice, l.line, l.product, l.supplier, l.quantity,
    l.price, round(l.quantity * l.price, 4) AS total, l.ts FROM lines l JOIN part ON p_partkey = product
    WHERE l.quantity > 0 AND l.price > 0 AND l.customer IS NOT NULL AND l.ts < TIMESTAMP '2001-07-01'
    AND p_brand NOT IN ({", ".join(f"'{b}'" for b in _BAD_BRANDS)})""",
)
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("product"), "p_brand")
    allowed = parts.filter(clean.not_in("p_brand", _BAD_BRANDS)).drop("p_brand")
    kept = clean.positive(lines(spark, sf).na.drop(subset=["customer"]), ["quantity", "price"])
    kept = clean.before_month(kept, "ts", "2001-07-01").join(allowed, "product")
    return kept.select(
        "invoice", "line", "product", "supplier", "quantity", "price",
        F.round(F.col("quantity") * F.col("price"), 4).alias("total"), "ts",
    ).dropDuplicates()


@query(
    "zscore_filter",
    sql="""WITH a AS (SELECT * FROM lineitem WHERE abs((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))
      / (SELECT stddev_pop(l_extendedprice) FROM lineitem)) < 1.5)
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM a
    WHERE abs((l_quantity - (SELECT avg(l_quantity) FROM a)) / (SELECT stddev_pop(l_quantity) FROM a)) < 1.5""",
)
def zscore_filter(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return clean.zscore_filter(items, ["l_extendedprice", "l_quantity"], 1.5)


@query(
    "zscore_all",
    sql="""WITH s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1, avg(l_quantity) AS m2,
      stddev_pop(l_quantity) AS s2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem, s
    WHERE abs((l_extendedprice - m1) / s1) < 1.5 AND abs((l_quantity - m2) / s2) < 1.5""",
)
def zscore_all(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return clean.zscore_filter(items, ["l_extendedprice", "l_quantity"], 1.5, sequential=False)


@query(
    "first_row_per_key",
    sql="""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_row_per_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return clean.first_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("flag_filter", sql="SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def flag_filter(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F'")
    return items.select("l_orderkey", "l_linenumber", "l_partkey")


@query("inner_join", sql="SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def inner_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")


@query(
    "title_join",
    sql="""WITH one AS (SELECT p_name, arg_min(p_size, p_partkey) AS label FROM part GROUP BY p_name)
    SELECT p_partkey, p_name, label FROM part LEFT JOIN one USING (p_name)""",
)
def title_join(spark: SparkSession, sf: str) -> DataFrame:
    """Labels reach rows by a title that is not unique: one label per title is kept first, so rows do not multiply."""
    parts = table(spark, sf, "part")
    first = clean.first_per_key(parts.select("p_name", "p_partkey", "p_size"), "p_name", ["p_partkey"])
    labels = first.select("p_name", F.col("p_size").alias("label"))
    return parts.select("p_partkey", "p_name").join(labels, "p_name", "left")


@query("parts_semi", sql="SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def parts_semi(spark: SparkSession, sf: str) -> DataFrame:
    bulk = table(spark, sf, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", "p_name").join(bulk, "p_partkey", "left_semi")


@query(
    "stat_broadcast",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity)
    OVER (), 6) AS z FROM lineitem""",
)
def stat_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    scaled = features.apply_scaler(items, features.fit_scaler(items, ["l_quantity"]), ["l_quantity"])
    return scaled.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("z"))


@query(
    "seconds_since_start",
    sql="""SELECT event_id, round((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6, 6) AS seconds FROM events""",
)
def seconds_since_start(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", dates.epoch_micros("ts").alias("us"))
    start = events.agg(F.min("us")).scalar()
    return events.select("event_id", F.round((F.col("us") - start) / 1e6, 6).alias("seconds"))


@query("time_of_day", sql="""SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon'
    ELSE 'evening' END AS time_of_day FROM events""")
def time_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", dates.day_part("ts").alias("time_of_day"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "one_hot",
    sql="SELECT event_id, "
    + ", ".join(f"(event_type = '{k}')::bigint AS event_type_{k}" for k in _KINDS)
    + ", "
    + ", ".join(f"(weekday = {d})::bigint AS weekday_{d}" for d in range(1, 7))
    + " FROM (SELECT event_id, event_type, isodow(ts) - 1 AS weekday FROM events)",
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", F.weekday("ts").alias("weekday"))
    hot = features.one_hot(features.one_hot(events, "event_type", _KINDS), "weekday", range(7), drop_first=True)
    return hot.drop("event_type", "weekday")


@query("log_features", sql="""SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS log_price,
    round(ln(l_quantity + 1), 6) AS log_quantity FROM lineitem""")
def log_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(F.ln("l_extendedprice"), 6).alias("log_price"),
        F.round(F.log1p("l_quantity"), 6).alias("log_quantity"),
    )


@query("safe_percent", sql="""SELECT l_orderkey, l_linenumber, l_partkey,
    round(abs(l_discount - l_tax) / nullif(l_tax, 0) * 100, 6) AS off FROM lineitem""")
def safe_percent(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.abs(F.col("l_discount") - F.col("l_tax"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.try_divide(gap, F.col("l_tax")) * 100, 6).alias("off")
    )


@query("preview", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query(
    "coerce_types",
    sql="""SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS double) AS level,
    try_cast(o_orderpriority AS double) AS whole FROM orders""",
)
def coerce_types(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("head", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    return orders.select(
        "o_orderkey", numeric_or_null("head").alias("level"), numeric_or_null("o_orderpriority").alias("whole")
    )


@query(
    "period_label",
    sql="SELECT o_orderkey, strftime(last_day(o_orderdate::date), '%Y-%m-%d') AS period FROM orders",
)
def period_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", dates.period_label("o_orderdate").alias("period"))


@query(
    "label_encode",
    sql=f"""WITH {LINES} SELECT invoice, line, product, supplier, quantity, description,
    (dense_rank() OVER (ORDER BY description) - 1)::bigint AS description_id,
    (dense_rank() OVER (ORDER BY country) - 1)::bigint AS country_id FROM lines""",
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    base = lines(spark, sf).select("invoice", "line", "product", "supplier", "quantity", "customer")
    named = with_description(with_country(base, spark, sf), spark, sf)
    coded = features.label_encode(features.label_encode(named, "description", "description_id"), "country", "country_id")
    return coded.drop("customer", "country")


@query(
    "first_seen_index",
    sql=f"""WITH {LINES}, f AS (SELECT product, min({{'ts': ts, 'invoice': invoice}}) AS first FROM lines GROUP BY product)
    SELECT product, row_number() OVER (ORDER BY first, product) - 1 AS product_id FROM f""",
)
def first_seen_index(spark: SparkSession, sf: str) -> DataFrame:
    return features.first_seen_ids(lines(spark, sf), "product", ["ts", "invoice"], "product_id")


