"""Customer-value queries over the invoice lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import clv, metrics, panel, rfm, samples
from trendloom.plans.base import CLOCK, LINES, lines, orders_at, tidy, tidy_sql, with_country, with_description
from trendloom.plans.registry import query

#: Months that are held out at the end of the data.
HELD_OUT = 6
_LATEST = f"max(o_orderdate + to_seconds((o_orderkey * {CLOCK}) % 86400))::date"
END = f"(SELECT {_LATEST} FROM orders)"
CUT = f"(SELECT ({_LATEST} - INTERVAL {HELD_OUT} MONTH)::date FROM orders)"
LINE_ORDER = ["line", "product", "supplier", "quantity", "price"]
_PLACE = "{'a': line, 'b': product, 'c': supplier, 'd': quantity, 'e': price}"


def period(spark: SparkSession, sf: str) -> tuple[date, date]:
    """Last day of the calibration and of the data; every later order of a longer table moves both."""
    end = F.to_date(F.max("ts"))
    row = orders_at(spark, sf).agg(F.to_date(F.add_months(end, -HELD_OUT)).alias("cut"), end.alias("end")).first()
    return row["cut"], row["end"]


def holdout(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.calibration_holdout(_spend(spark, sf), *period(spark, sf))


def r(name: str, places: int = 4):
    return F.round(name, places).alias(name)


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return with_country(lines(spark, sf), spark, sf)


_ORDERS = f"""{LINES}, orders_t AS (SELECT invoice, arg_min(customer, {_PLACE}) AS customer, sum(amount) AS amount,
  min(ts)::date AS ds, arg_min(country, {_PLACE}) AS country FROM lines GROUP BY invoice HAVING sum(amount) > 0),
  spend AS (SELECT customer, ds, sum(amount) AS amount FROM orders_t GROUP BY 1, 2)"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.orders(_named(spark, sf), LINE_ORDER)


def _spend(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.daily_spend(_orders(spark, sf))


@query(
    "order_rollup",
    sql=f"""WITH {LINES} SELECT invoice, arg_min(customer, {_PLACE}) AS customer,
    round(sum(CASE WHEN returned THEN -amount ELSE amount END), 2) AS amount, min(ts)::date AS ds,
    arg_min(country, {_PLACE}) AS country FROM lines GROUP BY invoice
    HAVING sum(CASE WHEN returned THEN -amount ELSE amount END) > 0""",
)
def order_rollup(spark: SparkSession, sf: str) -> DataFrame:
    signed = F.when(F.col("returned"), -F.col("amount")).otherwise(F.col("amount"))
    out = rfm.orders(_named(spark, sf), LINE_ORDER, signed)
    return out.withColumn("amount", F.round("amount", 2))


@query(
    "order_attributes",
    sql=f"""WITH {LINES} SELECT invoice, min(ts) AS ts, count(DISTINCT product) AS n_products,
    date_trunc('month', min(ts))::date AS month, isodow(min(ts)) - 1 AS day_of_week,
    round(sin(2 * pi() * (isodow(min(ts)) - 1) / 7), 6) AS day_sin,
    round(cos(2 * pi() * (isodow(min(ts)) - 1) / 7), 6) AS day_cos,
    CASE WHEN hour(min(ts)) < 12 THEN 'morning' WHEN hour(min(ts)) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day
    FROM lines GROUP BY invoice""",
)
def order_attributes(spark: SparkSession, sf: str) -> DataFrame:
    out = rfm.order_attributes(lines(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("day_sin", "day_cos")})


@query("first_order", sql=f"""WITH {LINES} SELECT invoice, line, product, supplier, quantity, customer, ts,
    min(ts) OVER (PARTITION BY customer) AS first_order FROM lines""")
def first_order(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["invoice", "line", "product", "supplier", "quantity", "customer", "ts"]
    return rfm.with_first_order(lines(spark, sf).select(*cols))


@query(
    "rfm_summary",
    sql=f"""WITH {_ORDERS} SELECT customer, count(*) AS frequency, date_diff('day', min(ds), max(ds)) AS recency,
    date_diff('day', min(ds), {END}) AS "T", {tidy_sql('sum(amount) / count(*)', 4)} AS monetary_value
    FROM spend WHERE ds <= {END} GROUP BY customer""",
)
def rfm_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = rfm.summary(_spend(spark, sf), period(spark, sf)[1], include_first=True)
    return out.withColumn("monetary_value", tidy("monetary_value", 4))


_HOLD = f"""{_ORDERS}, cal AS (SELECT customer, count(*) - 1 AS frequency, date_diff('day', min(ds), max(ds)) AS recency,
  date_diff('day', min(ds), {CUT}) AS "T",
  CASE WHEN count(*) > 1 THEN (sum(amount) - arg_min(amount, ds)) / (count(*) - 1) ELSE 0.0 END AS monetary_value
  FROM spend WHERE ds <= {CUT} GROUP BY customer),
  hold AS (SELECT customer, count(*) AS n, avg(amount) AS m FROM spend WHERE ds > {CUT} AND ds <= {END}
  GROUP BY customer),
  both_t AS (SELECT cal.*, coalesce(n, 0) AS hf, coalesce(m, 0.0) AS hm FROM cal LEFT JOIN hold USING (customer))"""


@query(
    "rfm_holdout",
    sql=f"""WITH {_HOLD} SELECT customer, frequency, recency, "T", {tidy_sql('monetary_value', 4)} AS monetary_value,
    hf AS holdout_frequency, {tidy_sql('hm', 4)} AS holdout_monetary_value FROM both_t""",
)
def rfm_holdout(spark: SparkSession, sf: str) -> DataFrame:
    out = holdout(spark, sf)
    return out.withColumns({c: tidy(c, 4) for c in ("monetary_value", "holdout_monetary_value")})


@query(
    "rfm_train_test",
    sql=f"""WITH {_HOLD} SELECT customer, frequency, recency, "T", {tidy_sql('monetary_value', 4)} AS monetary_value,
    hf AS test_frequency, {tidy_sql('hm', 4)} AS test_monetary_value FROM both_t WHERE monetary_value <= 250000""",
)
def rfm_train_test(spark: SparkSession, sf: str) -> DataFrame:
    out = rfm.train_test(_spend(spark, sf), *period(spark, sf), spend_cap=250000.0)
    return out.withColumns({c: tidy(c, 4) for c in ("monetary_value", "test_monetary_value")})


@query(
    "modal_bucket",
    sql=f"""WITH {LINES}, o AS (SELECT invoice, min(customer) AS customer, CASE WHEN hour(min(ts)) < 12 THEN 'morning'
      WHEN hour(min(ts)) < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM lines GROUP BY invoice),
    c AS (SELECT customer, part, count(*) AS n FROM o GROUP BY ALL)
    SELECT customer, part AS usual_part FROM c
    QUALIFY row_number() OVER (PARTITION BY customer ORDER BY n DESC, part) = 1""",
)
def modal_bucket(spark: SparkSession, sf: str) -> DataFrame:
    base = lines(spark, sf)
    owner = base.groupBy("invoice").agg(F.min("customer").alias("customer"))
    return rfm.usual_day_part(rfm.order_attributes(base).join(owner, "invoice"))


@query(
    "spend_corr",
    sql=f"WITH {_HOLD} SELECT round(corr(monetary_value, frequency), 6) AS corr FROM both_t WHERE frequency > 0",
)
def spend_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.spend_correlation(holdout(spark, sf)).select(r("corr", 6))


@query(
    "customer_features",
    sql=f"""WITH {_ORDERS}, a AS (SELECT invoice, min(ts) AS ts, count(DISTINCT product) AS n_products,
      CASE WHEN hour(min(ts)) < 12 THEN 'morning' WHEN hour(min(ts)) < 18 THEN 'afternoon' ELSE 'evening' END AS part
      FROM lines GROUP BY invoice),
    o AS (SELECT * EXCLUDE (ds, amount) FROM a JOIN orders_t USING (invoice)),
    p AS (SELECT customer, part FROM (SELECT customer, part, count(*) AS n FROM o GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY customer ORDER BY n DESC, part) = 1),
    g AS (SELECT customer, avg(n_products) AS unique_per_order, arg_min(country, {{'a': ts, 'b': invoice}}) AS country
      FROM o GROUP BY customer),
    i AS (SELECT customer, count(DISTINCT product) AS n_unique_items FROM lines GROUP BY customer),
    s AS (SELECT customer, count(*) AS frequency, date_diff('day', min(ds), max(ds)) AS recency,
      date_diff('day', min(ds), {END}) AS "T", sum(amount) / count(*) AS m FROM spend GROUP BY customer)
    SELECT customer, round(unique_per_order, 6) AS unique_per_order, country, n_unique_items, frequency, recency, "T",
      {tidy_sql('m', 4)} AS monetary_value, (part = 'afternoon')::bigint AS in_afternoon, (part = 'evening')::bigint AS in_evening,
      (part = 'morning')::bigint AS in_morning, round(recency / nullif(frequency, 0), 6) AS avg_time_between_orders,
      "T" - recency AS days_since_last_order, round(frequency * m, 2) AS total_spend
    FROM g JOIN p USING (customer) JOIN i USING (customer) LEFT JOIN s USING (customer)""",
)
def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    out = rfm.customer_features(_named(spark, sf), LINE_ORDER, period(spark, sf)[1])
    places = {"unique_per_order": 6, "avg_time_between_orders": 6, "total_spend": 2}
    return out.withColumns({"monetary_value": tidy("monetary_value", 4), **{c: F.round(c, n) for c, n in places.items()}})


@query(
    "period_rollup",
    sql=f"""WITH {LINES} SELECT last_day(ts::date) AS period_end, customer, product, count(*) AS n_lines,
    {tidy_sql('avg(price)', 4)} AS price, sum(quantity) AS quantity, arg_min(country, {_PLACE}) AS country,
    arg_min(description, {_PLACE}) AS description FROM lines GROUP BY 1, 2, 3 HAVING sum(quantity) > 0""",
)
def period_rollup(spark: SparkSession, sf: str) -> DataFrame:
    base = with_description(_named(spark, sf), spark, sf)
    place = F.struct(*LINE_ORDER)
    out = panel.period_rollup(
        base, ["customer", "product"], "ts",
        [
            F.count(F.lit(1)).alias("n_lines"), F.avg("price").alias("price"), F.sum("quantity").alias("quantity"),
            F.min_by("country", place).alias("country"), F.min_by("description", place).alias("description"),
        ],
    )
    return out.filter("quantity > 0").withColumn("price", tidy("price", 4))


START, STEP, MONTHS = "1995-01-01", 56, 3
_CUTS = f"""cuts AS (SELECT k AS cut_no, TIMESTAMP '{START}' + to_days(((k + 1) * {STEP})::int) - INTERVAL 1 SECOND AS cut
  FROM (SELECT unnest(range(0, (SELECT date_diff('day', TIMESTAMP '{START}', max(ts)) FROM lines) // {STEP} + 1)) AS k)
  WHERE TIMESTAMP '{START}' + to_days(((k + 1) * {STEP})::int) - INTERVAL 1 SECOND + INTERVAL {MONTHS} MONTH
    <= (SELECT max(ts) FROM lines))"""


def cuts(spark: SparkSession, sf: str) -> int:
    """Cuts whose target is whole, from the data."""
    return samples.whole_cuts(lines(spark, sf), "ts", START, STEP, MONTHS)


_FUTURE = f"""fut AS (SELECT cut_no, customer, sum(amount) AS target FROM lines JOIN cuts
  ON ts > cut AND ts < cut + INTERVAL {MONTHS} MONTH GROUP BY 1, 2)"""


@query("future_value", sql=f"WITH {LINES}, {_CUTS}, {_FUTURE} SELECT cut_no, customer, round(target, 2) AS target FROM fut")
def future_value(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.future_value(lines(spark, sf), "customer", "ts", "amount", START, STEP, cuts(spark, sf), MONTHS)
    return out.withColumn("target", F.round("target", 2))


@query(
    "clv_dataset",
    sql=f"""WITH {LINES}, {_CUTS}, {_FUTURE}, act AS (SELECT customer, cut_no, any_value(cut) AS cut, count(*) AS n_events,
      sum(amount) AS spend, max(ts) AS last FROM lines JOIN cuts ON ts <= cut GROUP BY 1, 2)
    SELECT customer, cut_no, n_events, round(spend, 2) AS spend, date_diff('second', last, cut) AS idle_seconds,
      round(coalesce(target, 0.0), 2) AS target, cut::date AS prediction_date
    FROM act LEFT JOIN fut USING (cut_no, customer)""",
)
def clv_dataset(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.clv_dataset(lines(spark, sf), "customer", "ts", "amount", START, STEP, cuts(spark, sf), MONTHS)
    return out.withColumns({c: F.round(c, 2) for c in ("spend", "target")})


@query(
    "clv_split",
    sql=f"""WITH {LINES}, {_CUTS}, act AS (SELECT DISTINCT customer, cut_no, cut::date AS prediction_date
      FROM lines JOIN cuts ON ts <= cut)
    SELECT (prediction_date >= DATE '2000-01-01')::bigint AS is_test, count(*) AS n, count(DISTINCT customer) AS customers
    FROM act GROUP BY 1""",
)
def clv_split(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test by prediction date."""
    seen = samples.activity(lines(spark, sf), "customer", "ts", "amount", START, STEP, cuts(spark, sf))
    dated = seen.withColumn("prediction_date", F.to_date(samples.cut_time(F.col("cut_no"), START, STEP)))
    flag = (F.col("prediction_date") >= F.lit("2000-01-01").cast("date")).cast("long").alias("is_test")
    return dated.groupBy(flag).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer").alias("customers"))


# Parameters of a fitted model, fixed so that scores can be compared.
BG = {"r": 0.8, "alpha": 60.0, "a": 1.4, "b": 2.5}
PN = {"r": 0.9, "alpha": 70.0, "s": 1.3, "beta": 55.0}
GG = {"p": 6.0, "q": 4.0, "v": 15000.0}
AHEAD = 180.0


def _series(a: str, b: str, c: str, z: str) -> str:
    return (
        f"list_sum(list_transform(range(0, 201), lambda k: exp(lgamma({a} + k) - lgamma({a}) + lgamma({b} + k) - lgamma({b})"
        f" - lgamma({c} + k) + lgamma({c}) - lgamma(k + 1) + k * ln({z}))))"
    )


_R, _AL, _A, _B = BG["r"], BG["alpha"], BG["a"], BG["b"]
_ALIVE = f"""CASE WHEN x > 0 THEN 1 / (1 + {_A} / ({_B} + x - 1) * pow(({_AL} + t) / ({_AL} + tx), {_R} + x)) ELSE 1.0 END"""
_SCORE = f"""{_HOLD}, f AS (SELECT customer, frequency::double AS x, recency::double AS tx, "T"::double AS t,
  monetary_value AS m, hf, hm FROM both_t),
  sc AS (SELECT customer, hf, hm, {_ALIVE} AS p_alive,
    ({_A} + {_B} + x - 1) / ({_A} - 1) * (1 - pow(({_AL} + t) / ({_AL} + t + {AHEAD}), {_R} + x)
      * {_series(f"({_R} + x)", f"({_B} + x)", f"({_A} + {_B} + x - 1)", f"({AHEAD} / ({_AL} + t + {AHEAD}))")})
      * ({_ALIVE}) AS expected_purchases,
    {GG["p"]} * ({GG["v"]} + x * m) / ({GG["p"]} * x + {GG["q"]} - 1) AS expected_spend FROM f)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return clv.score(holdout(spark, sf), BG, GG, AHEAD)


@query(
    "clv_score",
    sql=f"""WITH {_SCORE} SELECT customer, round(p_alive, 6) AS p_alive, round(expected_purchases, 6) AS expected_purchases,
    round(expected_spend, 4) AS expected_spend FROM sc""",
)
def clv_score(spark: SparkSession, sf: str) -> DataFrame:
    out = _scored(spark, sf)
    return out.select("customer", r("p_alive", 6), r("expected_purchases", 6), r("expected_spend", 4))


_S, _BE = PN["s"], PN["beta"]
_PA, _PR = PN["alpha"], PN["r"]
_PART = f"{_series(f'({_PR + _S} + x)', f'({_S + 1.0})', f'({_PR + _S + 1} + x)', f'({_PA - _BE} / ({_PA} + U))')} * pow(({_PA} + t) / ({_PA} + U), {_PR + _S} + x)"


@query(
    "pareto_score",
    sql=f"""WITH {_HOLD}, f AS (SELECT customer, frequency::double AS x, recency::double AS tx, "T"::double AS t FROM both_t),
    al AS (SELECT *, 1 / (1 + {_S} / ({_PR + _S} + x) * pow(({_BE} + t) / ({_PA} + t), {_S})
      * ({_PART.replace("U", "tx")} - {_PART.replace("U", "t")})) AS p_alive FROM f)
    SELECT customer, round(p_alive, 6) AS p_alive, round(p_alive * ({_PR} + x) * ({_BE} + t) / (({_PA} + t) * ({_S} - 1))
      * (1 - pow(({_BE} + t) / ({_BE} + t + {AHEAD}), {_S} - 1)), 6) AS expected_purchases FROM al""",
)
def pareto_score(spark: SparkSession, sf: str) -> DataFrame:
    base = holdout(spark, sf)
    x, tx, T = (F.col(c).cast("double") for c in ("frequency", "recency", "T"))
    out = base.select(
        "customer", clv.pareto_alive(x, tx, T, PN).alias("p_alive"),
        clv.pareto_purchases(x, tx, T, AHEAD, PN).alias("expected_purchases"),
    )
    return out.select("customer", r("p_alive", 6), r("expected_purchases", 6))


@query(
    "clv_product",
    sql=f"""WITH {_SCORE}, c AS (SELECT hf * hm AS y, greatest(expected_purchases * expected_spend, 0) AS yhat FROM sc)
    SELECT count(*) AS n, round(sqrt(avg((yhat - y) ** 2)), 4) AS rmse, round(avg(abs(yhat - y)), 4) AS mae,
    round(1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM c""",
)
def clv_product(spark: SparkSession, sf: str) -> DataFrame:
    """Expected purchases x expected spend against the later spend of the same customer."""
    real = F.col("holdout_frequency") * F.col("holdout_monetary_value")
    pairs = _scored(spark, sf).select(real.alias("y"), F.greatest("expected_clv", F.lit(0.0)).alias("yhat"))
    return metrics.regression(pairs, "y", "yhat").select("n", r("rmse"), r("mae"), r("r2", 6))


def _psi(x: str) -> str:
    """Derivative of the log-gamma function as SQL text."""
    z, low = f"(({x}) + 8)", " + ".join(f"1 / (({x}) + {k})" for k in range(8))
    q = f"(1 / ({z} * {z}))"
    return f"(ln({z}) - 0.5 / {z} - {q} * (1/12 - {q} * (1/120 - {q} * (1/252 - {q} * (1/240 - {q} / 132)))) - ({low}))"


#: Parameters at which likelihoods are reported: the scoring ones, and others around them.
BG_POINTS = [list(BG.values()), [1.0, 50.0, 1.0, 1.0], [2.0, 90.0, 0.5, 4.0]]
GG_POINTS = [list(GG.values()), [2.0, 3.0, 20000.0], [10.0, 2.0, 9000.0]]


def _points_sql(points: list[list[float]], names: str) -> str:
    rows = ", ".join(f"({i}, {', '.join(f'{v!r}::double' for v in p)})" for i, p in enumerate(points))
    return f"(VALUES {rows}) AS t(point, {names})"


@query(
    "bgnbd_likelihood",
    sql=f"""WITH {_HOLD}, f AS (SELECT frequency::double AS x, recency::double AS tx, "T"::double AS t FROM both_t),
    w AS (SELECT *, -(r + x) * ln(alpha + t) AS alive, CASE WHEN x > 0 THEN ln(a) - ln(b + x - 1) - (r + x) * ln(alpha + tx) END AS gone
      FROM f, {_points_sql(BG_POINTS, "r, alpha, a, b")}),
    s AS (SELECT *, CASE WHEN gone IS NULL THEN alive ELSE greatest(alive, gone) + ln(1 + exp(-abs(alive - gone))) END AS tail FROM w),
    e AS (SELECT *, CASE WHEN gone IS NULL THEN 0.0 ELSE exp(gone - tail) END AS q FROM s)
    SELECT point::bigint AS point, round(avg(lgamma(r + x) - lgamma(r) + r * ln(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b)
        - lgamma(a + b + x) + tail), 6) AS loglik,
      round(avg(r * ({_psi("r + x")} - {_psi("r")} + ln(alpha) - (1 - q) * ln(alpha + t) - q * ln(alpha + tx))), 6) AS d_r,
      round(avg(r - alpha * (r + x) * ((1 - q) / (alpha + t) + q / (alpha + tx))), 6) AS d_alpha,
      round(avg(a * ({_psi("a + b")} - {_psi("a + b + x")}) + q), 6) AS d_a,
      round(avg(b * ({_psi("a + b")} - {_psi("a + b + x")} + {_psi("b + x")} - {_psi("b")}
        - CASE WHEN x > 0 THEN q / (b + x - 1) ELSE 0.0 END)), 6) AS d_b FROM e GROUP BY point""",
)
def bgnbd_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log-likelihood and gradient of the purchase model at given parameters: what its fit climbs."""
    out = clv.likelihood(holdout(spark, sf), "bgnbd", BG_POINTS)
    return out.select("point", *[r(c, 6) for c in out.columns[1:]])


@query(
    "gamma_gamma_likelihood",
    sql=f"""WITH {_HOLD}, f AS (SELECT frequency::double AS x, monetary_value AS m FROM both_t WHERE frequency > 0 AND monetary_value > 0),
    w AS (SELECT *, ln(x * m + v) AS far FROM f, {_points_sql(GG_POINTS, "p, q, v")})
    SELECT point::bigint AS point, round(avg(lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * ln(v) + (p * x - 1) * ln(m)
        + p * x * ln(x) - (p * x + q) * far), 6) AS loglik,
      round(avg(p * x * ({_psi("p * x + q")} - {_psi("p * x")} + ln(m) + ln(x) - far)), 6) AS d_p,
      round(avg(q * ({_psi("p * x + q")} - {_psi("q")} + ln(v) - far)), 6) AS d_q,
      round(avg(q - v * (p * x + q) / (x * m + v)), 6) AS d_v FROM w GROUP BY point""",
)
def gamma_gamma_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log-likelihood and gradient of the spend model at given parameters."""
    out = clv.likelihood(holdout(spark, sf), "gamma_gamma", GG_POINTS)
    return out.select("point", *[r(c, 6) for c in out.columns[1:]])


@query("bgnbd_fit")
def bgnbd_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of most likelihood, without a penalty."""
    return clv.fit_bgnbd(holdout(spark, sf))


@query("gamma_gamma_fit")
def gamma_gamma_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of most likelihood, without a penalty."""
    return clv.fit_gamma_gamma(holdout(spark, sf))
