"""Model queries: forecasts, clusters, vector neighbours, text and value models."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.hashing import draw_sql
from trendloom.operators import backtest, metrics, models, panel, sampling, vectors
from trendloom.plans import customers, forecasting, interaction_graph
from trendloom.plans.base import DAILY, daily, lines, spread
from trendloom.plans.registry import query
from trendloom.sources import files
from trendloom.sources.files import table
from trendloom.sources.work import store, work_path

LAGS = forecasting.LAGS
CATS = ["entity"]
TREES = {"maxIter": 10, "maxDepth": 4}
HORIZON = 50


def _held(spark: SparkSession, sf: str, n: int = 50) -> DataFrame:
    return store(panel.holdout_tail(daily(spark, sf), "entity", "ds", n), "held")


def _fit(held: DataFrame, **params: object) -> models.PanelModel:
    frame = models.training_frame(held.filter("rel = 0"), "entity", "ds", "y", LAGS)
    numeric = [*models.CALENDAR, *models.lag_names(LAGS)]
    return models.fit_global(frame, "y", numeric, CATS, **{**TREES, **params})


@query("global_gbt")
def global_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """One-step predictions of the global model on the held-out tail, with lags from the actual history."""
    held = _held(spark, sf)
    model = _fit(held)
    frame = models.training_frame(held, "entity", "ds", "y", LAGS).filter("is_test")
    return models.score(model, frame, CATS).select("entity", "ds", "y", "yhat")


@query("recursive_forecast")
def recursive_forecast(spark: SparkSession, sf: str) -> DataFrame:
    held = _held(spark, sf)
    buffer = panel.tail(held.filter("rel = 0"), "entity", "ds", 50)
    return models.forecast(
        buffer, held.filter("rel > 0"), ["entity"], "ds", "y", [_fit(held)], LAGS, HORIZON, CATS
    )


@query("recursive_backtest")
def recursive_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling origins of the recursive forecast, all origins side by side."""
    held = _held(spark, sf, 80)
    model = _fit(held)

    def run(past: DataFrame, ahead: DataFrame, keys: list[str]) -> DataFrame:
        buffer = panel.tail(past, keys, "ds", 50)
        return models.forecast(buffer, ahead, keys, "ds", "y", [model], LAGS, HORIZON, CATS)

    return backtest.rolling(held, "entity", "y", HORIZON, backtest.origins(80, HORIZON, 5), run)


DIRECT = 10


@query("hybrid_forecast")
def hybrid_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Ten direct models in turn."""
    held = _held(spark, sf)
    family = models.fit_direct(held.filter("rel = 0"), "entity", "ds", "y", LAGS, DIRECT, CATS, **TREES)
    buffer = panel.tail(held.filter("rel = 0"), "entity", "ds", 60)
    return models.forecast(buffer, held.filter("rel > 0"), ["entity"], "ds", "y", family, LAGS, HORIZON, CATS)


@query("model_family")
def model_family(spark: SparkSession, sf: str) -> DataFrame:
    """Ten direct models saved, loaded again and scored on the held-out tail."""
    held = _held(spark, sf)
    path = work_path(spark, "family")
    models.save_family(models.fit_direct(held.filter("rel = 0"), "entity", "ds", "y", LAGS, DIRECT, CATS, **TREES), path)

    def scored(found: tuple[int, models.PanelModel]) -> DataFrame:
        i, model = found
        frame = models.training_frame(held, "entity", "ds", "y", [k + i for k in LAGS]).filter("is_test")
        return metrics.regression(models.score(model, frame, CATS), "y", "yhat").withColumn("model", F.lit(f"model_{i + 1}"))

    return files.stack([scored(x) for x in enumerate(models.load_family(spark, path, DIRECT))])


# Ranges of the search; trees are few and shallow beside a gradient library's, since Spark grows them level by level.
SPACE = {
    "maxIter": models.Choice(4, 12, "int", 2), "stepSize": models.Choice(0.05, 0.3, "log"), "maxDepth": models.Choice(3, 6, "int"),
    "minInstancesPerNode": models.Choice(5, 150, "int"), "subsamplingRate": models.Choice(0.6, 1.0),
}
TRIALS, FOLDS = 20, 3


@query("tuned_gbt")
def tuned_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty random settings over three expanding folds, the better half going on after each."""
    held = _held(spark, sf)
    frame = models.training_frame(held.filter("rel = 0"), "entity", "ds", "y", LAGS)
    numeric = [*models.CALENDAR, *models.lag_names(LAGS)]
    fit = lambda df, **p: models.fit_global(df, "y", numeric, CATS, **p)
    blocked = sampling.time_folds(frame, "ds", FOLDS)
    return models.search(blocked, "y", models.settings(SPACE, TRIALS), FOLDS, fit, partial(_score_with, cats=CATS))


def _score_with(model: models.PanelModel, df: DataFrame, cats: list[str]) -> DataFrame:
    return models.score(model, df, cats)


@query("importance")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    return models.importances(_fit(_held(spark, sf)), spark)


def _keyed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("row_key", F.col("entity") * 100000 + F.date_diff("ds", F.lit("1970-01-01").cast("date")))


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """All inputs of the tree model, on the held-out tail."""
    held = _held(spark, sf)
    model = _fit(held)
    frame = models.training_frame(held, "entity", "ds", "y", LAGS).filter("is_test")
    coded = _keyed(model.encode(frame, CATS)).select("row_key", "y", *model.inputs)
    predict = lambda df: model.pipeline.transform(df).withColumnRenamed("prediction", "yhat")
    return models.permutation_importance(coded, "row_key", "y", model.inputs, predict)


_LAG = [f"y_lag_{k}" for k in LAGS]
_RULED = """coalesce(list_sum(list_transform({x}, lambda v, i: coalesce(v * {w}[i], 0.0))) / nullif(list_sum(list_transform({x},
  lambda v, i: CASE WHEN v IS NULL THEN 0.0 ELSE {w}[i] END)), 0), 0.0)"""


@query(
    "permutation_importance_rule",
    sql=f"""WITH {DAILY}, {forecasting._HELD.format(n=50)}, lagged AS (SELECT d.entity, d.ds, d.y, d.is_test,
      [{", ".join(f"l{k}.y::double" for k in LAGS)}] AS x FROM held d
      {" ".join(f"LEFT JOIN held l{k} ON l{k}.entity = d.entity AND l{k}.ds = d.ds - {k}" for k in LAGS)}),
    keyed AS (SELECT *, entity * 100000 + date_diff('day', DATE '1970-01-01', ds) AS key FROM lagged WHERE is_test),
    placed AS (SELECT y, x, row_number() OVER (ORDER BY {draw_sql("key", 0)}, key) - 1 AS at, count(*) OVER () AS n FROM keyed),
    cols AS (SELECT unnest(range(1, {len(LAGS) + 1})) AS k, unnest({_LAG}) AS feature),
    turns AS (SELECT k, feature, 1 + ('0x' || substr(md5(feature || ':0'), 1, 15))::bigint % (SELECT any_value(n) - 1 FROM placed) AS turn FROM cols),
    copies AS (SELECT t.feature, r.y, r.x, list_transform(r.x, lambda v, i: CASE WHEN i = t.k THEN d.x[t.k] ELSE v END) AS z
      FROM turns t, placed r JOIN placed d ON (d.at + t.turn) % d.n = r.at)
    SELECT feature, round(avg(({_RULED.format(x="z", w=forecasting.WEIGHTS)} - y) ** 2) - avg(({_RULED.format(x="x", w=forecasting.WEIGHTS)} - y) ** 2), 6)
      AS rise FROM copies GROUP BY feature""",
)
def permutation_importance_rule(spark: SparkSession, sf: str) -> DataFrame:
    """All lags of the fixed rule, on the held-out tail."""
    held = _held(spark, sf)
    frame = _keyed(panel.add_date_lags(held, "entity", "ds", "y", LAGS).filter("is_test")).select("row_key", "y", *_LAG)
    rule = forecasting.RULE(lambda k: F.col(f"y_lag_{k}"), F.lit(0))
    out = models.permutation_importance(frame, "row_key", "y", _LAG, lambda df: df.withColumn("yhat", rule))
    return out.withColumn("rise", F.round("rise", 6))


@query("text_classifier")
def text_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the held-out fifth of the labelled documents, trained on whole texts."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    train, test = sampling.split(rows, "doc_id", 0.8, 42)
    scored = models.score_text(models.fit_text_classifier(train, "text", "label"), test)
    return scored.select("doc_id", "label", "score", metrics.threshold("score", 0.414).alias("pred"))


VECTOR = ["kilo", "quantity"]
LAST_EVENTS = 20
_VEC = [f"sum({c})" for c in ("x.amount / 1000", "x.quantity")]
_VEC += [f"sum({c})" for c in interaction_graph._encode_sql("(q.at - x.ts)", interaction_graph.DIM).split(", ")]
VEC_NAMES = [f"vec_{j}" for j in range(len(_VEC))]
_SAMPLES = f"""{interaction_graph.EDGES}, {customers._CUTS}, {customers._FUTURE},
  act AS (SELECT customer, cut_no, any_value(cut) AS cut, count(*) AS n_events, sum(amount) AS spend, max(ts) AS last
    FROM lines JOIN cuts ON ts <= cut GROUP BY 1, 2),
  q AS (SELECT act.*, u AS node, epoch(cut)::bigint - (SELECT epoch(min(ts))::bigint FROM lines) + 1 AS at FROM act JOIN cu USING (customer)),
  x AS (SELECT q.customer, q.cut_no, q.at, e.ts, e.amount, e.quantity FROM q JOIN edges e ON e.u = q.node AND e.ts < q.at
    QUALIFY row_number() OVER (PARTITION BY q.customer, q.cut_no ORDER BY e.ts DESC, e.edge_idx DESC) <= {LAST_EVENTS}),
  v AS (SELECT customer, cut_no, {", ".join(f"{e.replace('q.at', 'x.at')} AS {n}" for e, n in zip(_VEC, VEC_NAMES))} FROM x GROUP BY 1, 2),
  data AS (SELECT customer, cut_no, n_events, spend, date_diff('second', last, cut) AS idle_seconds, coalesce(target, 0.0) AS target,
    cut::date AS prediction_date, {", ".join(VEC_NAMES)}
    FROM act LEFT JOIN fut USING (cut_no, customer) JOIN v USING (customer, cut_no))"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of every cut with the vector of the customer's last events, its places as columns."""
    where = (customers.START, customers.STEP, customers.cuts(spark, sf))
    data = customers.samples.clv_dataset(lines(spark, sf), "customer", "ts", "amount", *where, customers.MONTHS)
    e = interaction_graph.edges(spark, sf).withColumn("kilo", F.col("amount") / 1000)
    found = interaction_graph.tables(spark, sf)
    out = customers.samples.with_vectors(
        data, e, found.users, found.start, *where, VECTOR, interaction_graph.DIM, LAST_EVENTS
    )
    return out.withColumns({n: F.col("vec")[j] for j, n in enumerate(VEC_NAMES)}).drop("vec")


@query(
    "clv_vectors",
    sql=f"""WITH {_SAMPLES} SELECT customer, cut_no, n_events, round(spend, 2) AS spend, idle_seconds, round(target, 2) AS target,
    prediction_date, {", ".join(f"round({n}, 5) AS {n}" for n in VEC_NAMES)} FROM data""",
)
def clv_vectors(spark: SparkSession, sf: str) -> DataFrame:
    places = {"spend": 2, "target": 2, **dict.fromkeys(VEC_NAMES, 5)}
    return _samples(spark, sf).withColumns({c: F.round(c, n) for c, n in places.items()})


@query("clv_regression")
def clv_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Later spend from activity and vectors: earlier cuts train, later ones test, predictions clipped at 0."""
    data = store(_samples(spark, sf), "clv-samples")
    numeric = ["n_events", "spend", "idle_seconds", *VEC_NAMES]
    model = models.fit_global(data.filter("prediction_date < DATE '2000-01-01'"), "target", numeric, **TREES)
    scored = models.score(model, data.filter("prediction_date >= DATE '2000-01-01'"))
    return metrics.regression(scored.withColumn("yhat", F.greatest("yhat", F.lit(0.0))), "target", "yhat")


_INPUTS = {
    "events": "n_events / 100.0", "mean_spend": "spend / n_events / 10000", "idle": "idle_seconds / 8640000.0", "sum_kilo": "vec_0 / 100",
    "sum_quantity": "vec_1 / 100", "code_1": "vec_3", "code_2": "vec_4 / 10",
}
_WIDE = len(_INPUTS) + 2


@query(
    "clv_linear",
    sql=f"""WITH RECURSIVE {_SAMPLES}, r AS (SELECT prediction_date < DATE '2000-01-01' AS train, target,
      [1.0::double, {", ".join(_INPUTS.values())}, target / 10000] AS z FROM data),
    g AS (SELECT list(s ORDER BY j) AS s, i FROM (SELECT i, j, sum(z[i] * z[j]) AS s FROM r, (SELECT unnest(range(1, {_WIDE})) AS i),
      (SELECT unnest(range(1, {_WIDE + 1})) AS j) WHERE train GROUP BY i, j) GROUP BY i),
    solve AS (SELECT 1 AS k, (SELECT list(s ORDER BY i) FROM g) AS m
      UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / row[k])
        ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM solve WHERE k < {_WIDE}),
    beta AS (SELECT list_transform(m, lambda row: row[{_WIDE}]) AS b FROM solve WHERE k = {_WIDE}),
    p AS (SELECT target AS y, greatest(10000 * list_dot_product(z[:{_WIDE - 1}], b), 0) AS yhat FROM r, beta WHERE NOT train)
    SELECT count(*) AS n, round(sqrt(avg((yhat - y) ** 2)), 3) AS rmse, round(avg(abs(yhat - y)), 3) AS mae,
    round(1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p""",
)
def clv_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Later spend by least squares on activity and vectors, same split and clip as ``clv_regression``."""
    data = store(_samples(spark, sf), "clv-samples").withColumns({n: F.expr(e) for n, e in _INPUTS.items()})
    data = data.withColumn("scaled", F.col("target") / 10000)
    early = F.col("prediction_date") < F.lit("2000-01-01").cast("date")
    model = models.fit_linear(data.filter(early), "scaled", list(_INPUTS))
    scored = models.score_linear(model, data.filter(~early), list(_INPUTS))
    out = metrics.regression(scored.withColumn("yhat", F.greatest(F.col("yhat") * 10000, F.lit(0.0))), "target", "yhat")
    return out.select("n", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"))


ROUNDS, MOST = 10, 20


def _lloyd_sql(ks: str) -> str:
    """Recursive twin: a round assigns every row for every number of clusters and moves the centres."""
    means = ", ".join(f"avg(v[{j + 1}])" for j in range(64))
    return f"""pts AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings WHERE embedding IS NOT NULL),
    first AS (SELECT v, row_number() OVER (ORDER BY {draw_sql("vec_id", 91)}, vec_id) - 1 AS j FROM pts),
    cen AS (SELECT 0 AS r, k, j, v AS c FROM first, (SELECT unnest({ks}) AS k) WHERE j < k
      UNION ALL SELECT o.r + 1, o.k, o.j, coalesce(n.c, o.c) FROM cen o LEFT JOIN (
        SELECT k, j, [{means}] AS c FROM (SELECT k, vec_id, any_value(v) AS v, arg_min(j, d) AS j FROM (
            SELECT k, j, vec_id, v, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) ** 2)) AS d FROM cen, pts)
          GROUP BY k, vec_id) GROUP BY k, j) n ON n.k = o.k AND n.j = o.j WHERE o.r < {ROUNDS}),
    near AS (SELECT k, vec_id, arg_min(j, d) AS cluster, min(d) AS d FROM (SELECT k, j, vec_id,
        list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) ** 2)) AS d FROM cen, pts WHERE r = {ROUNDS}) GROUP BY k, vec_id)"""


def _assigned(spark: SparkSession, sf: str, ks: list[int]) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.assign_nearest(rows, "vec_id", "embedding", vectors.lloyd(rows, "vec_id", "embedding", ks, ROUNDS))


@query("kmeans_clusters", sql=f"WITH RECURSIVE {_lloyd_sql('[3]')} SELECT vec_id, cluster FROM near")
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, [3]).select("vec_id", "cluster")


@query("elbow", sql=f"WITH RECURSIVE {_lloyd_sql(f'range(1, {MOST + 1})')} SELECT k, round(sum(d), 6) AS cost FROM near GROUP BY k")
def elbow(spark: SparkSession, sf: str) -> DataFrame:
    """Cost for 1 to 20 clusters, all numbers in the same passes."""
    out = vectors.costs(_assigned(spark, sf, list(range(1, MOST + 1))))
    return out.withColumn("cost", F.round("cost", 6))


def _component_sql(name: str, covariance: str) -> str:
    """Largest principal direction: a covariance matrix squared until only that direction is left."""
    return f"""{name}_p AS (SELECT 0 AS r, a FROM {covariance}
      UNION ALL SELECT r + 1, list_transform(a, lambda x: list_transform(x, lambda z: z / t)) FROM (SELECT r, a,
        list_sum(list_transform(range(1, 65), lambda i: a[i][i])) AS t FROM (SELECT r, list_transform(a, lambda x: list_transform(a,
          lambda z: list_dot_product(x, z))) AS a FROM {name}_p WHERE r < 24))),
    {name} AS (SELECT list_transform(w, lambda x: x / norm * CASE WHEN list_max(w) >= -list_min(w) THEN 1 ELSE -1 END) AS w
      FROM (SELECT w, sqrt(list_dot_product(w, w)) AS norm FROM (SELECT a[list_position(g, list_max(g))] AS w FROM (
        SELECT a, list_transform(range(1, 65), lambda i: a[i][i]) AS g FROM {name}_p WHERE r = 24))))"""


@query(
    "pca_vectors",
    sql=f"""WITH RECURSIVE pts AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),
    cov AS (SELECT list(s ORDER BY i) AS a FROM (SELECT i, list(s ORDER BY j) AS s FROM (
      SELECT i, j, covar_samp(v[i], v[j]) AS s FROM pts, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j)
      GROUP BY i, j) GROUP BY i)),
    {_component_sql("one", "cov")},
    rest AS (SELECT list_transform(a, lambda x, i: list_transform(x, lambda z, j: z - l * w[i] * w[j])) AS a FROM (SELECT a, w,
      list_dot_product(list_transform(a, lambda x: list_dot_product(x, w)), w) AS l FROM cov, one)),
    {_component_sql("two", "rest")}
    SELECT vec_id, round(list_dot_product(v, one.w), 6) AS projected_0, round(list_dot_product(v, two.w), 6) AS projected_1
    FROM pts, one, two""",
)
def pca_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Scores on the two directions of largest variance."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return spread(vectors.project(rows, "embedding", 2).select("vec_id", "projected"), "projected", 2, 6)


_CENTRES = "cen AS (SELECT label AS centre, [" + ", ".join(f"avg(embedding[{j + 1}]::double)" for j in range(64)) + """] AS c
  FROM embeddings GROUP BY label)"""


@query(
    "nearest_to_centre",
    sql=f"""WITH {_CENTRES}, d AS (SELECT centre, vec_id, sqrt(list_sum(list_transform(range(1, 65),
      lambda k: (embedding[k]::double - c[k]) * (embedding[k]::double - c[k])))) AS distance FROM embeddings, cen)
    SELECT centre, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY centre ORDER BY distance, vec_id)
    AS rank FROM d QUALIFY rank <= 11""",
)
def nearest_to_centre(spark: SparkSession, sf: str) -> DataFrame:
    """Representative (rank 1) and the ten next rows of each label's mean vector."""
    rows = table(spark, sf, "embeddings")
    centres = vectors.as_constants(vectors.centroids(rows, "embedding", "label", 64))
    out = vectors.nearest(rows, "vec_id", "embedding", centres, 11)
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "nearest_rows",
    sql="""WITH pts AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),
    d AS (SELECT a.vec_id AS centre, b.vec_id AS vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (b.v[i] - a.v[i]) ** 2))) AS distance
      FROM pts a, pts b)
    SELECT centre, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY centre ORDER BY distance, vec_id) AS rank
    FROM d QUALIFY rank <= 6""",
)
def nearest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a centre: itself and its five nearest others."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = vectors.nearest_many(rows, "vec_id", "embedding", rows, "vec_id", "embedding", 6)
    return out.select("centre", F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("node_attributes")
def node_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Reduced text vector of country or description, then the recency features of customers (0 for products)."""
    nodes = interaction_graph.static_node_features(spark, sf)
    vectors_ = models.text_vectors(nodes, "name", 512, 4).select("node", "kind", "text_vec")
    cols = ["unique_per_order", "n_unique_items", "frequency", "recency", "T", "monetary_value"]
    ids = interaction_graph.tables(spark, sf).users.select("customer", F.col("u").alias("node"))
    features = customers.customer_features(spark, sf).select("customer", *cols).join(ids, "customer").drop("customer")
    joined = vectors_.join(features, "node", "left")
    extra = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return joined.select("node", "kind", F.concat("text_vec", extra).alias("feat"))


@query(
    "interaction_files",
    sql=f"""WITH {interaction_graph.EDGES}, s AS (SELECT u - 1 AS u, i - 1 - (SELECT count(*) FROM cu) AS i, ts, amount, quantity
      FROM edges) SELECT row_number() OVER (ORDER BY ts, u, i, amount, quantity) AS edge_idx, u + 1 AS u,
      i + (SELECT max(u) + 1 FROM s) + 1 AS i, ts::double AS ts, 1.0::double AS label, amount AS f1, quantity AS f2 FROM s""",
)
def interaction_files(spark: SparkSession, sf: str) -> DataFrame:
    """Interaction lines through CSV, typed, numbered and moved to the one id range."""
    e = interaction_graph.edges(spark, sf)
    users = e.agg(F.max("u")).scalar()
    path = work_path(spark, "interactions-csv")
    files.write_csv(
        e.select(
            (F.col("u") - 1).alias("u"), (F.col("i") - 1 - users).alias("i"), F.col("ts").cast("double").alias("ts"),
            F.lit(1.0).alias("label"), F.col("amount").alias("f1"), F.col("quantity").alias("f2"),
        ),
        path,
    )
    read = interaction_graph.tgraph.read_interactions(spark, path, 2)
    feats = [F.col("feat")[j].alias(f"f{j + 1}") for j in range(2)]
    return interaction_graph.tgraph.reindex(read).select("edge_idx", "u", "i", "ts", "label", *feats)


@query(
    "metric_history",
    sql="""SELECT 'r1' AS run, model, round(sqrt(avg((l_quantity * f - l_extendedprice) ** 2)), 4) AS rmse,
    round(avg(abs(l_quantity * f - l_extendedprice)), 4) AS mae FROM lineitem,
    (SELECT 'flat' AS model, 1500.0::double AS f UNION ALL SELECT 'high', 2500.0) GROUP BY model""",
)
def metric_history(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of two models appended to one table and read back for comparison."""
    path = work_path(spark, "metrics")
    items = table(spark, sf, "lineitem")
    for name, factor in (("flat", 1500.0), ("high", 2500.0)):
        pred = items.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * factor).alias("yhat"))
        files.append_metrics(metrics.regression(pred, "y", "yhat"), path, "r1", name)
    kept = [F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae")]
    return spark.read.parquet(path).select("run", "model", *kept)
