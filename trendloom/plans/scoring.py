"""Metric queries: regression errors over the invoice lines, ranking and class metrics over the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import metrics
from trendloom.plans.registry import query
from trendloom.sources.files import table

_PRED = "pred AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS yhat FROM lineitem)"
_REG = """count(*) AS n, round(sqrt(avg((yhat - y) ** 2)), 4) AS rmse, round(avg(abs(yhat - y)), 4) AS mae,
  round(1 - sum((yhat - y) ** 2) / nullif(var_pop(y) * count(*), 0), 6) AS r2,
  round(avg(abs(yhat - y) / nullif((abs(yhat) + abs(y)) / 2, 0)) * 100, 6) AS smape,
  round(avg(CASE WHEN y = 0 AND yhat = 0 THEN 0 ELSE abs(yhat - y) / nullif((abs(yhat) + abs(y)) / 2, 0) END) * 100, 6)
    AS smape_guarded,
  round(avg(abs(greatest(y, 100) - greatest(yhat, 0)) / greatest(y, 100)) * 100, 6) AS adjusted_mape"""


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return items.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("yhat"))


def _rounded(df: DataFrame, *lead: str) -> DataFrame:
    shown = [F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae")]
    shown += [F.round(c, 6).alias(c) for c in ("r2", "smape", "smape_guarded", "adjusted_mape")]
    return df.select(*lead, "n", *shown)


@query("regression_metrics", sql=f"WITH {_PRED} SELECT {_REG} FROM pred")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.regression(_pred(spark, sf), "y", "yhat"))


@query(
    "quintile_metrics",
    sql=f"""WITH {_PRED}, t AS (SELECT *, ntile(5) OVER (ORDER BY y, yhat) AS tile FROM pred)
    SELECT tile, {_REG} FROM t GROUP BY tile""",
)
def quintile_metrics(spark: SparkSession, sf: str) -> DataFrame:
    pred = _pred(spark, sf)
    return _rounded(metrics.by_quantile(pred.withColumn("key", F.col("yhat")), "y", "yhat", ["y", "key"]), "tile")


_SCORED = "scored AS (SELECT doc_id, quality::bigint AS label, n_chars / (n_chars + 1000.0) AS score FROM documents JOIN labels USING (doc_id))"
_ROC = f"""{_SCORED}, c AS (SELECT score, count_if(label = 1)::bigint AS pos, count_if(label <> 1)::bigint AS neg FROM scored
  GROUP BY score), r AS (SELECT score AS threshold, pos, neg, (sum(pos) OVER w)::bigint AS tp, (sum(neg) OVER w)::bigint AS fp,
  (sum(pos) OVER w) / (SELECT sum(pos) FROM c) AS tpr, (sum(neg) OVER w) / (SELECT sum(neg) FROM c) AS fpr
  FROM c WINDOW w AS (ORDER BY score DESC))"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    return docs.join(labels, "doc_id")


@query(
    "roc_curve",
    sql=f"""WITH {_ROC} SELECT round(threshold, 9) AS threshold, pos, neg, tp, fp, round(tpr, 6) AS tpr,
    round(fpr, 6) AS fpr FROM r""",
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.roc(_scored(spark, sf), "label", "score")
    shown = [F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr")]
    return out.select(F.round("threshold", 9).alias("threshold"), "pos", "neg", "tp", "fp", *shown)


@query("auc", sql=f"""WITH {_ROC}, e AS (SELECT *, lag(tpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS t0,
    lag(fpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS f0 FROM r)
    SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM e""")
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(_scored(spark, sf), "label", "score").select(F.round("auc", 6).alias("auc"))


@query("average_precision", sql=f"""WITH {_ROC}
    SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM r""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, sf), "label", "score").select(F.round("ap", 6).alias("ap"))


@query("youden", sql=f"""WITH {_ROC} SELECT round(threshold, 9) AS threshold, round(tpr - fpr, 6) AS j FROM r
    ORDER BY tpr - fpr DESC, r.threshold DESC LIMIT 1""")
def youden(spark: SparkSession, sf: str) -> DataFrame:
    best = metrics.youden(_scored(spark, sf), "label", "score")
    return best.select(F.round("threshold", 9).alias("threshold"), F.round("j", 6).alias("j"))


@query("threshold_labels", sql=f"WITH {_SCORED} SELECT doc_id, label, (score > 0.414)::bigint AS pred FROM scored")
def threshold_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("doc_id", "label", metrics.threshold("score", 0.414).alias("pred"))


@query(
    "classification_report",
    sql=f"""WITH {_SCORED}, p AS (SELECT label::varchar AS y, ((score > 0.414)::bigint)::varchar AS p FROM scored),
    k AS (SELECT DISTINCT y AS class FROM p UNION SELECT DISTINCT p FROM p),
    m AS (SELECT class, (SELECT count(*) FROM p WHERE y = class AND p = class) AS tp,
      (SELECT count(*) FROM p WHERE p = class) AS said, (SELECT count(*) FROM p WHERE y = class) AS support FROM k),
    f AS (SELECT class, tp, support, coalesce(tp / nullif(said, 0), 0.0) AS precision,
      coalesce(tp / nullif(support, 0), 0.0) AS recall FROM m),
    g AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM f),
    u AS (SELECT class, precision, recall, f1, support FROM g
      UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM g
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM g
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM g)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      support::bigint AS support FROM u""",
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    pred = _scored(spark, sf).withColumn("pred", metrics.threshold("score", 0.414))
    out = metrics.classification_report(pred, "label", "pred")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("bce_loss", sql=f"""WITH {_SCORED}, l AS (SELECT label, (score - 0.5) * 8 AS x FROM scored)
    SELECT round(avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))), 6) AS loss FROM l""")
def bce_loss(spark: SparkSession, sf: str) -> DataFrame:
    logit = (F.col("score") - 0.5) * 8
    return _scored(spark, sf).agg(F.round(F.avg(metrics.bce(F.col("label"), logit)), 6).alias("loss"))


@query("zero_targets", sql=f"""WITH t AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS y
    FROM orders GROUP BY 1) SELECT (y > 0)::bigint AS positive, count(*) AS n, round(avg(y), 4) AS mean FROM t GROUP BY 1""")
def zero_targets(spark: SparkSession, sf: str) -> DataFrame:
    spend = F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0)).alias("y")
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(spend)
    split = per.groupBy((F.col("y") > 0).cast("long").alias("positive"))
    return split.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 4).alias("mean"))
