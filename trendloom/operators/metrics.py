"""Regression, ranking and classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import ordering
from trendloom.sources.work import store


def _terms(y: Column, p: Column) -> dict[str, Column]:
    gap = p - y
    return {
        "sq": gap * gap,
        "ab": F.abs(gap),
        "ape": F.try_divide(F.abs(gap), F.abs(y)) * 100,
        "sape": F.try_divide(F.abs(gap), (F.abs(p) + F.abs(y)) / 2) * 100,
    }


def by_horizon(df: DataFrame, y: str, yhat: str, h: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, MAPE and sMAPE of each forecast step; undefined percentages are left out of the mean."""
    t = _terms(F.col(y).cast("double"), F.col(yhat).cast("double"))
    return df.groupBy(*by, h).agg(
        F.sqrt(F.avg(t["sq"])).alias("rmse"),
        F.avg(t["ab"]).alias("mae"),
        F.avg(t["ape"]).alias("mape"),
        F.avg(t["sape"]).alias("smape"),
    )


def macro(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "mape", "smape")])


def regression(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), floor: float = 100.0) -> DataFrame:
    """RMSE, MAE, R2, sMAPE (0/0 skipped and 0/0 as 0) and MAPE with the actual floored and the prediction clipped at 0."""
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    t = _terms(a, p)
    low = F.greatest(a, F.lit(floor))
    spread = F.var_pop(a) * F.count(a)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(t["sq"])).alias("rmse"),
        F.avg(t["ab"]).alias("mae"),
        (1 - F.try_divide(F.sum(t["sq"]), spread)).alias("r2"),
        F.avg(t["sape"]).alias("smape"),
        F.avg(F.when((a == 0) & (p == 0), F.lit(0.0)).otherwise(t["sape"])).alias("smape_guarded"),
        (F.avg(F.abs(low - F.greatest(p, F.lit(0.0))) / low) * 100).alias("adjusted_mape"),
    )


def by_quantile(df: DataFrame, y: str, yhat: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """Regression metrics per equal-sized group of the target."""
    size = df.agg(F.count(F.lit(1))).scalar()
    ranked = ordering.global_index(df.select(*order, yhat), [*order], "_at")
    tiled = ranked.withColumn("tile", ordering.tile_of(F.col("_at"), size, n))
    return regression(tiled, y, yhat, by=["tile"])


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    hit = (F.col(label) == 1).cast("long")
    return df.groupBy(score).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative counts and rates at each distinct score, from the highest down (a row is positive at score >= s)."""
    counts = _score_counts(df, label, score)
    kept = lambda df: store(df, "curve", "zstd")
    up = ordering.running_totals(counts, [F.col(score).desc()], {"tp": "pos", "fp": "neg"}, keep=kept)
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return up.select(
        F.col(score).alias("threshold"),
        "pos",
        "neg",
        "tp",
        "fp",
        F.try_divide(F.col("tp"), totals["p"]).alias("tpr"),
        F.try_divide(F.col("fp"), totals["n"]).alias("fpr"),
    )


def auc(df: DataFrame, label: str, score: str, curve: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve: each step is a trapezoid whose left edge is known from its own counts.

    ``curve`` is the ``roc`` of the rows where it is at hand, so that several figures share one order of the scores.
    """
    r = roc(df, label, score) if curve is None else curve
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return r.agg(F.try_divide(area, F.max("tp") * F.max("fp")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, curve: DataFrame | None = None) -> DataFrame:
    """Sum of recall gains times precision over the distinct scores; ``curve`` as in ``auc``."""
    r = roc(df, label, score) if curve is None else curve
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return r.agg(F.try_divide(gain, F.max("tp")).alias("ap"))


def youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """Score with the greatest TPR - FPR; the highest such score on a tie."""
    r = roc(df, label, score).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = F.max(F.struct("j", "threshold"))
    return r.agg(best.alias("b")).select(F.col("b.threshold").alias("threshold"), F.col("b.j").alias("j"))


def threshold(score: str, cut: float, strict: bool = True) -> Column:
    over = F.col(score) > cut if strict else F.col(score) >= cut
    return over.cast("long")


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the macro and weighted means."""
    cells = df.groupBy(F.col(label).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    each = cells.select(
        "n", F.explode(F.array_distinct(F.array("y", "p"))).alias("class"), "y", "p"
    )
    hit, said, is_ = (F.col("y") == F.col("p")), F.col("p") == F.col("class"), F.col("y") == F.col("class")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    per = each.groupBy("class").agg(
        count(hit & is_).alias("tp"), count(said).alias("said"), count(is_).alias("support")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumn("precision", ratio(F.col("tp"), F.col("said"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("support"))
    )
    per = per.withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    three = ("precision", "recall", "f1")
    rows = per.select("class", *three, "support")
    support = F.sum("support")
    mean = per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in three], support.alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("class"),
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in three],
        support.alias("support"),
    )
    share = F.try_divide(F.sum("tp"), F.sum("support"))
    accuracy = per.agg(F.lit("accuracy").alias("class"), *[share.alias(c) for c in three], support.alias("support"))
    return rows.unionByName(accuracy).unionByName(mean).unionByName(weighted)


def bce(label: Column, logit: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))

