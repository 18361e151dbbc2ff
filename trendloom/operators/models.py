"""Panel, customer and text models on pyspark.ml."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, CountVectorizer, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import dates, hashing
from trendloom.operators import ordering, panel, sampling
from trendloom.sources.work import settle, store

CALENDAR = ["day_of_week", "day_of_month", "day_of_year", "week_of_year", "month", "is_weekend"]
MISSING = -1.0


def lag_features(values: Mapping[int, Column]) -> dict[str, Column]:
    """A lag that is missing becomes a sentinel with an indicator beside it."""
    out = {}
    for k, v in values.items():
        out[f"lag_{k}"] = F.coalesce(v.cast("double"), F.lit(MISSING))
        out[f"no_lag_{k}"] = v.isNull().cast("double")
    return out


def _lag_array(day: Column, lags: Sequence[int]) -> Column:
    """The columns of ``lag_names`` as one array, looked up in a day -> value map."""

    def pair(k: Column) -> Column:
        found = F.try_element_at("_hist", day - k)
        return F.array(F.coalesce(found, F.lit(MISSING)), found.isNull().cast("double"))

    return F.flatten(F.transform(F.array(*[F.lit(k) for k in lags]), pair))


def lag_names(lags: Sequence[int]) -> list[str]:
    return [name for k in lags for name in (f"lag_{k}", f"no_lag_{k}")]


def training_frame(df: DataFrame, key: str, ds: str, y: str, lags: Sequence[int]) -> DataFrame:
    """Calendar and date-lag features of a panel; all lags share one shuffle."""
    wide = panel.add_date_lags(panel.calendar(df, ds), key, ds, y, lags, prefix="_raw_")
    made = wide.withColumns(lag_features({k: F.col(f"_raw_{k}") for k in lags}))
    return made.drop(*[f"_raw_{k}" for k in lags])


def code_names(categorical: Sequence[str]) -> list[str]:
    return [f"{c}_{part}" for c in categorical for part in ("mean", "rows")]


@dataclass(frozen=True)
class PanelModel:
    """A regressor over all entities with the numbers that stand for its categories.

    A value is encoded by its training mean and row count, a table joined on the value: the same for a panel of any
    number of keys, and never gathered on the driver. An unseen or null value has the overall mean and no rows.
    """

    pipeline: PipelineModel
    codes: DataFrame | None
    overall: float

    @property
    def inputs(self) -> list[str]:
        return self.pipeline.stages[0].getInputCols()

    @property
    def trees(self):
        return self.pipeline.stages[-1]

    def encode(self, df: DataFrame, categorical: Sequence[str]) -> DataFrame:
        for c in categorical:
            mine = self.codes.filter(F.col("category") == c).select(
                F.col("value").alias("_value"), F.col("mean").alias("_mean"), F.col("n").alias("_n")
            )
            met = df.join(mine, F.col(c).cast("string") == F.col("_value"), "left")
            df = met.withColumns(
                {f"{c}_mean": F.coalesce("_mean", F.lit(self.overall)), f"{c}_rows": F.coalesce("_n", F.lit(0.0))}
            ).drop("_value", "_mean", "_n")
        return df

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/trees")
        if self.codes is not None:
            whole = self.codes.withColumn("overall", F.lit(self.overall))
            whole.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, categorical: bool = True) -> PanelModel:
        codes = spark.read.parquet(f"{path}/codes") if categorical else None
        overall = codes.first()["overall"] if categorical else 0.0
        return cls(PipelineModel.load(f"{path}/trees"), codes, overall)


def fit_global(
    frame: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str] = (), seed: int = 91, **params: object
) -> PanelModel:
    """One boosted-tree regressor over all entities; categories enter by their training mean and row count."""
    codes, overall = None, 0.0
    for c in categorical:
        each = frame.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(
            F.avg(y).alias("mean"), F.count(F.lit(1)).cast("double").alias("n")
        ).select(F.lit(c).alias("category"), "value", "mean", "n")
        codes = each if codes is None else codes.unionByName(each)
    if codes is not None:
        codes = store(codes, "codes")
        overall = float(frame.agg(F.avg(y)).first()[0] or 0.0)
    assembler = VectorAssembler(inputCols=[*numeric, *code_names(categorical)], outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol=y, predictionCol="prediction", seed=seed, **params)
    coded = PanelModel(None, codes, overall).encode(frame, categorical)
    return PanelModel(Pipeline(stages=[assembler, trees]).fit(coded), codes, overall)


def fit_linear(frame: DataFrame, y: str, cols: Sequence[str]) -> LinearRegressionModel:
    """Least squares by the normal equations: one pass over the rows, a solve of one row and column per input."""
    ready = VectorAssembler(inputCols=list(cols), outputCol="_inputs").transform(frame).select("_inputs", F.col(y).cast("double").alias("_y"))
    return LinearRegression(featuresCol="_inputs", labelCol="_y", solver="normal", regParam=0.0).fit(ready)


def score_linear(model: LinearRegressionModel, frame: DataFrame, cols: Sequence[str], name: str = "yhat") -> DataFrame:
    """The fitted plane as a column expression."""
    terms = [F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(cols, model.coefficients)]
    return frame.withColumn(name, sum(terms, F.lit(float(model.intercept))))


def score(model: PanelModel, frame: DataFrame, categorical: Sequence[str] = (), name: str = "yhat") -> DataFrame:
    scored = model.pipeline.transform(model.encode(frame, categorical)).withColumnRenamed("prediction", name)
    return scored.drop("features", *code_names(categorical))


@dataclass(frozen=True)
class Choice:
    """Range of a setting: whole numbers in steps, or numbers spread evenly by value or by logarithm."""

    low: float
    high: float
    kind: str = "float"
    step: int = 1

    def at(self, share: float) -> float | int:
        """The value at a share of [0, 1) of the range."""
        if self.kind == "int":
            return int(self.low) + self.step * int(share * ((int(self.high) - int(self.low)) // self.step + 1))
        if self.kind == "log":
            return math.exp(math.log(self.low) + share * (math.log(self.high) - math.log(self.low)))
        return self.low + share * (self.high - self.low)


def settings(space: Mapping[str, Choice], trials: int, seed: int = 91) -> list[dict[str, float | int]]:
    """Random settings that depend on seed, trial and name alone."""

    def share(trial: int, name: str) -> float:
        return int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:13], 16) / 16**13

    return [{name: choice.at(share(t, name)) for name, choice in space.items()} for t in range(trials)]


def in_parallel(work: Callable[[object], object], items: Sequence[object], workers: int = 4) -> list:
    """Independent Spark jobs side by side from driver threads; results in the order of ``items``."""
    with ThreadPoolExecutor(max(1, min(workers, len(items)))) as pool:
        return list(pool.map(work, items))


def search(
    blocked: DataFrame, y: str, chosen: Sequence[Mapping[str, object]], folds: int, fit: Callable[..., PanelModel],
    predict: Callable[[PanelModel, DataFrame], DataFrame], keep: float = 0.5, workers: int = 4,
) -> DataFrame:
    """Validation error of settings over expanding time folds; after each fold only the better share ``keep`` goes on.

    ``blocked`` carries ``block`` and is written once; the fits of a fold are independent jobs side by side, and what goes on is
    decided when all are in, so results do not depend on their order. One row per setting: its number, the folds it saw, its
    mean squared error over them, and whether it is the best of those that saw all.
    """
    frame = store(blocked, "search")
    gap = F.col("yhat") - F.col(y)
    alive, errors = list(range(len(chosen))), {n: [] for n in range(len(chosen))}
    for j in range(1, folds + 1):
        train, valid = sampling.fold(frame, j)

        def error(n: int) -> float:
            return float(predict(fit(train, **chosen[n]), valid).agg(F.avg(gap * gap)).first()[0])

        for n, e in zip(alive, in_parallel(error, alive, workers)):
            errors[n].append(e)
        ranked = sorted(alive, key=lambda n: (sum(errors[n]), n))
        alive = ranked if j == folds else ranked[: max(1, math.ceil(keep * len(ranked)))]
    rows = [
        (n, json.dumps(dict(s), sort_keys=True), len(errors[n]), sum(errors[n]) / len(errors[n]), n == alive[0])
        for n, s in enumerate(chosen)
    ]
    return blocked.sparkSession.createDataFrame(rows, "setting long, params string, folds long, mse double, best boolean")


def importances(model: PanelModel, spark: SparkSession) -> DataFrame:
    """Share of the split gain per input column."""
    values = model.trees.featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(model.inputs, values)], "feature string, importance double")


def rotation(name: str, n: int, seed: int = 0) -> int:
    """How far a column is moved along n rows in hash order: 1 to n - 1, set by seed and name."""
    return 1 + int(hashlib.md5(f"{name}:{seed}".encode()).hexdigest()[:15], 16) % max(n - 1, 1)


def permutation_importance(
    frame: DataFrame, key: str, y: str, cols: Sequence[str], predict: Callable[[DataFrame], DataFrame], seed: int = 0
) -> DataFrame:
    """Rise of the mean squared error when a column is dealt anew among the rows, for all numeric ``cols`` in one job.

    Rows are numbered once, in the hash order of the unique key; a column's values move along that order by a distance of
    its own. Each row then holds its own and its dealt values, and its copies, one per column and one unchanged, are made,
    scored and summed in place. Rows without ``y`` are left out of the means.
    """
    cols = list(cols)
    drawn = frame.withColumn("_h", hashing.draw(key, seed))
    home = store(ordering.global_index(drawn, ["_h", key], "_at").drop("_h"), "numbered")
    n = home.count()
    values = [F.struct(F.lit(k).alias("k"), F.pmod(F.col("_at") + rotation(c, n, seed), F.lit(max(n, 1))).alias("to"),
                       F.col(c).cast("double").alias("v")) for k, c in enumerate(cols)]
    moved = home.select(F.explode(F.array(*values)).alias("m")).select("m.*")
    dealt = moved.groupBy(F.col("to").alias("_at")).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"_{k}") for k in range(len(cols))])
    both = home.join(dealt, "_at").withColumns(
        {"_own": F.array(*[F.col(c).cast("double") for c in cols]), "_new": F.array(*[F.col(f"_{k}") for k in range(len(cols))])}
    )
    kept = [c for c in frame.columns if c not in cols]
    copies = both.select(*kept, "_own", "_new", F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))).alias("_copy"))
    mixed = F.transform("_own", lambda v, k: F.when(k == F.col("_copy"), F.get("_new", k)).otherwise(v))
    ready = copies.select(*kept, "_copy", mixed.alias("_x")).select(*kept, "_copy", *[F.col("_x")[k].alias(c) for k, c in enumerate(cols)])
    gap = F.col("yhat") - F.col(y)
    errors = predict(ready).groupBy("_copy").agg(F.avg(gap * gap).alias("mse"))
    base = errors.filter("_copy = -1").agg(F.max("mse")).scalar()
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_copy") + 1)
    return errors.filter("_copy >= 0").select(name.alias("feature"), (F.col("mse") - base).alias("rise"))


def _future(test: DataFrame, keys: Sequence[str], ds: str, y: str, horizon: int) -> DataFrame:
    numbered = panel.position(test, list(keys), ds, "_h").filter(F.col("_h") <= horizon)
    row = F.struct("_h", F.col(ds).alias("ds"), F.col(y).cast("double").alias("y"))
    return numbered.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_ahead"))


def _history(buffer: DataFrame, keys: Sequence[str], ds: str, y: str) -> DataFrame:
    entry = F.struct(dates.day_number(ds).alias("key"), F.col(y).cast("double").alias("value"))
    return buffer.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_hist"))


def forecast(
    buffer: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    ds: str,
    y: str,
    family: Sequence[PanelModel],
    lags: Sequence[int],
    horizon: int = 50,
    categorical: Sequence[str] = (),
    cut_every: int = 10,
) -> DataFrame:
    """Step-by-step forecast: each step's lags come from the buffer or from earlier predictions, else they are missing.

    Step h uses model (h - 1) mod n of the family, whose lags are shifted by that number; one model gives the recursive
    forecast, several the hybrid one. A key is one row holding its buffered values and its future days, both bounded by the
    buffer size and the horizon, so every step is narrow. The growing plan is cut by a checkpoint.
    """
    state = _future(test, keys, ds, y, horizon).join(_history(buffer, keys, ds, y), list(keys), "left")
    state = state.withColumns(
        {
            "_hist": F.coalesce("_hist", F.create_map().cast("map<bigint,double>")),
            "_preds": F.array().cast("array<double>"),
        }
    )
    state = settle(family[0].encode(state, categorical))
    carried = [c for c in state.columns if c not in ("_hist", "_preds")]
    for shift, model in enumerate(family):
        names = [*CALENDAR, *lag_names([k + shift for k in lags]), *code_names(categorical)]
        if model.inputs != names:
            raise ValueError(f"model {shift + 1} was fitted on other inputs: {model.inputs}")
    for h in range(1, horizon + 1):
        shift = (h - 1) % len(family)
        # A key with fewer future days than the horizon stays in the table; its surplus steps are dropped at the end.
        today = F.coalesce(F.get("_ahead", F.lit(h - 1))["ds"], F.lit("1970-01-01").cast("date"))
        day = dates.day_number(today)
        features = array_to_vector(
            F.concat(
                F.array(*[c.cast("double") for c in panel.calendar_columns(today).values()]),
                _lag_array(day, [k + shift for k in lags]),
                F.array(*[F.col(c) for c in code_names(categorical)]).cast("array<double>"),
            )
        )
        ready = state.select(*carried, "_hist", "_preds", features.alias("features"))
        state = family[shift].trees.transform(ready).select(
            *carried,
            F.map_concat(
                F.map_filter("_hist", lambda k, _: k != day), F.create_map(day, F.col("prediction"))
            ).alias("_hist"),
            F.concat("_preds", F.array("prediction")).alias("_preds"),
        )
        if h % cut_every == 0 and h < horizon:
            state = settle(state)
    kept = F.slice("_preds", F.lit(1), F.size("_ahead"))
    rows = state.select(*keys, F.explode(F.arrays_zip(F.col("_ahead").alias("a"), kept.alias("p"))).alias("r"))
    return rows.select(
        *keys, F.col("r.a.ds").alias(ds), F.col("r.a.y").alias(y), F.col("r.p").alias("yhat"),
        F.col("r.a._h").cast("long").alias("relative_horizon"),
    )


Lag = Callable[[int], Column]
Predictor = Callable[[Lag, Column], Column]


def lag_mean(lags: Sequence[int], weights: Sequence[float], empty: float = 0.0) -> Predictor:
    """Weighted mean of the lags that are known, ``empty`` where none is."""

    def predict(lag: Lag, day: Column) -> Column:
        values = F.array(*[lag(k).cast("double") for k in lags])
        sized = F.array(*[F.lit(float(w)) for w in weights])
        both = F.filter(F.arrays_zip(values.alias("v"), sized.alias("w")), lambda x: x["v"].isNotNull())
        add = lambda s, x: F.struct((s["v"] + x["v"] * x["w"]).alias("v"), (s["w"] + x["w"]).alias("w"))
        zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
        return F.aggregate(both, zero, add, lambda s: F.coalesce(F.try_divide(s["v"], s["w"]), F.lit(float(empty))))

    return predict


def shifted(predictor: Predictor, days: int) -> Predictor:
    """The same rule on lags that many days further back, as a direct model has them."""
    return lambda lag, day: predictor(lambda k: lag(k + days), day)


def forecast_with(
    buffer: DataFrame, test: DataFrame, keys: Sequence[str], ds: str, y: str, family: Sequence[Predictor], horizon: int = 50
) -> DataFrame:
    """The step-by-step forecast of ``forecast`` for predictors that are column expressions.

    A predictor maps a function from a number of days to the value that long ago (null if unknown), and the number of the day,
    to a prediction. Step h uses predictor (h - 1) mod n. A key is one row of its buffered values and future days, both bounded,
    and all steps are one fold over it: two groupings and one join, whatever the horizon.
    """
    state = _future(test, keys, ds, y, horizon).join(_history(buffer, keys, ds, y), list(keys), "left")
    known = F.coalesce("_hist", F.create_map().cast("map<bigint,double>"))
    start = F.struct(known.alias("hist"), F.array().cast("array<double>").alias("preds"))

    def step(s: Column, e: Column) -> Column:
        day = dates.day_number(e["ds"])
        turn = F.pmod(e["_h"] - 1, F.lit(len(family)))
        look = lambda k: F.try_element_at(s["hist"], day - k)
        made = family[-1](look, day)
        for i in range(len(family) - 2, -1, -1):
            made = F.when(turn == i, family[i](look, day)).otherwise(made)
        later = F.map_concat(F.map_filter(s["hist"], lambda k, _: k != day), F.create_map(day, made))
        return F.struct(later.alias("hist"), F.concat(s["preds"], F.array(made)).alias("preds"))

    folded = state.select(*keys, "_ahead", F.aggregate("_ahead", start, step, lambda s: s["preds"]).alias("_preds"))
    rows = folded.select(*keys, F.explode(F.arrays_zip(F.col("_ahead").alias("a"), F.col("_preds").alias("p"))).alias("r"))
    return rows.select(
        *keys, F.col("r.a.ds").alias(ds), F.col("r.a.y").alias(y), F.col("r.p").alias("yhat"),
        F.col("r.a._h").cast("long").alias("relative_horizon"),
    )


def fit_direct(
    df: DataFrame, key: str, ds: str, y: str, lags: Sequence[int], n: int, categorical: Sequence[str], **params: object
) -> list[PanelModel]:
    """Model i learns from lags shifted by i - 1 days, i = 1..n; the models are fitted side by side."""

    def fit(shift: int) -> PanelModel:
        moved = [k + shift for k in lags]
        frame = training_frame(df, key, ds, y, moved)
        return fit_global(frame, y, [*CALENDAR, *lag_names(moved)], categorical, **params)

    return in_parallel(fit, range(n))


def save_family(family: Sequence[PanelModel], path: str) -> None:
    for i, model in enumerate(family, start=1):
        model.save(f"{path}/model_{i}")


def load_family(spark: SparkSession, path: str, n: int, categorical: bool = True) -> list[PanelModel]:
    return [PanelModel.load(spark, f"{path}/model_{i}", categorical) for i in range(1, n + 1)]


def fit_text_classifier(df: DataFrame, text: str, label: str, features: int = 1 << 14) -> PipelineModel:
    """Hashed word weights into a logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=20),
        ]
    ).fit(df)


def score_text(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the positive-class probability as ``score``."""
    scored = model.transform(df)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "_words", "_counts", "features", "rawPrediction", "probability", "prediction"
    )


def text_vectors(df: DataFrame, text: str, features: int, dim: int) -> DataFrame:
    """Word counts over a fitted vocabulary of at most ``features`` words, reduced to ``dim`` principal components, as ``text_vec``."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=features),
        PCA(k=dim, inputCol="_counts", outputCol="_reduced"),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.withColumn("text_vec", vector_to_array("_reduced")).drop("_words", "_counts", "_reduced")
