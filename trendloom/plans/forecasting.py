"""Panel and forecasting queries over daily order counts per nation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.functions import dates
from trendloom.operators import backtest, baseline, metrics, models, panel
from trendloom.plans.base import DAILY, daily
from trendloom.plans.registry import query
from trendloom.sources.files import table

HOLIDAYS = ["01-01", "04-27", "05-05", "12-05", "12-25", "12-26"]
_HOLIDAY_SQL = "strftime(ds, '%m-%d') IN (" + ", ".join(f"'{d}'" for d in HOLIDAYS) + ")"
# Fixed value: the days back that forecasts look at.
LAGS = [1, 2, 3, 4, 5, 6, 7, 8, 14, 21, 28, 35, 42, 49]


def is_holiday(ds: str = "ds") -> Column:
    return F.date_format(ds, "MM-dd").isin(HOLIDAYS)


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


@query("daily_series", sql=f"WITH {DAILY} SELECT * FROM daily")
def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf)


@query("mean_series", sql=f"WITH {DAILY} SELECT ds, round(avg(y), 6) AS y FROM daily GROUP BY ds")
def mean_series(spark: SparkSession, sf: str) -> DataFrame:
    return panel.mean_series(daily(spark, sf), "ds", "y").select("ds", r6("y"))


_GAPS = """gaps AS (SELECT * FROM (SELECT entity, ds, date_diff('day', lag(ds) OVER w, ds)::bigint AS gap_days
  FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ds)) WHERE gap_days > {n})"""


@query("panel_gaps", sql=f"WITH {DAILY}, {_GAPS.format(n=7)} SELECT * FROM gaps")
def panel_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return panel.gaps(daily(spark, sf), "entity", "ds", 7)


@query(
    "gap_entities",
    sql=f"""WITH {DAILY}, {_GAPS.format(n=14)}, per AS (SELECT entity, count(*) AS n FROM gaps GROUP BY entity)
    SELECT count(*) AS with_gap, coalesce(count_if(n > 1), 0)::bigint AS with_several FROM per""",
)
def gap_entities(spark: SparkSession, sf: str) -> DataFrame:
    per = panel.gap_counts(daily(spark, sf), "entity", "ds", 14)
    return per.agg(F.count(F.lit(1)).alias("with_gap"), F.count_if(F.col("n_gaps") > 1).alias("with_several"))


@query(
    "drop_inactive",
    sql=f"""WITH {DAILY} SELECT * FROM daily WHERE entity IN
    (SELECT entity FROM daily GROUP BY entity HAVING max(ds) >= DATE '2001-07-25')""",
)
def drop_inactive(spark: SparkSession, sf: str) -> DataFrame:
    return panel.drop_inactive(daily(spark, sf), "entity", "ds", "2001-07-25")


@query(
    "drop_gappy",
    sql=f"""WITH {DAILY}, {_GAPS.format(n=20)} SELECT * FROM daily WHERE entity NOT IN
    (SELECT entity FROM gaps GROUP BY entity HAVING count(*) > 1)""",
)
def drop_gappy(spark: SparkSession, sf: str) -> DataFrame:
    return panel.drop_gappy(daily(spark, sf), "entity", "ds", 20, 1)


@query(
    "calendar_features",
    sql=f"""WITH {DAILY} SELECT entity, ds, y, isodow(ds) - 1 AS day_of_week, day(ds) AS day_of_month,
    dayofyear(ds) AS day_of_year, weekofyear(ds) AS week_of_year, month(ds) AS month,
    (isodow(ds) - 1 > 5)::bigint AS is_weekend,
    (ds BETWEEN DATE '1999-03-01' AND DATE '2000-07-31')::bigint AS in_span,
    ({_HOLIDAY_SQL})::bigint AS is_national_holiday FROM daily""",
)
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    flags = panel.fixed_holidays("ds", HOLIDAYS)
    return (
        panel.calendar(daily(spark, sf), "ds", weekend_from=6)
        .withColumn("in_span", panel.in_range("ds", "1999-03-01", "2000-07-31"))
        .withColumns(flags)
        .withColumn("is_national_holiday", panel.holiday_count(list(flags)))
        .drop(*flags)
    )


@query(
    "running_hours",
    sql="""WITH spans AS (SELECT user_id, ts::date AS ds, min(ts) AS opened,
      CASE WHEN count(*) > 1 THEN max(ts) END AS closed FROM events GROUP BY 1, 2)
    SELECT user_id, ds, round((epoch_us(closed) - epoch_us(opened)) / 3.6e9, 6) AS running_hours,
      hour(opened) AS opening_hour, hour(closed) AS closing_hour FROM spans WHERE closed IS NOT NULL""",
)
def running_hours(spark: SparkSession, sf: str) -> DataFrame:
    """First and last event of a user's day as opening times; a day with one event has no closing time and is dropped."""
    several = F.count(F.lit(1)) > 1
    spans = (
        table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("ds"))
        .agg(F.min("ts").alias("opened"), F.when(several, F.max("ts")).alias("closed"))
    )
    return panel.opening_hours(spans, "opened", "closed").select(
        "user_id", "ds", r6("running_hours"), "opening_hour", "closing_hour"
    )


@query(
    "cyclic_features",
    sql=f"""WITH {DAILY} SELECT entity, ds, round(sin(2 * pi() * (isodow(ds) - 1) / 7), 6) AS day_sin,
    round(cos(2 * pi() * (isodow(ds) - 1) / 7), 6) AS day_cos FROM daily""",
)
def cyclic_features(spark: SparkSession, sf: str) -> DataFrame:
    sine, cosine = dates.cycle(F.weekday("ds"), 7)
    return daily(spark, sf).select(
        "entity", "ds", F.round(sine, 6).alias("day_sin"), F.round(cosine, 6).alias("day_cos")
    )


@query(
    "date_lags",
    sql=f"WITH {DAILY} SELECT d.*, "
    + ", ".join(f"l{k}.y AS y_lag_{k}" for k in LAGS)
    + " FROM daily d "
    + " ".join(f"LEFT JOIN daily l{k} ON l{k}.entity = d.entity AND l{k}.ds = d.ds - {k}" for k in LAGS),
)
def date_lags(spark: SparkSession, sf: str) -> DataFrame:
    return panel.add_date_lags(daily(spark, sf), "entity", "ds", "y", LAGS)


@query(
    "last_year_value",
    sql=f"""WITH {DAILY} SELECT d.*, p.y AS last_year FROM daily d LEFT JOIN daily p ON p.entity = d.entity
    AND p.ds = (d.ds - INTERVAL 1 YEAR)::date AND strftime(d.ds, '%m-%d') IN
    ({", ".join(f"'{d}'" for d in HOLIDAYS)}, '02-29')""",
)
def last_year_value(spark: SparkSession, sf: str) -> DataFrame:
    where = is_holiday() | (F.date_format("ds", "MM-dd") == "02-29")
    return panel.last_year_value(daily(spark, sf), "entity", "ds", "y", where)


_HELD = """held AS (SELECT * EXCLUDE (back, size), size > {n} AND back <= {n} AS is_test,
  (CASE WHEN size > {n} AND back <= {n} THEN {n} + 1 - back ELSE 0 END)::bigint AS rel FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ds DESC) AS back,
  count(*) OVER (PARTITION BY entity) AS size FROM daily))"""


@query("tail_holdout", sql=f"WITH {DAILY}, {_HELD.format(n=50)} SELECT * FROM held")
def tail_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return panel.holdout_tail(daily(spark, sf), "entity", "ds", 50)


@query(
    "buffer_tail",
    sql=f"""WITH {DAILY} SELECT * FROM daily
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ds DESC) <= 50""",
)
def buffer_tail(spark: SparkSession, sf: str) -> DataFrame:
    return panel.tail(daily(spark, sf), "entity", "ds", 50)


@query(
    "relative_horizon",
    sql=f"""WITH {DAILY} SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ds) AS relative_horizon FROM daily""",
)
def relative_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return panel.position(daily(spark, sf), "entity", "ds")


def _wmean(h: str) -> str:
    return (
        f"CASE WHEN len({h}) = 0 THEN 0.0 ELSE list_sum(list_transform({h}, lambda v, i: v * i)) "
        f"/ (len({h}) * (len({h}) + 1) / 2) END"
    )


@query(
    "weighted_weekday_mean",
    sql=f"""WITH {DAILY}, h AS (SELECT *, coalesce(list(y) OVER (PARTITION BY entity, isodow(ds) ORDER BY ds
      ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS past FROM daily)
    SELECT entity, ds, y, round({_wmean("past")}, 6) AS weekday_mean FROM h""",
)
def weighted_weekday_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = panel.weekday_mean(daily(spark, sf), "entity", "ds", "y", 8, "weekday_mean")
    return out.select("entity", "ds", "y", r6("weekday_mean"))


def naive(held: DataFrame, horizon: int, m: int = 8) -> DataFrame:
    train, test = held.filter("rel = 0"), held.filter("rel > 0")
    return baseline.naive_weighted(train, test, ["entity"], "ds", "y", m, "last_year", 0.3, horizon)


def _held(spark: SparkSession, sf: str, n: int) -> DataFrame:
    base = daily(spark, sf)
    held = panel.holdout_tail(base, "entity", "ds", n)
    # The value one year back must already be known where the held-out tail starts.
    back = panel.last_year_value(held, "entity", "ds", "y", is_holiday(), {"rel": "last_rel"})
    return back.withColumn("last_year", F.when(F.col("last_rel") == 0, F.col("last_year"))).drop("last_rel")


def horizon_report(spark: SparkSession, sf: str, n_test: int = 50, horizon: int = 50) -> DataFrame:
    scored = naive(_held(spark, sf, n_test), horizon)
    out = metrics.by_horizon(scored, "y", "yhat", "relative_horizon")
    return out.select("relative_horizon", *[r6(c) for c in ("rmse", "mae", "mape", "smape")])


def _fold_sql(n: int, m: int, horizon: int, starts: list[int]) -> str:
    """Recursive twin: one step per future row of an (origin, entity, weekday) group."""
    origin_list = ", ".join(str(o) for o in starts)
    return f"""{DAILY}, {_HELD.format(n=n)}, o AS (SELECT unnest([{origin_list}])::bigint AS origin),
    past AS (SELECT o.origin, h.* FROM held h, o WHERE h.rel <= o.origin),
    fut AS (SELECT o.origin, h.entity, h.ds, h.y, isodow(h.ds) AS wd, h.rel - o.origin AS hz, p.y AS ly,
      row_number() OVER (PARTITION BY o.origin, h.entity, isodow(h.ds) ORDER BY h.ds) AS i
      FROM held h JOIN o ON h.rel > o.origin AND h.rel <= o.origin + {horizon}
      LEFT JOIN held p ON p.entity = h.entity AND p.ds = (h.ds - INTERVAL 1 YEAR)::date AND p.rel = 0
        AND strftime(h.ds, '%m-%d') IN ({", ".join(f"'{d}'" for d in HOLIDAYS)})),
    lastm AS (SELECT origin, entity, wd, list(y::double ORDER BY ds) AS hist FROM (SELECT *, isodow(ds) AS wd,
      row_number() OVER (PARTITION BY origin, entity, isodow(ds) ORDER BY ds DESC) AS b FROM past)
      WHERE b <= {m} GROUP BY 1, 2, 3),
    rec AS (SELECT f.origin, f.entity, f.wd, 0::bigint AS i, coalesce(l.hist, []::double[]) AS hist, 0.0::double AS yhat
      FROM (SELECT DISTINCT origin, entity, wd FROM fut) f LEFT JOIN lastm l USING (origin, entity, wd)
      UNION ALL
      SELECT origin, entity, wd, i, list_append(hist, yhat)[-{m}:], yhat FROM (
        SELECT r.origin, r.entity, r.wd, f.i, r.hist,
          CASE WHEN f.ly IS NOT NULL THEN 0.3 * f.ly + 0.7 * ({_wmean("r.hist")}) ELSE {_wmean("r.hist")} END AS yhat
        FROM rec r JOIN fut f ON f.origin = r.origin AND f.entity = r.entity AND f.wd = r.wd AND f.i = r.i + 1)),
    scored AS (SELECT f.origin, f.entity, f.ds, f.y, r.yhat, f.hz AS relative_horizon
      FROM rec r JOIN fut f USING (origin, entity, wd, i))"""


@query(
    "naive_forecast",
    sql=f"""WITH RECURSIVE {_fold_sql(50, 8, 50, [0])}
    SELECT entity, ds, y, round(yhat, 6) AS yhat, relative_horizon FROM scored""",
)
def naive_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return naive(_held(spark, sf, 50), 50).select("entity", "ds", "y", r6("yhat"), "relative_horizon")


_BY_H = """SELECT {by} relative_horizon, sqrt(avg((yhat - y) ** 2)) AS rmse, avg(abs(yhat - y)) AS mae,
  avg(abs(yhat - y) / nullif(y, 0) * 100) AS mape,
  avg(abs(yhat - y) / nullif((abs(yhat) + abs(y)) / 2, 0) * 100) AS smape FROM scored GROUP BY ALL"""
_R4 = "round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mape, 6) AS mape, round(smape, 6) AS smape"


@query(
    "horizon_metrics",
    sql=f"""WITH RECURSIVE {_fold_sql(50, 8, 50, [0])}, by_h AS ({_BY_H.format(by="")})
    SELECT relative_horizon, {_R4} FROM by_h""",
)
def horizon_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return horizon_report(spark, sf)


def _rolling_naive(past: DataFrame, ahead: DataFrame, keys: list[str]) -> DataFrame:
    return baseline.naive_weighted(past, ahead, keys, "ds", "y", 30, "last_year", 0.3, 50)


def _last_weeks(train: DataFrame) -> DataFrame:
    """The last 30 rows of each weekday: all that the baseline looks at."""
    w = Window.partitionBy("entity", F.weekday("ds")).orderBy(F.desc("ds"))
    return train.withColumn("_back", F.row_number().over(w)).filter("_back <= 30")


@query(
    "rolling_backtest",
    sql=f"""WITH RECURSIVE {_fold_sql(80, 30, 50, [0, 5, 10, 15, 20, 25])}, by_h AS ({_BY_H.format(by="origin,")})
    SELECT origin, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae, round(avg(mape), 6) AS mape,
    round(avg(smape), 6) AS smape FROM by_h GROUP BY origin""",
)
def rolling_backtest(spark: SparkSession, sf: str) -> DataFrame:
    starts = backtest.origins(80, 50, 5)
    out = backtest.rolling(_held(spark, sf, 80), "entity", "y", 50, starts, _rolling_naive, _last_weeks)
    return out.select("origin", *[r6(c) for c in ("rmse", "mae", "mape", "smape")])


#: A fixed linear rule: whole weeks back count three times as much as other days.
WEIGHTS = [3.0 if k % 7 == 0 else 1.0 for k in LAGS]
RULE = models.lag_mean(LAGS, WEIGHTS)
FAMILY = 10


def _linear_sql(n: int, buffer: int, starts: list[int], models_: int) -> str:
    """Recursive twin: one step per future row of an (origin, entity)."""
    return f"""{DAILY}, {_HELD.format(n=n)}, o AS (SELECT unnest([{", ".join(map(str, starts))}])::bigint AS origin),
    past AS (SELECT origin, entity, list(date_diff('day', DATE '1970-01-01', ds) ORDER BY ds) AS days, list(y::double ORDER BY ds) AS vals
      FROM (SELECT o.origin, h.*, row_number() OVER (PARTITION BY o.origin, h.entity ORDER BY h.ds DESC) AS b
        FROM held h JOIN o ON h.rel <= o.origin) WHERE b <= {buffer} GROUP BY ALL),
    fut AS (SELECT o.origin, h.entity, h.ds, h.y, h.rel - o.origin AS h, date_diff('day', DATE '1970-01-01', h.ds) AS d
      FROM held h JOIN o ON h.rel > o.origin AND h.rel <= o.origin + 50),
    rec AS (SELECT f.origin, f.entity, 0::bigint AS h, coalesce(days, []::bigint[]) AS days, coalesce(vals, []::double[]) AS vals, 0.0::double AS yhat
        FROM (SELECT DISTINCT origin, entity FROM fut) f LEFT JOIN past USING (origin, entity)
      UNION ALL SELECT origin, entity, h, list_append(days, d), list_append(vals, p), p FROM (SELECT *,
        coalesce(list_sum(list_transform(l, lambda v, i: coalesce(v * ({WEIGHTS})[i], 0.0)))
          / nullif(list_sum(list_transform(l, lambda v, i: CASE WHEN v IS NULL THEN 0.0 ELSE ({WEIGHTS})[i] END)), 0), 0.0) AS p
        FROM (SELECT f.origin, f.entity, f.h, f.d, r.days, r.vals,
          list_transform({LAGS}, lambda k: r.vals[list_position(r.days, f.d - k - (f.h - 1) % {models_})]) AS l
          FROM rec r JOIN fut f ON f.origin = r.origin AND f.entity = r.entity AND f.h = r.h + 1))),
    scored AS (SELECT f.origin, f.entity, f.ds, f.y, r.yhat, f.h AS relative_horizon FROM rec r JOIN fut f USING (origin, entity, h))"""


def _linear(family: list[models.Predictor], buffer: int) -> backtest.Forecaster:
    def run(past: DataFrame, ahead: DataFrame, keys: list[str]) -> DataFrame:
        return models.forecast_with(panel.tail(past, keys, "ds", buffer), ahead, keys, "ds", "y", family, 50)

    return run


@query(
    "linear_recursive",
    sql=f"""WITH RECURSIVE {_linear_sql(50, 50, [0], 1)}
    SELECT entity, ds, y::double AS y, round(yhat, 6) AS yhat, relative_horizon FROM scored""",
)
def linear_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """Step-by-step forecast by a fixed rule over the lags, own predictions fed back."""
    held = panel.holdout_tail(daily(spark, sf), "entity", "ds", 50)
    out = _linear([RULE], 50)(held.filter("rel = 0"), held.filter("rel > 0"), ["entity"])
    return out.withColumn("yhat", r6("yhat"))


@query(
    "linear_hybrid",
    sql=f"""WITH RECURSIVE {_linear_sql(50, 60, [0], FAMILY)}
    SELECT entity, ds, y::double AS y, round(yhat, 6) AS yhat, relative_horizon FROM scored""",
)
def linear_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Ten direct rules in turn, each on lags of its own distance."""
    held = panel.holdout_tail(daily(spark, sf), "entity", "ds", 50)
    family = [models.shifted(RULE, i) for i in range(FAMILY)]
    out = _linear(family, 60)(held.filter("rel = 0"), held.filter("rel > 0"), ["entity"])
    return out.withColumn("yhat", r6("yhat"))


@query(
    "linear_rolling",
    sql=f"""WITH RECURSIVE {_linear_sql(80, 50, [0, 5, 10, 15, 20, 25], 1)}, by_h AS ({_BY_H.format(by="origin,")})
    SELECT origin, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae, round(avg(mape), 6) AS mape,
    round(avg(smape), 6) AS smape FROM by_h GROUP BY origin""",
)
def linear_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling origins of the recursive rule; only the rows that an origin can reach are multiplied."""
    held = panel.holdout_tail(daily(spark, sf), "entity", "ds", 80)
    prune = lambda train: panel.tail(train, "entity", "ds", 50)
    out = backtest.rolling(held, "entity", "y", 50, backtest.origins(80, 50, 5), _linear([RULE], 50), prune)
    return out.select("origin", *[r6(c) for c in ("rmse", "mae", "mape", "smape")])


_ACF = f"""{DAILY}, s AS (SELECT ds, avg(y) AS y FROM daily GROUP BY ds), c AS (SELECT ds, y - avg(y) OVER () AS d FROM s),
  acf AS (SELECT k.lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM c) AS acf
  FROM (SELECT unnest(range(0, 101)) AS lag) k JOIN c a ON true JOIN c b ON b.ds = a.ds - k.lag::int GROUP BY k.lag)"""


@query("acf", sql=f"WITH {_ACF} SELECT lag, round(acf, 6) AS acf FROM acf")
def acf(spark: SparkSession, sf: str) -> DataFrame:
    return panel.acf(panel.mean_series(daily(spark, sf), "ds", "y"), "ds", "y", 100).select("lag", r6("acf"))


@query(
    "pacf",
    sql=f"""WITH RECURSIVE {_ACF}, r AS (SELECT list(acf ORDER BY lag) AS c FROM acf),
    dl AS (SELECT 0::bigint AS lag, []::double[] AS phi, 1.0::double AS pacf
      UNION ALL
      SELECT k, list_append(list_transform(phi, lambda p, j: p - new * phi[k - j]), new), new FROM (
        SELECT dl.lag + 1 AS k, phi,
          (r.c[dl.lag + 2] - coalesce(list_sum(list_transform(phi, lambda p, j: p * r.c[dl.lag + 2 - j])), 0))
          / (1 - coalesce(list_sum(list_transform(phi, lambda p, j: p * r.c[j + 1])), 0)) AS new
        FROM dl, r WHERE dl.lag < 100))
    SELECT lag, round(pacf, 5) AS pacf FROM dl""",
)
def pacf(spark: SparkSession, sf: str) -> DataFrame:
    series = panel.mean_series(daily(spark, sf), "ds", "y")
    return panel.pacf(series, "ds", "y", 100).select("lag", F.round("pacf", 5).alias("pacf"))


def _weeks_sql(m: int) -> str:
    return f"""SELECT {m}::bigint AS m, round(avg(rmse), 6) AS rmse FROM (
    WITH RECURSIVE {_fold_sql(50, m, 50, [0])}, by_h AS ({_BY_H.format(by="")}) SELECT * FROM by_h)"""


WEEKS = list(range(10, 33, 2))


@query("weeks_search", sql=" UNION ALL ".join(_weeks_sql(m) for m in WEEKS))
def weeks_search(spark: SparkSession, sf: str) -> DataFrame:
    """Mean RMSE of the baseline for each number of past weeks, all candidates in one job."""
    held = _held(spark, sf, 50)
    train, test = held.filter("rel = 0"), held.filter("rel > 0")
    scored = baseline.naive_weighted(train, test, ["entity"], "ds", "y", WEEKS, "last_year", 0.3, 50)
    by_step = metrics.by_horizon(scored, "y", "yhat", "relative_horizon", by=["m"])
    return metrics.macro(by_step, by=["m"]).select("m", r6("rmse"))
