"""Daily panels: one row per (key, day).

That uniqueness is what bounds every window below: a key can have no more rows than there are days. ``daily_counts``
collapses raw rows to it with map-side partial sums, so a hot key never travels whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import dates


def daily_counts(rows: DataFrame, key: str, day: Column, y: str = "y") -> DataFrame:
    return rows.groupBy(F.col(key), day.alias("ds")).agg(F.count(F.lit(1)).alias(y))


def mean_series(df: DataFrame, ds: str, y: str) -> DataFrame:
    return df.groupBy(ds).agg(F.avg(y).alias(y))


def duplicate_days(df: DataFrame, key: str, ds: str) -> DataFrame:
    """(key, day) pairs that break the uniqueness the panel functions rely on; empty on a sound panel."""
    return df.groupBy(key, ds).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gaps(df: DataFrame, key: str, ds: str, max_days: int) -> DataFrame:
    """Rows that follow strictly more than ``max_days`` days without a row of the same key."""
    w = Window.partitionBy(key).orderBy(ds)
    return (
        df.select(key, ds)
        .withColumn("gap_days", F.date_diff(F.col(ds), F.lag(ds).over(w)).cast("long"))
        .filter(F.col("gap_days") > max_days)
    )


def gap_counts(df: DataFrame, key: str, ds: str, max_days: int) -> DataFrame:
    return gaps(df, key, ds, max_days).groupBy(key).agg(F.count(F.lit(1)).alias("n_gaps"))


def drop_inactive(df: DataFrame, key: str, ds: str, cutoff: str) -> DataFrame:
    """Keep the keys whose last day is not before ``cutoff``."""
    stopped = df.groupBy(key).agg(F.max(ds).alias("_last")).filter(F.col("_last") < F.lit(cutoff).cast("date"))
    return df.join(stopped.select(key), key, "left_anti")


def drop_gappy(df: DataFrame, key: str, ds: str, max_days: int, max_gaps: int = 1) -> DataFrame:
    """Keep the keys with at most ``max_gaps`` gaps longer than ``max_days``."""
    gappy = gap_counts(df, key, ds, max_days).filter(F.col("n_gaps") > max_gaps)
    return df.join(gappy.select(key), key, "left_anti")


def calendar_columns(ds: str | Column, weekend_from: int = 5) -> dict[str, Column]:
    """Calendar columns of a day; weekdays count from Monday = 0."""
    wd = F.weekday(ds)
    return {
        "day_of_week": wd.cast("long"),
        "day_of_month": F.dayofmonth(ds).cast("long"),
        "day_of_year": F.dayofyear(ds).cast("long"),
        "week_of_year": F.weekofyear(ds).cast("long"),
        "month": F.month(ds).cast("long"),
        "is_weekend": (wd >= weekend_from).cast("long"),
    }


def calendar(df: DataFrame, ds: str, weekend_from: int = 5) -> DataFrame:
    return df.withColumns(calendar_columns(ds, weekend_from))


def opening_hours(df: DataFrame, opened: str, closed: str) -> DataFrame:
    """Hours open and the opening and closing hour; rows without both times are dropped."""
    return df.na.drop(subset=[opened, closed]).withColumns(
        {
            "running_hours": dates.hours_between(opened, closed),
            "opening_hour": F.hour(opened).cast("long"),
            "closing_hour": F.hour(closed).cast("long"),
        }
    )


def holiday_count(flags: Sequence[str]) -> Column:
    """How many of the holiday flags are set; a missing flag counts as unset."""
    terms = [F.coalesce(F.col(f).cast("long"), F.lit(0).cast("long")) for f in flags]
    return sum(terms[1:], terms[0])


def fixed_holidays(ds: str, days: Sequence[str]) -> dict[str, Column]:
    """One 0/1 column per fixed 'MM-dd' holiday."""
    return {f"holiday_{d.replace('-', '_')}": (F.date_format(ds, "MM-dd") == d).cast("long") for d in days}


def in_range(ds: str, first: str, last: str) -> Column:
    return F.col(ds).between(F.lit(first).cast("date"), F.lit(last).cast("date")).cast("long")


def add_date_lags(
    df: DataFrame, key: str, ds: str, y: str, lags: Sequence[int], prefix: str | None = None
) -> DataFrame:
    """Value exactly k calendar days earlier, null when that day is missing; every lag shares one shuffle and sort."""
    name = prefix or f"{y}_lag_"
    w = Window.partitionBy(key).orderBy("_day")
    out = df.withColumn("_day", dates.day_number(ds))
    return out.withColumns({f"{name}{k}": F.max(y).over(w.rangeBetween(-k, -k)) for k in lags}).drop("_day")


def last_year_value(df: DataFrame, key: str, ds: str, y: str, where: Column, extra: Mapping[str, str] = {}) -> DataFrame:
    """Value of the same calendar day one year earlier on the rows where ``where`` holds (29 February looks at the 28th)."""
    wanted = df.withColumn("_back", F.when(where, F.add_months(ds, -12)))
    past = df.select(
        key, F.col(ds).alias("_back"), F.col(y).alias("last_year"), *[F.col(c).alias(a) for c, a in extra.items()]
    )
    return wanted.join(past, [key, "_back"], "left").drop("_back")


def position(df: DataFrame, key: str, ds: str, name: str = "relative_horizon") -> DataFrame:
    w = Window.partitionBy(key).orderBy(ds)
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def holdout_tail(df: DataFrame, key: str, ds: str, n: int) -> DataFrame:
    """Flag the last n rows of each key, if it has more than n; ``rel`` is 1..n inside the held-out tail, else 0."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(ds).desc()))
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    return (
        df.withColumn("_back", back)
        .withColumn("_size", size)
        .withColumn("is_test", (F.col("_size") > n) & (F.col("_back") <= n))
        .withColumn("rel", F.when(F.col("is_test"), n + 1 - F.col("_back")).otherwise(0).cast("long"))
        .drop("_back", "_size")
    )


def tail(df: DataFrame, key: str | Sequence[str], ds: str, n: int) -> DataFrame:
    """Last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(ds).desc())
    return df.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n).drop("_back")


def weighted_mean(values: Column) -> Column:
    """Mean with weights 1..n from oldest to newest; 0 for an empty array."""
    n = F.size(values).cast("double")
    weighted = F.aggregate(
        F.transform(values, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(weighted / F.greatest(n * (n + 1) / 2, F.lit(1.0)))


def weekday_mean(df: DataFrame, key: str, ds: str, y: str, m: int, name: str) -> DataFrame:
    """Weighted mean of the last m earlier values of the same weekday (what exists, if fewer)."""
    w = Window.partitionBy(key, F.weekday(ds)).orderBy(ds).rowsBetween(-m, -1)
    return df.withColumn(name, weighted_mean(F.collect_list(y).over(w)))


def _centred(df: DataFrame, ds: str, y: str) -> DataFrame:
    mean = df.agg(F.avg(y)).scalar()
    return df.select(dates.day_number(ds).alias("_day"), (F.col(y) - mean).alias("_dev"))


def acf(df: DataFrame, ds: str, y: str, max_lag: int) -> DataFrame:
    """Autocorrelation of one daily series to ``max_lag`` calendar days."""
    dev = _centred(df, ds, y)
    power = dev.agg(F.sum(F.col("_dev") * F.col("_dev"))).scalar()
    lags = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    shifted = dev.select("_day", "_dev", lags).select(
        F.col("lag").cast("long").alias("lag"), (F.col("_day") + F.col("lag")).alias("_day"), F.col("_dev").alias("_past")
    )
    pairs = shifted.join(dev, "_day")
    return pairs.groupBy("lag").agg(F.try_divide(F.sum(F.col("_dev") * F.col("_past")), F.max(power)).alias("acf"))


def pacf(df: DataFrame, ds: str, y: str, max_lag: int) -> DataFrame:
    """Partial autocorrelation from the autocorrelations by the Durbin-Levinson recursion over max_lag + 1 numbers."""
    by_lag = F.sort_array(F.collect_list(F.struct("lag", "acf")))
    r = acf(df, ds, y, max_lag).agg(F.transform(by_lag, lambda p: p["acf"]).alias("r"))
    seed = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))
    corr = F.col("r")

    def add(a: Column, v: Column) -> Column:
        return a + v

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        seen = F.aggregate(F.transform(phi, lambda p, j: p * F.get(corr, k - 1 - j)), F.lit(0.0), add)
        used = F.aggregate(F.transform(phi, lambda p, j: p * F.get(corr, j + 1)), F.lit(0.0), add)
        new = F.try_divide(F.get(corr, k) - seen, 1 - used)
        kept = F.transform(phi, lambda p, j: p - new * F.get(phi, k - 2 - j))
        return F.struct(F.concat(kept, F.array(new)).alias("phi"), F.concat(state["out"], F.array(new)).alias("out"))

    folded = r.select(F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), seed, step)["out"].alias("out"))
    return folded.select(F.posexplode("out").alias("lag", "pacf")).select(F.col("lag").cast("long").alias("lag"), "pacf")


def period_rollup(df: DataFrame, keys: Sequence[str], ts: str, aggs: Sequence[Column]) -> DataFrame:
    """Month x keys aggregate in one hash aggregation, stamped with the last day of the month."""
    stamped = df.withColumn("period_end", F.last_day(ts))
    return stamped.groupBy("period_end", *keys).agg(*aggs)
