"""Streaming queries over the events table; each runs its stream to the end of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.plans.registry import query
from trendloom.sources.files import table
from trendloom.streaming import jobs

DELAY = "1 hour"


def events(spark: SparkSession, sf: str, n: int | None = None) -> list[DataFrame]:
    """The events in slices of time, oldest first."""
    return jobs.slices(table(spark, sf, "events"), "ts", n=n)


_MARK = "mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)"


def _daily(stream: DataFrame, slide: str | None, size: str) -> DataFrame:
    aggs = [("n", F.count(F.lit(1))), ("total", F.sum("value"))]
    return jobs.tumbling(stream, "ts", DELAY, size, ["event_type"], aggs, slide)


@query(
    "stream_tumbling",
    sql=f"""WITH {_MARK} SELECT date_trunc('day', ts)::timestamp AS window_start,
    date_trunc('day', ts)::timestamp + INTERVAL 1 DAY AS window_end,
    event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
    HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT w FROM mark)""",
)
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.replay(events(spark, sf), "ts", lambda s: _daily(s, None, "1 day"), "tumbling")
    return out.withColumn("total", F.round("total", 4))


@query(
    "stream_hopping",
    sql=f"""WITH {_MARK}, x AS (SELECT date_trunc('day', ts)::timestamp - to_days(unnest(range(0, 7))::int) AS window_start,
      event_type, value FROM events)
    SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM x GROUP BY ALL HAVING window_start + INTERVAL 7 DAY <= (SELECT w FROM mark)""",
)
def stream_hopping(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.replay(events(spark, sf), "ts", lambda s: _daily(s, "1 day", "7 days"), "hopping")
    return out.withColumn("total", F.round("total", 4))


@query(
    "stream_sessions",
    sql=f"""WITH {_MARK}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
      <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, user_id, count(*) AS n FROM s
    GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT w FROM mark)""",
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.replay(events(spark, sf), "ts", lambda s: jobs.sessions(s, "ts", DELAY, "12 hours", ["user_id"]), "sessions")


def _closed(build, spark: SparkSession, sf: str, label: str) -> DataFrame:
    return jobs.replay(events(spark, sf), "ts", build, label, close=True)


@query(
    "stream_tumbling_closed",
    sql="""SELECT date_trunc('day', ts)::timestamp AS window_start, date_trunc('day', ts)::timestamp + INTERVAL 1 DAY AS window_end,
    event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def stream_tumbling_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows of a finished input: every event is in one."""
    return _closed(lambda s: _daily(s, None, "1 day"), spark, sf, "tumbling-closed").withColumn("total", F.round("total", 4))


@query(
    "stream_hopping_closed",
    sql="""WITH x AS (SELECT date_trunc('day', ts)::timestamp - to_days(unnest(range(0, 7))::int) AS window_start, event_type, value FROM events)
    SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM x GROUP BY ALL""",
)
def stream_hopping_closed(spark: SparkSession, sf: str) -> DataFrame:
    return _closed(lambda s: _daily(s, "1 day", "7 days"), spark, sf, "hopping-closed").withColumn("total", F.round("total", 4))


@query(
    "stream_sessions_closed",
    sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
      <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions_closed(spark: SparkSession, sf: str) -> DataFrame:
    return _closed(lambda s: jobs.sessions(s, "ts", DELAY, "12 hours", ["user_id"]), spark, sf, "sessions-closed")


@query("stream_dedupe", sql="SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every event arrives twice and leaves once."""
    once = lambda s: jobs.dedupe(s.unionByName(s), "ts", DELAY, ["event_id"]).select("event_id", "user_id", "event_type")
    return jobs.replay(events(spark, sf), "ts", once, "dedupe")


@query(
    "stream_node_state",
    sql="""SELECT user_id, event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 6) AS waited,
    row_number() OVER w AS n_seen, false AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def stream_node_state(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.replay(events(spark, sf), "ts", lambda s: jobs.node_state(s, "user_id", "event_id", "ts"), "node-state")
    return out.withColumn("waited", F.round("waited", 6))


@query(
    "stream_time_stats",
    sql="""SELECT user_id, count(d) AS n, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS std FROM (SELECT user_id,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS d FROM events) GROUP BY user_id""",
)
def stream_time_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs.replay(events(spark, sf), "ts", lambda s: jobs.time_stats(s, "user_id", "ts"), "time-stats")
    out = jobs.latest(rows, "user_id")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


_EDGE = "(SELECT date_trunc('day', max(ts)) - INTERVAL 14 DAY FROM events)"


def _edge(df: DataFrame) -> Column:
    """Midnight two weeks before the last day of the data."""
    return df.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAY")).scalar()


def _out_of_order(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The events in two pieces. The first ends at the edge; one in four of its events is held back and comes with the second piece."""
    base = table(spark, sf, "events")
    held_back = F.col("event_id") % 4 == 0
    early = (F.col("ts") < _edge(base)) & ~held_back
    return [base.filter(early), base.filter(~early)]


_LATE = f"""p AS (SELECT *, CASE WHEN ts < {_EDGE} AND event_id % 4 <> 0 THEN 0 ELSE 1 END AS piece FROM events),
  first AS (SELECT user_id, max(ts) AS upto FROM p WHERE piece = 0 GROUP BY user_id)"""


@query(
    "stream_late",
    sql=f"""WITH {_LATE} SELECT user_id, count(*) AS n, count_if(piece = 1 AND ts < upto)::bigint AS n_late
    FROM p LEFT JOIN first USING (user_id) GROUP BY user_id""",
)
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Events older than the node's newest one of an earlier piece are counted and do not move its state back."""
    marked = jobs.replay(_out_of_order(spark, sf), "ts", lambda s: jobs.node_state(s, "user_id", "event_id", "ts"), "late")
    return marked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"))


@query(
    "stream_late_windows",
    sql=f"""WITH {_LATE}, {_MARK}, past AS (SELECT max(ts) - INTERVAL 1 HOUR AS m FROM p WHERE piece = 0),
    kept AS (SELECT * FROM p, past WHERE piece = 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > m)
    SELECT date_trunc('day', ts)::timestamp AS window_start, date_trunc('day', ts)::timestamp + INTERVAL 1 DAY AS window_end, event_type,
    count(*) AS n, round(sum(value), 4) AS total FROM kept GROUP BY ALL
    HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT w FROM mark)""",
)
def stream_late_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose window the watermark has passed are dropped, later rows of the same piece are counted.

    The second piece is late in part: of the events held back, those of days that the first piece closed are lost, those of its
    last day and all newer events are not.
    """
    out = jobs.replay(_out_of_order(spark, sf), "ts", lambda s: _daily(s, None, "1 day"), "late-windows", may_drop=True)
    return out.withColumn("total", F.round("total", 4))
