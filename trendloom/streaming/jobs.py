"""Structured Streaming jobs over timestamped interactions.

Each builder maps a streaming DataFrame to a streaming DataFrame; ``run`` drives one to the end of its input and returns what
it wrote. Event time is a zoned timestamp, because a watermark does not accept a zone-less one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trendloom.functions import dates
from trendloom.sources.work import work_path


#: Rows of one slice of a replay.
SLICE_ROWS = 5_000_000


def read(spark: SparkSession, pattern: str, schema: T.StructType, ts: str) -> DataFrame:
    """Files as a stream; all that are there when a run starts make one micro-batch.

    The wall clock of ``ts`` is read as UTC, so windows and outputs do not depend on the session zone.
    """
    stream = spark.readStream.schema(schema).parquet(pattern)
    return stream.withColumn(ts, F.timestamp_micros(dates.epoch_micros(ts)))


def slices(df: DataFrame, ts: str, rows: int = SLICE_ROWS, n: int | None = None) -> list[DataFrame]:
    """The rows cut by time into slices of about ``rows`` rows, oldest first; equal times stay together, null times come first.

    Cuts come from the data, whatever its files are, so a replay of the slices has no late rows at any size. The table is read
    once to count, once to cut, and once to write all slices, range-partitioned by their number; a slice is then a folder of
    its own, however many there are.
    """
    n = n or max(1, -(-df.count() // rows))
    if n == 1:
        return [df]
    spark, us = df.sparkSession, dates.epoch_micros(ts)
    cuts = sorted(set(df.agg(F.percentile_approx(us, [k / n for k in range(1, n)], 10_000)).first()[0] or []))
    known = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    number = F.when(us.isNull(), 0).otherwise(F.size(F.filter(known, lambda c: c <= us)))
    path = work_path(spark, "slices")
    numbered = df.withColumn("_slice", number)
    # The time lets a slice be dealt to several tasks; a task meets a few neighbouring slices only.
    parts = max(len(cuts) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered.repartitionByRange(parts, "_slice", us).write.partitionBy("_slice").parquet(path)
    return [spark.read.schema(df.schema).parquet(f"{path}/_slice={k}") for k in range(len(cuts) + 1) if _exists(spark, f"{path}/_slice={k}")]


def _exists(spark: SparkSession, path: str) -> bool:
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spot.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spot)


def closing(df: DataFrame, ts: str, reach: str = "1000 days") -> DataFrame:
    """One row whose time lies ``reach`` beyond the last one, all else null: as a last piece it moves the watermark past every window.

    ``reach`` must exceed delay and window size. The row's own window stays open, so it never comes out.
    """
    last = df.agg((F.max(ts) + F.expr(f"INTERVAL {reach}")).alias(ts)).filter(F.col(ts).isNotNull())
    return last.select(*[F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])


def _wall_clock(instant: str) -> Column:
    """Back from an instant to the zone-less time ``read`` took it from."""
    us, day = F.unix_micros(F.col(instant)), 86_400_000_000
    days = F.floor(us / day).cast("int")
    seconds = ((us - days.cast("long") * day) / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)


def run(stream: DataFrame, label: str, may_drop: bool = False) -> DataFrame:
    """Process all available input in append mode into a parquet table of the shared folder and read that table."""
    spark = stream.sparkSession
    out, progress = work_path(spark, label), work_path(spark, f"{label}-progress")
    _advance(stream, out, progress, may_drop)
    return spark.read.schema(stream.schema).parquet(out)


def _advance(stream: DataFrame, out: str, progress: str, may_drop: bool) -> None:
    """One run to the end of the input there is; rows dropped behind the watermark are an error unless they are the feature."""
    job = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(out)
    )
    job.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in job.recentProgress for op in p.stateOperators)
    if dropped and not may_drop:
        raise RuntimeError(f"{dropped} rows came later than the watermark allows")


def replay(
    pieces: Sequence[DataFrame], ts: str, build: Callable[[DataFrame], DataFrame], label: str, may_drop: bool = False,
    close: bool = False,
) -> DataFrame:
    """Stream pieces of a table one after the other, each as one micro-batch of the same query.

    A piece is written to the shared folder whole, in as many files as it needs, and the query goes on from its checkpoint:
    the batches are the pieces, whatever the number and times of files. ``close`` says that the input ends with the last piece: a
    closing batch then brings out the windows and sessions that are still open.
    """
    if close:
        last = [p.agg(F.max(ts).alias(ts)) for p in pieces]
        whole = last[0] if len(last) == 1 else functools.reduce(DataFrame.unionByName, last)
        end = closing(pieces[0].select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pieces[0].schema]).limit(0).unionByName(
            whole, allowMissingColumns=True), ts)
        pieces = [*pieces, end]
    spark, schema = pieces[0].sparkSession, pieces[0].schema
    source, out, progress = (work_path(spark, f"{label}{x}") for x in ("-input", "", "-progress"))
    for k, piece in enumerate(pieces):
        piece.write.parquet(f"{source}/piece-{k:06d}")
        stream = build(read(spark, f"{source}/*/", schema, ts))
        _advance(stream, out, progress, may_drop)
    return spark.read.schema(stream.schema).parquet(out)


def _named(df: DataFrame, spot: str, names: tuple[str, str], rest: Sequence[str]) -> DataFrame:
    start, end = (_wall_clock(f"{spot}.{e}").alias(n) for e, n in zip(("start", "end"), names))
    return df.select(start, end, *rest)


def tumbling(
    stream: DataFrame, ts: str, delay: str, size: str, keys: Sequence[str], aggs: Sequence[tuple[str, Column]],
    slide: str | None = None,
) -> DataFrame:
    """Aggregates per window and key; a window is emitted once the watermark passes its end and later rows are dropped.

    Windows that end after the last watermark stay open and do not come out, unless the replay closes its input.
    """
    span = F.window(ts, size, slide).alias("w") if slide else F.window(ts, size).alias("w")
    grouped = stream.withWatermark(ts, delay).groupBy(span, *keys).agg(*[c.alias(n) for n, c in aggs])
    return _named(grouped, "w", ("window_start", "window_end"), [*keys, *[n for n, _ in aggs]])


def sessions(stream: DataFrame, ts: str, delay: str, gap: str, keys: Sequence[str]) -> DataFrame:
    """Runs of events with no pause longer than ``gap``; a pause of exactly ``gap`` does not close a session."""
    grouped = (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _named(grouped, "w", ("session_start", "session_end"), [*keys, "n"])


def dedupe(stream: DataFrame, ts: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """First arrival per key while the watermark can still see its repeats."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


_STATE = "last_us long, last_id long, n long, late long"
_NONE = -1.0  # a wait that does not exist, inside the state functions only


def node_state(stream: DataFrame, node: str, event: str, ts: str) -> DataFrame:
    """Keyed state of each node: for every event the seconds since the node's previous one and the running count.

    An event older than the node's last one is late: it is marked, counted, and leaves the state as it is. Within a
    micro-batch a node's events are put in time order, so a replay in time order has no late ones.
    """

    def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, last_id, n, late = state.get if state.exists else (None, None, 0, 0)
        rows = pd.concat(list(chunks)).sort_values(["us", event], kind="stable")
        us, ids = rows["us"].to_numpy(), rows[event].to_numpy()
        tardy = us < last if last is not None else np.zeros(len(us), bool)
        on_time = us[~tardy]
        waits = np.full(len(us), _NONE)
        waits[~tardy] = np.diff(on_time, prepend=last if last is not None else on_time[:1]) / 1e6
        if last is None:
            waits[:1] = _NONE
        counts = np.full(len(us), n)
        counts[~tardy] = n + 1 + np.arange(len(on_time))
        if len(on_time):
            last, last_id = int(on_time[-1]), int(ids[~tardy][-1])
        state.update((last, last_id, int(n + len(on_time)), int(late + tardy.sum())))
        out = pd.DataFrame({event: ids, "waited": waits, "n_seen": counts, "late": tardy})
        out.insert(0, node, key[0])
        yield out

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    shape = f"{node} {kinds[node]}, {event} {kinds[event]}, waited double, n_seen long, late boolean"
    timed = stream.select(node, event, F.unix_micros(ts).alias("us"))
    out = timed.groupBy(node).applyInPandasWithState(advance, shape, _STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("waited", F.when(F.col("waited") >= 0, F.col("waited")))


def time_stats(stream: DataFrame, node: str, ts: str) -> DataFrame:
    """Running count, mean and population deviation of each node's waits; one row per node and micro-batch it appears in."""

    def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, mean, m2 = state.get if state.exists else (None, 0, 0.0, 0.0)
        us = np.sort(np.concatenate([c["us"].to_numpy() for c in chunks]))
        if last is not None:
            us = us[us >= last]
        waits = np.diff(us if last is None else np.concatenate([[last], us])) / 1e6
        if len(waits):
            # Merge the batch's moments into the running ones.
            k, centre = len(waits), float(waits.mean())
            gap, total = centre - mean, n + len(waits)
            mean += gap * k / total
            m2 += float(((waits - centre) ** 2).sum()) + gap * gap * n * k / total
            n = total
        if len(us):
            last = int(us[-1])
        state.update((last, n, mean, m2))
        std = math.sqrt(m2 / n) if n else 0.0
        yield pd.DataFrame({node: [key[0]], "n": [n], "mean": [mean], "std": [std], "upto": [last]})

    kind = dict((f.name, f.dataType.simpleString()) for f in stream.schema.fields)[node]
    shape = f"{node} {kind}, n long, mean double, std double, upto long"
    timed = stream.select(node, F.unix_micros(ts).alias("us"))
    return timed.groupBy(node).applyInPandasWithState(
        advance, shape, "last_us long, n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout
    )


def latest(rows: DataFrame, node: str) -> DataFrame:
    """The newest statistics row of each node from all micro-batches; a node without a wait has no mean."""
    best = F.max_by(F.struct("n", "mean", "std"), F.struct("upto", "n")).alias("_s")
    newest = rows.groupBy(node).agg(best).select(node, "_s.*")
    return newest.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("mean", "std")})
