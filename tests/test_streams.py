import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom.streaming import jobs

SCHEMA = "user_id long, event_id long, ts timestamp_ntz"


def pieces(spark, *rows):
    return [spark.createDataFrame(r, SCHEMA) for r in rows]


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_state_survives_batches_and_marks_late_rows(spark):
    parts = pieces(spark, [(1, 1, at(1)), (1, 2, at(2)), (2, 3, at(2))], [(1, 4, at(1, 5)), (1, 5, at(3))])
    out = jobs.replay(parts, "ts", lambda s: jobs.node_state(s, "user_id", "event_id", "ts"), "t-state")
    got = {r["event_id"]: (r["waited"], r["n_seen"], r["late"]) for r in out.collect()}
    day = 86400.0
    assert got == {1: (None, 1, False), 2: (day, 2, False), 3: (None, 1, False), 4: (None, 2, True), 5: (day, 3, False)}


def test_running_statistics_merge_batches(spark):
    parts = pieces(spark, [(1, 1, at(1)), (1, 2, at(2)), (1, 3, at(4))], [(1, 4, at(8))])
    rows = jobs.replay(parts, "ts", lambda s: jobs.time_stats(s, "user_id", "ts"), "t-stats")
    r = jobs.latest(rows, "user_id").first()
    day = 86400.0
    mean = 7 * day / 3
    std = (sum((d * day - mean) ** 2 for d in (1, 2, 4)) / 3) ** 0.5
    assert r["n"] == 3 and abs(r["mean"] - mean) < 1e-6 and abs(r["std"] - std) < 1e-6


def test_pause_of_exactly_the_gap_stays_in_the_session(spark):
    parts = pieces(spark, [(1, 1, at(1)), (1, 2, at(3)), (1, 3, at(5, 1)), (2, 4, at(30))])
    out = jobs.replay(parts, "ts", lambda s: jobs.sessions(s, "ts", "1 hour", "2 days", ["user_id"]), "t-sessions")
    got = sorted((r["session_start"], r["n"]) for r in out.filter(F.col("user_id") == 1).collect())
    assert got == [(at(1), 2), (at(5, 1), 1)]


def test_results_do_not_depend_on_files_or_slices(spark, tmp_path):
    rows = [(k * 7919 % 40, k, at(1 + k * 7919 % 28, k * 31 % 24) + dt.timedelta(seconds=k % 3600)) for k in range(1500)]
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    spark.createDataFrame(rows, SCHEMA).repartition(6, "event_id").write.parquet(str(tmp_path / "six"))
    six = spark.read.parquet(str(tmp_path / "six"))
    builds = [
        lambda s: jobs.tumbling(s, "ts", "1 hour", "1 day", ["user_id"], [("n", F.count(F.lit(1)))]),
        lambda s: jobs.sessions(s, "ts", "1 hour", "12 hours", ["user_id"]),
        lambda s: jobs.node_state(s, "user_id", "event_id", "ts"),
    ]
    for k, build in enumerate(builds):
        got = [
            sorted(map(str, jobs.replay(jobs.slices(df, "ts", n=n), "ts", build, f"t-{k}").collect()))
            for df, n in ((one, 1), (six, 5))
        ]
        assert got[0] == got[1] and got[0]
        assert k < 2 or not any("late=True" in r for r in got[0])
    assert sum(p.count() for p in jobs.slices(six, "ts", n=7)) == len(rows)


def test_dropped_rows_are_an_error_unless_they_are_the_feature(spark):
    parts = pieces(spark, [(1, 1, at(20))], [(1, 2, at(23))], [(1, 3, at(1))])
    build = lambda s: jobs.tumbling(s, "ts", "1 hour", "1 day", ["user_id"], [("n", F.count(F.lit(1)))])
    with pytest.raises(RuntimeError):
        jobs.replay(parts, "ts", build, "t-drop")
    assert jobs.replay(parts, "ts", build, "t-dropped", may_drop=True).count() >= 1


def test_a_finished_input_leaves_no_window_open(spark):
    rows = [(k % 3, k, at(1 + k % 28, k % 24)) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    build = lambda s: jobs.tumbling(s, "ts", "1 hour", "1 day", ["user_id"], [("n", F.count(F.lit(1)))])
    left_open = jobs.replay([df], "ts", build, "t-open").agg(F.sum("n")).first()[0]
    closed = jobs.replay(jobs.slices(df, "ts", n=3), "ts", build, "t-closed", close=True)
    assert left_open < closed.agg(F.sum("n")).first()[0] == 300
    assert closed.filter("user_id IS NULL").count() == 0
    sessions = jobs.replay([df], "ts", lambda s: jobs.sessions(s, "ts", "1 hour", "12 hours", ["user_id"]), "t-all", close=True)
    assert sessions.agg(F.sum("n")).first()[0] == 300


def test_an_empty_input_can_be_closed(spark):
    build = lambda s: jobs.tumbling(s, "ts", "1 hour", "1 day", ["user_id"], [("n", F.count(F.lit(1)))])
    assert jobs.replay([spark.createDataFrame([], SCHEMA)], "ts", build, "t-none", close=True).count() == 0


def test_slices_are_written_once_and_read_by_folder(spark):
    rows = [(1, k, at(1 + k % 28)) for k in range(200)] + [(1, 900, None)]
    parts = jobs.slices(spark.createDataFrame(rows, SCHEMA), "ts", n=5)
    assert len(parts) > 3 and sum(p.count() for p in parts) == 201
    spans = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert parts[0].filter("ts IS NULL").count() == 1 and parts[0].columns == ["user_id", "event_id", "ts"]
    files = {f.rsplit("/", 2)[1] for p in parts for f in p.inputFiles()}
    assert len(files) == len(parts)  # a slice reads its own folder alone
