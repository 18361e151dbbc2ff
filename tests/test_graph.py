import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import arrays, hashing
from trendloom.operators import ordering, snapshots, tgraph


@pytest.fixture()
def hot(spark, monkeypatch):
    """A third of all edges touch node 1, many in the same second; blocks are made tiny so that it is cut up."""
    monkeypatch.setattr(tgraph, "BLOCK_ROWS", 5)
    monkeypatch.setattr(tgraph, "BLOCK_SECONDS", 3)
    rnd = random.Random(4)
    times = sorted(rnd.randint(0, 40) for _ in range(120))
    rows = [(k + 1, 1 if k % 3 == 0 else rnd.randint(1, 6), rnd.randint(7, 12), t, float(k)) for k, t in enumerate(times)]
    return rows, spark.createDataFrame(rows, "edge_idx long, u long, i long, ts long, w double")


def past(rows, node, cut):
    out = [(t, e, i if u == node else u) for e, u, i, t, _ in rows if node in (u, i) and t < cut]
    return sorted(out)


def test_latest_neighbours_match_brute_force(spark, hot):
    rows, edges = hot
    asked = [(e, u, t) for e, u, _, t, _ in rows]
    queries = spark.createDataFrame(asked, "qid long, node long, cut long")
    found = tgraph.temporal_neighbors(tgraph.adjacency(edges), queries, 4)
    padded = tgraph.padded_neighbors(found, queries, 4).collect()
    assert len(padded) == len(rows)
    for r in padded:
        want = past(rows, r["node"], r["cut"])[-4:]
        assert r["edges"] == [0] * (4 - len(want)) + [e for _, e, _ in want]
        assert r["neighbors"] == [0] * (4 - len(want)) + [o for _, _, o in want]


def test_uniform_draws_come_from_the_past(spark, hot):
    rows, edges = hot
    queries = spark.createDataFrame([(e, u, t) for e, u, _, t, _ in rows], "qid long, node long, cut long")
    adj = tgraph.adjacency(edges)
    drawn = tgraph.temporal_neighbors(adj, queries, 3, "uniform", 9).collect()
    for r in drawn:
        assert (r["ts"], r["edge_idx"], r["other"]) in past(rows, r["node"], r["cut"])
    assert len(drawn) == 3 * sum(bool(past(rows, u, t)) for _, u, _, t, _ in rows)
    again = tgraph.temporal_neighbors(adj, queries, 3, "uniform", 9).collect()
    assert sorted(map(str, drawn)) == sorted(map(str, again))


def test_time_stats_match_the_walk(spark, hot):
    rows, edges = hot
    got = {r["side"]: r for r in tgraph.time_stats(edges).collect()}
    for side, col in (("u", 1), ("i", 2)):
        last, waits = {}, []
        for row in rows:
            waits.append(row[3] - last.get(row[col], 0))
            last[row[col]] = row[3]
        assert got[side]["mean"] == pytest.approx(np.mean(waits)) and got[side]["std"] == pytest.approx(np.std(waits))


def test_messages_see_the_state_before_their_batch(spark, hot):
    rows, edges = hot
    msgs = tgraph.messages(edges, ["w"], 3, batch_rows=10)
    for r in msgs.collect():
        earlier = [t for e, u, i, t, _ in rows if r["node"] in (u, i) and (e - 1) // 10 < r["batch"]]
        assert r["dt"] == r["ts"] - max(earlier, default=0)
    last = {(r["batch"], r["node"]): r for r in tgraph.aggregate_messages(msgs, tgraph.message_size(["w"], 3), "last").collect()}
    mean = {(r["batch"], r["node"]): r for r in tgraph.aggregate_messages(msgs, tgraph.message_size(["w"], 3), "mean").collect()}
    for key, r in last.items():
        own = sorted((m["edge_idx"], m["msg"]) for m in msgs.collect() if (m["batch"], m["node"]) == key)
        assert r["msg"] == own[-1][1]
        assert np.allclose(mean[key]["msg"], np.mean([m for _, m in own], axis=0))
        break


def test_inductive_split_invariants(spark, hot):
    rows, edges = hot
    parted = tgraph.inductive_split(edges, 20, 30, 0.3).collect()
    assert len(parted) == len(rows)
    train = {n for r in parted if r["part"] == "train" for n in (r["u"], r["i"])}
    held = {r["node"] for r in tgraph.held_out_nodes(edges, 20, 0.3, 2020).collect()}
    assert held and not held & train
    for r in parted:
        if r["part"] in ("valid", "test"):
            assert r["new_node"] == (r["u"] not in train or r["i"] not in train)
        else:
            assert not r["new_node"] and r["ts"] <= 20
            assert (r["part"] == "dropped") == bool({r["u"], r["i"]} & held)


def test_reindex_and_contiguity(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 0, 1)], "edge_idx long, u long, i long")
    out = {tuple(r) for r in tgraph.reindex(df).select("edge_idx", "u", "i").collect()}
    assert out == {(1, 1, 3), (2, 2, 4), (3, 1, 4)}
    assert tgraph.contiguous(df, "u").first()[0]
    assert not tgraph.contiguous(df.filter("u = 0").withColumn("i", F.col("i") * 2), "i").first()[0]


def test_empty_bundle_and_zero_row(spark):
    empty = tgraph.empty_bundle(spark)
    assert empty.count() == 0 and empty.schema == tgraph.EVENT_SCHEMA
    matrix = tgraph.feature_matrix(empty, 2).collect()
    assert [(r["idx"], r["feat"]) for r in matrix] == [(0, [0.0, 0.0])]


def test_negative_edges_can_avoid_true_ones(spark, hot):
    rows, edges = hot
    assert tgraph.negative_edges(edges).count() == len(rows)
    true = {(u, i) for _, u, i, _, _ in rows}
    clean = tgraph.negative_edges(edges, exclude=True).collect()
    assert all((r["u"], r["i"]) not in true for r in clean)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0], 10.0)], "a array<double>, b array<double>, t double")
    r = df.select(arrays.dot("a", "b"), arrays.euclidean("a", "b"), arrays.time_encode("t", 2)).first()
    assert r[0] == 13.0 and r[1] == pytest.approx(math.sqrt(13))
    assert np.allclose(r[2], [math.cos(10.0), math.cos(10.0 * 1e-9)])


def test_snapshot_targets_lie_after_the_snapshot(spark):
    import datetime as dt

    rows = []
    for m in range(1, 11):
        rows.append((m, 1, 7, m % 3, 1.0, float(10**0 * m), float(m), dt.datetime(2020, m, 5, 9), "X"))
    rows.append((20, 1, 8, 1, 2.0, 3.0, 6.0, dt.datetime(2020, 6, 20, 19), "Y"))
    cols = "invoice long, line long, customer long, product long, quantity double, price double, amount double, ts timestamp_ntz, country string"
    lines = spark.createDataFrame(rows, cols)
    first, last = 2020 * 12 + 3, 2020 * 12 + 6
    nodes = snapshots.customer_nodes(lines, ["line"], first, last).collect()
    assert len(nodes) == 2 * 4
    for r in nodes:
        month = r["snapshot"].month
        later = sum(x[6] for x in rows if x[2] == r["customer"] and month < x[7].month <= month + 3)
        assert r["target"] == later
        seen = [x for x in rows if x[2] == r["customer"] and x[7].month <= month]
        assert r["active"] == bool(seen) and r["n_unique_items"] == len({x[3] for x in seen})
        if not seen:
            assert r["frequency"] == 0 and r["lag1_revenue"] == 0
    versions = snapshots.edge_versions(lines, last)
    per_month = [snapshots.edges_at(versions, f"2020-{m:02d}-01").count() for m in range(1, 8)]
    assert per_month == sorted(per_month) and per_month[-1] == 4


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_matches_brute_force(spark, strict):
    rnd = random.Random(8)
    versions = sorted({(1 if rnd.random() < 0.4 else rnd.randint(2, 5), rnd.randint(0, 60)) for _ in range(90)})
    rows = [(k, t, n, None if n % 7 == 0 else f"v{n}") for n, (k, t) in enumerate(versions)]
    asked = [(rnd.randint(1, 6), rnd.randint(-2, 65)) for _ in range(200)]
    left, right = spark.createDataFrame(asked, "k long, t long"), spark.createDataFrame(rows, "k long, t long, n long, s string")
    got = ordering.as_of(left, right, ["k"], "t", ["n", "s"], F.floor(F.col("t") / 4), strict).collect()
    assert len(got) == len(set(asked))
    for r in got:
        known = [v for v in rows if v[0] == r["k"] and (v[1] < r["t"] or (v[1] == r["t"] and not strict))]
        want = known[-1][2:] if known else (None, None)
        assert (r["n"], r["s"]) == want


def _walk(rows, size):
    """State of every node at the start of each batch, and the messages, one edge after the other."""
    state, out = {}, {}
    for at in range(0, len(rows), size):
        batch = rows[at : at + size]
        for e, u, i, t, w in batch:
            for a, b in ((u, i), (i, u)):
                own, other = state.get(a, (0, 0.0, 0)), state.get(b, (0, 0.0, 0))
                out[e, a] = (*own[:2], *other[:2], w, t - own[2])
        for e, u, i, t, w in batch:
            for a in (u, i):
                n, total, _ = state.get(a, (0, 0.0, 0))
                state[a] = (n + 1, total + w, t)
    return out


def test_messages_carry_both_states_of_the_batch_start(spark, hot):
    rows, edges = hot
    want = _walk(rows, 7)
    got = tgraph.messages(edges, ["w"], 2, 7).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        n, total, n_other, total_other, w, dt = want[r["edge_idx"], r["node"]]
        code = [math.cos(dt), math.cos(dt * 1e-9)]
        assert r["msg"] == pytest.approx([n, total, n_other, total_other, w, *code]) and r["dt"] == dt


def test_versions_hold_from_one_batch_to_the_next(spark, hot):
    rows, edges = hot
    versions = tgraph.state_versions(edges, ["w"], 7).collect()
    by = {}
    for r in versions:
        by.setdefault(r["node"], []).append(r)
    for node, found in by.items():
        found.sort(key=lambda r: r["batch"])
        assert [r["valid_to"] for r in found] == [r["batch"] for r in found[1:]] + [None]
        for r in found:
            mine = [x for x in rows if node in (x[1], x[2]) and (x[0] - 1) // 7 <= r["batch"]]
            assert (r["valid_from"], r["n"], r["sum_w"], r["last_update"]) == (r["batch"] + 1, len(mine), sum(x[4] for x in mine), mine[-1][3])


@pytest.mark.parametrize("strict", [True, False])
def test_state_at_any_cut(spark, hot, strict):
    rows, edges = hot
    asked = [(q, node, cut, "keep") for q, (node, cut) in enumerate((n, c) for n in range(0, 13) for c in (-1, 0, 7, 8, 40, 99))]
    got = tgraph.state_at(edges, spark.createDataFrame(asked, "qid long, node long, cut long, note string"), ["w"], strict).collect()
    assert len(got) == len(asked)
    for r in got:
        mine = [x for x in rows if r["node"] in (x[1], x[2]) and (x[3] < r["cut"] or (x[3] == r["cut"] and not strict))]
        assert (r["n"], r["sum_w"]) == (len(mine), sum(x[4] for x in mine))
        assert r["last_update"] == (mine[-1][3] if mine else 0) and r["note"] == "keep"


@pytest.mark.parametrize("n", [1, 4, None])
def test_sums_from_running_sums_equal_summed_neighbourhoods(spark, hot, n):
    rows, edges = hot
    adj = tgraph.adjacency(edges, ["w"])
    asked = spark.createDataFrame([(q, node, cut) for q, (node, cut) in enumerate((a, c) for a in range(1, 14) for c in (0, 9, 33, 50))],
                                  "qid long, node long, cut long")
    found = tgraph.temporal_neighbors(adj, asked, n or 1000)
    want = {r["qid"]: r for r in tgraph.neighborhood_features(found, asked, ["w"], 3).collect()}
    got = tgraph.neighborhood_sums(adj, asked, ["w"], 3, n).collect()
    assert {r["qid"] for r in got} == set(want)
    for r in got:
        assert r["n"] == want[r["qid"]]["n"] and r["vec"] == pytest.approx(want[r["qid"]]["vec"], abs=1e-9)


def _moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("what, moves", [
    ("waits", 2), ("versions", 1), ("messages", 2), ("last", 2), ("mean", 2), ("state", 1), ("loose", 1), ("sums", 1), ("all_sums", 1), ("drawn", 1),
])
def test_rows_of_ordinary_nodes_move_once_and_agree_with_blocks(spark, hot, monkeypatch, what, moves):
    rows, edges = hot
    bare = [(121, 1, 7, None, 3.0), (122, 2, 7, None, 4.0), (123, 2, 12, None, 5.0)]  # without a time
    edges = edges.unionByName(spark.createDataFrame(bare, edges.schema))
    adj = tgraph.adjacency(edges, ["w"])
    asked = spark.createDataFrame([(q, node, cut, "x") for q, (node, cut) in enumerate((a, c) for a in range(0, 14) for c in (0, 9, 9, 33, 50))],
                                  "qid long, node long, cut long, w string")
    size = tgraph.message_size(["w"], 2)
    job = {
        "waits": lambda: tgraph.time_stats(edges),
        "versions": lambda: tgraph.state_versions(edges, ["w"], 7),
        "messages": lambda: tgraph.messages(edges, ["w"], 2, 7),
        "last": lambda: tgraph.aggregate_messages(tgraph.messages(edges, ["w"], 2, 7), size, "last"),
        "mean": lambda: tgraph.aggregate_messages(tgraph.messages(edges, ["w"], 2, 7), size, "mean"),
        "state": lambda: tgraph.state_at(edges, asked, ["w"]),
        "loose": lambda: tgraph.state_at(edges, asked, ["w"], False),
        "sums": lambda: tgraph.neighborhood_sums(adj, asked, ["w"], 3, 4),
        "all_sums": lambda: tgraph.neighborhood_sums(adj, asked, ["w"], 3),
        "drawn": lambda: tgraph.temporal_neighbors(tgraph.adjacency(edges), asked, 3, "uniform", 9),
    }[what]

    def flat(value):
        for v in value if isinstance(value, list) else [value]:
            yield round(v + 1.23457e-7, 6) if isinstance(v, float) else v  # off the halves

    def found():
        df = job()
        names = sorted(df.columns)
        return names, sorted(([x for c in names for x in flat(r[c])] for r in df.collect()), key=repr)

    cut_up = found()
    monkeypatch.setattr(tgraph, "BLOCK_ROWS", 30)
    mixed = found()
    monkeypatch.setattr(tgraph, "BLOCK_ROWS", 1_000_000)
    whole = found()
    assert whole == mixed == cut_up and whole[1]
    assert _moves(job()) == moves  # a plan that has run holds its first form as well


@pytest.mark.parametrize("blocks", [30, 1_000_000])
def test_messages_of_apart_sides_move_one_row_an_edge(spark, hot, monkeypatch, blocks):
    rows, edges = hot
    bare = [(121, 1, None, 41, 3.0), (122, None, 7, 41, 4.0), (123, 2, 7, None, 5.0)]
    edges = edges.unionByName(spark.createDataFrame(bare, edges.schema))
    monkeypatch.setattr(tgraph, "BLOCK_ROWS", blocks)

    def found(df):
        return sorted((r["batch"], r["edge_idx"], r["node"], r["other"], r["ts"], r["dt"], [v and round(v, 9) for v in r["msg"]]) for r in df.collect() if r["ts"] is not None)

    sent = tgraph.messages(edges, ["w"], 2, 7, stay=False)
    if blocks > 30:
        plan = sent._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Window") == 2 and "Generate" not in plan[plan.index("Window"):]
    assert found(sent) == found(tgraph.messages(edges, ["w"], 2, 7)) and sent.count() == 2 * (len(rows) + 1)
    mixed = edges.withColumn("i", F.col("i") - 4)  # some nodes are sources and destinations
    assert found(tgraph.messages(mixed, ["w"], 2, 7, stay=False)) == found(tgraph.messages(mixed, ["w"], 2, 7))


@pytest.mark.parametrize("blocks", [30, 1_000_000])
@pytest.mark.parametrize("strict", [True, False])
def test_events_ask_for_their_own_ends(spark, hot, monkeypatch, strict, blocks):
    rows, edges = hot
    bare = [(121, 1, 7, None, 3.0), (122, None, 7, 5, 4.0), (123, 2, 12, 4, 2.0), (124, 5, 5, 17, 1.0)]
    edges = edges.unionByName(spark.createDataFrame(bare, edges.schema))
    drawn = edges.select("edge_idx", "u", (13 - F.col("i") % 4).alias("i"), "ts")
    every = tgraph.state_at(edges, tgraph.both_ends(edges, drawn), ["w"], strict)
    monkeypatch.setattr(tgraph, "BLOCK_ROWS", blocks)
    got = tgraph.state_at(edges, tgraph.both_ends(edges, drawn, own=False), ["w"], strict, ends=True)
    names = ["qid", "side", "node", "cut", "n", "sum_w", "last_update"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, every.select(names).collect()))
    assert blocks == 30 or _moves(tgraph.state_at(edges, tgraph.both_ends(edges, drawn, own=False), ["w"], strict, ends=True)) == 1


def test_events_of_nodes_that_nobody_asks_for_stay(spark, hot, monkeypatch):
    rows, edges = hot
    adj = tgraph.adjacency(edges, ["w"])
    asked = spark.createDataFrame([(1, 8, 30), (2, 9, 31), (3, None, 31)], "qid long, node long, cut long")
    monkeypatch.setattr(tgraph, "BLOCK_ROWS", 30)
    busy, some = tgraph._busy_and_asked(adj, asked)
    assert 1 in busy and {r["node"] for r in some.select("node").distinct().collect()} == {8, 9}
    assert tgraph.neighborhood_sums(adj, asked.limit(0), ["w"], 3, 4).collect() == []


def test_derived_columns_order_lines_without_moving(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "k long, who string").withColumn("ts", F.lit("2000-01-01").cast("timestamp_ntz"))
    items = spark.createDataFrame([(1, "x", 6.0, 1.0), (1, "y", 8.0, 4.0), (2, "z", 9.0, 1.0)], "k long, what string, amount double, pieces double")
    piece = {"piece": F.col("amount") / F.col("pieces")}
    got = tgraph.interactions(heads, items.withColumns(piece), "who", "what", ["ts", "k", "piece"], ["what"], derived=piece)
    assert [(r["edge_idx"], r["what"]) for r in got.orderBy("edge_idx").collect()] == [(0, "y"), (1, "x"), (2, "z")]


def test_scored_edges_move_with_numbers_of_vectors(spark):
    edges = spark.createDataFrame([(k, k % 3, 3 + k % 4, k) for k in range(12)], "edge_idx long, u long, i long, ts long")
    negatives = edges.withColumn("i", F.lit(4).cast("long"))
    held = spark.createDataFrame([(v, [v + 0.5, 1.0]) for v in range(4)] + [(2, [9.0, 9.0])], "vec_id long, vec array<double>")
    named = tgraph.nodes(edges).withColumn("vec_id", F.col("node") % 5)  # vec_id 4 is held by no row, 2 by two rows
    dealt = named.join(held, "vec_id").select("node", "vec")
    want = sorted(map(tuple, tgraph.link_scores(edges, negatives, dealt).collect()))
    found = tgraph.link_scores(edges, negatives, named, held)
    assert sorted(map(tuple, found.collect())) == want and want


def test_stored_edges_follow_their_input(spark, tmp_path):
    from trendloom.plans import interaction_graph

    for table in ("orders", "lineitem", "customer", "nation", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").toPandas().to_parquet(
            tmp_path / f"{table}.parquet", coerce_timestamps="us", index=False)
    first = interaction_graph.edges(spark, str(tmp_path)).count()
    assert interaction_graph.edges(spark, str(tmp_path)).count() == first
    fewer = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500)
    fewer.toPandas().to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us", index=False)
    assert interaction_graph.edges(spark, str(tmp_path)).count() == 500 < first


def test_edges_number_whole_heads_and_take_part_rows_as_a_join_does(spark):
    """Heads or parts held twice double their lines, an unknown part drops its lines; ids follow the first line."""
    heads = spark.createDataFrame([(1, 20, "b"), (2, 10, "a"), (2, 10, "c"), (3, 10, None), (4, 30, "z")], "k long, s long, who string")
    heads = heads.withColumn("ts", F.expr("timestamp_ntz '2000-01-01' + make_dt_interval(0, 0, 0, s)")).drop("s")
    rows = [(1, 1, "x"), (1, 2, "y"), (2, 1, "y"), (2, 2, "gone"), (3, 1, "w"), (1, 3, None)]
    items = spark.createDataFrame(rows, "k long, line long, what string")
    named = spark.createDataFrame([("x", "X"), ("y", "Y"), ("y", "Y"), ("w", "W"), ("unused", "U")], "what string, name string")
    found = tgraph.interaction_tables(heads, items, "who", "what", ["ts", "k", "line"], ["who", "what", "name"], named)
    got = sorted(tuple(r) for r in found.edges.collect())
    # Key 2 comes first, for a and c; a head without a source is counted before it is left out.
    assert [r[0] for r in got] == [0, 1, 2, 3, 5, 6, 7]
    assert [r[4] for r in got] == ["a", "a", "c", "c", "b", "b", "b"]
    assert [r[5] for r in got] == ["y"] * 4 + ["x", "y", "y"]
    assert [r[3] for r in got] == [0, 0, 0, 0, 10, 10, 10]
    assert {r[5]: r[2] for r in got} == {"y": 0, "x": 2} and {r[6] for r in got} == {"X", "Y"}
    assert [r["who"] for r in found.users.orderBy("u").collect()][:1] == ["a"]


def test_shuffles_grow_with_the_input(spark, monkeypatch):
    from trendloom import session

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(session, "ROWS", 10)
        session.widen(spark, 10 * int(before) + 1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == int(before) + 1
        session.widen(spark, 1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == int(before) + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_snapshot_partitions_grow_with_the_grid(spark, monkeypatch):
    from trendloom import session

    monkeypatch.setattr(session, "ROWS", 100)
    rows = [(k, c, k, f"1995-0{1 + k % 6}-05 10:00:00", k % 7, 1, 1.0, 2.0, 2.0) for k, c in enumerate(list(range(40)) * 2)]
    lines = spark.createDataFrame(rows, "invoice long, customer long, line long, ts string, product long, supplier long, quantity double, price double, amount double")
    lines = lines.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = snapshots.product_nodes(lines, 1995 * 12, 1995 * 12 + 199)
    assert out.count() == 7 * 200 and out.rdd.getNumPartitions() == 14


def test_latest_neighbours_move_two_rows_a_query(spark, hot):
    _, edges = hot
    asked = spark.createDataFrame([(1, 1, 50), (2, 8, 30)], "qid long, node long, cut long")
    found = tgraph.temporal_neighbors(tgraph.adjacency(edges), asked, 30)
    assert "_run" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.groupBy("qid").count().filter("count > 30").isEmpty() and found.count() > 30


@pytest.mark.parametrize("blocks", [5, 1_000_000])
def test_latest_neighbours_of_a_query_come_in_one_row_and_move_once(spark, hot, monkeypatch, blocks):
    rows, edges = hot
    monkeypatch.setattr(tgraph, "BLOCK_ROWS", blocks)
    bare = [(121, 1, 7, None, 3.0), (122, 2, 7, None, 4.0)]  # without a time: they take a place, but are no neighbours
    adj = tgraph.adjacency(edges.unionByName(spark.createDataFrame(bare, edges.schema)))
    pairs = [(a, c) for a in [None, *range(0, 14)] for c in (None, 0, 1, 9, 9, 33, 50)]
    asked = spark.createDataFrame([(q, node, cut) for q, (node, cut) in enumerate(pairs)], "qid long, node long, cut long")
    found = tgraph.temporal_neighbors(adj, asked, 4, together=True)
    assert blocks == 5 or _moves(found) == 1
    got = {r["qid"]: r for r in tgraph.padded_neighbors(found, asked, 4).collect()}
    loose = tgraph.temporal_neighbors(adj, asked, 4)
    want = {r["qid"]: r for r in tgraph.padded_neighbors(loose, asked, 4).collect()}
    assert got == want and len(got) == len(pairs)
    gaps = {1: 1, 2: 1, 7: 2}
    for q, (node, cut) in enumerate(pairs):
        before = [] if node is None or cut is None else past(rows, node, cut)
        if node in gaps and cut is not None:
            before = [(0, 0, 0)] * gaps[node] + before
        last = [e for _, e, _ in before[-4:] if e]
        assert got[q]["edges"] == [0] * (4 - len(last)) + last
    places = {(r["qid"], r["edge_idx"]): r["place"] for r in loose.collect()}
    packed = {(r["qid"], e["edge_idx"]): e["place"] for r in found.collect() for e in r["events"]}
    assert places == packed


@pytest.mark.parametrize("ids", [[7, 8, 9, 10], [7, 9, 10, 40]])
def test_drawn_destinations_need_no_move_where_ids_have_no_gap(spark, ids):
    rows = [(k + 1, k % 3, ids[k % 4], k) for k in range(40)]
    edges = spark.createDataFrame(rows, "edge_idx long, u long, i long, ts long")
    drawn = tgraph.negative_edges(edges)
    place = F.pmod(hashing.draw("edge_idx", 0), F.lit(4))
    want = {r["edge_idx"]: ids[r["p"]] for r in edges.select("edge_idx", place.alias("p")).collect()}
    assert {r["edge_idx"]: r["i"] for r in drawn.collect()} == want
    joins = "Join" in drawn._jdf.queryExecution().executedPlan().toString()
    assert joins == (ids[-1] == 40)


def test_snapshots_lay_out_months_after_the_move_and_aggregate_orders_once(spark):
    rows = [(k, k % 9, k, f"1995-0{1 + k % 6}-05 10:00:00", k % 7, 1, 1.0, 2.0, 2.0, "x") for k in range(40)]
    lines = spark.createDataFrame(rows, "invoice long, customer long, line long, ts string, product long, supplier long, quantity double, price double, amount double, country string")
    lines = lines.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    customers = snapshots.customer_nodes(lines, ["line", "product", "supplier", "quantity", "price"], 1995 * 12, 1995 * 12 + 5)
    products = snapshots.product_nodes(lines, 1995 * 12, 1995 * 12 + 5)
    assert customers.count() == 9 * 6 and products.count() == 7 * 6
    assert "min_by" not in plan(customers)
    for made in (customers, products):
        text = plan(made)
        assert text.index("Generate explode") < text.index("RepartitionByExpression")


def test_no_vector_moves_with_an_edge_where_their_counted_size_allows(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k % 3, 3 + k % 4, k) for k in range(12)], "edge_idx long, u long, i long, ts long")
    held = spark.createDataFrame([(v, [v + 0.5, 1.0]) for v in range(5)], "vec_id long, vec array<double>")
    named = tgraph.nodes(edges).withColumn("vec_id", F.col("node") % 5)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = tgraph.link_scores(edges, edges, named, held)
    assert plan(found).count("rightHint=(strategy=broadcast)") == 2
    monkeypatch.setattr(tgraph, "VECTOR_BYTES", 5 * (64 + 16) - 1)
    apart = tgraph.link_scores(edges, edges, named, held)
    assert "broadcast" not in plan(apart)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, found.collect()))
