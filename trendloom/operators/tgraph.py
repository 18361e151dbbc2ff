"""Timestamped interaction graph: ids, splits, neighbourhoods, messages and negative edges.

Edges carry a global number ``edge_idx`` (1..E) in time order. Wherever a node's events must be ordered, they are first
collapsed to (node, second, block of edge numbers) counts and running totals are taken over those, so a node with a third
of all events is handled in many bounded pieces. Nodes of up to ``BLOCK_ROWS`` rows need no pieces: their rows move once, to
their node, and every window over them finds them there (``_by_node``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions import arrays, dates, hashing
from trendloom.operators import features, ordering, sampling
from trendloom.session import parts_for
from trendloom.sources.work import store

BLOCK_ROWS = 1_000_000
BLOCK_SECONDS = 86_400
VECTOR_BYTES = 256 << 20  # of a table of vectors that is sent to every executor
MOST_BACK = 64  # events that a query looks back one by one; more come in runs

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("edge_idx", T.LongType()),
        T.StructField("u", T.LongType()),
        T.StructField("i", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("feat", T.ArrayType(T.DoubleType())),
    ]
)


def read_interactions(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """CSV lines ``u,i,ts,label,f1..fk`` under a header line, as typed columns with a feature array and row index."""
    names = ["u", "i"]
    fields = [T.StructField(n, T.LongType()) for n in names]
    fields += [T.StructField("ts", T.DoubleType()), T.StructField("label", T.DoubleType())]
    fields += [T.StructField(f"f{j + 1}", T.DoubleType()) for j in range(n_features)]
    raw = spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
    typed = raw.select("u", "i", "ts", "label", F.array(*[f"f{j + 1}" for j in range(n_features)]).alias("feat"))
    return ordering.global_index(typed, ["ts", "u", "i", "feat"], "edge_idx")


def contiguous(df: DataFrame, col: str) -> DataFrame:
    """One row: do the ids of a column form an unbroken range?"""
    span = F.max(col) - F.min(col) + 1
    return df.agg((span == F.count_distinct(col)).alias("contiguous"))


def reindex(df: DataFrame, bipartite: bool = True, last_user: int | None = None) -> DataFrame:
    """1-based ids from 0-based ones; in a bipartite graph items follow the users in one id range.

    ``last_user`` is the largest ``u`` where it is known.
    """
    last = F.lit(last_user) if last_user is not None else df.agg(F.max("u")).scalar()
    shift = (last + 1) if bipartite else F.lit(0).cast("long")
    return df.withColumns({"u": F.col("u") + 1, "i": F.col("i") + shift + 1, "edge_idx": F.col("edge_idx") + 1})


class Interactions(NamedTuple):
    """Edges, (source, u), (destination, i, ...) and the second since 1970 that the edges' time counts from."""

    edges: DataFrame
    users: DataFrame
    destinations: DataFrame
    start: int


def _copied(items: DataFrame, named: DataFrame, col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Items as often as ``named`` holds their ``col``, both sides with the columns that then join them.

    Only values that it holds never or several times are looked up, so where every value is held once no item is moved.
    """
    items = items.filter(F.col(col).isNotNull())
    held = named.groupBy(col).agg(F.count(F.lit(1)).alias("_k"))
    times = F.coalesce("_k", F.lit(0).cast("long")).alias("_k")
    odd = store(items.select(col).distinct().join(held, col, "left").select(col, times).filter("_k <> 1"), "odd-keys")
    if odd.isEmpty():
        return items, named, [col]
    some = items.join(odd, col, "left").withColumn("_k", F.coalesce("_k", F.lit(1).cast("long"))).filter("_k > 0")
    copies = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_k"))).drop("_k")
    rest = [c for c in named.columns if c != col]
    place = F.row_number().over(Window.partitionBy(col).orderBy(*rest)).cast("long")
    return copies, named.withColumn("_copy", place), [col, "_copy"]


def interaction_tables(
    heads: DataFrame, items: DataFrame, source: str, destination: str, order: Sequence[str], keep: Sequence[str] = (),
    named: DataFrame | None = None, derived: Mapping[str, Column] | None = None,
) -> Interactions:
    """Lines as edges, the sources and destinations with their ids, and the first second.

    Edges have 0-based first-seen ids ``u`` and ``i``, a 0-based ``edge_idx`` in the given total order and the seconds since the first.
    A line is a row of ``items`` with its row of ``heads``. ``order`` begins with the time and the key, which come from the head
    and the key that joins both; the rest orders the lines inside a head, of which there are few. So only heads are sorted
    as a whole, with the number of lines before each. A line is moved twice, to its head and to its destination's id,
    and is as often there as ``named`` holds its destination. Lines without a source count for edge numbers and first places,
    but are no edges. ``derived`` columns follow from the others of a line: they are made where the line has moved to.
    """
    ts, key, *inner = order
    derived = derived or {}
    items = items.drop(*derived)
    both = [destination]
    if named is not None:
        items, named, both = _copied(items, named, destination)
    parts = parts_for(items.sparkSession, items.count())
    sizes = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = [c for c in dict.fromkeys([key, ts, source, *keep]) if c in heads.columns]
    sized = heads.select(*known).join(sizes.hint("shuffle_hash"), key)
    totals = ordering.running_totals(sized, [ts, key, source], {"_upto": "_n"}, parts, lambda df: store(df, "heads", "zstd"))
    placed = store(totals.withColumn("_at", F.col("_upto") - F.col("_n")).drop("_upto", "_n"), "heads-placed", "zstd")
    start = placed.agg(F.min(dates.epoch_seconds(ts))).first()[0]
    # Heads of one key and time stand side by side in the order of their sources, so the place breaks ties as the source does.
    users = placed.groupBy(source).agg(F.min("_at").alias("_first"))
    users = ordering.global_index(users, ["_first", source], "u").drop("_first")
    mine = users.select(F.col(source).alias("_source"), "u")
    owned = placed.join(mine.hint("shuffle_hash"), F.col(source) == F.col("_source"), "left").drop("_source")
    lines = items.repartition(parts, key).join(owned.repartition(parts, key).hint("shuffle_hash"), key).withColumns(dict(derived))
    cell = Window.partitionBy(key, ts).orderBy(*inner, source)
    base = F.min("_at").over(cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seconds = (dates.epoch_seconds(ts) - F.lit(start)).alias("seconds")
    numbered = lines.withColumn("edge_idx", base + F.row_number().over(cell) - 1)
    held = dict.fromkeys([*both, *[c for c in keep if c in lines.columns]])
    numbered = store(numbered.select("edge_idx", "u", seconds, *held), "numbered", "zstd")
    its = numbered.groupBy(destination).agg(F.min("edge_idx").alias("_first"))
    its = ordering.global_index(its, ["_first", destination], "i").drop("_first")
    its = its if named is None else its.join(named, destination)
    asked = its.select(*both, "i", *[c for c in keep if c in its.columns and c not in numbered.columns])
    edges = numbered.filter("u IS NOT NULL").join(asked, both).select("edge_idx", "u", "i", "seconds", *keep)
    return Interactions(edges, users, its.drop("_copy"), start)


def interactions(
    heads: DataFrame, items: DataFrame, source: str, destination: str, order: Sequence[str], keep: Sequence[str] = (),
    named: DataFrame | None = None, derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The edges of ``interaction_tables``."""
    return interaction_tables(heads, items, source, destination, order, keep, named, derived).edges


def event_features(edges: DataFrame, ts: str, amount: str, quantity: str) -> DataFrame:
    """Label 1 and the feature columns: standardised amount and quantity, weekday cycle, month flags 2..12."""
    scaled = features.apply_scaler(
        edges, features.fit_scaler(edges, [amount, quantity]), [amount, quantity]
    )
    sine, cosine = dates.cycle(F.weekday(ts), 7)
    timed = scaled.withColumns({"label": F.lit(1.0), "day_sin": sine, "day_cos": cosine, "month": F.month(ts)})
    return features.one_hot(timed, "month", range(1, 13), drop_first=True).drop("month")


def feature_columns(amount: str, quantity: str) -> list[str]:
    return [amount, quantity, "day_sin", "day_cos", *[f"month_{m}" for m in range(2, 13)]]


def event_bundle(events: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Canonical scoring table with a feature array; without input rows it is empty with the same schema."""
    feat = F.array(*[F.col(c).cast("double") for c in cols])
    return events.select("edge_idx", "u", "i", F.col("seconds").alias("ts"), "label", feat.alias("feat"))


def empty_bundle(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def feature_matrix(bundle: DataFrame, dim: int) -> DataFrame:
    """(idx, feat) rows with an all-zero row 0, for 1-based edge numbers."""
    zero = bundle.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"), arrays.zeros(dim).alias("feat"))
    return bundle.select(F.col("edge_idx").alias("idx"), "feat").unionByName(zero)


def adjacency(edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Both directions of every edge as (node, other, edge_idx, ts)."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.col("i").alias("other")),
        F.struct(F.col("i").alias("node"), F.col("u").alias("other")),
    )
    return edges.select(F.explode(ends).alias("e"), "edge_idx", "ts", *keep).select("e.*", "edge_idx", "ts", *keep)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "i")).alias("node")).distinct()


def busy_nodes(*frames: DataFrame) -> list[int]:
    """Nodes with more than ``BLOCK_ROWS`` rows in all frames together; at most one per so many rows."""
    rows = reduce(DataFrame.unionByName, [f.select("node") for f in frames])
    counted = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS)
    return [row["node"] for row in counted.filter("node IS NOT NULL").collect()]


def _busy_and_asked(adj: DataFrame, queries: DataFrame) -> tuple[list[int], DataFrame]:
    """``busy_nodes``, and the events of nodes between the first and the last that is asked for; the others need not move."""
    rows = adj.select("node", F.lit(False).alias("_q")).unionByName(queries.select("node", F.lit(True).alias("_q")))
    per = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.max("_q").alias("_q"))
    hit = F.when(F.col("_q"), F.col("node"))
    busy = F.collect_list(F.when(F.col("_n") > BLOCK_ROWS, F.col("node")))  # at most one per so many rows
    first, last, found = per.agg(F.min(hit), F.max(hit), busy).first()
    return found, adj.filter(F.col("node").between(F.lit(first), F.lit(last)))


def _by_node(
    frames: Sequence[DataFrame], busy: Sequence[int], whole: Callable[..., DataFrame], blocked: Callable[..., DataFrame]
) -> DataFrame:
    """``whole`` over the rows of nodes that one window can hold, ``blocked`` over those of the busy ones."""
    if not busy:
        return whole(*frames)
    hot = F.coalesce(F.col("node").isin(list(busy)), F.lit(False))
    return whole(*[f.filter(~hot) for f in frames]).unionByName(blocked(*[f.filter(hot) for f in frames]))


def time_stats(edges: DataFrame) -> DataFrame:
    """Mean and population deviation of the time since the node's previous event (0 before the first), per side.

    Events of one node in one second collapse to a count: one of them waits, the others follow at once.
    """

    def ticked(events: DataFrame) -> DataFrame:
        return events.groupBy("node", "ts").agg(F.count(F.lit(1)).alias("n"))

    def whole(events: DataFrame) -> DataFrame:
        prev = F.lag("ts").over(Window.partitionBy("node").orderBy("ts"))
        return ticked(events.filter("ts IS NOT NULL").repartition("node")).withColumn("prev", prev)

    def blocked(events: DataFrame) -> DataFrame:
        block = F.floor(F.col("ts") / BLOCK_SECONDS)
        return ordering.previous_in_key(ticked(events), ["node"], "ts", block, "prev")

    def side(node: str) -> DataFrame:
        events = edges.select(F.col(node).alias("node"), "ts")
        waits = _by_node([events], busy_nodes(events), whole, blocked)
        wait = (F.col("ts") - F.coalesce("prev", F.lit(0))).cast("double")
        total = F.sum("n")
        mean = F.sum(wait) / total
        return waits.agg(
            F.lit(node).alias("side"),
            mean.alias("mean"),
            F.sqrt(F.sum(wait * wait) / total - mean * mean).alias("std"),
        )

    return side("u").unionByName(side("i"))


def _block(edge_idx: str = "edge_idx") -> Column:
    return F.floor(F.col(edge_idx) / BLOCK_ROWS).cast("long")


def _ranked(
    adj: DataFrame, marks: DataFrame | None = None, sums: Mapping[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Adjacency rows with their 1-based place among the node's events, and the event count before each mark.

    Counts per (node, second, block) and marks (block -1, so before the events of their own second) share one running
    total. ``sums`` adds running sums of columns up to and with each event.
    """
    sums = sums or {}
    placed = adj.withColumn("_eb", _block()).withColumns({f"_x_{k}": v for k, v in sums.items()})
    cells = placed.groupBy("node", "ts", "_eb").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x_{k}").alias(f"_s_{k}") for k in sums]
    )
    if marks is not None:
        flat = marks.select("node", F.col("cut").alias("ts")).distinct()
        nothing = {"_eb": F.lit(-1).cast("long"), "_n": F.lit(0).cast("long"), **{f"_s_{k}": F.lit(0.0) for k in sums}}
        cells = cells.unionByName(flat.withColumns(nothing))
    block = F.floor(F.col("ts") / BLOCK_SECONDS)
    totals = ordering.keyed_running_totals(
        cells, ["node"], ["ts", "_eb"], block, {"_upto": "_n", **{f"_t_{k}": f"_s_{k}" for k in sums}}
    )
    spot = ["node", "ts", "_eb"]
    starts = totals.filter("_eb >= 0").select(
        *spot, (F.col("_upto") - F.col("_n")).alias("_start"), *[(F.col(f"_t_{k}") - F.col(f"_s_{k}")).alias(f"_b_{k}") for k in sums]
    )
    inside = Window.partitionBy(*spot).orderBy("edge_idx", "other")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        placed.withColumns({"_in": F.row_number().over(inside), **{f"_r_{k}": F.sum(f"_x_{k}").over(run) for k in sums}})
        .join(starts, spot)
        .withColumns({"place": F.col("_start") + F.col("_in"), **{k: F.col(f"_b_{k}") + F.col(f"_r_{k}") for k in sums}})
        .drop("_in", "_start", "_eb", *[f"_{x}_{k}" for k in sums for x in "xbr"])
    )
    before = totals.filter("_eb = -1").select("node", F.col("ts").alias("cut"), F.col("_upto").alias("before"))
    return ranked, before


def neighborhood_sums(adj: DataFrame, queries: DataFrame, cols: Sequence[str], dim: int, n: int | None = None) -> DataFrame:
    """What ``neighborhood_features`` sums over the last ``n`` events (null: all) before a cut, from running sums per node.

    The events of a node carry the running sums of their features and of the cosine and sine of each time code, so a sum over any
    run of events is the difference of two rows, and the codes of the time to the cut follow from those of the times. Work per
    query does not depend on ``n``.
    """
    rates = arrays.code_rates(dim)
    angle = lambda x, w: x.cast("double") * F.lit(w)
    sums = {f"f{j}": F.col(c).cast("double") for j, c in enumerate(cols)}
    sums |= {f"c{j}": F.cos(angle(F.col("ts"), w)) for j, w in enumerate(rates)}
    sums |= {f"s{j}": F.sin(angle(F.col("ts"), w)) for j, w in enumerate(rates)}
    busy, adj = _busy_and_asked(adj, queries)
    found = _by_node(
        [adj, queries], busy, lambda a, q: _last_sums(a, q, sums, n), lambda a, q: _last_sums_blocked(a, q, sums, n)
    )
    cut = lambda fn, w: fn(angle(F.col("cut"), w))
    codes = [cut(F.cos, w) * F.col(f"_t_c{j}") + cut(F.sin, w) * F.col(f"_t_s{j}") for j, w in enumerate(rates)]
    vec = F.array(*[F.coalesce(c, F.lit(0.0)) for c in [*[F.col(f"_t_f{j}") for j in range(len(cols))], *codes]])
    return found.select(*queries.columns, F.col("_n").alias("n"), vec.alias("vec"))


def _timeline(adj: DataFrame, queries: DataFrame, every: bool = False) -> tuple[DataFrame, WindowSpec, list[Column]]:
    """Events and queries (``_asks``) of a node side by side, moved once; their order, a query before the events of its second; the queries' columns.

    Queries without a node or a time are left out but for ``every``.
    """
    rest = [c for c in queries.columns if c not in ("node", "cut")]
    asks = (queries if every else queries.filter("node IS NOT NULL AND cut IS NOT NULL")).select(
        "node", F.col("cut").alias("ts"), F.lit(True).alias("_asks"), *[F.col(c).alias(f"_q_{c}") for c in rest]
    )
    rows = adj.withColumn("_asks", F.lit(False)).unionByName(asks, allowMissingColumns=True).repartition("node")
    order = Window.partitionBy("node").orderBy("ts", F.col("_asks").desc(), "edge_idx", "other")
    cut = F.col("ts").cast(queries.schema["cut"].dataType).alias("cut")
    own = {"node": F.col("node"), "cut": cut}
    return rows, order, [own[c] if c in own else F.col(f"_q_{c}").alias(c) for c in queries.columns]


def _last_sums(adj: DataFrame, queries: DataFrame, sums: Mapping[str, Column], n: int | None) -> DataFrame:
    """``queries`` with the number ``_n`` of a node's last ``n`` events before the cut and their sums ``_t_*``."""
    rows, order, asked = _timeline(adj, queries)
    events = Window.partitionBy("node", "_asks").orderBy("ts", "edge_idx", "other")
    run = events.rowsBetween(Window.unboundedPreceding, 0)
    # An event without a time counts and adds to the sums after it, but no sum ends or starts with it.
    timed = F.col("ts").isNotNull()
    totals = {"_n": F.count(F.lit(1)).over(run), **{f"_t_{k}": F.when(timed, F.sum(v).over(run)) for k, v in sums.items()}}
    rows = rows.withColumns(totals)
    if n is not None:
        rows = rows.withColumns({f"_o_{c}": F.lag(c, n).over(events) for c in totals})
        rows = rows.withColumns({c: F.col(c) - F.coalesce(f"_o_{c}", F.lit(0)) for c in totals})
    last = F.last(F.when(~F.col("_asks"), F.struct(*totals)), ignorenulls=True)
    found = rows.withColumn("_v", last.over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_asks")
    count = F.coalesce(F.col("_v._n"), F.lit(0).cast("long")).alias("_n")
    return found.select(*asked, count, *[F.col("_v")[f"_t_{k}"].alias(f"_t_{k}") for k in sums])


def _last_sums_blocked(adj: DataFrame, queries: DataFrame, sums: Mapping[str, Column], n: int | None) -> DataFrame:
    """``_last_sums`` for nodes of any size."""
    ranked, before = _ranked(adj, queries, sums)
    index = ranked.select("node", "place", F.struct(*sums).alias("run"))
    asked = queries.join(before, ["node", "cut"])
    low = F.lit(0).cast("long") if n is None else F.greatest(F.col("before") - n, F.lit(0).cast("long"))
    asked = asked.withColumn("after", low)
    ends = F.array(*[F.struct(F.col(c).alias("place"), F.lit(sign).alias("sign")) for c, sign in (("before", 1.0), ("after", -1.0))])
    marks = asked.select("qid", "node", F.explode(ends).alias("e")).select("qid", "node", "e.*").filter("place > 0")
    parts = marks.join(index, ["node", "place"]).groupBy("qid").agg(
        *[F.sum(F.col("sign") * F.col("run")[k]).alias(k) for k in sums]
    )
    return asked.join(parts, "qid", "left").select(
        *queries.columns, (F.col("before") - F.col("after")).alias("_n"), *[F.col(k).alias(f"_t_{k}") for k in sums]
    )


def temporal_neighbors(
    adj: DataFrame, queries: DataFrame, n: int, mode: str = "latest", seed: int = 0, together: bool = False
) -> DataFrame:
    """For each query (qid, node, cut): n events of the node strictly before the cut.

    ``latest`` takes the last n (fewer if there are fewer), ``uniform`` draws n with replacement. Events and queries of a node
    lie side by side in time, where a query looks back n events; event histories are never paired with queries. With
    ``together`` (latest only, one row per qid) every query is one row with its ``events``, oldest first; else an event is a row.
    """
    if mode == "latest":
        if n > MOST_BACK:
            found = _latest_blocked(adj, queries, n)
            return _gathered(found, queries) if together else found
        busy, adj = _busy_and_asked(adj, queries)

        def whole(a: DataFrame, q: DataFrame) -> DataFrame:
            met = _latest(a, q, n)
            return met if together else met.withColumn("_e", F.explode("events")).select(*queries.columns, "_e.*")

        def blocked(a: DataFrame, q: DataFrame) -> DataFrame:
            found = _latest_blocked(a, q, n)
            return _gathered(found, q) if together else found

        return _by_node([adj, queries], busy, whole, blocked)
    busy = busy_nodes(adj, queries)
    return _by_node([adj, queries], busy, lambda a, q: _drawn(a, q, n, seed), lambda a, q: _drawn_blocked(a, q, n, seed))


def _latest(adj: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``queries`` with the last ``n`` events before the cut as ``events``: one sort per node, in which a query looks back over events."""
    rows, order, asked = _timeline(adj, queries, every=True)
    event = [c for c in adj.columns if c != "node"]
    upto = F.count_if(~F.col("_asks")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_event", F.when(~F.col("_asks"), F.struct(*event))).withColumn("_upto", upto)
    along = "PARTITION BY node ORDER BY ts, _asks DESC, edge_idx, other"
    back = {f"_b{k}": F.expr(f"lag(_event, {k}) IGNORE NULLS OVER ({along})") for k in range(n, 0, -1)}
    found = rows.withColumns(back).filter("_asks")

    def placed(k: int) -> Column:
        fields = [F.col(f"_b{k}")[c].alias(c) for c in event]
        return F.struct(*fields, (F.col("_upto") - (k - 1)).alias("place"))

    # An event without a time counts for the places after it, but is no neighbour; beyond the first event there is none.
    met = F.filter(F.array(*[placed(k) for k in range(n, 0, -1)]), lambda e: e["ts"].isNotNull())
    return found.select(*asked, met.alias("events"))


def _latest_blocked(adj: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events for nodes and ``n`` of any size, an event a row.

    A query turns into the places of the events it needs, and those meet the ranked events by equality. The latest n lie in one or
    two runs of n events each, so two rows per query move, whatever n is.
    """
    ranked, before = _ranked(adj, queries)
    asked = queries.join(before, ["node", "cut"]).filter("before > 0")
    run = lambda place: F.call_function("div", place - 1, F.lit(n).cast("long"))
    event = [c for c in ranked.columns if c != "node"]
    runs = ranked.groupBy("node", run(F.col("place")).alias("_run")).agg(F.collect_list(F.struct(*event)).alias("_events"))
    low = F.greatest(F.col("before") - n + 1, F.lit(1).cast("long"))
    wanted = asked.withColumn("_low", low).withColumn("_run", F.explode(F.sequence(run(F.col("_low")), run(F.col("before")))))
    inside = F.filter("_events", lambda e: e["place"].between(F.col("_low"), F.col("before")))
    met = wanted.join(runs, ["node", "_run"]).select(*queries.columns, F.explode(inside).alias("_e"))
    return met.select(*queries.columns, "_e.*")


def _gathered(found: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` with their rows of ``found`` as ``events``, oldest first."""
    event = [c for c in found.columns if c not in queries.columns]
    per = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*event).alias("e")))).alias("_p"))
    events = F.coalesce(F.transform("_p", lambda p: p["e"]), F.array())
    return queries.join(per, "qid", "left").select(*queries.columns, events.alias("events"))


def _draws(qid: str, before: str, n: int, seed: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.struct(
            k.cast("long").alias("draw"),
            (F.pmod(hashing.draw(F.col(qid) * n + k, seed), F.col(before)) + 1).alias("place"),
        ),
    )


def _drawn(adj: DataFrame, queries: DataFrame, n: int, seed: int) -> DataFrame:
    """n drawn events per query: each draw takes over the event of its place, which stands before it in the order of places."""
    rows, order, asked = _timeline(adj, queries)
    upto = F.sum(F.when(~F.col("_asks"), 1).otherwise(0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    event = [c for c in adj.columns if c != "node"]
    rows = rows.withColumn("_upto", upto).filter("NOT _asks OR _upto > 0")
    one = F.array(F.struct(F.lit(None).cast("long").alias("draw"), F.col("_upto").alias("place")))
    spots = rows.withColumn("_d", F.explode(F.when(F.col("_asks"), _draws("_q_qid", "_upto", n, seed)).otherwise(one)))
    spots = spots.select("*", "_d.*").drop("_d", "_upto")
    places = Window.partitionBy("node").orderBy("place", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    met = F.last(F.when(~F.col("_asks"), F.struct(*event)), ignorenulls=True).over(places)
    found = spots.withColumn("_e", met).filter("_asks AND _e.ts IS NOT NULL")
    return found.select(*asked, "draw", "place", "_e").select(*queries.columns, "draw", "place", "_e.*")


def _drawn_blocked(adj: DataFrame, queries: DataFrame, n: int, seed: int) -> DataFrame:
    """``_drawn`` for nodes of any size."""
    ranked, before = _ranked(adj, queries)
    asked = queries.join(before, ["node", "cut"]).filter("before > 0")
    wanted = asked.select("*", F.explode(_draws("qid", "before", n, seed)).alias("_d")).select("*", "_d.*").drop("_d")
    found = wanted.join(ranked, ["node", "place"])
    event = [c for c in adj.columns if c != "node"]
    return found.select(*queries.columns, "draw", "place", *event)


def padded_neighbors(found: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """n neighbours per query, oldest first, zeros on the left where there are fewer (or none).

    ``found`` has a row per event, or one per query with its ``events``, which then meets nothing.
    """
    if "events" in found.columns:
        joined = found.withColumn("_e", F.transform("events", lambda e: F.struct(e["ts"], e["edge_idx"], e["other"])))
    else:
        event = F.struct("ts", "edge_idx", "other")
        per = found.groupBy("qid").agg(F.sort_array(F.collect_list(event)).alias("_e"))
        joined = queries.join(per, "qid", "left")
    events = F.coalesce("_e", F.array().cast("array<struct<ts:bigint,edge_idx:bigint,other:bigint>>"))

    def column(field: str) -> Column:
        return arrays.left_pad(F.transform(events, lambda e: e[field]), n, F.lit(0).cast("long"))

    return joined.select(
        "qid", "node", "cut", column("other").alias("neighbors"), column("edge_idx").alias("edges"),
        column("ts").alias("times"),
    )


def neighborhood_features(found: DataFrame, queries: DataFrame, cols: Sequence[str], dim: int) -> DataFrame:
    """Sum over the neighbourhood of edge features followed by the cosine encoding of the time to the cut."""
    size = len(cols) + dim
    vector = F.concat(
        F.array(*[F.col(c).cast("double") for c in cols]), arrays.time_encode(F.col("cut") - F.col("ts"), dim)
    )
    rows = found.withColumn("vec", vector)
    per = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), *arrays.element_sums("vec", size))
    summed = per.select("qid", "n", arrays.gather("vec", size).alias("vec"))
    joined = queries.join(summed, "qid", "left")
    return joined.select(
        "qid", "node", "cut", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.coalesce("vec", arrays.zeros(size)).alias("vec"),
    )


def _sums(cols: Sequence[str]) -> list[str]:
    return [f"sum_{c}" for c in cols]


def batch_of(batch_rows: int, edge_idx: str = "edge_idx") -> Column:
    return F.floor((F.col(edge_idx) - 1) / batch_rows).cast("long")


def state_versions(edges: DataFrame, cols: Sequence[str], batch_rows: int = 200) -> DataFrame:
    """Node states as versions: one row per node and batch in which it has events.

    A state is the number of events so far, the sums of their features and the last one's time. The version of ``batch`` holds
    from the start of batch ``valid_from`` to the end of batch ``valid_to`` (null: still valid): what happens in a batch is seen from the next on.
    """
    both = adjacency(edges, cols).withColumn("batch", batch_of(batch_rows))
    return _by_node([both], busy_nodes(both), lambda b: _versions(b, cols), lambda b: _versions_blocked(b, cols))


def _batch_sums(both: DataFrame, cols: Sequence[str]) -> DataFrame:
    return both.groupBy("node", "batch").agg(
        F.count(F.lit(1)).alias("_n"), F.max("ts").alias("last_update"), *[F.sum(c).alias(f"_{c}") for c in cols]
    )


def _version_columns(cols: Sequence[str]) -> list[str]:
    return ["node", "batch", "valid_from", "valid_to", "n", *_sums(cols), "last_update"]


def _versions(both: DataFrame, cols: Sequence[str]) -> DataFrame:
    along = Window.partitionBy("node").orderBy("batch")
    run = along.rowsBetween(Window.unboundedPreceding, 0)
    return _batch_sums(both.repartition("node"), cols).withColumns({
        "valid_from": F.col("batch") + 1, "valid_to": F.lead("batch").over(along), "n": F.sum("_n").over(run),
        **{out: F.sum(f"_{c}").over(run) for c, out in zip(cols, _sums(cols))},
    }).select(*_version_columns(cols))


def _versions_blocked(both: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``_versions`` for nodes of any size."""
    block = F.floor(F.col("batch") / BLOCK_ROWS)
    totals = {"n": "_n", **{out: f"_{c}" for c, out in zip(cols, _sums(cols))}}
    summed = ordering.keyed_running_totals(_batch_sums(both, cols), ["node"], ["batch"], block, totals).withColumn("_back", -F.col("batch"))
    ended = ordering.previous_in_key(summed, ["node"], "_back", F.floor(F.col("_back") / BLOCK_ROWS), "_next")
    ended = ended.withColumns({"valid_from": F.col("batch") + 1, "valid_to": -F.col("_next")})
    return ended.select(*_version_columns(cols))


def state_ticks(edges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Node states after each second with events: number of events, sums of features; ``ts`` is the last update."""
    return _ticks(adjacency(edges, cols), cols)


def _ticks(adj: DataFrame, cols: Sequence[str]) -> DataFrame:
    per = adj.groupBy("node", "ts").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in cols])
    totals = {"n": "_n", **{out: f"_{c}" for c, out in zip(cols, _sums(cols))}}
    block = F.floor(F.col("ts") / BLOCK_SECONDS)
    return ordering.keyed_running_totals(per, ["node"], ["ts"], block, totals).select("node", "ts", "n", *_sums(cols))


def state_at(edges: DataFrame, asked: DataFrame, cols: Sequence[str], strict: bool = True, ends: bool = False) -> DataFrame:
    """``asked`` (node, cut, ...) with the node's state before the cut (``strict=False``: up to it): n, sums, last_update.

    A node without earlier events has no events, sums of 0 and the last update 0. With ``ends`` every edge asks for its source and
    its destination as well, as in ``both_ends``; ``asked`` then has the columns qid, side, node and cut, and times are whole
    numbers. An event is a question too then, so it moves once and not twice.
    """
    values = ["n", *_sums(cols), "last_update"]
    if ends:
        return _state_at_ends(edges, asked, cols, strict, values)
    adj = adjacency(edges, cols)

    def whole(adj: DataFrame, asked: DataFrame) -> DataFrame:
        rest = [c for c in asked.columns if c not in ("node", "cut")]
        asks = asked.filter("node IS NOT NULL AND cut IS NOT NULL").select(
            "node", F.col("cut").alias("ts"), F.lit(0 if strict else 2).alias("_turn"), *[F.col(c).alias(f"_q_{c}") for c in rest]
        )
        events = adj.select("node", "ts", F.lit(1).alias("_turn"), *[F.col(c).alias(f"_x_{c}") for c in cols])
        both = events.unionByName(asks, allowMissingColumns=True).repartition("node")
        run = Window.partitionBy("node").orderBy("ts", "_turn").rowsBetween(Window.unboundedPreceding, 0)
        event = F.col("_turn") == 1
        states = {"n": F.count(F.when(event, 1)), **{out: F.sum(f"_x_{c}") for c, out in zip(cols, _sums(cols))}}
        latest = F.max(F.when(event, F.col("ts"))).over(run)  # events without a time count from the first one that has one
        states = {c: F.when(latest.isNotNull(), v.over(run)) for c, v in states.items()}
        found = both.withColumns(states | {"last_update": latest}).filter("_turn <> 1")
        cut = F.col("ts").cast(asked.schema["cut"].dataType).alias("cut")
        return found.select("node", cut, *[F.col(f"_q_{c}").alias(c) for c in rest], *values).fillna(0, values)

    return _by_node([adj, asked], busy_nodes(adj, asked), whole, lambda a, q: _states_blocked(a, q, cols, strict, values))


def _states_blocked(adj: DataFrame, asked: DataFrame, cols: Sequence[str], strict: bool, values: Sequence[str]) -> DataFrame:
    """``state_at`` for nodes of any size."""
    ticks = _ticks(adj, cols).withColumn("last_update", F.col("ts"))
    times = asked.select("node", F.col("cut").alias("ts"))
    block = F.floor(F.col("ts") / BLOCK_SECONDS)
    found = ordering.as_of(times, ticks, ["node"], "ts", values, block, strict).withColumnRenamed("ts", "cut")
    return asked.join(found.fillna(0, values), ["node", "cut"])


def _state_at_ends(edges: DataFrame, asked: DataFrame, cols: Sequence[str], strict: bool, values: Sequence[str]) -> DataFrame:
    """``state_at`` for both ends of every edge and ``asked``."""
    end = lambda c, side: F.struct(F.col(c).alias("node"), F.lit(side).alias("side"))
    sides = F.explode(F.array(end("u", "source"), end("i", "destination"))).alias("_e")
    events = edges.select(sides, "ts", F.col("edge_idx").alias("qid"), *cols).select("_e.*", "ts", "qid", *cols)

    def whole(events: DataFrame, asked: DataFrame) -> DataFrame:
        happened = events.select("node", "ts", "qid", "side", F.lit(True).alias("_event"), *[F.col(c).alias(f"_x_{c}") for c in cols])
        asks = asked.select("node", F.col("cut").alias("ts"), "qid", "side")
        both = happened.unionByName(asks, allowMissingColumns=True).repartition("node")
        run = Window.partitionBy("node").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
        states = {"n": F.count("_event"), **{out: F.sum(f"_x_{c}") for c, out in zip(cols, _sums(cols))}}
        latest = F.max(F.when(F.col("_event"), F.col("ts"))).over(run)  # events without a time count from the first one that has one
        states = {c: F.when(latest.isNotNull(), v.over(run)) for c, v in states.items()}
        found = both.withColumns(states | {"last_update": latest}).filter("node IS NOT NULL AND ts IS NOT NULL")
        return found.select("node", F.col("ts").alias("cut"), "qid", "side", *values).fillna(0, values)

    def blocked(events: DataFrame, asked: DataFrame) -> DataFrame:
        every = events.select("node", F.col("ts").alias("cut"), "qid", "side").unionByName(asked)
        return _states_blocked(events, every, cols, strict, values)

    return _by_node([events, asked], busy_nodes(events, asked), whole, blocked)


def both_ends(edges: DataFrame, negatives: DataFrame, own: bool = True) -> DataFrame:
    """What a batch asks for: each edge's source, destination and drawn destination at the edge's time (qid, side, node, cut).

    Without ``own`` only the drawn destinations, for callers that read the others from the edges.
    """
    part = lambda df, end, side: df.select(
        F.col("edge_idx").alias("qid"), F.lit(side).alias("side"), F.col(end).alias("node"), F.col("ts").alias("cut")
    )
    drawn = part(negatives, "i", "negative")
    return part(edges, "u", "source").unionByName(part(edges, "i", "destination")).unionByName(drawn) if own else drawn


def _apart(edges: DataFrame) -> bool:
    """Do sources and destinations have ranges of ids of their own, so that no node has events on both sides?"""
    u0, u1, i0, i1 = edges.agg(F.min("u"), F.max("u"), F.min("i"), F.max("i")).first()
    return None not in (u0, i0) and (u1 < i0 or i1 < u0)


def messages(edges: DataFrame, cols: Sequence[str], dim: int, batch_rows: int = 200, stay: bool = True) -> DataFrame:
    """Two directed messages per edge: own state, other end's state, edge features, encoded time since the own last update.

    Both states are those at the start of the edge's batch of ``batch_rows`` edges (events, then sums of features); before a
    node's first batch they are 0, and so is its last update. With ``stay`` the messages lie with their node, so that what sums them
    up per node moves nothing; without, where sources and destinations are apart, an edge moves as one row for both messages.
    """
    both = adjacency(edges, cols).withColumn("batch", batch_of(batch_rows))
    busy = busy_nodes(both)
    values = ["n", *_sums(cols), "last_update"]

    def whole(rows: DataFrame) -> DataFrame:
        past = Window.partitionBy("node").orderBy("batch").rangeBetween(Window.unboundedPreceding, -1)
        sums = {out: F.coalesce(F.sum(c).over(past), F.lit(0)) for c, out in zip(cols, _sums(cols))}
        latest = F.coalesce(F.max(F.struct("batch", "ts")).over(past)["ts"], F.lit(0))
        moved = rows.drop("batch").repartition("node").withColumn("batch", batch_of(batch_rows))
        return moved.withColumns({"n": F.count(F.lit(1)).over(past), **sums, "last_update": latest})

    def blocked(rows: DataFrame) -> DataFrame:
        versions = _versions_blocked(both.filter(F.col("node").isin(busy)), cols)
        block = F.floor(F.col("batch") / BLOCK_ROWS)
        start = ordering.as_of(versions, versions, ["node"], "batch", values, block, strict=True).fillna(0, values)
        met = rows.join(start, ["node", "batch"])
        return met.select(*rows.columns, *values)

    if not stay and _apart(edges):
        # All events of a node have it at one end: an edge moves to its source, and with that state to its destination.
        timed = edges.select("u", "i", "edge_idx", "ts", *cols, batch_of(batch_rows).alias("batch"))
        for end in ("u", "i"):
            met = _by_node([timed.withColumnRenamed(end, "node")], busy, whole, blocked)
            timed = met.withColumnsRenamed({"node": end, **{c: f"_{end}_{c}" for c in values}})
        timed = timed.filter("u IS NOT NULL AND i IS NOT NULL")
        state = lambda a: [F.col(f"_{a}_{c}").cast("double") for c in values[:-1]]
        told = F.array(*[
            F.struct(
                F.col(a).alias("node"), F.col(b).alias("other"), (F.col("ts") - F.col(f"_{a}_last_update")).alias("dt"),
                F.array(*state(a), *state(b), *[F.col(c).cast("double") for c in cols]).alias("state"),
            )
            for a, b in (("u", "i"), ("i", "u"))
        ])
        sent = timed.select("batch", "edge_idx", "ts", F.explode(told).alias("_m")).select("batch", "edge_idx", "ts", "_m.*")
        vector = F.concat("state", arrays.time_encode("dt", dim))
        return sent.select("batch", "edge_idx", "node", "other", "ts", "dt", vector.alias("msg"))

    # An event takes the state of its node to the other end, which is its node then: rows move twice, and stay with their node.
    others = [f"_other_{c}" for c in values[:-1]]
    first = _by_node([both], busy, whole, blocked)
    event = ["edge_idx", "ts", *cols, "batch"]
    turned = first.select(
        F.col("other").alias("node"), F.col("node").alias("other"), *event, *[F.col(c).alias(o) for c, o in zip(values, others)]
    )
    timed = _by_node([turned], busy, whole, blocked).filter("node IS NOT NULL AND other IS NOT NULL")
    timed = timed.withColumn("dt", F.col("ts") - F.col("last_update"))
    state = F.array(*[F.col(c).cast("double") for c in [*values[:-1], *others, *cols]])
    vector = F.concat(state, arrays.time_encode("dt", dim))
    return timed.select("batch", "edge_idx", "node", "other", "ts", "dt", vector.alias("msg"))


def message_size(cols: Sequence[str], dim: int) -> int:
    return 2 * (1 + len(cols)) + len(cols) + dim


def aggregate_messages(msgs: DataFrame, size: int, how: str = "last") -> DataFrame:
    """One message per (batch, node): the last one, or the element mean with the last time."""
    late = F.max("ts").alias("ts")
    if how == "last":
        return msgs.groupBy("batch", "node").agg(F.max_by("msg", F.struct("ts", "edge_idx")).alias("msg"), late)
    per = msgs.groupBy("batch", "node").agg(late, *arrays.element_means("msg", size))
    return per.select("batch", "node", arrays.gather("msg", size).alias("msg"), "ts")


def negative_edges(edges: DataFrame, seed: int = 0, exclude: bool = False) -> DataFrame:
    """One random destination per edge, drawn evenly from the distinct destinations; ``exclude`` drops true edges.

    Where the destinations' ids have no gap, the place of one follows from its id and no edge is moved.
    """
    i = F.col("i")
    size, low, span, holes = edges.agg(F.count_distinct(i), F.min(i), F.max(i) - F.min(i) + 1, F.count_if(i.isNull())).first()
    drawn = edges.select("edge_idx", "u", "ts", F.pmod(hashing.draw("edge_idx", seed), F.lit(size).cast("long")).alias("_at"))
    if size == span and not holes:
        negatives = drawn.select("edge_idx", "u", (F.col("_at") + F.lit(low)).alias("i"), "ts")
    else:
        pool = ordering.global_index(edges.select(i.alias("neg")).distinct(), ["neg"], "_at")
        negatives = drawn.join(pool, "_at").select("edge_idx", "u", F.col("neg").alias("i"), "ts")
    if exclude:
        negatives = negatives.join(edges.select("u", "i").distinct(), ["u", "i"], "left_anti")
    return negatives


def _sent(held: DataFrame) -> DataFrame:
    """``held`` (vec_id, vec), sent whole to every executor if it takes at most ``VECTOR_BYTES``, eight an entry and 64 a row."""
    rows, entries = held.agg(F.count(F.lit(1)), F.sum(F.size("vec"))).first()
    return F.broadcast(held) if 64 * rows + 8 * (entries or 0) <= VECTOR_BYTES else held


def link_scores(edges: DataFrame, negatives: DataFrame, vectors: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Dot-product scores of true (label 1) and drawn (label 0) edges over a (node, vec) table.

    With ``held`` (vec_id, vec), ``vectors`` is a (node, vec_id) table: edges then move with numbers, and meet the vectors last,
    which come to them if their counted size allows it. No vector then moves with an edge.
    """
    pairs = edges.select("edge_idx", "u", "i", F.lit(1).cast("long").alias("label")).unionByName(
        negatives.select("edge_idx", "u", "i", F.lit(0).cast("long").alias("label"))
    )
    value = "vec" if held is None else "vec_id"
    left = vectors.select(F.col("node").alias("u"), F.col(value).alias("_a"))
    right = vectors.select(F.col("node").alias("i"), F.col(value).alias("_b"))
    met = pairs.join(left, "u").join(right, "i")
    if held is not None:
        held = _sent(held)
        for end in ("_a", "_b"):
            found = held.select(F.col("vec_id").alias("_id"), F.col("vec").alias("_vec"))
            met = met.join(found, F.col(end) == F.col("_id")).drop(end, "_id").withColumnRenamed("_vec", end)
    return met.select("edge_idx", "u", "i", "label", arrays.dot("_a", "_b").alias("score"))


def split_by_time(edges: DataFrame, start: str, val_months: int = 6, test_months: int = 3) -> DataFrame:
    """train / valid / test by calendar: the test part is the last ``test_months``, validation starts ``val_months`` back."""
    cuts = time_cuts(edges, start, val_months, test_months)
    return edges.withColumn("part", _part(F.col("ts"), F.lit(cuts[0]), F.lit(cuts[1])))


def _part(ts: Column, val: Column, test: Column) -> Column:
    return F.when(ts <= val, "train").when(ts <= test, "valid").otherwise("test")


def time_cuts(edges: DataFrame, start: str, val_months: int, test_months: int) -> tuple[int, int]:
    """The two cut times in seconds since ``start``."""
    origin = F.lit(start).cast("timestamp_ntz")
    last = F.max("ts")
    end = origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), last.cast("decimal(18,6)"))

    def back(months: int) -> Column:
        return dates.epoch_seconds(end - F.make_ym_interval(F.lit(0), F.lit(months))) - dates.epoch_seconds(origin)

    row = edges.agg(back(val_months).alias("val"), back(test_months).alias("test")).first()
    return row["val"], row["test"]


def split_by_quantile(edges: DataFrame, val: float = 0.70, test: float = 0.85) -> DataFrame:
    q = ordering.exact_quantiles(edges, "ts", {"val": val, "test": test}).first()
    return edges.withColumn("part", _part(F.col("ts"), F.lit(q["val"]), F.lit(q["test"])))


def held_out_nodes(edges: DataFrame, val_time: int, fraction: float, seed: int) -> DataFrame:
    """A fixed share of all nodes, drawn from those seen after the training period."""
    n = int(fraction * nodes(edges).count())
    return sampling.exact(nodes(edges.filter(F.col("ts") > val_time)), "node", n, seed)


def inductive_split(
    edges: DataFrame, val_time: int, test_time: int, fraction: float = 0.1, seed: int = 2020, halves: bool = False
) -> DataFrame:
    """Parts with held-out nodes: training edges that touch one are marked ``dropped``.

    ``new_node`` marks validation and test edges with a node absent from training; with ``halves`` the held-out nodes are
    dealt to validation and test, and an edge is marked only for the half of its own part.
    """
    ts = F.col("ts")
    held = held_out_nodes(edges, val_time, fraction, seed).withColumn("_held", F.lit(True))
    if halves:
        held = held.withColumn("_half", F.pmod(hashing.draw("node", seed + 1), F.lit(2)))

    def flagged(df: DataFrame, marks: DataFrame, col: str, end: str) -> DataFrame:
        renamed = marks.withColumnsRenamed({c: f"{c}_{end}" for c in marks.columns if c != "node"})
        return df.join(renamed.withColumnRenamed("node", end), end, "left")

    marked = flagged(flagged(edges, held, "_held", "u"), held, "_held", "i")
    touches = F.coalesce("_held_u", F.lit(False)) | F.coalesce("_held_i", F.lit(False))
    part = _part(ts, F.lit(val_time), F.lit(test_time))
    marked = marked.withColumn("part", F.when((part == "train") & touches, "dropped").otherwise(part))
    later = F.col("part").isin("valid", "test")
    if halves:
        own = F.when(F.col("part") == "valid", 0).otherwise(1)
        hit = F.coalesce(F.col("_half_u") == own, F.lit(False)) | F.coalesce(F.col("_half_i") == own, F.lit(False))
        return marked.withColumn("new_node", later & hit).select(*edges.columns, "part", "new_node")
    trained = nodes(marked.filter("part = 'train'")).withColumn("_known", F.lit(True))
    known = flagged(flagged(marked.select(*edges.columns, "part"), trained, "_known", "u"), trained, "_known", "i")
    new = F.col("_known_u").isNull() | F.col("_known_i").isNull()
    return known.withColumn("new_node", later & new).select(*edges.columns, "part", "new_node")


def overlap(training: DataFrame, held: DataFrame) -> DataFrame:
    """Nodes in both sets; empty when the split is sound."""
    return training.select("node").intersect(held.select("node"))


def split_counts(parted: DataFrame) -> DataFrame:
    """Interactions and distinct nodes per part."""
    rows = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_node")).alias("n_new"))
    ends = parted.select("part", F.explode(F.array("u", "i")).alias("node"))
    return rows.join(ends.groupBy("part").agg(F.count_distinct("node").alias("n_nodes")), "part")


def static_node_features(edges: DataFrame, side: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First value of each column per node."""
    first = F.min_by(F.struct(*cols), F.struct(*order)).alias("_v")
    return edges.groupBy(F.col(side).alias("node")).agg(first).select("node", "_v.*")
