"""Prefix trie of conversations, rolled up over a centroid decomposition of its parent edges.

A node is a distinct sequence of first turns. It is known by its smallest member conversation and its depth, both numbers; the
sequence itself is known by a 128-bit running hash, so a conversation of any length is cut into blocks like any running total.

Roll-up of a value over subtrees: a component's centroid is the deepest node that holds more than half of the component's weight
below it. The component's total at the centroid is added to every node on the path from there to the component's top;
then the centroid goes, what lay below it falls into one component per child, and the rest stays one. No component keeps more than half the weight,
so depth costs rounds by its logarithm only. Weights need no roll-up of their own: the member turns below a node are known
when the node is grouped from its members. Large components are split by joins over all tasks, one round after the other;
components of at most ``LOCAL_NODES`` nodes are finished inside tasks by the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.textkit import batches
from trendloom.operators.ordering import global_index, keyed_running_totals
from trendloom.sources.work import store

#: Nodes of a component that one task finishes.
LOCAL_NODES = 8192
#: Turns of one conversation, and ids of one node's ends, that a window or a row holds.
BLOCK_TURNS, BLOCK_IDS = 1 << 16, 1 << 12
GROUP, SHARED = 5, 9


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``c``, ``pos`` from 0, ``content`` (md5 of role and text) and ``size`` (bytes of the text) of every turn.

    Turns go by ``turn``, null first, then by content; rows without a conversation are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.octet_length(text).cast("long").alias("size"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("content"),
        F.monotonically_increasing_id().alias("row"),  # equal rows may lie in two ranges
    )
    placed = store(global_index(base, ["c", F.asc_nulls_first("turn"), "content", "row"], "g"), "trie-turns")
    first = placed.groupBy("c").agg(F.min("g").alias("first"))
    return placed.join(first, "c").select("c", (F.col("g") - F.col("first")).alias("pos"), "content", "size")


def shared_turns(c: Column) -> Column:
    """Turns that a conversation takes from the first one of its group."""
    return (F.crc32(c.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, p, content, size) of the rebuilt conversations, and the rebuilt length of every conversation (c, len).

    Conversation c starts with the first h original turns of conversation c - c % 5 and goes on with its own after its first h.
    """
    rows = store(ordered_turns(turns), "trie-placed")
    own = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    base = own.select(F.col("c").alias("b"), F.col("n").alias("n_b"))
    convs = own.withColumns({"h": shared_turns(F.col("c")), "b": F.col("c") - F.col("c") % GROUP}).join(base, "b", "left")
    taken = F.least("h", F.coalesce("n_b", F.lit(0)))
    convs = store(convs.select("c", "h", "b", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-convs")
    lent = rows.filter((F.col("c") % GROUP == 0) & (F.col("pos") < SHARED - 1)).withColumnRenamed("c", "b")
    head = convs.select("c", "h", "b").join(lent, "b").filter("pos < h").select("c", F.col("pos").alias("p"), "content", "size")
    rest = rows.join(convs.select("c", "h", "taken"), "c").filter("pos >= h").select(
        "c", (F.col("taken") + F.col("pos") - F.col("h")).alias("p"), "content", "size"
    )
    return head.unionByName(rest), convs.select("c", "len")


def prefixes(rows: DataFrame) -> DataFrame:
    """``c``, depth ``d`` from 1, the key (k1, k2) of the first d turns, and the size of the last one.

    A turn counts with a hash of its content and place, and a sequence with the sums of its turns' hashes.
    """
    hashed = F.md5(F.concat("content", F.lit("."), F.col("p").cast("string")))
    part = lambda k: F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")
    base = rows.select("c", "p", "size", *[part(k).alias(f"h{k}") for k in range(4)])
    sums = keyed_running_totals(
        base, ["c"], ["p"], F.shiftright("p", BLOCK_TURNS.bit_length() - 1), {f"s{k}": f"h{k}" for k in range(4)}
    )
    low = lambda k: F.col(f"s{k}").bitwiseAND(0xFFFFFFFF)
    key = lambda a, b: F.shiftleft(low(a), 32).bitwiseOR(low(b))
    return sums.select("c", (F.col("p") + 1).alias("d"), key(0, 1).alias("k1"), key(2, 3).alias("k2"), "size")


def trie(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (conv, d, parent, n_convs, n_children, size, weight), paths (c, d, owner, above), and ends (c, len).

    ``paths`` names the node of every rebuilt conversation at every depth from 0, and the conversation of the node above.
    """
    rows, ends = rebuilt(turns)
    root = ends.select("c", *[F.lit(0).cast("long").alias(x) for x in ("d", "k1", "k2", "size")])
    members = store(prefixes(rows).unionByName(root), "trie-members")
    key = ["d", "k1", "k2"]
    weighed = members.join(ends, "c").withColumn("below", F.col("len") - F.col("d") + 1)
    nodes = store(
        weighed.groupBy(*key).agg(
            F.min("c").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.sum("below").alias("weight")
        ),
        "trie-nodes",
    )
    # A node with one member belongs to it; the others are looked up.
    met = nodes.filter("n_convs > 1").select(*key, F.col("conv").alias("met"))
    named = members.join(met, key, "left").select("c", "d", F.coalesce("met", "c").alias("owner"))
    named = store(named, "trie-named")
    above = named.select("c", (F.col("d") + 1).alias("d"), F.col("owner").alias("above"))
    paths = store(named.join(above, ["c", "d"], "left"), "trie-paths")
    parents = paths.filter("c = owner").select(F.col("c").alias("conv"), "d", F.col("above").alias("parent"))
    children = parents.filter("d > 0").groupBy(F.col("parent").alias("conv"), (F.col("d") - 1).alias("d")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    full = nodes.drop("k1", "k2").join(parents, ["conv", "d"]).join(children, ["conv", "d"], "left").fillna(0, ["n_children"])
    return full, paths, ends


def finish(nodes: Sequence[tuple], width: int) -> list[tuple]:
    """Sums over subtrees of the components in ``nodes``: (conv, d, parent, top conv, top d, weight, values, added).

    Values are sums over the node's part of its component, ``added`` what came from components cut off before.
    """
    spot = {(r[0], r[1]): i for i, r in enumerate(nodes)}
    # The node above, unless it lies outside the component.
    above = [spot[r[2], r[1] - 1] if (r[0], r[1]) != (r[3], r[4]) else -1 for r in nodes]
    weight = [r[5] for r in nodes]
    values, sums = [r[6] for r in nodes], [list(r[7]) for r in nodes]
    groups: dict[tuple, list[int]] = {}
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i][1]):
        groups.setdefault((nodes[i][3], nodes[i][4]), []).append(i)
    todo, each = list(groups.values()), range(width)
    while todo:
        part = todo.pop()  # parents before their children
        half = weight[part[0]]
        centre = min((i for i in part if 2 * weight[i] > half), key=weight.__getitem__)
        below: dict[int, list[int]] = {}
        label, rest, total = {}, [], list(values[centre])
        for i in part:
            if i == centre:
                continue
            to = i if above[i] == centre else label.get(above[i])
            if to is None:
                rest.append(i)
                continue
            label[i] = to
            below.setdefault(to, []).append(i)
            for k in each:
                total[k] += values[i][k]
        up = centre
        while up != part[0]:
            up = above[up]
            weight[up] -= weight[centre]
            for k in each:
                sums[up][k] += total[k]
        for k in each:
            sums[centre][k] += total[k]
        for tops in below:
            above[tops] = -1
        todo += [p for p in [rest, *below.values()] if p]
    return [(r[0], r[1], *s) for r, s in zip(nodes, sums)]


def _split(large: DataFrame, paths: DataFrame, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One round over large components: the centroids with their sums, and all other nodes in their new components."""
    top = ["tc", "td"]
    whole = large.groupBy(*top).agg(F.max("weight").alias("whole"))
    heavy = large.join(whole, top).filter("2 * weight > whole")
    least = heavy.groupBy(*top).agg(F.min("weight").alias("weight"))
    centres = store(
        heavy.join(least, [*top, "weight"]).select(*top, F.col("conv").alias("cc"), F.col("d").alias("cd"), F.col("weight").alias("cw")),
        "trie-centres",
    )
    spot = paths.select(F.col("c").alias("conv"), (F.col("d") - 1).alias("cd"), F.col("owner").alias("under"), F.col("above").alias("over"))
    placed = large.join(centres, top)
    deeper = placed.filter("d > cd").join(spot, ["conv", "cd"])
    labelled = deeper.withColumn("to", F.when(F.col("over") == F.col("cc"), F.col("under"))).drop("under", "over")
    others = placed.filter("d <= cd").withColumn("to", F.lit(None).cast("long"))
    known = store(labelled.unionByName(others), "trie-round")
    is_centre = (F.col("conv") == F.col("cc")) & (F.col("d") == F.col("cd"))
    totals = known.filter(is_centre | F.col("to").isNotNull()).groupBy(*top).agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    totals = store(centres.join(totals, top), "trie-totals")
    # The path from a centroid to its component's top, read from the centroid's own conversation.
    steps = paths.select(F.col("c").alias("cc"), "d", F.col("owner").alias("conv"))
    way = totals.join(steps, "cc").filter("d < cd AND d >= td").select("conv", "d", F.col("cw").alias("less"), *[f"t_{v}" for v in values])
    done = known.filter(is_centre).join(totals.select(*top, *[f"t_{v}" for v in values]), top).select(
        "conv", "d", *[(F.col(f"a_{v}") + F.col(f"t_{v}")).alias(v) for v in values]
    )
    left = known.filter(~is_centre).join(way, ["conv", "d"], "left")
    moved = left.withColumns({
        "tc": F.coalesce("to", "tc"), "td": F.when(F.col("to").isNotNull(), F.col("cd") + 1).otherwise(F.col("td")),
        "weight": F.col("weight") - F.coalesce("less", F.lit(0)),
        **{f"a_{v}": F.col(f"a_{v}") + F.coalesce(f"t_{v}", F.lit(0)) for v in values},
    })
    return done, moved.select(large.columns)


def roll_up(nodes: DataFrame, paths: DataFrame, values: Sequence[str], local_nodes: int = LOCAL_NODES) -> DataFrame:
    """``conv``, ``d`` and the sums of whole-number ``values`` over every node's subtree, the node included.

    ``nodes`` has conv, d, parent (conversation of the node above, null at the top), weight (at least 1 more than the weights of its children
    together) and the values; ``paths`` as ``trie`` returns it.
    """
    roots = paths.filter("d = 0").select(F.col("c").alias("conv"), F.col("owner").alias("tc"))
    state = nodes.join(roots, "conv").select(
        "conv", "d", "parent", "tc", F.lit(0).cast("long").alias("td"), "weight", *[F.col(v).cast("long").alias(v) for v in values],
        *[F.lit(0).cast("long").alias(f"a_{v}") for v in values],
    )
    top, done, small, count = ["tc", "td"], [], [], 0
    left = store(state, "trie-state")
    while True:
        sizes = store(left.groupBy(*top).agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
        fits, more = sizes.agg(F.sum(F.when(F.col("n") <= local_nodes, F.col("n"))), F.max("n")).first()
        count += fits or 0
        if not more or more <= local_nodes:
            small.append(left)
            break
        small.append(left.join(sizes.filter(F.col("n") <= local_nodes).select(*top), top, "left_semi").select(left.columns))
        finished, rest = _split(left.join(sizes.filter(F.col("n") > local_nodes).select(*top), top, "left_semi"), paths, values)
        done.append(store(finished, "trie-done"))
        left = store(rest, "trie-left")
    buckets = max(1, -(-count // local_nodes))

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        rows = zip(*[found.column(c).to_pylist() for c in ("conv", "d", "parent", "tc", "td", "weight")])
        mine = zip(*[found.column(v).to_pylist() for v in values])
        added = zip(*[found.column(f"a_{v}").to_pylist() for v in values])
        out = finish([(*r, v, a) for r, v, a in zip(rows, mine, added)], len(values))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)], ["conv", "d", *values])

    kind = ", ".join(f"{c} long" for c in ["conv", "d", *values])
    pieces = small[0]
    for part in small[1:]:
        pieces = pieces.unionByName(part)
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(*top), F.lit(buckets)))
    out = spread.groupBy("bucket").applyInArrow(run, kind)
    for part in done:
        out = out.unionByName(part)
    return out


def end_digests(ends: DataFrame, paths: DataFrame) -> DataFrame:
    """``conv``, ``d`` and ``ends_sha256`` of nodes where conversations end.

    The digest of one node runs over its ids in order, so it is one task's; the task reads them as a stream of blocks.
    """
    spot = ends.join(paths, (paths["c"] == ends["c"]) & (paths["d"] == ends["len"])).select(
        F.col("owner").alias("conv"), "d", ends["c"].alias("id")
    )
    blocks = spot.withColumn("block", F.shiftright("id", BLOCK_IDS.bit_length() - 1)).groupBy("conv", "d", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches(found):
            out = []
            for conv, d, ids in zip(*[batch.column(c).to_pylist() for c in ("conv", "d", "ids")]):
                if (conv, d) != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (conv, d), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _digests(out)
        if now is not None:
            yield _digests([(*now, digest.hexdigest())])

    return blocks.repartition("conv", "d").sortWithinPartitions("conv", "d", "block").select("conv", "d", "ids").mapInArrow(
        run, "conv long, d long, ends_sha256 string"
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "d", "ends_sha256"])


def prefix_trie(turns: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, from the textless root on.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes in the subtree),
    saved_tokens (bytes of repeated last texts, summed over the subtree), ends_sha256 (digest of the ids of conversations that end here).
    Null role or text is empty; null turns come first; equal turns go by the md5 of role and text; repeated rows are turns of their
    own; rows without conversation id are left out; other columns are ignored; an empty table gives no rows, not even a root.
    """
    nodes, paths, ends = trie(turns)
    nodes = store(nodes, "trie-full")
    marked = nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size"),
    })
    sums = roll_up(marked, paths, ["n_leaves", "saved_tokens"], local_nodes)
    digests = end_digests(ends, paths)
    empty = F.lit(hashlib.sha256().hexdigest())
    return nodes.join(sums, ["conv", "d"]).join(digests, ["conv", "d"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
        F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
