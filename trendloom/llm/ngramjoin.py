"""Exact Jaccard self-join on word shingles that skips by relations between sets.

Texts with one shingle set form a class. Classes with the same smallest hashes, in any of a few orders, meet one of them;
those verified to be similar to it are linked, and what is linked forms a cluster around its smallest class, the leader. The inverted index over rarity-ordered prefixes then holds one entry per token and
cluster (smallest place, range of sizes), so a group of near copies costs as much as one text. Lists are passed in blocks
whose sizes and places allow a skip of whole block pairs. Candidate clusters are verified leader against leader; what
other members can add follows from their known overlap with the leader, so few are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.components import components
from trendloom.llm.lmscore import expand, part_of, squeeze
from trendloom.llm.textkit import ascii_words, batches, gram_hashes, mix, word_hashes
from trendloom.sources.work import store, work_path

#: Counters of the frequency sketch that orders shingles; any fixed number gives right results.
SKETCH_BITS, SLICES = 22, 16
GATHER, PART_BYTES, BLOCK = 1_000_000, 32 << 20, 64
#: Orders whose two smallest hashes bring classes together before the exact join; more of them only save work.
ORDERS = 3
#: Entries of one token beyond the sketch's noise that share a cell of its comparison grid.
CELL = 50_000
#: Ids up to this number are broadcast to pick texts out; more meet the texts in a shuffled join.
BROADCAST_IDS = 1_000_000


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's n-word shingles."""
    return np.unique(gram_hashes(word_hashes(ascii_words(text)), n))


def prefix_size(n, num: int, den: int):
    """Rarest places of which a set of n must share one with any set similar enough."""
    return n - -(-n * num // den) + 1


def overlap_needed(total, num: int, den: int):
    """Least intersection of two sets with ``total`` members together: i / (total - i) >= num / den."""
    return -(-total * num // (den + num))


def _batch(columns: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (set size, set digest, smallest hashes of each order), and per task the slices of its frequency sketch."""

    def smallest(s: np.ndarray) -> list[int] | None:
        low = [np.sort(np.partition(x, 1)[:2] if len(x) > 2 else x) for x in (mix(s + np.uint64(7 + k)) for k in range(ORDERS))]
        return [xxhash.xxh3_64_intdigest(x.tobytes(), k) >> 1 for k, x in enumerate(low)] if len(s) else None

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        names = ["kind", "doc_id", "n", "digest", "buckets"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

        def pour() -> None:
            if held:
                slots = np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)
                np.add(counts, np.bincount(slots.astype(np.int64), minlength=len(counts)).astype(np.uint32), out=counts)
                held.clear()

        for batch in batches(found, owner="words"):
            out = []
            for text in batch.column("text").to_pylist():
                s = shingles(text, n)
                held.append(s)
                size += len(s)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, smallest(s)))
            if size > GATHER:
                pour()
                size = 0
            sizes, digests, buckets = map(list, zip(*out))
            yield _batch([["doc"] * len(out), batch.column("doc_id"), sizes, digests, buckets], names, kinds)
        pour()
        if counts.any():
            parts = [squeeze(x) for x in np.split(counts, SLICES)]
            yield _batch([["sketch"] * SLICES, [None] * SLICES, range(SLICES), parts, [None] * SLICES], names, kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "kind string, doc_id long, n long, digest binary, buckets array<long>"
    )


def frequencies(described: DataFrame) -> np.ndarray:
    """The summed sketch: a fixed number of counters, whatever the corpus."""

    def add(key: tuple[pa.Scalar, ...], found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
        for batch in found:
            for raw in batch.column("digest").to_pylist():
                total += expand(raw)
        capped = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        yield _batch([[key[0].as_py()], [squeeze(capped)]], ["n", "digest"], [pa.int64(), pa.binary()])

    rows = described.filter("kind = 'sketch'").select("n", "digest").groupBy("n").applyInArrow(add, "n long, digest binary").collect()
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint32)
    for r in rows:
        out[r["n"]] = expand(r["digest"])
    return out.reshape(-1)


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``doc_id`` and shingle set of the texts with the given distinct ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, "doc_id")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, owner="words"):
            sets = [shingles(t, n).tobytes() for t in batch.column("text").to_pylist()]
            yield _batch([batch.column("doc_id"), sets], ["doc_id", "grams"], [pa.int64(), pa.binary()])

    return picked.mapInArrow(run, "doc_id long, grams binary")


def overlaps(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Exact intersection sizes of distinct pairs (a, b) of documents, each known by one representative row."""
    pairs = store(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = store(_sets(docs, store(ids, "pair-ids"), n).dropDuplicates(["doc_id"]), "pair-sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, owner="words"):
            shared = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0)
            yield _batch([batch.column("a"), batch.column("b"), shared], ["a", "b", "shared"], [pa.int64()] * 3)

    return met.mapInArrow(run, "a long, b long, shared long")


def _prefixes(docs: DataFrame, spread, n: int, num: int, den: int) -> DataFrame:
    """Every document's prefix: its shingles in the order of rarity, the sketch first and then the hash."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = spread.value
        for batch in batches(found, owner="words"):
            out = []
            for text in batch.column("text").to_pylist():
                s = shingles(text, n)
                order = np.argsort(rarity[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                out.append(s[order[: prefix_size(len(s), num, den) if len(s) else 0]].tobytes())
            yield _batch([batch.column("doc_id"), out], ["doc_id", "prefix"], [pa.int64(), pa.binary()])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, prefix binary")


def _postings(prefixes: DataFrame, spread, parts: int, room: int, gather: int) -> DataFrame:
    """Index entries (token, cluster, smallest place, sizes), gathered per task and parted by token and grid cell."""

    def pour(held: list) -> pa.RecordBatch:
        token = np.concatenate([h[0] for h in held])
        lengths = [len(h[0]) for h in held]
        cluster, size = (np.repeat([h[k] for h in held], lengths) for k in (1, 2))
        place = np.concatenate([np.arange(m) for m in lengths])
        order = np.lexsort((cluster, token))
        token, cluster, size, place = (x[order] for x in (token, cluster, size, place))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cluster[1:] != cluster[:-1])
        at = np.flatnonzero(new)
        token, cluster = token[at], cluster[at]
        place, low, high = np.minimum.reduceat(place, at), np.minimum.reduceat(size, at), np.maximum.reduceat(size, at)
        rarity = spread.value
        seen = rarity[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
        blocks = 1 + np.maximum(seen - 2 * int(rarity.mean()), 0) // room
        own = (mix(cluster.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        copies = np.repeat(np.arange(len(token)), blocks)  # a hot token's entry goes to every cell of its row or column
        other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        a, b = np.minimum(own[copies], other), np.maximum(own[copies], other)
        cell = a * blocks[copies] + b
        side = np.where(a == b, 0, np.where(own[copies] == a, 1, 2))
        key = mix(token[copies] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        part = part_of(key, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        out = []
        for p in range(parts):
            rows = order[cuts[p] : cuts[p + 1]]
            if len(rows):
                w = copies[rows]
                out.append((p, key[rows].tobytes(), cluster[w].tobytes(),
                            squeeze(np.concatenate([place[w], low[w], high[w] - low[w], side[rows]]))))
        names = ["part", "tokens", "clusters", "rest"]
        return _batch(list(zip(*out)), names, [pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches(found, owner="words"):
            for raw, cluster, n in zip(*[batch.column(c).to_pylist() for c in ("prefix", "cluster", "n")]):
                held.append((np.frombuffer(raw, np.uint64), cluster, n))
                size += len(raw) // 8
            if size > gather:
                yield pour(held)
                held, size = [], 0
        if size:
            yield pour(held)

    return prefixes.mapInArrow(run, "part int, tokens binary, clusters binary, rest binary")


def _fits(p, lo, hi, q, lo2, hi2, num: int, den: int):
    """Whether sets with these places and sizes may be similar when this is their first common token."""
    left = 1 + np.minimum(hi - p - 1, hi2 - q - 1)
    return (hi * den >= lo2 * num) & (hi2 * den >= lo * num) & (left >= overlap_needed(lo + lo2, num, den))


def list_pairs(token, cluster, place, low, high, side, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of entries of one token that may belong to similar clusters; entries are sorted by token and size.

    Short lists are compared by their distance in the list, all lists at once. Long ones go block by block: a block pair is
    skipped if its ranges of sizes and places rule out every pair in it.
    """
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    length = np.diff(edges)
    rank_left = np.repeat(edges[1:], length) - np.arange(len(token)) - 1
    short = np.repeat(length <= BLOCK, length)
    values = place, low, high

    def keep(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (cluster[i] != cluster[j]) & ((side[i] != side[j]) | (side[i] == 0))
        i, j = i[ok], j[ok]
        ok = _fits(*[v[i] for v in values], *[v[j] for v in values], num, den)
        return i[ok], j[ok]

    for step in range(1, BLOCK):
        i = np.flatnonzero(short & (rank_left >= step))
        if not len(i):
            break
        yield keep(i, i + step)
    for k in np.flatnonzero(length > BLOCK):
        starts = np.arange(edges[k], edges[k + 1], BLOCK)
        p, lo = np.minimum.reduceat(place[: edges[k + 1]], starts), np.minimum.reduceat(low[: edges[k + 1]], starts)
        hi = np.maximum.reduceat(high[: edges[k + 1]], starts)
        for x, at in enumerate(starts):
            reach = _fits(p[x], lo[x], hi[x], p[x:], lo[x:], hi[x:], num, den)
            mine = np.arange(at, min(at + BLOCK, edges[k + 1]))
            for y in np.flatnonzero(reach) + x:
                theirs = np.arange(starts[y], min(starts[y] + BLOCK, edges[k + 1]))
                i, j = np.repeat(mine, len(theirs)), np.tile(theirs, len(mine))
                if x == y:
                    i, j = i[i < j], j[i < j]
                yield keep(i, j)


def _candidates(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b): clusters with a common prefix token whose places and sizes let it be the first of a similar pair."""

    def run(key: tuple[pa.Scalar, ...], found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, clusters, rest = [], [], []
        for batch in found:
            for t, c, r in zip(*[batch.column(x).to_pylist() for x in ("tokens", "clusters", "rest")]):
                tokens.append(np.frombuffer(t, np.uint64))
                clusters.append(np.frombuffer(c, np.int64))
                rest.append(expand(r).reshape(4, -1))
        token, cluster, rest = np.concatenate(tokens), np.concatenate(clusters), np.concatenate(rest, axis=1).astype(np.int64)
        order = np.lexsort((cluster, token))
        token, cluster, rest = token[order], cluster[order], rest[:, order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cluster[1:] != cluster[:-1])
        at = np.flatnonzero(new)  # entries of one cluster from several tasks
        place, low = np.minimum.reduceat(rest[0], at), np.minimum.reduceat(rest[1], at)
        high, side = np.maximum.reduceat(rest[1] + rest[2], at), rest[3][at]
        token, cluster = token[at], cluster[at]
        alone = np.ones(len(token), bool)
        alone[1:] &= token[1:] != token[:-1]
        alone[:-1] &= token[1:] != token[:-1]
        order = np.flatnonzero(~alone)
        order = order[np.lexsort((low[order], token[order]))]
        held, size = [], 0
        for i, j in list_pairs(*[x[order] for x in (token, cluster, place, low, high, side)], num, den):
            x, y = cluster[order[i]], cluster[order[j]]
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            size += len(x)
            if size > GATHER:
                yield unlike(held)
                held, size = [], 0
        yield unlike(held)

    def unlike(held: list) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held, axis=1), axis=1) if held else np.zeros((2, 0), np.int64)
        return _batch([pairs[0], pairs[1]], ["a", "b"], [pa.int64()] * 2)

    return postings.groupBy("part").applyInArrow(run, "a long, b long").distinct()


def _enough(shared, total, num: int, den: int):
    return shared * (den + num) >= total * num


def member_links(docs: DataFrame, still: DataFrame, clusters: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of open cluster pairs, one at least per pair that has any.

    The larger cluster of a pair lies in blocks of members, the members of all its smaller partners in blocks beside it; a tile
    is a block of each, so a set is sent once per block, not once per pair. Inside, the overlap that leaders share
    bounds every pair, and only pairs within the bound are compared.
    """
    flip = F.col("k_a") < F.col("k_b")
    pairs = store(
        still.select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("c"),
                     F.when(flip, F.col("a")).otherwise(F.col("b")).alias("partner"), "shared"), "open-pairs"
    )
    both = pairs.select(F.explode(F.array("c", "partner")).alias("cluster")).distinct()
    members = store(clusters.join(both, "cluster"), "open-members")
    sets = store(_sets(docs, store(members.select(F.col("rep").alias("doc_id")), "open-ids"), n).dropDuplicates(["doc_id"]), "open-sets")
    full = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    x = full.select(F.col("cluster").alias("c"), "rep", "n", "own", "grams").join(pairs.select("c").distinct(), "c")
    y = pairs.join(full.select(F.col("cluster").alias("partner"), "rep", "n", "own", "grams"), "partner")

    def blocks(df: DataFrame, fields: list[str], name: str) -> DataFrame:
        counts = df.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
        spot = F.pmod(F.xxhash64("rep"), F.col("_blocks"))
        return df.join(counts, "c").groupBy("c", spot.alias("_spot")).agg(F.collect_list(F.struct(*fields)).alias(name)).drop("_spot")

    tiled = blocks(x, ["rep", "n", "own", "grams"], "xs").join(blocks(y, ["partner", "shared", "rep", "n", "own", "grams"], "ys"), "c")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, 1, "words"):
            c, out, done = batch.column("c")[0].as_py(), [], set()
            xs = [(r["rep"], r["n"], r["own"], np.frombuffer(r["grams"], np.uint64)) for r in batch.column("xs")[0].as_py()]
            size, own = np.array([r[1] for r in xs]), np.array([r[2] for r in xs])
            for r in batch.column("ys")[0].as_py():
                if r["partner"] in done:
                    continue
                grams, total = np.frombuffer(r["grams"], np.uint64), size + r["n"]
                near = (r["shared"] + own + r["own"]) * (den + num) >= total * num
                near &= np.minimum(size, r["n"]) * den >= np.maximum(size, r["n"]) * num
                for k in np.flatnonzero(near):
                    if xs[k][0] == c and r["rep"] == r["partner"]:
                        continue
                    at = np.searchsorted(grams, xs[k][3])
                    shared = int((grams[np.minimum(at, len(grams) - 1)] == xs[k][3]).sum())
                    if shared * (den + num) >= total[k] * num:
                        out.append((xs[k][0], r["rep"]))
                        done.add(r["partner"])
                        break
            yield _batch(list(zip(*out)) or [[], []], ["a", "b"], [pa.int64()] * 2)

    return tiled.mapInArrow(run, "a long, b long")


def similar_texts(
    docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, parts: int | None = None, room: int = CELL, gather: int = GATHER
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id`` (smallest doc_id with the same set) and ``component_id`` of every row.

    Sets are linked when den * intersection >= num * union, exactly (shingles are known by 64-bit hashes). Texts without words,
    null texts and rows with a null id link with nothing; a null id has a null component. Rows that share an id are
    one document only if their sets are equal, so ids must be unique for different texts. Repeated rows give repeated
    rows; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(6, -(-size // PART_BYTES))
    path = work_path(spark, "shingle-sets")
    describe(docs, n).write.partitionBy("kind").parquet(path)
    described = spark.read.schema("kind string, doc_id long, n long, digest binary, buckets array<long>").parquet(path)
    spread = spark.sparkContext.broadcast(frequencies(described))
    rows = described.filter("kind = 'doc'").drop("kind")
    classes = store(
        rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("buckets").alias("buckets")),
        "classes",
    )
    spots = classes.select("rep", F.explode("buckets").alias("bucket"))
    leads = spots.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    near = spots.join(leads, "bucket").filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    size_of = lambda c, name: classes.select(F.col("rep").alias(c), F.col("n").alias(name))
    met = overlaps(docs, near, n).join(size_of("a", "na"), "a").join(size_of("b", "nb"), "b")
    members = store(met.filter(_enough(F.col("shared"), F.col("na") + F.col("nb"), num, den)).select("a", "b"), "members")
    grown = components(members).filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    led = overlaps(docs, grown, n).select(F.col("a").alias("rep"), F.col("b").alias("lead"), "shared")
    clusters = store(
        classes.join(led, "rep", "left").select(
            "rep", "n", F.coalesce("lead", "rep").alias("cluster"), (F.col("n") - F.coalesce("shared", "n")).alias("own")
        ),
        "clusters",
    )
    prefixes = _prefixes(docs, spread, n, num, den).join(clusters.select(F.col("rep").alias("doc_id"), "cluster", "n"), "doc_id")
    found = _candidates(_postings(prefixes.select("prefix", "cluster", "n"), spread, parts, room, gather), num, den)
    ranges = clusters.groupBy("cluster").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("own").alias("own"),
        F.max(F.when(F.col("rep") == F.col("cluster"), F.col("n"))).alias("n"), F.count(F.lit(1)).alias("k"),
    )
    side = lambda c: ranges.select(F.col("cluster").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("low", "high", "own", "n", "k")])
    held = store(found.join(side("a"), "a").join(side("b"), "b"), "candidates")
    checked = store(held.join(overlaps(docs, held.select("a", "b"), n), ["a", "b"]), "checked")
    linked = _enough(F.col("shared"), F.col("n_a") + F.col("n_b"), num, den)
    # What members add to the leaders' overlap is at most what they do not share with their leader; a smaller member needs
    # less. Cluster pairs that other links join already need no more; in the rest, members meet members in tiles.
    reach = _enough(F.col("shared") + F.col("own_a") + F.col("own_b"), F.col("low_a") + F.col("low_b"), num, den)
    open_pairs = checked.filter(~linked & reach).select("a", "b", "shared", "k_a", "k_b")
    joined = components(checked.filter(linked).select("a", "b"))
    side_of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    apart = ~F.coalesce("_a", "a").eqNullSafe(F.coalesce("_b", "b"))
    still = store(open_pairs.join(side_of("a"), "a", "left").join(side_of("b"), "b", "left").filter(apart).drop("_a", "_b"), "open")
    more = member_links(docs, still, clusters, n, num, den)
    star = clusters.filter("rep <> cluster").select(F.col("rep").alias("a"), F.col("cluster").alias("b"))
    links = star.unionAll(checked.filter(linked).select("a", "b")).unionAll(more.select("a", "b"))
    groups = components(links).select(F.col("node").alias("rep"), "component")
    named = classes.join(groups, "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    return rows.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
