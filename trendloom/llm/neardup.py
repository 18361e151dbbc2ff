"""Near duplicates of embeddings inside a label, by tiled comparison in the order of principal components.

Unit vectors are rotated so that the first coordinates carry most of their length. A pair above the threshold differs by at most
r = sqrt(2 - 2 t) in length, hence by at most r over the leading coordinates: vectors are laid into grid cells of that width
and meet only the cells within reach. Inside a tile, products are accumulated over growing leading blocks of coordinates;
the rest is bounded by the product of suffix norms, and a pair is dropped as soon as the bound falls below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.components import components
from trendloom.llm.textkit import batches
from trendloom.sources.work import store

#: The rotation is fitted on at most this many vectors in hash order; any rotation gives right results.
SAMPLE_ROWS = 4096
#: Vectors of a cell beyond this number are cut into blocks whose pairs are compared in separate tiles.
BLOCK = 1024
SLACK = 1e-9
STRIP = 256


def usable(docs: DataFrame, dims: str = "embedding") -> DataFrame:
    """Distinct (vec_id, label) with the vector as doubles, its length and a digest; vectors that link with nothing are left out."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, 4096):
            ids, labels, raw, sizes, digests = [], [], [], [], []
            for i, label, v in zip(*[batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")]):
                if i is None or label is None or not v or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and 0 < x @ x < np.inf:
                    ids.append(i)
                    labels.append(label)
                    raw.append(x.tobytes())
                    sizes.append(len(x))
                    digests.append(xxhash.xxh3_128_digest(raw[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, batch.schema.field("label").type), pa.array(sizes, pa.int32()),
                 pa.array(raw, pa.binary()), pa.array(digests, pa.binary())],
                ["vec_id", "label", "dim", "raw", "digest"],
            )

    kind = dict(docs.dtypes)["label"]
    base = docs.select(F.col("vec_id").cast("long"), "label", F.col(dims).alias("embedding"))
    return base.mapInArrow(run, f"vec_id long, label {kind}, dim int, raw binary, digest binary")


def rotation(vectors: DataFrame) -> np.ndarray:
    """Orthogonal matrix of the most common dimension, by falling second moment of the sampled unit vectors."""
    top = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return np.eye(1)
    rows = vectors.filter(F.col("dim") == top["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("raw").collect()
    x = np.stack([np.frombuffer(r["raw"], np.float64) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, basis = np.linalg.eigh(x.T @ x)
    return basis[:, ::-1]


def rotate(raw: np.ndarray, basis: np.ndarray) -> np.ndarray:
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return unit @ basis if raw.shape[1] == len(basis) else unit


def reach_cells(lead: np.ndarray, width: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, cells and whether it is the row's own cell, for the own cell and every later one within reach.

    "Later" is the order of cells by their coordinates, so of two cells within reach one is sent to the other, never both ways.
    """
    own = np.floor(lead / width).astype(np.int64)
    rows, cells = np.arange(len(lead)), np.zeros((len(lead), 0), np.int64)
    spent, ahead = np.zeros(len(lead)), np.zeros(len(lead), np.int64)
    for k in range(lead.shape[1]):
        inside = lead[rows, k] / width - own[rows, k]
        grown = []
        for step in (-1, 0, 1):
            cost = spent + (0 if not step else (inside if step < 0 else 1 - inside) * width) ** 2
            sign = np.where(ahead == 0, step, ahead)
            ok = (cost <= reach * reach + SLACK) & (sign >= 0)
            grown.append((rows[ok], np.column_stack([cells[ok], own[rows[ok], k] + step]), cost[ok], sign[ok]))
        rows, cells, spent, ahead = (np.concatenate([g[x] for g in grown]) for x in range(4))
    return rows, cells, ahead == 0


def place(vectors: DataFrame, basis: np.ndarray, lead: int, least: float) -> DataFrame:
    """A row per vector and cell it must meet: ``spot`` names label, dimension and cell, ``home`` marks the own cell."""
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    width = max(reach, 1e-3) * (1 + 1e-9)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, 2048):
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                raw = np.stack([np.frombuffer(r, np.float64) for r in part.column("raw").to_pylist()])
                rows, cells, home = reach_cells(rotate(raw, basis)[:, : min(lead, dim)], width, reach)
                labels = part.column("label").to_pylist()
                prefix = [f"{labels[r]}|{dim}|".encode() for r in range(part.num_rows)]
                spots = [xxhash.xxh3_64_intdigest(prefix[r] + c.tobytes()) >> 1 for r, c in zip(rows, cells)]
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spots, pa.int64()), pa.array(home), taken.column("vec_id"), taken.column("label"),
                     taken.column("dim"), taken.column("copies"), taken.column("raw")],
                    ["spot", "home", "vec_id", "label", "dim", "copies", "raw"],
                )

    kind = dict(vectors.dtypes)["label"]
    return vectors.select("vec_id", "label", "dim", "copies", "raw").mapInArrow(
        run, f"spot long, home boolean, vec_id long, label {kind}, dim int, copies long, raw binary"
    )


def tiles(placed: DataFrame, block: int) -> DataFrame:
    """Add ``tile`` and ``side``: own vectors of a cell in blocks, each block with itself, with later blocks, and with visitors.

    Side 0 is compared with side 1, and in a block's own tile (``self``) with itself.
    """
    counts = placed.groupBy("spot").agg(
        F.sum(F.col("home").cast("long")).alias("own"), F.sum((~F.col("home")).cast("long")).alias("guests")
    )
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    met = placed.join(counts.filter("own > 0").withColumns({"nb": blocks("own"), "ng": blocks("guests")}), "spot")
    mine = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.when(F.col("home"), F.col("nb")).otherwise(F.col("ng"))).cast("int")
    met = met.withColumn("blk", mine)
    as_own = F.concat(
        F.transform(
            F.sequence(F.lit(0), F.col("nb") - 1),
            lambda j: F.struct(F.least("blk", j).alias("i"), F.greatest("blk", j).alias("j"), F.lit(0).alias("k"),
                               F.when(j < F.col("blk"), 1).otherwise(0).alias("side")),
        ),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("ng") - 1), lambda j: j > 0),
            lambda j: F.struct(F.col("blk").alias("i"), F.col("blk").alias("j"), j.alias("k"), F.lit(0).alias("side")),
        ),
    )
    as_guest = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda i: F.struct(i.alias("i"), i.alias("j"), F.col("blk").alias("k"), F.lit(1).alias("side")),
    )
    return met.select("spot", "vec_id", "label", "dim", "copies", "raw", F.explode(F.when(F.col("home"), as_own).otherwise(as_guest)).alias("t")).select(
        "spot", "vec_id", "label", "dim", "copies", "raw", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.k").alias("k"),
        F.col("t.side").alias("side"),
    )


def near_pairs(x: np.ndarray, y: np.ndarray, basis: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y with cosine >= least."""
    rx, ry = rotate(x, basis), rotate(y, basis)
    dim = x.shape[1]
    cuts = [c for c in (4, 8, 16, 32, 64, 128, 256, 512) if c < dim]
    tail = lambda r: np.sqrt(np.maximum(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], 0))
    tx, ty = tail(rx), tail(ry)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    out_i, out_j = [], []
    for at in range(0, len(x), STRIP):
        a, ta = rx[at : at + STRIP], tx[at : at + STRIP]
        first = cuts[0] if cuts else dim
        sums = a[:, :first] @ ry[:, :first].T
        if cuts:
            i, j = np.nonzero(sums + np.outer(ta[:, first], ty[:, first]) >= least - SLACK)
        else:
            i, j = np.nonzero(sums >= least - SLACK)
        sums = sums[i, j]
        for low, high in zip(cuts, [*cuts[1:], dim]):
            if not len(i):
                break
            sums = sums + np.einsum("pk,pk->p", a[i, low:high], ry[j, low:high])
            rest = ta[i, high] * ty[j, high] if high < dim else 0.0
            ok = sums + rest >= least - SLACK
            i, j, sums = i[ok], j[ok], sums[ok]
        i = i + at
        exact = np.einsum("pk,pk->p", x[i], y[j]) / (nx[i] * ny[j])
        out_i.append(i[exact >= least])
        out_j.append(j[exact >= least])
    return np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(tiled: DataFrame, basis: np.ndarray, least: float) -> DataFrame:
    """Per tile, each vector's number of linked vectors and a forest of its links, never the pairs themselves."""

    def run(key: tuple[pa.Scalar, ...], found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sides, copies, raw, labels = [], [], [], [], []
        for batch in found:
            ids.append(batch.column("vec_id").to_numpy())
            sides.append(batch.column("side").to_numpy())
            copies.append(batch.column("copies").to_numpy())
            labels += [(a, b) for a, b in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())]
            raw += batch.column("raw").to_pylist()
        ids, sides, copies = np.concatenate(ids), np.concatenate(sides), np.concatenate(copies)
        own_tile = key[1].as_py() == key[2].as_py() and key[3].as_py() == 0
        links, node_a, node_b = np.zeros(len(ids), np.int64), [], []
        kinds: dict = {}
        for k, label in enumerate(labels):  # one, unless two spots share a hash
            kinds.setdefault(label, []).append(k)
        for rows in kinds.values():
            rows = np.array(rows)
            x = np.stack([np.frombuffer(raw[r], np.float64) for r in rows])
            zero, one = rows[sides[rows] == 0], rows[sides[rows] == 1]
            vx, vy = x[sides[rows] == 0], x[sides[rows] == 1]
            for mine, theirs, u, v in ((zero, one, vx, vy), (zero, zero, vx, vx)):
                if not len(mine) or not len(theirs) or (theirs is zero and not own_tile):
                    continue
                i, j = near_pairs(u, v, basis, least)
                if theirs is zero:
                    i, j = i[i < j], j[i < j]
                a, b = mine[i], theirs[j]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                node_a.append(a)
                node_b.append(b)
        if not node_a or not sum(map(len, node_a)):
            return
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = forest(len(ids), rank[np.concatenate(node_a)], rank[np.concatenate(node_b)])
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(links[some]), pa.array(ids[order[root[rank[some]]]])], ["vec_id", "links", "root"]
        )

    return tiled.groupBy("spot", "i", "j", "k").applyInArrow(run, "vec_id long, links long, root long")


def near_duplicates(table: DataFrame, least: float = 0.98, lead: int | None = None, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not null and their cosine, in doubles, reaches ``least``. Vectors that are
    null, empty, zero or hold null or non-finite numbers, and rows with a null id, link with nothing; vectors of different
    length never link. Equal vectors are compared once. Rows that repeat an id with the same vector are one vector and
    each come out; other columns are ignored; an empty table gives no rows.
    """
    vectors = store(usable(table).dropDuplicates(["vec_id", "label", "digest"]), "vectors")
    groups = store(
        vectors.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes"
    )
    if lead is None:
        # Cells grow with the largest label, so that a cell holds about a block of evenly spread vectors.
        most = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        lead = min(8, max(2, math.ceil(math.log(max(most / 256, 1), 3))))
    one_each = vectors.join(
        groups.select(F.col("rep").alias("vec_id"), "label", "digest", "copies"), ["vec_id", "label", "digest"]
    )
    basis = rotation(vectors)
    found = store(compare(tiles(store(place(one_each, basis, lead, least), "cells"), block), basis, least), "near-vectors")
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    groups_of = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    per_class = (
        groups.join(sums.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .join(groups_of.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    per_vector = vectors.select("vec_id", "label", "digest").join(per_class, ["label", "digest"]).select(
        F.col("vec_id").alias("_id"), F.col("n_links").alias("_links"), F.col("component_id").alias("_component")
    )
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"))
    component = F.coalesce("_component", "vec_id")
    return rows.join(per_vector, F.col("vec_id") == F.col("_id"), "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
