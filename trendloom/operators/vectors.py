"""Dense-vector neighbours and clusters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import arrays, hashing
from trendloom.operators import sampling
from trendloom.sources.work import store


def centroids(df: DataFrame, vec: str, by: str, dim: int) -> DataFrame:
    """Mean vector per group, one average per place."""
    per = df.groupBy(by).agg(*arrays.element_means(vec, dim))
    return per.select(by, arrays.gather(vec, dim).alias("centre"))


def nearest(df: DataFrame, key: str, vec: str, centres: Sequence[tuple[object, Sequence[float]]], k: int) -> DataFrame:
    """The k nearest rows to each centre with their rank; rank 1 represents the centre.

    The centres are a parameter, as a model's are. A row's distances to them are one array, and only numbers are multiplied by
    the centres; each task keeps its own k best per centre before the shuffle.
    """
    far = F.array(
        *[F.struct(F.lit(c).alias("centre"), arrays.euclidean(vec, F.array(*[F.lit(float(x)) for x in v])).alias("distance"))
          for c, v in centres]
    )
    measured = df.select(key, F.explode(far).alias("c")).select("c.centre", key, "c.distance")
    w = Window.partitionBy("centre").orderBy("distance", key)
    return measured.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def as_constants(centres: DataFrame) -> list[tuple[object, list[float]]]:
    """The centres of a model, (id, vector) each, as plain values."""
    return [(r[0], list(r[1])) for r in centres.orderBy(centres.columns[0]).collect()]


def _prepared(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))


def fit_kmeans(df: DataFrame, vec: str, k: int, seed: int = 91) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(_prepared(df, vec))


def assign(model: KMeansModel, df: DataFrame, vec: str) -> DataFrame:
    return model.transform(_prepared(df, vec)).drop("_features")


def elbow(df: DataFrame, vec: str, ks: Sequence[int], seed: int = 91) -> DataFrame:
    """Within-cluster cost for each number of clusters."""
    ready = _prepared(df, vec).select("_features").persist()
    costs = []
    for k in ks:
        if k == 1:
            # One cluster: the cost is the spread around the mean, which needs no search.
            dim = len(ready.first()["_features"])
            flat = ready.select(vector_to_array("_features").alias("v"))
            stats = flat.agg(*[(F.var_pop(F.col("v")[j]) * F.count(F.lit(1))).alias(f"s{j}") for j in range(dim)]).first()
            costs.append((1, float(sum(stats))))
            continue
        model = KMeans(k=k, seed=seed, featuresCol="_features").fit(ready)
        costs.append((k, float(model.summary.trainingCost)))
    ready.unpersist()
    return df.sparkSession.createDataFrame(costs, "k long, cost double")


Centres = Mapping[int, np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, as sums of squares of differences, some rows at a time."""
    out = np.empty((len(rows), len(centres)))
    for at in range(0, len(rows), 256):
        gap = rows[at : at + 256, None, :] - centres[None, :, :]
        out[at : at + 256] = (gap * gap).sum(axis=2)
    return out


def start_centres(df: DataFrame, key: str, vec: str, ks: Sequence[int], seed: int = 91) -> Centres:
    """For each k the first k rows in the hash order of a unique whole-number key; fewer where there are fewer rows."""
    first = sampling.exact(df.select(key, vec), key, max(ks), seed).withColumn("_h", hashing.draw(key, seed))
    rows = np.array([r[0] for r in first.orderBy("_h", key).select(vec).collect()], np.float64)
    return {k: rows[:k] for k in ks}


def lloyd(df: DataFrame, key: str, vec: str, ks: Sequence[int], rounds: int = 10, seed: int = 91) -> Centres:
    """Centres after ``rounds`` rounds of Lloyd's algorithm, for all numbers of clusters in the same passes.

    Every pass sums rows per (k, nearest centre) inside tasks and then in Spark; the driver sees one vector per centre, a number that the
    parameters set. A row belongs to the first of equally near centres, and a centre without rows stays where it is. Null
    vectors are left out.
    """
    rows = df.filter(F.col(vec).isNotNull()).select(key, vec)
    centres = dict(start_centres(rows, key, vec, ks, seed))
    dim = next(iter(centres.values())).shape[-1]
    for _ in range(rounds):
        sums = _summed(rows, vec, centres, dim)
        moved = {k: c.copy() for k, c in centres.items()}
        for r in sums:
            moved[r["k"]][r["cluster"]] = np.array(r["total"]) / r["n"]
        if all((moved[k] == centres[k]).all() for k in ks):
            break
        centres = moved
    return centres


def _summed(rows: DataFrame, vec: str, centres: Centres, dim: int) -> list:
    shared = rows.sparkSession.sparkContext.broadcast(dict(centres))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        totals = {k: np.zeros((len(c), dim + 1)) for k, c in known.items()}
        for batch in found:
            here = _matrix(batch.column(0))
            if len(here):
                wide = np.column_stack([here, np.ones(len(here))])
                for k, c in known.items():
                    np.add.at(totals[k], _squares(here, c).argmin(axis=1), wide)
        out = [(k, j, t[j, :dim].tolist(), int(t[j, dim])) for k, t in totals.items() for j in range(len(t)) if t[j, dim]]
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "cluster", "total", "n"])

    parts = rows.select(vec).mapInArrow(run, "k long, cluster long, total array<double>, n long")
    per = parts.groupBy("k", "cluster").agg(F.sum("n").alias("n"), *arrays.element_sums("total", dim))
    return per.select("k", "cluster", "n", arrays.gather("total", dim).alias("total")).collect()


def assign_nearest(df: DataFrame, key: str, vec: str, centres: Centres) -> DataFrame:
    """``k``, key, ``cluster`` and squared ``distance`` of every row for every set of centres; null vectors are left out."""
    shared = df.sparkSession.sparkContext.broadcast(dict(centres))
    kind = dict(df.dtypes)[key]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = _matrix(batch.column(1))
            for k, c in shared.value.items():
                far = _squares(rows, c) if len(rows) else np.zeros((0, len(c)))
                best = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), k, np.int64)), batch.column(0), pa.array(best.astype(np.int64)),
                     pa.array(far[np.arange(len(best)), best])],
                    ["k", key, "cluster", "distance"],
                )

    return df.filter(F.col(vec).isNotNull()).select(key, vec).mapInArrow(run, f"k long, {key} {kind}, cluster long, distance double")


def costs(assigned: DataFrame) -> DataFrame:
    """Within-cluster cost for each number of clusters."""
    return assigned.groupBy("k").agg(F.sum("distance").alias("cost"))


def _unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix, without a Python object per number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return np.zeros((0, 0))
    if not (np.diff(column.offsets.to_numpy()) == len(flat) // len(column)).all():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def _reaches(far: np.ndarray, cells: np.ndarray, k: int) -> np.ndarray:
    """Cells (pivot, ring, n, low, high) that may hold one of the k nearest rows, from a centre's distances to the pivots.

    A row of a cell lies at least |distance - radius| and at most distance + radius from the centre.
    """
    d, low, high = far[cells["pivot"]], cells["low"], cells["high"]
    least, most = np.maximum(np.maximum(d - high, low - d), 0), d + high
    order = np.argsort(most, kind="stable")
    enough = np.searchsorted(np.cumsum(cells["n"][order]), k)
    bound = most[order[min(enough, len(order) - 1)]]
    return np.flatnonzero(least <= bound * (1 + 1e-9) + 1e-12)


_CELL = np.dtype([("pivot", "i8"), ("ring", "i8"), ("n", "i8"), ("low", "f8"), ("high", "f8")])


def _groups(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of every cell: small cells that follow each other share one, large cells have several."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    group, filled = 0, 0
    for c, n in enumerate(sizes):
        if filled and filled + n > most:
            group, filled = group + 1, 0
        first[c] = group
        filled += n
        if parts[c] > 1:
            group, filled = group + int(parts[c]), 0
    return first, parts


def _nearest_in(points: np.ndarray, keys: np.ndarray, asked: np.ndarray, k: int, tile: int = 4096, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``asked``, keys and distances of the k nearest points, exact, ties by key, ``rows`` of ``asked`` at a time.

    Products of matrices leave out what lies farther than the k-th nearest so far by more than their rounding error; the distances of
    the rest are measured as sums of squares of differences. Of equal points only those with the k smallest keys can be asked for.
    """
    alike = np.ascontiguousarray(points + 0.0).view(np.dtype((np.void, 8 * points.shape[1]))).reshape(-1)
    order = np.lexsort((keys, np.unique(alike, return_inverse=True)[1].reshape(-1)))
    points, keys = points[order], keys[order]
    new = np.concatenate([[True], (points[1:] != points[:-1]).any(axis=1)])
    starts = np.flatnonzero(new)
    few = np.arange(len(keys)) - np.repeat(starts, np.diff(starts, append=len(keys))) < k
    points, keys = points[few], keys[few]
    with np.errstate(all="ignore"):  # what is not finite is measured
        norms = (points * points).sum(axis=1)
        wide, sizes = np.column_stack([points, norms]), np.sqrt(norms)
    slack = (8 * points.shape[1] + 64) * np.finfo(np.float64).eps
    for at in range(0, len(asked), rows):
        here = asked[at : at + rows]
        with np.errstate(all="ignore"):
            mine = (here * here).sum(axis=1)
            left = np.column_stack([-2 * here, np.ones(len(here))])
        row, key, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(len(here), np.inf)  # of the squared distance
        for t in range(0, len(keys), tile):
            with np.errstate(all="ignore"):
                about = left @ wide[t : t + tile].T  # the squared distance without the centre's square
                error = slack * (np.sqrt(mine) + sizes[t : t + tile].max()) ** 2
                if not t and about.shape[1] >= k:
                    limit = np.partition(about, k - 1, axis=1)[:, k - 1] + mine + error
                out = about > (limit - mine + error)[:, None]
            found = np.flatnonzero(~out)
            r, c = np.divmod(found, about.shape[1])
            gaps = np.empty(len(found))
            for s in range(0, len(found), 1 << 15):
                gap = points[t + c[s : s + (1 << 15)]] - here[r[s : s + (1 << 15)]]
                with np.errstate(over="ignore"):
                    gaps[s : s + (1 << 15)] = (gap * gap).sum(axis=1)
            row, key, far = np.concatenate([row, r]), np.concatenate([key, keys[t + c]]), np.concatenate([far, np.sqrt(gaps)])
            best = np.lexsort((key, far, row))
            row, key, far = row[best], key[best], far[best]
            begin = np.searchsorted(row, np.arange(len(here) + 1))
            place = np.arange(len(row)) - begin[row]
            kth = np.flatnonzero(place == k - 1)
            limit[row[kth]] = far[kth] ** 2
            row, key, far = row[place < k], key[place < k], far[place < k]
        yield row + at, key, far


def nearest_many(
    df: DataFrame, key: str, vec: str, centres: DataFrame, centre: str, centre_vec: str, k: int,
    pivots: int = 64, block: int = 2048, chunk: int | None = None, seed: int = 91,
) -> DataFrame:
    """The k nearest rows to every row of a table of centres: ``centre``, key, ``distance``, ``rank``; exact, ties by key.

    Rows lie in cells: the nearest of a few pivots, and a ring of radii around it. The triangle inequality bounds the distances
    from a centre to all rows of a cell, so a centre meets only the cells that may hold one of its k nearest, and distances are
    computed there alone. Cells that follow each other form groups of an eighth of the rows, at least ``block`` and at most 16 times as many;
    larger cells (copies have one radius) are dealt over several. A centre moves once to each group that it reaches, and a group once to each
    ``chunk`` of centres (by default as many as a group's rows), so a task holds two bounded tables. Where no cell can be left out the work
    grows with rows times centres. What the driver sees is pivots and cells, numbers that the parameters bound. Null vectors
    are left out on both sides; ``key`` and ``centre`` are unique whole numbers.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    asked = centres.filter(F.col(centre_vec).isNotNull()).select(
        F.col(centre).cast("long").alias("centre"), F.col(centre_vec).cast("array<double>").alias("vec")
    )
    picked = np.array([r["vec"] for r in sampling.exact(rows, "key", pivots, seed).select("vec").collect()], np.float64)
    if not len(picked):
        return asked.limit(0).select("centre", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank"))
    shared = spark.sparkContext.broadcast(picked)

    def place(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                far = _squares(_unpack(batch.column(1)), shared.value)
                best = far.argmin(axis=1)
                radius = np.sqrt(far[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int64)), pa.array(radius)], ["key", "vec", "pivot", "radius"])

    placed = store(rows.mapInArrow(place, "key long, vec array<double>, pivot long, radius double"), "placed")
    total, largest = placed.groupBy("pivot").count().agg(F.sum("count"), F.max("count")).first()
    rings = min(1000, -(-(largest or 1) // block))
    ringed = placed.withColumn("ring", F.lit(0).cast("long"))
    if rings > 1:
        steps = [i / rings for i in range(1, rings)]
        edges = placed.groupBy("pivot").agg(F.percentile_approx("radius", steps, 10_000).alias("edges"))  # one row per pivot
        ring = F.size(F.filter("edges", lambda e: e < F.col("radius"))).cast("long")
        ringed = placed.join(F.broadcast(edges), "pivot").withColumn("ring", ring).drop("edges")
    ringed = store(ringed, "ringed")
    stats = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    cells = np.array([tuple(r) for r in stats.orderBy("pivot", "ring").collect()], _CELL)
    most = min(max(block, -(-(total or 1) // 8)), 16 * block)
    first, parts = _groups(cells["n"], most)
    known = spark.sparkContext.broadcast((picked, cells, first, parts))
    chunks = max(1, -(-asked.count() // (chunk or most)))

    def reach(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, cells, first, parts = known.value
        for whole in found:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                far, groups = np.sqrt(_squares(_unpack(batch.column(1)), points)), []
                for d in far:
                    met = _reaches(d, cells, k)
                    one = met[parts[met] == 1]
                    several = [np.arange(first[c], first[c] + parts[c]) for c in met[parts[met] > 1]]
                    groups.append(np.unique(np.concatenate([first[one], *several])))
                owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
                flat = np.concatenate(groups).astype(np.int64)
                for s in range(0, len(flat), 4096):
                    some = batch.take(pa.array(owner[s : s + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(flat[s : s + 4096]), *some.columns], ["group", "centre", "vec"])

    spot = ["group", "chunk"]
    wanted = asked.mapInArrow(reach, "group long, centre long, vec array<double>")
    wanted = wanted.withColumn("chunk", F.pmod(F.xxhash64("centre"), F.lit(chunks)))
    counts = spark.createDataFrame(
        [(int(c["pivot"]), int(c["ring"]), int(g), int(p)) for c, g, p in zip(cells, first, parts)], "pivot long, ring long, first long, parts long"
    )
    dealt = ringed.join(F.broadcast(counts), ["pivot", "ring"]).select(
        (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).alias("group"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "key", "vec",
    )

    def measure(spot: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["centre", "key", "distance"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        ids, keys = left.column("centre").to_numpy(), right.column("key").to_numpy()
        found = [(ids[row], near, far) for row, near, far in _nearest_in(_unpack(right.column("vec")), keys, _unpack(left.column("vec")), k)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names)

    found = wanted.groupBy(*spot).cogroup(dealt.groupBy(*spot)).applyInArrow(measure, "centre long, key long, distance double")
    w = Window.partitionBy("centre").orderBy("distance", "key")  # at most k rows of each group met
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def project(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Principal-component scores as an array column ``projected``; a component's largest weight is positive."""
    ready = _prepared(df, vec)
    model = PCA(k=dim, inputCol="_features", outputCol="_projected").fit(ready)
    weights = model.pc.toArray()
    signs = np.sign(weights[np.abs(weights).argmax(axis=0), np.arange(dim)])
    out = model.transform(ready)
    signed = F.zip_with(vector_to_array("_projected"), F.array(*[F.lit(float(s)) for s in signs]), lambda x, s: x * s)
    return out.withColumn("projected", signed).drop("_features", "_projected")
