"""Lines that recur across documents, found by a log-template tree.

A line goes down a tree of fixed depth: its token count, then its leading tokens, where tokens with digits count as one variable
field. Under a leaf, the other tokens form up to eight segments; a line joins the first template that agrees in enough of
them, and the segments that differ become variable. A leaf of many lines is dealt out by the components of its lines that
agree in enough segments: a line only ever joins a template of its component, so that changes no result. Templates that several texts hold are dropped everywhere but in the
text that comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.components import components
from trendloom.llm.textkit import Memo, batches, fresh, mix
from trendloom.sources.work import store, work_path

LEADING, SEGMENTS = 3, 8
#: A line joins a template if at least this many of its segments agree, in eighths of their number.
AGREE = 6
#: Lines of fewer segments are templates of their own.
LEAST_SEGMENTS = 4
#: A leaf with more lines than this is dealt out by components; lines to a partition.
NODE_LINES, PART_LINES = 2000, 200_000
#: The lists of lines to cut are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20
_DIGIT = re.compile(rb"[0-9]")
_FIELD = xxhash.xxh3_64_digest(b"<*>")
#: Hashes of single words; tasks hash all words of a batch at once, by ``masked``.
MASKED = Memo(lambda w: _FIELD if _DIGIT.search(w) else xxhash.xxh3_64_digest(w), "lines")


def split_lines(text: str) -> list[list[bytes]]:
    return [line.split() for line in text.encode().split(b"\n")]


def masked(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words without white space; all words with digits have that of the one variable field."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).byteswap()
    text = np.frombuffer(b" ".join(words), np.uint8)
    digits = np.flatnonzero(text - np.uint8(48) < 10)
    if len(digits):
        h[np.searchsorted(np.flatnonzero(text == 32), digits)] = np.frombuffer(_FIELD, np.uint64)[0]
    return h


def line_keys(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token counts, two-word fingerprints, leaves, and segment hashes of lines (none for lines without tokens)."""
    counts = np.array([len(x) for x in lines], np.int64)
    n = int(counts.sum())
    prints, leaf, segs = np.zeros((len(lines), 2), np.uint64), np.zeros(len(lines), np.uint64), np.zeros((len(lines), SEGMENTS), np.uint32)
    if not n:
        return counts, prints, leaf, segs
    h = masked(list(chain.from_iterable(lines)))
    row = np.repeat(np.arange(len(lines)), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    length = counts[row]
    placed = mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    starts = np.flatnonzero(place == 0)
    some = row[starts]
    salt = counts.astype(np.uint64)
    prints[some, 0] = np.add.reduceat(placed, starts)
    prints[some, 1] = np.add.reduceat(mix(placed ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    prints = mix(prints + salt[:, None])
    lead = np.where(place < LEADING, placed, 0).astype(np.uint64)
    leaf[some] = mix(np.add.reduceat(lead, starts) + salt[some])
    rest = length - LEADING
    spot = place - LEADING
    seg = np.where(rest > SEGMENTS, spot * SEGMENTS // np.maximum(rest, 1), spot)
    body = np.flatnonzero(spot >= 0)
    if len(body):
        edge = np.concatenate([[True], (row[body][1:] != row[body][:-1]) | (seg[body][1:] != seg[body][:-1])])
        at = np.flatnonzero(edge)
        segs[row[body][at], seg[body][at]] = (mix(np.add.reduceat(placed[body], at)) >> np.uint64(32)).astype(np.uint32)
    return counts, prints, leaf, segs


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of an array."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


LINES = "doc_id long, digest binary, line binary, leaf long, segs binary, n_segs int, spots binary"


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """A row per text and distinct line of at least ``least_words`` tokens, with its places among the lines of the text."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, owner="lines"):
            split = [split_lines(t) for t in batch.column("text").to_pylist()]
            owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
            counts, prints, leaf, segs = line_keys([x for s in split for x in s])
            keep = np.flatnonzero(counts >= least_words)
            order = keep[np.lexsort((prints[keep, 1], prints[keep, 0], owner[keep]))]
            fresh = (np.diff(owner[order]) != 0) | (np.diff(prints[order], axis=0) != 0).any(axis=1)
            starts = np.flatnonzero(np.concatenate([[True], fresh])[: len(order)])
            first = np.cumsum([0] + [len(s) for s in split])
            spots = (order - first[owner[order]]).astype("<u4")
            ends = pa.py_buffer((4 * np.append(starts, len(order))).astype(np.int32).tobytes())
            spots = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(spots.tobytes())])
            back = np.argsort(order[starts])  # as the lines stand in the texts
            keep, spots = order[starts][back], spots.take(pa.array(back))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner[keep])), batch.column("digest").take(pa.array(owner[keep])),
                 _binary(prints[keep]), pa.array(leaf[keep].view(np.int64)),
                 _binary(segs[keep]),
                 pa.array(np.clip(counts[keep] - LEADING, 0, SEGMENTS), pa.int32()), spots],
                ["doc_id", "digest", "line", "leaf", "segs", "n_segs", "spots"],
            )

    return docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "digest", "text").mapInArrow(
        run, LINES
    )


def needed(size: int) -> int:
    """Segments of ``size`` that must agree."""
    return -(-AGREE * size // SEGMENTS)


def subset_keys(segs: np.ndarray, size: int) -> np.ndarray:
    """A row per line of hashes, one for each set of just enough segments: lines agree in enough if they share one."""
    spots = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cells = mix(mix(segs[:, :size].astype(np.uint64) + np.uint64(1)) + spots)
    total = cells.sum(axis=1, dtype=np.uint64)
    left_out = list(combinations(range(size), size - needed(size)))
    keys = [total - cells[:, out].sum(axis=1, dtype=np.uint64) + np.uint64(k) for k, out in enumerate(map(list, left_out))]
    return mix(np.column_stack(keys))


class Templates:
    """Templates of a node in the order they were made, found by the segment sets of their first lines.

    A set of segments has one template at most that still has all of them fixed: another line with the same set would have
    joined it. So the last template made under a key is the only one to look at, and a line costs the same in any node.
    """

    def __init__(self):
        self.index, self.shapes, self.names = {}, [], []

    def join(self, segs: list[int], keys: list[int], name):
        """Name of the first template that agrees in enough segments; a new template has the line's name."""
        for t in sorted({t for t in map(self.index.get, keys) if t is not None}):
            shape = self.shapes[t]
            same = [a == b for a, b in zip(shape, segs)]
            if sum(same) >= needed(len(segs)):
                self.shapes[t] = [a if s else None for a, s in zip(shape, same)]
                return self.names[t]
        self.index.update(dict.fromkeys(keys, len(self.names)))
        self.shapes.append(segs)
        self.names.append(name)
        return name


def _listed(segs: np.ndarray, sizes: np.ndarray) -> tuple[list, list]:
    """Segments and subset keys of lines as lists; no keys for lines of too few segments."""
    keys = [[] for _ in sizes]
    for size in np.unique(sizes[sizes >= LEAST_SEGMENTS]):
        rows = np.flatnonzero(sizes == size)
        for k, found in zip(rows, subset_keys(segs[rows], int(size)).tolist()):
            keys[k] = found
    return [x[:n] for x, n in zip(segs.tolist(), sizes)], keys


def join_templates(segs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Template (index of its first line) of each line of a leaf, in order: the first template agreeing in enough segments."""
    node = Templates()
    return np.array([node.join(x, keys, k) for k, (x, keys) in enumerate(zip(*_listed(segs, sizes)))], np.int64)


def _segments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    segs = np.frombuffer(b"".join(batch.column("segs").to_pylist()), np.uint32).reshape(-1, SEGMENTS)
    return segs, batch.column("n_segs").to_numpy()


def _dealt(full: DataFrame) -> DataFrame:
    """Lines of full leaves with the component of lines that agree in enough segments as ``node``; lines alone are left out."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, owner="lines"):
            segs, sizes = _segments(batch)
            leaf, ids = batch.column("leaf").to_numpy().view(np.uint64), batch.column("id").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                keys = mix(subset_keys(segs[rows], int(size)) + leaf[rows, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[rows], keys.shape[1]))], ["key", "id"]
                )

    named = full.withColumn("id", F.xxhash64("line"))
    keys = named.select("leaf", "id", "segs", "n_segs").mapInArrow(run, "key long, id long")
    leads = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    links = keys.join(leads, "key").filter("id <> lead").select("id", "lead").distinct()
    groups = components(links, "id", "lead").select(F.col("node").alias("id"), F.col("component").alias("node"))
    return named.join(groups, "id").select("node", "line", "segs", "n_segs", "texts")


def templates(lines: DataFrame, node_lines: int) -> DataFrame:
    """``line`` and ``template`` (its first line) of the lines that join another line's template."""
    able = lines.filter(F.col("n_segs") >= LEAST_SEGMENTS)
    leaves = store(able.groupBy("leaf").count().filter("count > 1"), "leaves")
    full = F.col("count") > node_lines
    nodes = able.join(leaves.filter(~full), "leaf").select(F.col("leaf").alias("node"), "line", "segs", "n_segs", "texts")
    few, many = leaves.agg(F.sum(F.when(~full, F.col("count"))), F.sum(F.when(full, F.col("count")))).first()
    if many:
        nodes = nodes.unionByName(_dealt(able.join(leaves.filter(full), "leaf").drop("count")))
    parts = max(1, -(-((few or 0) + (many or 0)) // PART_LINES))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes come one after the other, each in its order; of a node only its templates are held."""
        last, made = None, None
        for batch in batches(found, owner="lines"):
            mine, theirs = [], []
            names = batch.column("line").to_pylist()
            for node, name, segs, keys in zip(batch.column("node").to_pylist(), names, *_listed(*_segments(batch))):
                if made is None or node != last:
                    last, made = node, Templates()
                first = made.join(segs, keys, name)
                if first != name:
                    mine.append(name)
                    theirs.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.binary()), pa.array(theirs, pa.binary())], ["line", "template"])

    order = ["node", F.desc("texts"), "line"]
    spread = nodes.repartition(parts, "node").sortWithinPartitions(*order).select("node", "line", "segs", "n_segs")
    return spread.mapInArrow(run, "line binary, template binary")


def drop_recurring(
    docs: DataFrame, least_texts: int = 2, least_words: int = 4, node_lines: int = NODE_LINES,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """All columns of ``docs``, with recurring lines cut from ``text``, and the ``counts`` of lines and of lines dropped.

    A column of ``docs`` that has the name of a count gives way to it; no other name is taken.

    A template recurs when ``least_texts`` different texts hold it; lines of fewer than ``least_words`` tokens never do. The
    text with the smallest doc_id keeps its lines, and so do its exact copies, which count as one text: copies are for the
    document stages. A null doc_id comes last; among texts without ids the smallest digest is first. Null text stays
    null with no lines; repeated rows give repeated rows; an empty table gives no rows. ``n_chars``, where it is a
    column, follows the text.
    """
    spark = docs.sparkSession
    known_as, gone_as = fresh("_digest", docs.columns), fresh("_cut", docs.columns)
    marked = docs.withColumn(known_as, F.unhex(F.md5("text")))
    path = work_path(spark, "lines")
    _lines(docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest")), least_words).write.parquet(path)
    rows = spark.read.schema(LINES).parquet(path)
    last = F.lit((1 << 63) - 1)
    held = store(
        rows.groupBy("line", "leaf", "segs", "n_segs", "digest", "spots").agg(F.min(F.coalesce("doc_id", last)).alias("first")), "text-lines"
    )
    lines = store(held.groupBy("line", "leaf", "segs", "n_segs").agg(F.count(F.lit(1)).alias("texts")), "line-texts")
    merged = store(templates(lines, node_lines), "templates")
    known = held.select("line", "digest", "first", "spots").join(merged, "line", "left").withColumn("template", F.coalesce("template", "line"))
    known = store(known, "template-lines")
    counted = (
        known.groupBy("template", "digest").agg(F.min("first").alias("first"))
        .groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("first", "digest")).alias("keeper"))
        .filter(F.col("texts") >= least_texts)
        .select("template", F.col("keeper.digest").alias("keeper"))
    )
    cut = (
        known.join(counted, "template").filter("digest <> keeper")
        .groupBy(F.col("digest").alias(known_as)).agg(F.collect_list("spots").alias(gone_as), F.sum(F.length("spots")).alias("bytes"))
    )
    cut = store(cut, "cut-lines")
    size = cut.agg(F.sum(F.lit(32) + 16 * F.size(gone_as) + F.col("bytes"))).first()[0] or 0
    cut = cut.select(known_as, gone_as)
    cut = F.broadcast(cut) if size <= BROADCAST_BYTES else cut  # beyond, texts are shuffled to their lines
    fields = [f for f in docs.schema.fields]
    extra = [T.StructField(c, T.LongType()) for c in counts]
    fields = [f for f in fields if f.name.lower() not in counts]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + extra)

    def apply(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, owner="lines"):
            texts, sizes, dropped = [], [], []
            cuts = batch.column(gone_as).to_pylist()
            for text, gone in zip(batch.column("text").to_pylist(), cuts):
                parts = text.split("\n") if text is not None else []
                filled = sum(1 for p in parts if p.strip())
                n = 0
                if gone:
                    spots = set(np.frombuffer(b"".join(gone), "<u4").tolist())
                    n = len(spots)
                    text = "\n".join([p for k, p in enumerate(parts) if k not in spots])
                texts.append(text)
                sizes.append(filled)
                dropped.append(n)
            columns = []
            for f in fields:
                if f.name == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif f.name == "n_chars":
                    lengths = [len(t) if t is not None and d else old
                               for t, d, old in zip(texts, dropped, batch.column("n_chars").to_pylist())]
                    columns.append(pa.array(lengths, batch.schema.field("n_chars").type))
                else:
                    columns.append(batch.column(f.name))
            columns += [pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields] + list(counts))

    return marked.join(cut, known_as, "left").select(*[f.name for f in fields], gone_as).mapInArrow(apply, schema)
