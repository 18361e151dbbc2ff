"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

1. Every document becomes a vector over the terms of the searched items; counts of all terms give lengths and weights.
2. Runs of documents form shards of bounded size. A shard orders its documents by a tree of similarity (bisections along the line
   between two far documents), so each term's list, kept in this order, falls into blocks of similar documents: the nodes of
   the tree at the level where a node holds about as many documents of the list as a block should. A block's summary is
   the largest value of each coordinate over its documents, rounded up to eight bits.
3. A block's score bound for an item is the item's weights times the summary, over the terms from the block's own on: a document
   belongs to the list of its rarest term. The bound is never below the score of a document of the block, so a block is left out
   only if its bound falls short of a score that enough documents are known to reach. A first pass scores each item's most
   promising block of every shard, which gives that score; the second pass scores all blocks left.

Scores are whole numbers, so results are exact and do not depend on shards, blocks or the order of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.textkit import batches
from trendloom.operators.ordering import running_totals
from trendloom.sources.work import store

#: Lower case for A-Z, a blank for every ASCII character that is neither a letter nor a digit.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes of item texts that are searched for in one run; more items make more runs.
GROUP_BYTES = 128 << 10
#: Bounds of a shard: documents, postings, and cells of the matrix that summaries are taken from.
SHARD_DOCS, SHARD_POSTINGS, SHARD_CELLS = 8192, 1 << 19, 1 << 24
#: Documents of a list that a block should hold at least, and blocks that a long list is cut into.
BLOCK_DOCS, LIST_BLOCKS = 32, 16
#: A summary counts in steps of this size, rounded up; values lie below 10**6, so eight bits hold it.
STEP = 4096
SKETCH = 64
NO_ID = np.iinfo(np.int64).max  # stands for a null document id, behind all others

FORWARD = "doc_id long, n long, terms binary, times binary"
FOUND = "item int, doc_id long, score long"
# Arrays of a stored shard and their types.
PARTS = {
    "ids": "<i8", "starts": "<i8", "terms": "<u4", "values": "<i4", "lists": "<i8", "listed": "<u4",
    "blocks": "<i8", "edges": "<i8", "summary": "|u1",
}


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased; null has none."""
    return text.encode().translate(TERM_BYTES).split() if text else []


@dataclass
class Items:
    """A bounded group of items: ids, distinct terms of each as numbers from 1, and the numbers of all terms."""

    ids: list
    terms: list[np.ndarray]
    numbers: dict[bytes, int]


def read_items(rows: Sequence) -> Items:
    numbers: dict[bytes, int] = {}
    ids, terms = [], []
    for item_id, text in rows:
        found = sorted({numbers.setdefault(w, len(numbers) + 1) for w in terms_of(text)})
        if found:
            ids.append(item_id)
            terms.append(np.array(found, np.int64))
    return Items(ids, terms, numbers)


def item_groups(items: DataFrame, most: int = GROUP_BYTES) -> Iterator[Items]:
    """Items in groups of at most ``most`` bytes of text; a longer item is a group of its own."""
    base = items.select("item_id", "text", F.octet_length("text").cast("long").alias("size")).filter("size > 0")
    total = base.agg(F.sum("size")).first()[0] or 0
    if total <= most:
        yield read_items([tuple(r) for r in base.select("item_id", "text").collect()])
        return
    placed = running_totals(base, ["item_id", F.xxhash64("text")], {"upto": "size"})
    dealt = store(placed.withColumn("part", F.expr(f"(upto - 1) div {most}")), "item-groups")
    for number in range(-(-total // most)):
        part = [tuple(r) for r in dealt.filter(F.col("part") == number).select("item_id", "text", "size").collect()]
        small = [r[:2] for r in part if r[2] <= most]
        yield from (read_items(g) for g in [small, *[[r[:2]] for r in part if r[2] > most]] if g)


def vectors(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Length of every document in terms, and the numbers and counts of the searched terms in it."""
    book = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = book.value.get
        for batch in batches(found):
            sizes, terms, times = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                ids, counts = np.unique(np.array([*filter(None, map(number, words))], np.uint32), return_counts=True)
                sizes.append(len(words))
                terms.append(ids.astype("<u4").tobytes())
                times.append(counts.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())],
                ["doc_id", "n", "terms", "times"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FORWARD)


def list_lengths(rows: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each searched term, summed per task and then by Spark."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in found:
            out += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4"), minlength=size)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for term, n in rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def weights_of(lengths: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in lengths], np.int64)


def values_of(times: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's value in a document: it grows with its count there and falls with the document's length."""
    m = 100 - 50 + (50 * lengths * documents) // total
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def similar_order(points: np.ndarray, leaf: int = 8) -> np.ndarray:
    """Order of rows by repeated halving along the line between a far row and the row farthest from it; equal rows stay together."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        here = points[rows]
        one = here[np.argmin(here @ here.mean(axis=0))]
        other = here[np.argmin(here @ one)]
        rows = rows[np.argsort(here @ (other - one), kind="stable")]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def sketches(starts: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Unit-length projections of sparse rows (none empty) to a few dimensions."""
    table = np.random.default_rng(7).normal(size=(size, SKETCH)).astype(np.float32)
    out = np.empty((len(starts) - 1, SKETCH), np.float32)
    for at in range(0, len(out), 512):
        here = starts[at : min(at + 512, len(out)) + 1]
        rows = table[terms[here[0] : here[-1]]] * values[here[0] : here[-1], None].astype(np.float32)
        out[at : at + 512] = np.add.reduceat(rows, here[:-1] - here[0], axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def make_shard(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray) -> dict[str, bytes]:
    """Documents in order of similarity, the list of every term cut into blocks, and the blocks' summaries; all compressed.

    Terms are numbered by falling weight. A document belongs to the list of its first term, so a block's summary starts at its own term.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])
    order = similar_order(sketches(starts, terms, values * weights[terms], len(weights)))
    kept = spans(starts[order], sizes[order])
    ids, sizes, terms, values = ids[order], sizes[order], terms[kept], values[kept]
    owner = np.repeat(np.arange(len(ids)), sizes)
    by_term = np.argsort(terms, kind="stable")
    listed = owner[by_term]
    lists = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
    matrix = np.zeros((len(ids), len(weights)), np.uint8)
    matrix[owner, terms] = -(-values // STEP)
    blocks, edges = [0], []
    for a, b in zip(lists[:-1].tolist(), lists[1:].tolist()):
        if a < b:
            # A node of the tree holds 2**level documents, and of the list its share of them.
            here = max(BLOCK_DOCS, (b - a) // LIST_BLOCKS)
            level = max(0, round(math.log2(here * len(ids) / (b - a))))
            node = listed[a:b] >> level
            edges.append(a + np.flatnonzero(np.diff(node, prepend=-1)))
        blocks.append(blocks[-1] + (len(edges[-1]) if a < b else 0))
    edges = np.concatenate([*edges, [len(listed)]])
    press = zstandard.ZstdCompressor(level=1)
    # Summaries are compressed block by block: together they are larger than all the rest.
    first = np.repeat(np.arange(len(weights)), np.diff(blocks))
    out = press.compressobj(size=int((len(weights) - first).sum()))
    summary = [
        out.compress(matrix[listed[a:b], t:].max(axis=0).tobytes())
        for t, a, b in zip(first.tolist(), edges[:-1].tolist(), edges[1:].tolist())
    ]
    summary.append(out.flush())
    parts = {
        "ids": ids, "starts": np.concatenate([[0], np.cumsum(sizes)]), "terms": terms, "values": values, "lists": lists,
        "listed": listed, "blocks": np.array(blocks), "edges": edges,
    }
    packed = {k: press.compress(np.ascontiguousarray(v, PARTS[k]).tobytes()) for k, v in parts.items()}
    return packed | {"summary": b"".join(summary)}


def shards(rows: DataFrame, place: np.ndarray, weights: np.ndarray, documents: int, total: int, most_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per shard, with its arrays compressed; a shard is a run of documents of one task.

    ``place`` numbers the terms anew, by falling weight; ``weights`` are in that order.
    """
    most = max(1, min(most_docs, SHARD_CELLS // len(weights)))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            ids = np.array([NO_ID if r[0] is None else r[0] for r in held], np.int64)
            sizes = np.array([len(r[2]) // 4 for r in held])
            terms = place[np.frombuffer(b"".join(r[2] for r in held), "<u4")]
            times = np.frombuffer(b"".join(r[3] for r in held), "<u4").astype(np.int64)
            values = values_of(times, np.repeat([r[1] for r in held], sizes), documents, total)
            made = make_shard(ids, sizes, terms, values, weights)
            return pa.RecordBatch.from_arrays([pa.array([made[k]], pa.binary()) for k in PARTS], list(PARTS))

        postings = 0
        for batch in batches(found):
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "times")]):
                held.append(row)
                postings += len(row[2]) // 4
                if len(held) >= most or postings >= SHARD_POSTINGS:
                    yield close()
                    held, postings = [], 0
        if held:
            yield close()

    return rows.filter("octet_length(terms) > 0").mapInArrow(run, ", ".join(f"{k} binary" for k in PARTS))


class Shard:
    """An opened shard; ``scores`` are exact, ``bounds`` never below them."""

    def __init__(self, row: dict):
        opener = zstandard.ZstdDecompressor()
        arrays = {k: np.frombuffer(opener.decompress(row[k]), t) for k, t in PARTS.items()}
        self.ids, self.starts, self.terms, self.values = (arrays[k] for k in ("ids", "starts", "terms", "values"))
        self.listed, self.blocks, self.edges = (arrays[k] for k in ("listed", "blocks", "edges"))
        self.summary, size = arrays["summary"], len(self.blocks) - 1
        self.own = np.repeat(np.arange(size), np.diff(self.blocks))
        self.base = np.cumsum(size - self.own) - size  # where coordinate 0 would lie in a block's summary

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the ascending terms' lists, and for each a number that no score of its own documents exceeds.

        A document belongs to the first of these lists that it is in: it holds none of the terms before, and a bound leaves them out.
        """
        first = self.blocks[terms]
        found = spans(first, self.blocks[terms + 1] - first)
        after = self.own[found][:, None] <= terms
        highest = np.where(after, self.summary[np.where(after, self.base[found][:, None] + terms, 0)], 0)
        return found, highest.astype(np.int64) @ (weights[terms] * STEP)

    def members(self, blocks: np.ndarray) -> np.ndarray:
        return self.listed[spans(self.edges[blocks], self.edges[blocks + 1] - self.edges[blocks])]

    def scores(self, docs: np.ndarray, by_term: np.ndarray) -> np.ndarray:
        """``by_term`` holds an item's weights, 0 for other terms."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        spot = spans(self.starts[docs], sizes)
        return np.add.reduceat(by_term[self.terms[spot]] * self.values[spot], np.cumsum(sizes) - sizes)


class Best:
    """The highest scores of one item so far; ties by ascending id."""

    def __init__(self, k: int, floor: int):
        self.k, self.least = k, max(floor, 1)
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        kept = np.flatnonzero(scores >= self.least)
        kept = kept[np.lexsort((ids[kept], -scores[kept]))[: self.k]]
        self.ids, self.scores = ids[kept], scores[kept]
        if len(kept) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best, first_only: bool) -> tuple[int, int]:
    """Score the blocks whose bounds reach the least score wanted, the most promising ones first; blocks met and scored."""
    blocks, bounds = shard.bounds(terms, weights)
    order = np.argsort(-bounds, kind="stable")
    by_term = np.zeros(len(weights), np.int64)
    by_term[terms] = weights[terms]
    fresh = np.ones(len(shard.ids), bool)
    at, wave = 0, 1
    while at < len(order):
        some = order[at : at + wave]
        some = some[bounds[some] >= best.least]
        if not len(some):
            break
        docs = np.unique(shard.members(blocks[some]))
        docs = docs[fresh[docs]]
        fresh[docs] = False
        if len(docs):
            best.add(shard.ids[docs], shard.scores(docs, by_term))
        at, wave = at + len(some), wave * 2
        if first_only:
            break
    return len(blocks), at


def candidates(index: DataFrame, items: Items, weights: np.ndarray, k: int, floors: Sequence[int], first_only: bool) -> DataFrame:
    """Each task's best documents of every item."""
    shared = index.sparkSession.sparkContext.broadcast((items.terms, weights, list(floors)))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, floor = shared.value
        best = [Best(k, f) for f in floor]
        for batch in found:
            for at in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[at].as_py() for c in PARTS})
                for wanted, held in zip(terms, best):
                    search_shard(shard, wanted, weight, held, first_only)
        sizes = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)),
                pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best])),
            ],
            ["item", "doc_id", "score"],
        )

    return index.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every item; first within bounded groups of tasks, so that no window sees all tasks' rows."""
    order = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= k).drop("rank", "_salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def few_rows(spark: SparkSession, rows: int) -> str:
    """Rows per Arrow batch for tables whose rows are large; returns the setting it replaces."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    return before


def _search_group(docs: DataFrame, items: Items, k: int, most_docs: int) -> DataFrame:
    spark = docs.sparkSession
    rows = store(vectors(docs, items.numbers), "lexical-vectors")
    heads = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    documents, total = heads[0], heads[1] or 0
    weights = weights_of(list_lengths(rows, len(items.numbers) + 1), documents)
    order = np.argsort(-weights, kind="stable")
    place = np.argsort(order)  # terms are numbered by falling weight from here on
    weights, items = weights[order], Items(items.ids, [np.sort(place[t]) for t in items.terms], items.numbers)
    before = few_rows(spark, 512)
    try:
        index = store(shards(rows, place, weights, documents, max(total, 1), most_docs), "lexical-index")
        few_rows(spark, 2)
        seeds = store(candidates(index, items, weights, k, [1] * len(items.ids), True), "lexical-seeds")
        floors = [1] * len(items.ids)
        for item, score in ranked(seeds, k).filter(F.col("rank") == k).select("item", "score").collect():
            floors[item] = score
        found = store(candidates(index, items, weights, k, floors, False), "lexical-found")
    finally:
        few_rows(spark, int(before))
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], "item int, item_id long")
    doc_id = F.when(F.col("doc_id") != F.lit(int(NO_ID)), F.col("doc_id")).alias("doc_id")
    return store(ranked(found, k).join(names, "item").select("item_id", "rank", doc_id, "score"), "lexical-ranked")


def search(docs: DataFrame, items: DataFrame, k: int = 50, most_docs: int = SHARD_DOCS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``k`` best documents of every item, scores above 0 only.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are ignored. Ids are long numbers
    (others that Spark can cast to long are cast). Null and empty texts have no terms: such documents are found by nothing, such items find
    nothing. Ties go by ascending document id, null ids last. Repeated rows are documents, or items, of their own. Empty tables
    give no rows. The index holds every document, over the terms of the items searched for; items come in groups of a bounded
    number of bytes, each with a run of its own, so that what tasks share does not grow with the table of items.
    """
    out = None
    for group in item_groups(items, group_bytes):
        if group.ids:
            part = _search_group(docs, group, k, most_docs)
            out = part if out is None else out.unionByName(part)
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return empty if out is None else out
