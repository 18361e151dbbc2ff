"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

1. One pass cuts the corpus into chunks of whole documents, numbers each chunk's words, and writes the documents as numbers,
   the chunk's words, and its word pairs, the last two parted by hash.
2. Each part sums its counts over all chunks, answers the chunks with the exact counts of their words, and stores its pairs in its
   block of the filter: a pair whose count has level q is there as the q members (pair, 1) to (pair, q), and nothing else of it
   is kept. A block is as large as its members need.
3. The blocks are broadcast in slices of a bounded number of bytes. In a narrow pass per slice, the documents probe it for the pairs
   that fall into it, level by level until a member is missing, and interpolate the frequency found with the smoothed
   word frequency. A document's score is the sum of its passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.quality import remainder
from trendloom.llm.textkit import ascii_words, batches, give_back, mix
from trendloom.sources.work import store, work_path

#: Tokens after which a chunk is closed, and bytes of text per part of the hash space.
CHUNK_TOKENS, PART_BYTES = 2_000_000, 32 << 20
#: Bytes of the filter that are broadcast at a time, and tokens that are scored at a time (a longer document goes alone).
SLICE_BYTES, GROUP_TOKENS = 48 << 20, 1 << 17
BITS_PER_MEMBER, BITS_SET = 8, 4
BASE, ADDED = 1.5, 0.1
PAIR_WEIGHT = 0.2
END = b""

SCHEMA = "chunk long, kind string, part int, doc_id {kind}, held_out boolean, n long, a binary, b binary"
FIELDS = ["chunk", "kind", "part", "doc_id", "held_out", "n", "a", "b"]


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of distinct words: a chunk asks for each once, so none is kept."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, byte planes apart, since high bytes are mostly zero."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(2))


def pair_spots(hashes: np.ndarray, before: np.ndarray, codes: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 bits of the hash of word pairs, given as places in ``hashes``: all that a pair is known by."""
    h = pair_hash(hashes[before], hashes[codes])
    return (part_of(h, parts) << np.uint64(32)) | low32(h)


def low32(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised logarithm of counts of 1 or more: 1 for 1, one more for each power of the base reached."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def level_values(most: int = 64) -> np.ndarray:
    """Count that stands for a level: the geometric mean of the whole numbers it covers."""
    out = np.zeros(most)
    for q in range(1, most):
        low, high = int(np.ceil(BASE ** (q - 1) - 1e-9)), int(np.ceil(BASE**q - 1e-9)) - 1
        out[q] = float(low * max(high, low)) ** 0.5
    return out


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _close(chunk: int, docs: list, numbers: _Numbers, parts: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of a finished chunk; words are renumbered by part and hash, so a chunk's words are its parts' words in order."""
    hashes = mix(word_hashes(numbers) + np.uint64(1))
    order = np.lexsort((hashes, part_of(hashes, parts)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hashes = hashes[order]
    learned = sum(len(codes) for _, held, codes in docs if not held)
    words, pairs, rows, at = np.empty(learned, np.int32), np.empty(learned, np.uint64), [], 0
    end = place[numbers[END]]
    for doc_id, held, codes in docs:
        codes = place[codes]
        rows.append((chunk, "doc", 0, doc_id, held, len(codes), squeeze(codes), None))
        if not held:
            words[at : at + len(codes)] = codes
            pairs[at : at + len(codes)] = pair_spots(hashes, np.concatenate([[end], codes[:-1]]), codes, parts)
            at += len(codes)
        if len(rows) >= 512:
            yield _rows(rows, kind)
            rows = []
    counts = np.bincount(words, minlength=len(order))
    del words
    pairs.sort()
    starts = _starts(pairs).astype(np.uint32)
    times, pairs = np.diff(starts, append=np.uint32(len(pairs))), pairs[starts]
    del starts
    for p, a, b in _runs(part_of(hashes, parts)):
        rows.append((chunk, "uni", p, None, None, b - a, hashes[a:b].tobytes(), squeeze(counts[a:b])))
    for p, a, b in _runs((pairs >> np.uint64(32)).astype(np.uint32)) if len(pairs) else ():
        steps = np.diff(low32(pairs[a:b]), prepend=np.uint32(0))
        rows.append((chunk, "bi", p, None, None, b - a, squeeze(steps), squeeze(times[a:b])))
    yield _rows(rows, kind)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _runs(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Part, start and end of the runs of a sorted array."""
    edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]]))
    return ((int(parts[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]))


def _rows(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), kind, pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], FIELDS)


def chunked(docs: DataFrame, parts: int, folds: int, tokens: int = CHUNK_TOKENS) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", F.coalesce(remainder("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "text")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, numbers, size, shape = TaskContext.get().partitionId() << 24, [], _Numbers(), 0, None
        for batch in batches(found, owner="words"):
            shape = batch.schema.field("doc_id").type
            for doc_id, out, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")]):
                words = ascii_words(text)
                words.append(END)
                held.append((doc_id, out, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                size += len(words)
                if size >= tokens:
                    yield from _close(chunk, held, numbers, parts, shape)
                    chunk, held, numbers, size = chunk + 1, [], _Numbers(), 0
                    give_back()
        if held:
            yield from _close(chunk, held, numbers, parts, shape)
        del held, numbers
        give_back()

    return base.mapInArrow(run, SCHEMA.format(kind=kind))


# The filter of a part is an array of 64-bit words; a member sets some bits of one word.


def _spot(h: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    g = mix(h + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64)))
    mask = np.zeros(len(g), np.uint64)
    for k in range(BITS_SET):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * k)) & np.uint64(63))
    return ((g >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32), mask


def key_of(h: np.ndarray, pair: bool) -> np.ndarray:
    """Key inside a part: pairs are known by 32 bits of their hash there, words by all."""
    return low32(h).astype(np.uint64) + np.uint64(1 << 32) if pair else h | np.uint64(1 << 63)


def build_block(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Filter words of one part, as many as its members need."""
    levels = np.empty(len(keys), np.int8)
    slices = [slice(at, at + GROUP_TOKENS) for at in range(0, len(keys), GROUP_TOKENS)]  # what is made on the way stays small
    for s in slices:
        levels[s] = level_of(counts[s])
    words = max(1, int(levels.sum(dtype=np.int64) * BITS_PER_MEMBER // 64 + 1))
    out = np.zeros(words, np.uint64)
    for s in slices:
        for q in range(1, int(levels[s].max(initial=0)) + 1):
            spot, mask = _spot(keys[s][levels[s] >= q], q, words)
            np.bitwise_or.at(out, spot.astype(np.int64), mask)
    return out


class Filter:
    """Blocks of consecutive parts, ``first`` to ``last``, end to end; a part without a block has no members."""

    def __init__(self, blocks: Mapping[int, np.ndarray], first: int, last: int):
        self.first, self.last = first, last
        self.sizes = np.zeros(last - first + 1, np.uint64)
        for part, block in blocks.items():
            self.sizes[part - first] = len(block)
        self.starts = np.cumsum(self.sizes).astype(np.int64) - self.sizes.astype(np.int64)
        self.words = np.concatenate([blocks[p] for p in sorted(blocks)] or [np.zeros(0, np.uint64)])

    def levels(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Level of every key: probes for one level after the other until a member is missing."""
        out = np.zeros(len(key), np.int8)
        spot = part.astype(np.int64) - self.first
        left = np.flatnonzero(self.sizes[spot])
        key, size, start = key[left], self.sizes[spot[left]], self.starts[spot[left]]
        for q in range(1, 64):
            place, mask = _spot(key, q, size)
            hit = (self.words[start + place.astype(np.int64)] & mask) == mask
            left = left[hit]
            if not len(left):
                break
            out[left] = q
            key, size, start = key[hit], size[hit], start[hit]
        return out


def count_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Per part: token and word totals, the block of its pairs, and for each chunk the exact counts of its words."""

    def run(key: tuple[pa.Scalar, ...], found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, pair = [], []
        for batch in batches(found, 16, "words"):
            for kind, chunk, a, b in zip(*[batch.column(c).to_pylist() for c in ("kind", "chunk", "a", "b")]):
                if kind == "uni":
                    uni.append((chunk, np.frombuffer(a, np.uint64), expand(b)))
                else:
                    keys = np.cumsum(expand(a), dtype=np.uint32).astype(np.uint64)
                    pair.append((keys << np.uint64(32)) | expand(b))
        out, part = [], key[0].as_py()
        words, inverse, sums = _summed(uni, np.uint64)
        for (chunk, hashes, _), at in zip(uni, inverse):
            out.append((chunk, "count", part, None, None, len(hashes), squeeze(sums[at]), None))
        out.append((int(sums.sum()), "total", part, None, None, int((sums > 0).sum()), None, None))
        del words, inverse, sums, uni
        keys, times = _tallied(pair)
        if len(keys):
            block = build_block(key_of(keys, True), times)
            out.append((None, "block", part, None, None, block.nbytes, block.tobytes(), None))
            del block
        del keys, times
        give_back()
        for at in range(0, len(out), 512):
            yield _rows(out[at : at + 512], pa.int64())

    by_part = rows.filter("kind IN ('uni', 'bi')").select("part", "kind", "chunk", "a", "b")
    return by_part.groupBy("part").applyInArrow(run, SCHEMA.format(kind="bigint"))


def _summed(found: list, kind: type) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys of (chunk, keys, counts), the places of each chunk's keys among them, and their total counts."""
    keys, inverse = np.unique(np.concatenate([x[1] for x in found] or [np.zeros(0, kind)]), return_inverse=True)
    sums = np.bincount(inverse, np.concatenate([x[2] for x in found] or [np.zeros(0)]), len(keys)).astype(np.int64)
    return keys, np.split(inverse, np.cumsum([len(x[1]) for x in found])[:-1]), sums


def _tallied(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their total counts, from arrays with keys in the high and counts in the low halves; empties the list."""
    joined, at = np.empty(sum(map(len, found)), np.uint64), 0
    while found:
        some = found.pop()
        joined[at : at + len(some)] = some
        at += len(some)
    joined.sort()
    keys = joined >> np.uint64(32)
    joined &= np.uint64(0xFFFFFFFF)
    starts = _starts(keys)
    times = np.add.reduceat(joined, starts) if len(starts) else joined
    return keys[starts], times.astype(np.int64)


def gathered(rows: DataFrame, counted: DataFrame, kind: str) -> DataFrame:
    """One row per chunk: its words' hashes and exact counts in the order of parts and hashes, and its documents as numbers."""

    def run(key: tuple[pa.Scalar, ...], found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, docs, shape = {}, {}, [], None
        for batch in found:
            shape = batch.schema.field("doc_id").type
            for what, part, *rest in zip(*[batch.column(c).to_pylist() for c in ("kind", "part", "doc_id", "held_out", "a")]):
                if what == "doc":
                    docs.append(rest)
                else:
                    (words if what == "uni" else counts)[part] = rest[2]
        hashes = b"".join(words[p] for p in sorted(words))
        exact = squeeze(np.concatenate([expand(counts[p]) for p in sorted(counts)]))
        ids, held, codes = zip(*docs)
        columns = [pa.array([key[0].as_py()]), pa.array([hashes], pa.binary()), pa.array([exact], pa.binary()),
                   pa.array([ids], pa.list_(shape)), pa.array([held], pa.list_(pa.bool_())), pa.array([codes], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "hashes", "counts", "ids", "held", "codes"])

    keep = ["chunk", "kind", "part", "doc_id", "held_out", "a"]
    answers = counted.filter("kind = 'count'").withColumn("doc_id", F.lit(None).cast(kind)).select(keep)
    return rows.filter("kind IN ('doc', 'uni')").select(keep).unionByName(answers).groupBy("chunk").applyInArrow(
        run, f"chunk long, hashes binary, counts binary, ids array<{kind}>, held array<boolean>, codes array<binary>"
    )


def _pass(chunks: DataFrame, shared: Broadcast, parts: int, kind: str, total: int, distinct: int, weight: float) -> DataFrame:
    """The part of every document's score that comes from pairs in the broadcast slice, beside what needs no filter."""
    divisor, values = total + ADDED * (distinct + 1), level_values()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Filter = shared.value
        for batch in batches(found, 1, "words"):
            chunk, raw, counts, ids, held, codes = (batch.column(k)[0].as_py() for k in range(6))
            hashes, exact = np.frombuffer(raw, np.uint64), expand(counts).astype(np.float64)
            single = (exact + ADDED) / divisor
            logs, end = np.log10(single), int(np.flatnonzero(hashes == END_HASH)[0])
            numbers = list(map(expand, codes))
            turn = np.cumsum([len(c) for c in numbers]) // GROUP_TOKENS
            for _, at, to in _runs(turn):
                lengths = np.array([len(c) for c in numbers[at:to]])
                flat, starts = np.concatenate(numbers[at:to]).astype(np.int64), np.cumsum(lengths) - lengths
                before = np.concatenate([[end], flat[:-1]])
                before[starts] = end
                spots = pair_spots(hashes, before, flat, parts)
                part = (spots >> np.uint64(32)).astype(np.int64)
                here = np.flatnonzero((part >= book.first) & (part <= book.last))
                seen = values[book.levels(part[here], key_of(spots[here], True))]
                context, alone = exact[before[here]], single[flat[here]]
                share = np.where(context > 0, np.minimum(seen / np.maximum(context, 1), 1.0), 0.0)
                gained = np.zeros(len(flat))
                gained[here] = np.log10(np.where(context > 0, (1 - weight) * alone + weight * share, alone))
                n = to - at
                columns = [
                    pa.array(np.full(n, chunk)), pa.array(np.arange(at, to)), pa.array(ids[at:to], batch.schema.field("ids").type.value_type),
                    pa.array(held[at:to], pa.bool_()), pa.array(lengths), pa.array(np.add.reduceat(exact[flat] > 0, starts, dtype=np.int64)),
                    pa.array(np.full(n, total, np.int64)), pa.array(np.add.reduceat(logs[flat], starts)), pa.array(np.add.reduceat(gained, starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, PASS_FIELDS)

    shape = f"chunk long, at long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.mapInArrow(run, shape)


PASS_FIELDS = ["chunk", "at", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_documents(
    docs: DataFrame, folds: int = 10, weight: float = PAIR_WEIGHT, parts: int | None = None, chunk_tokens: int = CHUNK_TOKENS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Exact unigram base score and model score (log10 probabilities) of every whole text.

    Documents whose id's crc32 modulo ``folds`` is 0 are held out of all counts; a null id is not held out. Null and empty
    texts have the end token alone. Repeated rows count, and are scored, each; other columns are ignored; ids are of any type; an empty
    table gives no rows. Words are known by 64-bit hashes, pairs by a part and 32 bits. The filter grows with the pairs of
    the corpus; what is broadcast at a time is about ``slice_bytes``, and each slice is one more pass over the chunks.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(6, -(-size // PART_BYTES))
    kind = dict(docs.dtypes)["doc_id"]
    path = work_path(spark, "lm-chunks")
    chunked(docs, parts, folds, chunk_tokens).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(SCHEMA.format(kind=kind)).parquet(path)
    counted = store(count_parts(rows, parts), "lm-counts")
    heads = counted.groupBy("kind").agg(F.sum(F.when(F.col("kind") == "total", F.col("chunk"))).alias("tokens"), F.sum("n").alias("n"))
    sums = {r["kind"]: r for r in heads.collect()}
    total, distinct = (sums["total"]["tokens"], sums["total"]["n"]) if "total" in sums else (0, 0)
    slices = max(1, -(-(sums["block"]["n"] if "block" in sums else 0) // slice_bytes))
    chunks = store(gathered(rows, counted, kind), "lm-gathered")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    found = []
    for k in range(slices):
        first, last = k * parts // slices, (k + 1) * parts // slices - 1
        blocks = counted.filter((F.col("kind") == "block") & F.col("part").between(first, last)).select("part", "a").collect()
        shared = spark.sparkContext.broadcast(Filter({r["part"]: np.frombuffer(r["a"], np.uint64) for r in blocks}, first, last))
        spark.conf.set(name, "16m")  # a chunk is one row of some megabytes
        try:
            found.append(store(_pass(chunks, shared, parts, kind, total, distinct, weight), "lm-pass"))
        finally:
            spark.conf.set(name, before)
            shared.unpersist()
    if len(found) == 1:
        return found[0].select(PASS_FIELDS[2:])
    more = found[1].select("chunk", "at", "score")
    for part in found[2:]:
        more = more.unionByName(part.select("chunk", "at", "score"))
    rest = more.groupBy("chunk", "at").agg(F.sum("score").alias("_rest"))
    return found[0].join(rest, ["chunk", "at"]).withColumn("score", F.col("score") + F.col("_rest")).select(PASS_FIELDS[2:])


END_HASH = mix(word_hashes([END]) + np.uint64(1))[0]
