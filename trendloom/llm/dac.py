"""Token ids in files of directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

An id is split into chunks of bits, low bits first. Level 0 holds the first chunk of every id; a bitmap says which ids go on, and a
directory of counts says how many did so before each block of the bitmap, so the next chunk of an id is found by one rank. Any
id, or any run of ids, is read in as many steps as there are levels, and nothing around it is decoded.

A file is a row of segments, each followed by one line feed; a segment is a number of consecutive ids with the documents that they
belong to, and its chunk widths are those that make it smallest. Files come from ranges of documents in ascending order; positions
inside a segment's header count from the start of its range, and a small directory beside the files says how many ids lie before
each range. Spark's text writer puts the files out, so they reach any store Spark can write to and appear only when their task
commits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.packing import words_of
from trendloom.llm.textkit import batches

MAGIC = b"TLDAC1\0\0"
END = 2
#: Ids in a segment, segments in a file, and bytes of text in a range of documents.
SEGMENT_IDS, FILE_SEGMENTS, RANGE_BYTES = 1 << 18, 16, 16 << 20
#: Bits of a bitmap between two entries of its rank directory; a chunk has at most 24 bits, an id 32.
RANK_BITS, WIDEST = 512, 24

# Segment head: magic, bytes of the segment, range, first id, ids, documents, levels.
HEAD = struct.Struct("<8sqqqqqq")
PIECES = "range long, doc_id long, doc_start long, n_tokens long, at long, length long, crc long"


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths with the smallest sum of chunks, bitmaps and directories, found from the lowest bits up."""
    bits = np.zeros(len(ids), np.int64)
    for k in range(32):
        bits[ids >> np.uint32(k) != 0] = k + 1
    top = max(1, int(bits.max(initial=1)))
    beyond = [len(ids)] + [int((bits > k).sum()) for k in range(1, top)]  # ids with a chunk that starts at bit k
    cost, first = [0.0] * (top + 1), [0] * (top + 1)
    for k in range(top - 1, -1, -1):
        extra = 1 + 32 / RANK_BITS
        options = [(beyond[k] * (w + (extra if k + w < top else 0)) + cost[k + w], w) for w in range(1, min(WIDEST, top - k) + 1)]
        cost[k], first[k] = min(options)
    out, k = [], 0
    while k < top:
        out.append(first[k])
        k += first[k]
    return out


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits, low bits first, and four bytes more so that a read never leaves the array."""
    if width == 8:
        return values.astype(np.uint8).tobytes() + bytes(4)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + bytes(4)


def read_bits(raw: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
    spot = places.astype(np.int64) * width
    byte, shift = spot >> 3, (spot & 7).astype(np.uint32)
    out = np.zeros(len(places), np.uint32)
    for k in range(4):
        out |= raw[byte + k].astype(np.uint32) << np.uint32(8 * k)
    return (out >> shift) & np.uint32((1 << width) - 1)


def encode(ids: np.ndarray, widths: list[int] | None = None) -> tuple[list[int], bytes]:
    """Widths and bytes of all levels: per level its size, the chunks, and, but for the last level, bitmap and rank directory."""
    ids = ids.astype(np.uint32)
    widths = widths or best_widths(ids)
    out, left, shift = [], ids, 0
    for k, width in enumerate(widths):
        parts = [pack_bits(left & np.uint32((1 << width) - 1), width)]
        if k + 1 < len(widths):
            more = (left >> np.uint32(width)) != 0
            padded = np.zeros(-(-(len(more) + 1) // RANK_BITS) * RANK_BITS, np.uint8)
            padded[: len(more)] = more
            ones = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32)
            parts += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).tobytes()]
        out.append(struct.pack("<q", len(left)) + b"".join(parts))
        if k + 1 < len(widths):
            left = left[more] >> np.uint32(width)
        shift += width
    return widths, b"".join(out)


class Codes:
    """Ids of one segment, in place."""

    def __init__(self, raw: memoryview, widths: list[int]):
        at, self.levels = 0, []
        for k, width in enumerate(widths):
            (n,) = struct.unpack_from("<q", raw, at)
            at, size = at + 8, -(-n * width // 8) + 4
            chunks, at, marks, counts = np.frombuffer(raw, np.uint8, size, at), at + size, None, None
            if k + 1 < len(widths):
                blocks = -(-(n + 1) // RANK_BITS)
                marks = np.frombuffer(raw, "<u8", blocks * RANK_BITS // 64, at)
                at += blocks * RANK_BITS // 8
                counts = np.frombuffer(raw, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((width, n, chunks, marks, counts))

    @staticmethod
    def _rank(marks: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's count, then whole words, then part of a word."""
        block, word = places // RANK_BITS, places // 64
        out = counts[block].astype(np.int64)
        for k in range(RANK_BITS // 64):
            spot = block * (RANK_BITS // 64) + k
            out += np.where(spot < word, np.bitwise_count(marks[spot]), 0)
        below = (np.uint64(1) << (places % 64).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(marks[word] & below)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ids at any places, in any order."""
        places = np.asarray(places, np.int64)
        out, left, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for width, _, chunks, marks, counts in self.levels:
            out[left] |= read_bits(chunks, width, places) << np.uint32(shift)
            if marks is None:
                break
            more = (marks[places // 64] >> (places % 64).astype(np.uint64)) & np.uint64(1) == 1
            left, places = left[more], self._rank(marks, counts, places[more])
            shift += width
        return out

    def run(self, start: int, end: int) -> np.ndarray:
        """Ids at places ``start`` to ``end`` - 1: one rank a level, then consecutive chunks."""
        out, left, shift = np.zeros(end - start, np.uint32), np.arange(end - start), 0
        for width, _, chunks, marks, counts in self.levels:
            if start == end:
                break
            if width == 8:
                found = chunks[start:end].astype(np.uint32)
            else:
                found = read_bits(chunks, width, np.arange(start, end))
            out[left] |= found << np.uint32(shift)
            if marks is None:
                break
            more = np.unpackbits(marks.view(np.uint8), bitorder="little")[start:end] == 1 if end - start > 4096 else (
                (marks[np.arange(start, end) // 64] >> (np.arange(start, end) % 64).astype(np.uint64)) & np.uint64(1) == 1
            )
            left = left[more]
            start = int(self._rank(marks, counts, np.array([start]))[0])
            end, shift = start + len(left), shift + width
        return out


def make_segment(number: int, first: int, ids: np.ndarray, docs: list[tuple]) -> bytes:
    """``docs``: (id or None, start in the range, ids) of every document with ids here."""
    widths, coded = encode(ids)
    table = np.array([(0 if d is None else d, s, n, d is None) for d, s, n in docs], "<i8").tobytes()
    body = bytes(widths) + table + coded
    return HEAD.pack(MAGIC, HEAD.size + len(body), number, first, len(ids), len(docs), len(widths)) + body


class Segment:
    """A segment as it lies in a file; ``size`` is its number of bytes."""

    def __init__(self, raw: memoryview):
        magic, self.size, self.range, self.first, self.n, docs, levels = HEAD.unpack_from(raw, 0)
        if magic != MAGIC or self.size > len(raw):
            raise ValueError("not a segment of token ids, or cut off")
        at = HEAD.size + levels
        self._widths = list(raw[HEAD.size : at])
        self.docs = np.frombuffer(raw, "<i8", 4 * docs, at).reshape(docs, 4)
        self._rest = raw[at + 32 * docs : self.size]

    @property
    def codes(self) -> Codes:
        return Codes(self._rest, self._widths)


def segments(raw: memoryview) -> Iterator[Segment]:
    at = 0
    while at < len(raw):
        found = Segment(raw[at:])
        yield found
        at += found.size + 1


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of all documents below ``path``, in ascending order of ``doc_id``, and the directory of ranges.

    Every document ends with the id ``end``; null and empty texts have that id alone. Ids of documents are long numbers (others
    that Spark can cast to long are cast); null ids come first, repeated ones are documents of their own, ordered by a hash
    of their texts. Other columns are ignored; an empty table makes no segments. A range is cut by number of documents; a
    long document goes over as many segments and files as it needs.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_hash", F.xxhash64("text"))
    order = ["doc_id", "_hash", "_row"]
    # The row number only lets a range end inside repeated rows, which are alike.
    base = base.withColumn("_row", F.monotonically_increasing_id())
    laid = base.repartitionByRange(max(1, -(-size // RANGE_BYTES)), *order).sortWithinPartitions(*order)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = words_of(vocabulary), TaskContext.get().partitionId()
        first, total, held, table = 0, 0, [], []
        tail = np.array([end], "<u2").tobytes()

        def close(n: int) -> bytes:
            nonlocal first, held, table
            ids = np.frombuffer(b"".join(held), "<u2")
            made = make_segment(number, first, ids[:n], [d for d in table if d[1] < first + n])
            first += n
            held = [ids[n:].tobytes()]
            table = [d for d in table if d[1] + d[2] > first]
            return made

        for batch in batches(found, owner="pieces"):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist())):
                n = len(raw) // 2 + 1
                table.append((doc_id, total, n))
                held += [raw, tail]
                total += n
                while total - first >= segment_ids:
                    yield _one(close(segment_ids))
        if total > first:
            yield _one(close(total - first))

    coded = laid.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    coded.write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)
    _files(spark, path).mapInArrow(_ranges, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).withColumn(
        # One row per range of RANGE_BYTES of text: the unpartitioned window is bounded by the number of files.
        "base", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ).write.parquet(f"{path}/_ranges")


def _one(raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["value"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _opened(found: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches(found, 1):
        yield from segments(memoryview(batch.column("content")[0].as_buffer()))


def _ranges(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(s.range, s.n) for s in _opened(found)]
    columns = list(zip(*rows)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["range", "n"])


def _long_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """``range``, its number of ids ``n``, and the ids before it, ``base``."""
    return spark.read.schema("range long, n long, base long").parquet(f"{path}/_ranges")


def _pieces(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    for one in _opened(found):
        codes, rows = one.codes, []
        ids = codes.run(0, one.n).astype("<u4")
        for doc_id, start, n, missing in one.docs.tolist():
            a, b = max(start, one.first), min(start + n, one.first + one.n)
            crc = zlib.crc32(ids[a - one.first : b - one.first].tobytes())
            rows.append((one.range, None if missing else doc_id, start, n, a - start, b - a, crc))
        yield _long_rows(rows, names)


POLYNOMIAL = 0xEDB88320  # fixed value of crc32


def _product(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, highest bit for the power 0."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(crc: int, after: int, size: int) -> int:
    """crc32 of two strings end to end, from those of each and the second one's ``size`` in bytes."""
    power, factor, bits = 1 << 31, 1 << 30, 8 * size
    while bits:
        if bits & 1:
            power = _product(factor, power)
        factor, bits = _product(factor, factor), bits >> 1
    return _product(power, crc) ^ after


def _join_pieces(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = sorted(table.select(["at", "length", "crc", "doc_id", "n_tokens"]).to_pylist(), key=lambda r: r["at"])
    crc, at = 0, 0
    for r in rows:
        if r["at"] != at:
            raise ValueError("a piece of a document is missing")
        crc, at = joined_crc(crc, r["crc"], 4 * r["length"]), at + r["length"]
    if at != rows[0]["n_tokens"]:
        raise ValueError("a piece of a document is missing")
    one = (key[0].as_py(), rows[0]["doc_id"], key[1].as_py(), at, crc)
    return pa.Table.from_batches([_long_rows([one], ["range", "doc_id", "doc_start", "n_tokens", "crc"])])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of every document in the files."""
    pieces = _files(spark, path).mapInArrow(_pieces, PIECES)
    whole = pieces.filter("length = n_tokens").select("range", "doc_id", "doc_start", "n_tokens", "crc")
    # Pieces of one document: as many as segments that it goes over.
    cut = pieces.filter("length < n_tokens").groupBy("range", "doc_start").applyInArrow(
        _join_pieces, "range long, doc_id long, doc_start long, n_tokens long, crc long"
    )
    return whole.unionByName(cut).join(ranges(spark, path).select("range", "base"), "range").select(
        "doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The id ``token`` at every ``place`` (its number among all ids) of a table; places outside the files give no rows.

    Places meet segments by equality of a number of ``SEGMENT_IDS`` ids, and a segment is asked for its places alone: ids in
    between are not decoded.
    """
    spot = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("tile", F.expr(f"place div {SEGMENT_IDS}"))

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, 1):
            raw, at = memoryview(batch.column("content")[0].as_buffer()), 0
            for one in segments(raw):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.range]), pa.array([one.first]), pa.array([one.n]), pa.array([bytes(raw[at : at + one.size])], pa.binary())],
                    ["range", "first", "n", "raw"],
                )
                at += one.size + 1

    stored = _files(spark, path).mapInArrow(split, "range long, first long, n long, raw binary")
    begin = F.col("base") + F.col("first")
    edges = stored.select("range", "first", "n").join(ranges(spark, path).select("range", "base"), "range").select(
        "range", "first", begin.alias("begin"), (begin + F.col("n")).alias("end")
    )
    tiles = edges.withColumn("tile", F.explode(F.sequence(F.expr(f"begin div {SEGMENT_IDS}"), F.expr(f"(end - 1) div {SEGMENT_IDS}"))))
    asked = spot.join(tiles, "tile").filter("place >= begin AND place < end").groupBy("range", "first").agg(
        F.collect_list("place").alias("place"), F.collect_list(F.col("place") - F.col("begin")).alias("at")  # at most a segment's ids
    )

    def look(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, 1):
            one = Segment(memoryview(batch.column("raw")[0].as_buffer()))
            at = np.array(batch.column("at")[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("place")[0].as_py(), pa.int64()), pa.array(one.codes.at(at).astype(np.int64))], ["place", "token"]
            )

    return stored.select("range", "first", "raw").join(asked, ["range", "first"]).mapInArrow(look, "place long, token long")
