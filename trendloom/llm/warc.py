"""WARC archives whose records are Zstandard frames with a shared dictionary, written and read by Spark tasks.

A file is: one skippable frame (magic 0x184D2A5D) that holds the file's dictionary, then one frame per record. Spark's text
writer puts the files out, so they reach any store Spark can write to, appear only when their task commits, and
are written again if an executor is lost. Its line separator is an empty skippable frame, which every reader passes over.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.textkit import batches

# Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE_MAGIC = 0x184D2A5D, 0x184D2A50
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")

#: A dictionary is trained on at most this many bytes of a file's first records.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: Compressed bytes handed to the decompressor at a time.
CHUNK = 1 << 16
DATE = "2026-01-01T00:00:00Z"

READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
)


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records; raw content where they are too few to train on, none where they are empty."""
    room = min(DICTIONARY_BYTES, max(1 << 10, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(room, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-room:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, digest: str, size: int, refers_to, payload: bytes | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: {_record_id(page_id)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _whole(x):
    return None if pd.isna(x) else int(x)


def _compress(found: Iterator) -> Iterator[pd.DataFrame]:
    """Frames of one archive: the first records are held back as the sample, then everything streams."""
    held: list[bytes] = []
    size, packer = 0, None

    def start():
        book = train(held)
        head = []
        if book is not None:
            raw = book.as_bytes()
            head = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw]
        return zstandard.ZstdCompressor(level=3, dict_data=book), head

    for batch in batches(found, 64):
        rows = [
            record(_whole(p), u, d, n, _whole(r), b)
            for p, u, d, n, r, b in zip(*[batch.column(c).to_pylist() for c in
                                          ("page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload")])
        ]
        if packer is None:
            held += rows
            size += sum(map(len, rows))
            if size < SAMPLE_BYTES:
                continue
            packer, out = start()
            rows, held = held, []
        else:
            out = []
        yield _frame_batch(out + [packer.compress(r) for r in rows])
    if packer is None and held:
        packer, out = start()
        yield _frame_batch(out + [packer.compress(r) for r in held])


def _frame_batch(frames: list[bytes]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Digest, size and ``refers_to`` of every page.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the smallest page_id is the response and others refer to
    it; shorter payloads never refer. Null html is the empty payload. Rows that repeat the response's own page_id are
    responses too; a null page_id may refer but is never referred to. The payloads of revisits are not carried on.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    base = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    firsts = (
        base.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    later = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (
        base.join(firsts, "payload_digest", "left")
        .withColumn("refers_to", F.when(later, F.col("_first")))
        .withColumn("payload", F.when(~later, F.col("payload")))
        .drop("_first")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    """Write ``page_id``, ``url``, ``html`` as dictionary-compressed WARC files below ``path``, one per partition."""
    rows = mark_revisits(pages, least_bytes).select(
        "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload"
    )
    frames = rows.mapInArrow(_compress, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_frames(raw: memoryview) -> Iterator[bytes]:
    """Decompressed frames of one archive, in order."""
    at, opener = 0, zstandard.ZstdDecompressor()
    while at < len(raw):
        magic, size = struct.unpack_from("<II", raw, at) if at + 8 <= len(raw) else (0, 0)
        if SKIPPABLE_MAGIC <= magic < SKIPPABLE_MAGIC + 16:
            if magic == DICTIONARY_MAGIC:
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        one, parts = opener.decompressobj(), []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("the archive ends inside a frame")
            piece = raw[at : at + CHUNK]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def parse(whole: bytes) -> dict:
    """Fields of one record; the digest of a response is computed anew and must agree with its header."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    named = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = named["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {named['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(named[k]) if k in named else None
    return {
        "page_id": number("WARC-Page-ID"), "url": named.get("WARC-Target-URI"), "record_type": kind,
        "payload_digest": digest, "payload_bytes": size, "refers_to": number("WARC-Refers-To-Page-ID"),
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``, verified; ``payloads=False`` leaves the payload column null."""
    import pyarrow as pa

    fields = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def records(found):
        for batch in batches(found, 1):
            out, size = [], 0
            for frame in read_frames(memoryview(batch.column("content")[0].as_buffer())):
                out.append(parse(frame))
                size += out[-1]["payload_bytes"]
                if not payloads:
                    out[-1]["payload"] = None
                if size > SAMPLE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, READ_SCHEMA)
