"""Token sequences packed along a space-filling curve.

Documents are tokenized once; a hashed bag of tokens is projected to three dimensions and quantised, and documents are laid out
by the Hilbert index of their cell, so neighbours in a sequence use similar words. The layout is one stream of ids cut
every ``length`` ids. The last, shorter part is cut into powers of two, so there is no padding at all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.sharding import curve_order
from trendloom.llm.textkit import batches, kept_for
from trendloom.operators.ordering import running_totals
from trendloom.sources.work import store

END = 1
BUCKETS, DIMS, BITS = 1 << 12, 3, 10
#: Low bits of the order that spread documents of one curve cell, so that a hot cell can be cut between ranges.
TIE_BITS = 30

# Fixed pattern of the tokenizer's own splitter, as it applies to lower-case text of PLAIN characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: ASCII and the Latin letters that are single characters in lower case too.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-įı-ſ]*")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(rest)) for b in range(256)}


class Young(dict):
    """A memo of two generations: entries not used while one generation filled are forgotten."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.old = entries, {}

    def missing(self, keys: set) -> list:
        """Keys that are not known; entries of the old generation move over."""
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        out = []
        for k in [k for k in keys if k not in self]:
            value = self.old.get(k)
            if value is None:
                out.append(k)
            else:
                self[k] = value
        return out


class Words:
    """Ids of texts, as bytes of unsigned 16-bit numbers; ids of word pieces are remembered per process.

    The tokenizer drops white space and merges only inside the pieces of its splitter, so a text's ids are those of its pieces
    in order. Plain texts are split here, and only pieces not seen lately reach the tokenizer's model, many at a time; all
    other texts go through the whole tokenizer, one by one.
    """

    def __init__(self, path: str, entries: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.last = np.zeros(1 << 16, bool)  # ids that end a piece
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.letters[32] = " "  # it parts the pieces below
        self.pieces = Young(entries)

    def _learn(self, pieces: set[str]) -> None:
        fresh = self.pieces.missing(pieces)
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            line = " ".join(part).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint16)
            raw, ends = ids.tobytes(), (2 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark word ends")
            self.pieces.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null has none."""
        split = [PIECES.findall(t.lower()) if t and "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        self._learn(set().union(*[s for s in split if s]))
        known = self.pieces.__getitem__
        return [
            b"".join(map(known, s)) if s is not None
            else np.array(self.whole.encode(t or "", add_special_tokens=False).ids, np.uint16).tobytes()
            for t, s in zip(texts, split)
        ]


_LOADED: dict[str, Words] = {}
kept_for("pieces", _LOADED.clear)


def words_of(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def projection(buckets: int = BUCKETS, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(buckets, dims)) / np.sqrt(buckets)


def bag(ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed bag of ids: square roots of bucket counts, scaled to unit length."""
    places = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)
    v = np.sqrt(np.bincount(places, minlength=buckets))
    return v / max(np.sqrt(len(ids)), 1.0)


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ids (unsigned 16-bit, little-endian, without the end id), their count with it, and the projected bag."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = words_of(vocabulary), projection()
        for batch in batches(found, owner="pieces"):
            coded = words.encode(batch.column("text").to_pylist())
            spots = np.array([bag(np.frombuffer(c, "<u2")) @ table for c in coded]).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(c) // 2 + 1 for c in coded], pa.int64()), pa.array(coded, pa.binary()),
                 *[pa.array(spots[:, k]) for k in range(DIMS)]],
                ["doc_id", "doc_tokens", "coded", *[f"x{k}" for k in range(DIMS)]],
            )

    kind = dict(docs.dtypes)["doc_id"]
    spots = ", ".join(f"x{k} double" for k in range(DIMS))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, coded binary, {spots}")


def tail_starts(total: int, length: int) -> list[int]:
    """Starts of the sequences behind the last full one: the rest is cut into falling powers of two."""
    at, rest, out = total - total % length, total % length, []
    while rest:
        out.append(at)
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
    return out


def cuts(start: int, tokens: int, length: int, tail: list[int], total: int) -> list[tuple[int, int, int, int]]:
    """(offset in the document, length, sequence, offset in the sequence) of the pieces of one document."""
    out, at, end, full = [], start, start + tokens, total // length
    edges = [*tail, total]
    while at < end:
        if at < full * length:
            seq, base = at // length, at - at % length
            stop = base + length
        else:
            k = max(i for i, e in enumerate(tail) if e <= at)
            seq, base, stop = full + k, edges[k], edges[k + 1]
        out.append((at - start, min(stop, end) - at, seq, at - base))
        at = min(stop, end)
    return out


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids along the curve; every id lies in exactly one piece.

    A document is its ids and one end id; null and empty texts have the end id alone. Ties on the curve are spread by a
    hash of the id and ordered by row; repeated rows are documents of their own; an empty table gives no rows; other columns
    are ignored. Positions come from running totals over ranges of the order: ids themselves are shuffled once,
    by row number, and no task sees more than a hash partition. ``with_ids`` adds the ids as little-endian 32-bit numbers.
    """
    coded = store(
        tokenized(docs, vocabulary).withColumn("_row_id", F.monotonically_increasing_id()), "packing-ids"
    )
    narrow = coded.select("_row_id", "doc_id", "doc_tokens", *[f"x{k}" for k in range(DIMS)])
    placed = curve_order(narrow, {f"{k}": F.col(f"x{k}") for k in range(DIMS)}, BITS).select(
        "_row_id",
        "doc_tokens",
        (F.shiftleft("curve", TIE_BITS) + F.xxhash64("doc_id").bitwiseAND((1 << TIE_BITS) - 1)).alias("_place"),
    )
    starts = running_totals(store(placed, "packing-order"), ["_place", "_row_id"], {"_upto": "doc_tokens"}).select(
        "_row_id", (F.col("_upto") - F.col("doc_tokens")).alias("_start")
    )
    total = coded.agg(F.sum("doc_tokens")).first()[0] or 0
    tail = tail_starts(total, length)

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, owner="pieces"):
            out = []
            for doc, tokens, raw, start in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "coded", "_start")]):
                ids = np.append(np.frombuffer(raw, "<u2"), END).astype("<u4")
                for at, size, seq, offset in cuts(start, tokens, length, tail, total):
                    part = ids[at : at + size].tobytes()
                    out.append((doc, at, size, zlib.crc32(part), tokens, seq, offset, part if with_ids else None))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [batch.schema.field("doc_id").type] + [pa.int64()] * 6 + [pa.binary()]
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = dict(docs.dtypes)["doc_id"]
    pieces = coded.select("_row_id", "doc_id", "doc_tokens", "coded").join(starts, "_row_id").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return pieces if with_ids else pieces.drop("ids")
