"""Small helpers that the training-data operators share inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

from trendloom.session import prepare

#: Entries a per-process memo may hold before it is emptied; it bounds memory and never changes a result.
MEMO_ENTRIES = 250_000
#: What a Python worker keeps between tasks, by the operator that it is kept for.
_KEPT: dict[str, list[Callable[[], None]]] = {}


def kept_for(owner: str, forget: Callable[[], None]) -> None:
    """Register what ``forget`` frees as memory that only tasks of ``owner`` need."""
    _KEPT.setdefault(owner, []).append(forget)


def free_others(owner: str) -> None:
    """Free what this worker kept for other operators: workers serve the stages of one job after the other."""
    for name, known in _KEPT.items():
        if name != owner:
            for forget in known:
                forget()


def give_back() -> None:
    """Return freed memory to the system where the C library can: a worker serves later stages with what it holds now."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Memo(dict):
    """``key -> value`` computed once per Python worker, emptied whenever it is full or another operator's task begins."""

    def __init__(self, make: Callable[[bytes], bytes], owner: str, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries
        kept_for(owner, self.clear)

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.make(key)
        return value


WORD_HASHES = Memo(xxhash.xxh3_64_digest, "words")


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z only and split on the white space characters 0x20 and 0x09 to 0x0D; null has no words."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, one per place."""
    return np.frombuffer(b"".join(map(WORD_HASHES.__getitem__, words)), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n places; the whole run where there are fewer, none where there is nothing."""
    n = min(n, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    places = len(hashes) - n + 1
    out = np.full(places, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + places])
    return out


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, whatever its case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def ready(spark: SparkSession) -> SparkSession:
    """Prepare a session for tables of long texts: few rows to an Arrow batch, which lies in memory on both sides."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def batches(found: Iterator[pa.RecordBatch], rows: int = 256, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches to at most ``rows`` rows, so that long texts do not pile up in Python; memos of other owners are freed first."""
    free_others(owner)
    for batch in found:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
