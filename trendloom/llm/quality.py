"""Quality scores of documents from Naive Bayes support vectors.

A document is the set of its hashed n-grams: byte n-grams, and runs of one word repeated. The indicators are scaled by the
class log-count ratios of the labelled sample, scaled to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. A logistic curve over margins of a part left out of the fit turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.textkit import ascii_words, batches

BITS = 18
SIZES = (1, 2, 3, 4)
RUNS = (2, 3, 4, 6, 9)
#: Documented bound of the labelled sample the model is fitted on; scoring covers all rows.
SAMPLE_ROWS = 4000


def features(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; ``flags`` is a scratch array of 2**BITS zeros."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    found = []
    rolled = np.zeros(0, np.uint32)
    for n in SIZES:
        if len(raw) < n:
            break
        rolled = raw if n == 1 else (rolled[:-1] << np.uint32(8)) | raw[n - 1 :]
        found.append(((rolled + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    words = ascii_words(text)
    run = longest = 1
    for same in map(eq, words, words[1:]):
        run = run + 1 if same else 1
        if run > longest:
            longest = run
    found.append(np.array([n for n in RUNS if n <= longest], np.uint32))
    for f in found:
        flags[f] = True
    out = np.flatnonzero(flags).astype(np.int32)
    flags[out] = False
    return out


@dataclass(frozen=True)
class Model:
    """Margin = sum of weights of a document's features / norm of its scaled indicators; probability by a logistic curve."""

    weights: np.ndarray
    ratios: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        norm = np.sqrt(np.square(self.ratios[found]).sum(dtype=np.float64))
        return float(self.weights[found].sum(dtype=np.float64) / norm) if norm else 0.0

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    sums = np.full((2, 1 << BITS), alpha)
    for found, y in zip(rows, labels):
        sums[int(y), found] += 1
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, c: float, rounds: int, seed: int) -> np.ndarray:
    """Weights of the L2-regularised hinge loss by dual coordinate descent (Hsieh et al., 2008)."""
    w = np.zeros(1 << BITS)
    alpha, sign = np.zeros(len(rows)), np.where(labels == 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            if not len(rows[k]):
                continue
            slack = sign[k] * (w[rows[k]] @ values[k]) - 1
            fresh = min(max(alpha[k] - slack, 0.0), c)  # the rows have unit length
            if fresh != alpha[k]:
                w[rows[k]] += (fresh - alpha[k]) * sign[k] * values[k]
                moved = max(moved, abs(fresh - alpha[k]))
                alpha[k] = fresh
        if moved < 1e-3:
            break
    return w


def _fit_weights(rows, labels, c, rounds, seed) -> tuple[np.ndarray, np.ndarray]:
    ratios = log_count_ratios(rows, labels)
    values = []
    for found in rows:
        v = ratios[found]
        norm = np.sqrt(v @ v)
        values.append(v / norm if norm else v)
    return descend(rows, values, labels, c, rounds, seed) * ratios, ratios


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's curve, with his smoothed targets, by damped Newton steps."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))])
    t = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(t @ x, -500, 500)))
        slope = x @ (p - target)
        bend = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        t = t - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(t[0], 1e-3)), float(t[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, rounds: int = 20, seed: int = 7) -> Model:
    """Fit on feature sets and 0/1 labels; with one class or no rows the score is that share (0.5 without rows)."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = labels.mean() if len(labels) else 0.5
        share = min(max(share, 0.001), 0.999)
        none = np.zeros(1 << BITS)
        return Model(none, none, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(len(rows)) % 4 == 3
    kept = [r for r, out in zip(rows, part) if not out]
    offset = (0.0, 0.0)
    weights, ratios = _fit_weights(rows, labels, c, rounds, seed)
    if len(set(labels[~part].tolist())) == 2 and len(set(labels[part].tolist())) == 2:
        inner = Model(*_fit_weights(kept, labels[~part], c, rounds, seed), 1.0, 0.0)
        tested, held = [r for r, out in zip(rows, part) if out], labels[part]
    else:
        inner, tested, held = Model(weights, ratios, 1.0, 0.0), rows, labels
    offset = _logistic(np.array([inner.margin(r) for r in tested]), held)
    return Model(weights, ratios, *offset)


def sample_features(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features and label of at most ``rows`` usable labelled documents, taken in hash order of their ids.

    Only this bounded list of ids is broadcast, so the documents are filtered where they are read. A document labelled
    twice counts as good if any label says so; null ids and labels are left out.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("quality").cast("long").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def find(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches(found):
            sets = [features(t, flags).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array(sets, pa.binary())], ["doc_id", "label", "found"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return texts.mapInArrow(find, f"doc_id {kind}, label long, found binary").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def remainder(c: str | Column, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo ``parts``; null for a null id."""
    return F.crc32((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled documents outside the held-out fold (crc32 of the id modulo ``folds`` is 0)."""
    got = sample_features(docs, labels, remainder("doc_id", folds) != 0, rows).collect()  # at most ``rows`` rows
    return fit([np.frombuffer(r["found"], np.int32) for r in got], np.array([r["label"] for r in got]))


def add_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text; null and empty texts get the score of no features."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches(found):
            out = [model.score(features(t, flags)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(score, schema)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    Labels, language, source and id are no inputs of a score. A null id is not held out. Repeated rows give repeated
    rows; other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, folds)
    return add_scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= least, 1).otherwise(0).cast("int").alias("predicted"),
    )
