import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trendloom.llm import lmscore

SCHEMA = "doc_id long, text string, score string, kind string"


def _docs():
    rng = random.Random(6)
    vocab = ["w%d" % int(rng.paretovariate(0.9)) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 80))).replace("w1 ", "W1\x0b"), "clash", "doc") for i in range(150)]
    rows += [(500 + i, "one common passage of every day that all share", "", "") for i in range(60)]
    rows += [(900, None, None, None), (901, "", "", ""), (902, "zzz\xa0y ÉTÉ " * 5000, "", ""), (3, rows[3][1], "", ""), (None, "no id here", "", "")]
    return rows


def _words(text):
    return [w.lower() for w in (text or "").encode().split()] + [None]


@pytest.mark.parametrize("parts,tokens", [(None, 10**6), (5, 300)])
def test_base_scores_are_exact_and_the_model_is_better_on_shared_text(spark, parts, tokens):
    docs = _docs()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, t, *_ in docs if not held(d) for w in _words(t))
    n, v = sum(counts.values()), len(counts)
    got = lmscore.score_documents(spark.createDataFrame(docs, SCHEMA), parts=parts, chunk_tokens=tokens).collect()
    want = []
    for d, t, *_ in docs:
        w = _words(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)))
    rows = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    shared = [r for r in got if r["doc_id"] is not None and 500 <= r["doc_id"] < 560]
    assert any(r["held_out"] for r in shared) and all(r["score"] > r["base_score"] + 5 for r in shared)
    assert all(r["score"] < 0 for r in got)


def test_filter_never_understates_and_rarely_overstates():
    rng = np.random.default_rng(1)
    h = lmscore.mix(np.arange(60_000, dtype=np.uint64))
    counts = rng.zipf(1.7, len(h)).clip(1, 10**6)
    parts = 3
    where = lmscore.part_of(h, parts)
    blocks = {p: lmscore.build_block(lmscore.key_of(h[where == p], True), counts[where == p]) for p in range(parts)}
    assert sum(map(len, blocks.values())) * 64 >= 8 * lmscore.level_of(counts).sum()
    book = lmscore.Filter(blocks, 0, parts - 1)
    got, want = book.levels(where, lmscore.key_of(h, True)), lmscore.level_of(counts)
    assert (got >= want).all() and (got > want).mean() < 0.12
    absent = lmscore.mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))
    assert (book.levels(lmscore.part_of(absent, parts), lmscore.key_of(absent, True)) > 0).mean() < 0.12
    some = lmscore.Filter({2: blocks[2]}, 1, 2)  # a slice; part 1 without members
    two = where == 2
    assert (some.levels(where[two], lmscore.key_of(h[two], True)) == got[two]).all()
    assert not some.levels(where[where == 1], lmscore.key_of(h[where == 1], True)).any()
    values = lmscore.level_values()
    assert all(values[q] / 1.5 <= c <= values[q] * 1.5 for c in (1, 2, 3, 7, 1000, 123_456) for q in [int(lmscore.level_of(np.array([c]))[0])])


def test_numbers_round_trip_and_empty_table(spark):
    x = np.array([0, 1, 255, 256, 2**32 - 1], np.uint32)
    assert (lmscore.expand(lmscore.squeeze(x)) == x).all()
    assert lmscore.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pairs_are_kept_whatever_the_number_of_parts(spark):
    text = " ".join(f"word{'x' * (k % 40)}" for k in range(40_000))
    docs = spark.createDataFrame([(i, text, "", "") for i in (1, 2, 3)], SCHEMA)
    for parts in (6, 6_000_000):
        got = lmscore.score_documents(docs, parts=parts).collect()
        assert len(got) == 3 and all(r["score"] > r["base_score"] / 2 for r in got)


@pytest.mark.parametrize("slice_bytes", [lmscore.SLICE_BYTES, 2000])
def test_scores_agree_with_a_plain_model(spark, slice_bytes):
    docs = _docs()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    words, pairs = Counter(), Counter()
    for d, t, *_ in docs:
        if not held(d):
            w = _words(t)
            words.update(w)
            pairs.update(zip([None, *w], w))
    n, v, values = sum(words.values()), len(words), lmscore.level_values()

    def chance(a, b):
        single, k = (words[b] + 0.1) / (n + 0.1 * (v + 1)), pairs[a, b]
        seen = values[lmscore.level_of(np.array([k]))[0]] if k else 0
        return math.log10(0.8 * single + 0.2 * min(seen / words[a], 1) if words[a] else single)

    want = sorted((str(d), sum(chance(a, b) for a, b in zip([None, *_words(t)], _words(t)))) for d, t, *_ in docs)
    got = sorted((str(r["doc_id"]), r["score"]) for r in lmscore.score_documents(spark.createDataFrame(docs, SCHEMA), parts=4, chunk_tokens=700, slice_bytes=slice_bytes).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    # The filter may overstate a few pairs and never understates one.
    assert all(x >= y - 1e-6 for (_, x), (_, y) in zip(got, want))
    assert abs(sum(x for _, x in got) / sum(y for _, y in want) - 1) < 0.02


def test_scores_come_from_the_filter(spark, monkeypatch):
    """Without its members the model knows words alone."""
    docs = spark.createDataFrame(_docs(), SCHEMA)
    full = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lmscore.score_documents(docs, parts=4).collect()}
    monkeypatch.setattr(lmscore, "build_block", lambda keys, counts: np.zeros(1, np.uint64))
    for r in lmscore.score_documents(docs, parts=4).collect():
        single = r["base_score"] + (r["n_tokens"] * math.log10(0.8))
        assert r["score"] == pytest.approx(single, abs=abs(math.log10(0.8)) * r["n_tokens"]) and r["score"] < full[r["doc_id"], r["n_tokens"]] + 1e-9


def test_ids_of_any_type(spark):
    for kind, ids in (("smallint", [1, 2, None]), ("string", ["a", "b", None]), ("int", [7, 8, None])):
        docs = spark.createDataFrame([(i, "some words here") for i in ids], f"doc_id {kind}, text string")
        got = lmscore.score_documents(docs)
        assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and {r["doc_id"] for r in got.collect()} == set(ids)


def _peak(make):
    tracemalloc.start()
    out = make()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_what_a_task_makes_on_the_way_stays_small():
    """Beside its input and output, a part's block takes some bytes a pair, and a closed chunk some bytes a token."""
    rng = np.random.default_rng(4)
    counts = rng.zipf(1.7, 1_000_000).clip(1, 10**6)
    keys = lmscore.key_of(np.arange(len(counts), dtype=np.uint64), True)
    assert _peak(lambda: lmscore.build_block(keys, counts))[1] < 20 * len(keys)
    numbers = lmscore._Numbers({b"w%d" % k if k else lmscore.END: k for k in range(2000)})
    docs = [(i, False, rng.integers(0, 2000, 1000, np.int32)) for i in range(1000)]
    list(lmscore._close(0, docs[:1], numbers, 3, pa.int64()))  # imports
    rows, peak = _peak(lambda: list(lmscore._close(0, docs, numbers, 3, pa.int64())))
    assert peak - sum(r.nbytes for r in rows) < 40 * 1000 * 1000


def test_tallied_sums_counts_by_key():
    rng = np.random.default_rng(5)
    found = [(rng.integers(0, 50, n).astype(np.uint64) << np.uint64(32)) | rng.integers(1, 9, n).astype(np.uint64) for n in (0, 40, 300)]
    want = Counter()
    for x in np.concatenate(found).tolist():
        want[x >> 32] += x & 0xFFFFFFFF
    keys, times = lmscore._tallied(found)
    assert dict(zip(keys.tolist(), times.tolist())) == want and found == [] and (np.diff(keys.astype(int)) > 0).all()
    assert [len(x) for x in lmscore._tallied([])] == [0, 0]
