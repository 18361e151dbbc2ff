import random
import zlib

import numpy as np

from trendloom.llm import quality

DOCS, LABELS = "doc_id long, text string, lang string, label string, score string", "doc_id long, quality int, toxic int"


def _texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for k in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(20, 120)))
        bad = k % 4 == 0
        if bad:
            text = [text.upper() + "!!", " ".join(w + "%%%" for w in text.split()), " ".join([text.split()[0]] * 60)][k % 3]
        out.append((text, int(not bad)))
    return out


def test_held_out_accuracy_and_empty_cases(spark):
    made = _texts(600)
    docs = [(i, t, "en", "1", "x") for i, (t, _) in enumerate(made)]
    docs += [(9001, None, None, None, None), (9002, "", "", "", ""), (None, "no id", "", "", ""), (9003, "word " * 50_000, "", "", "")]
    docs += [docs[5]] * 2
    labels = [(i, y, 0) for i, (_, y) in enumerate(made)] + [(None, 1, 0), (3, None, None), (77_777, 0, 0)]
    got = quality.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    tested = [(r["predicted"], made[r["doc_id"]][1]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(tested) > 80 and np.mean([a == b for a, b in tested]) > 0.97


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, "text", "", "", "")], DOCS)
    assert [r["score"] for r in quality.score_documents(one, none).collect()] == [0.5]
    assert quality.score_documents(spark.createDataFrame([], DOCS), none).collect() == []


def test_descent_reaches_the_optimum_of_the_dual():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(60)]
    values = [np.full(8, 8**-0.5) for _ in rows]
    labels = np.array([int(r.min() < 5) for r in rows])
    w = quality.descend(rows, values, labels, 1.0, 2000, 1)[:50]
    x = np.zeros((60, 50))
    for k, r in enumerate(rows):
        x[k, r] = values[k]
    sign = np.where(labels == 1, 1, -1)
    primal = lambda v: 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v)).sum()
    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(scale=0.02, size=50)) >= best - 1e-3


def test_features_are_a_set():
    flags = np.zeros(1 << quality.BITS, bool)
    a = quality.features("ab ab ab ab", flags)
    assert len(a) == len(set(a.tolist())) and not flags.any()
    assert len(quality.features(None, flags)) == len(quality.features("", flags)) == 0
