import random

import numpy as np
import pytest

from trendloom.llm import ngramjoin
from trendloom.llm.components import components

SCHEMA = "doc_id long, text string, class_id string, n int"


def _set(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def _brute(rows, num=75, den=100):
    sets = {d: _set(t) for d, t, *_ in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sorted(sets) if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d if d is not None else -1, len(_set(t)), find(d) if d is not None else -1) for d, t, *_ in rows)


def _rows(seed, originals=60, near=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    hot = " ".join(rng.choices(vocab, k=30))
    rows, k = [], 0
    for _ in range(originals):
        words = rng.choices(vocab, k=rng.choice([3, 6, 12, 40, 120]))
        if rng.random() < 0.4:
            words = words[: len(words) // 2] + hot.split() + words[len(words) // 2 :]
        for _ in range(rng.randrange(1, near + 1)):
            text = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            if rng.random() < 0.3:
                text = text[: max(1, int(len(text) * rng.uniform(0.7, 1.0)))]
            rows.append((k * 3 % 1009, " ".join(text).replace("w1 ", "W1\t") + rng.choice(["", " ", "\n"]), "clash", 1))
            k += 1
    return rows


def _got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"])
                  for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed):
    rows = _rows(seed)
    rows += [(5000, None, None, None), (5001, "", "", 0), (5002, " \n", "", 0), (5003, "one", "", 0), (5004, "ONE", "", 0), (5005, "one two", "", 0)]
    rows += [(6000, "long " * 3000 + "tail of it", "", 0), (6001, "long " * 2900 + "tail of it", "", 0), (None, rows[0][1], "", 0), rows[3]]
    got = ngramjoin.similar_texts(spark.createDataFrame(rows, SCHEMA), parts=3)
    assert _got(got) == _brute(rows)


def test_large_near_copy_group_and_borderline_members(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words), "", 0))
    rows += [(1000 + i, rows[7][1], "", 0) for i in range(100)]
    assert _got(ngramjoin.similar_texts(spark.createDataFrame(rows, SCHEMA), gather=500)) == _brute(rows)


def test_blocks_skip_without_losing_pairs():
    rng = np.random.default_rng(3)
    low = rng.integers(20, 400, 700)
    token = np.sort(rng.integers(0, 6, 700).astype(np.uint64))
    order = np.lexsort((low, token))
    low, place = low[order], rng.integers(0, 100, 700) % np.maximum(low[order] // 4, 1)
    cluster, side = np.arange(700), np.zeros(700, int)
    got = {(int(a), int(b)) for i, j in ngramjoin.list_pairs(token, cluster, place, low, low, side, 75, 100) for a, b in zip(i, j)}
    want = {
        (i, j) for i in range(700) for j in range(i + 1, 700)
        if token[i] == token[j] and ngramjoin._fits(place[i], low[i], low[i], place[j], low[j], low[j], 75, 100)
    }
    assert {tuple(sorted(p)) for p in got} == want


def test_hot_tokens_meet_in_cells(spark):
    rows = _rows(5, originals=25)
    assert _got(ngramjoin.similar_texts(spark.createDataFrame(rows, SCHEMA), parts=2, room=4)) == _brute(rows)


def test_empty_table_and_components(spark):
    assert ngramjoin.similar_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 240)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(7, 7)]
    root = list(range(300))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    links = spark.createDataFrame([*edges, *edges[:5], (None, 3)], "a long, b long")
    for local in (0, 1_000_000):  # by rounds over all tasks, and by one task
        got = components(links, local=local).collect()
        assert len(got) == len({r["node"] for r in got})
        assert {r["node"]: r["component"] for r in got} == {v: root[v] for e in edges for v in e if e[0] != e[1]}
        assert components(links.limit(0), local=local).collect() == []


def test_memos_of_other_operators_are_freed():
    from trendloom.llm import linededup, textkit

    textkit.word_hashes([b"a", b"b"])
    linededup.MASKED[b"c"]
    list(textkit.batches(iter([]), owner="words"))
    assert textkit.WORD_HASHES and not linededup.MASKED
    list(textkit.batches(iter([])))
    assert not textkit.WORD_HASHES
