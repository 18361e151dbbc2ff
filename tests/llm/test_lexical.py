import math
import random
import re
from collections import Counter

import numpy as np

from trendloom.llm import lexical

SCHEMA = "doc_id long, text string, item_id string, n string, rank string"
ITEMS = "item_id long, text string, doc_id string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in counts if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
                for w in set(plain_terms(text)) if c[w]
            )
            if s > 0:
                found.append((-s, math.inf if d is None else d))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "x'y", "a_b", "12", "日本", "K", "k", "\x1c"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.randrange(0, 60)))) for i in range(size)]
    docs += [(size + i, "w1 w7 w30 hot copies of one text") for i in range(80)]
    docs += [(3, docs[3][1]), (None, "w5 w6 w7"), (9_000, None), (9_001, ""), (9_002, "w2 " * 20_000), (9_003, "!?")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(25)]
    items += [(100, "w1 w7 w30 hot copies"), (101, None), (102, "..."), (103, "nowhere"), (4, "w1 w2"), (104, "W1, W2")]
    return docs, items


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_ranks_equal_brute_force_for_any_shards_and_groups(spark):
    docs, items = corpus(1, 500)
    want = plain(docs, items, 50)
    d = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in docs], SCHEMA)
    q = spark.createDataFrame([(a, b, "x", "y") for a, b in items], ITEMS)
    assert got(lexical.search(d, q)) == want
    assert got(lexical.search(d, q, most_docs=40)) == want
    assert got(lexical.search(d, q, group_bytes=400)) == want
    assert got(lexical.search(d, q, k=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(2, 10)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    none = "doc_id long, text string", "item_id long, text string"
    assert got(lexical.search(spark.createDataFrame([], none[0]), q)) == []
    assert got(lexical.search(d, spark.createDataFrame([], none[1]))) == []
    assert got(lexical.search(spark.createDataFrame([(1, None)], none[0]), q)) == []


def _shard(rng, size):
    docs = [np.sort(rng.choice(200, size=rng.integers(1, 40), replace=False)) for _ in range(size)]
    sizes = np.array([len(t) for t in docs])
    terms, values = np.concatenate(docs).astype(np.uint32), rng.integers(0, 1_000_000, sizes.sum())
    weights = np.sort(rng.integers(0, 9000, 200))[::-1].copy()
    return lexical.make_shard(np.arange(size), sizes, terms, values, weights), weights


def test_bounds_hold_and_blocks_are_skipped():
    rng = np.random.default_rng(5)
    made, weights = _shard(rng, 900)
    shard = lexical.Shard(made)
    skipped = 0
    for _ in range(20):
        terms = np.sort(rng.choice(200, size=12, replace=False))
        by_term = np.zeros(200, np.int64)
        by_term[terms] = weights[terms]
        blocks, bounds = shard.bounds(terms, weights)
        scores = shard.scores(np.arange(900), by_term)
        owner = {}
        for place, block in enumerate(blocks):
            for doc in shard.members(np.array([block])):
                owner.setdefault(int(doc), place)  # the lists come in the order of terms
        assert all(scores[doc] <= bounds[place] for doc, place in owner.items())
        assert {d for d in range(900) if scores[d] > 0} <= set(owner)
        best = lexical.Best(5, int(np.sort(scores)[-5]))
        met, done = lexical.search_shard(shard, terms, weights, best, False)
        skipped += met - done
        want = np.lexsort((shard.ids, -scores))[:5]
        assert best.ids.tolist() == shard.ids[want].tolist() and best.scores.tolist() == scores[want].tolist()
    assert skipped > 0


def test_blocks_hold_similar_documents():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, 2000)
    points = np.eye(4)[kinds] + rng.normal(scale=0.05, size=(2000, 4))
    order = lexical.similar_order(points.astype(np.float32))
    assert sorted(order.tolist()) == list(range(2000))
    runs = kinds[order].reshape(-1, 50)
    assert sum((r == r[0]).all() for r in runs) > len(runs) * 3 // 4
