import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from trendloom.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, c string, d string, size string, parent string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(c - 5 * int(c / 5)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children, out = defaultdict(list), {}
    for key in members:
        if key:
            children[key[:-1]].append(key)
    for key in sorted(members, key=len, reverse=True):
        kids = [out[k] for k in children[key]]
        saved = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        ends = ",".join(str(c) for c in sorted(members[key]) if built[c] == key)
        out[key] = (
            min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(kids),
            sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    got = convtrie.prefix_trie(df, **options)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=repr)


def conversations(seed, size):
    rng = random.Random(seed)
    rows = []
    for c in range(size):
        if rng.random() < 0.9:
            rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "é", "cc"])) for t in range(rng.randrange(1, 9))]
    return rows


@pytest.fixture(scope="module")
def rows():
    out = conversations(1, 60)
    out += [(c, t, "user", "the same words") for c in range(100, 140) for t in range(3)]
    out += [(200, t, "user", f"long {t % 3}") for t in range(150)]  # a chain
    out += [(None, 1, "user", "no conversation"), (210, None, None, None), (210, None, "user", ""), (210, 0, "user", "x")]
    out += [(215, 1, "user", "again")] * 12 + [(216, 5, "user", "tie"), (216, 5, "bot", "tie"), (-3, 1, "user", "minus")]
    out += [(217, 0, "user", "long " * 30_000)]
    random.Random(2).shuffle(out)
    return out


@pytest.mark.parametrize("local_nodes", [convtrie.LOCAL_NODES, 25])
def test_nodes_equal_brute_force(spark, rows, local_nodes):
    assert run(spark, rows, local_nodes=local_nodes) == plain(rows)


def test_blocks_of_turns_and_ids(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK_TURNS", 4)
    monkeypatch.setattr(convtrie, "BLOCK_IDS", 2)
    rows = conversations(3, 12) + [(c, 0, "user", "hot") for c in range(-9, 30)]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


def test_finish_sums_random_trees_and_splits_in_halves():
    rng = random.Random(7)
    for n in (1, 2, 30, 200):
        parent = [None] + [rng.choice([i - 1, rng.randrange(i)]) for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        value, weight = [rng.randrange(10) for _ in range(n)], [1] * n
        want = list(value)
        for i in range(n - 1, 0, -1):
            want[parent[i]] += want[i]
            weight[parent[i]] += weight[i]
        nodes = [(i, depth[i], parent[i], 0, 0, weight[i], (value[i],), (100,)) for i in range(n)]
        got = {r[0]: r[2] for r in convtrie.finish(nodes, 1)}
        assert got == {i: want[i] + 100 for i in range(n)}
