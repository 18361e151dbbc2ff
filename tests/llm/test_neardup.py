import numpy as np
import pytest

from trendloom.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, raw string"


def _rows(seed, n=240, dim=24):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    while k < n:
        v = rng.normal(size=dim)
        for _ in range(rng.integers(1, 7)):
            w = v + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12, 0.18, 0.25])
            w = w * rng.choice([1.0, 3.0])
            rows.append((int(k * 7 % 2003), [float(np.float32(x)) for x in w], int(rng.integers(0, 2)), "clash", ""))
            k += 1
    same = [float(np.float32(x)) for x in rng.normal(size=dim)]
    rows += [(3000 + i, same, 1, "", "") for i in range(60)] + [(3100, same, 0, "", "")]
    near = np.array(same)
    rows += [(4000 + i, [float(np.float32(x)) for x in near + rng.normal(size=dim) * 0.02], 1, "", "") for i in range(60)]
    rows += [
        (5000, None, 1, None, None), (5001, [], 1, "", ""), (5002, [0.0] * dim, 1, "", ""), (5003, [None] * dim, 1, "", ""),
        (5004, [float("nan")] * dim, 1, "", ""), (5005, [float("inf")] * dim, 1, "", ""), (5006, same, None, "", ""),
        (None, same, 1, "", ""), (5007, same[:5], 1, "", ""), (5008, [2 * x for x in same[:5]], 1, "", ""), (5009, [1.0], 1, "", ""), (5010, [2.0], 1, "", ""),
    ]
    return rows


def _brute(rows, least):
    good = [(i, np.array(v, float), lab) for i, v, lab, *_ in rows
            if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, u, p) in enumerate(good):
        for b, v, q in good[k + 1 :]:
            if p == q and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i if i is not None else -1), links[i], (find(i) if i is not None else -1), find(i) == i) for i in root)


@pytest.mark.parametrize("seed,lead,block", [(1, None, 1024), (2, 3, 16), (3, 5, 7)])
def test_agrees_with_brute_force(spark, seed, lead, block):
    rows = _rows(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.98, lead, block).collect()
    mine = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["n_links"], (-1 if r["component_id"] is None else r["component_id"]), r["kept"])
                  for r in got)
    assert mine == _brute(rows, 0.98)
    assert max(r["n_links"] for r in got) >= 119


def test_cells_reach_every_near_pair_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * 0.2
    rows, cells, home = neardup.reach_cells(x, 0.2, 0.2)
    at = {}
    for r, c, h in zip(rows, map(tuple, cells), home):
        at.setdefault(c, ([], []))[0 if h else 1].append(int(r))
    met = set()
    for own, guests in at.values():
        pairs = [(a, b) for k, a in enumerate(own) for b in own[k + 1 :]] + [(a, b) for a in own for b in guests]
        for a, b in pairs:
            assert (min(a, b), max(a, b)) not in met
            met.add((min(a, b), max(a, b)))
    for a in range(300):
        for b in range(a + 1, 300):
            if np.linalg.norm(x[a] - x[b]) <= 0.2:
                assert (a, b) in met


def test_repeated_rows_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, "", ""), (1, v, 0, "", ""), (2, v, 0, "", "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
