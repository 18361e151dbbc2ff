import zlib
from collections import Counter, defaultdict

import numpy as np

from trendloom.llm.hilbert import hilbert_index
from trendloom.llm.sharding import shard_documents, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
        h = hilbert_index(list(grid), bits)
        assert sorted(h) == list(range(1 << (dims * bits)))
        assert (np.abs(np.diff(grid[:, np.argsort(h)], axis=1)).sum(0) == 1).all()


def _check(rows, got, shards):
    assert len(got) == len(rows)
    counts, slots = Counter(r["shard"] for r in got), defaultdict(list)
    assert not got or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((i if i is not None else -1), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["size"], r["text_crc32"]) for r in got) == want


def test_counts_slots_and_checksums(spark):
    rows = [(i, "t é" * (i % 50), ["en", "de"][i % 2], f"src{i % 7}", i, "clash") for i in range(500)]
    rows += [(1000 + i, "copy", "en", "hot", 4, None) for i in range(300)]
    rows += [(None, None, None, None, None, None), (7, "", "", "", 0, ""), (7, "", "", "", 0, ""), (8, "w " * 200_000, "en", "s", 1, "")]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), 24).collect()
    _check(rows, got, 24)


def test_few_rows_and_no_rows(spark):
    rows = [(i, "a", "en", "s", 1, "") for i in range(5)]
    _check(rows, shard_documents(spark.createDataFrame(rows, SCHEMA), 24).collect(), 24)
    assert shard_documents(spark.createDataFrame([], SCHEMA), 24).collect() == []


def test_runs_are_narrow_and_files_hold_one_shard(spark, tmp_path):
    rows = [(i, "w" * ((i * 37) % 400), ["de", "en", "fr"][i % 3], f"s{(i * 7) % 11}", 0, "") for i in range(1200)]
    df = shard_documents(spark.createDataFrame(rows, SCHEMA), 24)
    lang = {r[0]: r[2] for r in rows}
    seen = defaultdict(set)
    for r in df.collect():
        seen[r["shard"]].add(lang[r["doc_id"]])
    assert np.mean([len(s) for s in seen.values()]) < 2.5  # three languages in every shard without the curve
    write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1200
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("shard=")]) == 24


def test_sources_that_begin_alike_are_told_apart(spark):
    """A reader that wants one source opens few shards, also where all sources share a long beginning."""
    rows = [(i, "w" * (i % 9), "en", f"https://host.example.org/part-{i * 7 % 12:02d}", 0, "") for i in range(1200)]
    source, seen = {r[0]: r[3] for r in rows}, defaultdict(set)
    for r in shard_documents(spark.createDataFrame(rows, SCHEMA), 24).collect():
        seen[source[r["doc_id"]]].add(r["shard"])
    assert np.mean([len(s) for s in seen.values()]) < 8


def test_shards_are_runs_of_the_plainly_sorted_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w" * int(rng.integers(0, 300)), ["de", "en", "fr"][i % 3], f"source-{int(rng.integers(0, 40)):03d}", 0, "") for i in range(700)]
    rank = lambda k: {v: n for n, v in enumerate(sorted({r[k] for r in rows}))}
    lang, source = rank(2), rank(3)
    points = np.array([(lang[r[2]], source[r[3]], len(r[1]) + 8) for r in rows], float)
    cells = []
    for column in points.T:
        ordered = np.sort(column)
        bounds = [ordered[-(-k * len(ordered) // 256) - 1] for k in range(1, 256)]  # least value with k / 256 of the rows up to it
        cells.append(np.searchsorted(bounds, column, side="right"))
    curve = hilbert_index(cells, 8)
    order = sorted(range(len(rows)), key=lambda n: (curve[n], zlib.crc32(rows[n][1].encode()), rows[n][0]))
    small, spare = divmod(len(rows), 24)
    want, at = {}, 0
    for shard in range(24):
        for slot in range(small + (shard < spare)):
            want[rows[order[at]][0]] = (shard, slot)
            at += 1
    got = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), 24).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want
