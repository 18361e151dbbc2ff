import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trendloom.llm import dac

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, value string, n string"


def opened(ids, widths=None):
    widths, raw = dac.encode(ids, widths)
    return dac.Codes(memoryview(raw), widths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.randoms())
def test_any_id_and_any_run_come_back(values, rng):
    ids = np.array(values, np.uint32)
    for widths in (None, [8, 24], [3, 5, 24]):
        codes = opened(ids, widths)
        assert codes.run(0, len(ids)).tolist() == values
        places = [rng.randrange(len(ids)) for _ in range(20)] if values else []
        assert codes.at(np.array(places, int)).tolist() == [values[p] for p in places]
        a = rng.randrange(len(ids) + 1)
        b = rng.randrange(a, len(ids) + 1)
        assert codes.run(a, b).tolist() == values[a:b]


def test_widths_are_the_smallest(spark):
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.4, 30_000), 49_407).astype(np.uint32)
    sizes = {(a, 16 - a): len(dac.encode(ids, [a, 16 - a])[1]) for a in range(1, 16)}
    assert len(dac.encode(ids)[1]) <= min(sizes.values()) + 64 < 2 * len(ids)


def test_crc_of_joined_strings():
    for a, b in ((b"", b""), (b"abc", b""), (b"", b"xyz"), (b"head" * 999, b"tail" * 12345)):
        assert dac.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["sun", "moon,", "Ärger", "x1", "of", "日本"], k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(-7, "negative"), (1000, None), (1001, ""), (1002, "word and word " * 3000), (5, "another five"), (None, "no id")]
    docs += [(2000, "hot copy of one row")] * 200
    rng.shuffle(docs)
    return docs


def plain(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("segment_ids", [dac.SEGMENT_IDS, 500])
def test_files_read_back(spark, tmp_path, rows, segment_ids):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA).repartition(7)
    dac.write_tokens(df, path, PATH, segment_ids=segment_ids)
    got = [tuple(r) for r in dac.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    got.sort(key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    spots = [i for i, d in enumerate(ids) if d == 5]
    texts = {d: t for d, t in rows if d != 5}
    fives = sorted((t for d, t in rows if d == 5), key=lambda t: plain([(5, t)])[0][2])
    fives = fives if got[spots[0]][2] <= got[spots[1]][2] else fives[::-1]
    want = plain([(d, fives[spots.index(i)] if d == 5 else texts[d]) for i, d in enumerate(ids)])
    assert got == [w[:4] for w in want]
    every = [t for w in want for t in w[4]]
    places = [0, len(every) - 1, *random.Random(1).sample(range(len(every)), 50), 3, 3, -1, len(every)]
    found = dac.read_tokens(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted(map(tuple, found)) == [(p, every[p]) for p in sorted({*places} - {-1, len(every)})]


def test_several_ranges_and_files(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(dac, "RANGE_BYTES", 9000)
    monkeypatch.setattr(dac, "FILE_SEGMENTS", 2)
    path = str(tmp_path / "t")
    kept = [r for r in rows if r[0] != 5]
    dac.write_tokens(spark.createDataFrame(kept, "doc_id long, text string"), path, PATH, segment_ids=700)
    assert dac.ranges(spark, path).count() > 3 and len(list((tmp_path / "t").glob("part-*"))) > 8
    got = sorted((tuple(r) for r in dac.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in plain(sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0)))]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    dac.write_tokens(spark.createDataFrame([], SCHEMA), path, PATH)
    assert dac.read_documents(spark, path).collect() == []


def test_a_cut_file_is_noticed():
    raw = dac.make_segment(0, 0, np.arange(100, dtype=np.uint32), [(1, 0, 100)])
    assert next(dac.segments(memoryview(raw))).codes.run(0, 100).tolist() == list(range(100))
    with pytest.raises(ValueError):
        dac.Segment(memoryview(raw)[:-3])
