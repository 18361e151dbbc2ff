import os
import sys

import numpy as np
import pytest
import zlib
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
import test_decontam  # noqa: E402
import test_linededup  # noqa: E402
import test_ngramjoin  # noqa: E402
import test_packing  # noqa: E402
from trendloom.llm import quality  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_agrees_with_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"], 0) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, kept[-1], FOLDER).write.parquet(out)
        kept.append(spark.read.parquet(out))
        assert k == 4 or kept[-1].columns == columns
    rows = [_rows(d) for d in kept[:-1]]

    order = quality.sample_features(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), quality.remainder("doc_id", 5) != 0).collect()
    flags, text = np.zeros(1 << quality.BITS, bool), dict(rows[0])
    used = [r["doc_id"] for r in order]
    assert all(zlib.crc32(str(d).encode()) % 5 for d in used)
    model = quality.fit([quality.features(text[d], flags) for d in used], np.array([labels[d] for d in used]))
    assert sorted(rows[1]) == sorted((d, t) for d, t in rows[0] if model.score(quality.features(t, flags)) >= 0.3)
    bad = [d for d, t in rows[0] if labels.get(d) == 0]
    assert bad and len([d for d, _ in rows[1] if labels.get(d) == 0]) < 0.1 * len(bad)

    before = dict(rows[1])
    plain = [(d, t) for d, t in test_linededup.plain(rows[1]) if t == before[d] or t.strip()]
    assert sorted(rows[2]) == sorted(plain) and len(plain) and sorted(plain) != sorted(rows[1])

    groups = {d: c for d, _, c in test_ngramjoin._brute(rows[2])}
    assert sorted(rows[3]) == sorted((d, t) for d, t in rows[2] if groups[d] == d)

    hit = {r[0] for r in test_decontam._brute(rows[3], items) if r[5]}
    assert sorted(rows[4]) == sorted((d, t) for d, t in rows[3] if d not in hit)

    test_packing._check(rows[4], kept[5].collect(), Tokenizer.from_file(test_packing.PATH), 2048)


def test_run_and_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, empty, FOLDER)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, empty, FOLDER).count() == 0


def test_nulls_and_repeated_rows_in_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "some words of text to keep in here", "en", None, 3), (2, "", "", "", 0),
            (3, "alpha beta gamma delta epsilon zeta", "en", "s", 1)] + [(3, "alpha beta gamma delta epsilon zeta", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), schema)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows[:4])


def test_rows_that_share_an_id_lose_no_text(spark):
    texts = ["one two three four five six seven", "quite another text with other words in it", "a third one that shares nothing with them"]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[2]), (5, texts[0]), (7, texts[1]), (None, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, FOLDER).collect()))
    assert got == sorted([(0, texts[0]), (0, texts[0]), (5, texts[0]), (5, texts[1]), (6, texts[2])])


def test_clashing_names_in_every_stage(spark):
    names = ["_score", "_digest", "_cut", "n_lines", "n_dropped", "_key", "_number", "_id", "_n", "component_id", "text_key", "contaminated"]
    texts = ["first words here and more of them\na line that recurs in all of them", "other words there and less of those\na line that recurs in all of them"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.schema == docs.schema, name
        for r in out.collect():
            assert [r[c] for c in names] == [f"{c}{r['doc_id']}" for c in names], name
    assert corpus_pipeline.pack(spark, docs, FOLDER).select("doc_id").distinct().count() == 2
