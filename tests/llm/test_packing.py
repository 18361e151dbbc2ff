import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trendloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(4)
    words = ["The", "don't", "we'LL", "x's", "\"'s", "it''re", "ÄÖß", "éclair", "İstanbul", "ΣΟΦΟΣ", "<|endoftext|>", "<|ENDOFTEXT|>",
             "12,5%", "a_b", "&&&", "日本語", "é", " ", "\x1c", "µm", "¿qué?", "😀", "ſ", "Ÿ", "ŉ", "tion,***", "ª", "\x7f", "\x85"]
    texts = ["", " ", "  \n"] + ["".join(rng.choices(words + [" "] * 12 + ["\n"], k=rng.randrange(1, 40))) for _ in range(800)]
    texts += [w for w in words] + ["long words " * 20_000]
    small = packing.Words(PATH, entries=50)
    for chunk in (texts, texts):
        for t, raw in zip(chunk, small.encode(chunk)):
            assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def _check(rows, got, tokenizer, length):
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        assert sum(p["length"] for p in parts) == sum(map(len, want[doc]))
        if len(want[doc]) > 1:
            continue
        ids, at = want[doc][0], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            piece = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(piece))
            at += p["length"]
    sizes = []
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
        assert at <= length
    assert all(s == length or s & (s - 1) == 0 for s in sizes) and sorted(by_seq) == list(range(len(by_seq)))
    return sizes


def test_pieces_cover_every_id_once(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["sun", "moon,", "Ärger", "x1", "of"], k=rng.randrange(0, 60))), "c", "c") for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "", ""), (1002, "word and word " * 3000, "", ""), (5, rows[5][1], "", ""), (None, "no id", "", "")]
    rows += [(2000 + i, "hot copy of one text", "", "") for i in range(150)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 64).collect()
    sizes = _check(rows, got, tokenizer, 64)
    assert sum(s != 64 for s in sizes) <= 6
    seqs = {r["sequence_id"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 2000}
    assert len(seqs) <= 150 * 6 // 64 + 3  # copies are neighbours on the curve


def test_ids_on_request_and_empty_table(spark):
    got = packing.pack(spark.createDataFrame([(1, "a b", "", "")], SCHEMA), PATH, 2048, with_ids=True).collect()
    assert b"".join(bytes(r["ids"]) for r in sorted(got, key=lambda r: r["start"]))[-4:] == (1).to_bytes(4, "little")
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
