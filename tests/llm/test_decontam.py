import hashlib
import random
import re

import pytest

from trendloom.llm.decontam import contamination

DOCS, ITEMS = "doc_id long, text string, item_id string, n int", "item_id long, text string, doc_id long"


def _words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _brute(docs, items):
    windows = {}
    for item, text, _ in items:
        w = _words(text)
        m = min(13, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[p : p + m]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w, hit, ids = _words(text), set(), set()
        for m in {len(k) for k in windows}:
            for p in range(len(w) - m + 1):
                found = windows.get(tuple(w[p : p + m]))
                if found is not None:
                    hit.update(range(p, p + m))
                    ids |= {str(i) for i in found if i is not None}
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def _cases():
    rng = random.Random(8)
    vocab = ["the", "of", "ärger", "Sun", "x1", "moon", "ÉTÉ"]
    phrase = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, phrase(rng.choice([1, 2, 3, 5, 12, 13, 14, 20, 40]) + 3 * (i > 3)), 7) for i in range(25)]
    items += [(100, None, 0), (101, "", 0), (102, "...", 0), (None, "unnamed item of five words here", 0), (5, "x1 of " * 9, 1), (103, items[8][1], 0)]
    docs = []
    for i in range(120):
        text = phrase(rng.randrange(0, 90))
        if i % 3 == 0:
            text += ", " + rng.choice(items)[1].upper() if (text := text) and rng.choice([True, False]) and items[i % 20][1] else ""
        if i % 4 == 0:
            text += "\n" + items[i % 20][1] + "! " + phrase(rng.randrange(0, 200))
        docs.append((i, text, "clash", 0))
    docs += [(200, None, "", 0), (201, "", "", 0), (202, "?!", "", 0), (None, "unnamed item OF five words here", "", 0), (203, "the " * 30_000, "", 0)]
    docs += [docs[4]] * 2 + [(4, "another text of the same id", "", 0)]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_agrees_with_brute_force(spark, limit):
    docs, items = _cases()
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_bytes=limit).collect()
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=str)
    assert rows == _brute(docs, items)
    assert any(r[5] for r in rows) and not all(r[5] for r in rows)


def test_empty_tables(spark):
    docs, items = _cases()
    none = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == len(docs) and not any(r["n_hit"] for r in none)
    assert contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []


def test_no_python_in_the_plan(spark):
    docs, items = _cases()
    plan = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
