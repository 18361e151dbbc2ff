import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trendloom.llm.linededup import MASKED, _lines, drop_recurring, join_templates, line_keys, masked, split_lines

SCHEMA = "doc_id long, text string, n_chars long, n_lines string, template string"


def _mask(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in line.split())


def _run(spark, rows, **kw):
    got = drop_recurring(spark.createDataFrame(rows, SCHEMA), **kw)
    assert set(got.columns) == {"doc_id", "text", "n_chars", "n_lines", "template", "n_dropped"}
    return got.collect()


def test_exact_and_variable_lines(spark):
    rng = random.Random(1)
    unique = lambda i: " ".join(f"{w}{'abcdefghij'[i % 10]}" for w in rng.choices("tree log line node leaf part".split(), k=12)) + f" own {chr(97 + i % 26)}q{'z' * i}"
    passage = " ".join(f"word{'x' * (i % 7)}" for i in range(60))
    rows = []
    for i in range(40):
        lines = [unique(i), "short line", f"User {i} logged in at 10:{i:02d} from host h{i}"]
        if i % 4 == 0:
            lines.insert(1, passage)
        if i % 5 == 0:
            lines.append("")
        rows.append((i, "\n".join(lines), None, "clash", "t"))
    rows += [(100, None, None, None, None), (101, "", 0, "", ""), (102, "\n \n", 0, "", ""), (None, rows[3][1], 1, "", ""), rows[0]]
    rows += [(200 + i, "a whole copied text of one line here", 5, "", "") for i in range(30)]
    rows += [(300, "many words " * 40_000, 1, "", "")]
    got = _run(spark, rows)
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert [r["text"] for r in by_id[0]] == [rows[0][1]] * 2 and all(r["n_dropped"] == 0 for r in by_id[0])
    for i in range(1, 40):
        kept = [x for x in rows[i][1].split("\n") if not x.startswith("User") and x != passage]
        r = by_id[i][0]
        assert r["text"] == "\n".join(kept) and r["n_dropped"] == 1 + (i % 4 == 0) and r["n_chars"] == len(r["text"])
    assert by_id[None][0]["text"] == by_id[3][0]["text"]
    assert (by_id[100][0]["text"], by_id[100][0]["n_lines"], by_id[101][0]["text"], by_id[102][0]["text"]) == (None, 0, "", "\n \n")
    assert all(r["text"] == rows[-2][1] and r["n_dropped"] == 0 for i in range(30) for r in by_id[200 + i])
    assert by_id[300][0]["n_dropped"] == 0


def plain(rows):
    """The whole definition, line by line: masks, leaves, segments, first-fit templates, keepers."""
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[t].append(d)
    held = defaultdict(set)
    for t in texts:
        for x in t.split("\n"):
            if len(x.split()) >= 4:
                held[_mask(x)].add(t)

    def segments(m):
        body = [m[k] for k in range(3, len(m))]
        if len(body) <= 8:
            return [(b,) for b in body]
        out = defaultdict(list)
        for k, b in enumerate(body):
            out[k * 8 // len(body)].append(b)
        return [tuple(out[s]) for s in range(8)]

    leaves = defaultdict(list)
    for m in held:
        leaves[(len(m), m[:3])].append(m)
    code = lambda m: line_keys([[w.encode() if w != "<*>" else b"0" for w in m]])[1][0].tobytes()
    template = {}
    for group in leaves.values():
        made = []
        for m in sorted(group, key=lambda m: (-len(held[m]), code(m))):
            segs = segments(m)
            for shape, first in made:
                same = [a is not None and a == b for a, b in zip(shape, segs)]
                if len(segs) >= 4 and sum(same) * 8 >= 6 * len(segs):
                    shape[:] = [a if s else None for a, s in zip(shape, same)]
                    template[m] = first
                    break
            else:
                made.append((list(segs), m))
                template[m] = m
    holders = defaultdict(set)
    for m, first in template.items():
        holders[first] |= held[m]
    keeper = {f: min(ts, key=lambda t: min(texts[t])) for f, ts in holders.items() if len(ts) >= 2}
    want = []
    for d, t, *_ in rows:
        kept = [x for x in t.split("\n") if len(x.split()) < 4 or keeper.get(template[_mask(x)], t) == t]
        want.append((d, "\n".join(kept)))
    return want


def test_agrees_with_a_plain_version(spark):
    rng = random.Random(4)
    pool = [[rng.choice("red green blue cyan pink".split()) for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(["odd", "even", "7", "x9"])
            lines.append(" ".join(line))
        rows.append((i * 3 % 83, "\n".join(lines), None, "", ""))
    want = plain(rows)
    got = sorted((r["doc_id"], r["text"]) for r in _run(spark, rows))
    assert got == sorted(want) and got != sorted((d, t) for d, t, *_ in rows)


def test_full_nodes_go_deeper_and_stay_right(spark):
    rows = [(i, "the same start " + " ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for c in "abcdefgh"), None, "", "") for i in range(200)]
    rows += [(1000 + i, "the same start but one that recurs in all of these" + " x" * i * 0, None, "", "") for i in range(2)]
    rows[-1] = (1001, rows[-2][1] + "\nand more of it over here", None, "", "")
    got = {r["doc_id"]: r for r in _run(spark, rows, node_lines=5)}
    assert all(got[i]["n_dropped"] == 0 for i in range(200)) and got[1000]["n_dropped"] == 0
    assert got[1001]["text"] == "and more of it over here"


def test_full_leaves_agree_with_a_plain_version(spark):
    rng = random.Random(9)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"Posted in category {name(i)} by the staff of this site with care and love", None, "", "") for i in range(150)]
    for i in range(200, 400):
        body = [rng.choice("red green blue".split()) if rng.random() < 0.9 else name(rng.randrange(5000)) for _ in range(8)]
        rows.append((i, "we saw the " + " ".join(body) + f"\nOne short text {' '.join(body[:rng.choice([4, 5, 7])])}", None, "", ""))
    want = plain(rows)
    got = _run(spark, rows, node_lines=10)
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want)
    assert all(r["n_dropped"] == 1 for r in got if 0 < r["doc_id"] < 150)


def test_segments_generalise():
    lines = [b"a b c d1x e f g h i j k l".split(), b"a b c OTHER e f g h i j k l".split(), b"a b c q r s t u v w x y".split()]
    counts, prints, leaf, segs = line_keys(lines)
    assert len(set(leaf.tolist())) == 1 and join_templates(segs, np.full(3, 8)).tolist() == [0, 0, 2]
    assert split_lines("a b\n\nc") == [[b"a", b"b"], [], [b"c"]]


def test_empty_table(spark):
    assert _run(spark, []) == []


def test_words_with_digits_are_one_field_and_others_their_own_hash():
    words = "a b7 7 c \xe9t\xe9 0x x-9 d".encode().split() + [b"long" * 50, b"\x30" * 3]
    want = [xxhash.xxh3_64_digest(b"<*>" if re.search(rb"[0-9]", w) else w) for w in words]
    assert masked(words).tobytes() == b"".join(want) == b"".join([MASKED[w] for w in words])
    assert masked([b"a", b"b"]).tobytes() == b"".join(map(xxhash.xxh3_64_digest, [b"a", b"b"]))
    assert len(masked([])) == 0


def test_a_line_knows_all_its_places_in_the_text(spark):
    again = "one line that comes more than once"
    rows = [(1, f"{again}\nshort\n{again} 5\nall words of it 3\n\n{again}\nall words of it 4"), (2, f"\n{again}"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.unhex(F.md5("text")))
    got = [(r["doc_id"], np.frombuffer(r["spots"], "<u4").tolist()) for r in _lines(docs, 4).collect()]
    assert sorted(got) == [(1, [0, 5]), (1, [2]), (1, [3, 6]), (2, [1])]
    cut = drop_recurring(docs.drop("digest").union(docs.select((F.col("doc_id") + 10).alias("doc_id"), F.concat(F.lit("x\n"), "text"))))
    out = {r["doc_id"]: (r["text"], r["n_dropped"], r["n_lines"]) for r in cut.collect()}
    assert out[1] == (rows[0][1], 0, 6) and out[2] == ("", 1, 1) and out[3] == (None, 0, 0)
    assert out[11] == ("x\nshort\n", 5, 7) and out[14] == ("x\n", 0, 1)
