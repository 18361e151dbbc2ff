import hashlib
import random

from trendloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def _archive(spark, tmp_path, rows, schema=SCHEMA):
    path = str(tmp_path / "a")
    df = spark.createDataFrame(rows, schema)
    warc.write_archives(df, path)
    return {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}


def test_round_trip_with_copies_nulls_and_long_payloads(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "<p>", "é", "\r\n\r\n", "\x00"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 400))) for _ in range(150)]
    texts += ["x" * 100, "x" * 99, "x" * 99, "x" * 100, None, "", "long " * 60_000]
    rows = [(i, f"http://h/{i}\n é", t, "clash") for i, t in enumerate(texts)]
    got = _archive(spark, tmp_path, rows)
    assert len(got) == len(rows)
    first: dict[bytes, int] = {}
    for i, _, text, _ in rows:
        raw = (text or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        if len(raw) >= 100 and raw in first:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", first[raw], None)
        else:
            first.setdefault(raw, i)
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)


def test_files_are_plain_zstandard_with_a_leading_dictionary(spark, tmp_path):
    rows = [(i, None, f"<html><body>page {i} " + "same words again " * 40, "") for i in range(400)]
    _archive(spark, tmp_path, rows)
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert files and all(f.read_bytes()[:4] == (0x184D2A5D).to_bytes(4, "little") for f in files)
    assert sum(f.stat().st_size for f in files) < sum(len(r[2]) for r in rows) / 4


def test_empty_table_and_repeated_rows(spark, tmp_path):
    assert _archive(spark, tmp_path / "e", []) == {}
    path = str(tmp_path / "r")
    rows = [(1, "u", "y" * 200, "")] * 3 + [(None, None, "y" * 200, None), (0, "u", "short", "")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in warc.read_archives(spark, path).collect())
    assert got == [(-1, "response", -1)] + [(-1, "revisit", 1)] + [(1, "response", -1)] * 3
