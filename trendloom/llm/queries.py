"""Registered queries of the training-data operators and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import convtrie, dac, decontam, extract, lexical, linededup, lmscore, neardup, ngramjoin, packing, quality, sharding, warc
from trendloom.llm.textkit import ready
from trendloom.sources.work import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(ready(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards along a Hilbert curve over language, source and size."""
    return sharding.shard_documents(table(spark, folder, "documents"), shards=24)


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, strlen(h)::bigint AS payload_bytes, sha256(h) AS payload_digest,
                 min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
    r AS (SELECT *, payload_bytes >= 100 AND first_id <> page_id AS later FROM q)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN later THEN first_id END AS refers_to
    FROM r
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Archive every page, then read the archives back."""
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op6_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract_pages(table(spark, folder, "pages"))


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file; every worker has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return packing.pack(table(spark, folder, "documents"), vocabulary(), 2048)


_SPLIT = (
    "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
)


@query(
    "op5_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
    b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
    v AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, w[p : p + least(len(w), 13) - 1] AS words
          FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT m FROM v),
    spots AS (SELECT doc_id, m, p, w[p : p + m - 1] AS words
           FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
    hit AS (SELECT doc_id, p, spots.m, v.item_id FROM spots JOIN v ON spots.m = v.m AND spots.words = v.words),
    cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS k FROM hit) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS s FROM hit GROUP BY doc_id)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans", "text_key")


@query("op4_lm_scoring")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Base and model scores of all documents; one in ten is held out of the counts."""
    return lmscore.score_documents(table(spark, folder, "documents"))


@query("op7_ngram_join")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 0.75 or more on five-word shingles."""
    found = ngramjoin.similar_texts(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op1_near_duplicates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of one label linked by a cosine of 0.98 or more."""
    return neardup.near_duplicates(table(spark, folder, "embeddings"), 0.98)


@query("op8_line_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of recurring templates dropped from all documents."""
    cut = linededup.drop_recurring(table(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.length("text").cast("long").alias("n_chars"),
    )


_TERMS = (
    "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [])"
)


@query(
    "op11_lexical_search",
    f"""
    WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY doc_id),
    whole AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS total FROM sizes),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint AS w
          FROM tf, whole WHERE term IN (SELECT term FROM q) GROUP BY term),
    m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // total) AS m FROM sizes, whole),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::int AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 50)


@query("op12_token_files")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents in files of directly addressable codes, read back."""
    path = work_path(spark, "tokens")
    dac.write_tokens(table(spark, folder, "documents"), path, vocabulary())
    return dac.read_documents(spark, path)


@query(
    "op13_prefix_trie",
    """
    WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
    t AS (SELECT conv_id AS c, strlen(coalesce(text, ''))::bigint AS size,
                 md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) AS content,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) - 1 AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, c - c % 5 AS b, count(*) AS n FROM t GROUP BY c),
    h AS (SELECT own.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
                   lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM own, crc),
    k AS (SELECT h.c, h.b, h.h, h.n, least(h.h, coalesce(base.n, 0)) AS taken FROM h LEFT JOIN own AS base ON base.c = h.b),
    r AS (SELECT k.c, pos AS p, content, size FROM k JOIN t ON t.c = k.b AND pos < h
          UNION ALL SELECT k.c, taken + pos - h, content, size FROM k JOIN t ON t.c = k.c WHERE pos >= h),
    m AS (SELECT c, p + 1 AS d, size, md5(list(content) OVER (PARTITION BY c ORDER BY p)::varchar) AS key FROM r
          UNION ALL SELECT c, 0, 0, '' FROM k),
    ends AS (SELECT c, taken + greatest(n - h, 0) AS len FROM k),
    owned AS (SELECT *, min(c) OVER (PARTITION BY d, key) AS owner FROM m),
    nodes AS (SELECT owner AS conv, d, count(*) AS n_convs, max(size) AS size,
                sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends_sha256
              FROM owned JOIN ends USING (c) GROUP BY owner, d),
    up AS (SELECT n.conv, n.d, o.owner AS parent FROM nodes AS n LEFT JOIN owned AS o ON o.c = n.conv AND o.d = n.d - 1),
    kids AS (SELECT parent AS conv, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
    full_nodes AS (SELECT n.*, up.parent, coalesce(n_children, 0) AS n_children
                   FROM nodes AS n JOIN up USING (conv, d) LEFT JOIN kids USING (conv, d)),
    sums AS (SELECT o.owner AS conv, o.d, sum((f.n_children = 0)::int)::bigint AS n_leaves, sum((f.n_convs - 1) * f.size)::bigint AS saved_tokens
             FROM full_nodes AS f JOIN owned AS o ON o.c = f.conv AND o.d <= f.d GROUP BY ALL)
    SELECT conv AS conv_id, d::bigint AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM full_nodes JOIN sums USING (conv, d)
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt so that they share their first turns."""
    return convtrie.prefix_trie(table(spark, folder, "conversations"))
