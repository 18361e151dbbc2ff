"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

A window (13 words of an item, or a whole shorter item) is contained in a document only if all its shingles are, so one
necessary shingle per window is enough to find candidates: the rarest. Documents offer all their shingles; a match fixes
where the window would start, positions that cannot hold it are dropped, and the words are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.sources.work import store

WINDOW, SHINGLE = 13, 3
#: An index of at most this many bytes is broadcast; a larger one meets the shingles in a shuffled join.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: str) -> Column:
    """Parts between separators: words of ASCII digits, letters (A-Z in lower case) and any characters beyond ASCII; null has none."""
    text = F.coalesce(F.col(text), F.lit(""))
    return F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)


def _trimmed(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the words of ``text``; only the first and the last part of a split can be empty."""
    first = F.when(F.element_at("_parts", 1) == "", 1).otherwise(0)
    last = F.when(F.element_at("_parts", -1) == "", 1).otherwise(0)
    inner = F.slice("_parts", first + 1, F.greatest(F.size("_parts") - first - last, F.lit(0)))
    return df.withColumn("_parts", _split(text)).withColumn(name, inner).drop("_parts")


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def window_index(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per prefix shingle: ``token`` and its ``entries`` (offset in the window, size, words, item ids, shingle size).

    A window's prefix is its rarest shingle: in the fewest windows, then the longest, then by hash. A null item_id has windows
    but no id to report.
    """
    sized = _trimmed(items.select("item_id", "text"), "text", "w").withColumn("n", F.size("w")).filter("n > 0")
    size = F.least(F.col("n"), F.lit(window))
    windows = (
        sized.withColumn("size", size)
        .select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("p"))
        .groupBy(F.slice("w", F.col("p"), F.col("size")).alias("words"))
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("size", F.size("words"))
    )
    windows = store(windows, "benchmark-windows")
    k = F.least(F.col("size"), F.lit(shingle))
    token = F.coalesce(*[F.when(F.col("k") == j, _shingle(F.col("words"), F.col("offset"), j)) for j in range(1, shingle + 1)])
    letters = F.aggregate(F.slice("words", F.col("offset") + 1, F.col("k")), F.lit(0), lambda n, w: n + F.length(w))
    spots = (
        windows.withColumn("k", k)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("offset"))
        .withColumns({"long": letters, "token": token})
    )
    spread = spots.groupBy("token").agg(F.count_distinct("words").alias("windows"))
    rank = F.struct("windows", (-F.col("long")).alias("long"), "token", "offset")
    return (
        spots.join(spread, "token")
        .groupBy("words", "size", "k", "items")
        .agg(F.min(rank).alias("prefix"))
        .groupBy(F.col("prefix.token").alias("token"))
        .agg(F.collect_list(F.struct(F.col("prefix.offset").alias("offset"), "size", "words", "items", "k")).alias("entries"))
    )


def _hits(words: Column, n: Column, at: Column, entries: Column) -> Column:
    """Entries whose words stand in the document where the matched shingle puts them."""
    placed = F.transform(
        entries,
        lambda e: F.struct(
            (at - e["offset"]).alias("start"), e["size"].alias("size"), e["items"].alias("items"), e["words"].alias("words")
        ),
    )
    kept = F.filter(
        placed,
        lambda h: (h["start"] >= 0) & (h["start"] + h["size"] <= n) & (F.slice(words, h["start"] + 1, h["size"]) == h["words"]),
    )
    return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), h["size"].alias("size"), h["items"].alias("items")))


def _spots(base: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per place of a document, with the hash of the shingle of each size there, or null where it does not fit.

    Shifted copies of the words are zipped and exploded, so the hashes are computed in generated code. A document
    without words keeps one row whose place is null; ``first`` marks one row per document.
    """
    shifted = [F.slice("w", j + 1, F.greatest(F.col("n") - j, F.lit(0))).alias(f"w{j}") for j in range(max(sizes))]
    placed = base.select("*", F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "_near"))
    near = [F.col(f"_near.w{j}") for j in range(max(sizes))]
    tokens = [F.when(near[k - 1].isNotNull(), F.xxhash64(F.lit(k), *near[:k])) for k in sizes]
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    if len(tokens) == 1:
        return placed.select(*base.columns, "at", tokens[0].alias("token"), first.alias("first"))
    return placed.select(*base.columns, "at", first.alias("_zero"), F.posexplode(F.array(*tokens)).alias("_size", "token")).select(
        *base.columns, "at", "token", (F.col("_zero") & (F.col("_size") == 0)).alias("first")
    )


def covered(hits: Column) -> Column:
    """Words inside any of the (start, size) runs."""
    runs = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["size"]).alias("b")))))
    return F.aggregate(
        runs,
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda s, r: F.struct(
            F.greatest(s["upto"], r["b"]).alias("upto"),
            (s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["upto"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"].cast("long"),
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and the hit ``spans``.

    A document word inside any occurrence of a window is hit; a document is contaminated if some word is hit and the hits
    are at least a twentieth of its words; ``text_key`` is the hash64 of its text. Null and empty texts have no words. Documents are told apart by id (null
    is one too) and text; repeated rows give repeated rows. Without items nothing is hit. Other columns are ignored.
    """
    index = store(window_index(items, window, shingle), "benchmark-index")
    cost = F.sum(F.aggregate("entries", F.lit(0), lambda s, e: s + 40 + 16 * e["size"] + 8 * F.size(e["items"])
                             + F.aggregate(e["words"], F.lit(0), lambda t, w: t + F.octet_length(w))))
    row = index.agg(cost.alias("bytes"), F.array_sort(F.collect_set(F.col("entries")[0]["k"])).alias("sizes")).first()
    sizes = row["sizes"] or [shingle]
    base = _trimmed(docs.select("doc_id", "text", F.xxhash64("text").alias("_key")), "text", "w").drop("text")
    base = base.withColumn("n", F.size("w"))
    shape = "array<struct<start:int,size:int,items:array<%s>>>" % dict(items.dtypes)["item_id"]
    if (row["bytes"] or 0) <= broadcast_bytes:
        # One pass: the words stay beside the shingles of their row, and rows without a match never leave the join.
        found = (
            _spots(base, sizes)
            .join(F.broadcast(index), "token", "left")
            .filter(F.col("first") | F.col("entries").isNotNull())
            .select(
                "doc_id", "_key", "n", F.col("first").cast("long").alias("copies"),
                F.when(F.col("entries").isNotNull(), _hits(F.col("w"), F.col("n"), F.col("at"), F.col("entries"))).alias("hits"),
            )
        )
    else:
        spots = _spots(base, sizes).select("doc_id", "_key", "at", "token").filter("token IS NOT NULL")
        near = (
            spots.distinct().join(index, "token")
            .groupBy("doc_id", "_key").agg(F.collect_list(F.struct("at", "entries")).alias("near"))
            .withColumnRenamed("doc_id", "_doc").withColumnRenamed("_key", "_text")
        )
        meet = base["doc_id"].eqNullSafe(near["_doc"]) & (base["_key"] == near["_text"])
        found = base.join(near, meet, "left").select(
            "doc_id", "_key", "n", F.lit(1).cast("long").alias("copies"),
            F.flatten(F.transform("near", lambda c: _hits(F.col("w"), F.col("n"), c["at"], c["entries"]))).alias("hits"),
        )
    hits = F.coalesce(F.array_distinct(F.flatten("_hits")), F.array().cast(shape))
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))), lambda i: i.cast("string")))
    return (
        found.groupBy("doc_id", "_key")
        .agg(F.max("n").cast("long").alias("n_words"), F.sum("copies").alias("_copies"), F.collect_list(
            F.when(F.size("hits") > 0, F.col("hits"))).alias("_hits"))
        .withColumn("hits", hits)
        .select("doc_id", F.col("_key").alias("text_key"), "n_words", "_copies", covered(F.col("hits")).alias("n_hit"), ids.alias("_ids"),
                F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["size"].alias("size"))))).alias("spans"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("_ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("_ids", ",").cast("binary"), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            "spans", "text_key", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_one"),
        )
        .drop("_one")
    )
