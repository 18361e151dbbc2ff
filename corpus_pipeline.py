"""From raw documents to packed sequences: five stages, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import decontam, linededup, ngramjoin, packing, quality
from trendloom.llm.queries import table, vocabulary
from trendloom.llm.textkit import fresh, ready
from trendloom.operators.ordering import global_index
from trendloom.sources.work import store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3.

    Empty and null texts are scored like any other, repeated rows each; an empty table stays empty, and all columns stay, whatever their names.
    """
    ready(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh("_score", docs.columns)
    return quality.add_scores(docs, model, score).filter(F.col(score) >= 0.3).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that had nothing else goes with them.

    Null and empty texts stay as they are; exact copies and repeated rows lose the same lines; of a template, the text with the
    smallest id keeps its lines. An empty table stays empty, and columns of any names keep their values (``n_chars`` follows the text).
    """
    ready(spark)
    lines, dropped = fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)
    cut = linededup.drop_recurring(docs, counts=(lines, dropped))
    left = (F.col(dropped) == 0) | (F.trim(F.regexp_replace("text", r"\s+", "")) != "")
    return cut.filter(left).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays.

    Rows with one id and one text are one document and stay once; rows with one id and different texts are documents of
    their own, the smaller text hash first. Null ids stay, as do null and empty texts, which link with nothing; an
    empty table stays empty, and columns of any names stay.
    """
    ready(spark)
    key, number = fresh("_key", docs.columns), fresh("_number", docs.columns)
    text_key = F.xxhash64("text")
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id", text_key.alias(key)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
    )
    repeated = store(ids.filter("n > 1"), "repeated")
    if repeated.filter("low <> high").isEmpty():
        numbered = docs.withColumn(number, F.col("doc_id").cast("long"))
    else:
        pairs = docs.filter("doc_id IS NOT NULL").select("doc_id", text_key.alias(key)).distinct()
        places = store(global_index(pairs, ["doc_id", key], number), "numbers")
        met = docs.withColumn(key, text_key).join(places, ["doc_id", key], "left")
        numbered = store(met.select(*docs.columns, number), "numbered")
    found = ngramjoin.similar_texts(numbered.select(F.col(number).alias("doc_id"), "text"))
    gone = store(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(number)).distinct(), "copies")
    kept = numbered.join(gone, number, "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    again = repeated.select("doc_id")
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates([number])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go.

    A row is judged by its id and text, so repeated rows and rows that share an id are judged each; null and empty texts have no words
    and stay; an empty table stays empty, and columns of any names stay.
    """
    ready(spark)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return _without(docs, store(bad, "contaminated"))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"])
    return docs.join(bad, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 ids.

    Null texts are empty; repeated rows are documents of their own; ties on the curve go by a hash of the id; an empty table gives no
    pieces; other columns are ignored, whatever their names.
    """
    ready(spark)
    return packing.pack(docs, vocabulary(), 2048)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the fitted model nor the templates; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
