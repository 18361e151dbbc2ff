"""Samples, splits and batches over documents, labels and the daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.hashing import MODULUS, draw_sql
from trendloom.operators import sampling
from trendloom.plans.base import DAILY, daily
from trendloom.plans.registry import query
from trendloom.sources.files import table


@query("exact_sample", sql=f"SELECT doc_id, lang FROM documents ORDER BY {draw_sql('doc_id', 91)}, doc_id LIMIT 150")
def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.exact(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 150, 91)


@query(
    "balanced_sample",
    sql=f"""SELECT doc_id, quality FROM labels
    QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {draw_sql("doc_id", 91)}, doc_id) <= 50""",
)
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 50, 91)


@query(
    "hash_split",
    sql=f"""SELECT o_orderkey, CASE WHEN {draw_sql("o_orderkey", 5)} < {int(0.8 * MODULUS)} THEN 'train' ELSE 'test' END AS part
    FROM orders""",
)
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sampling.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8, 5)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("key_batches", sql="SELECT p_partkey, ntile(6) OVER (ORDER BY p_partkey) AS batch FROM part")
def key_batches(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batches(table(spark, sf, "part").select("p_partkey"), "p_partkey", 6)


@query(
    "time_folds",
    sql=f"""WITH {DAILY}, d AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS pos, count(*) OVER () AS n
      FROM (SELECT DISTINCT ds FROM daily)),
    b AS (SELECT ds, CASE WHEN pos < n - (n // 6) * 5 THEN 0 ELSE (pos - (n - (n // 6) * 5)) // (n // 6) + 1 END::bigint AS block
      FROM d) SELECT entity, ds, y, block FROM daily JOIN b USING (ds)""",
)
def time_folds(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.time_folds(daily(spark, sf), "ds", 5)
