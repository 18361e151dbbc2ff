"""File sources and sinks with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header and quoted text that may hold commas, quotes and line breaks; several paths are stacked."""
    paths = path if isinstance(path, str) else list(path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(paths)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_metrics(df: DataFrame, path: str, run: str, model: str) -> None:
    """Append a metric table under (run, model), so that runs can be compared later without refitting."""
    tagged = df.withColumn("run", F.lit(run)).withColumn("model", F.lit(model))
    tagged.write.mode("append").partitionBy("run", "model").parquet(path)


def canonicalise(df: DataFrame, renames: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Drop export-index columns and move source names to the canonical ones."""
    return df.drop(*drop).withColumnsRenamed(dict(renames))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


ENTRY = T.StructType([T.StructField("quantity", T.DoubleType()), T.StructField("unit", T.StringType())])
NESTED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("items", T.MapType(T.StringType(), ENTRY)),
    ]
)


def to_nested(df: DataFrame, title: str, item: str, quantity: str, unit: str) -> DataFrame:
    """Long (title, item, quantity, unit) rows to one nested record per title; (title, item) must be unique."""
    entry = F.struct(F.col(quantity).cast("double").alias("quantity"), F.col(unit).alias("unit"))
    return df.groupBy(F.col(title).alias("title")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(item), entry))).alias("items")
    )


def write_nested_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested records back to long rows; one JSON record per line, so the file splits across tasks."""
    nested = spark.read.schema(NESTED).json(path)
    return nested.select("title", F.explode("items").alias("item", "entry")).select(
        "title", "item", F.col("entry.quantity").alias("quantity"), F.col("entry.unit").alias("unit")
    )


def read_dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """A folder of whole-file JSON dictionaries {title: {item: {quantity, unit}}} as long rows.

    One file is one JSON value, so write many moderate files rather than a single large one.
    """
    raw = spark.read.text(path, wholetext=True)
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), ENTRY))
    per_title = raw.select(F.explode(F.from_json("value", schema)).alias("title", "items"))
    return per_title.select("title", F.explode("items").alias("item", "entry")).select(
        "title", "item", F.col("entry.quantity").alias("quantity"), F.col("entry.unit").alias("unit")
    )


def numeric_or_null(name: str, kind: str = "double") -> Column:
    return F.col(name).try_cast(kind)
