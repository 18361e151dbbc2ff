"""The shared work folder, and lineage cuts that outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    used = spark.sparkContext.getCheckpointDir()
    if used:
        return used.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="trendloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the work folder; never reused, so a failed run leaves no half-written table behind."""
    return f"{work_root(spark)}/trendloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_root(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write a table to the work folder and read it back: columnar, prunable, and free of lineage."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: another value once the table was written anew."""
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = spot.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spot)
    return ";".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
