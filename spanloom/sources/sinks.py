"""Sinks: partitioned datasets, content-addressed stores, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written


def by_category(df: DataFrame, path: str, category: str, kind: str = "json") -> None:
    """A folder per category."""
    df.write.mode("overwrite").partitionBy(category).format(kind).save(path)


def store(df: DataFrame, path: str, content: str) -> int:
    """Appends contents that a content-addressed store doesn't hold yet; how many were new."""
    spark = df.sparkSession
    rows = df.withColumn("hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).dropDuplicates(["hash"])
    if _exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("hash"), "hash", "left_anti")
    # What is new is written apart first, so that a lost executor can't compute it against the rows it adds.
    fresh = written(rows, "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def snapshot(df: DataFrame, path: str, keep: int = 3) -> int:
    """Writes the next numbered snapshot and removes all but the newest ``keep``; its number."""
    spark = df.sparkSession
    numbers = sorted(_versions(spark, path))
    now = (numbers[-1] if numbers else 0) + 1
    df.write.parquet(f"{path}/version={now}")
    fs, root = _fs(spark, path)
    for old in [*numbers, now][: -keep or None]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)
    return now


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest snapshot by number, or none."""
    numbers = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={max(numbers)}") if numbers else None


def _fs(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _exists(spark: SparkSession, path: str) -> bool:
    fs, root = _fs(spark, path)
    return fs.exists(root)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, root = _fs(spark, path)
    return [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")] if fs.exists(root) else []
