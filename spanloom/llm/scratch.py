"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names it.  Where the setting is missing a local run (as in tests) uses one folder
per process, and a cluster raises.  A written table cuts lineage like a reliable checkpoint does: a lost
executor costs a reread, not a recomputation, and several consumers read the same rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or a local one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spanloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def table(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Writes ``df`` once, with at most ``rows`` (where not 0) in a file, and returns the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
