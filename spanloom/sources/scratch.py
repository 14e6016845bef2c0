"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_local: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it back; where that is unset, a local run uses a folder of its own and a cluster raises."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spanloom-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = f"file://{_local[0]}"
    path = f"{root.rstrip('/')}/spanloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
