"""The tables that queries run on, and the sequences that stand in for agent traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The operation that an event stands for.
OPERATIONS = {"view": "ZOOM_IN", "click": "SEGMENT_OBJECT_AT", "purchase": "GET_PROPERTIES", "signup": "READ_TEXT", "error": "THINK"}
OP_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{o}'" for e, o in OPERATIONS.items()) + " END"
KIND_SQL = "CASE WHEN event_type = 'error' THEN 'reasoning' ELSE 'visual_operation' END"
ORDER = ["ts", "event_id"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: ``user_id, ts, event_id, op, kind, value, props``."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", F.expr(OP_SQL).alias("op"), F.expr(KIND_SQL).alias("kind"), "value", "props")
