"""Streams over static files against their batch twins."""

import uuid

from pyspark.sql import functions as F

from spanloom.operators import governance, sequence
from spanloom.streaming import keyed


def _run(spark, df, mode, tmp_path):
    name = f"s{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def _events(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))


def test_cooldown_stream_equals_batch(spark, sf_dir, tmp_path):
    events, stream = _events(spark, sf_dir, tmp_path)
    hot = "event_type = 'error' AND value > 50"
    ours = _run(spark, keyed.cooled(stream.filter(hot), "user_id", "ts", "event_id", 21600), "append", tmp_path)
    batch = governance.cooled(events.filter(hot), ["user_id"], "ts", ["event_id"], 21600)
    assert sorted(map(tuple, ours.collect())) == sorted((r.user_id, r.event_id) for r in batch.collect())


def test_ewma_stream_equals_batch(spark, sf_dir, tmp_path):
    events, stream = _events(spark, sf_dir, tmp_path)
    ours = _run(spark, keyed.ewma(stream, "user_id", "ts", "event_id", "value", 0.05), "update", tmp_path)
    batch = sequence.ewma(events, "user_id", ["ts", "event_id"], "value", 0.05)
    assert sorted((int(r.key), r.n, round(r.ewma, 6)) for r in ours.collect()) == sorted((r.user_id, r.n, round(r.ewma, 6)) for r in batch.collect())


def test_rate_limit_counts_accepted_only(spark, tmp_path):
    rows = [(1, 1704067200 + s, s) for s in (0, 1, 2, 3, 61, 62, 63)]
    df = spark.createDataFrame(rows, "u long, s long, e long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))
    kept = _run(spark, keyed.limited(stream, "u", "ts", "e", per_minute=2, per_hour=3), "append", tmp_path)
    assert sorted(r.event for r in kept.collect()) == [0, 1, 61]
