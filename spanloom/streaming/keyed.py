"""Streams with state per key, each with a batch twin in :mod:`spanloom.operators`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cooled(stream: DataFrame, key: str, when: str, event: str, seconds: int) -> DataFrame:
    """Alerts of a stream, each at least ``seconds`` after the last one of its key; rows of a batch in time order."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["s", "event"])
        kept = []
        for s, e in zip(rows["s"], rows["event"], strict=True):
            if last is None or s - last >= seconds:
                last = int(s)
                kept.append((name[0], int(e)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["key", "event"])

    rows = stream.select(F.col(key).cast("long").alias("key"), F.unix_timestamp(F.col(when).cast("timestamp")).alias("s"), F.col(event).cast("long").alias("event"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event long", "last long", "append", GroupStateTimeout.NoTimeout)


def limited(stream: DataFrame, key: str, when: str, event: str, per_minute: int = 10, per_hour: int = 100) -> DataFrame:
    """Requests that a sliding limit per key accepts: what was accepted counts, what was refused doesn't."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["s", "event"])
        kept = []
        for s, e in zip(rows["s"], rows["event"], strict=True):
            past = [t for t in past if s - t < 3600]
            if len(past) < per_hour and sum(s - t < 60 for t in past) < per_minute:
                past.append(int(s))
                kept.append((name[0], int(e)))
        state.update((past,))
        yield pd.DataFrame(kept, columns=["key", "event"])

    rows = stream.select(F.col(key).cast("long").alias("key"), F.unix_timestamp(F.col(when).cast("timestamp")).alias("s"), F.col(event).cast("long").alias("event"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event long", "past array<long>", "append", GroupStateTimeout.NoTimeout)


def ewma(stream: DataFrame, key: str, when: str, event: str, value: str, alpha: float) -> DataFrame:
    """The exponentially weighted mean of each key after every batch."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["s", "event"])
        for x in rows["value"]:
            mean = float(x) if n == 0 else mean * (1 - alpha) + x * alpha
            n += 1
        state.update((n, mean))
        yield pd.DataFrame([(name[0], n, mean)], columns=["key", "n", "ewma"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(when).cast("timestamp")).alias("s"), F.col(event).cast("long").alias("event"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, ewma double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def windows(stream: DataFrame, when: str, by: str, value: str, size: str, late: str) -> DataFrame:
    """Counts and means per window and key; rows later than ``late`` are left out."""
    t = stream.withColumn("__t", F.col(when).cast("timestamp")).withWatermark("__t", late)
    return t.groupBy(F.window("__t", size), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), by, "n", "mean")
