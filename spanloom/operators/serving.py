"""An online service's decisions as batch plans: modes, inserts, rotation, caches, restarts, limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modes(rows: DataFrame, key: str, order: Sequence[str], confidence: str, cold: int = 100, gate: float = 0.7) -> DataFrame:
    """``rows`` with ``mode``: ``bootstrap`` while a key has seen fewer than ``cold`` rows, then ``update`` for sure answers, else ``infer``; ``priority`` of the insert."""
    seen = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    c = F.col(confidence)
    mode = F.when(seen < cold, "bootstrap").when(c >= gate, "update").otherwise("infer")
    return rows.withColumn("mode", mode).withColumn("priority", F.when(F.col("mode") == "bootstrap", 0.9).otherwise(0.5 * (1 - c) + 0.25))


def rotated(rows: DataFrame, stream: str, order: Sequence[str], size: Column, most: int) -> DataFrame:
    """``rows`` with ``file``: a stream's file numbers, a new file where the bytes so far pass another ``most``."""
    so_far = F.sum(size).over(Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("file", F.floor(F.coalesce(so_far, F.lit(0)) / most).cast("long"))


def changed(rows: DataFrame, key: str, order: Sequence[str], *columns: str) -> DataFrame:
    """Rows that differ from the one before: what a poller reads again unchanged goes."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.row_number().over(w) > 1
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("__same", same).filter("NOT __same").drop("__same")


def cache_hits(rows: DataFrame, key: Sequence[str], order: Sequence[str], when: Column, seconds: int) -> DataFrame:
    """``rows`` with ``hit``: whether the same key was asked for within so many seconds before."""
    w = Window.partitionBy(*key).orderBy(*order)
    t = rows.withColumn("__t", when)
    return t.withColumn("hit", F.coalesce(F.col("__t") - F.lag("__t").over(w) <= seconds, F.lit(False))).drop("__t")


def restarts(rows: DataFrame, key: str, order: Sequence[str], failed: Column, base: float = 1.0, most: float = 60.0, emergency: int = 3) -> DataFrame:
    """Failures with how many came in a row, the wait before the restart, and whether that is an emergency."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__f", failed.cast("int")).withColumn("__run", F.sum(1 - F.col("__f")).over(w))
    inside = Window.partitionBy(key, "__run").orderBy(*order)
    out = marked.withColumn("in_a_row", F.sum("__f").over(inside)).filter("__f = 1").drop("__f", "__run")
    return out.withColumn("wait", F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("in_a_row") - 1), F.lit(most))).withColumn("emergency", F.col("in_a_row") >= emergency)


def rebuilt(snapshot: DataFrame, log: DataFrame, key: str, at: str) -> DataFrame:
    """A snapshot with a log of ``add``, ``update`` and ``delete`` operations applied: the last operation of a key decides."""
    last = log.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter("__n = 1").drop("__n")
    kept = snapshot.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("operation != 'delete'").select(*snapshot.columns))


def limited(rows: DataFrame, key: str, when: Column, event: str, per_minute: int = 10, per_hour: int = 100) -> DataFrame:
    """``key, event`` of the requests that a sliding limit accepts; only accepted ones count.

    A key's requests are one ordered fold.  It holds the accepted times of an hour at most, and rows are
    streamed in order, so a hot key takes time but no memory.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.select(F.col(key).cast("long").alias("key"), when.cast("long").alias("s"), F.col(event).cast("long").alias("event")).repartition(n, "key").sortWithinPartitions("key", "s", "event")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, past = None, []
        for batch in batches:
            kept = []
            for k, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, past = k, []
                past = [t for t in past if s - t < 3600]
                if len(past) < per_hour and sum(s - t < 60 for t in past) < per_minute:
                    past.append(s)
                    kept.append((k, e))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([e for _, e in kept], pa.int64())], names=["key", "event"])

    return laid.mapInArrow(run, "key long, event long")


def last_wins(rows: DataFrame, key: str, order: Sequence[str], first: bool = False) -> DataFrame:
    """One row per key: its last one, or its first."""
    by = [F.col(c).asc() if first else F.col(c).desc() for c in order]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("__n = 1").drop("__n")


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str = "version") -> DataFrame:
    """``rows`` with a number from 1 within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def resolved(rows: DataFrame, key: str, version: str, as_text: bool = False) -> DataFrame:
    """The newest version of each key, by number; ``as_text`` compares ``v9`` and ``v10`` as texts do."""
    by = F.concat(F.lit("v"), F.col(version).cast("string")) if as_text else F.col(version)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(by.desc()))).filter("__n = 1").drop("__n")


def ring(rows: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The last ``most`` rows."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def prune_report(rows: DataFrame, gone: Column, key: str, first: int = 10) -> DataFrame:
    """``removed, remaining, first``: what a pruning run takes away, with the first keys of it."""
    few = rows.filter(gone).orderBy(key).limit(first).agg(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ",").alias("first"))
    return rows.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("remaining")).crossJoin(few)  # one row each
