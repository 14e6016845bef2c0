"""Hash-chained audit logs, retention, alerts, versions and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def record(*columns: str) -> Column:
    """The canonical text of a row: its values, nulls empty, behind their lengths."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text])


def chain(df: DataFrame, key: str, order: list[str], body: Column) -> DataFrame:
    """``key, entries``: each key's records in order, each with the hash of itself and the hash before.

    A chain is one fold by nature, so it is per key: one writer per chain, chains in parallel.
    """
    entry = F.transform(F.array_sort(F.collect_list(F.struct(*order, body.alias("body")))), lambda s: s.body)
    bodies = df.groupBy(key).agg(entry.alias("bodies"))
    step = lambda a, b: F.concat(a, F.array(F.sha2(F.concat(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit("")), F.lit("|"), b), 256)))
    hashes = F.aggregate("bodies", F.array().cast("array<string>"), step)
    return bodies.select(key, F.arrays_zip(F.col("bodies").alias("body"), hashes.alias("hash")).alias("entries"))


def broken(links: DataFrame, key: str, order: list[str], body: str, hash_: str) -> DataFrame:
    """The rows of a chain whose hash isn't that of the hash before and the body."""
    before = F.coalesce(F.lag(hash_).over(Window.partitionBy(key).orderBy(*order)), F.lit(""))
    expected = F.sha2(F.concat(before, F.lit("|"), F.col(body)), 256)
    return links.withColumn("__expected", expected).filter(F.col("__expected") != F.col(hash_)).drop("__expected")


def age_bands(df: DataFrame, when: str, as_of: Column) -> DataFrame:
    """Counts of rows by age: up to 7, 30, 60, 90 days and beyond."""
    days = F.datediff(as_of, F.col(when).cast("date"))
    return df.groupBy(scalar.chain([(days <= 7, "7"), (days <= 30, "30"), (days <= 60, "60"), (days <= 90, "90")], "over").alias("band")).agg(F.count("*").alias("n"))


def retained(df: DataFrame, when: str, as_of: Column, days: int) -> DataFrame:
    """The rows that are at most ``days`` whole days old."""
    return df.filter(F.datediff(as_of, F.col(when).cast("date")) <= days)


def ring(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """The last ``size`` rows of each key."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter(F.col("__at") <= size).drop("__at")


def breaches(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The metric rows beyond a threshold of their metric."""
    return metrics.join(F.broadcast(thresholds), "metric").filter(scalar.beyond(F.col("value"), F.col("threshold"), F.col("comparison")))  # thresholds are configuration


def cooled(breached: DataFrame, key: list[str], when: str, order: list[str], seconds: int) -> DataFrame:
    """The breaches that alert: each at least ``seconds`` after the last one of its key that did.

    Whether one alerts depends on those before that did, so this is a fold over each key.
    """
    second = F.unix_timestamp(F.col(when).cast("timestamp"))
    rows = breached.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(second.alias("s"), *order))).alias("rows"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.filter("rows", lambda r: F.lit(False)).alias("kept"))
    step = lambda a, r: F.when(a.last.isNull() | (r.s - a.last >= seconds), F.struct(r.s.alias("last"), F.concat(a.kept, F.array(r)).alias("kept"))).otherwise(a)
    return rows.select(*key, F.explode(F.aggregate("rows", start, step, lambda a: a.kept)).alias("r")).select(*key, "r.*")


def recover(snapshot: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """A snapshot and the logged rows it doesn't hold."""
    return snapshot.unionByName(log.join(snapshot.select(key), key, "left_anti"))


def versions(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``df`` with the number of each artifact version of its name."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(name).orderBy(*order)))


def distinct_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """``hash, first, copies``: rows by the SHA-256 of their content, as a content-addressed store holds them."""
    return df.groupBy(F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def health_rates(df: DataFrame, key: str, when: str, order: list[str], last: int = 60) -> DataFrame:
    """Events per minute over the last rows of each key."""
    s = F.unix_micros(F.col(when).cast("timestamp"))
    r = ring(df, key, order, last).groupBy(key).agg(F.count("*").alias("n"), (F.max(s) - F.min(s)).alias("span"))
    return r.select(key, "n", F.try_divide((F.col("n") - 1) * 60e6, F.nullif("span", F.lit(0))).alias("per_minute"))
