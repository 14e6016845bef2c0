"""Samples, splits and quotas that a keyed hash fixes, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def place(key: Column, seed: int) -> Column:
    """A row's place in a keyed order: an MD5 digest."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def share_of(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by key and seed."""
    return F.conv(F.substring(place(key, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``__rank``, each row's place from 0 in an order; no task holds more than a range of it.

    A range sort is written with ids that number the rows of a partition; the partitions' sizes, one row
    each, give where a partition begins.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    rank = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, part == F.col("__part")).withColumn("__rank", rank).drop("__id", "__part", "__c", "__before")


def ranked_within(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """``df`` with ``__at``, each row's place from 1 in its stratum's keyed order, and ``__n``, the stratum's size."""
    all_ = ranked(df.withColumn("__place", place(F.col(key), seed)), *[F.col(c).asc_nulls_first() for c in strata], F.col("__place"), F.col(key))
    first = all_.groupBy(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)]).agg(F.min("__rank").alias("__first"), F.count("*").alias("__n"))
    same = F.lit(True)
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return all_.join(first, same).withColumn("__at", F.col("__rank") - F.col("__first") + 1).drop("__rank", "__place", "__first", *[f"__s{i}" for i in range(len(strata))])


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows over all strata in equal quotas, one more for the first strata by name, without back-fill."""
    names = df.groupBy(*strata).count().withColumn("__rank", F.row_number().over(Window.orderBy(*strata)) - 1)  # one row per stratum
    quota = names.crossJoin(names.agg(F.count("*").alias("__strata")))
    quota = quota.select(*strata, (F.floor(F.lit(n) / F.col("__strata")) + F.when(F.col("__rank") < F.lit(n) % F.col("__strata"), 1).otherwise(0)).alias("__quota"))
    return ranked_within(df, strata, key, seed).join(quota, strata).filter("__at <= __quota").drop("__at", "__n", "__quota").select(*df.columns)


def proportional(df: DataFrame, strata: list[str], key: str, share: float, seed: int = 7) -> DataFrame:
    """A share of every stratum, at least one row."""
    return ranked_within(df, strata, key, seed).filter(F.col("__at") <= F.greatest(F.floor(F.col("__n") * share), F.lit(1))).select(*df.columns)


def split(df: DataFrame, strata: list[str], key: str, test: float = 0.15, val: float = 0.1, seed: int = 7) -> DataFrame:
    """``df`` with train, val or test in exact shares of each stratum."""
    n_test, n_val, at = F.floor(F.col("__n") * test), F.floor(F.col("__n") * val), F.col("__at")
    return ranked_within(df, strata, key, seed).withColumn("split", F.when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train")).drop("__at", "__n")


def weighted(df: DataFrame, key: str, weight: Column, k: int, seed: int = 7) -> DataFrame:
    """``k`` rows without replacement, likelier by weight: the largest ``u ** (1 / w)``; zero weights come last."""
    u = F.greatest(share_of(F.col(key), seed), F.lit(1e-12))
    score = F.when(weight > 0, F.log(u) / weight).otherwise(F.lit(float("-inf")))
    return df.withColumn("__score", score).orderBy(F.col("__score").desc(), key).limit(k).drop("__score")


def strided(df: DataFrame, key: str, k: int) -> DataFrame:
    """Every ``n // k``-th row in key order."""
    n = df.agg(F.greatest(F.floor(F.count("*") / k), F.lit(1)).alias("__step"))  # one row
    return ranked(df, F.col(key)).crossJoin(n).filter(F.col("__rank") % F.col("__step") == 0).select(*df.columns)


def uniform(df: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """``k`` rows without replacement: the first in the keyed order."""
    return df.orderBy(place(F.col(key), seed), key).limit(k)


def below(df: DataFrame, key: str, share: float, seed: int = 7) -> DataFrame:
    """The rows whose place is below a share; smaller shares give subsets of larger ones, without a sort."""
    return df.filter(share_of(F.col(key), seed) < share)


def mixture(df: DataFrame, stratum: str, key: str, shares: dict, n: int, seed: int = 7) -> DataFrame:
    """``draw, stratum, key``: ``n`` draws with replacement, each from a stratum by share and then from its rows alike.

    A draw is a number; its digest picks the stratum and the rank of the row, so only ranks are joined.
    """
    u = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    upto, pick = 0.0, F.lit(None).cast("string")
    for name, share in reversed(list(shares.items())):
        pick = F.when(u("stratum") < 1 - upto, F.lit(name)).otherwise(pick) if upto else F.lit(name)
        upto += share
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn(stratum, pick)
    rows = ranked_within(df.select(stratum, key), [stratum], key, seed).select(stratum, key, F.col("__at").alias("__rank"))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    at = draws.join(sizes, stratum).withColumn("__rank", F.floor(u("row") * F.col("__n")) + 1)
    return at.join(rows, [stratum, "__rank"]).select("draw", stratum, key)


def active(df: DataFrame, stratum: str, key: str, weights: dict, seed: int = 7) -> DataFrame:
    """``floor(n * weight)`` rows of each stratum; strata without a weight go."""
    share = F.lit(0.0)
    for name, weight in weights.items():
        share = F.when(F.col(stratum) == F.lit(name), weight).otherwise(share)
    return ranked_within(df, [stratum], key, seed).filter(F.col("__at") <= F.floor(F.col("__n") * share)).select(*df.columns)


def batches(df: DataFrame, priority: str, order: list[str], size: int) -> DataFrame:
    """``df`` with ``batch``: rows in batches by priority, first come first served among equals."""
    at = F.row_number().over(Window.orderBy(F.desc(priority), *order)) - 1
    return df.withColumn("batch", F.floor(at / size).cast("long"))


def searched(df: DataFrame, order: list[str], limit: int = 1000, like: dict | None = None, **equal) -> DataFrame:
    """The first ``limit`` rows whose columns equal values or (``like``) hold texts."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(value))
    for name, part in (like or {}).items():
        df = df.filter(F.col(name).contains(part))
    return df.orderBy(*order).limit(limit)
