"""Connected components of a table of links.

Links are first contracted inside tasks: each leaves a star (node, smallest node) per component it sees,
so links inside dense groups vanish early.  If they fit one bounded task, that is the answer.  Otherwise
large-star and small-star rounds follow, whose joins and sums have no row per pair of a group, until a
round changes nothing; tables written between rounds cut the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table

#: Links that one task contracts.
LOCAL = 1_000_000


def min_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of links, and for each the smallest node of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        high = np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)  # hook roots, then let every node point at a root
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _contract(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
        if a:
            nodes, least = min_labels(np.concatenate(a), np.concatenate(b))
            apart = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(least[apart])], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours above (large) or below (small) a node are linked to its smallest one."""
    if large:
        both = links.union(links.select("b", "a"))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("u"))
    moved = joined.filter("b > a" if large else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """``node, component`` (its smallest node) for every node of the links ``a, b`` between longs.

    Links of a node to itself and links with a null are dropped; repeated links count once.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    links = table(_contract(links), "links")
    before = None
    while True:
        n = links.count()
        parts = max(1, -(-n // local))
        if parts == 1:
            stars = table(_contract(links.repartition(1)), "stars")
            break
        links = _contract(links.repartition(parts, F.least("a", "b")))
        links = table(_star(_star(links, True), False), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            stars = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b"), F.col("b")).distinct())
