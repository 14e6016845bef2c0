"""Dealing rows to ranges of a key, so that parts in order hold all rows in key order.

The cut points are approximate quantiles of the key alone (a scan of one column); they set the balance
of the parts, never what a result holds.  Rows with equal keys share a part; null keys are in the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(rows: DataFrame, key: str, text: str, bytes_per_part: int = 32 << 20) -> list[int]:
    """Cut points for parts of about ``bytes_per_part`` of text, at least as many as shuffle partitions."""
    size = rows.agg(F.sum(F.octet_length(text)), F.count(key)).first()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-(size[0] or 0) // bytes_per_part))
    if parts < 2 or not size[1]:
        return []
    at = rows.select(key).dropna().approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts)
    return sorted({int(c) for c in at})


def part_of(key: str, cuts: list[int], step: int = 64) -> Column:
    """The number of the part of a key: how many cut points are at most the key.

    Every ``step``-th cut point is tried first, and then those between two of them, level by level, so the
    work per row grows with the logarithm of the number of parts.
    """
    if not cuts:
        return F.lit(0)
    # From the coarsest level to the cut points themselves: how many of a level are at most the key.
    levels = [cuts]
    while len(levels[-1]) > step:
        levels.append(levels[-1][step - 1 :: step])
    found = F.size(F.filter(F.lit(levels[-1]), lambda c: c <= F.col(key)))
    for level in levels[-2::-1]:
        found = F.element_at(F.transform(F.array(found), _within(key, level, step)), 1)
    return F.when(F.col(key).isNull(), 0).otherwise(found)


def _within(key: str, level: list[int], step: int) -> Callable[[Column], Column]:
    """How many cut points of a level are at most the key, from how many of the coarser level are."""
    return lambda n: n * step + F.size(F.filter(F.slice(F.lit(level), n * step + 1, F.lit(step)), lambda c: c <= F.col(key)))
