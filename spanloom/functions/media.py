"""Frames, times, masks and small score formulas as column expressions.

A mask is an array of 0 and 1, row by row, with its width given where places matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import chain


def range_to_frames(start: Column, end: Column, fps: Column, inclusive: bool = True) -> Column:
    """First and last frame of a time range; the last is rounded up if it belongs to the range."""
    last = F.ceil(end * fps) if inclusive else F.floor(end * fps)
    return F.array(F.floor(start * fps).cast("long"), last.cast("long"))


def frames_to_range(first: Column, last: Column, fps: Column) -> Column:
    """Start and end time of frames; the last frame ends where the next begins."""
    return F.array(first / fps, (last + 1) / fps)


def sampled(first: Column, last: Column, strategy: str, n: int = 8) -> Column:
    """Frame numbers from ``first`` to ``last``: ``all``, ``uniform`` (``n`` of them, truncated), ``endpoints`` or ``middle``."""
    everything = F.sequence(first, last)
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (first + F.floor(i * (last - first) / F.lit(max(n - 1, 1)))).cast("long"))
    return {"all": everything, "uniform": F.when(last - first + 1 <= n, everything).otherwise(spread), "endpoints": F.array_distinct(F.array(first, last)), "middle": F.array(F.floor((first + last) / 2).cast("long"))}[strategy]


def clamped(first: Column, last: Column, count: Column) -> Column:
    """A frame range cut at the last frame; null where it begins behind it."""
    return F.when(first < count, F.array(first, F.least(last, count - 1)))


def inside(times: Column, fps: Column, count: Column) -> Column:
    """The frames of timestamps that are within the video."""
    return F.filter(F.transform(times, lambda t: F.bround(t * fps).cast("long")), lambda f: (f >= 0) & (f < count))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def mask_counts(a: Column, b: Column) -> Column:
    """``a, b, both, same, n`` pixels of two masks."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    return F.struct(_sum(a).alias("a"), _sum(b).alias("b"), _sum(F.zip_with(a, b, lambda x, y: x * y)).alias("both"), _sum(F.zip_with(a, b, lambda x, y: (x == y).cast("int"))).alias("same"), F.size(pairs).alias("n"))


def mask_iou(c: Column) -> Column:
    """Intersection over union of counted masks, 1 for two empty ones."""
    union = c.a + c.b - c.both
    return F.when(union == 0, 1.0).otherwise(c.both / union)


def dice(c: Column) -> Column:
    """Twice the intersection over both areas, null for two empty masks."""
    return F.try_divide(2.0 * c.both, c.a + c.b)


def mask_box(mask: Column, width: Column, inclusive: bool = False) -> Column:
    """``x, y, x2, y2`` of a mask's pixels, the end one past the last pixel if ``inclusive`` of it; null for an empty mask."""
    at = F.filter(F.transform(mask, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull())
    x, y = F.transform(at, lambda i: i % width), F.transform(at, lambda i: F.floor(i / width).cast("int"))
    more = 1 if inclusive else 0
    return F.when(F.size(at) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x) + more, F.array_max(y) + more))


def size_properties(area: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """``area, relative, diagonal, aspect`` of a box in an image."""
    return F.struct(area.alias("area"), F.try_divide(area, width * height).alias("relative"), F.sqrt(w * w + h * h).alias("diagonal"), F.coalesce(F.try_divide(w, h), F.lit(0.0)).alias("aspect"))


def position(x: Column, y: Column) -> Column:
    """``centre_distance, edge_proximity`` of a point in the unit square."""
    return F.struct(F.sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)).alias("centre_distance"), F.least(x, y, 1 - x, 1 - y).alias("edge_proximity"))


def sampling_weight(kind: Column, quality: Column) -> Column:
    """The weight of a sample in training: traps and corrections count more, by the root of their quality."""
    return F.when(kind == "trap", 1.5).when(kind == "self_correction", 1.2).otherwise(1.0) * F.sqrt(quality)


def rank_limit(rank: Column, low: int = 4, high: int = 64) -> Column:
    """A rank within its bounds; above 16 the nearest power of two."""
    r = F.least(F.greatest(rank, F.lit(low)), F.lit(high))
    return F.when(r > 16, F.pow(F.lit(2.0), F.bround(F.log2(r.cast("double"))))).otherwise(r).cast("int")


def smoothed_rank(rank: Column, mean: Column, factor: float = 0.5) -> Column:
    """A rank drawn towards the mean of its group, truncated."""
    return (factor * mean + (1 - factor) * rank).cast("int")


def agreement_label(icc: Column) -> Column:
    """The name of an agreement."""
    return chain([(icc < 0.4, "poor"), (icc < 0.6, "fair"), (icc < 0.75, "good")], "excellent")


def bottleneck_label(percent: Column) -> Column:
    """The name of a share of the time."""
    return chain([(percent >= 50, "critical"), (percent >= 30, "high"), (percent >= 20, "medium"), (percent >= 10, "low")], "minimal")


def compression_ratio(rank: Column) -> Column:
    """The assumed compression by mean rank."""
    return chain([(rank <= 8, 0.01), (rank <= 16, 0.05), (rank <= 32, 0.10)], 0.15)


def kl_divergence(original: Column, current: Column) -> Column:
    """The divergence of two arrays of logits, after their softmax."""

    def soft(v: Column) -> Column:
        top = F.array_max(v)
        e = F.transform(v, lambda x: F.exp(x - top))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    each = F.zip_with(soft(original), soft(current), lambda p, q: p * (F.log(p) - F.log(q + 1e-8)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def comparison_category(a: Column, b: Column) -> Column:
    """What a comparison of two models tests, by their names, in order."""
    has = lambda word: a.contains(word) | b.contains(word)
    return chain([(has("full") & has("base"), "overall"), (has("online"), "adaptation"), (has("rft"), "reinforcement"), (has("sft"), "fine_tuning")], "other")


def boundary(mask: Column, width: Column) -> Column:
    """The pixels of a mask that have a neighbour outside it or lie on the edge."""
    n = F.size(mask)
    out = lambda i: F.coalesce(F.get(mask, i), F.lit(0)) == 0
    edge = lambda i: (i % width == 0) | (i % width == width - 1) | (i < width) | (i >= n - width)
    return F.filter(F.transform(mask, lambda m, i: F.when((m > 0) & (edge(i) | out(i - 1) | out(i + 1) | out(i - width) | out(i + width)), i)), lambda i: i.isNotNull())


def boundary_f1(a: Column, b: Column, width: Column, reach: int = 3) -> Column:
    """The F1 of two masks' boundaries, a pixel being met within ``reach`` rows and columns; 1 for two without boundary."""
    near = lambda i, others: F.exists(others, lambda j: (F.abs(i % width - j % width) <= reach) & (F.abs(F.floor(i / width) - F.floor(j / width)) <= reach))
    x, y = boundary(a, width), boundary(b, width)
    precision = F.try_divide(F.size(F.filter(x, lambda i: near(i, y))), F.size(x))
    recall = F.try_divide(F.size(F.filter(y, lambda j: near(j, x))), F.size(y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
