"""Rewards and penalties of step sequences, their running statistics, and curricula over metrics.

Sequences are rows with a key and a full order.  Scores are clipped where the reference range says so; a
sequence too short for a score gets 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within a range."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def semantic_coherence(rows: DataFrame, key: str, order: Sequence[str], vector: str) -> DataFrame:
    """``key, similarity, coherence``: the mean cosine of neighbours; too unlike -0.5, too alike -0.3, else its place between 0.3 and 0.9."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = rows.select(key, scalar.cosine(F.col(vector), F.lag(vector).over(w)).alias("c"))
    mean = pairs.groupBy(key).agg(F.avg("c").alias("similarity"))
    s = F.col("similarity")
    return mean.withColumn("coherence", F.when(s.isNull(), 0.0).when(s < 0.3, -0.5).when(s > 0.9, -0.3).otherwise((s - 0.3) / 0.6))


def tool_penalty(rows: DataFrame, key: str, order: Sequence[str], most: int = 10) -> DataFrame:
    """``key, penalty``: 0.1 for each visual step beyond ``most``, 0.5 for a repeat of three, 0.2 for each zoom after a zoom; -10 at the lowest."""
    w = Window.partitionBy(key).orderBy(*order)
    visual = rows.filter("kind = 'visual_operation'").select(key, "op", F.lag("op").over(w).alias("p1"), F.lag("op", 2).over(w).alias("p2"))
    sums = visual.groupBy(key).agg(
        F.count("*").alias("tools"),
        F.coalesce(F.bool_or((F.col("op") == F.col("p1")) & (F.col("op") == F.col("p2"))), F.lit(False)).alias("repeats"),
        F.count_if((F.col("op") == "ZOOM_IN") & (F.col("p1") == "ZOOM_IN")).alias("zooms"),
    )
    lost = 0.1 * F.greatest(F.col("tools") - most, F.lit(0)) + F.when(F.col("repeats"), 0.5).otherwise(0.0) + 0.2 * F.col("zooms")
    return rows.select(key).distinct().join(sums, key, "left").select(key, clip(-F.coalesce(lost, F.lit(0.0)), -10.0, 0.0).alias("penalty"))


def contradictions(rows: DataFrame, key: str, order: Sequence[str], x: str, y: str) -> DataFrame:
    """``key, again, early``: segmentations of a place that was segmented before, and properties or tracks before any segmentation."""
    w = Window.partitionBy(key).orderBy(*order)
    place = Window.partitionBy(key, "op", x, y).orderBy(*order)
    seen = F.max(F.when(F.col("op") == "SEGMENT_OBJECT_AT", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__seen", F.coalesce(seen, F.lit(0))).withColumn("__again", F.row_number().over(place) > 1)
    return marked.groupBy(key).agg(F.count_if((F.col("op") == "SEGMENT_OBJECT_AT") & F.col("__again")).alias("again"), F.count_if(F.col("op").isin("GET_PROPERTIES", "TRACK_OBJECT") & (F.col("__seen") == 0)).alias("early"))


def out_of_bounds(rows: DataFrame, key: str, low: float, high: float, *columns: str) -> DataFrame:
    """``key, wrong``: parameters outside a range."""
    return rows.groupBy(key).agg(sum((F.count_if(~F.col(c).between(low, high)) for c in columns), F.lit(0)).alias("wrong"))


def step_coherence(rows: DataFrame, key: str, order: Sequence[str], args: str, good: Sequence[tuple[str, str]]) -> DataFrame:
    """``key, coherence``: per pair of neighbours -0.1 for equal steps, +0.2 for good pairs but the last; over the number of pairs."""
    w = Window.partitionBy(key).orderBy(*order)
    p = rows.select(key, "op", F.lag("op").over(w).alias("before"), (F.lag(args).over(w) == F.col(args)).alias("same"), F.lead("op").over(w).isNull().alias("last"))
    fits = F.lit(False)
    for a, b in good:
        fits = fits | ((F.col("before") == a) & (F.col("op") == b))
    each = F.when((F.col("before") == F.col("op")) & F.col("same"), -0.1).otherwise(0.0) + F.when(fits & ~F.col("last"), 0.2).otherwise(0.0)
    sums = p.groupBy(key).agg(F.sum(F.when(F.col("before").isNotNull(), each)).alias("s"), F.count("before").alias("n"))
    return sums.select(key, F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("coherence"))


def total(weights: dict[str, float], penalty: Column) -> tuple[Column, Column]:
    """The weighted and the plain sum of reward columns and a penalty, clipped to 10 either way."""
    parts = list(weights.items())
    return clip(sum((F.col(c) * w for c, w in parts), F.lit(0.0)) + clip(penalty, -10.0, 0.0), -10.0, 10.0), clip(sum((F.col(c) for c, _ in parts), F.lit(0.0)) + clip(penalty, -10.0, 0.0), -10.0, 10.0)


def running(rows: DataFrame, key: str, order: Sequence[str], value: str, first: int = 10, clipped: float | None = None) -> DataFrame:
    """``rows`` with ``mean``, ``std`` (population, over all rows so far) and ``z``; the first rows' ``z`` is the value itself."""
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("at", F.row_number().over(w)).withColumn("mean", F.avg(value).over(so_far)).withColumn("std", F.when(F.col("at") > 1, F.stddev_pop(value).over(so_far)).otherwise(1.0))
    z = (F.col(value) - F.col("mean")) / (F.col("std") + 1e-8)
    return out.withColumn("z", F.when(F.col("at") < first, F.col(value)).otherwise(z if clipped is None else clip(z, -clipped, clipped)))


def moving(rows: DataFrame, metric: str, step: Sequence[str], value: str, mean_of: int, slope_of: int) -> DataFrame:
    """``rows`` with a named metric's moving mean and the slope of its last values by step."""
    w = Window.partitionBy(metric).orderBy(*step)
    placed = rows.withColumn("at", F.row_number().over(w))
    last = w.rowsBetween(1 - slope_of, 0)
    full = F.count("*").over(last) == slope_of
    slope = F.when(full, F.regr_slope(F.col(value), F.col("at").cast("double")).over(last))
    return placed.withColumn("moving_mean", F.avg(value).over(w.rowsBetween(1 - mean_of, 0))).withColumn("slope", slope)


def latest(rows: DataFrame, metric: str, step: Sequence[str], *values: str) -> DataFrame:
    """The last row of each metric."""
    w = Window.partitionBy(metric).orderBy(*[F.desc(c) for c in step])
    return rows.withColumn("__at", F.row_number().over(w)).filter("__at = 1").select(metric, *values)


def smoothed(value: str, key: str, order: Sequence[str], n: int) -> Column:
    """The mean of the last ``n`` values, null until there are so many."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return F.when(F.count("*").over(w) == n, F.avg(value).over(w))


def meets(criteria: dict[str, float]) -> Column:
    """Whether all metrics meet their criteria: a loss at most, others at least."""
    good = F.lit(True)
    for name, bound in criteria.items():
        good = good & (F.col(name) <= bound if "loss" in name else F.col(name) >= bound)
    return F.coalesce(good, F.lit(False))


def replayed(rows: DataFrame, value: str, quantile: float = 0.7) -> DataFrame:
    """Rows whose value is above the quantile of all values."""
    least = rows.agg(F.percentile(value, quantile).alias("__least"))  # one row
    return rows.crossJoin(least).filter(F.col(value) > F.col("__least")).drop("__least")


def step_weights(rows: DataFrame, step: str, stages: Sequence[tuple[int, dict[str, float]]]) -> DataFrame:
    """``rows`` with the weights of the last stage that has begun; the stages are a list of settings, not data."""
    names = sorted({n for _, w in stages for n in w})
    for name in names:
        value = F.lit(None).cast("double")
        for begin, weights in sorted(stages, key=lambda s: s[0]):
            value = F.when(F.col(step) >= begin, F.lit(weights.get(name))).otherwise(value)
        rows = rows.withColumn(name, value)
    return rows


def robustness(retention: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum of what is left of a score under each stress."""
    return sum((retention[k] * weights[k] for k in weights), F.lit(0.0))


def adjust_beta(rows: DataFrame, key: str, order: Sequence[str], value: str, target: float, tolerance: float = 0.5, factor: float = 1.5, low: float = 1e-4, high: float = 1.0, start: float = 0.1, window: int = 20, least: int = 10) -> DataFrame:
    """``key, beta, raised, lowered``: a controller that follows the mean of the last values.

    From the ``least``-th value on beta is multiplied by ``factor`` where the mean is above
    ``target * (1 + tolerance)`` and divided where it is below ``target * (1 - tolerance)``; the bounds are
    taken of the decimal numbers (50 and 0.1 make 55, not the next number above it).
    """
    above, below = (float(Decimal(str(target)) * (1 + side * Decimal(str(tolerance)))) for side in (1, -1))
    w = Window.partitionBy(key).orderBy(*order)
    mean = rows.withColumn("__n", F.row_number().over(w)).withColumn("__mean", F.avg(value).over(w.rowsBetween(1 - window, 0)))
    turn = F.when(F.col("__n") < least, 0).when(F.col("__mean") > above, 1).when(F.col("__mean") < below, -1).otherwise(0)
    # Turns are one byte each; a fold over them clamps step by step.
    turns = mean.select(key, F.struct(F.col("__n"), turn.alias("t")).alias("s")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.t).alias("turns"))
    beta = F.aggregate("turns", F.lit(start), lambda b, t: clip(F.when(t > 0, b * factor).when(t < 0, b / factor).otherwise(b), low, high))
    return turns.select(key, beta.alias("beta"), F.size(F.filter("turns", lambda t: t > 0)).alias("raised"), F.size(F.filter("turns", lambda t: t < 0)).alias("lowered"))
