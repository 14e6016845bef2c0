"""Scores of ordered step sequences.

A sequence is the rows of one key in an explicit order; steps have an operation and a kind.  Everything
that looks at neighbouring steps is a window over the key, and scores are sums of what windows flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

# Step pairs that count for or against a sequence.
GOOD_PAIRS = (("SEGMENT_OBJECT_AT", "GET_PROPERTIES"), ("ZOOM_IN", "READ_TEXT"), ("SEGMENT_OBJECT_AT", "TRACK_OBJECT"), ("READ_TEXT", "THINK"), ("GET_PROPERTIES", "THINK"))
BAD_PAIRS = (("TRACK_OBJECT", "TRACK_OBJECT"), ("ZOOM_IN", "ZOOM_IN"), ("GET_PROPERTIES", "SEGMENT_OBJECT_AT"))
VISUAL, REASONING = "visual_operation", "reasoning"


def _pair(pairs, before, now):
    return scalar.chain([((before == a) & (now == b), True) for a, b in pairs], False)


def adjacent(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with the operation and kind of the step before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("prev_op", F.lag("op").over(w)).withColumn("prev_kind", F.lag("kind").over(w)).withColumn("step", F.row_number().over(w))


def _clip(x, low=-1.0, high=1.0):
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logical_flow(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Progression score: repeats cost, changes of kind and thinking after looking count."""
    a = adjacent(df, key, order)
    same = (F.col("prev_kind") == F.col("kind")) & (F.col("prev_op") == F.col("op"))
    gain = F.when(same, -0.2).otherwise(0.0) + F.when(F.col("prev_kind") != F.col("kind"), 0.1).otherwise(0.0) + F.when((F.col("prev_kind") == VISUAL) & (F.col("kind") == REASONING), 0.2).otherwise(0.0)
    n = F.count("*")
    total = F.sum(F.when(F.col("prev_op").isNotNull(), gain).otherwise(0.0))
    return a.groupBy(key).agg(_clip(F.when(n > 1, total / (n - 1)).otherwise(0.0)).alias("flow"))


def tool_pattern(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Diversity of visual operations, less over-use, plus two good successions."""
    a = adjacent(df, key, order)
    good = (F.col("prev_kind") == VISUAL) & _pair(GOOD_PAIRS[:2], F.col("prev_op"), F.col("op"))
    pairs = a.groupBy(key).agg(F.count_if(good).alias("good"))
    uses = df.filter(F.col("kind") == VISUAL).groupBy(key, "op").count().groupBy(key).agg(F.count("*").alias("tools"), F.max("count").alias("most"))
    score = F.least(F.col("tools") * 0.1, F.lit(0.5)) - F.greatest(F.col("most") - 5, F.lit(0)) * 0.1 + F.col("good") * 0.2
    return pairs.join(uses, key, "left").select(key, F.when(F.col("tools").isNull(), 0.0).otherwise(_clip(score)).alias("pattern"))


def bigram_counts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """How many step pairs are good, bad, or plain repeats."""
    a = adjacent(df, key, order)
    before, now = F.col("prev_op"), F.col("op")
    return a.groupBy(key).agg(F.count_if(_pair(GOOD_PAIRS, before, now)).alias("good"), F.count_if(_pair(BAD_PAIRS, before, now)).alias("bad"), F.count_if(F.coalesce(before == now, F.lit(False))).alias("repeats"))


def repetition(df: DataFrame, key: str, order: list[str], threshold: int = 2) -> DataFrame:
    """Whether a run of equal visual operations reaches the threshold; other steps are passed over."""
    r = runs(df.filter(F.col("kind") == VISUAL), key, order)
    flags = r.groupBy(key).agg((F.max("length") >= threshold).alias("repeats"))
    return df.select(key).distinct().join(flags, key, "left").select(key, F.coalesce("repeats", F.lit(False)).alias("repeats"))


def runs(df: DataFrame, key: str, order: list[str], longest: int | None = None) -> DataFrame:
    """``key, run, op, length``: runs of equal operations, cut after ``longest`` steps."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag("op").over(w).eqNullSafe(F.col("op")), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.row_number().over(Window.partitionBy(key, "__run").orderBy(*order)) - 1
    part = F.floor(inside / longest) if longest else F.lit(0)
    return marked.withColumn("__part", part).groupBy(key, F.col("__run").alias("run"), F.col("__part").alias("part"), "op").agg(F.count("*").alias("length"))


def misuse(df: DataFrame, key: str, order: list[str], most: int = 10) -> DataFrame:
    """Steps that need an earlier segmentation and have none, and operations beyond their number."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(F.col("op") == "SEGMENT_OBJECT_AT", 1).otherwise(0)).over(w), F.lit(0))
    flagged = df.withColumn("__early", (F.col("op").isin("GET_PROPERTIES", "TRACK_OBJECT")) & (seen == 0))
    return flagged.groupBy(key).agg(F.count_if("__early").alias("early"), F.greatest(F.count_if(F.col("kind") == VISUAL) - most, F.lit(0)).alias("beyond"))


def efficiency(df: DataFrame, key: str, order: list[str], argument: str) -> DataFrame:
    """Distinct over all operations, with discounts for length; distinct steps; equal neighbours; thinking."""
    a = adjacent(df, key, order)
    n = F.count("*")
    share = F.countDistinct("op") / n
    discount = F.when(n > 20, 0.9 * 0.8).when(n > 15, 0.9).otherwise(1.0)
    return a.groupBy(key).agg(
        (share * discount).alias("efficiency"),
        (F.countDistinct("op", argument) / n).alias("exploration"),
        F.coalesce(F.avg(F.when(F.col("prev_op").isNotNull(), F.when(F.col("prev_op") == F.col("op"), 0.5).otherwise(1.0))), F.lit(1.0)).alias("coherence"),
        (F.count_if(F.col("op") == "THINK") / n).alias("thinking"),
    )


def loops(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Whether a pattern of at least two steps follows itself somewhere, in sequences of four or more."""
    ops = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "op"))), lambda s: s.op).alias("ops"))
    n = F.size("ops")
    twice = lambda m: F.exists(F.sequence(F.lit(1), n - 2 * m + 1), lambda i: F.slice("ops", i, m) == F.slice("ops", i + m, m))
    longest = F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(2))
    found = F.when(n < 4, False).otherwise(F.exists(F.filter(F.sequence(F.lit(2), longest), lambda m: (2 * m <= n) & (m <= F.floor(n / 2) - 1)), twice))
    return ops.select(key, found.alias("loops"))


def difficulty(df: DataFrame, key: str) -> DataFrame:
    """Length, operation and reasoning parts of a sequence's difficulty, and their weighted sum."""
    known = scalar.operation_weight(F.col("op"))
    n, ops = F.count("*"), F.count(known)
    sums = df.groupBy(key).agg(n.alias("n"), ops.alias("ops"), F.coalesce(F.sum(known), F.lit(0.0)).alias("w"), F.countDistinct(F.when(known.isNotNull(), F.col("op"))).alias("kinds"), F.count_if(F.col("op") == "THINK").alias("thinking"))
    tools = F.when(F.col("ops") == 0, 0.3).otherwise(F.least(F.col("w") / (3.0 * F.col("ops")) + 0.2 * F.col("kinds") / F.col("ops"), F.lit(1.0)))
    parts = sums.select(key, "n", scalar.length_complexity(F.col("n")).alias("complexity"), tools.alias("sophistication"), scalar.reasoning_depth(F.col("thinking"), F.col("n")).alias("depth"))
    total = 0.30 * F.col("complexity") + 0.25 * F.col("sophistication") + 0.20 * F.col("depth")
    return parts.withColumn("difficulty", _clip(total, 0.1, 1.0))


def difficulty_bins(df: DataFrame, score: str) -> DataFrame:
    """``df`` with easy, medium or hard by the thirds of the scores within 1.5 quartile ranges."""
    q = df.agg(F.percentile(score, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = (F.col("q")[1] - F.col("q")[0]) * 1.5
    inside = df.crossJoin(F.broadcast(q)).filter(F.col(score).between(F.col("q")[0] - spread, F.col("q")[1] + spread))  # one row
    cuts = inside.agg(F.percentile(score, F.array(F.lit(0.33), F.lit(0.66))).alias("c"))
    label = F.when(F.col(score) <= F.col("c")[0], "easy").when(F.col(score) <= F.col("c")[1], "medium").otherwise("hard")
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", label).drop("c")


def rolling(df: DataFrame, key: str, order: list[str], value: str, size: int, least: int = 10) -> DataFrame:
    """``df`` with mean, deviation and z-score over the last ``size`` rows, and the slope over them.

    Z-scores of rows with fewer than ``least`` before or at them are the values themselves.
    """
    w = Window.partitionBy(key).orderBy(*order)
    last = w.rowsBetween(1 - size, 0)
    at = F.row_number().over(w)
    out = df.withColumn("at", at).withColumn("mean", F.avg(value).over(last)).withColumn("deviation", F.stddev_pop(value).over(last) + 1e-8)
    z = F.when(F.col("at") < least, F.col(value)).otherwise((F.col(value) - F.col("mean")) / F.col("deviation"))
    return out.withColumn("z", z).withColumn("slope", F.regr_slope(F.col(value), F.col("at").cast("double")).over(last))


def ewma(df: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """The exponentially weighted mean after the last row of each key, started by the first."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value])
    folded = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha)
    return df.groupBy(key).agg(values.alias("v"), F.count("*").alias("n")).select(key, "n", folded.alias("ewma"))


def group_normalise(df: DataFrame, key: str, order: list[str], value: str, size: int = 4, flat: float = 0.01) -> DataFrame:
    """``df`` with values normalised within consecutive groups; near-zero values become 0."""
    at = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size)
    group = Window.partitionBy(key, "group")
    x = (F.col(value) - F.avg(value).over(group)) / (F.coalesce(F.stddev_samp(value).over(group), F.lit(0.0)) + 1e-8)
    return df.withColumn("group", at).withColumn("advantage", x).withColumn("advantage", F.when(F.abs("advantage") <= flat, 0.0).otherwise(F.col("advantage")))


def clips(df: DataFrame, key: str, frame: str, duration: int, stride: int, least: int) -> DataFrame:
    """``key, clip_start, n``: sliding clips over frame numbers from each key's first frame; short tails drop out."""
    spans = df.groupBy(key).agg(F.min(frame).alias("lo"), F.max(frame).alias("hi"))
    starts = spans.select(key, "hi", F.explode(F.sequence("lo", "hi", F.lit(stride).cast("long"))).alias("clip_start"))
    starts = starts.filter(F.least(F.col("clip_start") + duration - 1, F.col("hi")) - F.col("clip_start") + 1 >= least)
    return starts.join(df.select(key, frame), key).filter(F.col(frame).between(F.col("clip_start"), F.col("clip_start") + duration - 1)).groupBy(key, "clip_start").agg(F.count("*").alias("n"))


def motion(df: DataFrame, key: str, order: list[str], x: str, y: str) -> DataFrame:
    """Path length, mean and greatest step, displacement, and whether an object stands still."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2.0) + F.pow(F.col(y) - F.lag(y).over(w), 2.0))
    far = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = lambda c: F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = df.withColumn("__step", step).withColumn("__dx", last(x) - far(x)).withColumn("__dy", last(y) - far(y))
    path = F.coalesce(F.sum("__step"), F.lit(0.0))
    return d.groupBy(key).agg(path.alias("path"), F.coalesce(F.avg("__step"), F.lit(0.0)).alias("speed"), F.coalesce(F.max("__step"), F.lit(0.0)).alias("fastest"), F.first(F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2)).alias("displacement"), (path < 10).alias("stationary"))
