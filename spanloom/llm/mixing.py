"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source and step of a keyed draw (map-side first, so a hot source costs ``STEPS``
rows per task at most), the sums give each source a target and a repetition rate, and every document is
emitted ``floor(rate)`` times plus one more time if its draw, a keyed hash, falls below the source's
threshold.  The threshold is the fraction of the rate as the draws have it: of the ``STEPS`` steps of the
draw the one up to which the source's words come nearest to the fraction of all its words.  With many
documents it is the fraction itself; with few, where independent draws would miss the target by much, the
words taken differ from the target by less than half a step holds.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share ``budget`` times
all tokens.  A target stops at ``cap`` times its source's tokens; the excess goes to the others by
weight until none is above, which is ``min(cap * size, level * weight)`` for one common level.

Defined cases: null texts count 0 tokens; a null source is a source of its own; rows that repeat with
the same key get the same number of copies each; a source without tokens has target 0 and its rows go
nowhere; an empty table stays empty.  Rows with a null key draw by their text.  Columns of any names pass
through :func:`mix`; :func:`mix_counts` adds ``__size``, ``__source_size``, ``__target`` and ``__copies`` in
place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

#: Steps of the draws in which a source's words are counted.
STEPS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """The number of words of a text, as a long; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: ``__source, __source_size, __target, __rate``.

    The level is found by rounds of one aggregate each: sources above their cap leave, the rest share
    what is left.  Ranks come from a range sort, so no task holds all sources.
    """
    spark = sized.sparkSession
    sums = sized.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("__source_size"))
    placed = table(
        sums.repartitionByRange(F.col("__source").isNull(), F.col("__source"))
        .sortWithinPartitions(F.col("__source").isNull(), F.col("__source"))
        .withColumn("__at", F.monotonically_increasing_id()),
        "sources",
    )
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, not per source.
    starts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = table(placed.join(F.broadcast(starts), part == F.col("__part")).select("__source", "__source_size", turn.cast("long").alias("__weight")), "ranked")

    level = 0.0
    total = ranked.agg(F.sum("__source_size")).first()[0] or 0
    most = F.col("__source_size") * cap
    while total:
        full = most <= F.col("__weight") * level
        capped, rest = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("__weight")))).first()
        now = (total * budget - (capped or 0.0)) / rest if rest else level
        if now <= level:
            break
        level = now
    target = F.least(most, F.col("__weight") * F.lit(level))
    return ranked.select("__source", "__source_size", target.alias("__target"), F.coalesce(F.try_divide(target, F.col("__source_size")), F.lit(0.0)).alias("__rate"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key and the seed: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def thresholds(steps: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates`` with ``__threshold``: below it, a draw takes one more copy.  ``steps`` has ``__source, __step, __size``."""
    from_start = Window.partitionBy("__source").orderBy("__step")  # at most STEPS rows a source
    ends = steps.select("__source", ((F.col("__step") + 1) / F.lit(float(STEPS))).alias("end"), F.sum("__size").over(from_start).alias("words"))
    ends = ends.unionByName(rates.select("__source", F.lit(0.0).alias("end"), F.lit(0).cast("long").alias("words")))
    wanted = rates.select(F.col("__source").alias("s"), ((F.col("__rate") - F.floor("__rate")) * F.col("__source_size")).alias("wanted"))
    near = ends.join(wanted, F.col("__source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.min(F.struct(F.abs(F.col("words") - F.col("wanted")).alias("off"), "end")).alias("best"))
    return rates.join(near, F.col("__source").eqNullSafe(F.col("s"))).select(*rates.columns, F.col("best.end").alias("__threshold"))


def mix_counts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of ``df`` with ``__size, __source_size, __target, __copies``.

    One pass counts tokens and sums them; the second counts again and joins the per-source rates, which
    Spark broadcasts when they are small by their measured size and shuffles otherwise.
    """
    chance = draw(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit("")))), seed)
    sized = df.drop("__size", "__source", "__source_size", "__target", "__rate", "__threshold", "__draw", "__copies").withColumn("__size", word_count(text)).withColumn("__draw", chance)
    steps = table(sized.groupBy(F.col(source).alias("__source"), F.floor(F.col("__draw") * STEPS).cast("int").alias("__step")).agg(F.sum("__size").alias("__size")), "draws")
    rates = table(thresholds(steps, source_targets(steps, "__source", "__size", weights, budget, cap)), "rates")
    joined = sized.join(rates, F.col(source).eqNullSafe(F.col("__source")), "left")
    copies = F.floor("__rate") + F.when(F.col("__draw") < F.col("__threshold"), 1).otherwise(0)
    return joined.withColumn("__copies", copies.cast("int")).drop("__source", "__rate", "__draw", "__threshold")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``df`` with every row repeated as often as the mix takes it, columns unchanged."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s"))
    counted = mix_counts(packed, "k", "t", "s", **options).filter("__copies > 0")
    return counted.select("row", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).select("row.*")
