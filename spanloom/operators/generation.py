"""Task generation, validation and curricula: rows to rows, with every random choice fixed by a keyed hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import share_of

# What a finished sample's question and trajectory must measure.
QUESTION_CHARS = (10, 500)
TRAJECTORY_STEPS = (2, 20)


def problems(question: Column, answer: Column, steps: Column, known: Column) -> Column:
    """The names of the rules a sample breaks."""
    rules = (
        (~F.length(question).between(*QUESTION_CHARS), "question_length"),
        (F.trim(answer) == "", "empty_answer"),
        (~steps.between(*TRAJECTORY_STEPS), "trajectory_length"),
        (~known, "unknown_action"),
        (question.isNull() | answer.isNull(), "missing_field"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in rules]))


def completeness(*present: Column) -> Column:
    """The share of fields that are there."""
    return reduce(lambda a, b: a + b, [F.when(p, 1).otherwise(0) for p in present]) / len(present)


def grid(spark, **choices: list) -> DataFrame:
    """One row per combination of values."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in choices.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)  # the product is what is asked for


def blinded(pairs: DataFrame, key: str, left: str, right: str, seed: int = 3) -> DataFrame:
    """``pairs`` with sides swapped for half of the keys, and whether they were."""
    swap = share_of(F.col(key), seed) < 0.5
    return pairs.withColumn("swapped", swap).withColumns({left: F.when(swap, F.col(right)).otherwise(F.col(left)), right: F.when(swap, F.col(left)).otherwise(F.col(right))})


def pairs_of(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """For each group one task: its two rows of the smallest keyed order, and which has the larger value."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key))
    two = df.withColumn("__at", at).filter("__at <= 2").groupBy(group).agg(F.count("*").alias("__n"), F.min(F.struct("__at", key, value)).alias("a"), F.max(F.struct("__at", key, value)).alias("b"))
    larger = F.when(F.col(f"a.{value}") > F.col(f"b.{value}"), F.col(f"a.{key}")).otherwise(F.col(f"b.{key}"))
    return two.filter("__n = 2").select(group, F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"), larger.alias("answer"))


def perturbed(df: DataFrame, key: str, order: list[str], op: str, wrong: str, seed: int = 5) -> DataFrame:
    """Each sequence with one wrong step put in front of a hash-chosen step, flagged."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    where = n.select(key, (F.floor(share_of(F.col(key), seed) * F.col("__n")) + 1).cast("int").alias("__where"))
    numbered = df.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    plain = numbered.select(key, F.col("step").cast("double").alias("step"), F.col(op).alias(op), F.lit(False).alias("injected"))
    return plain.unionByName(where.select(key, (F.col("__where") - 0.5).alias("step"), F.lit(wrong).alias(op), F.lit(True).alias("injected")))


def energy_rank(df: DataFrame, group: list[str], order: str, energy: str, share: float) -> DataFrame:
    """The least number of leading components whose energy reaches a share of all, largest first."""
    w = Window.partitionBy(*group).orderBy(F.desc(energy), order) if group else Window.orderBy(F.desc(energy), order)
    all_ = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    run = F.sum(energy).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(energy).over(all_)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("share", run).filter(F.col("share") >= share).groupBy(*group).agg(F.min("rank").alias("rank"))


def curriculum(df: DataFrame, key: str, order: list[str], metric: str, goals: list[float], patience: int) -> DataFrame:
    """``key, stage``: how far a stage machine comes that advances when ``patience`` values in a row reach its goal."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, metric))), lambda s: s[metric])
    goal = lambda stage: F.coalesce(F.get(F.array(*map(F.lit, goals)), stage), F.lit(float("inf")))
    start = F.struct(F.lit(0).alias("stage"), F.lit(0).alias("streak"))

    def step(s: Column, x: Column) -> Column:
        streak = F.when(x >= goal(s.stage), s.streak + 1).otherwise(0)
        done = streak >= patience
        return F.struct(F.when(done, s.stage + 1).otherwise(s.stage).alias("stage"), F.when(done, 0).otherwise(streak).alias("streak"))

    return df.groupBy(key).agg(values.alias("v")).select(key, F.aggregate("v", start, step, lambda s: s.stage).alias("stage"))


#: Operations that distract from a first operation, and the thoughts that lead back.
DISTRACTORS = {"ZOOM_IN": ("READ_TEXT", "GET_PROPERTIES"), "SEGMENT_OBJECT_AT": ("ZOOM_IN", "TRACK_OBJECT"), "READ_TEXT": ("SEGMENT_OBJECT_AT", "ZOOM_IN"), "GET_PROPERTIES": ("READ_TEXT", "TRACK_OBJECT")}
THOUGHTS = {"ZOOM_IN": ("This is too far away to read.", "Properties need a closer look."), "SEGMENT_OBJECT_AT": ("Zooming does not separate it.", "There is nothing to follow yet."), "READ_TEXT": ("There is text to read first.", "The text is large enough.")}


def _pick(options, key: Column) -> Column:
    at = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % len(options)
    return F.element_at(F.array(*map(F.lit, options)), (at + 1).cast("int"))


def distractor(op: Column, key: Column) -> Column:
    """An operation that leads away from the first one, by a digest of the key; segmentation for unknown ones."""
    out = F.lit("SEGMENT_OBJECT_AT")
    for name, options in DISTRACTORS.items():
        out = F.when(op == name, _pick(options, key)).otherwise(out)
    return out


def corrective(op: Column, key: Column) -> Column:
    """The thought that leads back from a distractor."""
    out = F.lit("That did not help.")
    for name, options in THOUGHTS.items():
        out = F.when(op == name, _pick(options, key)).otherwise(out)
    return out


def wrong_count(count: Column, key: Column) -> Column:
    """A count that is one too many or one too few (0 at least), by a digest of the key."""
    odd = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 2
    return F.when(odd == 0, count + 1).otherwise(F.greatest(count - 1, F.lit(0)))


def first_and_last(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``first, last, n``: where a track of two rows at least begins and ends."""
    pick = F.struct(*order, value)
    s = rows.groupBy(*keys).agg(F.min(pick)[value].alias("first"), F.max(pick)[value].alias("last"), F.count("*").alias("n"))
    return s.filter("n >= 2")


def projected(rows: DataFrame, key: str, most: int, **fields: Column) -> DataFrame:
    """The first ``most`` rows by key as tasks."""
    return rows.orderBy(key).limit(most).select(key, *[c.alias(n) for n, c in fields.items()])


def trapped(rows: DataFrame, key: str, order: list[str], column: str, at: int, wrong: str) -> DataFrame:
    """Sequences whose ``at``-th value is replaced."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__at", F.row_number().over(w)).withColumn(column, F.when(F.col("__at") == at, wrong).otherwise(F.col(column))).drop("__at")


def mixed(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``rows`` with ``kind``, in shares that sum to 1, by a digest of the key."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    names = list(shares)
    out, upto = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        upto = sum(shares[n] for n in names[: names.index(name) + 1])
        out = F.when(u < upto, name).otherwise(out)
    return rows.withColumn("kind", out)


def zooms(rows: DataFrame, levels: list[float], side: str) -> DataFrame:
    """One row per zoom level with the side of what is cut out."""
    return rows.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).select(*[c for c in rows.columns if c != side], "level", (F.col(side) / F.col("level")).alias("side"))
