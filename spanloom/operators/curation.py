"""Filters and statistics of annotated samples: rows with a key and an array of instances.

An instance is a struct with at least ``category``, ``area`` and ``bbox`` (x, y, width, height).  Filters keep
or drop whole samples unless they say that they prune instances.  Samples without instances (null or empty
arrays) have count 0 and pass no filter that asks for an instance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

INSTANCES = "instances"


def gather(rows: DataFrame, key: str, **fields: Column) -> DataFrame:
    """One sample per key with its rows as instances, ordered by the instances' fields."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()]))).alias(INSTANCES))


def count(instances: str = INSTANCES) -> Column:
    """The number of instances; none for null."""
    return F.coalesce(F.size(F.col(instances)), F.lit(0)) if instances else F.lit(0)


def centre(bbox: Column) -> Column:
    """The middle of a box, (0, 0) if it isn't one."""
    fine = (F.size(bbox) >= 4) & (bbox[2] > 0) & (bbox[3] > 0)
    return F.when(fine, F.array(bbox[0] + bbox[2] / 2, bbox[1] + bbox[3] / 2)).otherwise(F.array(F.lit(0.0), F.lit(0.0)))


def histogram(rows: DataFrame, key: str, instances: str = INSTANCES) -> DataFrame:
    """``key, category, n``: how many instances of each category a sample has."""
    return rows.select(key, F.explode(instances).alias("i")).groupBy(key, F.col("i.category").alias("category")).agg(F.count("*").alias("n"))


def with_category(rows: DataFrame, category: str, instances: str = INSTANCES) -> DataFrame:
    """Samples with an instance of the category."""
    return rows.filter(F.exists(instances, lambda i: i.category == category))


def between(rows: DataFrame, low: int = 1, high: int | None = None, instances: str = INSTANCES) -> DataFrame:
    """Samples with at least ``low`` and at most ``high`` instances."""
    n = count(instances)
    return rows.filter((n >= low) & (F.lit(True) if high is None else n <= high))


def diverse(rows: DataFrame, least: int = 3, instances: str = INSTANCES) -> DataFrame:
    """Samples with at least so many different categories."""
    return rows.filter(F.size(F.array_distinct(F.transform(instances, lambda i: i.category))) >= least)


def having(rows: DataFrame, good: Callable[[Column], Column], instances: str = INSTANCES) -> DataFrame:
    """Samples with any good instance, all of whose instances stay."""
    return rows.filter(F.exists(instances, good))


def pruned(rows: DataFrame, good: Callable[[Column], Column], instances: str = INSTANCES) -> DataFrame:
    """Samples with any good instance, whose other instances go."""
    return rows.withColumn(instances, F.filter(instances, good)).filter(F.size(instances) > 0)


def quality(iou: float = 0.9, stability: float = 0.95) -> Callable[[Column], Column]:
    """Instances whose ``predicted_iou`` and ``stability_score`` are high enough."""
    return lambda i: (i.predicted_iou >= iou) & (i.stability_score >= stability)


def area(low: float, high: float | None = None) -> Callable[[Column], Column]:
    """Instances of an area in a range."""
    return lambda i: (i.area >= low) & (F.lit(True) if high is None else i.area <= high)


def comparable(rows: DataFrame, low: int = 2, high: int = 10, least: float = 1.5, most: float = 50.0, instances: str = INSTANCES) -> DataFrame:
    """Samples of a few instances whose largest and smallest areas differ enough and not too much."""
    areas = F.transform(instances, lambda i: i.area)
    ratio = F.try_divide(F.array_max(areas), F.array_min(areas))
    return between(rows, low, high, instances).filter((F.array_min(areas) > 0) & ratio.between(least, most))


def lookup(rows: DataFrame, column: str, value, required: bool = False) -> DataFrame:
    """The first row (by all columns) with a value; an error if one is required and there is none."""
    found = rows.filter(F.col(column) == F.lit(value)).orderBy(*[c for c, t in rows.dtypes if not t.startswith("map")]).limit(1)
    if required and found.isEmpty():
        raise LookupError(f"no row with {column} = {value!r}")
    return found


def frequency_class(images: Column, rare: int = 10, common: int = 100) -> Column:
    """``r``, ``c`` or ``f`` by the number of images that a category is in."""
    return F.when(images <= rare, "r").when(images <= common, "c").otherwise("f")


def coverage_ratio(instances: str, width: Column, height: Column) -> Column:
    """The share of an image that the instances' areas make up; 0 without an image area."""
    return F.coalesce(F.try_divide(F.aggregate(instances, F.lit(0.0), lambda a, i: a + i.area), width * height), F.lit(0.0))


def mean_of(instances: str, field: str, digits: int = 4) -> Column:
    """The mean of a field over the instances, rounded half to even; 0 without instances."""
    total = F.aggregate(instances, F.lit(0.0), lambda a, i: a + i[field])
    return F.when(F.size(instances) > 0, F.bround(total / F.size(instances), digits)).otherwise(0.0)


def size_bands(instances: str = INSTANCES, small: float = 1000, large: float = 10000) -> Column:
    """Numbers of small, medium and large instances, and their whole area."""
    n = lambda good: F.size(F.filter(instances, good)).cast("long")
    total = F.aggregate(instances, F.lit(0.0), lambda a, i: a + i.area)
    return F.struct(n(lambda i: i.area < small).alias("small"), n(lambda i: (i.area >= small) & (i.area < large)).alias("medium"), n(lambda i: i.area >= large).alias("large"), total.alias("total_area"))


def geometry_statistics(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """``n, smallest, largest, mean, upper_median`` of a value over groups; the upper median by rank."""
    named = rows.select(*by, value.alias("value")).filter("value IS NOT NULL")
    stats = named.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("smallest"), F.max("value").alias("largest"), F.avg("value").alias("mean"))
    # The value whose running count first passes half: counts per distinct value, so no group is one buffer.
    from pyspark.sql import Window

    counts = named.groupBy(*by, "value").agg(F.count("*").alias("c"))
    running = Window.partitionBy(*by).orderBy("value")
    placed = counts.withColumn("upto", F.sum("c").over(running)).withColumn("all", F.sum("c").over(Window.partitionBy(*by)))
    median = placed.filter(F.expr("upto >= all div 2 + 1")).groupBy(*by).agg(F.min("value").alias("upper_median"))
    return stats.join(median, list(by)) if by else stats.crossJoin(median)  # one row each without groups


def track_statistics(rows: DataFrame, sequence: str, item: str, frame: str) -> DataFrame:
    """Per sequence: objects, detections, shortest, mean and longest track, objects per distinct frame."""
    tracks = rows.groupBy(sequence, item).agg(F.count("*").alias("length"))
    frames = rows.groupBy(sequence).agg(F.countDistinct(frame).alias("frames"))
    per = tracks.groupBy(sequence).agg(F.count("*").alias("objects"), F.sum("length").alias("detections"), F.min("length").alias("shortest"), F.avg("length").alias("mean_length"), F.max("length").alias("longest"))
    return per.join(frames, sequence).withColumn("objects_per_frame", F.col("detections") / F.col("frames"))


def items_between(rows: DataFrame, key: str, item: str, low: int = 1, high: float = float("inf")) -> DataFrame:
    """Keys with a number of distinct items in a range, and the number."""
    return rows.groupBy(key).agg(F.countDistinct(item).alias("n")).filter(F.col("n").between(low, F.lit(high)))


def completeness(*columns: str) -> Column:
    """The share of the columns that are not null."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def availability(rows: DataFrame, key: str, **sides: DataFrame) -> DataFrame:
    """``rows`` with one flag per side table: whether it has the row's key."""
    for name, side in sides.items():
        keys = side.select(F.col(key).alias("__k")).distinct().withColumn(name, F.lit(True))
        rows = rows.join(keys, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def by_precedence(rows: DataFrame, key: str, dense: DataFrame, sparse: DataFrame, value: str) -> DataFrame:
    """``rows`` with the dense side's value, else the sparse side's, and where it is from."""
    side = lambda t, n: t.select(F.col(key).alias(f"__{n}"), F.col(value).alias(f"__{n}_value"))
    both = rows.join(side(dense, "dense"), F.col(key) == F.col("__dense"), "left").join(side(sparse, "sparse"), F.col(key) == F.col("__sparse"), "left")
    source = F.when(F.col("__dense").isNotNull(), "dense").when(F.col("__sparse").isNotNull(), "sparse").otherwise("none")
    return both.withColumn("source", source).withColumn(value, F.when(F.col("source") == "dense", F.col("__dense_value")).otherwise(F.col("__sparse_value"))).drop("__dense", "__sparse", "__dense_value", "__sparse_value")


def paired(a: DataFrame, b: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of two tables by their place within a key, as far as both go (``a`` and ``b`` as structs)."""
    from pyspark.sql import Window

    def placed(t: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        return t.select(F.col(key), F.row_number().over(w).alias("at"), F.struct(*t.columns).alias(name))

    return placed(a, "a").join(placed(b, "b"), [key, "at"])


def relative_area(w: Column, h: Column, width: Column, height: Column) -> Column:
    """The band of a box's share of its image."""
    return scalar.size_band(F.coalesce(F.try_divide(w * h, width * height), F.lit(0.0)))
