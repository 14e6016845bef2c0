"""Listings, fault-tolerant readers and the common row shape of samples.

Bad input is data: rows that can't be used go to a second DataFrame with the reason, and
:func:`error_summary` counts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import stem

VIDEO = ("mp4", "avi", "mov", "mkv", "webm", "flv", "m4v")
IMAGE = ("jpg", "jpeg", "png", "bmp", "gif", "webp")
#: The first bytes of image formats (fixed values).
HEADS = ("FFD8FF", "89504E47", "424D", "47494638", "52494646")


def listing(spark: SparkSession, path: str, *extensions: str) -> DataFrame:
    """``path, length, name, stem, extension`` of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    out = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("stem", stem(F.col("path"))).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return out.filter(F.col("extension").isin(*extensions)) if extensions else out


def json_rows(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """The documents below a path with all required fields, and the others as ``file, type``."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return _judged(rows, required, "invalid_json")


def csv_rows(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files with a header that have all required columns, and the others as ``file, type``."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return _judged(rows, required, "invalid_row")


def _judged(rows: DataFrame, required: Sequence[str], broken: str) -> tuple[DataFrame, DataFrame]:
    # A row is found to be broken only where its columns are read, so all of them are.
    read = (F.xxhash64(*[c for c, t in rows.dtypes if c != "_corrupt" and not t.startswith("map")]) % 2).isin(-1, 0, 1)
    kind = F.when(F.col("_corrupt").isNotNull() & read, broken)
    for name in required:
        kind = kind.when(F.col(name).isNull(), f"missing_{name}")
    judged = rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).withColumn("type", kind)
    return judged.filter("type IS NULL").drop("_corrupt", "type"), judged.filter("type IS NOT NULL").select("file", "type")


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: whole files as UTF-8, or as Latin-1 where they are none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    utf8 = F.expr("try_validate_utf8(CAST(content AS STRING))")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def media_problem(kind: Column, path: Column, length: Column, head: Column) -> Column:
    """What is wrong with a media file, by its place in a listing and its first bytes; null if nothing is."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    image = F.lit(False)
    for start in HEADS:
        image = image | F.hex(head).startswith(start)
    return (
        F.when(length.isNull(), "missing_file")
        .when((kind == "image") & ~F.coalesce(image, F.lit(False)), "corrupted_image")
        .when((kind == "video") & (length == 0), "empty_video")
        .when((kind == "video") & ~extension.isin(*VIDEO), "invalid_video_extension")
    )


def validated(samples: DataFrame, spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Samples (``sample_id, media_path, media_type``) whose media can be used, and the others as ``sample_id, type``.

    Spark's listings leave out empty files, so here an empty file is a missing one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("__name"), "length", F.substring("content", 1, 8).alias("__head"))
    both = samples.withColumn("__name", F.regexp_extract("media_path", r"([^/]+)$", 1)).join(files, "__name", "left")
    judged = both.withColumn("type", media_problem(F.col("media_type"), F.col("media_path"), F.col("length"), F.col("__head"))).drop("__name", "__head", "length")
    return judged.filter("type IS NULL").drop("type"), judged.filter("type IS NOT NULL").select("sample_id", "type")


def error_summary(errors: DataFrame, sample: str, first: int = 10) -> DataFrame:
    """``type, n, first``: how many errors of each type there are, and the first samples by name."""
    least = errors.groupBy("type", sample).agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("type").orderBy(sample))
    few = least.withColumn("at", at).filter(F.col("at") <= first).groupBy("type").agg(F.array_sort(F.collect_list(F.col(sample).cast("string"))).alias("first"))
    return least.groupBy("type").agg(F.sum("c").alias("n")).join(few, "type")


def envelope(rows: DataFrame, dataset: str, sample_id: Column, media_path: Column, media_type: str, *annotations: str, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Rows in the common shape: ``source_dataset, sample_id, media_type, media_path, width, height, annotations``."""
    size = lambda c: (c if c is not None and media_type == "image" else F.lit(None)).cast("int")
    return rows.select(F.lit(dataset).alias("source_dataset"), sample_id.cast("string").alias("sample_id"), F.lit(media_type).alias("media_type"), media_path.alias("media_path"), size(width).alias("width"), size(height).alias("height"), F.struct(*annotations).alias("annotations"))


def present(rows: DataFrame, name: Column, files: DataFrame) -> DataFrame:
    """Rows whose file is in a listing, by its name or else by its stem under any extension; ``file`` is the name found."""
    names = files.select(F.col("name").alias("__name")).distinct()
    stems = files.groupBy(F.col("stem").alias("__stem")).agg(F.min("name").alias("__other"))
    both = rows.withColumn("__want", name).join(names, F.col("__want") == F.col("__name"), "left").join(stems, stem(F.col("__want")) == F.col("__stem"), "left")
    return both.withColumn("file", F.coalesce("__name", "__other")).filter("file IS NOT NULL").drop("__want", "__name", "__stem", "__other")
