"""Readers of nested annotation files: one lazy DataFrame each, with an explicit schema.

Every reader gives one row per sample or annotation with a ``sample_id`` or ids of its own; malformed
records of line formats go to ``_corrupt`` instead of ending the job.  Files are named by any path that
Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COCO = """images array<struct<id:bigint, file_name:string, width:int, height:int>>,
categories array<struct<id:int, name:string, supercategory:string, frequency:string, synonyms:array<string>>>,
annotations array<struct<id:bigint, image_id:bigint, category_id:int, area:double, bbox:array<double>, iscrowd:int>>"""
MOT = "frame_id int, object_id int, x double, y double, w double, h double, confidence double, class int, visibility double"
TVQA = "qid bigint, q string, a0 string, a1 string, a2 string, a3 string, a4 string, answer_idx int, vid_name string, show string, ts_start double, ts_end double"
TRAJECTORY = "task_id string, question string, actions array<struct<action:string, parameters:map<string,string>, observation:string, thought:string, type:string>>, final_answer string, trajectory_type string, metadata map<string,string>"
ACTIVITY = "video_id string, duration double, timestamps array<array<double>>, sentences array<string>"
HIERTEXT = "annotations array<struct<image_id:string, paragraphs:array<struct<legible:boolean, lines:array<struct<text:string, legible:boolean, words:array<struct<text:string, legible:boolean>>>>>>>>"
DOCVQA = "data array<struct<questionId:bigint, question:string, answers:array<string>, image:string, question_types:array<string>>>"
OCR = "recognitionResults array<struct<page:int, lines:array<struct<boundingBox:array<int>, text:string, words:array<struct<boundingBox:array<int>, text:string, confidence:string>>>>>>"
VOS = "videos array<struct<id:bigint, width:int, height:int, length:int, file_names:array<string>>>, categories array<struct<id:int, name:string>>, annotations array<struct<id:bigint, video_id:bigint, category_id:int, bboxes:array<array<double>>, areas:array<double>, iscrowd:int>>"
MIND2WEB = "annotation_id string, confirmed_task string, website string, subdomain string, actions array<struct<action_type:string, text:string, success:boolean>>"
STAR = "question_id string, video_id string, start double, end double, question string, answer string, question_program array<struct<function:string, value_input:array<string>>>"
MSRVTT = "video_id string, category int, `start time` double, `end time` double, caption array<string>"


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, with the schema's fields only."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON line; lines that don't parse have only ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def stem(path: Column) -> Column:
    """A file's name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def coco(spark: SparkSession, path: str, min_area: float = 0.0, crowd: bool = False) -> DataFrame:
    """One row per image of a COCO or LVIS file with its annotations, categories looked up.

    Annotations below ``min_area`` and crowds (unless wanted) go; so do images without any left.
    """
    doc = document(spark, path, COCO)
    images = doc.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "image_id")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name", "c.supercategory", "c.frequency")
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.*").filter((F.col("area") >= min_area) & (F.lit(crowd) | (F.coalesce("iscrowd", F.lit(0)) == 0)))
    named = boxes.join(names, "category_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("category_"), F.col("category_id").cast("string"))))
    grouped = named.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "name", "supercategory", "frequency", "area", "bbox"))).alias("annotations"))
    return images.join(grouped, "image_id").withColumn("sample_id", F.col("image_id").cast("string"))


def mot(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of headerless MOT files: one row per object, its boxes in frame order."""
    rows = spark.read.schema(MOT).csv(path).withColumn("class", F.coalesce("class", F.lit(-1))).withColumn("visibility", F.coalesce("visibility", F.lit(1.0)))
    boxes = F.array_sort(F.collect_list(F.struct("frame_id", "x", "y", "w", "h", "confidence", "class", "visibility")))
    return rows.groupBy("object_id").agg(boxes.alias("boxes"), F.count("*").alias("detections"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


def tvqa(spark: SparkSession, path: str) -> DataFrame:
    """Questions with five answers; a missing end is five seconds after the start."""
    rows = lines(spark, path, TVQA).filter("_corrupt IS NULL AND qid IS NOT NULL")
    return rows.select(F.col("qid").cast("string").alias("sample_id"), "q", F.array("a0", "a1", "a2", "a3", "a4").alias("answers"), "answer_idx", "vid_name", "show", "ts_start", F.coalesce("ts_end", F.col("ts_start") + 5).alias("ts_end"))


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Agent traces, golden unless they say otherwise."""
    return lines(spark, path, TRAJECTORY).filter("_corrupt IS NULL").withColumn("trajectory_type", F.coalesce("trajectory_type", F.lit("golden")))


def activity(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Captioned videos, and the records held back with the reason; of repeated ids the last stays."""
    rows = document(spark, path, ACTIVITY).withColumn("__at", F.monotonically_increasing_id())
    reason = F.when(F.col("video_id").isNull(), "missing_id").when(F.col("timestamps").isNull() | F.col("sentences").isNull(), "incomplete").when(F.size("timestamps") != F.size("sentences"), "length_mismatch")
    judged = rows.withColumn("reason", reason)
    last = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("__at")))
    good = judged.filter("reason IS NULL").withColumn("__n", last).filter("__n = 1")
    events = F.transform(F.arrays_zip("timestamps", "sentences"), lambda z: F.struct(z.timestamps[0].alias("start"), z.timestamps[1].alias("end"), z.sentences.alias("sentence")))
    return good.select(F.col("video_id").alias("sample_id"), "duration", events.alias("events")), judged.filter("reason IS NOT NULL").select("video_id", "reason")


def hiertext(spark: SparkSession, path: str) -> DataFrame:
    """Words with their paragraph, line and word numbers; legibility is inherited downwards."""
    a = document(spark, path, HIERTEXT).select(F.explode("annotations").alias("a")).filter("a.image_id IS NOT NULL").select("a.*")
    p = a.select("image_id", F.posexplode("paragraphs").alias("paragraph", "p"))
    li = p.select("image_id", "paragraph", F.coalesce("p.legible", F.lit(True)).alias("lp"), F.posexplode("p.lines").alias("line", "l"))
    w = li.select("image_id", "paragraph", "line", (F.col("lp") & F.coalesce("l.legible", F.lit(True))).alias("ll"), F.posexplode("l.words").alias("word", "w"))
    return w.select("image_id", "paragraph", "line", "word", F.col("w.text").alias("text"), (F.col("ll") & F.coalesce("w.legible", F.lit(True))).alias("legible"))


def docvqa(spark: SparkSession, questions: str, ocr: str) -> DataFrame:
    """Questions with the tokens of their page, none where no sidecar has the image's name."""
    qa = document(spark, questions, DOCVQA).select(F.explode("data").alias("d")).select("d.*").withColumn("__stem", stem(F.col("image")))
    side = document(spark, ocr, OCR).withColumn("__stem", stem(F.input_file_name()))
    words = side.select("__stem", F.explode("recognitionResults").alias("r")).select("__stem", F.posexplode("r.lines").alias("line", "l")).select("__stem", "line", F.posexplode("l.words").alias("at", "w"))
    even = lambda keep: F.filter("w.boundingBox", lambda x, i: i % 2 == keep)
    box = F.array(F.array_min(even(0)), F.array_min(even(1)), F.array_max(even(0)), F.array_max(even(1)))
    tokens = words.groupBy("__stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "at", F.col("w.text").alias("text"), box.alias("box")))), lambda s: F.struct(s.text.alias("text"), s.box.alias("box"))).alias("tokens"))
    return qa.join(tokens, "__stem", "left").select(F.col("questionId").cast("string").alias("sample_id"), "question", "answers", "image", "question_types", F.coalesce("tokens", F.array().cast("array<struct<text:string,box:array<int>>>")).alias("tokens"))


def vos(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a video segmentation file: one row per track, its frames that have a box."""
    doc = document(spark, path, VOS)
    videos = doc.select(F.explode("videos").alias("v")).select(F.col("v.id").alias("video_id"), "v.width", "v.height", "v.length")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    tracks = doc.select(F.explode("annotations").alias("a")).select("a.*").join(names, "category_id", "left")
    frames = F.filter(F.transform("bboxes", lambda b, i: F.struct(i.alias("frame"), b.alias("box"))), lambda s: s.box.isNotNull())
    return tracks.join(videos, "video_id").select("video_id", F.col("id").alias("track_id"), "category", "length", frames.alias("frames"))


def mind2web(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """Web tasks of all shards, with the number of their actions and successes."""
    rows = document(spark, path, MIND2WEB).filter("annotation_id IS NOT NULL")
    rows = rows.filter(F.col("website") == domain) if domain else rows
    return rows.select(F.col("annotation_id").alias("sample_id"), F.col("confirmed_task").alias("goal"), F.col("website").alias("domain"), F.size("actions").alias("n_actions"), F.size(F.filter("actions", lambda a: F.coalesce(a.success, F.lit(True)))).alias("n_success"))


def star(spark: SparkSession, path: str) -> DataFrame:
    """Video questions with the functions of their program."""
    return document(spark, path, STAR).select(F.col("question_id").alias("sample_id"), "video_id", "start", "end", "question", "answer", F.transform("question_program", lambda p: p.function).alias("functions"))


def msrvtt(spark: SparkSession, path: str, categories: str) -> DataFrame:
    """Captioned clips with category names, by number where the table has none, and durations from 0 up."""
    names = spark.read.schema("category string, id int").option("sep", "\t").csv(categories)
    v = document(spark, path, MSRVTT).withColumnRenamed("category", "id")
    span = F.col("end time") - F.col("start time")
    return v.join(names, "id", "left").select(F.col("video_id").alias("sample_id"), F.coalesce("category", F.concat(F.lit("category_"), F.col("id").cast("string"))).alias("category"), F.greatest(span, F.lit(0.0)).alias("duration"), "caption")


def log_metrics(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The last value of each ``name: number`` in text logs, by file."""
    text = spark.read.option("wholetext", True).text(path).withColumn("file", stem(F.input_file_name()))
    last = lambda n: F.element_at(F.regexp_extract_all("value", F.lit(rf"(?i){n}\s*[:=]\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"), 1), -1).cast("double")
    return text.select("file", *[last(n).alias(n) for n in names])
