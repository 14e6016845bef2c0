"""Readers of further annotated datasets: one lazy DataFrame each, with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .readers import document, lines, stem

SA1B = "image struct<image_id:bigint, width:int, height:int, file_name:string>, annotations array<struct<id:bigint, bbox:array<double>, area:double, segmentation:struct<size:array<int>, counts:string>, predicted_iou:double, stability_score:double, point_coords:array<array<double>>, crop_box:array<double>>>"
ART = "map<string, array<struct<transcription:string, points:array<array<int>>, language:string, illegibility:boolean>>>"
AWS_WORD = "struct<Text:string, Confidence:double, Geometry:struct<BoundingBox:struct<Left:double, Top:double, Width:double, Height:double>>>"
INFOGRAPHICS = "data array<struct<questionId:bigint, question:string, answers:array<string>, image_local_name:string>>"
INFOGRAPHICS_OCR = f"LINE array<{AWS_WORD}>, WORD array<{AWS_WORD}>, words array<struct<text:string, bbox:array<double>, confidence:double>>"
TEXTCAPS = "data array<struct<image_id:string, caption_str:string, reference_strs:array<string>, image_classes:array<string>, set_name:string, image_width:int, image_height:int>>"
TEXTCAPS_OCR = "data array<struct<image_id:string, ocr_tokens:array<string>, ocr_info:array<struct<bounding_box:struct<top_left_x:double, top_left_y:double, width:double, height:double>>>>>"
FLICKR = "raw string, sentids string, split string, filename string, img_id bigint"
ASSEMBLY = "id bigint, video string, start_frame int, end_frame int, action_id int, verb_id int, noun_id int, action_cls string, verb_cls string, noun_cls string, toy_id string, toy_name string, is_shared int, is_RGB int"
DIDEMO = "annotation_id string, video string, description string, times array<array<int>>, train_times array<array<int>>, reference_description string, context string"
UNSPLASH = "annotations array<struct<box:array<double>, desc:string>>"
COTA = "sample_id string, task_type string, sample_type string, question string, answer string, trajectory array<struct<action:string, parameters:map<string,string>, thought:string>>, provenance map<string,string>"
FAILURE = "case_id string, task string, success boolean, confidence double, error string, tools array<string>"
ANNOTATION = "annotation_id string, sample_id string, annotator string, left_rating int, right_rating int, preference string, minutes double"
LINEAGE = "nodes map<string, struct<name:string, type:string, version:string, run_id:string>>, edges map<string, array<string>>"
REGISTRY = "map<string, struct<name:string, status:string, path:string>>"
UVO_TRACKS = "annotations array<struct<id:int, object_id:int, frame_id:int, image_id:int, bbox:array<double>, area:double>>"


def sa1b(spark: SparkSession, folder: str, min_area: float = 0.0, min_stability: float = 0.0, min_iou: float = 0.0) -> DataFrame:
    """One row per image with a mask file of its name: its masks above the bounds, their middles, sums and means.

    Files that don't parse go, and so do images without a mask left.
    """
    masks, _ = files.json_rows(spark, f"{folder}/*.json", SA1B, ["annotations"])
    images = files.listing(spark, folder, "jpg", "jpeg", "png").select(F.col("stem").alias("__stem"), F.col("name").alias("image_file"))
    kept = F.filter("annotations", lambda a: (a.area >= min_area) & (a.stability_score >= min_stability) & (a.predicted_iou >= min_iou) & (a.bbox[2] > 0) & (a.bbox[3] > 0))
    made = F.transform(kept, lambda a: F.struct(a.id.alias("id"), a.bbox.alias("bbox"), a.area.alias("area"), a.predicted_iou.alias("predicted_iou"), a.stability_score.alias("stability_score"), F.array(a.bbox[0] + a.bbox[2] / 2, a.bbox[1] + a.bbox[3] / 2).alias("center")))
    rows = masks.withColumn("__stem", stem(F.col("file"))).join(images, "__stem").withColumn("annotations", made).filter(F.size("annotations") > 0)
    mean = lambda f: F.bround(F.aggregate("annotations", F.lit(0.0), lambda s, a: s + a[f]) / F.size("annotations"), 4)
    return rows.select(
        F.coalesce(F.col("image.image_id").cast("string"), "__stem").alias("sample_id"), "image_file", F.coalesce("image.width", F.lit(0)).alias("width"), F.coalesce("image.height", F.lit(0)).alias("height"),
        "annotations", F.size("annotations").alias("num_masks"), F.aggregate("annotations", F.lit(0.0), lambda s, a: s + a.area).alias("total_area"), mean("stability_score").alias("avg_stability_score"), mean("predicted_iou").alias("avg_predicted_iou"),
    )


def sa1b_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same files, only ids and masks with a segmentation: a pruned schema reads no more."""
    pruned = "image struct<image_id:bigint>, annotations array<struct<id:bigint, area:double, segmentation:struct<size:array<int>, counts:string>>>"
    rows, _ = files.json_rows(spark, f"{folder}/*.json", pruned, ["annotations"])
    kept = F.filter("annotations", lambda a: F.length(a.segmentation.counts) > 0)
    return rows.select(F.concat(F.lit("sa1b_"), F.col("image.image_id").cast("string")).alias("sample_id"), kept.alias("annotations")).filter(F.size("annotations") > 0)


def art(spark: SparkSession, annotations: str, images: str) -> DataFrame:
    """Scene text of images that are there, without illegible text; the language is ``unknown`` unless given."""
    whole = spark.read.option("wholetext", True).text(annotations).select(F.explode(F.from_json("value", ART)).alias("image_id", "texts"))
    there = files.listing(spark, images, *files.IMAGE)
    found = files.present(whole, F.concat("image_id", F.lit(".jpg")), there)
    legible = F.filter("texts", lambda t: ~F.coalesce(t.illegibility, F.lit(False)))
    return found.select(F.col("image_id").alias("sample_id"), "file", F.transform(legible, lambda t: F.struct(t.transcription.alias("text"), t.points.alias("polygon"), F.coalesce(t.language, F.lit("unknown")).alias("language"))).alias("scene_text"))


def aws_tokens(line: str = "LINE", word: str = "WORD", words: str = "words") -> Column:
    """Tokens of an OCR result: its lines, or else its words, or else its plain words."""
    boxed = lambda c: F.transform(F.filter(c, lambda t: t.Text.isNotNull() & t.Geometry.BoundingBox.isNotNull()), lambda t: F.struct(t.Text.alias("text"), F.array(*[F.coalesce(t.Geometry.BoundingBox[k], F.lit(0.0)) for k in ("Left", "Top", "Width", "Height")]).alias("bbox"), F.coalesce(t.Confidence, F.lit(0.0)).alias("confidence")))
    plain = F.transform(words, lambda t: F.struct(t.text.alias("text"), F.coalesce(t.bbox, F.array(*[F.lit(0.0)] * 4)).alias("bbox"), F.coalesce(t.confidence, F.lit(0.0)).alias("confidence")))
    return F.coalesce(boxed(line), boxed(word), plain, F.array().cast("array<struct<text:string,bbox:array<double>,confidence:double>>"))


def infographics(spark: SparkSession, questions: str, ocr: str) -> DataFrame:
    """Questions with the tokens of their image, by its name and else by its stem; none where there is no OCR."""
    qa = document(spark, questions, INFOGRAPHICS).select(F.explode("data").alias("d")).select("d.*").withColumn("__stem", stem(F.col("image_local_name")))
    side = document(spark, ocr, INFOGRAPHICS_OCR).select(stem(F.input_file_name()).alias("__stem"), aws_tokens().alias("tokens"))
    return qa.join(side, "__stem", "left").select(F.col("questionId").cast("string").alias("sample_id"), "question", "answers", "image_local_name", F.coalesce("tokens", F.array().cast("array<struct<text:string,bbox:array<double>,confidence:double>>")).alias("tokens"))


def textcaps(spark: SparkSession, captions: str, ocr: str, images: str) -> DataFrame:
    """Captioned images that are there and have OCR, tokens beside their boxes (null boxes where too few)."""
    c = document(spark, captions, TEXTCAPS).select(F.explode("data").alias("d")).select("d.*")
    o = document(spark, ocr, TEXTCAPS_OCR).select(F.explode("data").alias("d")).select("d.image_id", "d.ocr_tokens", "d.ocr_info")
    both = files.present(c.join(o, "image_id"), F.concat("image_id", F.lit(".jpg")), files.listing(spark, images, *files.IMAGE))
    per = F.transform("reference_strs", lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    box = lambda i: F.get("ocr_info", i).bounding_box
    tokens = F.transform("ocr_tokens", lambda t, i: F.struct(t.alias("text"), F.when(box(i).isNotNull(), F.array(*[F.coalesce(box(i)[k], F.lit(0.0)) for k in ("top_left_x", "top_left_y", "width", "height")])).alias("bbox")))
    mean = F.coalesce(F.bround(F.try_divide(F.aggregate(per, F.lit(0).cast("long"), lambda a, n: a + n), F.size("reference_strs")), 2), F.lit(0.0))
    return both.select(F.col("image_id").alias("sample_id"), "file", "reference_strs", "image_classes", "set_name", tokens.alias("tokens"), mean.alias("avg_caption_words"))


def flickr(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One row per image with all its captions; rows whose list of captions doesn't parse go."""
    rows = spark.read.schema(FLICKR).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    listed = rows.withColumn("captions", F.from_json("raw", "array<string>")).filter("captions IS NOT NULL")
    listed = listed.filter(F.col("split") == split) if split else listed
    grouped = listed.groupBy("filename").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("img_id", "captions"))), lambda s: s.captions)).alias("captions"), F.min("split").alias("split"), F.min("img_id").alias("img_id"))
    return grouped.select(F.col("filename").alias("sample_id"), "captions", F.size("captions").alias("num_captions"), "split", "img_id")


def star_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """All key frames of each video, in file order."""
    rows = spark.read.schema("video_id string, keyframe_id string").option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    return rows.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "keyframe_id"))), lambda s: s.keyframe_id).alias("keyframes"))


def star_segments(spark: SparkSession, path: str) -> DataFrame:
    """The last segment of each video in its file."""
    rows = spark.read.schema("video_id string, start double, end double").option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    last = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("at")))
    return rows.withColumn("n", last).filter("n = 1").drop("n", "at")


def assembly101(spark: SparkSession, path: str, videos: str) -> DataFrame:
    """Action segments of videos that are there; ``-`` stands for nothing, frames are counted inclusively."""
    rows = spark.read.schema(ASSEMBLY).option("header", True).csv(path)
    there = files.listing(spark, videos, *files.VIDEO).select(F.col("name").alias("video"))
    kept = rows.join(there, "video", "left_semi")
    some = lambda c: F.nullif(F.col(c), F.lit("-")).alias(c)
    return kept.select(F.concat(F.lit("segment_"), F.col("id").cast("string")).alias("sample_id"), "video", "start_frame", "end_frame", (F.col("end_frame") - F.col("start_frame") + 1).alias("duration_frames"), "action_cls", "verb_cls", "noun_cls", some("toy_id"), some("toy_name"), (F.col("is_shared") == 1).alias("is_shared"))


def segment_seconds(span: Column) -> Column:
    """Start and end in seconds of a span of five-second pieces, (0, 0) without one."""
    return F.when(F.size(span) >= 2, F.array(span[0] * 5.0, (span[1] + 1) * 5.0)).otherwise(F.array(F.lit(0.0), F.lit(0.0)))


def didemo(spark: SparkSession, path: str, videos: str) -> DataFrame:
    """Described moments of videos that are there, by name or by stem."""
    rows = document(spark, path, DIDEMO).withColumn("__at", F.monotonically_increasing_id())
    found = files.present(rows, F.col("video"), files.listing(spark, videos, *files.VIDEO))
    first = F.when(F.size("train_times") > 0, F.get("train_times", F.lit(0))).when(F.size("times") > 0, F.get("times", F.lit(0)))
    everyone = F.transform(F.coalesce("times", F.array().cast("array<array<int>>")), segment_seconds)
    return found.select(F.coalesce("annotation_id", F.concat(F.lit("moment_"), F.col("__at").cast("string"))).alias("sample_id"), "file", "description", segment_seconds(first).alias("moment"), everyone.alias("all_moments"), "context")


def epic_classes(spark: SparkSession, path: str) -> DataFrame:
    """``class_id, class``: from columns ``noun_id, noun`` or ``id, name``, or else the first two."""
    rows = spark.read.option("header", True).csv(path)
    pair = next((p for p in (("noun_id", "noun"), ("id", "name")) if set(p) <= set(rows.columns)), tuple(rows.columns[:2]))
    return rows.select(F.col(pair[0]).try_cast("int").alias("class_id"), F.col(pair[1]).alias("class")).filter("class_id IS NOT NULL")


def flat_map(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a JSON file that is one flat object."""
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def epic(spark: SparkSession, root: str) -> DataFrame:
    """Videos of both splits with a sparse or a dense annotation, and how dense the annotations are."""
    parts = None
    for split in ("train", "val"):
        side = files.listing(spark, f"{root}/{split}", "json").select(F.lit(split).alias("split"), "stem", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("kind"), "length")
        parts = side if parts is None else parts.union(side)
    grouped = parts.groupBy("split", F.col("stem").alias("video_id")).agg(F.bool_or(F.col("kind") == "sparse").alias("sparse"), F.bool_or(F.col("kind") == "dense").alias("dense"), F.sum(F.when(F.col("kind") == "dense", F.col("length"))).alias("dense_bytes"), F.sum(F.when(F.col("kind") == "sparse", F.col("length"))).alias("sparse_bytes"))
    return grouped.filter("sparse OR dense").select(F.col("video_id").alias("sample_id"), "split", "sparse", "dense", F.try_divide("dense_bytes", "sparse_bytes").alias("density"))


def translated(rows: DataFrame, values: Column, frames: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``key, field, value, original`` of flat annotations (a map), with ids of frames and classes looked up by what the field is called."""
    flat = rows.select(key, F.explode(values).alias("field", "original"))
    low = F.lower("field")
    f = frames.select(F.col("key").alias("__f"), F.col("value").alias("__frame"))
    c = classes.select(F.col("class_id").cast("string").alias("__c"), F.col("class").alias("__class"))
    is_frame, is_class = low.contains("frame"), low.contains("class") & low.contains("id")
    both = flat.join(f, is_frame & (F.col("original") == F.col("__f")), "left").join(c, is_class & (F.col("original") == F.col("__c")), "left")
    return both.select(key, "field", F.coalesce("__frame", "__class", "original").alias("value"), "original")


def video_id(path: Column) -> Column:
    """The video that a file belongs to: its folder where that is named like a video, or else its stem."""
    folder, name = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), stem(path)
    like = folder.startswith("video") | F.regexp_replace(folder, "[_-]", "").rlike("^[0-9]+$")
    return F.when(like, folder).when((name != "") & ~name.startswith("."), name)


def uvo(spark: SparkSession, videos: str, **annotations: str) -> DataFrame:
    """Base videos (files or folders of frames) with the newest file by name of each annotation folder that has one."""
    files_ = files.listing(spark, videos)
    base = files_.select(F.when(F.col("extension").isin("mp4", "avi", "mov", "mkv"), F.col("stem")).otherwise(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("video_id")).distinct()
    for name, folder in annotations.items():
        side = files.listing(spark, folder).select(video_id(F.col("path")).alias("video_id"), "path").groupBy("video_id").agg(F.max("path").alias(name))
        base = base.join(side, "video_id", "left")
    return base


def uvo_masks(spark: SparkSession, folder: str) -> DataFrame:
    """``object_id, frames`` of mask files named by frame and object; other names are passed over."""
    name = F.regexp_replace("stem", "_", "-")
    part = lambda i: F.regexp_extract(name, r"^([0-9]+)-([0-9]+)$", i).try_cast("int")
    rows = files.listing(spark, folder, "png").select(part(1).alias("frame"), part(2).alias("object_id"), "name").filter("frame IS NOT NULL AND object_id IS NOT NULL")
    return rows.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("frame", "name"))).alias("frames"))


def uvo_tracks(spark: SparkSession, path: str) -> DataFrame:
    """``object_id, frames`` of an annotation file; ids and frames under either name, 0 without one."""
    rows = document(spark, path, UVO_TRACKS).select(F.explode("annotations").alias("a")).select(F.coalesce("a.id", "a.object_id", F.lit(0)).alias("object_id"), F.coalesce("a.frame_id", "a.image_id", F.lit(0)).alias("frame"), "a.bbox", "a.area")
    return rows.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("frame", "area", "bbox"))).alias("frames"), F.count("*").alias("length"))


def part_pairs(spark: SparkSession, images: str, masks: str) -> DataFrame:
    """Images with a mask of their stem; the class is what comes before the first underscore."""
    i = files.listing(spark, images, *files.IMAGE).select("stem", F.col("name").alias("image"))
    m = files.listing(spark, masks, "png").select("stem", F.col("name").alias("mask"))
    return i.join(m, "stem").select(F.col("stem").alias("sample_id"), F.split_part("stem", F.lit("_"), F.lit(1)).alias("class"), "image", "mask")


def unsplash(spark: SparkSession, images: str, annotations: str, annotated: bool = False) -> DataFrame:
    """Listed images with the described regions of their sidecar; regions without a box or text go."""
    i = files.listing(spark, images, *files.IMAGE).select("stem", "name", "length", "extension")
    a = document(spark, annotations, UNSPLASH).select(stem(F.input_file_name()).alias("stem"), "annotations")
    good = F.filter(F.transform("annotations", lambda r, k: F.struct(k.alias("region_id"), r.box.alias("box"), r["desc"].alias("description"))), lambda r: (F.size(r.box) >= 4) & r.description.isNotNull())
    regions = F.transform(good, lambda r: F.struct(r.region_id.alias("region_id"), r.description.alias("description"), F.array(r.box[0], r.box[1], r.box[2] - r.box[0], r.box[3] - r.box[1]).alias("bbox")))
    both = i.join(a, "stem", "inner" if annotated else "left")
    return both.select(F.col("stem").alias("sample_id"), F.col("name").alias("file"), "length", "extension", F.coalesce(regions, F.array().cast("array<struct<region_id:int,description:string,bbox:array<double>>>")).alias("regions")).orderBy("sample_id")


def mot_sequences(spark: SparkSession, root: str) -> DataFrame:
    """Sequence folders with frames and a truth file: their first and last frame, frames between, objects, frames listed."""
    folder = lambda c: F.regexp_extract(c, r"([^/]+)/[^/]+/[^/]+$", 1)
    truth = spark.read.schema("frame_id int, object_id int").csv(f"{root}/*/gt/gt.txt").withColumn("sequence", folder(F.input_file_name()))
    spans = truth.groupBy("sequence").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.countDistinct("object_id").alias("objects"))
    frames = files.listing(spark, root, "jpg", "png").groupBy(folder(F.col("path")).alias("sequence")).agg(F.count("*").alias("listed"))
    found = spans.join(frames, "sequence")
    return found.select("sequence", F.coalesce("first", F.lit(1)).alias("first"), F.coalesce("last", F.lit(1)).alias("last"), F.coalesce(F.col("last") - F.col("first") + 1, F.lit(1)).alias("frames"), "objects", "listed")


def cota(spark: SparkSession, path: str) -> DataFrame:
    """Generated samples: a list of them, or an object that holds one as ``samples``."""
    listed = document(spark, path, f"{COTA}, samples array<struct<{', '.join(c.replace(' ', ':', 1) for c in COTA.split(', '))}>>")
    plain = listed.filter("samples IS NULL").drop("samples")
    nested = listed.filter("samples IS NOT NULL").select(F.explode("samples").alias("s")).select("s.*")
    return plain.unionByName(nested)


def failures(spark: SparkSession, path: str) -> DataFrame:
    """Cases that did not succeed; a case that says nothing did."""
    return lines(spark, path, FAILURE).filter("_corrupt IS NULL").filter(~F.coalesce("success", F.lit(True))).drop("_corrupt")


def annotations(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """Annotations of single files and of session files; each is written to both, so ``once`` keeps one by id."""
    single = spark.read.schema(ANNOTATION).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    session = spark.read.schema(ANNOTATION).option("pathGlobFilter", "session_*.jsonl").json(folder)
    both = single.unionByName(session)
    return both.dropDuplicates(["annotation_id"]) if once else both


def experiment_results(spark: SparkSession, root: str) -> DataFrame:
    """``experiment, seed, metric, value``: of the files of a run the final metrics win over the evaluation's."""
    parts = []
    for at, name in enumerate(("evaluation_results", "final_metrics")):
        text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.json").text(root).withColumn("path", F.input_file_name())
        parts.append(text.select(F.regexp_extract("path", r"([^/]+)/seed_[0-9]+/[^/]+$", 1).alias("experiment"), F.regexp_extract("path", r"seed_([0-9]+)/", 1).cast("int").alias("seed"), F.lit(at).alias("order"), F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value")))
    w = Window.partitionBy("experiment", "seed", "metric").orderBy(F.desc("order"))
    return parts[0].union(parts[1]).withColumn("n", F.row_number().over(w)).filter("n = 1").select("experiment", "seed", "metric", "value")


def registry(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The entry of one experiment."""
    whole = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", REGISTRY)).alias("id", "e"))
    return whole.filter(F.col("id") == key).select("id", "e.*")


def lineage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``node, name, type, version, run_id`` and ``parent, child`` of a lineage file."""
    doc = document(spark, path, LINEAGE)
    return doc.select(F.explode("nodes").alias("node", "n")).select("node", "n.*"), doc.select(F.explode("edges").alias("parent", "c")).select("parent", F.explode("c").alias("child"))


def rle_mask(counts: Column, height: Column, width: Column) -> Column:
    """Pixels, column by column, of run lengths that begin with zeros; all zeros where they don't fill the mask."""
    pixels = F.flatten(F.transform(counts, lambda n, i: F.array_repeat((i % 2).cast("int"), n.cast("int"))))
    return F.when(F.size(pixels) == height * width, pixels).otherwise(F.array_repeat(F.lit(0), (height * width).cast("int")))
