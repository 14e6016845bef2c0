"""Texts, frames, masks and generated tasks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import media, scalar, texts
from ..operators import generation
from .tables import ORDER, read, steps


def _six(df, *names):
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def _pairs(spark, d):
    """A turn's text and the same turn's text of the conversation before."""
    t = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    return t.join(t.select((F.col("conv_id") + 1).alias("conv_id"), "turn", F.col("t").alias("o")), ["conv_id", "turn"])


def word_error_rate(spark, d):
    """Word error rates between turns of neighbouring conversations."""
    return _six(_pairs(spark, d).select("conv_id", "turn", texts.word_error(F.col("t"), F.col("o")).alias("wer")), "wer")


def fuzzy_task_reward(spark, d):
    """Rewards for answers that are like the truth: parts' names beside the next part's."""
    p = read(spark, d, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("o")), "p_partkey")
    return _six(both.select("p_partkey", texts.fuzzy_reward(F.col("p_name"), F.col("o")).alias("reward")), "reward")


def ocr_metrics(spark, d):
    """Exact and case-blind matches of parts' types, by brand."""
    p = read(spark, d, "part").select("p_brand", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.lit("x")).alias("read"))
    return _six(p.groupBy("p_brand").agg(F.avg(texts.ocr_score(F.col("read"), F.col("p_type"))).alias("score"), F.avg((F.col("read") == F.col("p_type")).cast("double")).alias("exact")), "score", "exact")


def web_complexity(spark, d):
    """Complexity of orders as web tasks."""
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("kinds"), F.bool_or(F.col("l_linestatus") == "O").alias("text"))
    return o.select("l_orderkey", texts.complexity(F.col("n").cast("double"), F.col("kinds").cast("double"), F.col("text")).alias("complexity"))


def _responses(spark, d):
    """A user's events of a day as the lines of a response."""
    s = steps(spark, d).withColumn("day", F.to_date("ts"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.concat(F.lit("do "), F.col("op")).alias("line")))), lambda x: x.line), "\n")
    return s.groupBy("user_id", "day").agg(F.concat(listed, F.lit("\n<answer> a"), F.count("*").cast("string"), F.lit(" </answer>\nend")).alias("r"), F.count("*").alias("n"))


def answer_extract(spark, d):
    """The answers of responses, and of those without their end."""
    r = _responses(spark, d).withColumn("r", F.when(F.col("n") % 2 == 0, F.replace("r", F.lit("</answer>"), F.lit(""))).otherwise(F.col("r")))
    return r.select("user_id", "day", texts.answer(F.col("r")).alias("answer"))


def trajectory_parse(spark, d):
    """Operations that responses' lines name, by kind."""
    s = _responses(spark, d).select(F.explode(texts.steps(F.col("r"))).alias("s"))
    return s.groupBy(F.col("s.operation").alias("operation"), F.col("s.type").alias("type")).agg(F.count("*").alias("n"))


def prompt_format(spark, d):
    """Digests of samples as texts."""
    s = steps(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "op"))), lambda x: x.op).alias("ops"))
    t = s.select("user_id", texts.prompt(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.col("ops"), F.element_at("ops", -1)).alias("t"))
    return t.select("user_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


def error_texts(spark, d):
    """Digests of errors as texts."""
    e = read(spark, d, "events").filter("event_type = 'error'")
    t = texts.error_text(F.col("user_id").cast("string"), F.col("event_type"), F.repeat(F.col("props"), 40), F.array(*[F.lit(x) for x in "abcdefg"]))
    return e.select("event_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


def text_corruption(spark, d):
    """Digests of parts' names with a fifth of their letters corrupted."""
    p = read(spark, d, "part")
    return p.select("p_partkey", texts.corrupted(F.col("p_name"), 0.2, F.col("p_partkey")).alias("corrupted"))


def content_ids(spark, d):
    """Ids of parts by what they are."""
    p = read(spark, d, "part")
    return p.select("p_partkey", texts.content_id("cota_", name=F.col("p_name"), brand=F.col("p_brand")).alias("id"), texts.content_id("", 32, "md5", size=F.col("p_size"), type=F.col("p_type")).alias("key"))


def prompt_templates(spark, d):
    """Prompts by template and part."""
    t = ("How large is the {thing}?", "Is the {thing} of {brand} there?", "{brand}: count each {thing}.")
    return read(spark, d, "part").select("p_partkey", texts.filled(t, F.col("p_partkey"), thing=F.col("p_type"), brand=F.col("p_brand")).alias("prompt"))


def result_table(spark, d):
    """Mean and deviation of quantities as text, by flag and status."""
    g = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
    return g.select("l_returnflag", "l_linestatus", texts.mean_and_std(F.col("m"), F.col("s")).alias("cell"))


def content_filter(spark, d):
    """Documents that are short enough and hold no blocked words, by source."""
    return read(spark, d, "documents").groupBy("source").agg(F.count_if(texts.appropriate(F.col("text"), ("password", "token"), 5000)).alias("fine"), F.count("*").alias("n"))


def answer_subsequence_match(spark, d):
    """Where benchmark items begin in documents that hold their first eight words in a row."""
    eight = F.slice(scalar.words(F.lower("text")), 1, 8)
    b = read(spark, d, "benchmark").select("item_id", eight.alias("wanted")).filter(F.size("wanted") == 8).withColumn("first", F.array_join(F.slice("wanted", 1, 4), " "))
    w = read(spark, d, "documents").select("doc_id", scalar.words(F.col("text")).alias("tokens")).filter(F.size("tokens") >= 8)
    # Items meet only documents that hold their first four words in a row.
    grams = w.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("tokens") - 3), lambda i: F.lower(F.array_join(F.slice("tokens", i, 4), " "))))).alias("first"))
    met = grams.join(b, "first").select("doc_id", "item_id", "wanted").join(w, "doc_id")
    return met.select("doc_id", "item_id", texts.subsequence(F.col("tokens"), F.col("wanted")).alias("at")).filter("at IS NOT NULL")


def property_full_outer_match(spark, d):
    """Properties of a user's neighbouring events that agree, differ or are on one side."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = read(spark, d, "events").withColumn("n", F.row_number().over(w)).withColumn("p", F.map_concat(F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"), F.col("value").cast("string")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))))
    long = e.select("user_id", "n", F.explode("p").alias("name", "v"))
    both = long.join(long.select("user_id", (F.col("n") + 1).alias("n"), "name", F.col("v").alias("o")), ["user_id", "n", "name"], "full_outer")
    return both.groupBy("user_id", "name").agg(F.count_if(texts.property_matches(F.col("v"), F.col("o"))).alias("same"), F.count_if(F.col("v").isNull() | F.col("o").isNull()).alias("alone"), F.count("*").alias("n"))


def frame_ranges(spark, d):
    """Time ranges as frames and back."""
    s = F.get_json_object("props", "$.k").cast("double")
    e = read(spark, d, "events").select("event_id", media.range_to_frames(s, s + F.col("value"), F.lit(29.97)).alias("f"))
    back = media.frames_to_range(F.col("f")[0], F.col("f")[1], F.lit(29.97))
    return _six(e.select("event_id", F.col("f")[0].alias("first"), F.col("f")[1].alias("last"), back[0].alias("start"), back[1].alias("end")), "start", "end")


def frame_sampling(spark, d):
    """How many frames each strategy takes, and their sums."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, d, "events").select("event_id", k.alias("a"), (k + F.floor("value").cast("long")).alias("b"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    each = [total(media.sampled(F.col("a"), F.col("b"), s)).alias(s) for s in ("all", "uniform", "endpoints", "middle")]
    return e.select("event_id", *each)


def frames_clamped(spark, d):
    """Frame ranges within a video of a hundred frames."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, d, "events").select("event_id", media.clamped(k + 20, k + 20 + F.floor("value").cast("long"), F.lit(100)).alias("r"), F.size(media.inside(F.array(F.col("value"), F.col("value") / 2, -F.col("value")), F.lit(2.0), F.lit(200))).alias("inside"))
    return e.select("event_id", F.col("r")[0].alias("first"), F.col("r")[1].alias("last"), "inside")


def time_strings(spark, d):
    """Seconds of times written in three ways."""
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.when(F.col("event_id") % 3 == 0, F.format_string("%d:%02d:%02d", k, k % 60, F.col("event_id") % 60)).when(F.col("event_id") % 3 == 1, F.format_string("%d:%02d", k, F.col("event_id") % 60)).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return read(spark, d, "events").select("event_id", scalar.parse_time(t).alias("seconds"))


def _masks(spark, d):
    """Masks of 8 by 8 pixels from neighbouring vectors' signs."""
    v = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0.05).cast("int")).alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def mask_metrics(spark, d):
    """Overlap, Dice and pixel accuracy of masks, and the first one's box."""
    m = _masks(spark, d).withColumn("c", media.mask_counts(F.col("a"), F.col("b"))).withColumn("box", media.mask_box(F.col("a"), F.lit(8)))
    c = F.col("c")
    return _six(m.select("vec_id", media.mask_iou(c).alias("iou"), media.dice(c).alias("dice"), (c.same / c.n).alias("accuracy"), F.array_join(F.col("box").cast("array<string>"), ",").alias("box")), "iou", "dice", "accuracy")


def boundary_scores(spark, d):
    """Boundary F1 of masks, pixels met within one."""
    return _six(_masks(spark, d).select("vec_id", media.boundary_f1(F.col("a"), F.col("b"), F.lit(8), 1).alias("f1")), "f1")


def size_and_position(spark, d):
    """Sizes of parts as boxes, where they are, and their bands."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"), ((F.col("p_retailprice") % 100) / 100.0).alias("y"))
    s = media.size_properties(F.col("x") * F.col("y"), F.col("x"), F.col("y"), F.lit(1.0), F.lit(1.0))
    q = media.position(F.col("x"), F.col("y"))
    return _six(p.select("p_partkey", s.relative.alias("relative"), s.diagonal.alias("diagonal"), s.aspect.alias("aspect"), q.centre_distance.alias("centre"), q.edge_proximity.alias("edge")), "relative", "diagonal", "aspect", "centre", "edge")


def labels_by_band(spark, d):
    """Names of agreements, bottlenecks, effects and compressions by discount and quantity."""
    li = read(spark, d, "lineitem")
    return li.groupBy(media.agreement_label(F.col("l_discount") * 9).alias("agreement"), media.bottleneck_label(F.col("l_quantity")).alias("bottleneck"), scalar.effect_label(F.col("l_tax") * 12).alias("effect"), media.compression_ratio(F.col("l_quantity")).alias("compression")).agg(F.count("*").alias("n"))


def sampling_weights(spark, d):
    """Training weights of documents by kind and quality."""
    kind = F.when(F.col("toxic") == 1, "trap").when(F.col("doc_id") % 2 == 0, "self_correction").otherwise("golden")
    j = read(spark, d, "labels").select("doc_id", media.sampling_weight(kind, (F.col("quality") + 1) / 2).alias("weight"))
    return _six(j, "weight")


def rank_constraints(spark, d):
    """Ranks of parts within bounds, and drawn towards their brand's mean."""
    p = read(spark, d, "part").withColumn("rank", media.rank_limit(F.col("p_size")))
    return p.select("p_partkey", "rank", media.smoothed_rank(F.col("rank"), F.avg("rank").over(Window.partitionBy("p_brand"))).alias("smooth"))


def kl_penalty(spark, d):
    """Divergence between neighbouring vectors as logits."""
    v = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("a"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return _six(both.select("vec_id", media.kl_divergence(F.col("a"), F.col("b")).alias("kl")), "kl")


def model_pairs(spark, d):
    """All pairs of event types, those with errors first, and what they compare."""
    t = read(spark, d, "events").select("event_type").distinct()
    pairs = t.alias("a").join(t.alias("b"), F.col("a.event_type") < F.col("b.event_type")).select(F.col("a.event_type").alias("one"), F.col("b.event_type").alias("two"))
    return pairs.withColumn("first", F.col("one").contains("error") | F.col("two").contains("error")).withColumn("category", media.comparison_category(F.col("one"), F.col("two")))


def center_tracking(spark, d):
    """Events as boxes' centres: matches by distance to a user's last one, and switches of type."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = read(spark, d, "events").select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("away"), (F.col("event_type") != F.lag("event_type").over(w)).alias("switched"))
    s = e.groupBy("user_id").agg(F.avg((F.col("away") < 50).cast("double")).alias("mota"), (1 - F.avg(F.when(F.col("away") < 50, F.col("away"))) / 100).alias("motp"), F.count_if(F.col("switched") & (F.col("away") < 50)).alias("switches"))
    return _six(s, "mota", "motp")


def counting_samples(spark, d):
    """Counting tasks by order and flag: how many there are, and what a wrong answer says."""
    n = read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("count"))
    return n.select("l_orderkey", "l_returnflag", "count", generation.wrong_count(F.col("count"), F.concat_ws(":", F.col("l_orderkey").cast("string"), "l_returnflag")).alias("trap"))


def tracking_tasks(spark, d):
    """First and last value of each user's event type that occurs twice at least."""
    return generation.first_and_last(read(spark, d, "events"), ["user_id", "event_type"], ORDER, "value")


def ocr_tasks(spark, d):
    """Reading tasks from the first documents with text."""
    return generation.projected(read(spark, d, "documents").filter("length(text) > 0"), "doc_id", 50, question=F.lit("What does it say?"), answer=F.substring("text", 1, 20))


def trap_trajectories(spark, d):
    """Sequences whose second observation is replaced: how many steps differ."""
    t = generation.trapped(steps(spark, d), "user_id", ORDER, "op", 2, "WRONG")
    return t.groupBy("user_id").agg(F.count_if(F.col("op") == "WRONG").alias("wrong"), F.count("*").alias("n"))


def dataset_mix(spark, d):
    """Orders as golden, trap and corrected samples in given shares."""
    return generation.mixed(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"golden": 0.5, "trap": 0.3, "self_correction": 0.2}).groupBy("kind").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def distractors(spark, d):
    """A distractor for each sequence by its first operation, and the thought that mends it."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    first = steps(spark, d).withColumn("at", F.row_number().over(w)).filter("at = 1")
    return first.select("user_id", generation.distractor(F.col("op"), F.col("user_id")).alias("distractor"), generation.corrective(F.col("op"), F.col("user_id")).alias("thought"))


def zoom_levels(spark, d):
    """One row per part and zoom level, with the cut's size."""
    return _six(generation.zooms(read(spark, d, "part").select("p_partkey", "p_retailprice"), [1.0, 1.5, 2.0], "p_retailprice"), "side")


QUERIES = {n: f for n, f in list(globals().items()) if getattr(f, "__module__", None) == __name__ and not n.startswith("_")}

_OPS = "CASE event_type WHEN 'view' THEN 'ZOOM_IN' WHEN 'click' THEN 'SEGMENT_OBJECT_AT' WHEN 'purchase' THEN 'GET_PROPERTIES' WHEN 'signup' THEN 'READ_TEXT' WHEN 'error' THEN 'THINK' END"
_R = f"r AS (SELECT user_id, ts::DATE AS day, string_agg('do ' || {_OPS}, chr(10) ORDER BY ts, event_id) || chr(10) || '<answer> a' || count(*) || ' </answer>' || chr(10) || 'end' AS r, count(*) AS n FROM events GROUP BY ALL)"
_u = lambda salt: f"(('0x' || substr(md5('7{salt}:' || p_partkey || ':' || (i - 1)), 1, 6))::BIGINT / 16777216.0::DOUBLE)"
_MASK = "v AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0.05::DOUBLE)::INT) AS a FROM embeddings), m AS (SELECT v.vec_id, v.a, w.a AS b FROM v JOIN v w ON w.vec_id = v.vec_id + 1)"
_k = "(props->>'$.k')::BIGINT"
_hash8 = lambda key: f"('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT"
_case = lambda table, key: "CASE op " + " ".join(f"WHEN '{op}' THEN list_extract([{', '.join(repr(x) for x in options)}], ({_hash8(key)} % {len(options)} + 1)::INT)" for op, options in table.items()) + " END"

ORACLE_SQL = {
    "ocr_metrics": "WITH p AS (SELECT p_brand, p_type, CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type ELSE 'x' END AS r FROM part) SELECT p_brand, round(avg(CASE WHEN r = p_type THEN 1.0::DOUBLE WHEN lower(r) = lower(p_type) THEN 0.5 ELSE 0 END), 6) AS score, round(avg(CASE WHEN r = p_type THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact FROM p GROUP BY p_brand",
    "web_complexity": "SELECT l_orderkey, round_even(least(count(*) * 0.1::DOUBLE + count(DISTINCT l_returnflag) * 0.2::DOUBLE + CASE WHEN bool_or(l_linestatus = 'O') THEN 0.3::DOUBLE ELSE 0 END, 1), 3) AS complexity FROM lineitem GROUP BY l_orderkey",
    "answer_extract": f"WITH {_R} SELECT user_id, day, CASE WHEN n % 2 = 0 THEN 'end' ELSE 'a' || n END AS answer FROM r",
    "trajectory_parse": f"SELECT {_OPS} AS operation, CASE WHEN event_type = 'error' THEN 'reasoning' ELSE 'visual' END AS type, count(*) AS n FROM events GROUP BY ALL",
    "prompt_format": f"WITH s AS (SELECT user_id, {_OPS} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), t AS (SELECT user_id, 'Question: user ' || user_id || chr(10) || string_agg('Step ' || pos || ': ' || op, chr(10) ORDER BY pos) || chr(10) || 'Answer: ' || last(op ORDER BY pos) AS t FROM s GROUP BY user_id) SELECT user_id, length(t)::INTEGER AS chars, md5(t) AS digest FROM t",
    "error_texts": "WITH t AS (SELECT event_id, 'task: ' || user_id || ' | error: error | context: ' || substr(repeat(props, 40), 1, 200) || ' | tools: a,b,c,d,e' AS t FROM events WHERE event_type = 'error') SELECT event_id, md5(t) AS digest, length(t)::INTEGER AS chars FROM t",
    "text_corruption": f"WITH c AS (SELECT p_partkey, string_split(p_name, '') AS s FROM part), l AS (SELECT p_partkey, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM c) SELECT p_partkey, string_agg(CASE WHEN {_u('a')} >= 0.2::DOUBLE THEN c WHEN {_u('b')} < 0.33::DOUBLE THEN c || c WHEN {_u('b')} < 0.66::DOUBLE THEN '' ELSE chr((97 + floor({_u('c')} * 26))::INT) END, '' ORDER BY i) AS corrupted FROM l GROUP BY p_partkey",
    "content_ids": """SELECT p_partkey, 'cota_' || substr(sha256('{"brand": "' || p_brand || '", "name": "' || p_name || '"}'), 1, 12) AS id, md5('{"size": "' || p_size || '", "type": "' || p_type || '"}') AS key FROM part""",
    "prompt_templates": f"SELECT p_partkey, CASE {_hash8('p_partkey')} % 3 WHEN 0 THEN 'How large is the ' || p_type || '?' WHEN 1 THEN 'Is the ' || p_type || ' of ' || p_brand || ' there?' ELSE p_brand || ': count each ' || p_type || '.' END AS prompt FROM part",
    "result_table": "SELECT l_returnflag, l_linestatus, printf('%.3f', avg(l_quantity)) || ' ± ' || printf('%.3f', stddev_samp(l_quantity)) AS cell FROM lineitem GROUP BY ALL",
    "content_filter": "SELECT source, count(*) FILTER (WHERE length(text) <= 5000 AND NOT contains(lower(text), 'password') AND NOT contains(lower(text), 'token')) AS fine, count(*) AS n FROM documents GROUP BY source",
    "answer_subsequence_match": r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x09-\x0D\x20]+')[1:8] AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x09-\x0D\x20]+') AS t FROM documents),
      g AS (SELECT doc_id, i, array_to_string(t[i:i + 7], ' ') AS gram FROM d, unnest(range(1, len(t) - 6)) u(i)) SELECT doc_id, item_id, min(i)::INTEGER AS "at" FROM g JOIN b ON gram = array_to_string(w, ' ') WHERE len(w) = 8 GROUP BY ALL""",
    "property_full_outer_match": f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), l AS (SELECT user_id, n, 'k' AS name, {_k}::DOUBLE AS x, NULL AS s FROM e UNION ALL SELECT user_id, n, 'value', value, NULL FROM e UNION ALL SELECT user_id, n, 'type', NULL, event_type FROM e WHERE event_id % 2 = 0),
      f AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.name, b.name) AS name, a.n IS NULL OR b.n IS NULL AS alone, coalesce(CASE WHEN a.name = 'type' THEN a.s = b.s WHEN b.x = 0 THEN a.x = 0 ELSE abs(a.x - b.x) / abs(b.x) < 0.1::DOUBLE END, false) AS same FROM l a FULL JOIN l b ON a.user_id = b.user_id AND a.n = b.n + 1 AND a.name = b.name)
      SELECT user_id, name, count(*) FILTER (WHERE same AND NOT alone) AS same, count(*) FILTER (WHERE alone) AS alone, count(*) AS n FROM f GROUP BY ALL""",
    "frame_ranges": f"WITH f AS (SELECT event_id, floor({_k}::DOUBLE * 29.97::DOUBLE)::BIGINT AS a, ceil(({_k}::DOUBLE + value) * 29.97::DOUBLE)::BIGINT AS b FROM events) SELECT event_id, a AS first, b AS last, round(a / 29.97::DOUBLE, 6) AS start, round((b + 1) / 29.97::DOUBLE, 6) AS \"end\" FROM f",
    "frame_sampling": f"""WITH e AS (SELECT event_id, {_k} AS a, {_k} + floor(value)::BIGINT AS b FROM events) SELECT event_id, (a + b) * (b - a + 1) // 2 AS "all", CASE WHEN b - a + 1 <= 8 THEN (a + b) * (b - a + 1) // 2 ELSE list_sum(list_transform(range(8), lambda i: a + i * (b - a) // 7))::BIGINT END AS uniform, CASE WHEN a = b THEN a ELSE a + b END AS endpoints, (a + b) // 2 AS middle FROM e""",
    "frames_clamped": f"WITH e AS (SELECT event_id, {_k} + 20 AS a, {_k} + 20 + floor(value)::BIGINT AS b, value FROM events) SELECT event_id, CASE WHEN a < 100 THEN a END AS first, CASE WHEN a < 100 THEN least(b, 99) END AS last, (CASE WHEN round_even(value * 2, 0) < 200 THEN 1 ELSE 0 END + CASE WHEN round_even(value / 2 * 2, 0) < 200 THEN 1 ELSE 0 END + CASE WHEN round_even(-value * 2, 0) >= 0 THEN 1 ELSE 0 END) AS inside FROM e",
    "time_strings": f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {_k} * 3600 + {_k} % 60 * 60 + event_id % 60 WHEN 1 THEN {_k} * 60 + event_id % 60 ELSE {_k} + 0.5::DOUBLE END::DOUBLE AS seconds FROM events",
    "mask_metrics": f"""WITH {_MASK}, c AS (SELECT vec_id, a, list_sum(a) AS sa, list_sum(b) AS sb, list_dot_product(a::DOUBLE[], b::DOUBLE[]) AS both_, list_filter(list_transform(range(64), lambda i: CASE WHEN a[i + 1] > 0 THEN i END), lambda x: x IS NOT NULL) AS p FROM m)
      SELECT vec_id, round(CASE WHEN sa + sb - both_ = 0 THEN 1 ELSE both_ / (sa + sb - both_) END, 6) AS iou, round(2 * both_ / nullif(sa + sb, 0), 6) AS dice, round((64 - sa - sb + 2 * both_) / 64, 6) AS accuracy, CASE WHEN len(p) > 0 THEN list_min(list_transform(p, lambda i: i % 8)) || ',' || list_min(list_transform(p, lambda i: i // 8)) || ',' || list_max(list_transform(p, lambda i: i % 8)) || ',' || list_max(list_transform(p, lambda i: i // 8)) END AS box FROM c""",
    "size_and_position": "WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, (p_retailprice % 100) / 100.0::DOUBLE AS y FROM part) SELECT p_partkey, round(x * y, 6) AS relative, round(sqrt(x * x + y * y), 6) AS diagonal, round(coalesce(x / nullif(y, 0), 0), 6) AS aspect, round(sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)), 6) AS centre, round(least(x, y, 1 - x, 1 - y), 6) + 0.0 AS edge FROM p",
    "labels_by_band": "WITH l AS (SELECT l_discount * 9 AS a, l_quantity AS q, abs(l_tax * 12) AS e FROM lineitem) SELECT CASE WHEN a < 0.4::DOUBLE THEN 'poor' WHEN a < 0.6::DOUBLE THEN 'fair' WHEN a < 0.75::DOUBLE THEN 'good' ELSE 'excellent' END AS agreement, CASE WHEN q >= 50 THEN 'critical' WHEN q >= 30 THEN 'high' WHEN q >= 20 THEN 'medium' WHEN q >= 10 THEN 'low' ELSE 'minimal' END AS bottleneck, CASE WHEN e < 0.2::DOUBLE THEN 'negligible' WHEN e < 0.5::DOUBLE THEN 'small' WHEN e < 0.8::DOUBLE THEN 'medium' ELSE 'large' END AS effect, CASE WHEN q <= 8 THEN 0.01::DOUBLE WHEN q <= 16 THEN 0.05 WHEN q <= 32 THEN 0.1 ELSE 0.15 END AS compression, count(*) AS n FROM l GROUP BY ALL",
    "sampling_weights": "SELECT doc_id, round(CASE WHEN toxic = 1 THEN 1.5::DOUBLE WHEN doc_id % 2 = 0 THEN 1.2::DOUBLE ELSE 1 END * sqrt((quality + 1) / 2.0::DOUBLE), 6) AS weight FROM labels",
    "rank_constraints": "WITH r AS (SELECT p_partkey, p_brand, least(greatest(p_size, 4), 64) AS r FROM part), s AS (SELECT p_partkey, p_brand, (CASE WHEN r > 16 THEN 2 ** round_even(log2(r), 0) ELSE r END)::INTEGER AS rank FROM r) SELECT p_partkey, rank, trunc(0.5::DOUBLE * avg(rank) OVER (PARTITION BY p_brand) + 0.5::DOUBLE * rank)::INTEGER AS smooth FROM s",
    "kl_penalty": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4) AS a FROM embeddings), e AS (SELECT vec_id, list_transform(a, lambda x: exp(x)) AS e FROM v), s AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
      SELECT s.vec_id, round(list_sum(list_transform(list_zip(s.p, t.p), lambda z: z[1] * (ln(z[1]) - ln(z[2] + 1e-8)))), 6) + 0.0 AS kl FROM s JOIN s t ON t.vec_id = s.vec_id + 1""",
    "model_pairs": "WITH t AS (SELECT DISTINCT event_type AS m FROM events) SELECT a.m AS one, b.m AS two, contains(a.m, 'error') OR contains(b.m, 'error') AS first, 'other' AS category FROM t a JOIN t b ON a.m < b.m",
    "center_tracking": "WITH e AS (SELECT user_id, abs(value - lag(value) OVER w) AS away, event_type <> lag(event_type) OVER w AS switched FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(avg(CASE WHEN away < 50 THEN 1.0::DOUBLE WHEN away IS NOT NULL THEN 0 END), 6) AS mota, round(1 - avg(away) FILTER (WHERE away < 50) / 100, 6) AS motp, count(*) FILTER (WHERE switched AND away < 50) AS switches FROM e GROUP BY user_id",
    "counting_samples": f"SELECT l_orderkey, l_returnflag, count(*) AS count, CASE WHEN {_hash8('l_orderkey || chr(58) || l_returnflag')} % 2 = 0 THEN count(*) + 1 ELSE greatest(count(*) - 1, 0) END AS trap FROM lineitem GROUP BY l_orderkey, l_returnflag",
    "tracking_tasks": "SELECT user_id, event_type, first(value ORDER BY ts, event_id) AS first, last(value ORDER BY ts, event_id) AS last, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2",
    "ocr_tasks": "SELECT doc_id, 'What does it say?' AS question, substr(text, 1, 20) AS answer FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 50",
    "trap_trajectories": "SELECT user_id, CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END::BIGINT AS wrong, count(*) AS n FROM events GROUP BY user_id",
    "dataset_mix": f"WITH u AS (SELECT o_orderkey, ('0x' || substr(md5('7:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders) SELECT CASE WHEN u < 0.5::DOUBLE THEN 'golden' WHEN u < 0.8::DOUBLE THEN 'trap' ELSE 'self_correction' END AS kind, count(*) AS n, min(o_orderkey) AS first FROM u GROUP BY kind",
    "distractors": f"WITH s AS (SELECT user_id, {_OPS} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) SELECT user_id, coalesce({_case(generation.DISTRACTORS, 'user_id')}, 'SEGMENT_OBJECT_AT') AS distractor, coalesce({_case(generation.THOUGHTS, 'user_id')}, 'That did not help.') AS thought FROM s WHERE pos = 1",
    "zoom_levels": "SELECT p_partkey, level::DOUBLE AS level, round(p_retailprice / level, 6) AS side FROM part, (VALUES (1.0::DOUBLE), (1.5), (2.0)) z(level)",
}
