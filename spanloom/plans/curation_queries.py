"""Annotated samples on the driver's tables: an order is an image, its lines are the instances in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation
from .tables import read


def _instances(spark, d):
    li = read(spark, d, "lineitem")
    h = F.col("l_extendedprice") / 1000
    return li.select(
        F.struct("_metadata.file_path", "_metadata.row_index").alias("stored"),
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("id"), F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("category"),
        F.array((F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"), F.col("l_quantity"), h).alias("bbox"),
        (F.col("l_quantity") * h).alias("area"), (1 - F.col("l_discount")).alias("predicted_iou"), (1 - F.col("l_tax")).alias("stability_score"),
    )


def _samples(spark, d, *first):
    fields = (*first, "id", "category", "bbox", "area", "predicted_iou", "stability_score")
    return curation.gather(_instances(spark, d), "image", **{f: F.col(f) for f in fields})


def _counted(df):
    return df.select("image", curation.count().alias("n"))


def _six(df, *names):
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def samples_by_category(spark, d):
    """Images with an instance of one category."""
    return _counted(curation.with_category(_samples(spark, d), "c7"))


def samples_by_complexity(spark, d):
    """Images with two to five instances."""
    return _counted(curation.between(_samples(spark, d), 2, 5))


def category_histogram(spark, d):
    """How many instances of each category an image has, where more than one."""
    return curation.histogram(_samples(spark, d), "image").filter("n > 1")


def _classes(spark, d):
    n = _instances(spark, d).groupBy("category").agg(F.countDistinct("image").alias("images"), F.count("*").alias("instances"))
    least = n.agg(F.percentile("images", F.array(F.lit(0.33), F.lit(0.66))).alias("p"))  # one row
    return n.crossJoin(least).select("category", "images", "instances", F.when(F.col("images") <= F.col("p")[0], "r").when(F.col("images") <= F.col("p")[1], "c").otherwise("f").alias("frequency"))


def frequency_classes(spark, d):
    """Categories and instances by rare, common and frequent."""
    return _classes(spark, d).groupBy("frequency").agg(F.count("*").alias("categories"), F.sum("instances").alias("instances"), F.sort_array(F.collect_list("category"))[0].alias("first"))


def rare_samples(spark, d):
    """Images with an instance of a rare category."""
    rare = _classes(spark, d).filter("frequency = 'r'").select("category")
    return _instances(spark, d).join(rare, "category", "left_semi").groupBy("image").agg(F.count("*").alias("n"))


def samples_diverse(spark, d):
    """Images with four categories at least."""
    return _counted(curation.diverse(_samples(spark, d), 4))


def quality_samples(spark, d):
    """Images with any good instance, with all instances."""
    return _counted(curation.having(_samples(spark, d), curation.quality(0.98, 0.95)))


def quality_instances(spark, d):
    """Images with any good instance, with the good ones only."""
    return _counted(curation.pruned(_samples(spark, d), curation.quality(0.98, 0.95)))


def area_pruned(spark, d):
    """Images with instances of an area between 500 and 1500."""
    return _counted(curation.pruned(_samples(spark, d), curation.area(500, 1500)))


def comparison_suitable(spark, d):
    """Images whose instances can be compared by area."""
    return _counted(curation.comparable(_samples(spark, d)))


def box_centres(spark, d):
    """The mean centre of an image's boxes and their mean aspect."""
    c = _instances(spark, d).select("image", curation.centre(F.col("bbox")).alias("c"), (F.col("bbox")[2] / F.col("bbox")[3]).alias("aspect"))
    return _six(c.groupBy("image").agg(F.avg(F.col("c")[0]).alias("x"), F.avg(F.col("c")[1]).alias("y"), F.avg("aspect").alias("aspect")), "x", "y", "aspect")


def size_bands(spark, d):
    """Small, medium and large instances of an image and their area."""
    return _six(_samples(spark, d).select("image", curation.size_bands(small=500, large=1500).alias("b")).select("image", "b.*"), "total_area")


def sample_quality(spark, d):
    """Mean quality of an image's instances and the share of a 100 by 100 image they cover, both summed in the order in which rows are stored."""
    s = _samples(spark, d, "stored")
    q = s.select("image", curation.mean_of("instances", "stability_score", 6).alias("stability"), curation.mean_of("instances", "predicted_iou", 6).alias("iou"), curation.coverage_ratio("instances", F.lit(100.0), F.lit(100.0)).alias("coverage"))
    # As the SQL rounds: the product's fraction decides, not the number's shortest decimal form.
    return q.withColumn("coverage", F.round(F.col("coverage") * 1e6) / 1e6)


def area_statistics(spark, d):
    """Area statistics by frequency class, with the upper median."""
    areas = _instances(spark, d).join(_classes(spark, d).select("category", "frequency"), "category")
    return _six(curation.geometry_statistics(areas, F.col("area"), "frequency"), "smallest", "largest", "mean", "upper_median")


def area_statistics_overall(spark, d):
    """Area statistics over all instances."""
    return _six(curation.geometry_statistics(_instances(spark, d), F.col("area")), "smallest", "largest", "mean", "upper_median")


def vocabulary_coverage(spark, d):
    """How many parts of each size any line uses."""
    used = read(spark, d, "lineitem").select("l_partkey").distinct().withColumn("used", F.lit(1))
    p = read(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    return _six(p.groupBy("p_size").agg(F.count("*").alias("parts"), F.count("used").alias("used")).withColumn("ratio", F.col("used") / F.col("parts")), "ratio")


def _tracks(spark, d):
    return read(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))


def track_statistics(spark, d):
    """Tracks of a user's event types over days."""
    return _six(curation.track_statistics(_tracks(spark, d), "user_id", "event_type", "day"), "mean_length", "objects_per_frame")


def tracking_overall(spark, d):
    """Sums over all sequences, and how many have how many objects."""
    return curation.track_statistics(_tracks(spark, d), "user_id", "event_type", "day").groupBy("objects").agg(F.count("*").alias("sequences"), F.sum("detections").alias("detections"), F.max("longest").alias("longest"))


def objects_between(spark, d):
    """Orders whose lines are of three or four suppliers."""
    return curation.items_between(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 3, 4)


def duration_between(spark, d):
    """Customers with orders on five to fifteen days."""
    return curation.items_between(read(spark, d, "orders"), "o_custkey", "o_orderdate", 5, 15)


def annotation_completeness(spark, d):
    """How complete documents are, where by half at least."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").withColumn("complete", curation.completeness("text", "lang", "source", "quality", "toxic"))
    return _six(docs.filter("complete >= 0.5").groupBy("complete").agg(F.count("*").alias("n")), "complete")


def both_annotations(spark, d):
    """Documents with a label that have a benchmark item of the same number."""
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return read(spark, d, "labels").select("doc_id").join(b, "doc_id", "left_semi")


def availability_flags(spark, d):
    """Documents by which side tables have them."""
    sides = {"labelled": read(spark, d, "labels"), "benchmarked": read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))}
    return curation.availability(read(spark, d, "documents"), "doc_id", **sides).groupBy("labelled", "benchmarked").agg(F.count("*").alias("n"))


def annotation_precedence(spark, d):
    """The better annotation of each document and where it is from."""
    labels = read(spark, d, "labels")
    dense = labels.filter("quality = 1").select("doc_id", F.col("toxic").alias("value"))
    found = curation.by_precedence(read(spark, d, "documents").select("doc_id"), "doc_id", dense, labels.select("doc_id", F.col("quality").alias("value")), "value")
    return found.select("doc_id", "value", "source")


def positional_zip(spark, d):
    """A user's clicks beside the user's views, by place."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    both = curation.paired(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "user_id", ["ts", "event_id"])
    return _six(both.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a.value") - F.col("b.value"))).alias("apart")), "apart")


def annotation_union(spark, d):
    """Every key of any annotation table, and in how many it is."""
    keys = read(spark, d, "labels").select(F.col("doc_id").alias("key")).unionByName(read(spark, d, "benchmark").select(F.col("item_id").alias("key"))).unionByName(read(spark, d, "conversations").select(F.col("conv_id").alias("key")).distinct())
    return keys.groupBy("key").agg(F.count("*").alias("tables"))


def caption_overall(spark, d):
    """The mean of conversations' mean word counts, and the words used at all."""
    w = read(spark, d, "conversations").select("conv_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("w"))
    per = w.groupBy("conv_id").agg(F.avg(F.size("w")).alias("mean")).agg(F.avg("mean").alias("mean_words"))
    return _six(per.crossJoin(w.select(F.explode("w").alias("x")).agg(F.countDistinct("x").alias("vocabulary"))), "mean_words")  # one row each


def temporal_statistics(spark, d):
    """Values above ten, by event type, with the upper median."""
    return _six(curation.geometry_statistics(read(spark, d, "events").filter("value > 10"), F.col("value"), "event_type"), "mean")


def category_top(spark, d):
    """The ten categories with most instances."""
    return _instances(spark, d).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)


def program_statistics(spark, d):
    """How often each event type is in a user's sequence, and in how many sequences."""
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sequences"), F.max(F.length("props")).alias("longest"))


def domain_statistics(spark, d):
    """Customers, orders and mean orders by region and nation, at every level."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    per = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))
    return _six(per.withColumn("mean_orders", F.col("orders") / F.col("customers")), "mean_orders")


def file_statistics(spark, d):
    """Pages by the ending of their url's path, with their mean size."""
    p = read(spark, d, "pages").select(F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"\.([a-z0-9]{1,5})$", 1).alias("ending"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    return _six(p.groupBy("ending").agg(F.count("*").alias("n"), F.avg("size").alias("mean_size")), "mean_size")


def class_statistics(spark, d):
    """Parts by what is before the last sign of their brand, and the most frequent size of each."""
    p = read(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("class"), "p_size")
    n = p.groupBy("class", "p_size").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    best = n.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "p_size"))).filter("at = 1").select("class", F.col("p_size").alias("mode"))
    return _six(p.groupBy("class").agg(F.count("*").alias("n"), F.stddev_pop("p_size").alias("spread")).join(best, "class"), "spread")


QUERIES = {
    f.__name__: f
    for f in (
        samples_by_category, samples_by_complexity, category_histogram, frequency_classes, rare_samples, samples_diverse, quality_samples, quality_instances, area_pruned, comparison_suitable, box_centres, size_bands, sample_quality, area_statistics, area_statistics_overall, vocabulary_coverage, track_statistics, tracking_overall, objects_between, duration_between, annotation_completeness, both_annotations, availability_flags, annotation_precedence, positional_zip, annotation_union, caption_overall, temporal_statistics, category_top, program_statistics, domain_statistics, file_statistics, class_statistics,
    )
}

_I = "i AS (SELECT l_orderkey AS image, l_linenumber AS id, 'c' || (l_partkey % 40) AS category, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y, l_quantity AS w, l_extendedprice / 1000 AS h, l_quantity * (l_extendedprice / 1000) AS area, 1 - l_discount AS iou, 1 - l_tax AS stability FROM lineitem)"
_PER = f"WITH {_I} SELECT image, count(*)::INTEGER AS n FROM i GROUP BY image HAVING"
_CLASS = f"""{_I}, k AS (SELECT category, count(DISTINCT image) AS images, count(*) AS instances FROM i GROUP BY category), q AS (SELECT quantile_cont(images, 0.33) AS a, quantile_cont(images, 0.66) AS b FROM k),
    f AS (SELECT category, images, instances, CASE WHEN images <= a THEN 'r' WHEN images <= b THEN 'c' ELSE 'f' END AS frequency FROM k, q)"""
_GEOMETRY = "count(*) AS n, round(min({0}), 6) AS smallest, round(max({0}), 6) AS largest, round(avg({0}), 6) AS mean, round(list(({0}) ORDER BY ({0}))[count(*) // 2 + 1], 6) AS upper_median"
_TRACKS = "t AS (SELECT user_id, event_type, ts::DATE AS day FROM events), per AS (SELECT user_id, event_type, count(*) AS length FROM t GROUP BY ALL), s AS (SELECT user_id, count(*) AS objects, sum(length)::BIGINT AS detections, min(length) AS shortest, avg(length) AS mean_length, max(length) AS longest FROM per GROUP BY user_id), fr AS (SELECT user_id, count(DISTINCT day) AS frames FROM t GROUP BY user_id)"

ORACLE_SQL = {
    "samples_by_category": f"{_PER} count(*) FILTER (WHERE category = 'c7') > 0",
    "samples_by_complexity": f"{_PER} count(*) BETWEEN 2 AND 5",
    "category_histogram": f"WITH {_I} SELECT image, category, count(*) AS n FROM i GROUP BY ALL HAVING count(*) > 1",
    "frequency_classes": f"WITH {_CLASS} SELECT frequency, count(*) AS categories, sum(instances)::BIGINT AS instances, min(category) AS first FROM f GROUP BY frequency",
    "rare_samples": f"WITH {_CLASS} SELECT image, count(*) AS n FROM i WHERE category IN (SELECT category FROM f WHERE frequency = 'r') GROUP BY image",
    "samples_diverse": f"{_PER} count(DISTINCT category) >= 4",
    "quality_samples": f"{_PER} count(*) FILTER (WHERE iou >= 0.98::DOUBLE AND stability >= 0.95::DOUBLE) > 0",
    "quality_instances": f"WITH {_I} SELECT image, count(*)::INTEGER AS n FROM i WHERE iou >= 0.98::DOUBLE AND stability >= 0.95::DOUBLE GROUP BY image",
    "area_pruned": f"WITH {_I} SELECT image, count(*)::INTEGER AS n FROM i WHERE area BETWEEN 500 AND 1500 GROUP BY image",
    "comparison_suitable": f"{_PER} count(*) BETWEEN 2 AND 10 AND min(area) > 0 AND max(area) / min(area) BETWEEN 1.5 AND 50",
    "box_centres": f"WITH {_I} SELECT image, round(avg(x + w / 2), 6) AS x, round(avg(y + h / 2), 6) AS y, round(avg(w / h), 6) AS aspect FROM i GROUP BY image",
    "size_bands": f"WITH {_I} SELECT image, count(*) FILTER (WHERE area < 500) AS small, count(*) FILTER (WHERE area >= 500 AND area < 1500) AS medium, count(*) FILTER (WHERE area >= 1500) AS large, round(sum(area), 6) AS total_area FROM i GROUP BY image",
    "sample_quality": f"WITH {_I} SELECT image, round_even(sum(stability) / count(*), 6) AS stability, round_even(sum(iou) / count(*), 6) AS iou, round(sum(area) / 10000, 6) AS coverage FROM i GROUP BY image",
    "area_statistics": f"WITH {_CLASS} SELECT frequency, {_GEOMETRY.format('area')} FROM i JOIN f USING (category) GROUP BY frequency",
    "area_statistics_overall": f"WITH {_I} SELECT {_GEOMETRY.format('area')} FROM i",
    "vocabulary_coverage": "SELECT p_size, count(*) AS parts, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) AS used, round(count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) / count(*), 6) AS ratio FROM part GROUP BY p_size",
    "track_statistics": f"WITH {_TRACKS} SELECT user_id, objects, detections, shortest, round(mean_length, 6) AS mean_length, longest, frames, round(detections / frames, 6) AS objects_per_frame FROM s JOIN fr USING (user_id)",
    "tracking_overall": f"WITH {_TRACKS} SELECT objects, count(*) AS sequences, sum(detections)::BIGINT AS detections, max(longest) AS longest FROM s GROUP BY objects",
    "objects_between": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) BETWEEN 3 AND 4",
    "duration_between": "SELECT o_custkey, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderdate) BETWEEN 5 AND 15",
    "annotation_completeness": "WITH c AS (SELECT round((CASE WHEN text IS NULL THEN 0 ELSE 1 END + CASE WHEN lang IS NULL THEN 0 ELSE 1 END + CASE WHEN source IS NULL THEN 0 ELSE 1 END + CASE WHEN quality IS NULL THEN 0 ELSE 1 END + CASE WHEN toxic IS NULL THEN 0 ELSE 1 END) / 5.0::DOUBLE, 6) AS complete FROM documents LEFT JOIN labels USING (doc_id)) SELECT complete, count(*) AS n FROM c WHERE complete >= 0.5 GROUP BY complete",
    "both_annotations": "SELECT doc_id FROM labels WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "availability_flags": "SELECT doc_id IN (SELECT doc_id FROM labels) AS labelled, doc_id IN (SELECT item_id FROM benchmark) AS benchmarked, count(*) AS n FROM documents GROUP BY ALL",
    "annotation_precedence": "SELECT d.doc_id, CASE WHEN quality = 1 THEN toxic ELSE quality END AS value, CASE WHEN quality = 1 THEN 'dense' WHEN l.doc_id IS NOT NULL THEN 'sparse' ELSE 'none' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)",
    "positional_zip": "WITH p AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pos FROM events WHERE event_type IN ('click', 'view')) SELECT a.user_id, count(*) AS n, round(sum(abs(a.value - b.value)), 6) AS apart FROM p a JOIN p b ON a.user_id = b.user_id AND a.pos = b.pos AND a.event_type = 'click' AND b.event_type = 'view' GROUP BY a.user_id",
    "annotation_union": "SELECT key, count(*) AS tables FROM (SELECT doc_id AS key FROM labels UNION ALL SELECT item_id FROM benchmark UNION ALL SELECT DISTINCT conv_id FROM conversations) GROUP BY key",
    "caption_overall": r"WITH w AS (SELECT conv_id, regexp_extract_all(lower(text), '[^\x09-\x0D\x20]+') AS w FROM conversations), p AS (SELECT avg(len(w)) AS m FROM w GROUP BY conv_id) SELECT (SELECT round(avg(m), 6) FROM p) AS mean_words, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM w)) AS vocabulary",
    "temporal_statistics": "SELECT event_type, count(*) AS n, min(value) AS smallest, max(value) AS largest, round(avg(value), 6) AS mean, list(value ORDER BY value)[count(*) // 2 + 1] AS upper_median FROM events WHERE value > 10 GROUP BY event_type",
    "category_top": f"WITH {_I} SELECT category, count(*) AS n FROM i GROUP BY category ORDER BY n DESC, category LIMIT 10",
    "program_statistics": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sequences, max(length(props))::INTEGER AS longest FROM events GROUP BY event_type",
    "domain_statistics": "WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) SELECT r_name, n_name, count(*) AS customers, coalesce(sum(orders), 0)::BIGINT AS orders, round(coalesce(sum(orders), 0) / count(*), 6) AS mean_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON c_custkey = o_custkey GROUP BY ROLLUP (r_name, n_name)",
    "file_statistics": r"SELECT regexp_extract(lower(coalesce(url, '')), '\.([a-z0-9]{1,5})$', 1) AS ending, count(*) AS n, round(avg(length(coalesce(html, ''))), 6) AS mean_size FROM pages GROUP BY ending",
    "class_statistics": "WITH p AS (SELECT substr(p_brand, 1, 7) AS class, p_size FROM part), m AS (SELECT class, p_size, row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, p_size) AS pos FROM p GROUP BY class, p_size) SELECT p.class, count(*) AS n, round(stddev_pop(p.p_size), 6) AS spread, any_value(m.p_size) AS mode FROM p JOIN m ON p.class = m.class AND m.pos = 1 GROUP BY p.class",
}
