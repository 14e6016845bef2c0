"""Statistics, governance, lineage, sampling and text analysis on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import privacy, scalar
from ..operators import governance, lineage, sampling, statistics
from .tables import ORDER, read

AS_OF = "2024-01-31"


def _six(df, *names):
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def latency_profile_percentiles(spark, d):
    """Percentiles of values by event type."""
    return _six(statistics.profile(read(spark, d, "events"), "value", ["event_type"]), "mean", "std", "p50", "p90", "p95", "p99")


def quality_distribution(spark, d):
    """Shares of documents by language and source, and of labels."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return _six(statistics.shares(docs, ["lang", "source", "quality", "toxic"]), "share")


def quality_cube(spark, d):
    """Counts and lengths by language and quality at every level."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    c = docs.cube("lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.percentile("n_chars", 0.5).alias("median_chars"))
    return c


def min_sample_warnings(spark, d):
    """Sources with fewer documents of a language than ten."""
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).filter("n < 10")


def coverage_full_outer(spark, d):
    """Documents with text only, label only, or both."""
    a, b = read(spark, d, "documents").select("doc_id", F.lit(True).alias("a")), read(spark, d, "labels").select("doc_id", F.lit(True).alias("b"))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "text").otherwise("label")
    return a.join(b, "doc_id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def caption_stats(spark, d):
    """Words, distinct words and their ratio per conversation."""
    w = scalar.words(F.lower("text"))
    t = read(spark, d, "conversations").withColumn("w", w)
    return _six(t.groupBy("conv_id").agg(F.sum(F.size("w")).alias("words"), F.size(F.array_distinct(F.flatten(F.collect_list("w")))).alias("distinct_words"), F.avg(F.length("text")).alias("mean_chars")).withColumn("diversity", F.col("distinct_words") / F.col("words")), "mean_chars", "diversity")


def keyword_topk(spark, d):
    """The ten most frequent words of each language, longer than two letters."""
    w = read(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    n = w.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return n.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter("at <= 10")


def pii_detect_counts(spark, d):
    """Matches of each category over all documents."""
    docs = read(spark, d, "documents")
    sums = docs.agg(*[F.sum(privacy.count(F.col("text"), n)).alias(n) for n, *_ in privacy.CATALOG])
    return sums.unpivot([], [n for n, *_ in privacy.CATALOG], "category", "n").select("category", F.col("n").cast("long").alias("n"))


def pii_risk(spark, d):
    """Risk points and levels of documents, over every category of the catalog."""
    counts = {n: privacy.count(F.col("text"), n) for n, *_ in privacy.CATALOG}
    points, level = privacy.risk(counts)
    return read(spark, d, "documents").select("doc_id", points.cast("long").alias("points"), level.alias("level"))


def pii_redact_plain(spark, d):
    """The lengths and digests of redacted documents."""
    return read(spark, d, "documents").select("doc_id", privacy.redact(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


def anonymise(spark, d):
    """Events with hashed users and without properties."""
    return read(spark, d, "events").select("event_id", privacy.user_hash(F.col("user_id")).alias("user_hash"), "event_type", F.lit(True).alias("anonymised"))


def question_type(spark, d):
    """Kinds of turns by their first word; a question word is put before most of them, by the turn's number."""
    at = F.col("turn") % 8
    words = F.array(*map(F.lit, ("what", "who", "where", "when", "why", "how")))
    asked = F.when(at < 6, F.concat_ws(" ", F.get(words, at.cast("int")), "text")).when(at == 6, F.concat(F.lit("Tell what happens: "), "text")).otherwise(F.col("text"))
    return read(spark, d, "conversations").withColumn("text", asked).groupBy(scalar.question_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def cer_normalised_edit(spark, d):
    """Edit distances between the whole texts of a turn in neighbouring conversations, by code points."""
    t = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    o = t.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("t").alias("o"))
    return _six(t.join(o, ["conv_id", "turn"]).select("conv_id", "turn", scalar.character_error(F.col("t"), F.col("o")).alias("cer"), scalar.edit_similarity(F.col("t"), F.col("o")).alias("distance")), "cer", "distance")


def timecode_suite(spark, d):
    """Frames and times of events at NTSC rate."""
    s = (F.unix_micros(F.col("ts").cast("timestamp")) % 3600000000) / 1e6
    fps = F.lit(29.97)
    e = read(spark, d, "events").select("event_id", s.alias("s"))
    return e.select("event_id", scalar.frame_at(F.col("s"), fps, "floor").alias("floor"), scalar.frame_at(F.col("s"), fps, "ceil").alias("ceil"), F.round(scalar.time_at(F.floor(F.col("s")).cast("long"), fps), 6).alias("time"), scalar.standard_fps(F.col("s") % 61).alias("standard"))


def geometry_suite(spark, d):
    """Boxes made of parts: overlap with a fixed one, aspect, size band and quarter."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") % 100 / 100.0).alias("y"))
    box = [F.col("x"), F.col("y"), F.col("x") + 0.2, F.col("y") + 0.3]
    fixed = [F.lit(0.4), F.lit(0.4), F.lit(0.9), F.lit(0.9)]
    return p.select("p_partkey", F.round(scalar.iou(box, fixed), 6).alias("iou"), F.round(scalar.aspect_ratio(F.col("x"), F.col("y")), 6).alias("aspect"), scalar.size_band(F.col("x") * F.col("y")).alias("band"), scalar.quadrant(F.col("x"), F.col("y")).alias("quadrant"))


def priority_decay(spark, d):
    """Priorities of events by value and age, initial ones, and vote weights."""
    age = F.timestamp_diff("SECOND", F.col("ts"), F.lit(f"{AS_OF} 00:00:00").cast("timestamp_ntz")) / 3600
    e = read(spark, d, "events")
    u = F.col("value") / 500
    return _six(e.select("event_id", scalar.priority(u, F.lit(-0.5), age).alias("priority"), scalar.initial_priority(u, F.lit(0.0)).alias("initial"), scalar.vote_weight(u, F.lit(0.25), age, F.lit(1.5)).alias("weight")), "priority", "initial", "weight")


def fleiss_kappa(spark, d):
    """Agreement of the flags of all lines per order."""
    return _six(statistics.fleiss_kappa(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag"), "observed", "chance", "kappa")


def icc(spark, d):
    """Intraclass correlation of the quantities of all lines within orders."""
    return _six(statistics.icc(read(spark, d, "lineitem"), "l_orderkey", "l_quantity"), "msb", "msw", "icc")


def cohen_weighted(spark, d):
    """Weighted kappa of two ratings made of quantity and discount."""
    li = read(spark, d, "lineitem").select((F.floor(F.col("l_quantity") / 10.001)).cast("int").alias("a"), (F.floor(F.col("l_discount") * 49)).cast("int").alias("b"))
    return _six(statistics.weighted_kappa(li, "a", "b", 5), "kappa")


def ttest_and_wilcoxon(spark, d):
    """Paired statistics of quantity against a tenth of the price, by flag."""
    li = read(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.round(F.col("l_extendedprice") / 2000, 1)).alias("p"))
    t = statistics.paired_t(li, "l_quantity", "p", ["l_returnflag"])
    w = statistics.signed_rank(li, "l_quantity", "p", ["l_returnflag"]).select("l_returnflag", F.col("n").alias("nonzero"), "w", "effect")
    return _six(t.join(w, "l_returnflag"), "t", "d", "effect")


def seed_aggregate(spark, d):
    """Mean and deviation of quantity by flag and status."""
    return _six(statistics.seed_summary(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), "mean", "std")


def ablation_pivot(spark, d):
    """Mean price by flag, a column per status."""
    li = read(spark, d, "lineitem")
    return _six(li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_extendedprice")), "F", "O")


def interaction_effect(spark, d):
    """Interaction of brand and type in prices."""
    return _six(statistics.interaction(read(spark, d, "part"), "p_brand", "p_type", "p_retailprice"), "total", "rows", "columns", "interaction")


def pareto(spark, d):
    """Parts that no other beats in size, price and key order."""
    p = read(spark, d, "part").select("p_partkey", "p_size", F.floor(F.col("p_retailprice") / 10).alias("price"), (F.col("p_partkey") % 7).alias("rank"))
    return statistics.frontier(p, ["p_size", "price", "rank"])


def forgetting(spark, d):
    """Loss and retention of each user's values."""
    return _six(statistics.forgetting(read(spark, d, "events"), "user_id", ORDER, "value"), "forgetting", "retention")


def retention_bands(spark, d):
    """Events by age."""
    return governance.age_bands(read(spark, d, "events"), "ts", F.lit(AS_OF).cast("date"))


def retention_prune(spark, d):
    """Events of the last ten days, counted by type."""
    return governance.retained(read(spark, d, "events"), "ts", F.lit(AS_OF).cast("date"), 10).groupBy("event_type").agg(F.count("*").alias("n"))


def ring_buffer_eviction(spark, d):
    """The last five events of each user."""
    return governance.ring(read(spark, d, "events"), "user_id", ORDER, 5).select("user_id", "event_id")


def health_rates(spark, d):
    """Events per minute over each type's last sixty."""
    return _six(governance.health_rates(read(spark, d, "events"), "event_type", "ts", ORDER), "per_minute")


def alert_thresholds(spark, d):
    """Values beyond the thresholds of their type."""
    limits = spark.createDataFrame([("error", 300.0, "gt"), ("view", 1.0, "lt"), ("click", 50.0, "none")], "metric string, threshold double, comparison string")
    return governance.breaches(read(spark, d, "events").withColumnRenamed("event_type", "metric"), limits).groupBy("metric").agg(F.count("*").alias("n"))


def alert_cooldown(spark, d):
    """Errors above 50 that alert, six hours apart at least for each user."""
    hot = read(spark, d, "events").filter("event_type = 'error' AND value > 50")
    return governance.cooled(hot, ["user_id"], "ts", ["event_id"], 6 * 3600).select("user_id", "event_id")


def audit_hash_chain(spark, d):
    """Each user's event chain: its length and last hash."""
    e = read(spark, d, "events")
    c = governance.chain(e, "user_id", ORDER, governance.record("event_id", "event_type", "props"))
    return c.select("user_id", F.size("entries").alias("n"), F.element_at("entries", -1).hash.alias("last"))


def audit_verify(spark, d):
    """Broken links of chains in which every tenth entry was changed after the fact."""
    e = read(spark, d, "events")
    c = governance.chain(e, "user_id", ORDER, governance.record("event_id", "event_type", "props")).select("user_id", F.posexplode("entries").alias("at", "e"))
    links = c.select("user_id", "at", F.when(F.col("at") % 10 == 9, F.concat(F.col("e.body"), F.lit("!"))).otherwise(F.col("e.body")).alias("body"), F.col("e.hash").alias("hash"))
    return governance.broken(links, "user_id", ["at"], "body", "hash").select("user_id", "at")


def recover_snapshot_plus_wal(spark, d):
    """Orders of a snapshot up to 1996 and a log from 1995, by status."""
    o = read(spark, d, "orders")
    both = governance.recover(o.filter("o_orderdate < '1997-01-01'"), o.filter("o_orderdate >= '1995-01-01'"), "o_orderkey")
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def dedup_content_hash(spark, d):
    """Documents by the digest of their text."""
    return governance.distinct_content(read(spark, d, "documents"), "doc_id", "text")


def artifact_versions(spark, d):
    """The newest version number of each customer's orders."""
    return governance.versions(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).groupBy("o_custkey").agg(F.max("version").alias("version"))


def _tree(spark, d):
    v = read(spark, d, "embeddings").select("vec_id")
    return v.filter("vec_id > 0").select(F.expr("vec_id div 2").alias("parent"), F.col("vec_id").alias("child"))


def lineage_descendants(spark, d):
    """Everything below the nodes that divide by 20."""
    starts = read(spark, d, "embeddings").filter("vec_id % 20 = 0").select("vec_id")
    return lineage.closure(_tree(spark, d).filter("parent != child"), starts)


def lineage_ancestors(spark, d):
    """Everything above the nodes that divide by 20."""
    starts = read(spark, d, "embeddings").filter("vec_id % 20 = 0").select("vec_id")
    return lineage.closure(_tree(spark, d).filter("parent != child"), starts, down=False)


def lineage_depth(spark, d):
    """The longest path to each node."""
    return lineage.longest_paths(_tree(spark, d).filter("parent != child"))


def _looped(spark, d):
    back = read(spark, d, "embeddings").filter("vec_id % 50 = 0 AND vec_id > 0").select(F.col("vec_id").alias("parent"), F.expr("vec_id div 4").alias("child"))
    return _tree(spark, d).filter("parent != child").union(back)


def lineage_cycles(spark, d):
    """Edges on cycles: the tree with one edge back from every node that divides by 50."""
    return lineage.cyclic(_looped(spark, d))


def lineage_path(spark, d):
    """The way between two nodes of the tree."""
    found = lineage.path(_tree(spark, d).filter("parent != child"), 37, 401)
    return spark.createDataFrame(list(enumerate(found)), "at int, node long")


def lineage_run_subgraph(spark, d):
    """The edges around the nodes of one label."""
    nodes = read(spark, d, "embeddings").filter("vec_id % 7 = 0")
    return lineage.subgraph(nodes, _tree(spark, d).filter("parent != child"), "vec_id", "label", 3)[1]


def lineage_components(spark, d):
    """Components of the tree without the edges into nodes that divide by ten."""
    cut = _tree(spark, d).filter("parent != child AND child % 10 != 0")
    return lineage.components(cut)


def lineage_insertable(spark, d):
    """Edges whose parent has the smaller number, of the tree with edges back."""
    nodes = read(spark, d, "embeddings").withColumn("at", F.col("vec_id"))
    return lineage.insertable(nodes, _looped(spark, d), "vec_id", "at")


def lineage_validate(spark, d):
    """What is wrong with a tree some of whose nodes are gone."""
    nodes = read(spark, d, "embeddings").filter("vec_id % 11 != 3").select("vec_id")
    return lineage.problems(nodes, _looped(spark, d).filter("parent % 3 != 0 OR child % 50 = 0"), "vec_id")


def lineage_export(spark, d):
    """The tree's edges in two graph languages."""
    e = _tree(spark, d).filter("parent != child")
    return lineage.exported(e, "dot").union(lineage.exported(e, "mermaid"))


def lineage_tree(spark, d):
    """All ways up from one node, with cycles marked."""
    t = lineage.tree(_looped(spark, d), 400)
    return t.select("node", "depth", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "circular")


def stratified_balance(spark, d):
    """Forty documents balanced over languages."""
    return sampling.stratified(read(spark, d, "documents"), ["lang"], "doc_id", 40).select("doc_id", "lang")


def proportional_subset(spark, d):
    """A tenth of each source's documents."""
    return sampling.proportional(read(spark, d, "documents"), ["source"], "doc_id", 0.1).select("doc_id", "source")


def exact_splits(spark, d):
    """Train, val and test within languages."""
    return sampling.split(read(spark, d, "documents"), ["lang"], "doc_id").select("doc_id", "split")


def priority_sample(spark, d):
    """Fifty orders, likelier by price."""
    return sampling.weighted(read(spark, d, "orders"), "o_orderkey", F.col("o_totalprice"), 50).select("o_orderkey")


def strided_sampling(spark, d):
    """About a hundred documents at equal steps."""
    return sampling.strided(read(spark, d, "documents"), "doc_id", 100).select("doc_id")


def category_rollup(spark, d):
    """Lines and revenue by region and nation, with totals."""
    li, s = read(spark, d, "lineitem"), read(spark, d, "supplier")
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def variable_fps_range_join(spark, d):
    """Events by the rate segment that holds their hour of the month."""
    segments = spark.createDataFrame([(0.0, 100.0, 24.0), (100.0, 400.0, 29.97), (400.0, 800.0, 60.0)], "lo double, hi double, fps double")
    h = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 3600
    e = read(spark, d, "events").withColumn("h", h)
    return e.join(F.broadcast(segments), (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi"))).groupBy("fps").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("h") * F.col("fps"))).cast("long").alias("frames"))  # segments are configuration


def curriculum_asof_weights(spark, d):
    """Orders by the last stage that starts at or before their rank by date."""
    stages = spark.createDataFrame([(0, 1.0), (1000, 0.5), (5000, 0.1)], "step int, weight double")
    o = read(spark, d, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 3)
    j = o.join(F.broadcast(stages), F.col("step") <= F.col("day"))  # stages are configuration
    last = j.groupBy("o_orderkey").agg(F.max(F.struct("step", "weight")).weight.alias("weight"))
    return last.groupBy("weight").agg(F.count("*").alias("n"))


def common_customers_intersect(spark, d):
    """Customers that have orders of every status."""
    o = read(spark, d, "orders")
    parts = [o.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in ("O", "F", "P")]
    return parts[0].intersect(parts[1]).intersect(parts[2])


QUERIES = {n: f for n, f in list(globals().items()) if getattr(f, "__module__", None) == __name__ and not n.startswith("_")}
