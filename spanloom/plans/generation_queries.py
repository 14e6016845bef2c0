"""Generation, validation, curricula and tracking on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import generation, retrieval, tracking
from .retrieval_queries import _NEAR, _vote, _votes
from .tables import ORDER, read, steps


def heuristic_validator(spark, d):
    """The rules that conversations break, by rule."""
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("a"), F.min(F.when(F.col("role").isin("user", "assistant"), 1).otherwise(0)).alias("known"))
    broken = t.select("conv_id", generation.problems(F.col("q"), F.col("a"), F.col("steps"), F.col("known") == 1).alias("p"))
    return broken.select(F.explode_outer("p").alias("rule")).groupBy(F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


def experiment_grid(spark, d):
    """Every combination of three settings."""
    return generation.grid(spark, rate=[0.1, 0.01], size=[16, 32, 64], seed=[1, 2])


def blinded_pairs(spark, d):
    """Neighbouring parts with sides swapped for half of them."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("left"), (F.col("p_partkey") + 1).alias("right"))
    return generation.blinded(p, "key", "left", "right")


def comparison_tasks(spark, d):
    """For each order one pair of its lines and which costs more."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    return generation.pairs_of(li, "l_orderkey", "l_linenumber", "price")


def self_correction(spark, d):
    """Sequences with one wrong step put in: their lengths and where it is."""
    p = generation.perturbed(steps(spark, d), "user_id", ORDER, "op", "WRONG")
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("injected"), F.col("step"))).alias("at_step"))


def svd_rank_select(spark, d):
    """The number of embedding columns that hold nine tenths of the energy, by label."""
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    energy = e.groupBy("label", "dim").agg(F.round(F.sum(F.col("x").cast("double") * F.col("x").cast("double")), 9).alias("energy"))
    return generation.energy_rank(energy, ["label"], "dim", "energy", 0.9)


def curriculum_stages(spark, d):
    """How far a stage machine comes on each user's values."""
    return generation.curriculum(read(spark, d, "events"), "user_id", ORDER, "value", [5.0, 10.0, 20.0, 40.0], 2)


def knn_fallback_min_votes(spark, d):
    """Majority labels where three neighbours agree on likeness above 0.2, else the query's own at half confidence."""
    v = _votes(spark, d).filter("score > 0.2")
    n = v.groupBy("query_id").count()
    few = read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(n, "query_id", "left").filter(F.coalesce("count", F.lit(0)) < 3)
    voted = retrieval.vote(v.join(n.filter("count >= 3").select("query_id"), "query_id", "left_semi"), "query_id", "label").select("query_id", "label", F.round("confidence", 6).alias("confidence"))
    return voted.unionByName(few.select("query_id", "label", F.lit(0.5).alias("confidence")))


def adaptation_speed(spark, d):
    """The first step at which a user's running mean comes within a tenth of its peak's gain."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = read(spark, d, "events").withColumn("at_step", F.row_number().over(w)).withColumn("mean", F.round(F.avg("value").over(w.rowsBetween(-9, 0)), 9))
    s = e.groupBy("user_id").agg(F.max(F.when(F.col("at_step") == 1, F.col("mean"))).alias("first"), F.max("mean").alias("peak"))
    hit = e.join(s, "user_id").filter(F.col("mean") >= F.col("first") + 0.9 * (F.col("peak") - F.col("first")) - 1e-9)
    return hit.groupBy("user_id").agg(F.min("at_step").alias("at_step"))


def sensitivity_impact(spark, d):
    """Variance of mean price over part sizes, and the range of sizes within nine tenths of the peak."""
    m = read(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m"))
    return m.agg(F.max("m").alias("peak"), F.var_pop("m").alias("v")).crossJoin(m).groupBy(F.round("v", 4).alias("variance"), F.round("peak", 4).alias("peak")).agg(F.min(F.when(F.col("m") >= 0.9 * F.col("peak"), F.col("p_size"))).alias("lo"), F.max(F.when(F.col("m") >= 0.9 * F.col("peak"), F.col("p_size"))).alias("hi"))


def disagreement_cases(spark, d):
    """Orders whose quantities differ by more than fifteen in deviation."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("spread")).filter("spread > 15")


def mota_motp(spark, d):
    """Tracking scores of the boxes of all events, a sequence per user and a frame per day, against the same boxes moved a little."""
    e = read(spark, d, "events")
    b = e.select(F.col("user_id").alias("sequence"), F.unix_date(F.to_date("ts")).cast("long").alias("frame"), F.col("event_id").alias("id"), (F.col("value") % 50).alias("x1"), (F.col("event_id") % 40).cast("double").alias("y1"))
    box = lambda side, dx: b.select("sequence", "frame", F.lit(side).alias("side"), "id", (F.col("x1") + dx).alias("x1"), "y1", (F.col("x1") + dx + 10).alias("x2"), (F.col("y1") + 10).alias("y2"))
    return tracking.scores(box("gt", 0.0).unionByName(box("pred", 1.0)))


QUERIES = {f.__name__: f for f in (heuristic_validator, experiment_grid, blinded_pairs, comparison_tasks, self_correction, svd_rank_select, curriculum_stages, knn_fallback_min_votes, adaptation_speed, sensitivity_impact, disagreement_cases, mota_motp)}

_u = lambda seed, key: f"(('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_VOTES3 = _NEAR + ", votes AS (SELECT *, 1 AS weight FROM near WHERE score > 0.2), n AS (SELECT query_id, count(*) AS c FROM votes GROUP BY query_id), enough AS (SELECT votes.* FROM votes JOIN n USING (query_id) WHERE c >= 3)"

ORACLE_SQL = {
    "heuristic_validator": """WITH t AS (SELECT conv_id, count(*) AS steps, max(text) FILTER (WHERE turn = 0) AS q, max(text) FILTER (WHERE turn = 1) AS a, min(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) AS known FROM conversations GROUP BY conv_id),
      r AS (SELECT 'question_length' AS rule, conv_id FROM t WHERE length(q) NOT BETWEEN 10 AND 500 UNION ALL SELECT 'empty_answer', conv_id FROM t WHERE trim(a) = '' UNION ALL SELECT 'trajectory_length', conv_id FROM t WHERE steps NOT BETWEEN 2 AND 20 UNION ALL SELECT 'unknown_action', conv_id FROM t WHERE known = 0 UNION ALL SELECT 'missing_field', conv_id FROM t WHERE q IS NULL OR a IS NULL)
      SELECT coalesce(rule, 'none') AS rule, count(*) AS n FROM t LEFT JOIN r USING (conv_id) GROUP BY ALL""",
    "experiment_grid": "SELECT rate, size, seed FROM (VALUES (0.1::DOUBLE), (0.01::DOUBLE)) a(rate), (VALUES (16::BIGINT), (32), (64)) b(size), (VALUES (1::BIGINT), (2)) c(seed)",
    "blinded_pairs": f"""SELECT p_partkey AS key, {_u(3, 'p_partkey')} < 0.5 AS swapped, CASE WHEN {_u(3, 'p_partkey')} < 0.5 THEN p_partkey + 1 ELSE p_partkey END AS "left", CASE WHEN {_u(3, 'p_partkey')} < 0.5 THEN p_partkey ELSE p_partkey + 1 END AS "right" FROM part""",
    "comparison_tasks": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_linenumber::VARCHAR), l_linenumber) AS pos FROM l)
      SELECT a.l_orderkey, a.l_linenumber AS "first", b.l_linenumber AS "second", CASE WHEN a.price > b.price THEN a.l_linenumber ELSE b.l_linenumber END AS answer FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.pos = 1 AND b.pos = 2""",
    "self_correction": f"SELECT user_id, count(*) + 1 AS n, floor({_u(5, 'user_id')} * count(*)) + 1 - 0.5::DOUBLE AS at_step FROM events GROUP BY user_id",
    "svd_rank_select": """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings), s AS (SELECT label, dim, round(sum(x * x), 9) AS energy FROM e GROUP BY ALL),
      c AS (SELECT label, row_number() OVER w AS rank, sum(energy) OVER w / sum(energy) OVER (PARTITION BY label) AS share FROM s WINDOW w AS (PARTITION BY label ORDER BY energy DESC, dim ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT label, min(rank)::INT AS rank FROM c WHERE share >= 0.9 GROUP BY label""",
    "curriculum_stages": """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
      s(user_id, pos, stage, streak) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0 FROM e UNION ALL
        SELECT s.user_id, e.pos, CASE WHEN value >= goal AND streak + 1 >= 2 THEN stage + 1 ELSE stage END, CASE WHEN value >= goal AND streak + 1 < 2 THEN streak + 1 ELSE 0 END
        FROM (SELECT *, CASE stage WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 WHEN 3 THEN 40.0 ELSE 'inf'::DOUBLE END AS goal FROM s) s JOIN e ON e.user_id = s.user_id AND e.pos = s.pos + 1)
      SELECT user_id, max(stage) AS stage FROM s GROUP BY user_id""",
    "knn_fallback_min_votes": f"""WITH {_VOTES3}, {_vote('v', 'enough', '1.0')} SELECT query_id, label, round(confidence, 6) AS confidence FROM v
      UNION ALL SELECT vec_id, label, 0.5::DOUBLE FROM embeddings LEFT JOIN n ON query_id = vec_id WHERE vec_id % 20 = 0 AND coalesce(c, 0) < 3""",
    "adaptation_speed": """WITH e AS (SELECT user_id, row_number() OVER w AS s, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      p AS (SELECT user_id, max(m) FILTER (WHERE s = 1) AS f, max(m) AS k FROM e GROUP BY user_id) SELECT user_id, min(s)::INT AS at_step FROM e JOIN p USING (user_id) WHERE m >= f + 0.9::DOUBLE * (k - f) - 1e-9 GROUP BY user_id""",
    "sensitivity_impact": "WITH m AS (SELECT p_size, avg(p_retailprice) AS m FROM part GROUP BY p_size), s AS (SELECT max(m) AS k, var_pop(m) AS v FROM m) SELECT round(v, 4) AS variance, round(k, 4) AS peak, min(p_size) FILTER (WHERE m >= 0.9::DOUBLE * k) AS lo, max(p_size) FILTER (WHERE m >= 0.9::DOUBLE * k) AS hi FROM m, s GROUP BY v, k",
    "disagreement_cases": "SELECT l_orderkey, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem GROUP BY l_orderkey HAVING round(stddev_pop(l_quantity), 6) > 15",
}
