"""Rewards, running statistics, curricula and simulations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rewards, sequence
from .sequence_queries import KEY, _rounded
from .tables import KIND_SQL, OP_SQL, ORDER, read, steps

STAGES = ((0, {"task": 1.0, "curiosity": 0.0}), (300, {"task": 0.8, "curiosity": 0.2}), (600, {"task": 0.6, "curiosity": 0.4}))


def _xy(spark, d):
    return steps(spark, d).withColumn("x", F.floor(F.col("value") / 20).cast("long")).withColumn("y", F.get_json_object("props", "$.k").cast("long") % 5)


def tool_usage_histogram(spark, d):
    """How often each sequence uses each visual operation."""
    return steps(spark, d).filter("kind = 'visual_operation'").groupBy(KEY, "op").agg(F.count("*").alias("n"))


def operation_frequency(spark, d):
    """How often each operation is used, and by how many sequences."""
    return steps(spark, d).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct(KEY).alias("sequences"))


def semantic_coherence(spark, d):
    """The likeness of neighbouring vectors of a label."""
    return _rounded(rewards.semantic_coherence(read(spark, d, "embeddings"), "label", ["vec_id"], "embedding"), "similarity", "coherence")


def contradictions(spark, d):
    """Steps that contradict earlier ones."""
    return rewards.contradictions(_xy(spark, d), KEY, ORDER, "x", "y")


def tool_penalty(spark, d):
    """Penalties for too many, repeated and needless steps."""
    return _rounded(rewards.tool_penalty(steps(spark, d), KEY, ORDER, 40), "penalty")


def coordinate_bounds(spark, d):
    """Parameters outside their bounds."""
    e = _xy(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rewards.out_of_bounds(e, KEY, 0, 80, "value", "k")


def step_coherence(spark, d):
    """Equal neighbours and good pairs, over the number of pairs."""
    return _rounded(rewards.step_coherence(_xy(spark, d), KEY, ORDER, "y", sequence.GOOD_PAIRS), "coherence")


def total_reward(spark, d):
    """Weighted and plain sums of a sequence's rewards."""
    s = steps(spark, d)
    flow, pattern = _rounded(sequence.logical_flow(s, KEY, ORDER), "flow"), _rounded(sequence.tool_pattern(s, KEY, ORDER), "pattern")
    both = rewards.tool_penalty(s, KEY, ORDER, 40).join(flow, KEY).join(pattern, KEY)
    weighted, plain = rewards.total({"flow": 0.7, "pattern": 0.3}, F.col("penalty"))
    return _rounded(both.select(KEY, weighted.alias("weighted"), plain.alias("plain")), "weighted", "plain")


def running_zscore(spark, d):
    """Values against mean and deviation of all so far, clipped at 3."""
    r = rewards.running(read(spark, d, "events"), KEY, ORDER, "value", 10, 3.0)
    return _rounded(r.select("event_id", "mean", "std", "z"), "mean", "std", "z")


def moving_avg_slope(spark, d):
    """Moving means of 100 values and slopes of five, by user."""
    return _rounded(rewards.moving(read(spark, d, "events"), KEY, ORDER, "value", 100, 5).select("event_id", "moving_mean", "slope"), "moving_mean", "slope")


def latest_metric(spark, d):
    """Each user's last value, moving mean and slope."""
    m = rewards.moving(read(spark, d, "events"), KEY, ORDER, "value", 100, 5)
    return _rounded(rewards.latest(m, KEY, ORDER, "value", "moving_mean", "slope"), "moving_mean", "slope")


def smoothed_metric(spark, d):
    """Means of full windows of five, and how many of them would advance a stage."""
    e = read(spark, d, "events").withColumn("accuracy", rewards.smoothed("value", KEY, ORDER, 5)).withColumn("loss", F.get_json_object("props", "$.k").cast("double"))
    return e.groupBy(KEY).agg(F.count("accuracy").alias("full"), F.count_if(rewards.meets({"accuracy": 50.0, "loss": 40.0})).alias("advance"))


def grpo_replay_select(spark, d):
    """How many of a supplier's lines are above the 0.7 quantile of all quantities."""
    return rewards.replayed(read(spark, d, "lineitem").select("l_suppkey", "l_quantity"), "l_quantity").groupBy("l_suppkey").agg(F.count("*").alias("n"))


def curriculum_step_weights(spark, d):
    """Reward weights by how far a sequence is."""
    e = read(spark, d, "events").withColumn("step", F.col("event_id") % 1000)
    return _rounded(rewards.step_weights(e, "step", STAGES).groupBy("task", "curiosity").agg(F.count("*").alias("n"), F.sum(F.col("task") * F.col("value")).alias("weighted")), "weighted")


def beta_controller(spark, d):
    """A controller's last factor over each user's values."""
    return _rounded(rewards.adjust_beta(read(spark, d, "events"), KEY, ORDER, "value", 50.0, 0.1), "beta")


def kl_window(spark, d):
    """The mean of the last twenty values and whether an update would be blocked."""
    w = Window.partitionBy(KEY).orderBy(*ORDER).rowsBetween(-19, 0)
    e = read(spark, d, "events").withColumn("mean", F.avg("value").over(w))
    blocked = F.col("value") > 2 * F.col("mean")
    return _rounded(e.groupBy(KEY).agg(F.count_if(blocked).alias("blocked"), F.count_if(~blocked).alias("applied"), F.avg(F.when(~blocked, F.col("value"))).alias("mean_applied")), "mean_applied")


def failure_rate(spark, d):
    """The share of errors so far, at every tenth event of a user."""
    w = Window.partitionBy(KEY).orderBy(*ORDER)
    e = read(spark, d, "events").select(KEY, F.row_number().over(w).alias("at"), F.avg((F.col("event_type") == "error").cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rate"))
    return _rounded(e.filter("at % 10 = 0"), "rate")


def latest_health(spark, d):
    """The newest value of each metric of a user, and whether all are healthy."""
    last = rewards.latest(read(spark, d, "events").withColumn("metric", F.concat_ws(":", F.col(KEY).cast("string"), "event_type")), "metric", ORDER, KEY, "event_type", "value")
    return last.groupBy(KEY).agg(F.count("*").alias("metrics"), F.max("value").alias("worst"), F.bool_and(F.col("value") < 150).alias("healthy"))


def critical_conditions(spark, d):
    """Events that a monitor would report, by condition."""
    e = read(spark, d, "events").withColumn("fill", F.get_json_object("props", "$.k").cast("double") / 100)
    found = F.filter(F.array(F.when(F.col("event_type") == "error", "worker"), F.when(F.col("fill") > 0.95, "queue"), F.when(F.col("value") > 180, "memory")), lambda x: x.isNotNull())
    return e.select(F.explode(found).alias("condition")).groupBy("condition").agg(F.count("*").alias("n"))


def review_counters(spark, d):
    """Decisions of reviewers and the running mean of confidence at the end."""
    e = read(spark, d, "events")
    return _rounded(e.groupBy(KEY).agg(F.count_if(F.col("event_type") == "purchase").alias("approved"), F.count_if(F.col("event_type") == "error").alias("rejected"), F.avg("value").alias("confidence")), "confidence")


def experience_rate(spark, d):
    """Experiences per hour between a user's first and last."""
    hours = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9
    return _rounded(read(spark, d, "events").groupBy(KEY).agg((F.count("*") / hours).alias("per_hour")), "per_hour")


def adaptive_rate(spark, d):
    """Learning rates by confidence, and which updates pass the gate."""
    c = F.get_json_object("props", "$.k").cast("double") / 100
    e = read(spark, d, "events").select("event_type", c.alias("c"), rewards.clip(0.001 * (1 - c), 0.0001, 0.001).alias("rate"))
    return _rounded(e.groupBy("event_type").agg(F.count_if(F.col("c") >= 0.7).alias("updates"), F.avg("rate").alias("rate")).withColumn("rate", F.col("rate") * 1000), "rate")


def review_routing(spark, d):
    """Events that are routed to a reviewer: one in fifty, by a digest of the id."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit("review:"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long") % 10000
    return read(spark, d, "events").filter(at < 200).select("event_id", KEY)


def simulation_metrics(spark, d):
    """Success, rate and latency of a run, and whether all checks hold."""
    m = read(spark, d, "events").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("success"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.99).alias("p99"), F.stddev_pop("value").alias("spread"))
    return _rounded(m.withColumn("passed", (F.col("success") > 0.5) & (F.col("p99") < 1000)), "success", "p50", "p99", "spread")


def configuration_metrics(spark, d):
    """A user's mean over the last twenty values, the first near the peak, and stability."""
    w = Window.partitionBy(KEY)
    e = read(spark, d, "events").select(KEY, "value", F.row_number().over(w.orderBy(*ORDER)).alias("at"), F.count("*").over(w).alias("n"), F.max("value").over(w).alias("peak"))
    tail = F.when(F.col("at") > F.col("n") - 20, F.col("value"))
    return _rounded(e.groupBy(KEY).agg(F.avg(tail).alias("final"), F.min(F.when(F.col("value") >= 0.9 * F.col("peak"), F.col("at"))).alias("converged"), (1 / (F.var_pop(tail) + 1e-6)).alias("stability")), "final", "stability")


def robustness_score(spark, d):
    """What is left of an event type's mean under three kinds of stress."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("base"), *[F.avg(F.when(k % 3 == i, F.col("value"))).alias(f"s{i}") for i in range(3)])
    left = {f"s{i}": F.col(f"s{i}") / F.col("base") for i in range(3)}
    return _rounded(e.select("event_type", rewards.robustness(left, {"s0": 0.2, "s1": 0.3, "s2": 0.5}).alias("score")), "score")


def first_n_accuracy(spark, d):
    """The share of right answers among each user's first ten."""
    w = Window.partitionBy(KEY).orderBy(*ORDER)
    e = read(spark, d, "events").withColumn("at", F.row_number().over(w)).filter("at <= 10")
    return _rounded(e.groupBy(KEY).agg(F.avg((F.col("event_type") == "click").cast("double")).alias("accuracy")), "accuracy")


def clip_regroup(spark, d):
    """Clips of seven days, every five: what of each event type is in them, from the clip's start."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    e = read(spark, d, "events").select(KEY, "event_type", day.alias("day"))
    c = sequence.clips(e.select(KEY, "day").distinct(), KEY, "day", 7, 5, 3).select(KEY, "clip_start")
    within = c.withColumn("day", F.explode(F.sequence(F.col("clip_start"), F.col("clip_start") + 6))).join(e, [KEY, "day"])
    return within.groupBy(KEY, "clip_start", "event_type").agg(F.count("*").alias("n"), F.min(F.col("day") - F.col("clip_start")).alias("first"), F.max(F.col("day") - F.col("clip_start")).alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        tool_usage_histogram, operation_frequency, semantic_coherence, contradictions, tool_penalty, coordinate_bounds, step_coherence, total_reward, running_zscore, moving_avg_slope, latest_metric, smoothed_metric, grpo_replay_select, curriculum_step_weights, beta_controller, kl_window, failure_rate, latest_health, critical_conditions, review_counters, experience_rate, adaptive_rate, review_routing, simulation_metrics, configuration_metrics, robustness_score, first_n_accuracy, clip_regroup,
    )
}

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_S = f"s AS (SELECT user_id, ts, event_id, {OP_SQL} AS op, {KIND_SQL} AS kind, value, (props->>'$.k')::BIGINT AS k, floor(value / 20)::BIGINT AS x, (props->>'$.k')::BIGINT % 5 AS y FROM events)"
_GOOD = "(" + " OR ".join(f"(p = '{a}' AND op = '{b}')" for a, b in sequence.GOOD_PAIRS) + ")"
_PENALTY = f"""v AS (SELECT user_id, op, lag(op) OVER w AS p1, lag(op, 2) OVER w AS p2 FROM s WHERE kind = 'visual_operation' WINDOW w AS ({_W})),
    pen AS (SELECT user_id, least(greatest(-(0.1::DOUBLE * greatest(count(*) - 40, 0) + CASE WHEN coalesce(bool_or(op = p1 AND op = p2), false) THEN 0.5 ELSE 0 END + 0.2::DOUBLE * count(*) FILTER (WHERE op = 'ZOOM_IN' AND p1 = 'ZOOM_IN')), -10), 0) AS penalty FROM v GROUP BY user_id),
    penalties AS (SELECT user_id, coalesce(penalty, 0) AS penalty FROM (SELECT DISTINCT user_id FROM s) LEFT JOIN pen USING (user_id))"""

from .sequence_queries import ORACLE_SQL as _SEQUENCE  # noqa: E402

ORACLE_SQL = {
    "tool_usage_histogram": f"WITH {_S} SELECT user_id, op, count(*) AS n FROM s WHERE kind = 'visual_operation' GROUP BY ALL",
    "operation_frequency": f"WITH {_S} SELECT op, count(*) AS n, count(DISTINCT user_id) AS sequences FROM s GROUP BY op",
    "semantic_coherence": """WITH p AS (SELECT label, embedding::DOUBLE[] AS a, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), m AS (SELECT label, avg(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) AS c FROM p GROUP BY label)
        SELECT label, round(c, 6) + 0.0 AS similarity, round(CASE WHEN c IS NULL THEN 0 WHEN c < 0.3 THEN -0.5 WHEN c > 0.9 THEN -0.3 ELSE (c - 0.3) / 0.6 END, 6) + 0.0 AS coherence FROM m""",
    "contradictions": f"""WITH {_S}, m AS (SELECT *, coalesce(max(CASE WHEN op = 'SEGMENT_OBJECT_AT' THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, row_number() OVER (PARTITION BY user_id, op, x, y ORDER BY ts, event_id) AS nth FROM s)
        SELECT user_id, count(*) FILTER (WHERE op = 'SEGMENT_OBJECT_AT' AND nth > 1) AS again, count(*) FILTER (WHERE op IN ('GET_PROPERTIES', 'TRACK_OBJECT') AND seen = 0) AS early FROM m GROUP BY user_id""",
    "tool_penalty": f"WITH {_S}, {_PENALTY} SELECT user_id, round(penalty, 6) + 0.0 AS penalty FROM penalties",
    "coordinate_bounds": f"WITH {_S} SELECT user_id, count(*) FILTER (WHERE value NOT BETWEEN 0 AND 80) + count(*) FILTER (WHERE k NOT BETWEEN 0 AND 80) AS wrong FROM s GROUP BY user_id",
    "step_coherence": f"""WITH {_S}, p AS (SELECT user_id, op, lag(op) OVER w AS p, lag(y) OVER w = y AS same, lead(op) OVER w IS NULL AS last FROM s WINDOW w AS ({_W}))
        SELECT user_id, round(coalesce(sum(CASE WHEN p = op AND same THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN {_GOOD} AND NOT last THEN 0.2::DOUBLE ELSE 0 END) FILTER (WHERE p IS NOT NULL) / nullif(count(p), 0), 0), 6) + 0.0 AS coherence FROM p GROUP BY user_id""",
    "total_reward": f"""WITH {_S}, {_PENALTY}, f AS ({_SEQUENCE['logical_flow']}), t AS ({_SEQUENCE['tool_pattern']}), j AS (SELECT * FROM penalties JOIN f USING (user_id) JOIN t USING (user_id))
        SELECT user_id, round(least(greatest(flow * 0.7::DOUBLE + pattern * 0.3::DOUBLE + penalty, -10), 10), 6) + 0.0 AS weighted, round(least(greatest(flow + pattern + penalty, -10), 10), 6) + 0.0 AS plain FROM j""",
    "running_zscore": f"""WITH r AS (SELECT event_id, value, row_number() OVER ({_W}) AS pos, avg(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS mean, stddev_pop(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS dev FROM events), q AS (SELECT *, CASE WHEN pos > 1 THEN dev ELSE 1 END AS std FROM r)
        SELECT event_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(CASE WHEN pos < 10 THEN value ELSE least(greatest((value - mean) / (std + 1e-8), -3), 3) END, 6) + 0.0 AS z FROM q""",
    "moving_avg_slope": f"""WITH r AS (SELECT *, row_number() OVER ({_W}) AS pos FROM events)
        SELECT event_id, round(avg(value) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) + 0.0 AS moving_mean, CASE WHEN pos >= 5 THEN round(regr_slope(value, pos) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) + 0.0 END AS slope FROM r""",
    "latest_metric": f"""WITH r AS (SELECT *, row_number() OVER ({_W}) AS pos FROM events), m AS (SELECT user_id, pos, value, avg(value) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mm, regr_slope(value, pos) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sl, count(*) OVER (PARTITION BY user_id) AS n FROM r)
        SELECT user_id, value, round(mm, 6) + 0.0 AS moving_mean, CASE WHEN pos >= 5 THEN round(sl, 6) + 0.0 END AS slope FROM m WHERE pos = n""",
    "smoothed_metric": f"""WITH r AS (SELECT user_id, (props->>'$.k')::DOUBLE AS loss, row_number() OVER ({_W}) AS pos, avg(value) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM events)
        SELECT user_id, count(*) FILTER (WHERE pos >= 5) AS "full", count(*) FILTER (WHERE pos >= 5 AND m >= 50 AND loss <= 40) AS advance FROM r GROUP BY user_id""",
    "grpo_replay_select": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > (SELECT quantile_cont(l_quantity, 0.7) FROM lineitem) GROUP BY l_suppkey",
    "curriculum_step_weights": "WITH e AS (SELECT value, CASE WHEN event_id % 1000 >= 600 THEN 0.6::DOUBLE WHEN event_id % 1000 >= 300 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS task FROM events) SELECT task, CASE task WHEN 0.6::DOUBLE THEN 0.4::DOUBLE WHEN 0.8::DOUBLE THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS curiosity, count(*) AS n, round(sum(task * value), 6) AS weighted FROM e GROUP BY task",
    "beta_controller": f"""WITH r AS (SELECT user_id, ts, event_id, row_number() OVER ({_W}) AS pos, avg(value) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM events), t AS (SELECT user_id, list(CASE WHEN pos < 10 THEN 0 WHEN m > 55 THEN 1 WHEN m < 45 THEN -1 ELSE 0 END ORDER BY pos) AS turns FROM r GROUP BY user_id)
        SELECT user_id, round(list_reduce(list_prepend(0.1::DOUBLE, turns::DOUBLE[]), lambda b, t: least(greatest(CASE WHEN t > 0 THEN b * 1.5::DOUBLE WHEN t < 0 THEN b / 1.5::DOUBLE ELSE b END, 0.0001::DOUBLE), 1::DOUBLE)), 6) AS beta, len(list_filter(turns, lambda x: x > 0))::INTEGER AS raised, len(list_filter(turns, lambda x: x < 0))::INTEGER AS lowered FROM t""",
    "kl_window": f"WITH r AS (SELECT user_id, value, avg(value) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM events) SELECT user_id, count(*) FILTER (WHERE value > 2 * m) AS blocked, count(*) FILTER (WHERE value <= 2 * m) AS applied, round(avg(value) FILTER (WHERE value <= 2 * m), 6) AS mean_applied FROM r GROUP BY user_id",
    "failure_rate": f"WITH r AS (SELECT user_id, row_number() OVER ({_W})::INTEGER AS at_, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS rate FROM events) SELECT user_id, at_ AS \"at\", round(rate, 6) + 0.0 AS rate FROM r WHERE at_ % 10 = 0",
    "latest_health": "WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS pos FROM events) SELECT user_id, count(*) AS metrics, max(value) AS worst, bool_and(value < 150) AS healthy FROM r WHERE pos = 1 GROUP BY user_id",
    "critical_conditions": "SELECT condition, count(*) AS n FROM (SELECT 'worker' AS condition FROM events WHERE event_type = 'error' UNION ALL SELECT 'queue' FROM events WHERE (props->>'$.k')::DOUBLE / 100 > 0.95 UNION ALL SELECT 'memory' FROM events WHERE value > 180) GROUP BY condition",
    "review_counters": "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS approved, count(*) FILTER (WHERE event_type = 'error') AS rejected, round(avg(value), 6) AS confidence FROM events GROUP BY user_id",
    "experience_rate": "SELECT user_id, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9), 6) AS per_hour FROM events GROUP BY user_id",
    "adaptive_rate": "WITH e AS (SELECT event_type, (props->>'$.k')::DOUBLE / 100 AS c FROM events) SELECT event_type, count(*) FILTER (WHERE c >= 0.7::DOUBLE) AS updates, round(avg(least(greatest(0.001::DOUBLE * (1 - c), 0.0001::DOUBLE), 0.001::DOUBLE)) * 1000, 6) AS rate FROM e GROUP BY event_type",
    "review_routing": "SELECT event_id, user_id FROM events WHERE ('0x' || substr(md5('review:' || event_id::VARCHAR), 1, 8))::BIGINT % 10000 < 200",
    "simulation_metrics": "WITH m AS (SELECT avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END) AS success, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, stddev_pop(value) AS spread FROM events) SELECT round(success, 6) AS success, round(p50, 6) AS p50, round(p99, 6) AS p99, round(spread, 6) AS spread, success > 0.5 AND p99 < 1000 AS passed FROM m",
    "configuration_metrics": f"""WITH r AS (SELECT user_id, value, row_number() OVER ({_W})::INTEGER AS pos, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY user_id) AS peak FROM events)
        SELECT user_id, round(avg(value) FILTER (WHERE pos > n - 20), 6) AS final, min(pos) FILTER (WHERE value >= 0.9::DOUBLE * peak) AS converged, round(1 / (var_pop(value) FILTER (WHERE pos > n - 20) + 1e-6), 6) AS stability FROM r GROUP BY user_id""",
    "robustness_score": "WITH e AS (SELECT event_type, value, (props->>'$.k')::BIGINT % 3 AS k FROM events) SELECT event_type, round(avg(value) FILTER (WHERE k = 0) / avg(value) * 0.2::DOUBLE + avg(value) FILTER (WHERE k = 1) / avg(value) * 0.3::DOUBLE + avg(value) FILTER (WHERE k = 2) / avg(value) * 0.5::DOUBLE, 6) AS score FROM e GROUP BY event_type",
    "first_n_accuracy": f"WITH r AS (SELECT user_id, event_type, row_number() OVER ({_W}) AS pos FROM events) SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM r WHERE pos <= 10 GROUP BY user_id",
    "clip_regroup": """WITH e AS (SELECT user_id, event_type, datediff('day', DATE '2024-01-01', ts::DATE) AS day FROM events), c AS (SELECT user_id, max(day) AS hi, unnest(range(min(day), max(day) + 1, 5)) AS clip_start FROM e GROUP BY user_id)
        SELECT c.user_id, clip_start, event_type, count(*) AS n, min(day - clip_start) AS first, max(day - clip_start) AS last FROM c JOIN e ON c.user_id = e.user_id AND day BETWEEN clip_start AND clip_start + 6 WHERE least(clip_start + 6, hi) - clip_start + 1 >= 3 GROUP BY ALL""",
}
