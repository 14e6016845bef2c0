"""Sequence scores over ``events``: one sequence per user, ordered by time and id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import sequence
from .tables import KIND_SQL, OP_SQL, ORDER, read, steps

KEY = "user_id"


def _rounded(df, *names):
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def logical_flow(spark, d):
    """Progression scores."""
    return _rounded(sequence.logical_flow(steps(spark, d), KEY, ORDER), "flow")


def tool_pattern(spark, d):
    """Tool pattern scores."""
    return _rounded(sequence.tool_pattern(steps(spark, d), KEY, ORDER), "pattern")


def bigram_coherence(spark, d):
    """Good, bad and repeated step pairs."""
    return sequence.bigram_counts(steps(spark, d), KEY, ORDER)


def repetition_flags(spark, d):
    """Whether three equal visual operations follow one another."""
    return sequence.repetition(steps(spark, d), KEY, ORDER, 3)


def op_islands_batch4(spark, d):
    """Numbers of runs of equal operations of at most four steps, by operation and length."""
    return sequence.runs(steps(spark, d), KEY, ORDER, 4).groupBy("op", "length").agg(F.count("*").alias("n"))


def tool_misuse(spark, d):
    """Steps without what they need, and operations beyond their number."""
    return sequence.misuse(steps(spark, d), KEY, ORDER)


def exploration_and_tool_efficiency(spark, d):
    """Efficiency, exploration, coherence and thinking."""
    return _rounded(sequence.efficiency(steps(spark, d), KEY, ORDER, "props"), "efficiency", "exploration", "coherence", "thinking")


def loop_detection(spark, d):
    """Whether each conversation's roles hold a pattern that follows itself."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("op"))
    return sequence.loops(turns, "conv_id", ["turn"])


def difficulty_score(spark, d):
    """Difficulty and its parts, and its bin."""
    scored = sequence.difficulty(steps(spark, d), KEY).withColumn("difficulty", F.round("difficulty", 9))
    return _rounded(sequence.difficulty_bins(scored, "difficulty"), "complexity", "sophistication", "depth", "difficulty")


def rolling_zscore(spark, d):
    """Mean, deviation, z-score and slope over the last 100 values of each event type."""
    e = read(spark, d, "events")
    r = sequence.rolling(e, "event_type", ORDER, "value", 100)
    return _rounded(r.select("event_id", F.round("mean", 9).alias("mean"), "z", "slope"), "z", "slope")


def ewma_fold(spark, d):
    """The exponentially weighted mean of each user's values."""
    return _rounded(sequence.ewma(read(spark, d, "events"), KEY, ORDER, "value", 0.05), "ewma")


def grpo_group_normalise(spark, d):
    """Advantages within consecutive groups of four lines of a part's supplier."""
    li = read(spark, d, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    n = sequence.group_normalise(li, "l_suppkey", order, "l_quantity")
    return n.select("l_suppkey", "group", F.round("advantage", 5).alias("advantage")).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("advantage") == 0).alias("zeros"), F.round(F.sum(F.abs("advantage")), 3).alias("spread"))


def sliding_clips(spark, d):
    """Clips of seven days, every five, over the days on which a user was seen."""
    days = read(spark, d, "events").select(KEY, F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")).distinct()
    return sequence.clips(days, KEY, "day", 7, 5, 3)


def motion_stats(spark, d):
    """Path, speed and displacement of points made of values and keys."""
    e = read(spark, d, "events").withColumn("y", F.get_json_object("props", "$.k").cast("double"))
    return _rounded(sequence.motion(e, KEY, ORDER, "value", "y"), "path", "speed", "fastest", "displacement")


def trend_by_type(spark, d):
    """The trend of each event type's values."""
    e = sequence.rolling(read(spark, d, "events"), "event_type", ORDER, "value", 1 << 30)
    slope = F.regr_slope(F.col("value"), F.col("at").cast("double"))
    return e.groupBy("event_type").agg(F.round(slope, 9).alias("slope"), scalar.trend_label(slope, 0.001).alias("trend"))


QUERIES = {f.__name__: f for f in (logical_flow, tool_pattern, bigram_coherence, repetition_flags, op_islands_batch4, tool_misuse, exploration_and_tool_efficiency, loop_detection, difficulty_score, rolling_zscore, ewma_fold, grpo_group_normalise, sliding_clips, motion_stats, trend_by_type)}

_STEPS = f"steps AS (SELECT user_id, ts, event_id, {OP_SQL} AS op, {KIND_SQL} AS kind, value, props FROM events), adj AS (SELECT *, lag(op) OVER w AS prev_op, lag(kind) OVER w AS prev_kind, row_number() OVER w AS step FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_pairs = lambda pairs: "(" + " OR ".join(f"(prev_op = '{a}' AND op = '{b}')" for a, b in pairs) + ")"
_weight = "CASE op " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in scalar.OPERATION_WEIGHT.items()) + " END"

ORACLE_SQL = {
    "logical_flow": f"""WITH {_STEPS} SELECT user_id, round(least(greatest(CASE WHEN count(*) > 1 THEN sum(CASE WHEN prev_op IS NULL THEN 0 ELSE
        CASE WHEN prev_kind = kind AND prev_op = op THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN prev_kind <> kind THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN prev_kind = 'visual_operation' AND kind = 'reasoning' THEN 0.2::DOUBLE ELSE 0 END END) / (count(*) - 1) ELSE 0 END, -1), 1), 6) + 0.0 AS flow FROM adj GROUP BY user_id""",
    "tool_pattern": f"""WITH {_STEPS}, pairs AS (SELECT user_id, count(*) FILTER (WHERE prev_kind = 'visual_operation' AND {_pairs(sequence.GOOD_PAIRS[:2])}) AS good FROM adj GROUP BY user_id),
        uses AS (SELECT user_id, count(*) AS tools, max(n) AS most FROM (SELECT user_id, op, count(*) AS n FROM steps WHERE kind = 'visual_operation' GROUP BY ALL) GROUP BY user_id)
        SELECT user_id, round(CASE WHEN tools IS NULL THEN 0 ELSE least(greatest(least(tools * 0.1::DOUBLE, 0.5) - greatest(most - 5, 0) * 0.1::DOUBLE + good * 0.2::DOUBLE, -1), 1) END, 6) + 0.0 AS pattern FROM pairs LEFT JOIN uses USING (user_id)""",
    "bigram_coherence": f"WITH {_STEPS} SELECT user_id, count(*) FILTER (WHERE {_pairs(sequence.GOOD_PAIRS)}) AS good, count(*) FILTER (WHERE {_pairs(sequence.BAD_PAIRS)}) AS bad, count(*) FILTER (WHERE prev_op = op) AS repeats FROM adj GROUP BY user_id",
    "repetition_flags": f"""WITH {_STEPS}, seen AS (SELECT *, lag(op) OVER w AS p1, lag(op, 2) OVER w AS p2 FROM steps WHERE kind = 'visual_operation' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, coalesce(bool_or(op = p1 AND op = p2), false) AS repeats FROM (SELECT DISTINCT user_id FROM steps) LEFT JOIN seen USING (user_id) GROUP BY user_id""",
    "op_islands_batch4": f"""WITH {_STEPS}, marked AS (SELECT *, sum(CASE WHEN op IS NOT DISTINCT FROM prev_op THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM adj),
        placed AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 4 AS part FROM marked)
        SELECT op, length, count(*) AS n FROM (SELECT user_id, run, part, op, count(*) AS length FROM placed GROUP BY ALL) GROUP BY ALL""",
    "tool_misuse": f"""WITH {_STEPS}, f AS (SELECT *, coalesce(max(CASE WHEN op = 'SEGMENT_OBJECT_AT' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM steps)
        SELECT user_id, count(*) FILTER (WHERE op IN ('GET_PROPERTIES', 'TRACK_OBJECT') AND seen = 0) AS early, greatest(count(*) FILTER (WHERE kind = 'visual_operation') - 10, 0) AS beyond FROM f GROUP BY user_id""",
    "exploration_and_tool_efficiency": f"""WITH {_STEPS} SELECT user_id, round(count(DISTINCT op) / count(*)::DOUBLE * CASE WHEN count(*) > 20 THEN 0.9::DOUBLE * 0.8::DOUBLE WHEN count(*) > 15 THEN 0.9 ELSE 1 END, 6) AS efficiency,
        round(count(DISTINCT op || props) / count(*)::DOUBLE, 6) AS exploration, round(coalesce(avg(CASE WHEN prev_op IS NULL THEN NULL WHEN prev_op = op THEN 0.5 ELSE 1 END), 1), 6) AS coherence, round(count(*) FILTER (WHERE op = 'THINK') / count(*)::DOUBLE, 6) AS thinking FROM adj GROUP BY user_id""",
    "loop_detection": """WITH seqs AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
        SELECT conv_id, len(r) >= 4 AND len(list_filter(range(2, len(r) // 2), lambda m: len(list_filter(range(1, len(r) - 2 * m + 2), lambda i: r[i:i + m - 1] = r[i + m:i + 2 * m - 1])) > 0)) > 0 AS loops FROM seqs""",
    "difficulty_score": f"""WITH {_STEPS}, sums AS (SELECT user_id, count(*) AS n, count({_weight}) AS ops, coalesce(sum({_weight}), 0) AS w, count(DISTINCT CASE WHEN {_weight} IS NOT NULL THEN op END) AS kinds, count(*) FILTER (WHERE op = 'THINK') / count(*)::DOUBLE AS t FROM steps GROUP BY user_id),
        parts AS (SELECT user_id, n, CASE WHEN n < 2 THEN 0.1 ELSE least(ln(n + 1) / ln(16), 1) END AS complexity, CASE WHEN ops = 0 THEN 0.3 ELSE least(w / (3.0::DOUBLE * ops) + 0.2::DOUBLE * kinds / ops, 1) END AS sophistication, CASE WHEN t < 0.2 THEN t / 0.2::DOUBLE WHEN t > 0.6 THEN 1 - (t - 0.6::DOUBLE) / 0.4::DOUBLE * 0.3::DOUBLE ELSE 1 END AS depth FROM sums),
        scored AS (SELECT *, round(least(greatest(0.30::DOUBLE * complexity + 0.25::DOUBLE * sophistication + 0.20::DOUBLE * depth, 0.1), 1), 9) AS difficulty FROM parts),
        q AS (SELECT quantile_cont(difficulty, 0.25) AS lo, quantile_cont(difficulty, 0.75) AS hi FROM scored), c AS (SELECT quantile_cont(difficulty, 0.33) AS a, quantile_cont(difficulty, 0.66) AS b FROM scored, q WHERE difficulty BETWEEN lo - (hi - lo) * 1.5 AND hi + (hi - lo) * 1.5)
        SELECT user_id, n, round(complexity, 6) AS complexity, round(sophistication, 6) AS sophistication, round(depth, 6) AS depth, round(difficulty, 6) AS difficulty, CASE WHEN difficulty <= a THEN 'easy' WHEN difficulty <= b THEN 'medium' ELSE 'hard' END AS bin FROM scored, c""",
    "rolling_zscore": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events),
        s AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w + 1e-8 AS dev, regr_slope(value, pos) OVER w AS slope FROM r WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
        SELECT event_id, round(mean, 9) AS mean, round(CASE WHEN pos < 10 THEN value ELSE (value - mean) / dev END, 6) AS z, CASE WHEN isnan(slope) THEN NULL ELSE round(slope, 6) + 0.0 END AS slope FROM s""",
    "ewma_fold": "SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * (1 - 0.05::DOUBLE) + x * 0.05::DOUBLE), 6) AS ewma FROM events GROUP BY user_id",
    "grpo_group_normalise": """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 4 AS g FROM lineitem),
        a AS (SELECT l_suppkey, (l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey, g)) / (coalesce(stddev_samp(l_quantity) OVER (PARTITION BY l_suppkey, g), 0) + 1e-8) AS x FROM p),
        b AS (SELECT l_suppkey, round(CASE WHEN abs(x) <= 0.01 THEN 0 ELSE x END, 5) AS x FROM a)
        SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE x = 0) AS zeros, round(sum(abs(x)), 3) AS spread FROM b GROUP BY l_suppkey""",
    "sliding_clips": """WITH days AS (SELECT DISTINCT user_id, datediff('day', DATE '2024-01-01', ts::DATE) AS day FROM events), s AS (SELECT user_id, max(day) AS hi, unnest(range(min(day), max(day) + 1, 5)) AS clip_start FROM days GROUP BY user_id)
        SELECT s.user_id, clip_start, count(*) AS n FROM s JOIN days d ON s.user_id = d.user_id AND d.day BETWEEN clip_start AND clip_start + 6 WHERE least(clip_start + 6, hi) - clip_start + 1 >= 3 GROUP BY ALL""",
    "motion_stats": """WITH p AS (SELECT user_id, ts, event_id, value AS x, (props->>'$.k')::DOUBLE AS y FROM events), s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, round(coalesce(sum(step), 0), 6) AS path, round(coalesce(avg(step), 0), 6) AS speed, round(coalesce(max(step), 0), 6) AS fastest, round(sqrt((last(x ORDER BY ts, event_id) - first(x ORDER BY ts, event_id)) ** 2 + (last(y ORDER BY ts, event_id) - first(y ORDER BY ts, event_id)) ** 2), 6) AS displacement, coalesce(sum(step), 0) < 10 AS stationary FROM s GROUP BY user_id""",
    "trend_by_type": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events), s AS (SELECT event_type, regr_slope(value, pos) AS slope FROM r GROUP BY event_type)
        SELECT event_type, round(slope, 9) AS slope, CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'improving' ELSE 'declining' END AS trend FROM s""",
}
