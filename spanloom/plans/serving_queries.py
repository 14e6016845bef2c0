"""An online service's decisions and logs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving
from .tables import ORDER, read


def _six(df, *names):
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def _events(spark, d):
    return read(spark, d, "events").withColumn("c", F.get_json_object("props", "$.k").cast("double") / 100)


def infer_modes(spark, d):
    """How a service would treat each user's events, and the mean priority of what it stores."""
    m = serving.modes(_events(spark, d), "user_id", ORDER, "c", cold=20)
    return _six(m.groupBy("user_id", "mode").agg(F.count("*").alias("n"), F.avg("priority").alias("priority")), "priority")


def log_rotation(spark, d):
    """Files of each user's log, at most about a thousand bytes each."""
    r = serving.rotated(read(spark, d, "events"), "user_id", ORDER, F.length("props") + F.length("event_type"), 1000)
    return r.groupBy("user_id", "file").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def retention_cleanup(spark, d):
    """What is older than a week before the last event, and the first of it."""
    e = read(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    return serving.prune_report(e.crossJoin(last), F.col("ts") < F.col("last") - F.expr("INTERVAL 7 DAYS"), "event_id")


def index_rebuild(spark, d):
    """Orders of a snapshot with later ones as a log of operations."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    snapshot = serving.last_wins(o.filter("o_orderkey % 2 = 0"), "o_custkey", ["o_orderkey"])
    log = o.filter("o_orderkey % 2 = 1").withColumn("operation", F.when(F.col("o_orderkey") % 7 == 0, "delete").otherwise("update"))
    return serving.rebuilt(snapshot, log, "o_custkey", "o_orderkey")


def metric_poll_dedup(spark, d):
    """How many of a poller's readings changed, and their sum."""
    e = read(spark, d, "events").withColumn("reading", F.floor(F.col("value") / 50))
    return serving.changed(e, "user_id", ORDER, "reading").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("reading").alias("total"))


def reward_cache_hits(spark, d):
    """Questions that a cache with a day's time to live would answer."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    h = serving.cache_hits(read(spark, d, "events"), ["user_id", "event_type"], ORDER, t, 86400)
    return h.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def restart_backoff(spark, d):
    """Restarts after errors: waits double, three in a row are an emergency."""
    r = serving.restarts(read(spark, d, "events"), "user_id", ORDER, F.col("event_type") == "error")
    return r.select("event_id", "in_a_row", "wait", "emergency")


def stale_segments(spark, d):
    """Orders that are open for longer than a year before the last one, or whose worker is gone."""
    o = read(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))  # one row
    stale = (F.datediff("last", "o_orderdate") > 365) | (F.col("o_custkey") % 10 == 3)
    return o.filter("o_orderstatus = 'P'").crossJoin(last).filter(stale).select("o_orderkey")


def rate_limiter(spark, d):
    """Events of each user that a limit of ten a minute and two an hour accepts."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return serving.limited(read(spark, d, "events"), "user_id", t, "event_id", 10, 2)


def log_replay(spark, d):
    """The last order of each customer in a log, and the first."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    order = ["o_orderdate", "o_orderkey"]
    first = serving.last_wins(o, "o_custkey", order, first=True).select("o_custkey", F.col("o_orderkey").alias("first"))
    return serving.last_wins(o, "o_custkey", order).select("o_custkey", F.col("o_orderkey").alias("last")).join(first, "o_custkey")


def artifact_resolve(spark, d):
    """The newest version of each customer's orders, by number and as texts compare."""
    v = serving.numbered(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    text = serving.resolved(v, "o_custkey", "version", as_text=True).select("o_custkey", F.col("version").alias("as_text"))
    return serving.resolved(v, "o_custkey", "version").select("o_custkey", "version").join(text, "o_custkey")


def metrics_ring(spark, d):
    """The last thousand metrics, by type."""
    return _six(serving.ring(read(spark, d, "events"), ORDER, 1000).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


def tombstone_delete(spark, d):
    """Documents that no later line deletes."""
    gone = read(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return read(spark, d, "documents").select("doc_id", "lang").join(gone, "doc_id", "left_anti")


def experience_counters(spark, d):
    """Retrievals and successes of each key in a log of events."""
    e = read(spark, d, "events").withColumn("key", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("key").agg(F.count("*").alias("retrievals"), F.count_if(F.col("event_type") == "purchase").alias("successes"))


def seed_run_summary(spark, d):
    """One row per run: whether it succeeded, its metrics, its time."""
    e = read(spark, d, "events").withColumn("seed", F.col("event_id") % 5)
    return _six(e.groupBy("user_id", "seed").agg((F.count_if(F.col("event_type") == "error") == 0).alias("success"), F.avg("value").alias("metric"), F.count("*").alias("steps")), "metric")


QUERIES = {n: f for n, f in list(globals().items()) if getattr(f, "__module__", None) == __name__ and not n.startswith("_")}

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_s = "epoch_us(ts) // 1000000"

ORACLE_SQL = {
    "infer_modes": f"WITH e AS (SELECT user_id, (props->>'$.k')::DOUBLE / 100 AS c, row_number() OVER ({_W}) - 1 AS seen FROM events), m AS (SELECT *, CASE WHEN seen < 20 THEN 'bootstrap' WHEN c >= 0.7::DOUBLE THEN 'update' ELSE 'infer' END AS mode FROM e) SELECT user_id, mode, count(*) AS n, round(avg(CASE WHEN mode = 'bootstrap' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE * (1 - c) + 0.25 END), 6) AS priority FROM m GROUP BY ALL",
    "log_rotation": f"WITH r AS (SELECT user_id, event_id, coalesce(sum(length(props) + length(event_type)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 1000 AS file FROM events) SELECT user_id, file, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL",
    "retention_cleanup": "WITH e AS (SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS gone FROM events) SELECT count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT gone) AS remaining, (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM e WHERE gone ORDER BY event_id LIMIT 10)) AS first FROM e",
    "index_rebuild": """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1), l AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
      SELECT * FROM s WHERE o_custkey NOT IN (SELECT o_custkey FROM l) UNION ALL SELECT * FROM l WHERE o_orderkey % 7 <> 0""",
    "metric_poll_dedup": f"WITH r AS (SELECT user_id, floor(value / 50)::BIGINT AS reading, lag(floor(value / 50)::BIGINT) OVER ({_W}) AS before FROM events) SELECT user_id, count(*) AS n, sum(reading)::BIGINT AS total FROM r WHERE before IS NULL OR reading <> before GROUP BY user_id",
    "reward_cache_hits": f"WITH r AS (SELECT event_type, {_s} - lag({_s}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400 AS hit FROM events) SELECT event_type, count(*) FILTER (WHERE hit) AS hits, count(*) AS n FROM r GROUP BY event_type",
    "restart_backoff": f"WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER ({_W}) AS run FROM events), c AS (SELECT event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS in_a_row FROM m) SELECT event_id, in_a_row, least(2.0::DOUBLE ** (in_a_row - 1), 60) AS wait, in_a_row >= 3 AS emergency FROM c WHERE event_type = 'error'",
    "stale_segments": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND (datediff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) > 365 OR o_custkey % 10 = 3)",
    "log_replay": "SELECT o_custkey, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first FROM orders GROUP BY o_custkey",
    "artifact_resolve": "WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS v FROM orders) SELECT o_custkey, max(v) AS version, last(v ORDER BY 'v' || v) AS as_text FROM v GROUP BY o_custkey",
    "metrics_ring": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY event_type",
    "tombstone_delete": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "experience_counters": "SELECT (props->>'$.k')::BIGINT AS key, count(*) AS retrievals, count(*) FILTER (WHERE event_type = 'purchase') AS successes FROM events GROUP BY key",
    "seed_run_summary": "SELECT user_id, event_id % 5 AS seed, count(*) FILTER (WHERE event_type = 'error') = 0 AS success, round(avg(value), 6) AS metric, count(*) AS steps FROM events GROUP BY ALL",
}
