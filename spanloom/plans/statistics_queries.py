"""Comparisons of models, raters, runs and samples on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import privacy, scalar
from ..operators import sampling, statistics
from .tables import ORDER, read


def _six(df, *names):
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def _ratings(spark, d):
    """A line is a rating of an order by a supplier, of the model that its flag names."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("rater"), F.col("l_returnflag").alias("model"), F.floor(F.col("l_quantity") / 10.001).cast("long").alias("rating"), F.col("l_discount").alias("minutes"), "l_quantity", "l_linestatus")


def model_compare(spark, d):
    """Mean, deviation and median rating of each model."""
    r = _ratings(spark, d)
    return _six(r.groupBy("model").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("std"), F.percentile("rating", 0.5).alias("median")), "mean", "std")


def annotator_stats(spark, d):
    """What each rater did; the deviation is of the distinct ratings."""
    r = _ratings(spark, d)
    distinct = r.select("rater", "rating").distinct().groupBy("rater").agg(F.stddev_pop("rating").alias("rating_std"))
    return _six(r.groupBy("rater").agg(F.count("*").alias("n"), F.avg("minutes").alias("minutes"), F.avg("rating").alias("mean")).join(distinct, "rater"), "minutes", "mean", "rating_std")


def preference_agreement(spark, d):
    """The share of samples on whose model all raters agree, among those rated twice at least."""
    r = _ratings(spark, d).groupBy("sample").agg(F.countDistinct("model").alias("kinds"), F.count("*").alias("n")).filter("n > 1")
    return _six(r.agg(F.count("*").alias("samples"), F.avg((F.col("kinds") == 1).cast("double")).alias("unanimous")), "unanimous")


def metric_overall(spark, d):
    """Each metric over everything and by category; what is over everything is combined from the categories, as the SQL's sums are."""
    r = read(spark, d, "lineitem").select("l_returnflag", F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"))).alias("metric", "x"))
    per = r.groupBy("l_returnflag", "metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("s"), F.count("x").alias("k"))
    return _six(statistics.with_totals(per, "metric", "l_returnflag").drop("s", "k"), "mean", "std")


def success_criteria(spark, d):
    """Which criteria event types meet, and whether all of them are met."""
    m = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    met = F.when(F.col("event_type") == "error", F.col("mean") < 60).otherwise(F.col("mean") > 40)
    one = m.select("event_type", met.alias("met"))
    return one.unionByName(one.agg(F.lit("overall").alias("event_type"), F.bool_and("met").alias("met")))


def best_model(spark, d):
    """The best model of each status, the first by name among equals."""
    m = _ratings(spark, d).groupBy("l_linestatus", "model").agg(F.round(F.avg("l_quantity"), 9).alias("mean"))
    w = Window.partitionBy("l_linestatus").orderBy(F.desc("mean"), "model")
    return _six(m.withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at"), "mean")


def sample_efficiency(spark, d):
    """Means of two arms at four shares of the orders, and the gain."""
    o = read(spark, d, "orders").withColumn("u", sampling.share_of(F.col("o_orderkey"), 7)).withColumn("pct", F.explode(F.array(*map(F.lit, (10, 25, 50, 100))))).filter("u * 100 < pct")
    p = o.groupBy("pct").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return _six(p.select("pct", "F", "O", (F.col("O") - F.col("F")).alias("gain"), ((F.col("O") - F.col("F")) / F.col("F")).alias("relative")), "F", "O", "gain", "relative")


def cluster_patterns(spark, d):
    """Members, mean and most frequent brand of each size of part, and its two most frequent types."""
    p = read(spark, d, "part")
    n = p.groupBy("p_size", "p_type").agg(F.count("*").alias("c"))
    top = n.withColumn("at", F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("c"), "p_type"))).filter("at <= 2").groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p_type"))), lambda s: s.p_type), ",").alias("types"))
    return _six(p.groupBy("p_size").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean")).join(top, "p_size"), "mean")


def trajectory_stages(spark, d):
    """Lengths and errors of sequences by the third of the run that they begin in."""
    s = read(spark, d, "events").groupBy("user_id", (F.floor(F.col("event_id") / 100) % 3).alias("stage")).agg(F.count("*").alias("length"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return _six(s.groupBy("stage").agg(F.count("*").alias("n"), F.avg("length").alias("length"), F.avg(F.col("kinds") / F.col("length")).alias("efficiency"), F.sum("errors").alias("errors")), "length", "efficiency")


def batch_summary(spark, d):
    """Orders by status, by priority and over all."""
    return read(spark, d, "orders").groupingSets([("o_orderstatus",), ("o_orderpriority",), ()], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def audit_stats(spark, d):
    """Events by type, by result and over all, with the last time of each."""
    e = read(spark, d, "events").withColumn("result", F.when(F.col("event_type") == "error", "failure").otherwise("success"))
    return e.groupingSets([("event_type",), ("result",), ()], "event_type", "result").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def redaction_stats(spark, d):
    """How often each category of personal data is found, and in how many documents."""
    names = [n for n, *_ in privacy.CATALOG]
    t = read(spark, d, "documents").select(F.explode(F.array(*[F.struct(F.lit(n).alias("category"), privacy.count(F.col("text"), n).alias("c")) for n in names])).alias("s")).select("s.*")
    return t.groupBy("category").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("documents"))


def distribution_validation(spark, d):
    """Languages that are too rare or come from too few sources."""
    g = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per language
    return _six(g.withColumn("share", share).withColumn("valid", (F.col("share") >= 0.25) & (F.col("sources") >= 3)), "share")


def annotation_progress(spark, d):
    """How far each rater is with the labelled documents, and how long the rest takes."""
    r = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("done"), F.avg("l_quantity").alias("seconds"))
    n = read(spark, d, "orders").agg(F.count("*").alias("all"))  # one row
    return _six(r.crossJoin(n).select("l_suppkey", "done", (100 * F.col("done") / F.col("all")).alias("percent"), (F.col("seconds") * (F.col("all") - F.col("done"))).alias("left")), "percent", "left")


def cache_stats(spark, d):
    """Entries, accesses and hits of a cache keyed by user and type."""
    e = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("accesses"))
    return _six(e.agg(F.count("*").alias("entries"), F.sum("accesses").alias("accesses"), F.sum(F.col("accesses") - 1).alias("hits"), F.avg("accesses").alias("mean")), "mean")


def voting_consistency(spark, d):
    """Mean, deviation and trend of each user's confidence, and whether it is often low."""
    k = F.get_json_object("props", "$.k").cast("double") / 100
    e = read(spark, d, "events").select("user_id", k.alias("c"), F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).alias("at"))
    slope = F.regr_slope("c", F.col("at").cast("double"))
    return _six(e.groupBy("user_id").agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), slope.alias("slope"), F.avg((F.col("c") < 0.3).cast("double")).alias("low")).withColumn("trend", scalar.trend_label(F.col("slope"), 0.001)).withColumn("warn", F.col("low") > 0.3), "mean", "std", "slope", "low")


def vote_distribution(spark, d):
    """Votes for each flag among an order's lines, and the winner's share."""
    v = read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("l_orderkey")
    best = v.withColumn("all", F.sum("votes").over(w)).withColumn("at", F.row_number().over(w.orderBy(F.desc("votes"), "l_returnflag"))).filter("at = 1")
    return _six(best.select("l_orderkey", "l_returnflag", "votes", (F.col("votes") / F.col("all")).alias("consensus")), "consensus")


def buffer_stats(spark, d):
    """Size, use, means and success of a buffer of a thousand events."""
    e = read(spark, d, "events")
    return _six(e.agg(F.least(F.count("*"), F.lit(1000)).alias("size"), F.avg("value").alias("priority"), F.countDistinct("user_id").alias("users"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("success")).withColumn("utilisation", F.col("size") / 1000), "priority", "success", "utilisation")


def update_stats(spark, d):
    """Applied and blocked updates, mean divergence and the last version, by type."""
    e = read(spark, d, "events")
    return _six(e.groupBy("event_type").agg(F.count_if(F.col("value") <= 100).alias("applied"), F.count_if(F.col("value") > 100).alias("blocked"), F.avg("value").alias("mean"), F.max("event_id").alias("version")), "mean")


def throughput(spark, d):
    """Events per second of each day's span."""
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    s = e.groupBy("day").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span")).filter("span > 0")
    return _six(s.select("day", "n", (F.col("n") / (F.col("span") / 1e6) * 1000).alias("per_1000_s")), "per_1000_s")


def run_intervals(spark, d):
    """Student intervals of the mean price of each order status."""
    return _six(statistics.t_summary(read(spark, d, "orders"), ["o_orderstatus"], "o_totalprice"), "mean", "std", "low", "high")


def ablation_tests(spark, d):
    """Pooled t tests of two flags' quantities by status, corrected for their number."""
    return _six(statistics.pooled_t(read(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_quantity", ["l_linestatus"], tests=2), "t", "d", "p", "p_corrected")


def wilcoxon_p(spark, d):
    """p-values of signed-rank tests of quantity against price."""
    li = read(spark, d, "lineitem").withColumn("b", F.round(F.col("l_extendedprice") / 2000, 1))
    return _six(statistics.signed_rank_p(statistics.signed_rank(li, "l_quantity", "b", ["l_linestatus", "l_returnflag"])), "w", "effect", "z", "p")


def icc_interval(spark, d):
    """The interval of the intraclass correlation."""
    li = read(spark, d, "lineitem")
    return _six(statistics.icc_interval(statistics.icc(li, "l_orderkey", "l_quantity"), li, "l_orderkey"), "msb", "msw", "icc", "low", "high")


def bootstrap_ci(spark, d):
    """Bootstrap intervals of customers' balances by market segment."""
    return _six(statistics.bootstrap(read(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", 50), "mean", "low", "high", "p")


def pii_redact_hashed(spark, d):
    """The lengths and digests of documents whose personal data is replaced by digests."""
    t = read(spark, d, "documents").select("doc_id", privacy.redact_hashed(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


def anonymise_verify(spark, d):
    """What is wrong with documents that were redacted in part."""
    done = F.col("doc_id") % 3 == 0
    t = read(spark, d, "documents").select("doc_id", F.when(done, privacy.redact(F.col("text"))).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("u")).alias("user_id"), done.alias("anonymised"))
    issues = privacy.verify_anonymised({"text": F.col("text")}, [F.col("user_id")], F.col("anonymised"))
    return t.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def uniform_sample(spark, d):
    """A hundred orders without replacement."""
    return sampling.uniform(read(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey")


def subset_series(spark, d):
    """Sizes of nested subsets of the orders."""
    o = read(spark, d, "orders")
    parts = [sampling.below(o, "o_orderkey", s).agg(F.lit(round(100 * s)).alias("percent"), F.count("*").alias("n")) for s in (0.1, 0.25, 0.5)]
    return parts[0].union(parts[1]).union(parts[2])


def curriculum_mixture(spark, d):
    """Draws with replacement from three statuses in given shares."""
    return sampling.mixture(read(spark, d, "orders"), "o_orderstatus", "o_orderkey", {"F": 0.5, "O": 0.3, "P": 0.2}, 200)


def active_curriculum(spark, d):
    """Orders that are active by the weight of their status."""
    return sampling.active(read(spark, d, "orders"), "o_orderstatus", "o_orderkey", {"F": 0.5, "O": 0.1}).select("o_orderkey", "o_orderstatus")


def ratio_sample(spark, d):
    """A fifth of each language's documents."""
    docs = read(spark, d, "documents").filter("lang IS NOT NULL")
    return sampling.active(docs, "lang", "doc_id", {n: 0.2 for n in ("en", "de", "fr", "es")}).select("doc_id", "lang")


def priority_success_sample(spark, d):
    """Fifty events, likelier by value and success."""
    weight = F.col("value") * F.when(F.col("event_type") == "purchase", 0.7 + 0.3 * 0.9).otherwise(1.0)
    return sampling.weighted(read(spark, d, "events"), "event_id", weight, 50).select("event_id")


def priority_batches(spark, d):
    """Requests in batches of eight by priority, then by time."""
    o = read(spark, d, "orders").filter("o_orderstatus = 'P'")
    return sampling.batches(o, "o_orderpriority", ["o_orderdate", "o_orderkey"], 8).select("o_orderkey", "batch")


def recent_alerts(spark, d):
    """The ten newest errors."""
    return read(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id")


def audit_search(spark, d):
    """The first thousand clicks whose properties hold a 7."""
    return sampling.searched(read(spark, d, "events"), ORDER, 1000, {"props": "7"}, event_type="click").select("event_id")


QUERIES = {n: f for n, f in list(globals().items()) if getattr(f, "__module__", None) == __name__ and not n.startswith("_")}

_R = "r AS (SELECT l_orderkey AS sample, l_suppkey AS rater, l_returnflag AS model, floor(l_quantity / 10.001::DOUBLE)::BIGINT AS rating, l_discount AS minutes, l_quantity, l_linestatus FROM lineitem)"
_lit = lambda text: "'" + text.replace("'", "''") + "'"
_count = lambda column, p: f"coalesce(len(regexp_extract_all({column}, {_lit(privacy.FLAGS + p)})), 0)"
_place = lambda key, seed=7: f"md5('{seed}:' || {key}::VARCHAR)"
_share = lambda key: f"(('0x' || substr({_place(key)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_u = lambda salt: f"(('0x' || substr(md5('7:{salt}:' || draw::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _hashed() -> str:
    parts, last = ["h0 AS (SELECT doc_id, text AS t FROM documents)"], "h0"
    for i, (_, pattern, label, _) in enumerate(privacy.CATALOG, 1):
        p = _lit(privacy.FLAGS + pattern)
        parts.append(f"""h{i} AS (SELECT doc_id, list_reduce(list_prepend('', list_transform(list_zip(string_split_regex(t, {p}), list_append(list_transform(regexp_extract_all(t, {p}), lambda m: '[{label}_' || substr(md5(m), 1, 6) || ']'), '')), lambda z: z[1] || z[2])), lambda a, b: a || b) AS t FROM {last})""")
        last = f"h{i}"
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, length(t)::INTEGER AS chars, md5(t) AS digest FROM {last}"


_poisson, _upto, _term = [], 0.0, 2.718281828459045**-1
for _k in range(1, 9):
    _upto, _term = _upto + _term, _term / _k
    _poisson.append(f"CASE WHEN u >= {_upto!r}::DOUBLE THEN 1 ELSE 0 END")
_redacted = "text"
for _n, _p, _label, _r in privacy.CATALOG:
    _redacted = f"regexp_replace({_redacted}, {_lit(privacy.FLAGS + _p)}, '[{_label}]', 'g')"

ORACLE_SQL = {
    "model_compare": f"WITH {_R} SELECT model, count(*) AS n, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS std, quantile_cont(rating, 0.5) AS median FROM r GROUP BY model",
    "annotator_stats": f"WITH {_R} SELECT rater, count(*) AS n, round(avg(minutes), 6) AS minutes, round(avg(rating), 6) AS mean, round((SELECT stddev_pop(x) FROM (SELECT DISTINCT rating AS x FROM r q WHERE q.rater = r.rater)), 6) AS rating_std FROM r GROUP BY rater",
    "preference_agreement": f"WITH {_R}, s AS (SELECT count(DISTINCT model) AS kinds FROM r GROUP BY sample HAVING count(*) > 1) SELECT count(*) AS samples, round(avg(CASE WHEN kinds = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS unanimous FROM s",
    "metric_overall": "WITH m AS (SELECT l_returnflag, 'quantity' AS metric, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem) SELECT l_returnflag, metric, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high FROM m GROUP BY GROUPING SETS ((metric), (l_returnflag, metric))",
    "success_criteria": "WITH m AS (SELECT event_type, CASE WHEN event_type = 'error' THEN avg(value) < 60 ELSE avg(value) > 40 END AS met FROM events GROUP BY event_type) SELECT event_type, met FROM m UNION ALL SELECT 'overall', bool_and(met) FROM m",
    "best_model": f"WITH {_R}, m AS (SELECT l_linestatus, model, round(avg(l_quantity), 9) AS mean FROM r GROUP BY ALL) SELECT l_linestatus, model, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY mean DESC, model) AS pos FROM m) WHERE pos = 1",
    "sample_efficiency": f"""WITH p AS (SELECT pct, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders, (VALUES (10), (25), (50), (100)) t(pct) WHERE {_share('o_orderkey')} * 100 < pct GROUP BY pct)
      SELECT pct, round(f, 6) AS "F", round(o, 6) AS "O", round(o - f, 6) AS gain, round((o - f) / f, 6) AS relative FROM p""",
    "cluster_patterns": "WITH n AS (SELECT p_size, p_type, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_type) AS pos FROM part GROUP BY p_size, p_type), t AS (SELECT p_size, string_agg(p_type, ',' ORDER BY pos) AS types FROM n WHERE pos <= 2 GROUP BY p_size) SELECT p_size, count(*) AS n, round(avg(p_retailprice), 6) AS mean, any_value(types) AS types FROM part JOIN t USING (p_size) GROUP BY p_size",
    "trajectory_stages": "WITH s AS (SELECT user_id, (event_id // 100) % 3 AS stage, count(*) AS length, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL) SELECT stage, count(*) AS n, round(avg(length), 6) AS length, round(avg(kinds / length), 6) AS efficiency, sum(errors)::BIGINT AS errors FROM s GROUP BY stage",
    "batch_summary": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "audit_stats": "WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result FROM events) SELECT event_type, result, count(*) AS n, max(event_id) AS last FROM e GROUP BY GROUPING SETS ((event_type), (result), ())",
    "redaction_stats": " UNION ALL ".join(f"SELECT '{n}' AS category, sum(c)::BIGINT AS n, count(*) FILTER (WHERE c > 0) AS documents FROM (SELECT {_count('text', p)} AS c FROM documents)" for n, p, *_ in privacy.CATALOG),
    "distribution_validation": "WITH g AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang) SELECT lang, n, sources, round(n / (SELECT sum(n) FROM g), 6) AS share, n / (SELECT sum(n) FROM g) >= 0.25 AND sources >= 3 AS valid FROM g",
    "annotation_progress": "WITH a AS (SELECT count(*) AS n FROM orders) SELECT l_suppkey, count(DISTINCT l_orderkey) AS done, round(100 * count(DISTINCT l_orderkey) / any_value(n), 6) AS percent, round(avg(l_quantity) * (any_value(n) - count(DISTINCT l_orderkey)), 6) AS left FROM lineitem, a GROUP BY l_suppkey",
    "cache_stats": "SELECT count(*) AS entries, sum(c)::BIGINT AS accesses, sum(c - 1)::BIGINT AS hits, round(avg(c), 6) AS mean FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type)",
    "voting_consistency": "WITH e AS (SELECT user_id, (props->>'$.k')::DOUBLE / 100 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), s AS (SELECT user_id, avg(c) AS mean, stddev_pop(c) AS std, regr_slope(c, pos) AS slope, avg(CASE WHEN c < 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS low FROM e GROUP BY user_id) SELECT user_id, round(mean, 6) AS mean, round(std, 6) AS std, round(slope, 6) + 0.0 AS slope, round(low, 6) AS low, CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'improving' ELSE 'declining' END AS trend, low > 0.3::DOUBLE AS warn FROM s",
    "vote_distribution": "WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(votes) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, l_returnflag) AS pos FROM v) SELECT l_orderkey, l_returnflag, votes, round(votes / total, 6) AS consensus FROM w WHERE pos = 1",
    "buffer_stats": "SELECT least(count(*), 1000) AS size, round(avg(value), 6) AS priority, count(DISTINCT user_id) AS users, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END), 6) AS success, round(least(count(*), 1000) / 1000, 6) AS utilisation FROM events",
    "update_stats": "SELECT event_type, count(*) FILTER (WHERE value <= 100) AS applied, count(*) FILTER (WHERE value > 100) AS blocked, round(avg(value), 6) AS mean, max(event_id) AS version FROM events GROUP BY event_type",
    "throughput": "SELECT ts::DATE AS day, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) * 1000, 6) AS per_1000_s FROM events GROUP BY day HAVING max(ts) > min(ts)",
    "bootstrap_ci": f"""WITH w AS (SELECT c_mktsegment, c_acctbal, draw, ('0x' || substr(md5('7:' || draw || ':' || c_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM customer, range(50) t(draw)), x AS (SELECT c_mktsegment, draw, c_acctbal, {' + '.join(_poisson)} AS k FROM w),
      m AS (SELECT c_mktsegment, draw, sum(k * c_acctbal) / nullif(sum(k), 0) AS m FROM x GROUP BY ALL), e AS (SELECT c_mktsegment, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg(CASE WHEN m <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS below FROM m GROUP BY ALL)
      SELECT c.c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, round(2 * least(any_value(below), 1 - any_value(below)), 6) AS p FROM customer c JOIN e ON c.c_mktsegment = e.c_mktsegment GROUP BY c.c_mktsegment""",
    "pii_redact_hashed": _hashed(),
    "anonymise_verify": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_redacted} ELSE text END AS text FROM documents), f AS (SELECT doc_id, {' + '.join(_count('text', p) for n, p, *_ in privacy.CATALOG if n not in ('phone', 'bank_account'))} AS c FROM t)
      SELECT issue, count(*) AS n FROM (SELECT 'personal data in text' AS issue FROM f WHERE c > 0 UNION ALL SELECT 'forbidden field' FROM f WHERE doc_id % 5 = 0 UNION ALL SELECT 'not marked' FROM f WHERE doc_id % 3 <> 0) GROUP BY issue""",
    "uniform_sample": f"SELECT o_orderkey FROM orders ORDER BY {_place('o_orderkey')}, o_orderkey LIMIT 100",
    "subset_series": f"SELECT p::INTEGER AS percent, count(*) AS n FROM orders, (VALUES (10), (25), (50)) t(p) WHERE {_share('o_orderkey')} < p / 100.0::DOUBLE GROUP BY p",
    "curriculum_mixture": f"""WITH d AS (SELECT draw, CASE WHEN {_u('stratum')} < 0.5::DOUBLE THEN 'F' WHEN {_u('stratum')} < 0.8::DOUBLE THEN 'O' ELSE 'P' END AS o_orderstatus, {_u('row')} AS u FROM range(200) t(draw)),
      r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_place('o_orderkey')}, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
      SELECT draw, d.o_orderstatus, o_orderkey FROM d JOIN r ON d.o_orderstatus = r.o_orderstatus AND r.pos = floor(u * n)""",
    "active_curriculum": f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_place('o_orderkey')}, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE pos <= floor(n * CASE o_orderstatus WHEN 'F' THEN 0.5::DOUBLE WHEN 'O' THEN 0.1::DOUBLE ELSE 0 END)",
    "ratio_sample": f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_place('doc_id')}, doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')) WHERE pos <= floor(n * 0.2::DOUBLE)",
    "priority_success_sample": f"WITH e AS (SELECT event_id, value * CASE WHEN event_type = 'purchase' THEN 0.7::DOUBLE + 0.3::DOUBLE * 0.9::DOUBLE ELSE 1 END AS w FROM events) SELECT event_id FROM e ORDER BY CASE WHEN w > 0 THEN ln(greatest({_share('event_id')}, 1e-12)) / w ELSE '-infinity'::DOUBLE END DESC, event_id LIMIT 50",
    "priority_batches": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) - 1) // 8 AS batch FROM orders WHERE o_orderstatus = 'P'",
    "recent_alerts": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10",
    "audit_search": "SELECT event_id FROM events WHERE event_type = 'click' AND contains(props, '7') ORDER BY ts, event_id LIMIT 1000",
}
