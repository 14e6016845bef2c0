"""URL filters: allow and block rules, and link-graph propagation for what no rule decides.

A rule is a host and a path prefix, as in ``example.com/en/7``; it fits the host and its subdomains
where the path starts with the rule's, and the longest rule that fits wins (of equally long ones the
first by code point).  Pages without a rule get their host's verdict: trust is a personalised PageRank
from hosts with allowed pages along host links, distrust the same from hosts with blocked pages along the
reversed links, and a host is blocked if its distrust is above ``ratio`` times its trust.

Links are the absolute ``href`` targets in pages, and between a host and the host above it (one label
less, two labels at least) in both directions, each pair of hosts once.  Mass is counted in whole units,
``UNITS`` for each kind of seed, so sums don't depend on the order of rows and reruns agree to the unit.
Rounds go on until trust and distrust together change by ``TOLERANCE`` at most (a millionth, summed
over hosts; tested after every ``ROUNDS`` rounds), so what is still to come is below six times that.

Hosts are kept in tables dealt by host; the joins are equi-joins that Spark may split where a host is
hot, contributions are summed map-side, and nothing but a sum of changes per test reaches the driver.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed unless other empty hosts are distrusted (they never are); null pages have no links; repeated
rows are judged alike and their links count once; without seeds of a kind its scores are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table

DAMPING = 85
UNITS = 10**18
TOLERANCE = UNITS // 10**6
ROUNDS = 4
HREF = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """The lower-cased host of a url, and its path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        site, slash, prefix = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Distinct ``src, dst`` between different hosts, by links and by site."""
    found = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(HREF), 1)).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    links = found.filter("src != dst AND src != '' AND dst != ''").distinct()
    hosts = pages.select(F.col(host).alias("h")).union(links.select("dst")).distinct()
    labels = F.split("h", r"\.")
    # Every host above, so that sites hang together where no page is on the host between.
    chain = F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.struct(F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, i + 2, F.size(labels)), ".").alias("b")))
    up = hosts.filter(F.size(labels) > 2).select(F.explode(chain).alias("l")).select(F.col("l.a").alias("src"), F.col("l.b").alias("dst")).distinct()
    return links.union(up).union(up.select("dst", "src")).distinct()


def propagate(links: DataFrame, seeds: DataFrame, tolerance: int = TOLERANCE, damping: int = DAMPING) -> DataFrame:
    """``host, trust, distrust`` in units of 1 / ``UNITS``, of hosts that either reaches.

    ``seeds`` has ``host, good, bad``, numbers of allowed and blocked pages.  Rounds end when trust and
    distrust together change by ``tolerance`` at most, summed over hosts.
    """
    both = links.select(F.lit(True).alias("good"), "src", "dst").union(links.select(F.lit(False), "dst", "src"))
    degrees = both.groupBy("good", "src").agg(F.count("*").alias("degree"))
    edges = table(both.join(degrees, ["good", "src"]), "host-links")
    long = seeds.select(F.lit(True).alias("good"), "host", F.col("good").alias("n")).union(seeds.select(F.lit(False), "host", F.col("bad"))).filter("n > 0")
    totals = long.groupBy("good").agg(F.sum("n").alias("total"))
    start = table(long.join(F.broadcast(totals), "good").select("good", "host", F.expr(f"cast({UNITS} AS decimal(19)) * cast(n AS decimal(19)) div cast(total AS decimal(19))").alias("mass")), "seeds")  # two totals
    state = start
    back = start.select("good", "host", F.expr(f"mass div 100 * {100 - damping} + mass % 100 * {100 - damping} div 100").alias("mass"))
    change = None
    while change is None or change > tolerance:
        for _ in range(ROUNDS):
            last = state
            # Quotient and remainder apart, so that no product leaves 64 bits.
            sent = state.withColumnRenamed("host", "src").join(edges, ["good", "src"]).select("good", F.col("dst").alias("host"), F.expr(f"mass div (100 * degree) * {damping} + mass % (100 * degree) * {damping} div (100 * degree)").alias("mass"))
            state = sent.union(back).groupBy("good", "host").agg(F.sum("mass").alias("mass"))
        moved = state.withColumn("before", F.lit(0).cast("long")).union(last.select("good", "host", F.lit(0).cast("long"), "mass")).groupBy("good", "host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before"))
        moved = table(moved, "ranks")
        change = moved.agg(F.sum(F.abs(F.col("mass") - F.col("before")))).first()[0] or 0
        state = moved.select("good", "host", "mass").filter("mass > 0")
    return table(state.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("good"), F.col("mass"))), F.lit(0)).alias("trust"), F.coalesce(F.sum(F.when(~F.col("good"), F.col("mass"))), F.lit(0)).alias("distrust")), "trust")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str]] = RULES, ratio: float = 1.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page."""
    host, path = host_and_path(url)
    cut = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("__html"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumn("rule", rule).withColumn("__verdict", verdict)
    seeds = ruled.groupBy("host").agg(F.count(F.when(F.col("__verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("__verdict") == "block", 1)).alias("bad"))
    scores = propagate(host_links(cut, "host", "__html"), seeds)
    scored = ruled.drop("__html").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    own = F.when(distrust > trust * F.lit(ratio), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def sql(rules: Sequence[tuple[str, str]] = RULES, tolerance: int = TOLERANCE, damping: int = DAMPING, most: int = 40 * ROUNDS) -> str:
    """The same for DuckDB over ``pages``, with ratio 1: of ``most`` rounds the first tested one within the tolerance."""
    rule, verdict = "NULL", "NULL"
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        site, slash, prefix = text.partition("/")
        fits = f"(host = '{site}' OR suffix(host, '.{site}')) AND starts_with(path, '{slash}{prefix}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    href = HREF.replace("'", "''")
    parts = [
        "rests AS (SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"cut AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)",
        f"ruled AS (SELECT *, {rule} AS rule, {verdict} AS own FROM cut)",
        f"found AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM cut) WHERE src <> dst AND src <> '' AND dst <> '')",
        "hosts AS (SELECT host AS h FROM cut UNION SELECT dst FROM found)",
        "up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(h, '.') AS l FROM hosts) WHERE len(l) > 2))",
        "links AS (SELECT src, dst FROM found UNION SELECT src, dst FROM up UNION SELECT dst, src FROM up)",
        "both_ways AS (SELECT true AS good, src, dst FROM links UNION ALL SELECT false, dst, src FROM links)",
        "edges AS (SELECT *, count(*) OVER (PARTITION BY good, src) AS degree FROM both_ways)",
        "seeds AS (SELECT own = 'allow' AS good, host, count(*) AS n FROM ruled WHERE own IS NOT NULL GROUP BY ALL)",
        f"s0 AS (SELECT good, host, ({UNITS}::HUGEINT * n // sum(n) OVER (PARTITION BY good))::BIGINT AS mass FROM seeds)",
        f"""steps(step, good, host, mass) AS (
  SELECT 0, good, host, mass FROM s0
  UNION ALL
  SELECT step + 1, good, host, sum(mass)::BIGINT FROM (
    SELECT step, s.good, e.dst AS host, s.mass // (100 * e.degree) * {damping} + s.mass % (100 * e.degree) * {damping} // (100 * e.degree) AS mass FROM steps s JOIN edges e ON s.good = e.good AND s.host = e.src
    UNION ALL SELECT k.step, s0.good, s0.host, s0.mass // 100 * {100 - damping} + s0.mass % 100 * {100 - damping} // 100 FROM s0, (SELECT DISTINCT step FROM steps) k
  ) WHERE step < {most} GROUP BY ALL
)""",
        f"""changes AS (
  SELECT step, sum(abs(mass)) AS change FROM (
    SELECT step, good, host, sum(mass) AS mass FROM (SELECT step, good, host, mass FROM steps UNION ALL SELECT step + 1, good, host, -mass FROM steps) GROUP BY ALL
  ) GROUP BY step
)""",
        f"final AS (SELECT coalesce(min(step), 0) AS step FROM changes WHERE step > 0 AND step % {ROUNDS} = 0 AND step <= {most} AND change <= {tolerance})",
        "scores AS (SELECT host, coalesce(sum(mass) FILTER (WHERE good), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (WHERE NOT good), 0)::BIGINT AS distrust FROM steps JOIN final USING (step) GROUP BY host)",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT page_id, r.host, path, rule, coalesce(own, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust FROM ruled r LEFT JOIN scores s ON r.host = s.host"
