"""Agreement, tests and design statistics, as sums that partial aggregation combines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions


def profile(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, deviation, range and linear percentiles."""
    p = F.percentile(value, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), p.alias("p"))
    return out.select(*by, "n", "mean", "std", "min", "max", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((50, 90, 95, 99))])


def with_totals(parts: DataFrame, by: str, part: str) -> DataFrame:
    """``parts`` (``n, mean, std, low, high``, the sum ``s`` and number ``k`` of values that aren't null) and, with a null ``part``, the same of each ``by``."""
    k = F.sum("k")
    means = parts.groupBy(by).agg(F.try_divide(F.sum("s"), k).alias("__mean")).withColumnRenamed(by, "__by")
    apart = F.col("mean") - F.col("__mean")
    spread = F.sum(F.col("k") * (F.col("std") * F.col("std") + apart * apart))
    totals = parts.join(means, F.col(by).eqNullSafe(F.col("__by"))).groupBy(by).agg(
        F.lit(None).cast(parts.schema[part].dataType).alias(part), F.sum("n").alias("n"), F.first("__mean").alias("mean"), F.sqrt(F.try_divide(spread, k)).alias("std"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), k.alias("k"),
    )
    return parts.unionByName(totals)


def fleiss_kappa(df: DataFrame, item: str, category: str) -> DataFrame:
    """Fleiss' kappa; 1 where chance agreement is full.

    Items may have different numbers of ratings: agreement is the mean over items with two at least,
    chance the squared shares of categories over all ratings.
    """
    counts = df.groupBy(item, category).count()
    per_item = counts.groupBy(item).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("sq"))
    observed = per_item.filter("n > 1").agg(F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("observed"))
    shares = counts.groupBy(category).agg(F.sum("count").alias("c")).agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("chance"))
    kappa = F.when(F.col("chance") == 1, 1.0).otherwise((F.col("observed") - F.col("chance")) / (1 - F.col("chance")))
    return observed.crossJoin(shares).select("observed", "chance", kappa.alias("kappa"))  # one row each


def icc(df: DataFrame, item: str, rating: str) -> DataFrame:
    """One-way random intraclass correlation of single ratings, for any numbers of ratings per item; null ratings don't count.

    For unequal numbers the group size is ``k0 = (N - sum(k^2) / N) / (n - 1)``, which is ``k`` for equal ones.
    """
    k = F.col("k").cast("double")
    per_item = df.groupBy(item).agg(F.avg(rating).alias("m"), F.count(rating).alias("k"), F.var_pop(rating).alias("v")).filter("k > 0")
    s = per_item.agg(F.count("*").alias("n"), F.sum(k).alias("all"), F.sum(k * k).alias("kk"), F.sum(k * F.col("m")).alias("km"), F.sum(k * F.col("m") * F.col("m")).alias("kmm"), F.sum(k * F.col("v")).alias("within"))
    msb = F.try_divide(F.col("kmm") - F.col("km") * F.col("km") / F.col("all"), F.col("n") - 1)
    msw = F.try_divide("within", F.col("all") - F.col("n"))
    k0 = F.try_divide(F.col("all") - F.col("kk") / F.col("all"), F.col("n") - 1)
    return s.select("n", msb.alias("msb"), msw.alias("msw"), F.try_divide(msb - msw, msb + (k0 - 1) * msw).alias("icc"))


def weighted_kappa(df: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Cohen's kappa of two raters with linear weights over ``levels`` ordered ratings."""
    gap = lambda x, y: F.abs(x - y) / (levels - 1)
    n = df.agg(F.count("*").alias("n"), F.avg(gap(F.col(a), F.col(b))).alias("seen"))
    pa, pb = df.groupBy(F.col(a).alias("x")).agg(F.count("*").alias("ca")), df.groupBy(F.col(b).alias("y")).agg(F.count("*").alias("cb"))
    expected = pa.crossJoin(pb).agg(F.sum(gap(F.col("x"), F.col("y")) * F.col("ca") * F.col("cb")).alias("e"))  # one row per level and side
    share = F.col("e") / (F.col("n") * F.col("n"))
    return n.crossJoin(expected).select("n", F.when(share == 0, 1.0).otherwise(1 - F.col("seen") / share).alias("kappa"))


def paired_t(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Paired t statistic and Cohen's d of differences."""
    d = F.col(a) - F.col(b)
    s = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.stddev_pop(d).alias("p"))
    return s.select(*by, "n", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")).alias("t"), F.try_divide("m", F.nullif("p", F.lit(0.0))).alias("d"))


def signed_rank(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Wilcoxon's signed-rank statistic, with mean ranks for ties and zeros left out, and the rank-biserial effect."""
    d = df.withColumn("__d", F.col(a) - F.col(b)).filter("__d != 0").withColumn("__abs", F.abs("__d"))
    tie = Window.partitionBy(*by, "__abs")
    ranked = d.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy("__abs")) + (F.count("*").over(tie) - 1) / 2)
    s = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__rank"))), F.lit(0.0)).alias("up"), F.sum("__rank").alias("all"))
    w = F.least("up", F.col("all") - F.col("up"))
    return s.select(*by, "n", w.alias("w"), (1 - 2 * w / F.col("all")).alias("effect"))


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over runs, 0 for one run."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def interaction(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Variance of cell means that neither row means nor column means explain."""
    cells = df.groupBy(row, column).agg(F.avg(value).alias("m"))
    total = cells.agg(F.var_pop("m").alias("total"))
    rows = cells.groupBy(row).agg(F.avg("m").alias("m")).agg(F.var_pop("m").alias("rows"))
    columns = cells.groupBy(column).agg(F.avg("m").alias("m")).agg(F.var_pop("m").alias("columns"))
    return total.crossJoin(rows).crossJoin(columns).select("*", F.greatest(F.col("total") - F.col("rows") - F.col("columns"), F.lit(0.0)).alias("interaction"))  # one row each


def frontier(df: DataFrame, best: list[str]) -> DataFrame:
    """The rows that no other row beats: at least as large in all of ``best``, larger in one.

    Equal points stand and fall together, so they meet as one; within a point of the first two columns
    only the largest third can stay, which prunes before the theta join.
    """
    points = df.select(*best).distinct()
    lead = Window.partitionBy(*best[:-1])
    slim = points.withColumn("__top", F.max(best[-1]).over(lead)).filter(F.col(best[-1]) == F.col("__top")).drop("__top")
    other = slim.select(*[F.col(c).alias(f"__{c}") for c in best])
    beats = None
    larger = None
    for c in best:
        ge, gt = F.col(f"__{c}") >= F.col(c), F.col(f"__{c}") > F.col(c)
        beats, larger = ge if beats is None else beats & ge, gt if larger is None else larger | gt
    top = slim.join(other, beats & larger, "left_anti")
    return df.join(top, best, "left_semi")


def forgetting(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Loss from the first value to the last as a share of the first, and what is kept."""
    pick = F.struct(*order, value)
    s = df.groupBy(key).agg(F.min(pick)[value].alias("first"), F.max(pick)[value].alias("last"))
    kept = F.try_divide("last", F.nullif("first", F.lit(0.0)))
    return s.select(key, F.greatest(1 - kept, F.lit(0.0)).alias("forgetting"), kept.alias("retention"))


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares over every one of ``by`` apart: ``dimension, value, n, share``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by])).alias("s")).select("s.*")
    n = long.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def upper_median(value: str, n: Column, at: Column) -> Column:
    """The upper of two middle values, by a row number from 1."""
    return F.max(F.when(at == F.floor(n / 2) + 1, F.col(value)))


def t_summary(df: DataFrame, by: list[str], value: str, p: float = 0.95) -> DataFrame:
    """``n, mean, std, low, high``: a Student interval of the mean of each group; null bounds for one value."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    half = distributions.t_interval(p, F.col("n") - 1) * F.col("std") / F.sqrt("n")
    return s.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def pooled_t(df: DataFrame, side: str, a, b, value: str, by: list[str], tests: int = 1) -> DataFrame:
    """``t, df, d``, ``p`` and the Bonferroni-corrected ``p_corrected`` (at most 1) of two samples with pooled variance."""
    x, y = F.when(F.col(side) == F.lit(a), F.col(value)), F.when(F.col(side) == F.lit(b), F.col(value))
    s = df.groupBy(*by).agg(*[f(c).alias(n) for c, k in ((x, "a"), (y, "b")) for f, n in ((F.count, f"n_{k}"), (F.avg, f"m_{k}"), (F.var_samp, f"v_{k}"))])
    free = F.col("n_a") + F.col("n_b") - 2
    pooled = F.try_divide((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"), free)
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))))
    out = s.select(*by, t.alias("t"), free.alias("df"), F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(pooled)).alias("d"))
    return out.withColumn("p", distributions.t_p(F.col("t"), F.col("df"))).withColumn("p_corrected", F.least(F.col("p") * tests, F.lit(1.0)))


def signed_rank_p(ranks: DataFrame) -> DataFrame:
    """``z`` and ``p`` of Wilcoxon's statistic by the normal approximation, for results of :func:`signed_rank`."""
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return ranks.withColumn("z", z).withColumn("p", distributions.normal_p(F.col("z")))


def icc_interval(found: DataFrame, ratings: DataFrame, item: str, p: float = 0.95) -> DataFrame:
    """``low, high`` of an intraclass correlation, by F quantiles of its mean squares."""
    n = ratings.groupBy(item).agg(F.count("*").alias("k")).agg(F.count("*").alias("items"), F.sum("k").alias("all"))
    both = found.crossJoin(n)  # one row each
    d1, d2, k = F.col("items") - 1, F.col("all") - F.col("items"), F.col("all") / F.col("items")
    f = F.col("msb") / F.col("msw")
    low, high = f / distributions.f_interval((1 + p) / 2, d1, d2), f * distributions.f_interval((1 + p) / 2, d2, d1)
    return both.select(*found.columns, ((low - 1) / (low + k - 1)).alias("low"), ((high - 1) / (high + k - 1)).alias("high"))


def bootstrap(df: DataFrame, by: list[str], key: str, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """``n, mean, low, high, p``: a Poisson bootstrap of each group's mean.

    Every row weighs a Poisson(1) number, fixed by key, draw and seed, in every draw; so draws are sums that
    combine map-side, and no task holds a group.  ``p`` is twice the smaller share of draws on one side of 0.
    """
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__draw").cast("string"), F.lit(":"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    upto, term, weight = 0.0, 2.718281828459045**-1, F.lit(0)
    for k in range(1, 9):
        upto, term = upto + term, term / k
        weight = weight + F.when(u >= upto, 1).otherwise(0)
    drawn = df.select(*by, key, value).withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__w", weight)
    means = drawn.groupBy(*by, "__draw").agg(F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("__m"))
    ends = means.groupBy(*by).agg(F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("__m") <= 0).cast("double")).alias("below"))
    whole = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return whole.join(ends, by).select(*by, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (2 * F.least(F.col("below"), 1 - F.col("below"))).alias("p"))
