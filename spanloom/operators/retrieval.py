"""Nearest neighbours of a stated query set among all rows, and votes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

BLOCK = 2048


def _blocks(df: DataFrame, key: str, vector: str, name: str, size: int) -> DataFrame:
    """Rows packed ``size`` to a row, as arrays, within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                ids, vectors = batch.slice(lo, size).columns
                x = np.array(vectors.to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], names=[f"{name}_ids", f"{name}_raw", f"{name}_dim"])

    return df.select(F.col(key).cast("long"), vector).filter(F.col(vector).isNotNull()).mapInArrow(run, f"{name}_ids array<long>, {name}_raw binary, {name}_dim int")


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``query_id, neighbor_id, score, rank``: the ``k`` nearest other rows of each query.

    Both sides are packed into blocks; each pair of blocks is one matrix product whose best ``k`` per
    query go on, so the rows that meet in the final ranking are ``k`` per query and block.  Ties go to
    the smaller id.  ``score`` is the cosine, or the negative Euclidean distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["q_raw"]).reshape(-1, r["q_dim"])
                x = np.frombuffer(r["r_raw"]).reshape(-1, r["r_dim"])
                if metric == "cosine":
                    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                    score = unit(q) @ unit(x).T
                else:
                    score = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T, 0))
                qi, ri = np.array(r["q_ids"]), np.array(r["r_ids"])
                score = np.where(qi[:, None] == ri, -np.inf, score)
                order = np.lexsort((np.broadcast_to(ri, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                keep = np.take_along_axis(score, order, axis=1)
                fine = np.isfinite(keep)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qi[:, None], keep.shape)[fine]), pa.array(ri[order][fine]), pa.array(keep[fine])], names=["query_id", "neighbor_id", "score"])

    met = _blocks(rows, key, vector, "r", BLOCK).crossJoin(_blocks(queries, key, vector, "q", BLOCK // 4))
    best = met.mapInArrow(run, "query_id long, neighbor_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(F.col("score"), 9).desc(), "neighbor_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def vote(votes: DataFrame, group: str, answer: str, weight: str | None = None, order: str = "rank") -> DataFrame:
    """``group, answer, confidence, n_votes``: the answer with most votes, or with the most weight.

    Weighted confidences are shares of weight times the agreement factor.  The first seen wins a tie.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sums = votes.groupBy(group, answer).agg(F.sum(w).alias("w"), F.count("*").alias("n"), F.min(order).alias("first"))
    all_ = Window.partitionBy(group)
    shares = sums.withColumn("share", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(all_)), F.lit(0.0))).withColumn("ratio", F.col("n") / F.sum("n").over(all_)).withColumn("n_votes", F.sum("n").over(all_))
    top = shares.withColumn("at", F.row_number().over(all_.orderBy(F.round("share", 9).desc(), "first"))).filter("at = 1")
    confidence = F.col("share") * scalar.agreement_factor(F.col("ratio")) if weight else F.col("share")
    return top.select(group, answer, confidence.alias("confidence"), "n_votes")


def confident_vote(votes: DataFrame, group: str, answer: str, weight: str, confidence: str, least: float, order: str = "rank") -> DataFrame:
    """A weighted vote of the confident ones; without any, the most confident vote at half its confidence."""
    some = votes.filter(F.col(confidence) >= least).withColumn("__w", F.col(weight) * F.col(confidence))
    voted = vote(some, group, answer, "__w", order).select(group, answer, "confidence")
    best = Window.partitionBy(group).orderBy(F.col(confidence).desc(), order)
    rest = votes.join(voted.select(group), group, "left_anti").withColumn("at", F.row_number().over(best)).filter("at = 1")
    return voted.unionByName(rest.select(group, answer, (F.col(confidence) * 0.5).alias("confidence")))


def ensemble_vote(votes: DataFrame, group: str, answer: str, weight: str, confidence: str, least: float, order: str = "rank") -> DataFrame:
    """Three votes together: summed confidence over three; unanimous answers gain a fifth, up to 1."""
    one = vote(votes, group, answer, None, order).select(group, answer, "confidence")
    two = vote(votes, group, answer, weight, order).select(group, answer, "confidence")
    both = one.unionByName(two).unionByName(confident_vote(votes, group, answer, weight, confidence, least, order))
    sums = both.groupBy(group, answer).agg((F.sum("confidence") / 3).alias("c"), F.count("*").alias("n"))
    value = F.when(F.col("n") == 3, F.least(F.col("c") * 1.2, F.lit(1.0))).otherwise(F.col("c"))
    top = Window.partitionBy(group).orderBy(F.round("c", 9).desc(), answer)
    return sums.withColumn("at", F.row_number().over(top)).filter("at = 1").select(group, answer, value.alias("confidence"))


def centroids(df: DataFrame, label: str, vector: str, key: str, k: int = 3) -> DataFrame:
    """``label, n, representatives``: the rows nearest each label's mean vector (Euclidean)."""
    flat = df.select(label, F.posexplode(vector).alias("at", "x"))
    means = flat.groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    center = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s.m).alias("center"))
    gap = F.aggregate(F.zip_with(vector, "center", lambda x, m: F.pow(x.cast("double") - m, 2.0)), F.lit(0.0), lambda a, x: a + x)
    near = Window.partitionBy(label).orderBy(F.round(gap, 9), key)
    ranked = df.join(center, label).select(label, key, F.row_number().over(near).alias("at"))
    reps = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= k, F.struct("at", key)))), lambda s: s[key])
    return ranked.groupBy(label).agg(F.count("*").alias("n"), reps.alias("representatives"))
