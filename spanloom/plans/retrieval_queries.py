"""Neighbours and votes on ``embeddings``: queries are the rows whose id divides by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import retrieval
from .tables import read

K = 5


def _near(spark: SparkSession, d: str, metric: str = "cosine") -> DataFrame:
    e = read(spark, d, "embeddings")
    return retrieval.nearest(e.filter("vec_id % 20 = 0"), e, K, metric=metric)


def _votes(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("neighbor_id"), "label")
    near = _near(spark, d).join(labels, "neighbor_id")
    return near.withColumn("weight", F.greatest("score", F.lit(0.0))).withColumn("confidence", 1 / (F.col("rank") + 1.0))


def knn_topk_cosine(spark, d):
    """The five nearest by cosine."""
    return _near(spark, d).select("query_id", "neighbor_id", F.round("score", 6).alias("score"), "rank")


def knn_topk_l2(spark, d):
    """The five nearest by Euclidean distance."""
    return _near(spark, d, "l2").select("query_id", "neighbor_id", F.round(-F.col("score"), 6).alias("distance"), "rank")


def knn_vote_weighted(spark, d):
    """The label with most similarity among the neighbours."""
    return retrieval.vote(_votes(spark, d), "query_id", "label", "weight").select("query_id", "label", F.round("confidence", 6).alias("confidence"))


def knn_vote_majority(spark, d):
    """The most frequent label among the neighbours."""
    return retrieval.vote(_votes(spark, d), "query_id", "label").select("query_id", "label", F.round("confidence", 6).alias("confidence"))


def knn_vote_confidence(spark, d):
    """The weighted label of confident neighbours, or the most confident one's."""
    return retrieval.confident_vote(_votes(spark, d), "query_id", "label", "weight", "confidence", 0.3).select("query_id", "label", F.round("confidence", 6).alias("confidence"))


def knn_vote_ensemble(spark, d):
    """The label of three votes together."""
    return retrieval.ensemble_vote(_votes(spark, d), "query_id", "label", "weight", "confidence", 0.3).select("query_id", "label", F.round("confidence", 6).alias("confidence"))


def centroid_representatives(spark, d):
    """The three vectors nearest each label's mean."""
    return retrieval.centroids(read(spark, d, "embeddings"), "label", "embedding", "vec_id")


def hybrid_embedding(spark, d):
    """Each vector mixed with the next one's, by its cosine with itself."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("text"))
    mixed = F.coalesce(F.zip_with("embedding", "text", lambda v, t: 0.7 * v.cast("double") + 0.3 * t.cast("double")), F.col("embedding").cast("array<double>"))
    return e.join(other, "vec_id", "left").select("vec_id", F.round(scalar.cosine(mixed, F.col("embedding")), 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (knn_topk_cosine, knn_topk_l2, knn_vote_weighted, knn_vote_majority, knn_vote_confidence, knn_vote_ensemble, centroid_representatives, hybrid_embedding)}

_NEAR = """near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, neighbor_id) AS rank FROM (
    SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, r.label, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score
    FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)) WHERE rank <= 5)"""
_VOTES = _NEAR + ", votes AS (SELECT *, greatest(score, 0) AS weight, 1 / (rank + 1.0::DOUBLE) AS confidence FROM near)"
_FACTOR = "least(greatest(CASE WHEN r > 0.7 THEN 0.8 + 0.2 * (r - 0.7) / 0.3 WHEN r < 0.3 THEN 0.6 + 0.2 * r / 0.3 ELSE 0.6 + 0.2 * (r - 0.3) / 0.4 END, 0.5), 1.0)"


def _vote(name: str, source: str, weight: str) -> str:
    value = f"share * {_FACTOR}" if weight != "1.0" else "share"
    return f"""{name} AS (SELECT query_id, label, {value} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(share, 9) DESC, f) AS pos FROM (
    SELECT query_id, label, f, coalesce(w / nullif(sum(w) OVER (PARTITION BY query_id), 0), 0) AS share, n / (sum(n) OVER (PARTITION BY query_id))::DOUBLE AS r FROM (
      SELECT query_id, label, sum({weight})::DOUBLE AS w, count(*) AS n, min(rank) AS f FROM {source} GROUP BY query_id, label))) WHERE pos = 1)"""


_CONFIDENT = f"""few AS (SELECT *, weight * confidence AS cw FROM votes WHERE confidence >= 0.3), {_vote('sure', 'few', 'cw')},
confident AS (SELECT * FROM sure UNION ALL SELECT query_id, label, confidence * 0.5 FROM votes WHERE rank = 1 AND query_id NOT IN (SELECT query_id FROM sure))"""
_OUT = "SELECT query_id, label, round(confidence, 6) AS confidence FROM "

ORACLE_SQL = {
    "knn_topk_cosine": f"WITH {_NEAR} SELECT query_id, neighbor_id, round(score, 6) AS score, rank::INT AS rank FROM near",
    "knn_topk_l2": """SELECT query_id, neighbor_id, round(gap, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(gap, 9), neighbor_id) AS rank FROM (
      SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS gap
      FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)) WHERE rank <= 5""",
    "knn_vote_weighted": f"WITH {_VOTES}, {_vote('v', 'votes', 'weight')} {_OUT} v",
    "knn_vote_majority": f"WITH {_VOTES}, {_vote('v', 'votes', '1.0')} {_OUT} v",
    "knn_vote_confidence": f"WITH {_VOTES}, {_CONFIDENT} {_OUT} confident",
    "knn_vote_ensemble": f"""WITH {_VOTES}, {_vote('one', 'votes', '1.0')}, {_vote('two', 'votes', 'weight')}, {_CONFIDENT},
      sums AS (SELECT query_id, label, sum(confidence) / 3 AS c, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM confident) GROUP BY ALL)
      SELECT query_id, label, round(CASE WHEN n = 3 THEN least(c * 1.2, 1.0) ELSE c END, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, label) AS pos FROM sums) WHERE pos = 1""",
    "centroid_representatives": """WITH means AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL),
      centers AS (SELECT label, list(m ORDER BY pos) AS center FROM means GROUP BY label),
      ranked AS (SELECT e.label, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_distance(embedding::DOUBLE[], center) ** 2, 9), vec_id) AS pos FROM embeddings e JOIN centers USING (label))
      SELECT label, count(*) AS n, list(vec_id ORDER BY pos) FILTER (WHERE pos <= 3) AS representatives FROM ranked GROUP BY label""",
    "hybrid_embedding": """SELECT vec_id, round(list_cosine_similarity(mixed, e), 6) AS cosine FROM (
      SELECT a.vec_id, a.embedding::DOUBLE[] AS e, CASE WHEN b.vec_id IS NULL THEN a.embedding::DOUBLE[] ELSE list_transform(list_zip(a.embedding, b.embedding), lambda p: 0.7::DOUBLE * p[1]::DOUBLE + 0.3::DOUBLE * p[2]::DOUBLE) END AS mixed
      FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
}
