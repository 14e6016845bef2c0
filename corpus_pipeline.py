"""A corpus pipeline over ``documents``: five stages, each a table of its own.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes it as Parquet into
the shared folder and rereads it as the next stage's ``docs``.  All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import jaccard_join, language, mixing, pii, sentencepiece_ids
from spanloom.llm.queries import pii_key
from spanloom.llm.scratch import table

#: A text whose n-grams share less than this with its nearest profile is of no known language.
LEAST_SCORE = 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects texts without letters and texts far from every language's profile."""
    found = language.identify(docs, language.fit(docs))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document with the smallest id stays.

    Documents without words are in no group and stay, as do rows without an id, one of each text.  Of rows
    with equal id and text one stays; if an id comes with several texts, all of them stay where one does.
    """
    found = jaccard_join.near_duplicates(docs)
    first = found.filter("n_shingles > 0 AND doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("__id"), "left_semi")
    apart = docs.filter(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(mixing.WORD))
    return kept.unionByName(apart).dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: numbers, dates, addresses and keys give way to pseudonyms of the same format."""
    named = pii.pseudonymise(docs.withColumn("__before", F.length("text")), pii_key(spark))
    return named.withColumn("n_chars", F.coalesce(F.col("n_chars") + F.length("text") - F.col("__before"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents repeat or go so that sources come to their target weights."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of every text, and whether they decode to it."""
    return sentencepiece_ids.verified(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Profiles, keyed permutations and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
