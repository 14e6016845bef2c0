"""Document fingerprints: a threshold-scaled sketch of each text's shingle hashes.

A sketch keeps every shingle hash below ``fraction`` of the hash range, of short and of long texts alike,
so sketches of very unequal texts stay comparable, and merge by union.  Shared hashes over the smaller
count estimate containment of the smaller text in the larger, over the union Jaccard likeness.  Next to
each likeness stands how many hashes of the smaller sketch it rests on: 0 says that nothing was compared
(a text of few shingles may have none below the limit), and then the likeness is 0.  A digest of all shingles
tells equal sets, whose likeness is 1 whatever was kept; a merged sketch has none.

Serialised form: base64 of the little-endian limit, the digest and the sorted hashes.  Texts with no
shingle (null, empty or white space only) have limit and digest 0; two of those are alike (1, resting on no
hash), and one of them is unlike any other text (0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .ranges import cut_points, part_of
from .shingles import WIDTH, shingle_sets

FRACTION = 1 / 4
FULL = (1 << 64) - 1


def sketch(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The limit, the digest, then the kept hashes, of sorted distinct shingle hashes."""
    limit = int(fraction * FULL) if len(hashes) else 0
    n = int(np.searchsorted(hashes, np.uint64(limit), side="right"))
    return np.concatenate([np.array([limit], dtype="<u8"), hashes.sum(dtype="<u8", keepdims=True), hashes[:n].astype("<u8")])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two texts' shingles, without a digest."""
    return np.concatenate([np.maximum(a[:1], b[:1]), np.zeros(1, dtype="<u8"), np.union1d(a[2:], b[2:])])


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float, int]:
    """Estimated containment of the smaller text in the larger, Jaccard likeness, and the number of hashes they rest on."""
    x, y = a[2:], b[2:]
    least = min(len(x), len(y))
    if a[1] == b[1] and (a[1] or not a[0] and not b[0]):
        return 1.0, 1.0, least
    if not least:
        return 0.0, 0.0, 0
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return shared / least, shared / (len(x) + len(y) - shared), least


def encode(s: np.ndarray) -> str:
    """A sketch as text."""
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    """A sketch from its text."""
    return np.frombuffer(base64.b64decode(s), dtype="<u8")


def fingerprints(df: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with ``__fingerprint``, one Arrow batch at a time."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([encode(sketch(s)) for s in shingle_sets(batch.column(text), width)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, "__fingerprint"])

    return df.mapInArrow(run, StructType([*df.schema, StructField("__fingerprint", StringType())]))


def with_predecessors(df: DataFrame, key: str, text: str, bytes_per_part: int = 32 << 20) -> DataFrame:
    """``__part, __own, __key, __text``, dealt by ``__part``, such that a part holds a whole range of keys.

    Each part also gets, ``__own`` false, the row of the largest key below its own (the part of the
    smallest key: of the largest key), so that a pass over the sorted part sees for each row the row
    before it.  Texts are shuffled once.  Only cut points and one key per part pass the driver; the
    approximate quantiles set the balance of parts, never what is in a result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    cuts = cut_points(rows, "__key", "__text", bytes_per_part)
    rows = rows.withColumn("__part", part_of("__key", cuts))
    last = {r[0]: r[1] for r in rows.groupBy("__part").agg(F.max("__key")).collect()}
    order = sorted(last)
    send = [(p, last[order[i - 1]]) for i, p in enumerate(order)]  # the first gets the last one's
    carried = spark.createDataFrame(send, "p int, k long").groupBy("k").agg(F.collect_list(F.struct("p", F.lit(False).alias("own"))).alias("__more"))
    both = rows.join(F.broadcast(carried), F.col("__key").eqNullSafe(F.col("k")), "left")
    own = F.array(F.struct(F.col("__part").alias("p"), F.lit(True).alias("own")))
    both = both.withColumn("__to", F.explode(F.when(F.col("__more").isNull(), own).otherwise(F.concat(own, "__more"))))
    dealt = both.select(F.col("__to.p").alias("__part"), F.col("__to.own").alias("__own"), "__key", "__text")
    return dealt.repartitionById(len(cuts) + 1, F.col("__part"))


def edited_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text in descending key order.

    The edited text has its last ``floor(n / 2)`` code points replaced by as many from the start of the
    next text (all, if it is shorter).  After the smallest key comes the largest.  Rows with equal keys
    follow one another by text; null keys are the smallest.  A table of one row is its own next.
    """
    laid = with_predecessors(df, key, text).sortWithinPartitions("__part", "__own", F.col("__key").asc_nulls_first(), "__text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double, compared_edited long, compared_next long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, before_part, before_sketch = "", None, None
        target = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[(c, pa.float64()) for c in ("near_edited", "near_next", "jaccard_edited", "jaccard_next")], ("compared_edited", pa.int64()), ("compared_next", pa.int64())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                part, own, keys = (rows.column(i).to_pylist() for i in (0, 1, 2))
                texts = [t or "" for t in rows.column(3).to_pylist()]
                nexts = [before, *texts[:-1]]
                edits = [t if len(t) < 2 else t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
                sets = shingle_sets(pa.array(texts + edits, pa.large_string()), width)
                made = [sketch(s) for s in sets]
                m = len(texts)
                out = []
                for i in range(m):
                    if part[i] != before_part:
                        before_part, before_sketch = part[i], None
                    if own[i]:
                        near = likeness(made[i], made[m + i])
                        follow = likeness(made[i], before_sketch if before_sketch is not None else made[i])
                        out.append((keys[i], len(texts[i]), hashlib.sha256(edits[i].encode()).hexdigest(), encode(made[i]), encode(made[m + i]), near[0], follow[0], near[1], follow[1], near[2], follow[2]))
                    before_sketch = made[i]
                before = texts[-1]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target) if out else pa.RecordBatch.from_pylist([], schema=target)

    return laid.mapInArrow(run, schema)
