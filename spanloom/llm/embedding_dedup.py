"""Embedding near-dedup by a join of packed chunks with a subspace filter.

Unit vectors with cosine at least ``t`` are at squared distance at most ``2 - 2 t``, and so are their first
coordinates after any rotation.  A fixed rotation spreads a vector's energy evenly, so that ``width`` of its
coordinates tell most pairs apart: one matrix product in single precision over these, with room for its
rounding, finds candidates, and the cosine of the vectors themselves, in double precision, decides.

Every row is compared with every other one, so seconds grow with the square of the rows; what is written
grows with the rows.  Distinct vectors are packed into chunks of at most ``CHUNK`` rows, one row of a written
table each.  A Cartesian product of that table with itself reads the chunks again and shuffles none; each
pair of chunks meets once, in one of its two orders by a hash, so that tasks share the pairs.

Equal vectors are collapsed before the join, and are found again by 128 bits of hashes.  What leaves a task
is a link count per vector and a spanning star per component, not pairs.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing; vectors of different lengths don't link; rows with equal vectors link with one another, also if
their ids repeat; an empty table stays empty; other columns don't matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, min_labels
from .scratch import table

THRESHOLD = 0.9
#: Rows of a chunk, and numbers in its vectors.
CHUNK = 1 << 14
CELLS = 1 << 20
#: Rows and columns of a tile of the product; the columns are a multiple of 8.
_TILE = (512, 1024)
#: Links that are counted at a time, and linked rows that a task combines.
_PAIRS = 1 << 18
_ROWS = 1 << 20


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation of ``dim`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def width(dim: int, threshold: float) -> int:
    """Coordinates by which all but some 3 in 10,000 pairs of random vectors are told apart."""
    room = 4 * max(0.0, 1 - threshold) * dim
    return min(dim, math.ceil(((3.6 + math.sqrt(13 + room)) / 2) ** 2))


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors in double precision, scaled to length 1 (by their largest component first, so that no square leaves the range)."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists of a batch as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one length."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == dim)))


def packed(classes: DataFrame, chunk: int) -> DataFrame:
    """``classes`` (longs, then the vector) as chunks: ``dim, at, (the longs as arrays), vector``."""
    *longs, vector = classes.columns
    kind = np.float32 if classes.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    schema = "dim int, at long, " + ", ".join(f"{c} array<long>" for c in longs) + ", vector binary"

    def row(dim: int, columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        *ids, x = (np.concatenate(c) for c in columns)
        made = [pa.array([dim], pa.int32()), pa.array([ids[0][0]], pa.int64()), *[pa.array([c], pa.list_(pa.int64())) for c in ids], pa.array([x.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(made, names=["dim", "at", *longs, "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for rows in _by_length(batch, len(longs)):
                x = _vectors(rows.column(len(longs))).astype(kind)
                dim, lo = x.shape[1], 0
                most = max(1, min(chunk, CELLS // dim))
                while lo < len(x):
                    kept = held.setdefault(dim, [[] for _ in range(len(longs) + 1)])
                    hi = lo + most - sum(map(len, kept[-1]))
                    for c, new in zip(kept, [*(rows.column(i).to_numpy() for i in range(len(longs))), x], strict=True):
                        c.append(new[lo:hi])
                    if hi <= len(x):
                        yield row(dim, held.pop(dim))
                    lo = hi
        for dim, kept in held.items():
            yield row(dim, kept)

    return classes.mapInArrow(run, schema)


class _Links:
    """What a pair of chunks has: a link count per row and stars over the linked rows."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.count = np.zeros(len(ids), dtype=np.int64)
        self.label = np.arange(len(ids))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        """Counts links; of their components only stars are kept."""
        n = len(self.ids)
        self.count += (np.bincount(p, weights=self.sizes[q], minlength=n) + np.bincount(q, weights=self.sizes[p], minlength=n)).astype(np.int64)
        a, b = self.label[p], self.label[q]
        apart = a != b
        if apart.any():
            nodes, least = min_labels(a[apart], b[apart])
            moved = np.arange(n)
            moved[nodes] = least
            self.label = moved[self.label]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``id, n, least`` of the linked rows; ``least`` is the smallest id of a row's star."""
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.ids)
        linked = np.flatnonzero(self.count)
        return self.ids[linked], self.count[linked], least[self.label[linked]]


class Side:
    """A chunk's unit vectors, and their first coordinates as both sides of a product that is not negative for candidates."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, threshold: float):
        self.ids, self.sizes, self.x = ids, sizes, unit(raw)
        n, dim = self.x.shape
        low = (self.x @ rotation(dim)[:, : width(dim, threshold)]).astype(np.float32)
        half, one = (low.astype(np.float64) ** 2).sum(axis=1, keepdims=True) / 2, np.ones((n, 1))
        slack = 4e-7 * (low.shape[1] + 8)  # more than single precision loses
        self.left = np.hstack([low, 1 - threshold + slack - half, one]).astype(np.float32)
        right = np.hstack([low, one, -half]).astype(np.float32)
        none = np.zeros((-n % 8, right.shape[1]), dtype=np.float32)  # to a multiple of 8; no candidates
        none[:, -1] = -8
        right = np.concatenate([right, none])
        self.right = [np.ascontiguousarray(right[j : j + _TILE[1]].T) for j in range(0, len(right), _TILE[1])]


def join(one: Side, two: Side, threshold: float) -> _Links:
    """Links between two chunks, or within one."""
    same = one is two
    out = _Links(one.ids, one.sizes) if same else _Links(np.concatenate([one.ids, two.ids]), np.concatenate([one.sizes, two.sizes]))
    at = 0 if same else len(one.ids)
    verified = max(1, (1 << 21) // one.x.shape[1])
    product, flags = np.empty(_TILE[0] * _TILE[1], dtype=np.float32), np.empty(_TILE[0] * _TILE[1], dtype=bool)
    found, n = [], 0
    for i in range(0, len(one.left), _TILE[0]):
        left = one.left[i : i + _TILE[0]]
        for j, right in enumerate(two.right):
            cols, first = right.shape[1], j * _TILE[1]
            if same and first + cols <= i:
                continue
            cells = len(left) * cols
            np.matmul(left, right, out=product[:cells].reshape(len(left), cols))
            near = np.greater_equal(product[:cells], np.float32(0), out=flags[:cells])
            words = np.flatnonzero(near.view(np.uint64) != 0)
            cell = (words[:, None] * 8 + np.arange(8))[near.reshape(-1, 8)[words]]
            for k in range(0, len(cell), verified):
                p, q = np.divmod(cell[k : k + verified], cols)
                p, q = p + i, q + first
                if same:
                    p, q = p[p < q], q[p < q]
                close = (one.x[p] * two.x[q]).sum(axis=1) >= threshold
                found.append((p[close], q[close] + at))
                n += len(found[-1][0])
                if n >= _PAIRS:
                    out.add(*map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
    if n:
        out.add(*map(np.concatenate, zip(*found, strict=True)))
    return out


def linked(chunks: DataFrame, kind: type, threshold: float) -> DataFrame:
    """``id, n, least`` of linked vectors, from every pair of chunks; an id may come once per task."""
    one = chunks.select("dim", "at", "id", "size", "vector")
    two = one.select(*[F.col(c).alias(f"{c}_2") for c in one.columns])
    odd = F.pmod(F.xxhash64(F.least("at", "at_2"), F.greatest("at", "at_2")), F.lit(2)) == 1
    once = (F.col("at") == F.col("at_2")) | ((F.col("at") != F.col("at_2")) & ((F.col("at") < F.col("at_2")) == odd))
    pairs = one.crossJoin(two.hint("shuffle_replicate_nl")).filter((F.col("dim") - F.col("dim_2") == 0) & once)

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        ids, n, least = map(np.concatenate, zip(*parts, strict=True))
        nodes, star = min_labels(ids, least)
        total = np.bincount(np.searchsorted(nodes, ids), weights=n, minlength=len(nodes)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total), pa.array(star)], names=["id", "n", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[str, tuple[int, Side]] = {}

        def side(batch: pa.RecordBatch, i: int, end: str) -> Side:
            get = lambda c: batch.column(c + end)[i]
            at = get("at").as_py()
            if end not in sides or sides[end][0] != at:
                raw = np.frombuffer(get("vector").as_buffer(), dtype=kind).reshape(-1, get("dim").as_py())
                sides[end] = at, Side(get("id").values.to_numpy(), get("size").values.to_numpy(), raw, threshold)
            return sides[end][1]

        parts, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                a = side(batch, i, "")
                b = a if batch.column("at")[i].as_py() == batch.column("at_2")[i].as_py() else side(batch, i, "_2")
                rows = join(a, b, threshold).rows()
                if len(rows[0]):
                    parts.append(rows)
                    n += len(rows[0])
                if n >= _ROWS:
                    yield combined(parts)
                    parts, n = [], 0
        if parts:
            yield combined(parts)

    return pairs.mapInArrow(run, "id long, n long, least long")


def _digest(vector: str, seed: int) -> Column:
    """64 bits of a vector, the same for both zeros."""
    return F.xxhash64(F.lit(seed), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows = df.select(F.col(key).cast("long").alias("__id"), F.col(vector).alias("__vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    good = F.col("__vector").isNotNull() & F.forall("__vector", finite) & F.exists("__vector", lambda v: v != 0)
    rows = rows.withColumn("__vector", F.when(good, F.col("__vector")))
    whole = rows.filter("__vector IS NOT NULL").groupBy("__vector").agg(F.min("__id").alias("least"), F.count("*").alias("size"))
    classes = whole.select(F.monotonically_increasing_id().alias("id"), "least", "size", _digest("__vector", 1).alias("h1"), _digest("__vector", 2).alias("h2"), F.col("__vector").alias("vector"))
    kind = np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    # One chunk a file, so that the readers deal them out evenly.
    chunks = table(packed(classes, chunk), "vectors", 1)
    found = table(linked(chunks, kind, threshold), "embedding-links")

    parts = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = chunks.select(F.inline(F.arrays_zip("id", "least", "size", "h1", "h2")))
    named = named.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left").withColumn("__group", F.coalesce("component", "id"))
    smallest = named.groupBy("__group").agg(F.min("least").alias("component_id"))
    per_class = named.join(smallest, "__group").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    keyed = rows.select("__id", F.when(F.col("__vector").isNotNull(), _digest("__vector", 1)).alias("h1"), F.when(F.col("__vector").isNotNull(), _digest("__vector", 2)).alias("h2"))
    out = keyed.join(per_class, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "__id")
    return out.select(F.col("__id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("__id") == component).alias("kept"))
