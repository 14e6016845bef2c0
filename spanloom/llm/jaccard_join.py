"""N-gram Jaccard join of whole texts by vertical partitioning.

A text is the set of its distinct word n-grams (:mod:`.shingles`), each a 64-bit hash; the order of the
hashes is the global n-gram order.  Equal sets are one class, named by a 64-bit digest.

1. *Fragments.*  The global order is cut into ranges.  Every class sends its hashes to the fragments as
   packed segments, each task one row per fragment.  A fragment holds all classes of its n-grams, so it
   counts their exact document frequencies by sorting.  Hashes of two classes or more go on.
2. *Classes.*  Partial counts of shared n-grams from all fragments are summed per class.  A partner at
   ``threshold`` shares that share of a class's n-grams, so classes with fewer shared n-grams drop out,
   and for the rest one of the rarest shared n-grams (prefix filter) is shared with any partner.
3. *Rounds.*  Under each prefix n-gram a few pivots, smallest in a hash order, meet the members after
   them; the number of pivots grows by ``GROWTH`` from round to round until it covers the posting.
   Members that links already connect are not paired again, so a large group of near copies is linked by
   a few pivots and not pair by pair, while pairs that no link connects are all compared in the end.
4. *Partial overlaps.*  A candidate pair's overlap is counted fragment by fragment, each in a task of its
   own, and summed per pair: ``100 * overlap >= 100 * threshold * union`` decides.

Tasks are bounded: fragments and class buckets grow in number with the n-grams, postings are joined by
skew-splittable equi-joins, and links are contracted as in :mod:`.components`.

Defined cases: null texts and texts without words have no n-gram, size 0, and link with nothing; fewer
words than ``width`` are one n-gram; repeated rows and equal sets share a component; a null key takes
part, and the component's id is the smallest key that isn't null; an empty table stays empty.
Digests and n-gram hashes have 64 bits: of ``n`` different sets about ``n * n / 2**65`` pairs clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import table
from .shingles import WIDTH, shingle_sets
from .units import by_bytes, settle

PERCENT = 75
FRAGMENT_BYTES = 32 << 20
#: Bytes of sets in one bucket of the overlap count, and the fragments that it counts apart.
BUCKET_BYTES = 16 << 20
OVERLAP_FRAGMENTS = 3
PIVOTS, GROWTH = 4, 8


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key, n, set``: each text's number of distinct n-grams and the digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for lo, hi in by_bytes(column):
                sets = shingle_sets(column.slice(lo, hi - lo), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.int64())], names=["key", "n", "set"])
        settle()

    return df.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, "key long, n long, set long")


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(len(a) for a in arrays)], dtype="<u8").tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    lengths = np.frombuffer(blob, dtype="<u8", count=len(kinds) + 1)[1:]
    out, at = [], 8 * (len(kinds) + 1)
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


def _joined(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    rows = [_unpack(b, *kinds) for b in blobs]
    return [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, dtype=k) for i, k in enumerate(kinds)]


def _fragment(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of the global order that each hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def _segments(df: DataFrame, text: str, width: int, fragments: int) -> DataFrame:
    """``fragment, blob``: the packed segments of the classes that each slice of rows holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for lo, hi in by_bytes(column):
                classes = {_digest(s): s for s in shingle_sets(column.slice(lo, hi - lo), width) if len(s)}
                if not classes:
                    continue
                names = np.fromiter(classes, dtype=np.int64, count=len(classes))
                n = np.fromiter(map(len, classes.values()), dtype=np.int64, count=len(classes))
                hashes, owner = np.concatenate(list(classes.values())), np.repeat(np.arange(len(names)), n)
                part = _fragment(hashes, fragments)
                order = np.argsort(part, kind="stable")
                hashes, owner, part = hashes[order], owner[order], part[order]
                home = names % fragments
                by_home = np.argsort(home, kind="stable")
                here = np.union1d(part, home)  # only fragments that this slice has something for
                ends, homes = np.searchsorted(part, np.append(here, fragments)), np.searchsorted(home[by_home], np.append(here, fragments))
                made = []
                for k, f in enumerate(here.tolist()):
                    own = owner[ends[k] : ends[k + 1]]
                    first = _runs(own)
                    mine = by_home[homes[k] : homes[k + 1]]
                    lengths = np.diff(np.concatenate([first, [len(own)]])).astype("<u4")
                    made.append((f, _pack(names[own[first]], lengths, hashes[ends[k] : ends[k + 1]], names[mine], n[mine])))
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], names=["fragment", "blob"])
        settle()

    return df.select(text).mapInArrow(run, "fragment int, blob binary")


def _shared(group: pa.Table, fragments: int) -> pa.Table:
    """What a fragment knows, by class bucket: segments of shared n-grams with frequencies, class sizes."""
    f = group["fragment"][0].as_py()
    names, lengths, hashes, homes, n = _joined(group["blob"].to_pylist(), "<i8", "<u4", "<u8", "<i8", "<i8")
    _, keep = np.unique(names, return_index=True)  # a class that several slices sent counts once
    fresh = np.zeros(len(names), dtype=bool)
    fresh[keep] = True
    hashes = hashes[np.repeat(fresh, lengths)]
    names, lengths = names[fresh], lengths[fresh].astype(np.int64)
    order = np.argsort(hashes)
    first = _runs(hashes[order])
    counts = np.diff(np.concatenate([first, [len(hashes)]]))
    frequency = np.empty(len(hashes), dtype="<u4")
    frequency[order] = np.repeat(counts, counts)
    owner = np.repeat(np.arange(len(names)), lengths)
    shared = frequency > 1
    hashes, frequency, owner = hashes[shared], frequency[shared], owner[shared]
    bucket = (names % fragments)[owner]
    order = np.argsort(bucket, kind="stable")
    hashes, frequency, owner, bucket = hashes[order], frequency[order], owner[order], bucket[order]
    _, sized = np.unique(homes, return_index=True)
    none = np.zeros(0, dtype="<i8")
    out = []
    for a, b in zip(_runs(bucket).tolist(), [*_runs(bucket).tolist()[1:], len(bucket)], strict=False):
        own = owner[a:b]
        begin = _runs(own)
        out.append((int(bucket[a]), _pack(names[own[begin]], np.diff(np.concatenate([begin, [b - a]])).astype("<u4"), hashes[a:b], frequency[a:b], none, none)))
    if len(sized):
        out.append((f, _pack(none, none.astype("<u4"), none.astype("<u8"), none.astype("<u4"), homes[sized], n[sized])))
    return pa.table({"bucket": pa.array([x for x, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})


def _survivors(group: pa.Table, percent: int) -> pa.Table:
    """Classes with enough shared n-grams: their size, shared hashes in order, and prefix."""
    names, lengths, hashes, frequency, homes, n = _joined(group["blob"].to_pylist(), "<i8", "<u4", "<u8", "<u4", "<i8", "<i8")
    owner = np.repeat(names, lengths)
    order = np.lexsort((hashes, owner))
    owner, hashes, frequency = owner[order], hashes[order], frequency[order]
    size = dict(zip(homes.tolist(), n.tolist(), strict=True))
    first = _runs(owner)
    node, total, kept, prefix = [], [], [], []
    for a, b in zip(first.tolist(), [*first.tolist()[1:], len(owner)], strict=False):
        name = int(owner[a])
        m = size[name]
        need = -(-percent * m // 100)
        if b - a >= need:
            x = hashes[a:b]
            rare = np.lexsort((x, frequency[a:b]))[: b - a - need + 1]
            node.append(name)
            total.append(m)
            kept.append(x.tobytes())
            prefix.append(x[rare].view(np.int64))
    return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(total, pa.int64()), "hashes": pa.array(kept, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64()))})


def _overlaps(group: pa.Table) -> pa.Table:
    """Partial overlaps of the pairs of one bucket in one fragment."""
    rows = group.combine_chunks()
    kind = rows["kind"].to_numpy()
    x, y, n = (rows[c].to_numpy(zero_copy_only=False) for c in ("x", "y", "n"))
    blobs = rows["hashes"]
    sets = {(int(kind[i]), int(x[i])): np.frombuffer(blobs[int(i)].as_py(), dtype="<u8") for i in np.flatnonzero(kind > 0)}
    at = np.flatnonzero(kind == 0)
    at = at[np.argsort(x[at], kind="stable")]
    first = _runs(x[at])
    partial = np.zeros(len(at), dtype=np.int64)
    for a, b in zip(first.tolist(), [*first.tolist()[1:], len(at)], strict=False):
        pivot = sets[1, int(x[at[a]])]
        others = [sets[2, int(j)] for j in y[at[a:b]]]
        ends = np.cumsum([len(o) for o in others])
        if not len(pivot) or not ends[-1]:
            continue
        flat = np.concatenate(others)
        hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
        partial[a:b] = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(hit)])[ends]]))
    return pa.table({"a": pa.array(x[at], pa.int64()), "b": pa.array(y[at], pa.int64()), "n": pa.array(n[at], pa.int64()), "partial": pa.array(partial)})


def _cut(survivors: DataFrame, fragments: int) -> DataFrame:
    """``node, fragment, hashes``: the sets of classes, cut at ranges of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([-(-(i << 64) // fragments) for i in range(1, fragments)], dtype=np.uint64)
        for batch in batches:
            names, parts, blobs = [], [], []
            for name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f, x in enumerate(np.split(x := np.frombuffer(raw, dtype="<u8"), np.searchsorted(x, cuts))):
                    names.append(name), parts.append(f), blobs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["node", "fragment", "hashes"])
        settle()

    return survivors.select("node", "hashes").mapInArrow(run, "node long, fragment int, hashes binary")


def _linked(pairs: DataFrame, survivors: DataFrame, buckets: int, percent: int) -> DataFrame:
    """The pairs ``a, b, n`` (``n``: sum of sizes) whose overlap, summed over fragments, is enough."""
    sets = _cut(survivors, OVERLAP_FRAGMENTS)
    placed = pairs.withColumn("bucket", F.pmod(F.xxhash64("b"), F.lit(buckets)).cast("int"))
    none, blank = F.lit(0).cast("long"), F.lit(None).cast("binary")  # no nulls among the longs, which numpy would turn into doubles
    named = placed.select("bucket", F.col("a").alias("node"), F.lit(1).alias("kind")).union(placed.select("bucket", "b", F.lit(2))).distinct()
    needed = named.join(sets, "node").select("bucket", "fragment", "kind", F.col("node").alias("x"), none.alias("y"), none.alias("n"), "hashes")
    asked = placed.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(OVERLAP_FRAGMENTS - 1)))).select("bucket", "fragment", F.lit(0).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "n", blank.alias("hashes"))
    counted = needed.unionAll(asked).groupBy("bucket", "fragment").applyInArrow(_overlaps, "a long, b long, n long, partial long")
    whole = counted.groupBy("a", "b", "n").agg(F.sum("partial").alias("overlap"))
    return whole.filter(100 * F.col("overlap") >= percent * (F.col("n") - F.col("overlap"))).select("a", "b")


def _groups(survivors: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``node, component`` of the classes that links connect."""
    spark = survivors.sparkSession
    # An n-gram's position counts those that only this class has, which come before all shared ones.
    alone = F.col("n") - F.octet_length("hashes") / 8
    postings = survivors.select("node", "n", alone.cast("long").alias("alone"), F.posexplode("prefix").alias("position", "gram")).withColumn("position", F.col("alone") + F.col("position")).drop("alone")
    counts = postings.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1")
    postings = table(postings.join(counts, "gram").withColumn("place", F.shiftrightunsigned(F.xxhash64("node"), 1) / F.lit(float(1 << 63))), "postings")
    links = tried = parts = None
    pivots, before = PIVOTS, 0
    now = postings.withColumn("component", F.col("node"))
    while True:
        if parts is not None:  # postings that are finished, or within one component, stay out from here on
            known = now.filter(F.col("m") > before).drop("component").join(parts.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = known.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("gram")
            now = table(known.join(mixed, "gram").select(*now.columns), "open")
        if now.filter(F.col("m") > before).isEmpty():
            break
        # Pivots of this round are those whose place is in the next interval; a place stands for a rank.
        ahead = now.filter((F.col("m") > before) & (F.col("place") * F.col("m") >= before) & (F.col("place") * F.col("m") < F.when(F.col("m") <= pivots, F.lit(float("inf"))).otherwise(F.lit(pivots))))
        p = ahead.select("gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("component").alias("ca"), F.col("position").alias("ra"))
        # The overlap that the two sizes ask for; the first n-gram that a linked pair shares leaves room for it in both.
        need = F.ceil(percent * (F.col("n") + F.col("na")) / (100 + percent))
        room = (F.col("ra") + need <= F.col("na")) & (F.col("position") + need <= F.col("n"))
        met = p.join(now, "gram").filter((F.struct("place", "node") > F.struct("pa", "a")) & (F.col("component") != F.col("ca")) & room)
        pairs = met.select("a", F.col("node").alias("b"), (F.col("n") + F.col("na")).alias("n")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = table(pairs, "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        if not pairs.isEmpty():
            found = table(_linked(pairs, survivors, buckets, percent), "links")
            links = found if links is None else links.union(found)
            parts = components(links)
        before, pivots = pivots, pivots * GROWTH
    return parts if parts is not None else spark.createDataFrame([], "node long, component long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = df.sparkSession
    docs = table(sizes(df, key, text, width), "shingle-sets")
    classes = docs.filter("n > 0").groupBy("set").agg(F.min("key").alias("least"), F.first("n").alias("n"))
    grams = docs.agg(F.sum("n")).first()[0] or 0
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * grams // FRAGMENT_BYTES))
    shared = _segments(df, text, width, fragments).groupBy("fragment").applyInArrow(lambda t: _shared(t, fragments), "bucket int, blob binary")
    survivors = table(shared.groupBy("bucket").applyInArrow(lambda t: _survivors(t, percent), "node long, n long, hashes binary, prefix array<long>"), "survivors")
    held = survivors.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    parts = _groups(survivors, max(1, -(-held // BUCKET_BYTES)), percent)
    named = classes.join(parts, F.col("set") == F.col("node"), "left").withColumn("group", F.coalesce("component", "set"))
    linked = named.filter("component IS NOT NULL").groupBy("group").agg(F.min("least").alias("smallest"))
    per_class = named.join(linked, "group", "left").select(F.col("set").alias("s"), F.coalesce("smallest", "least").alias("component_id"))
    out = docs.join(per_class, (F.col("set") == F.col("s")) & (F.col("n") > 0), "left")
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
