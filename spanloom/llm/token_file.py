"""Token ids as files of rANS blocks, written in key order and read back in parallel.

A file set is a folder of two Parquet containers (so that Spark's commit protocol and any file system
apply): ``table`` holds the shared frequency counts, ``blocks`` one row per block with the numbers
``part, block, offset`` (ids of the part before it), the keys and lengths of its documents, and the
block itself as :mod:`.rans` lays it out.  Parts in order hold the documents in ascending key order.

Defined cases: null texts are empty; every document ends with the end id, so it has at least one;
null keys come first; documents with equal keys follow one another by ids.  A block holds whole
documents, so one longer than ``block_ids`` is a block by itself.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .ranges import cut_points, part_of
from .scratch import shared_dir, table
from .units import UnitIds, by_bytes

BLOCK_IDS = 1 << 19
END = 2
TOKENIZER = "word_bpe_49k.json"

def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class TextIds:
    """Ids of whole texts by the tokenizers library.

    A tokenizer that lower-cases, replaces runs of white space by one blank and keeps only matches of a
    pattern of letters, single digits or other signs never joins characters across white space, nor a
    letter and a sign after it.  Its units are what lies between such cuts, and units of letters alone
    are encoded many at a time, as one text, which ends of words cut up again.  Texts with U+001C to
    U+001F, which Arrow splits at and the tokenizer does not, texts with the brackets of special tokens,
    and all texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        text = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        wanted = (r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", '"Lowercase"', '"content": " "')
        special = all(t["content"].startswith("<|") for t in spec["added_tokens"])
        self.by_word = bool(split and split["invert"] and split["behavior"] == "Removed" and special and all(w in text for w in wanted))
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.vocab, dtype=bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.units = UnitIds(self._encode_units, 600_000)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of units, some thousand at a time."""
        return [self._encode_some(units[lo : lo + 4096]) for lo in range(0, len(units), 4096)]

    def _encode_some(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(units)
        letters = [i for i, u in enumerate(units) if u.isalpha()] if self.ends.any() else []
        if letters:
            ids = np.array(self._encode([" ".join([units[i] for i in letters])])[0], dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(units) == len(letters):
                return ids, np.diff(np.concatenate([[0], cuts]))
            if len(cuts) == len(letters):
                for i, x in zip(letters, np.split(ids, cuts[:-1]), strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._encode([units[i] for i in rest]), strict=True):
            out[i] = np.asarray(x, dtype=np.uint32)
        return np.concatenate(out), np.fromiter(map(len, out), dtype=np.int64, count=len(out))

    def _split(self, column: pa.Array) -> pa.ListArray:
        cut = pc.replace_substring_regex(pc.ascii_lower(column), r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        return pc.utf8_split_whitespace(cut)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts without end ids, and the offsets of the texts in them."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, "[\x1c-\x1f]|<\\|").to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(column), dtype=bool)
        if not odd.any():
            return self.units.ids(self._split(column))
        whole = iter(self._encode(column.filter(pa.array(odd)).to_pylist()))
        plain, at = self.units.ids(self._split(column.filter(pa.array(~odd))))
        rest = iter(np.split(plain, at[1:-1]) if len(at) > 1 else [])
        rows = [np.asarray(next(whole) if o else next(rest), dtype=np.uint32) for o in odd]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_loaded: dict[str, TextIds] = {}


def text_ids(name: str) -> TextIds:
    """One encoder per worker process."""
    if name not in _loaded:
        _loaded[name] = TextIds(name if os.path.exists(name) else tokenizer_path(name))
    return _loaded[name]


def tokenised(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``__key, __ids``: the ids of each text as little-endian bytes, two or four an id, without end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(tokenizer)
        kind = id_type(encoder.vocab)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in by_bytes(column, 8 << 20):
                ids, at = encoder.ids(column.slice(lo, hi - lo))
                raw = pa.py_buffer(ids.astype(kind).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * np.dtype(kind).itemsize).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed], names=["__key", "__ids"])

    return df.select(F.col(key).cast("long").alias("__key"), text).mapInArrow(run, "__key long, __ids binary")


def id_type(vocab: int) -> str:
    """The type that ids of a vocabulary are kept in."""
    return "<u2" if vocab <= 1 << 16 else "<u4"


def id_counts(packed: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """``id, n``: how often each id occurs, one end id a document, counted per task and then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = text_ids(tokenizer).vocab
        counts = np.zeros(max(vocab, end + 1), dtype=np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            counts += np.bincount(np.frombuffer(raw, dtype=id_type(vocab)), minlength=len(counts))
            counts[end] += batch.num_rows
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    return packed.select("__ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame) -> np.ndarray:
    """Counts by id; the vocabulary bounds what reaches the driver."""
    rows = counts.toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    out[rows["id"].to_numpy(dtype=np.int64)] = rows["n"]
    return out


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all texts of ``df`` to ``path``."""
    rows = table(tokenised(df, key, text, tokenizer), "ids")
    id_counts(rows, tokenizer, end).coalesce(1).write.parquet(f"{path}/table")
    counts = _table(df.sparkSession.read.parquet(f"{path}/table"))
    cuts = cut_points(rows, "__key", "__ids")
    dealt = rows.withColumn("__part", part_of("__key", cuts)).repartitionById(len(cuts) + 1, F.col("__part"))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, model = id_type(text_ids(tokenizer).vocab), rans.Table(counts)
        part, block, offset, held = None, 0, 0, 0
        keys: list = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, offset, held
            packed = rans.encode(np.concatenate(ids), model)
            out = pa.RecordBatch.from_pylist([{"part": part, "block": block, "offset": offset, "keys": keys[:], "sizes": sizes[:], "ids": packed}], schema=schema)
            block, offset, held = block + 1, offset + held, 0
            keys.clear(), sizes.clear(), ids.clear()
            return out

        for batch in batches:
            for name, raw, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != part:
                    if keys:
                        yield flush()
                    part, block, offset = place, 0, 0
                n = len(raw) // np.dtype(kind).itemsize + 1
                if keys and held + n > block_ids:
                    yield flush()
                keys.append(name), sizes.append(n), ids.append(np.append(np.frombuffer(raw, dtype=kind), end).astype(np.uint32))
                held += n
        if keys:
            yield flush()

    laid = dealt.sortWithinPartitions("__part", F.col("__key").asc_nulls_first(), "__ids").select("__key", "__ids", "__part")
    laid.mapInArrow(run, "part int, block int, offset long, keys array<long>, sizes array<long>, ids binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a file set, from its decoded ids."""
    counts = _table(spark.read.parquet(f"{path}/table"))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.max(F.col("offset") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).collect()  # one row per part
    total, bases = 0, []
    for part, n in sorted(map(tuple, sizes)):
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")
    based = blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("offset")).alias("start"), "keys", "sizes", "ids")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rans.Table(counts)
        for batch in batches:
            for row in range(batch.num_rows):
                start, keys, n, packed = (batch.column(i)[row].as_py() for i in range(4))
                raw = memoryview(rans.decode(packed, model).astype("<u4").tobytes())
                ends = np.cumsum(n)
                begins = ends - n
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    """A fresh folder among the intermediate tables."""
    return f"{shared_dir(spark)}/spanloom/tokens-{uuid.uuid4().hex}"
