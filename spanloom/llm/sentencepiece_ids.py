"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, field by field.  From it come the normaliser (precompiled character
map, extra white space), the metaspace marker and dummy prefix, the pieces with their scores and the
byte fallback.  A unigram model becomes ``Unigram`` with the pieces' scores; a BPE model becomes ``BPE``
whose merges are all ways to split a piece into two pieces, ranked by the piece's score.

Where no piece has some character pair inside, no merge crosses that pair.  If that holds for any
character before the marker, and for letters before punctuation (both are checked when a model is
loaded), a text's ids are those of the units between such cuts, in order: distinct units are encoded in
batches by the library's threads, and :class:`.units.UnitIds` expands them.  Texts with runs of blanks,
blanks at an end, the marker itself or U+0001 are encoded whole.

Parity: every distinct unit that a worker encodes is encoded by the sentencepiece library as well, and
so is every text that is encoded whole; ``parity`` says that all of a document's units agreed.  Tests
hold whole texts against that library.

Defined cases: null and empty texts give no ids and decode to empty texts; rows may repeat and columns
pass through.  Decoding restores every text without the marker character U+2581, which a model without
character map reads as a blank.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .units import UnitIds, by_bytes, settle

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
THREADS = 2
#: Units that a worker remembers, units encoded in one call, and bytes of text taken at a time.
UNITS, CALL, SLICE = 120_000, 8192, 1 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class Model:
    """What a model file says about encoding."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces: bool = True
    escape: bool = True
    suffix: bool = False


def parse(raw: bytes) -> Model:
    """A model from the bytes of its file."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                model.unknown = len(model.pieces)
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.extra_spaces = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def build(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.suffix or not model.escape or model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with a prefixed marker are built")
    text = [p for p, _, _ in model.pieces]
    if model.kind == UNIGRAM:
        made = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        ids = {p: i for i, (p, _, k) in enumerate(model.pieces) if k in (NORMAL, USER)}
        merges = []
        for p, i in ids.items():
            merges += [(-model.pieces[i][1], ids[p[:k]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        merges.sort()
        made = models.BPE(vocab={p: i for i, p in enumerate(text)}, merges=[m[2:] for m in merges], unk_token=text[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(made)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
POINT = r"""[,.:;!?%&$#*)(|"'=\-\n]"""


class Pieces:
    """Encoder and decoder of one model, with its parity check."""

    def __init__(self, path: str, threads: int = THREADS, check: bool = True):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as file:
            raw = file.read()
        self.model, self.check, self.file = parse(raw), check, raw
        plain = [p for p, _, k in self.model.pieces if k in (NORMAL, USER)]
        self.by_unit = self.model.kind == BPE and self.model.dummy_prefix and not self.model.charsmap and not self.model.extra_spaces and not any(MARK in p.lstrip(MARK) for p in plain)
        self.by_point = not any(re.search(f"[{LETTER}]{POINT}", p) for p in plain)
        self.by_line = not any("\n" in p and len(p) > 1 for p in plain)
        self.units = UnitIds(self._encode_units, UNITS)
        self.wrong: set[str] = set()
        self.raw = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces], pa.binary())

    # Built when first asked for: a worker that decodes needs none of these.
    @functools.cached_property
    def tokenizer(self):
        """The tokenizer, for whole texts or (see :meth:`_normal`) for units, which are normalised already."""
        made = build(self.model)
        self.normaliser, self.whole = made.normalizer, True
        return made

    def _normal(self, whole: bool):
        """The one tokenizer of this worker, with or without its normaliser."""
        from tokenizers import normalizers

        made = self.tokenizer
        if self.whole != whole:
            made.normalizer = self.normaliser if whole else normalizers.Sequence([])
            self.whole = whole
        return made

    @functools.cached_property
    def reference(self):
        """The sentencepiece library's encoder for whole texts."""
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.file)

    @functools.cached_property
    def bare_reference(self):
        """The same for units: a second normaliser message, merged into the first, sets add_dummy_prefix to 0."""
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.file + b"\x1a\x02\x18\x00")

    def _encode_units(self, units: list[str]) -> list[np.ndarray]:
        bare, out = self._normal(False), []
        if self.check and not self.units.index:
            self.wrong = set()
        for lo in range(0, len(units), CALL):
            some = units[lo : lo + CALL]
            found = [e.ids for e in bare.encode_batch_fast(some, add_special_tokens=False)]
            if self.check:
                theirs = self.bare_reference.encode(some, num_threads=1)
                if found != theirs:
                    self.wrong.update(u for u, a, b in zip(some, found, theirs, strict=True) if a != b)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum()))
            out.append((flat, sizes))
        return out

    def _split(self, column: pa.Array) -> pa.ListArray:
        marked = pc.binary_join_element_wise(MARK, pc.replace_substring(column, " ", "\x01" + MARK), "")
        if self.by_point:
            marked = pc.replace_substring_regex(marked, f"([{LETTER}])({POINT})", "\\1\x01\\2")
        if self.by_line:
            marked = pc.replace_substring(marked, "\n", "\n\x01")
        return pc.split_pattern(marked, "\x01")

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a slice of texts, the offsets of the texts in them, and their parity."""
        column = pc.fill_null(column, "")
        odd = np.ones(len(column), dtype=bool)
        if self.by_unit:
            odd = pc.or_(pc.match_substring_regex(column, f"^ | $|  |{MARK}|\x01"), pc.equal(column, "")).to_numpy(zero_copy_only=False)
        lists = self._split(column.filter(pa.array(~odd)))
        ids, at = self.units.ids(lists)
        right = np.ones(len(lists), dtype=bool)
        if self.wrong:
            bad = pc.is_in(lists.flatten(), value_set=pa.array(sorted(self.wrong), lists.type.value_type)).to_numpy(zero_copy_only=False)
            right = np.diff(np.concatenate([[0], np.cumsum(bad)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]) == 0
        if not odd.any():
            return ids, at, right
        texts = column.filter(pa.array(odd)).to_pylist()
        whole = [e.ids for e in self._normal(True).encode_batch_fast(texts, add_special_tokens=False)]
        agree = [a == b for a, b in zip(whole, self.reference.encode(texts, num_threads=1), strict=True)] if self.check else [True] * len(whole)
        rest, w, u = np.split(ids, at[1:-1]), 0, 0
        rows, parity = [], np.ones(len(odd), dtype=bool)
        for i, o in enumerate(odd):
            if o:
                rows.append(np.asarray(whole[w], dtype=np.uint32))
                parity[i], w = agree[w], w + 1
            else:
                rows.append(rest[u])
                parity[i], u = right[u], u + 1
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), parity

    def decode(self, lists: pa.ListArray) -> list[str]:
        """Texts of lists of ids.

        The bytes of the pieces are joined; where they are no text, the library decides what stands
        for the broken bytes.
        """
        lists = pc.fill_null(lists, []) if lists.null_count else lists
        taken = self.raw.cast(pa.large_binary()).take(lists.flatten())
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        _, ends, data = taken.buffers()
        at = np.frombuffer(ends, dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1][offsets].tolist() if len(taken) else [0] * (len(lists) + 1)
        joined = memoryview(data) if len(taken) else b""
        out = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            try:
                text = str(joined[a:b], "utf-8")
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(lists[i].as_py(), skip_special_tokens=False))
                continue
            out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
        return out


_loaded: dict[tuple, Pieces] = {}


def pieces(name: str = MODEL, threads: int = THREADS, check: bool = True) -> Pieces:
    """One encoder per worker process."""
    key = (name, threads, check)
    if key not in _loaded:
        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        _loaded[key] = Pieces(name, threads, check)
    return _loaded[key]


def _release(encoder: Pieces) -> None:
    """Ends a task: the worker keeps its model for later tasks and forgets the units."""
    encoder.units.forget()
    settle()


def encode(df: DataFrame, text: str = "text", model: str = MODEL, threads: int = THREADS, check: bool = True) -> DataFrame:
    """``df`` with ``piece_ids`` and ``parity``.

    Null and empty texts give no ids.  Repeated rows and extra columns pass through; columns of the
    same names are replaced.
    """
    kept = [c for c in df.columns if c not in ("piece_ids", "parity")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(model, threads, check)
        for batch in batches:
            column = batch.column(kept.index(text))
            for lo, hi in by_bytes(column, SLICE):
                ids, at, parity = encoder.ids(column.slice(lo, hi - lo))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(parity)], names=[*kept, "piece_ids", "parity"])
        _release(encoder)

    rows = df.select(*[f"`{c}`" for c in kept])
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("piece_ids", ArrayType(IntegerType())), StructField("parity", BooleanType())]))


def decode(df: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """``df`` with ``decoded``, the texts of its lists of ids (null lists: empty)."""
    kept = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = pieces(model, THREADS, False)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = decoder.decode(part.column(kept.index(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    rows = df.select(*[f"`{c}`" for c in kept])
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("decoded", StringType())]))


def verified(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, parity, round_trip`` of all texts, encoded and decoded in one pass.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers; ``round_trip`` says that the
    decoded ids are the text again.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("parity", pa.bool_()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(model, threads)
        for batch in batches:
            names, column = batch.columns
            for lo, hi in by_bytes(column, SLICE):
                texts = column.slice(lo, hi - lo)
                ids, at, parity = encoder.ids(texts)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                same = [a == (b or "") for a, b in zip(encoder.decode(lists), texts.to_pylist(), strict=True)]
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64()), pa.array(parity), pa.array(same)], schema=schema)
        _release(encoder)

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
