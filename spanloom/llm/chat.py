"""Chat formatting by columnar byte assembly.

Template: each turn is ``### Role: text</turn>`` and a line feed, roles capitalised as they come
(``assistant`` is ``Assistant``; a role that would not survive that is written after ``=``).  Inside
roles and texts a backslash goes before every backslash, before ``###``, before ``</turn>`` and before
``: `` in roles, so that reading takes away what writing put in, for any text.

A batch of turns becomes one buffer: the lengths of all segments (header, role, text, end) give
cumulative offsets, and numpy scatters the bytes of the Arrow columns to these places.  The loss mask is
a list of byte spans ``[begin, end)`` over the formatted part: the escaped texts of assistant turns.

A conversation comes as parts of at most ``part_turns`` turns, so no row and no task holds a whole
conversation however long it is; parts in order make up the conversation.

Defined cases: null texts and roles are empty; rows of one conversation are in order of turn (nulls
first), then role, then text, so that ties and repeated rows have one result; null conversations form
one conversation; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import utf8

HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"
PART_TURNS = 256
PARTS = "conv_id long, part long, n_turns int, formatted binary, mask_begins array<int>, mask_ends array<int>"


def escape_text(column: pa.Array) -> pa.Array:
    """Texts with a backslash before backslashes and before the template's marks."""
    column = pc.replace_substring(column, "\\", "\\\\")
    return pc.replace_substring(pc.replace_substring(column, "###", "\\###"), "</turn>", "\\</turn>")


def escape_role(column: pa.Array) -> pa.Array:
    """Roles as headings, reversibly."""
    column = pc.replace_substring(escape_text(column), ": ", "\\: ")
    column = pc.replace_substring(column, "\n", "\\\n")
    plain = pc.match_substring_regex(column, "^[a-z]")
    first = pc.if_else(plain, pc.ascii_upper(pc.utf8_slice_codeunits(column, 0, 1)), "=")
    rest = pc.if_else(plain, pc.utf8_slice_codeunits(column, 1), column)
    return pc.binary_join_element_wise(first, rest, "")


def read_role(heading: str) -> str:
    """The role that a heading stands for."""
    plain = heading[1:] if heading[:1] == "=" else heading[:1].lower() + heading[1:]
    return unescape(plain)


def unescape(text: str) -> str:
    """What escaping started from."""
    pieces = text.split("\\\\")
    return "\\".join(p.replace("\\", "") for p in pieces)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of formatted turns, the turns' offsets in it, and the begins and ends of their texts."""
    (r, ra), (t, ta) = utf8(escape_role(roles)), utf8(escape_text(texts))
    n = len(ra) - 1
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(HEAD), len(MIDDLE), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(ra), np.diff(ta)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, dtype=np.uint8)
    for k, mark in ((0, HEAD), (2, MIDDLE), (4, END)):
        out[begins[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)
    for k, data, at in ((1, r, ra), (3, t, ta)):
        out[np.arange(len(data)) + np.repeat(begins[:, k] - at[:-1], np.diff(at))] = data
    return out, np.concatenate([[0], ends[:, -1]]) if n else np.zeros(1, dtype=np.int64), begins[:, 3], ends[:, 3]


def _sorted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Formatted parts of all conversations: ``conv_id, part, n_turns, formatted, mask_begins, mask_ends``.

    Turns are range-dealt by conversation and turn, so that a conversation with a large share of all
    turns is spread over tasks.  ``part`` numbers order a conversation's parts and leave gaps.
    """
    clean = df.select(F.col(conv).cast("long").alias("__conv"), F.col(turn).cast("long").alias("__turn"), F.coalesce(role, F.lit("")).alias("__role"), F.coalesce(text, F.lit("")).alias("__text"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = clean.repartitionByRange(n, F.col("__conv").asc_nulls_first(), F.col("__turn").asc_nulls_first()).withColumn("__task", F.spark_partition_id().cast("long"))
    laid = _sorted(dealt, ["__conv", "__turn", "__role", "__text"]).select("__conv", "__role", "__text", "__task")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int32()), ("formatted", pa.binary()), ("mask_begins", pa.list_(pa.int32())), ("mask_ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                rows = batch.slice(lo, 2048)
                names = rows.column(0).to_pylist()
                buffer, at, begins, ends = assemble(rows.column(1), rows.column(2))
                loss = pc.equal(rows.column(1), "assistant").to_numpy(zero_copy_only=False)
                raw = buffer.tobytes()
                task = rows.column(3)[0].as_py()
                out, i = [], 0
                while i < len(names):
                    j = i + 1
                    while j < len(names) and j - i < part_turns and names[j] == names[i]:
                        j += 1
                    base, inside = int(at[i]), np.flatnonzero(loss[i:j]) + i
                    out.append((names[i], (task << 32) + made, j - i, raw[base : int(at[j])], (begins[inside] - base).tolist(), (ends[inside] - base).tolist()))
                    made, i = made + 1, j
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return laid.mapInArrow(run, PARTS)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts that a formatted part holds."""
    out, at = [], 0
    head, middle, end = HEAD.decode(), MIDDLE.decode(), END.decode()

    def find(mark: str, begin: int) -> int:
        while True:
            k = formatted.index(mark, begin)
            back = k
            while back and formatted[back - 1] == "\\":
                back -= 1
            if (k - back) % 2 == 0:
                return k
            begin = k + 1

    while at < len(formatted):
        if not formatted.startswith(head, at):
            raise ValueError("a turn must begin here")
        colon = find(middle, at + len(head))
        stop = find(end, colon + len(middle))
        out.append((read_role(formatted[at + len(head) : colon]), unescape(formatted[colon + len(middle) : stop])))
        at = stop + len(end)
    return out


def digests(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from the parts.

    Parts of a conversation meet in order in one task, which streams them into running digests and
    holds one part at a time: a SHA-256 of a conversation is one chain and can't be computed apart.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = _sorted(parts.repartition(n, "conv_id"), ["conv_id", "part"])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def row(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        for batch in batches:
            done = []
            for name, _, _, raw, begins, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != name:
                    if now is not None:
                        done.append(row(now))
                    now = [name, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = raw.decode()
                for role, text in read_turns(formatted):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(begins, ends, strict=True):
                    learned = unescape(raw[a:b].decode())
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(now), schema, strict=True)], schema=schema)

    return laid.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
