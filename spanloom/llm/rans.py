"""A static range asymmetric numeral system over token ids, in interleaved blocks.

One frequency table serves all blocks: frequencies scaled to a sum of ``2**BITS``, at least 1 for
every id that occurs.  A block holds ``n`` ids dealt to ``lanes`` independent coders (id ``i`` to lane
``i % lanes``), which numpy advances together; each step of a lane emits at most one 32-bit word.
Every ``interval`` ids a checkpoint keeps the lanes' states and the position in the words, so a
decoder may begin at any of them, and each piece between checkpoints has its own checksum.

Layout of a block, little-endian:
``magic u32, n u64, lanes u32, interval u64, words u64, pieces u32``, then per piece
``first word u64, crc32 of its ids u32, states u64 * lanes``, then the words, then a crc32 of all that.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
MAGIC = 0x4C52414E
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<IQIQQI")
_PIECE = struct.Struct("<QI")


class Table:
    """Frequencies, cumulative starts and the slot-to-id map that all blocks share."""

    def __init__(self, counts: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = scale(np.asarray(counts, dtype=np.int64), bits).astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)[:-1]
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id of each slot."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))
        return self._slots


def scale(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, near the counts' shares, none of a seen id below 1."""
    total, room = int(counts.sum()), 1 << bits
    if not total:
        counts, total = np.ones_like(counts), len(counts)
    seen = counts > 0
    if int(seen.sum()) > room:
        raise ValueError("more ids than slots")
    freq = np.where(seen, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    over = int(freq.sum()) - room
    order = np.lexsort((np.arange(len(freq)), -freq))
    while over:  # take from, or give to, the most frequent first
        if over < 0:
            freq[order[0]] -= over
            break
        spare = np.maximum(freq[order] // 2, 0)
        cut = np.minimum(spare, np.maximum(0, over - (np.cumsum(spare) - spare)))
        freq[order] -= cut
        over -= int(cut.sum())
    return freq


def _lanes(n: int) -> int:
    return 1 << max(0, min(10, (max(n, 1) // 64).bit_length() - 1))


def encode(ids: np.ndarray, table: Table, interval: int = 1 << 17) -> bytes:
    """One block of ids."""
    n, lanes = len(ids), _lanes(len(ids))
    interval = max(lanes, interval // lanes * lanes)
    steps = -(-n // lanes)
    f_all, s_all = table.freq[ids], table.start[ids]
    if n and not f_all.all():
        raise ValueError("an id is not in the table")
    state = np.full(lanes, _LOW, dtype=np.uint64)
    bits, shift = np.uint64(table.bits), np.uint64(63 - table.bits)
    per_piece = interval // lanes
    parts: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    emitted = 0
    for step in range(steps - 1, -1, -1):
        lo = step * lanes
        m = min(lanes, n - lo)
        f, s, x = f_all[lo : lo + m], s_all[lo : lo + m], state[:m]
        full = x >= (f << shift)
        if full.any():
            out = x[full].astype(np.uint32)[::-1]
            parts.append(out)
            emitted += len(out)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:m] = (q << bits) + (x - q * f) + s
        if step % per_piece == 0:
            marks.append((emitted, state.copy()))
    words = np.concatenate(parts)[::-1].astype("<u4") if parts else np.zeros(0, dtype="<u4")
    marks.reverse()
    body = [_HEAD.pack(MAGIC, n, lanes, interval, len(words), len(marks))]
    for k, (done, states) in enumerate(marks):
        piece = ids[k * interval : (k + 1) * interval].astype("<u4")
        body += [_PIECE.pack(len(words) - done, zlib.crc32(piece.tobytes())), states.astype("<u8").tobytes()]
    body.append(words.tobytes())
    raw = b"".join(body)
    return raw + struct.pack("<I", zlib.crc32(raw))


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of pieces ``first`` to ``last`` (all of the block by default), checked."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum")
    magic, n, lanes, interval, n_words, pieces = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at, size = _HEAD.size, _PIECE.size + 8 * lanes
    words = np.frombuffer(block, dtype="<u4", count=n_words, offset=at + size * pieces).astype(np.uint64)
    bits, mask, slots = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), table.slots
    out = []
    for k in range(first, pieces if last is None else min(last, pieces)):
        pos, crc = _PIECE.unpack_from(block, at + size * k)
        state = np.frombuffer(block, dtype="<u8", count=lanes, offset=at + size * k + _PIECE.size).astype(np.uint64)
        lo, hi = k * interval, min(n, (k + 1) * interval)
        ids = np.empty(hi - lo, dtype=np.uint32)
        for i in range(0, hi - lo, lanes):
            m = min(lanes, hi - lo - i)
            x = state[:m]
            slot = x & mask
            got = slots[slot]
            ids[i : i + m] = got
            x = table.freq[got] * (x >> bits) + slot - table.start[got]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | words[pos : pos + len(low)]
                pos += len(low)
            state[:m] = x
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("piece checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
