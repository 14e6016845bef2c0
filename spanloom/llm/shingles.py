"""Word and shingle hashes of whole texts, computed over Arrow buffers without a Python loop per word.

Words are maximal runs of bytes other than space and U+0009..U+000D, with A-Z lower-cased.  A word's
hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed; a shingle's hash
combines the hashes of ``width`` words.  Texts with fewer words give one shingle of the whole
sequence; texts without words give none.  Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Bytes hashed at a time; a single longer word is taken whole.
CHUNK = 1 << 19
_P = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INV = pow(_P, -1, 1 << 64)
_U = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of ``x`` over all 64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_byte = mix(np.arange(1, 257, dtype=np.uint64))[_lower]
_weight = mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK * 2)
        for key, base in (("p", _P), ("i", _INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (length rows + 1)."""
    hashes, begins, lo, n = [], [], 0, len(data)
    while lo < n:
        hi = min(n, lo + CHUNK)
        while hi < n:  # cut where a word ends
            gap = np.flatnonzero(_space[data[hi : hi + 65536]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(n, hi + 65536)
        part = data[lo:hi]
        inside = ~_space[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo  # rows that begin in this part
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, inverse = _power(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_byte[part] * p[: len(part)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
        begins.append(start + lo)
        lo = hi
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    b = np.concatenate(begins) if begins else np.zeros(0, dtype=np.int64)
    return h, np.searchsorted(b, at)


def row_shingles(h: np.ndarray, first: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row, from :func:`words`."""
    n = len(h)
    whole = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        whole += h[k : n - width + 1 + k] * _weight[k] if n >= width else 0
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(whole[a : b - width + 1])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            short = (h[a:b] * _weight[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + _weight[width + b - a]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a string column."""
    return row_shingles(*words(*utf8(column)), width)
