"""Token ids of many texts from the ids of their distinct units.

Where a tokenizer never joins characters across some cut, the ids of a text are the ids of its units in
order.  Arrow splits and dictionary-encodes the units of a batch, the tokenizer sees each distinct unit
once, and numpy expands ids by index.  Units met before come from a cache that is emptied when it holds
``most`` units.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa


class UnitIds:
    """Ids by unit, with a bounded cache."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], most: int = 300_000):
        """``encode`` gives, for runs of the units it is given, all ids and the number of ids of each unit."""
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        """Empties the cache."""
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)

    def _add(self, units: list[str]) -> None:
        found = self.encode(units)
        sizes = np.concatenate([n for _, n in found])
        total, at = int(sizes.sum()), len(self.index)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(units) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + total] = np.concatenate([ids for ids, _ in found])
        self.start[at : at + len(units)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(units)] = sizes
        self.used += total
        self.index.update(zip(units, range(at, at + len(units)), strict=True))

    def lookup(self, units: list[str]) -> np.ndarray:
        """The cache's index of each distinct unit."""
        if len(self.index) > self.most:
            self.forget()
        new = [u for u in units if u not in self.index]
        if new:
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, units), dtype=np.int64, count=len(units))

    def ids(self, lists: pa.ListArray, rename: Callable[[list[str]], list[str]] = lambda x: x) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows of units, and the offsets of the rows in them."""
        offsets = lists.offsets.to_numpy() if len(lists) else np.zeros(1, dtype=np.int64)
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(lists) + 1, dtype=np.int64)
        at = self.lookup(rename(flat.dictionary.to_pylist()))[flat.indices.to_numpy()]
        size = self.size[at]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) + np.repeat(self.start[at] - (ends - size), size)
        return self.flat[place], np.concatenate([[0], ends])[offsets - offsets[0]]


def by_bytes(column: pa.Array, most: int = 4 << 20):
    """Slices ``(begin, end)`` of a string column of about ``most`` bytes each; a longer text is alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def settle() -> None:
    """Gives memory that a task no longer needs back to the system, as Spark keeps workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
