"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Arrow hands over a column's bytes and offsets; nothing here makes a Python string
per word. Word separators are ASCII, so no byte inside a longer character is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one step; a longer text is a step of its own.
STEP = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, STEP + 1)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _ODD, np.uint64))]).astype(np.uint64)
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _INVERSE, np.uint64))]).astype(np.uint64)
        return self.up, self.down


POWERS = Powers()


def trimmed(run):
    """``run`` (batches to batches) that gives freed memory back to the system at its end.

    Python workers outlive their tasks; without this each keeps the peak of what it ran.
    """

    def around(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return around


def steps(column: pa.Array, size: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``size`` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of some texts: start and end bytes, the text each belongs to, and its 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> None:
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        n = len(data)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[:n] = inside
        edge[1:] ^= inside
        # A text's first byte may follow the last text's word directly.
        firsts = offsets[1:-1]
        firsts = firsts[(firsts > 0) & (firsts < n)]
        joined = np.unique(firsts[inside[firsts] & inside[firsts - 1]]) if len(firsts) else firsts
        at = np.flatnonzero(edge)
        self.starts, self.ends = at[0::2], at[1::2]
        if len(joined):
            self.starts = np.sort(np.concatenate([self.starts, joined]))
            self.ends = np.sort(np.concatenate([self.ends, joined]))
        self.inside = inside
        self.per_doc = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.per_doc)
        self.fold = fold

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = POWERS.get(n + 1)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(_VALUE[_FOLD[self.data] if self.fold else self.data] * up[:n], out=total[1:])
            return mixed((total[self.ends] - total[self.starts]) * down[self.starts])

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, text) of every run of k words within one text."""
        size = np.maximum(self.counts - k + 1, 0)
        doc = np.repeat(np.arange(self.n_docs), size)
        before = np.cumsum(size) - size
        first = np.arange(len(doc)) - before[doc] + self.per_doc[:-1][doc]
        m = len(hashes) - k + 1
        if m <= 0 or not len(first):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            run = hashes[:m].copy()
            for j in range(1, k):
                run *= _ODD
                run += hashes[j : m + j]
            return mixed(run[first]), first, doc


def repeated_within(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each entry, whether its text has the same key twice or more."""
    out = np.zeros(len(keys), bool)
    if not len(keys):
        return out
    with np.errstate(over="ignore"):
        both = keys ^ mixed(doc.astype(np.uint64) + _ODD)
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out
