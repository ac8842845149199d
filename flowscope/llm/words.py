"""Words, lines and hashes of Arrow text columns, taken from their UTF-8 bytes with numpy.

Texts are handled in pieces of a few megabytes, so a task needs memory for one piece or for one very long text, not
for a whole partition. A null text has no words, like an empty one.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
HASH_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def worker_store() -> dict:
    """A dictionary which lives as long as the Python worker, for tables that are costly to build."""
    return sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__


def release_memory() -> None:
    """Give memory that is no longer used back to the system, since an idle worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def release_tables() -> None:
    """Forget the tables of :func:`worker_store`; for a stage that needs none after one that built them in this worker."""
    store = worker_store()
    for name in [k for k in store if not (isinstance(k, str) and k.startswith("__"))]:
        del store[name]
    release_memory()


def space_separated() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the offset of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = PIECE_BYTES) -> Iterator:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes within each text, and the first run of each text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    opens[borders] = inside[borders]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    store = worker_store()
    held = store.get("powers")
    if held is None or len(held[0]) < n:
        size = max(n, HASH_BYTES + 4096)
        with np.errstate(over="ignore"):
            made = []
            for base in (BASE, INVERSE):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                made.append(np.multiply.accumulate(factors))
        held = tuple(made)
        if size <= 4 * HASH_BYTES:
            store["powers"] = held
    return held


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def symbol_table(size: int, seed: int) -> np.ndarray:
    """A fixed random 64-bit value for each symbol."""
    store = worker_store()
    if ("symbols", size, seed) not in store:
        store["symbols", size, seed] = np.random.default_rng(seed).integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    return store["symbols", size, seed]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``data[start:end]``; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        high = ends[last - 1]
        power, inverse = _powers(int(high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(symbols[data[low:high]] * power[: high - low], out=total[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (total[b] - total[a]) * inverse[a]
        first = last
    return mixed(out)


def rolling(h: np.ndarray, k: int, step: int = STEP) -> np.ndarray:
    """Hash of each ``k`` consecutive values; entry ``i`` covers ``i .. i + k - 1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(step)
        out += h[j : j + n]
    return mixed(out)


def whole_windows(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which windows ``i .. i + k - 1`` of ``n`` words lie in one text; ``first`` is the first word of each text."""
    count = max(0, n - k + 1)
    valid = np.zeros(count, bool)
    if count:
        last = np.repeat(first[1:], np.diff(first))[:count]
        valid = np.arange(count) + k <= last
    return valid


def covered(marked: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words of ``n`` which lie in a marked window of ``k`` words."""
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(marked)
    np.add.at(change, at, 1)
    np.subtract.at(change, np.minimum(at + k, n), 1)
    return np.cumsum(change[:n]) > 0


class Texts:
    """Words of the texts of one piece."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, kind: str = "space", lower: bool = False):
        self.data, self.offsets = text_bytes(column)
        if lower or kind == "alnum":
            self.data = lower_ascii()[self.data]
        self.inside = (space_separated() if kind == "space" else alphanumeric())[self.data]
        self.starts, self.ends, self.first = spans(self.data, self.offsets, self.inside)
        self.n_words = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, symbol_table(256, seed))

    def per_text(self, marked: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        total = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=total[1:])
        return np.diff(total[self.offsets])

    def words_per_text(self, marked: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=total[1:])
        return np.diff(total[self.first])
