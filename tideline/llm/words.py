"""Words of many texts at once, as arrays.

A text is lower-cased in A-Z only and cut into words ``[^\x20\x09-\x0D]+``.
All work is on the UTF-8 bytes of a whole Arrow column: word bounds come from
masks, and a word's 64-bit hash from prefix sums of per-byte random numbers
weighted by powers of an odd constant, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tideline.llm.store import dropped_at_end

U64 = np.uint64
#: Texts that are worked on together at most.
MOST_ROWS = 2000
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=U64)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_WEIGHTS = _random.integers(1, 2**63, 64, dtype=U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = dropped_at_end({})


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < n:
        size = max(n, 2 * len(known) if known is not None else 0, 1 << 16)
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, U64)
        steps[0] = 1
        known = _powers[kind] = np.cumprod(steps, dtype=U64)
    return known[:n]


@dataclass
class Words:
    """Word ``i`` is ``data[start[i]:end[i]]`` of text ``doc[i]``; text ``d`` has words ``first[d]:first[d+1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    prefix: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """Case-folded 64-bit hash of each word."""
        return self.span_hashes(self.start, self.end)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
        values = (_BYTE_FOLDED if fold else _BYTE)[self.data]
        values *= _power("up", len(values))
        prefix = np.empty(len(values) + 1, U64)
        prefix[0] = 0
        np.cumsum(values, out=prefix[1:])
        h = (prefix[end] - prefix[start]) * _power("down", len(values) + 1)[start]
        return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text bounds of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), none)
    inside = ~IS_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1:-1]
    closes[:-1] &= ~inside[1:] | begins[1:-1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, first, doc)


def words_of(column: pa.Array) -> Words:
    return find_words(*column_bytes(column))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words inside a text, and the number of each window's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = hashes[:n] * _WEIGHTS[0]
    for k in range(1, size):
        total += hashes[k : n + k] * _WEIGHTS[k]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[at]), at


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has few rows and few bytes of text; a longer text may exceed the bytes."""
    if batch.num_rows == 0:
        return
    sizes = np.diff(column_bytes(batch.column(batch.schema.get_field_index(text)))[1])
    piece = np.cumsum(sizes) // most_bytes + np.arange(batch.num_rows) // MOST_ROWS
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have items at all, and where their items begin (for ``reduceat``)."""
    full = np.flatnonzero(np.diff(first))
    return full, first[full]
