"""Vectorised work on the UTF-8 bytes of Arrow string columns, shared by the operators.

A block is a run of rows held as one ``uint8`` array and ``offsets`` (rows + 1). Null texts are empty.
Hashes are 64 bits wide: a polynomial over the bytes, finished by a strong mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
HASHED_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
WORD_CODE = BYTE_CODE[LOWER].copy()
WORD_CODE[SPACE] = 0

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, _U)
        table[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:n]


def powers(n: int) -> np.ndarray:
    return _power_table(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _power_table(pow(_BASE, -1, 2**64), n)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES, rows: int = 60_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text and at most ``rows`` rows each (a longer text stands alone)."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(n, at + rows, max(to, at + 1))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    data = offsets = batch = None
    released()


def released() -> None:
    """Gives back what this Python worker no longer uses, for it lives on beside the next stage's work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words of each row) of all ``[^\\x20\\x09-\\x0D]+``; none crosses rows."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word with A-Z lower-cased. Words are hashed HASHED_BYTES at a time (a longer word alone), so
    that the tables of powers stay small; a hash does not depend on where its word stands."""
    if not len(start):
        return np.zeros(0, _U)
    if end[-1] - start[0] > HASHED_BYTES and len(start) > 1:
        out, at = [], 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + HASHED_BYTES, "right")))
            low = start[at]
            out.append(word_hashes(data[low : end[to - 1]], start[at:to] - low, end[at:to] - low))
            at = to
        return np.concatenate(out)
    weighted = WORD_CODE[data]
    weighted *= powers(len(data))
    sums = np.add.reduceat(weighted, start)
    # what lies between a word's end and the next start is white space, which counts nothing
    sums *= inverse_powers(len(data))[start]
    return mix(sums + (end - start).astype(_U))


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a row with fewer words has its whole sequence, one without words none."""
    n, row = len(hashes), row_of(counts)
    if not n:
        return hashes, row
    # a word's own multiplier depends on its place in the run
    multipliers = mix(np.arange(1, size + 1, dtype=_U) * _U(_BASE)) | _U(1)
    run = np.zeros(n, _U)
    for j in range(size):
        run[: max(0, n - j)] += hashes[j:] * multipliers[j] if j else hashes * multipliers[0]
    first = np.cumsum(counts) - counts
    within = np.arange(n) - first[row]
    whole = within + size <= counts[row]
    out, at = mix(run[whole]), row[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), _U)
        for j in range(size - 1):
            has = counts[short] > j
            extra[has] += hashes[first[short[has]] + j] * multipliers[j]
        extra = mix(extra + counts[short].astype(_U))
        out, at = np.concatenate([out, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def distinct_per_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their numbers."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[keep], row[keep]
    return values, np.bincount(row, minlength=rows)
