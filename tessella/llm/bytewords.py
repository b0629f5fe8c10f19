"""Words and shingles of many texts at once, on the UTF-8 bytes that Arrow holds.

Both word rules of the operators speak of single bytes below 0x80 and count every byte of a longer
character as part of a word, so that words can be found on bytes without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MIX = U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(7)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0xD6E8FEB86659FD93)
CHUNK = 2 << 20


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    for a, b in separators:
        t[a : b + 1] = 0
    return t


#: Words are runs of anything but white space; A-Z lower-cased. A zero byte stands for a separator,
#: so the byte 0x00, which is a word character here, is read as 0xFF (never found in UTF-8).
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
SPACED[0] = 0xFF
#: Words are runs of digits, a-z and everything beyond ASCII; A-Z lower-cased.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = U(1)
    return np.cumprod(p, dtype=np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows of about ``most`` bytes."""
    data, offsets = buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of the first word of each row, with the total at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    b = table[data]
    on = b != 0
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(on[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    first &= on
    where = np.flatnonzero(first)
    if len(where) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    c = b[on]
    starts = np.flatnonzero(first[on])
    lens = np.diff(np.append(starts, len(c)))
    k = np.arange(len(c)) - np.repeat(starts, lens)
    h = np.add.reduceat(BYTE[c] * powers(STEP, int(lens.max()))[k], starts)
    return mix(h + lens.astype(np.uint64) * MIX), np.searchsorted(where, offsets)


def shingles(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in order, first shingle of each row). A row of fewer words has one shingle, of them all."""
    counts = np.diff(rows)
    p = powers(STEP, size)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.empty(at[-1], np.uint64)
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            s += h[j : j + len(s)] * p[j]
        full = np.repeat(counts >= size, out_counts)
        start = np.repeat(rows[:-1] - at[:-1], out_counts) + np.arange(at[-1])
        out[full] = s[start[full]]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[rows[r] : rows[r + 1]]
        out[at[r]] = np.sum(own * p[: len(own)] + MIX, dtype=np.uint64)
    return mix(out), at
