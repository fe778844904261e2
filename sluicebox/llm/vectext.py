"""Vectorised text helpers for Arrow batches: flat bytes, word spans, rolling hashes.

Tasks hand over an Arrow string column; everything below works on the column's
contiguous byte buffer, so that no Python object is made per word.  A batch is
cut into slices of bounded bytes first, which bounds the memory of a task
whatever the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task handles at once.
SLICE_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves every other byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_word_table() -> np.ndarray:
    """Which bytes belong to a word of the class [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, dtype=bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def alnum_word_table() -> np.ndarray:
    """Which bytes belong to a word of digits, ASCII letters (either case) and non-ASCII characters."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = True
    t[128:] = True
    return t


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the worker's life while it is small."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def as_text(column) -> pa.Array:
    """The column as one Arrow string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text has max_bytes together at most (one longer row stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # workers share an executor's memory with its JVM


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of the rows) of a string column; null is empty."""
    arr = as_text(column)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=arr.offset + len(arr) + 1)[arr.offset :]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each row the index of its first word.

    ``first`` has one entry more than there are rows.  Words never cross rows.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = table[data]
    brk = np.zeros(n + 1, dtype=bool)
    brk[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = w[:-1]
    before &= ~brk[:n]
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = w[1:]
    after &= ~brk[1:]
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the bytes stand."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_MULT, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INV, n + 1)[starts])


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` consecutive word hashes (rows are not told apart here)."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers(_MULT, n), out=sums[1:])
    at = np.arange(n - size + 1)
    return mix((sums[size:] - sums[:-size]) * powers(_INV, n + 1)[at])


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word the row that holds it."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
