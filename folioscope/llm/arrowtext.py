"""Vectorised views of Arrow text batches, shared by the operators of this subpackage.

Everything here runs inside ``mapInArrow`` tasks on bounded chunks of rows: a
chunk holds at most ``CHUNK_BYTES`` of text, or one document if that is longer.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def releasing(step: Callable) -> Callable:
    """A task's function over batches, after which freed memory goes back to the system.

    Python workers stay alive between tasks and would keep it, beside those that work.
    """

    @wraps(step)
    def stepped(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return stepped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i in 0..n-1; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (max(n, 1) - 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _POWERS[base] = have = table
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows within ``limit`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row of each word; words never cross rows."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < n]
    before[row_starts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[row_starts[row_starts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inner = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = _BYTE[data[inner + np.repeat(starts, lengths)]]
    values *= powers(_BASE, int(lengths.max()))[inner]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def rolling(values: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(inverse(base), n))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[:n], out[width - have : width - have + n]) if have < width else out


def binary_column(blobs: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column from concatenated bytes and the length of each value."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(blobs).tobytes())])


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many slices of ``data``, one after another."""
    if len(starts) == 0:
        return data[:0]
    first = np.cumsum(lengths) - lengths
    return data[np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - first, lengths)]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal integer ``keys``, from batches sorted by them; one group is held at a time."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(len(table), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), len(table)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part = table.slice(lo, hi - lo)
            if held is not None and lo == 0 and all(held.column(k)[0] == table.column(k)[0] for k in keys):
                held = pa.concat_tables([held, part])
                continue
            if held is not None:
                yield held
            held = part
    if held is not None:
        yield held
