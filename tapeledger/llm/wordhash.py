"""Words and shingles of whole Arrow columns as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text hashed at a time
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = 5

_BYTES = np.arange(256, dtype=np.uint8)
IS_SPACE = np.isin(_BYTES, [0x20, 9, 10, 11, 12, 13])
LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit (splitmix64)."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUES = mixed(np.arange(256, dtype=np.uint64), 7)
LOWER_VALUES = VALUES[LOWERED]


# Kept in a plain dictionary: functions travel to the tasks with what they name.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` and one more at least."""
    size = CHUNK + 1
    while size < n + 1:
        size *= 2
    if size not in _POWERS:
        for big in [s for s in _POWERS if s > CHUNK + 1]:
            del _POWERS[big]
        factors = np.full((2, size), [[BASE], [INVERSE]], dtype=np.uint64)
        factors[:, 0] = 1
        _POWERS[size] = tuple(np.cumprod(factors, axis=1))
    return _POWERS[size]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of groups of rows of about ``size`` bytes; a longer text comes alone."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, start and end of every run of bytes other than white space; no word crosses rows."""
    parts = [_words(data[a:b], a, offsets, lower) for a, b in _pieces(data)]
    if len(parts) == 1:
        return parts[0]
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty, empty.astype(np.uint64), empty, empty)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at white space, for a text much longer than a chunk."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + 2 * CHUNK)
        while b < n and not IS_SPACE[data[b - 1]]:
            ahead = IS_SPACE[data[b : b + CHUNK]]
            b = b + int(np.argmax(ahead)) + 1 if ahead.any() else min(n, b + CHUNK)
        yield a, b
        a = b


def _words(data: np.ndarray, at: int, offsets: np.ndarray, lower: bool):
    n = len(data)
    space = IS_SPACE[data]
    edges = offsets[(offsets >= at) & (offsets < at + n)] - at
    fresh = np.empty(n, bool)
    fresh[0], fresh[1:] = True, space[:-1]
    fresh[edges] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, space[1:]
    last[edges[edges > 0] - 1] = True
    starts, ends = np.flatnonzero(fresh & ~space), np.flatnonzero(last & ~space) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER_VALUES if lower else VALUES)[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts], 1)
    rows = np.searchsorted(offsets, starts + at, side="right") - 1
    return rows, hashes, starts + at, ends + at


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``k`` words; a row of fewer words is one run, without words none."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    long = max(0, len(hashes) - k + 1)
    runs = np.zeros(long, np.uint64)
    for i in range(k):
        runs = mixed(runs * np.uint64(3) + hashes[i : i + long], 2 + i)
    for row in range(n_rows):
        a, b = int(bounds[row]), int(bounds[row + 1])
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                short = mixed(short * np.uint64(3) + h, 100 + b - a)
            yield short
        else:
            yield np.zeros(0, np.uint64)
