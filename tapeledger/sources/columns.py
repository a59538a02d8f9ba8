"""FLAC headers of a whole batch of contents, column by column.

Only regular headers are told here; ``flac_facts`` reads what is left, so both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Blocks, and comments, followed by column; a file with more is left.
STEPS = 64
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint16)


def _number(data: np.ndarray, at: np.ndarray, width: int, little: bool = False) -> np.ndarray:
    n = np.zeros(len(at), np.int64)
    for i in reversed(range(width)) if little else range(width):
        n = n << 8 | data[at + i]
    return n


def _cut(data: pa.Buffer, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between ascending places; those between two cuts are values that are not taken."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    places = np.stack([starts, ends], axis=1).ravel()
    every = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), data])
    return every.take(pa.array(np.arange(0, len(places), 2)))


def _text(values: pa.Array) -> pa.Array:
    try:
        return values.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values.to_pylist()], pa.large_string())


def _upper(keys: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(keys), min_count=0).as_py():
        return pc.ascii_upper(keys)
    return pa.array([k.upper() for k in keys.to_pylist()], pa.large_string())


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def _grouped(owner: np.ndarray, keys: pa.Array, values: pa.Array, n: int, failed: pa.Array) -> pa.Array:
    """Maps of key to values; keys by their first place, values in file order."""
    coded = keys.dictionary_encode()
    tag = owner * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(tag, kind="stable")
    new = np.diff(tag[order], prepend=-1) != 0
    first = order[new]
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    group = np.empty(len(tag), np.int64)
    group[order] = rank[np.cumsum(new) - 1]
    first.sort()
    lists = pa.ListArray.from_arrays(
        _offsets(np.bincount(group, minlength=len(first))), values.take(pa.array(np.argsort(group, kind="stable"))).cast(pa.string())
    )
    places = _offsets(np.bincount(owner[first], minlength=n))
    return pa.MapArray.from_arrays(places, keys.take(pa.array(first)).cast(pa.string()), lists, mask=failed)


def flac_columns(contents: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Which of the contents are told, and what ``flac_facts`` finds in these; the rest is to be read one by one."""
    n = len(contents)
    given = contents.cast(pa.large_binary())
    _, places, held = given.buffers()
    held = held or pa.py_buffer(b"")
    data = np.frombuffer(held, np.uint8)
    bounds = np.frombuffer(places, np.int64)[given.offset : given.offset + n + 1]
    start, end = bounds[:-1], bounds[1:]

    told = given.is_valid().to_numpy(zero_copy_only=False) & (end - start >= 4)
    strange = np.zeros(n, bool)
    rows = np.flatnonzero(told)
    strange[rows] = _number(data, start[rows], 4) != int.from_bytes(b"fLaC")

    # Blocks: where the two that matter begin and end, -1 without one.
    stream, block, stop = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    rows = np.flatnonzero(told & ~strange)
    at = start[rows] + 4
    for _ in range(STEPS):
        more = at + 4 <= end[rows]
        rows, at = rows[more], at[more]
        kind, size = data[at], _number(data, at + 1, 3)
        last, kind, at = kind >= 128, kind & 127, at + 4
        is_stream, is_block = kind == 0, kind == 4
        cut = at + size > end[rows]
        odd = (is_stream & (cut | (size < 34) | (stream[rows] >= 0))) | (is_block & (cut | (block[rows] >= 0)))
        told[rows[odd]] = False
        stream[rows[is_stream]] = at[is_stream]
        block[rows[is_block]] = at[is_block]
        stop[rows[is_block]] = (at + size)[is_block]
        on = ~odd & ~last & ((stream[rows] < 0) | (block[rows] < 0))
        rows, at = rows[on], (at + size)[on]
        if not len(rows):
            break
    told[rows] = False

    # Comments: the vendor's place, then one comment of every file at a time.
    vendor, vendor_end, count = start.copy(), start.copy(), np.zeros(n, np.int64)
    rows = np.flatnonzero(told & (block >= 0))

    def text_at(rows: np.ndarray, at: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose text lies inside the block with ``room`` bytes behind, and its place; others are left."""
        fits = at + 4 <= stop[rows]
        size = np.zeros(len(rows), np.int64)
        size[fits] = _number(data, at[fits], 4, little=True)
        fits &= at + 4 + size + room <= stop[rows]
        told[rows[~fits]] = False
        return rows[fits], at[fits] + 4, (at + 4 + size)[fits]

    rows, begin, at = text_at(rows, block[rows], 4)
    vendor[rows], vendor_end[rows] = begin, at
    count[rows] = _number(data, at, 4, little=True)
    told[count > STEPS] = False
    at = at + 4
    longest = int(count[told].max(initial=0))
    starts, ends = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64)
    for i in range(longest):
        on = told[rows] & (count[rows] > i)
        rows, begin, at = text_at(rows[on], at[on], 0)
        starts[rows, i], ends[rows, i] = begin, at
    count[~told] = 0
    wanted = np.arange(longest) < count[:, None]
    starts, ends = starts[wanted], ends[wanted]
    equals = pc.find_substring(_cut(held, starts, ends), b"=").to_numpy()
    key_end = np.where(equals < 0, ends, starts + equals)

    missing = stream < 0
    failed = pa.array(strange | missing)
    comments = _grouped(
        np.repeat(np.arange(n), count), _upper(_text(_cut(held, starts, key_end))), _text(_cut(held, np.minimum(key_end + 1, ends), ends)), n, failed
    )
    encoder = _text(_cut(held, vendor, vendor_end))

    facts = np.zeros((n, 24), np.uint8)
    rows = np.flatnonzero(~missing & told)
    facts[rows] = data[stream[rows, None] + np.arange(10, 34)]
    high, low = facts[:, :8].copy().view(">u4").astype(np.int64).T
    frames, md5 = (high & 15) << 32 | low, facts[:, 8:]
    digest = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 32), pa.py_buffer(HEX[md5])])
    unknown = pa.scalar(None, pa.string())
    told_of = {
        "sample_rate": pa.array(high >> 12),
        "channels": pa.array((high >> 9 & 7) + 1, pa.int32()),
        "bits_per_sample": pa.array((high >> 4 & 31) + 1, pa.int32()),
        "total_frames": pa.array(frames, mask=frames == 0),
        "audio_md5": pc.if_else(pa.array(md5.any(axis=1)), digest, unknown),
    }
    found = {
        "stream": pa.StructArray.from_arrays(list(told_of.values()), names=list(told_of), mask=failed),
        "encoder": pc.if_else(pa.array((vendor_end > vendor) & ~strange & ~missing), encoder.cast(pa.string()), unknown),
        "comments": comments,
        "reason": pc.if_else(
            pa.array(strange), pa.scalar("NOT_FLAC_DATA"), pc.if_else(pa.array(missing), pa.scalar("NO_STREAMINFO"), unknown)
        ),
    }
    return told, found if told.all() else {k: v.filter(pa.array(told)) for k, v in found.items()}
