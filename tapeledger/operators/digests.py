"""Digests over bytes laid end to end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_bytes(parts: Column, field: str) -> Column:
    """Concatenate one binary field of an ordered array of short parts; linear however many there are."""
    few = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p[field]))
    many = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p[field])), ""))
    return F.when(F.size(parts) <= 8, few).otherwise(many)


def chained_sha1(parts: DataFrame, key: str, order: Sequence[str], data: str) -> DataFrame:
    """SHA-1 of each key's parts in order, as ``key, bytes, sha1``.

    The hash of a concatenation is a chain, so one task walks a key's parts; it holds one
    batch at a time and never the whole document.
    """
    key_type = parts.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hasher, size, started = None, hashlib.sha1(), 0, False

        def row():
            return pa.RecordBatch.from_pydict(
                {key: [current], "bytes": [size], "sha1": [hasher.hexdigest()]}, schema=schema
            )

        schema = None
        for batch in batches:
            if schema is None:
                kind = batch.schema.field(key).type
                schema = pa.schema([(key, kind), ("bytes", pa.int64()), ("sha1", pa.string())])
            for k, chunk in zip(batch.column(key).to_pylist(), batch.column(data)):
                if started and k != current:
                    yield row()
                    hasher, size = hashlib.sha1(), 0
                current, started = k, True
                chunk = chunk.as_buffer()
                hasher.update(chunk)
                size += chunk.size
        if started:
            yield row()

    return (
        parts.repartition(key)
        .sortWithinPartitions(key, *order)
        .select(key, data)
        .mapInArrow(walk, f"{key} {key_type}, bytes bigint, sha1 string")
    )


def hashed_pieces(slices: DataFrame, algorithm: str = "sha1") -> DataFrame:
    """Digest of each piece of a stream: ``set_id, piece, digest, ordinal``.

    ``slices``: ``set_id, piece, piece_at, bytes, data``; no ``data`` stands for that many zeros. A
    task walks a piece's slices in order and holds one batch of them, so a piece may be of any
    size. Where slices carry a ``reason`` (and ``ordinal``) for not having been read, the piece has
    a row for each such file and no digest.
    """
    told = "reason" in slices.columns
    key_type = slices.schema["set_id"].dataType.simpleString()
    kept = [F.col(c) for c in ("set_id", "piece", "piece_at", "bytes", "data")]
    reason = F.col("reason") if told else F.lit(None).cast("string")
    ordinal = F.col("ordinal").cast("long") if told else F.lit(None).cast("long")
    zeros = bytes(1 << 16)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hasher, bad, schema = None, None, set(), None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("set_id", batch.schema.field("set_id").type), ("piece", pa.int64()), ("digest", pa.string()), ("ordinal", pa.int64())])
            done = []
            for a, b in stretches(batch):
                key = (batch.column("set_id")[a].as_py(), batch.column("piece")[a].as_py())
                if key != current:
                    if current is not None:
                        done += ended(current, hasher, bad)
                    current, hasher, bad = key, hashlib.new(algorithm), set()
                part = batch.slice(a, b - a)
                fed(hasher, part, bad)
            yield packed(done, schema)
        if current is not None:
            yield packed(ended(current, hasher, bad), schema)

    def stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """First and last row (excluded) of each piece in a batch."""
        codes = batch.column("set_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        pieces = batch.column("piece").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero((np.diff(codes, prepend=codes[:1] - 1) != 0) | (np.diff(pieces, prepend=pieces[:1] - 1) != 0)).tolist() if len(codes) else []
        yield from zip(starts, [*starts[1:], len(codes)])

    def fed(hasher, part: pa.RecordBatch, bad: set) -> None:
        """The bytes of a piece's slices, which lie one after the other in the column."""
        data, reasons = part.column("data"), part.column("reason")
        if reasons.null_count < len(reasons):
            bad.update(o for o, r in zip(part.column("ordinal").to_pylist(), reasons.to_pylist()) if r is not None)
        elif data.null_count == 0:
            _, offsets, content = data.buffers()
            ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(data.type) else np.int32)
            if content is not None:
                hasher.update(memoryview(content)[ends[data.offset] : ends[data.offset + len(data)]])
        else:
            for size, slice_ in zip(part.column("bytes").to_pylist(), data):
                if slice_.is_valid:
                    hasher.update(slice_.as_buffer())
                else:
                    for at in range(0, size, len(zeros)):
                        hasher.update(zeros[: size - at])

    def ended(key, hasher, bad):
        return [(*key, None, o) for o in sorted(bad)] if bad else [(*key, hasher.hexdigest(), None)]

    def packed(rows, schema):
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return (
        slices.select(*kept, reason.alias("reason"), ordinal.alias("ordinal"))
        .repartition("set_id", "piece")
        .sortWithinPartitions("set_id", "piece", "piece_at")
        .mapInArrow(walk, f"set_id {key_type}, piece bigint, digest string, ordinal bigint")
    )


def tree_digest(pieces: DataFrame, keys: Sequence[str], index: str, digest: str, fan_in: int = 1 << 16, levels: int = 4) -> DataFrame:
    """Fold ordered piece digests into one per key, ``fan_in`` at a time.

    Two streams cut on the same grid are equal exactly when their trees are, and unlike one
    long chain a tree is computed by many tasks. Four levels of 2^16 cover every piece number
    there is, so a key always has one root.
    """
    level = pieces.select(*keys, F.col(index).alias("_i"), F.col(digest).alias("_d"))
    for _ in range(levels):
        pairs = F.array_sort(F.collect_list(F.struct("_i", "_d")))
        level = (
            level.withColumn("_g", F.floor(F.col("_i") / fan_in).cast("long"))
            .groupBy(*keys, "_g")
            .agg(F.md5(F.array_join(F.transform(pairs, lambda p: p["_d"]), "")).alias("_d"))
            .withColumnRenamed("_g", "_i")
        )
    return level.select(*keys, F.col("_d").alias("tree_md5"))
