"""Audio files: what their headers say, without decoding."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.functions.tags import comment_fields
from tapeledger.operators.inventory import split_readable, union_sets
from tapeledger.schemas import PROBE_FIELDS
from tapeledger.session import union_all
from tapeledger.sources.columns import flac_columns
from tapeledger.sources.opening import list_files, map_files, read_exact

CHUNK = 1 << 20
# Plain and extensible PCM.
PCM_TAGS = (0x0001, 0xFFFE)


def flac_facts(f) -> dict:
    """The stream block, and the comment block if there is one; other blocks are skipped."""
    if read_exact(f, 4) != b"fLaC":
        raise ValueError("NOT_FLAC_DATA")
    stream = comments = vendor = None
    last = False
    while not last and (stream is None or comments is None):
        head = f.read(4)
        if len(head) < 4:
            break
        last, kind, size = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:], "big")
        if kind == 0:
            block = read_exact(f, size)
            packed = int.from_bytes(block[10:18], "big")
            frames, md5 = packed & ((1 << 36) - 1), block[18:34]
            stream = {
                "sample_rate": packed >> 44,
                "channels": ((packed >> 41) & 7) + 1,
                "bits_per_sample": ((packed >> 36) & 31) + 1,
                "total_frames": frames or None,
                "audio_md5": md5.hex() if any(md5) else None,
            }
        elif kind == 4:
            vendor, comments = vorbis_comments(read_exact(f, size))
        else:
            f.seek(size, 1)
    if stream is None:
        raise ValueError("NO_STREAMINFO")
    return {"stream": stream, "encoder": vendor or None, "comments": list((comments or {}).items())}


def vorbis_comments(block: bytes) -> tuple[str, dict[str, list[str]]]:
    """Vendor and comments; keys in upper case, repeated keys in file order."""
    at = 0

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<I", block, at)
        at += 4 + n
        if at > len(block):
            raise ValueError("TRUNCATED")
        return block[at - n : at].decode("utf-8", "replace")

    try:
        vendor, found = text(), {}
        (count,) = struct.unpack_from("<I", block, at)
        at += 4
        for _ in range(count):
            key, _, value = text().partition("=")
            found.setdefault(key.upper(), []).append(value)
    except struct.error:
        raise ValueError("TRUNCATED") from None
    return vendor, found


def wav_facts(f) -> dict:
    """Walk the chunks to ``fmt `` and ``data``; unknown ones are skipped, odd ones are padded."""
    riff = read_exact(f, 12)
    if riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("NOT_RIFF_WAVE")
    shape = data = None
    at = 12
    while shape is None or data is None:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            break
        size = int.from_bytes(head[4:], "little")
        if head[:4] == b"fmt ":
            if size < 16:
                raise ValueError("SHORT_FMT")
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read_exact(f, 16))
            if tag not in PCM_TAGS:
                raise ValueError("NOT_PCM")
            if not 0 < channels < 256:
                raise ValueError("BAD_CHANNELS")
            if not 0 < bits < 256:
                raise ValueError("BAD_BITS")
            shape = (channels, rate, bits)
        elif head[:4] == b"data":
            data = (at + 8, size)
        at += 8 + size + (size & 1)
    if shape is None:
        raise ValueError("NO_FMT")
    if data is None:
        raise ValueError("NO_DATA")
    channels, rate, bits = shape
    stream = {
        "sample_rate": rate,
        "channels": channels,
        "bits_per_sample": bits,
        "total_frames": data[1] // (channels * -(-bits // 8)),
        "audio_md5": None,
    }
    return {"stream": stream, "data_offset": data[0], "data_len": data[1]}


def read_flac_headers(files: DataFrame) -> DataFrame:
    """Rate, channels, bits, frames, stored digest, encoder and comments of FLAC files."""
    return map_files(files, lambda _row, f: flac_facts(f), PROBE_FIELDS, flac_columns)


def read_wav_headers(files: DataFrame) -> DataFrame:
    return map_files(files, lambda _row, f: wav_facts(f), PROBE_FIELDS)


def probe(files: DataFrame) -> DataFrame:
    """Either kind, by the ``format`` column."""
    return map_files(files, lambda row, f: flac_facts(f) if row["format"] == "FLAC" else wav_facts(f), PROBE_FIELDS)


def _inventoried(files: DataFrame, bare: bool) -> tuple[DataFrame, DataFrame]:
    unlisted = files.filter(F.col("reason").isNotNull()).select("path", F.lit(None).cast("string").alias("format"), "reason")
    good, bad = split_readable(files.filter(F.col("reason").isNull()).drop("reason"), bare)
    probed = probe(good)
    failed = probed.filter(F.col("reason").isNotNull())
    shape = ["path", "format", "reason"]
    return (
        probed.filter(F.col("reason").isNull()).drop("reason"),
        union_sets(bad.select(shape), failed.select(shape), unlisted),
    )


def scan_inventory(spark: SparkSession, root: str, recursive: bool = True, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every audio file under ``root`` (as ``listed``, if that is known), and those that could not be used with the reason.

    Both come from one lazily planned scan; write the inventory before reading it often.
    """
    return _inventoried(list_files(spark, root, recursive) if listed is None else listed, bare=False)


def collect_paths(
    spark: SparkSession, folders: list[str], files: list[str], recursive: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Folders are scanned, bare files are taken as they are; nothing is deduplicated."""
    parts = [scan_inventory(spark, folder, recursive) for folder in folders]
    if files:
        parts.append(_inventoried(list_files(spark, files), bare=True))
    return union_sets(*[p[0] for p in parts]), union_sets(*[p[1] for p in parts])


def read_tags(inventory: DataFrame) -> DataFrame:
    """The nine fields of probed files; other formats carry no such comments."""
    flac = F.col("format") == "FLAC"
    # Each a column of its own, so that those nobody asks for are not looked up.
    fields = [F.when(flac, value).alias(field) for field, value in comment_fields(F.col("comments")).items()]
    return inventory.select(*inventory.columns, F.when(flac, "OK").otherwise("NOT_TAGGABLE").alias("tag_status"), *fields)


def _md5(f, start: int, size: int | None) -> str:
    f.seek(start)
    hasher, left = hashlib.md5(), size
    while left is None or left > 0:
        data = f.read(CHUNK if left is None else min(CHUNK, left))
        if not data:
            break
        hasher.update(data)
        left = None if left is None else left - len(data)
    if left:
        raise ValueError("TRUNCATED")
    return hasher.hexdigest()


def file_digests(files: DataFrame) -> DataFrame:
    """MD5 of each file's bytes, and of a WAV's audio alone (``data_offset``, ``data_len``).

    Files are read a chunk at a time, each by one task.
    """

    def read(row: dict, f) -> dict:
        audio = row.get("data_len")
        return {
            "file_md5": _md5(f, 0, None),
            "st5": None if audio is None else _md5(f, row["data_offset"], audio),
        }

    return map_files(files, read, "file_md5 string, st5 string, reason string")


def read_chunks(files: DataFrame, chunk_bytes: int = 1 << 24) -> DataFrame:
    """Cut files into ranges and read each range in its own row, so a huge file is read by
    many tasks. ``files``: ``set_id, path, start, length, is_pad``; padding is not read."""
    step = F.lit(chunk_bytes).cast("long")
    ranges = files.filter(F.col("length") > 0).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step))
    )
    kept = [c for c in ("ordinal", "piece_length") if c in files.columns]
    cut = ranges.select(
        "set_id", *kept, "path", "is_pad", "_from",
        (F.col("start") + F.col("_from")).alias("start"),
        F.least(step, F.col("length") - F.col("_from")).alias("length"),
    )

    def read(row: dict, f) -> dict:
        f.seek(row["_from"])
        return {"content": read_exact(f, row["length"])}

    real = map_files(cut.filter(~F.col("is_pad")).repartition("path", "_from"), read, "content binary, reason string")
    pads = cut.filter("is_pad").withColumns({"content": F.lit(None).cast("binary"), "reason": F.lit(None).cast("string")})
    return union_all(real, pads).drop("_from")
