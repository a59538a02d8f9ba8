"""Torrent documents as nested rows, and the tables exploded from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.functions.formats import is_padding
from tapeledger.functions.tags import announce_tiers
from tapeledger.schemas import TORRENT_FIELDS
from tapeledger.session import union_all
from tapeledger.sources.opening import list_files, map_files


def bdecode(data: bytes, at: int, spans: dict[bytes, tuple[int, int]] | None = None):
    """One value and where it ends. Keys must be sorted and unique, numbers canonical.

    ``spans`` collects where the values of the outermost dictionary lie.
    """
    kind = data[at : at + 1]
    if kind == b"i":
        end = data.find(b"e", at)
        text = data[at + 1 : max(end, 0)]
        if not text.removeprefix(b"-").isdigit() or str(int(text)).encode() != text:
            raise ValueError("BENCODE")
        return int(text), end + 1
    if kind == b"l":
        at, items = at + 1, []
        while data[at : at + 1] != b"e":
            value, at = bdecode(data, at)
            items.append(value)
        return items, at + 1
    if kind == b"d":
        at, found, before = at + 1, {}, None
        while data[at : at + 1] != b"e":
            key, at = bdecode(data, at)
            if not isinstance(key, bytes) or (before is not None and key <= before):
                raise ValueError("UNSORTED_KEYS")
            start = at
            found[key], at = bdecode(data, at)
            if spans is not None:
                spans[key] = (start, at)
            before = key
        return found, at + 1
    colon = data.find(b":", at)
    size = data[at : max(colon, 0)]
    if not size.isdigit() or (size[:1] == b"0" and size != b"0") or colon + 1 + int(size) > len(data):
        raise ValueError("BENCODE")
    return data[colon + 1 : colon + 1 + int(size)], colon + 1 + int(size)


def _typed(value, kind, absent=None):
    if value is None:
        return absent
    if not isinstance(value, kind):
        raise ValueError("BENCODE")
    return value


def _text(value) -> str | None:
    value = _typed(value, bytes)
    return None if value is None else value.decode("utf-8", "replace")


def _whole(value, negative: bool = False) -> int | None:
    value = _typed(value, int)
    if value is not None and not (-(1 << 63) if negative else 0) <= value < 1 << 63:
        raise ValueError("NUMBER_RANGE")
    return value


def torrent_facts(f) -> dict:
    """The document as it stands; its identity is the hash of the original ``info`` bytes."""
    data, spans = f.read(), {}
    try:
        top, _ = bdecode(data, 0, spans)
    except (IndexError, RecursionError):
        raise ValueError("BENCODE") from None
    top = _typed(top, dict)
    info = _typed(top.get(b"info"), dict)
    if info is None:
        raise ValueError("NO_INFO")
    files = _typed(info.get(b"files"), list)
    entries = None
    if files is not None:
        entries = []
        for entry in files:
            entry = _typed(entry, dict)
            parts = [_text(p) for p in _typed(entry.get(b"path"), list, [])]
            size = _whole(entry.get(b"length"))
            if b"path" not in entry or size is None:
                raise ValueError("FILE_ENTRY")
            entries.append({"path_parts": parts, "length": size, "attr": _text(entry.get(b"attr"))})
    start, end = spans[b"info"]
    tiers = _typed(top.get(b"announce-list"), list)
    return {
        "name": _text(info.get(b"name")),
        "piece_length": _whole(info.get(b"piece length")),
        "pieces": _typed(info.get(b"pieces"), bytes),
        "length": _whole(info.get(b"length")),
        "files": entries,
        "meta_version": _whole(info.get(b"meta version"), negative=True),
        "private": _whole(info.get(b"private"), negative=True) not in (None, 0),
        "source": _text(info.get(b"source")),
        "announce": _text(top.get(b"announce")),
        "tiers": None if tiers is None else [[_text(u) for u in _typed(t, list)] for t in tiers],
        "comment": _text(top.get(b"comment")),
        "created_by": _text(top.get(b"created by")),
        "creation_date": _whole(top.get(b"creation date"), negative=True),
        "info_hash": hashlib.sha1(data[start:end]).hexdigest(),
    }


def decode_torrents(binary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and quarantine from ``set_id`` with ``content`` or ``path``."""
    decoded = map_files(binary, lambda _row, f: torrent_facts(f), TORRENT_FIELDS)
    good = decoded.filter(F.col("reason").isNull()).drop("reason")
    documents = good.select(
        *[c for c in good.columns if c not in ("announce", "tiers")],
        announce_tiers(F.col("announce"), F.col("tiers")).alias("announce"),
        F.col("tiers").isNotNull().alias("multitracker"),
        F.col("files").isNull().alias("is_single_file"),
    )
    kept = [c for c in binary.columns if c != "content"]
    return documents, decoded.filter(F.col("reason").isNotNull()).select(*kept, "reason")


def read_torrents(spark: SparkSession, paths, recursive: bool = True, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every ``.torrent`` in the given folders (as ``listed``, if that is known), ``set_id`` being its path; those refused, with folders that cannot be listed."""
    listed = list_files(spark, paths, recursive) if listed is None else listed
    found = listed.filter(F.col("reason").isNull() & F.col("path").endswith(".torrent"))
    documents, refused = decode_torrents(found.select(F.col("path").alias("set_id"), "path"))
    unlisted = listed.filter(F.col("reason").isNotNull()).select(F.col("path").alias("set_id"), "path", "reason")
    return documents, union_all(refused, unlisted)


def torrent_files(documents: DataFrame) -> DataFrame:
    """Every file in stream order, padding included; a single file goes by the set's name."""
    one = F.array(
        F.struct(F.array("name").alias("path_parts"), F.col("length"), F.lit(None).cast("string").alias("attr"))
    )
    entries = F.when(F.col("files").isNull(), one).otherwise(F.col("files"))
    return documents.select("set_id", F.posexplode(entries).alias("ordinal", "f")).select(
        "set_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        "f.path_parts",
        F.array_join("f.path_parts", "/").alias("path"),
        "f.length",
        is_padding(F.col("f.path_parts"), F.col("f.attr")).alias("is_pad"),
    )


def torrent_pieces(documents: DataFrame) -> DataFrame:
    """``set_id, piece, sha1`` of every whole 20-byte hash."""
    count = F.floor(F.octet_length("pieces") / 20).cast("int")
    at = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    hashes = F.transform(
        at, lambda i: F.struct(i.cast("long").alias("piece"), F.lower(F.hex(F.substring("pieces", i * 20 + 1, F.lit(20)))).alias("sha1"))
    )
    return documents.filter(count > 0).select("set_id", F.explode(hashes).alias("p")).select("set_id", "p.*")


def rule_columns(documents: DataFrame) -> DataFrame:
    """The columns ``torrent_violations`` judges."""
    return documents.select(
        "set_id", "name", "piece_length", F.octet_length("pieces").cast("long").alias("pieces_bytes"),
        "length", F.col("files").isNotNull().alias("has_files"), "meta_version",
    )
