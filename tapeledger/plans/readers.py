"""File readers over documents that Spark writes from the given tables.

Each query lays out real file bytes (RIFF, FLAC, bencode) with Spark expressions and reads them
back; the SQL twin takes the same facts straight from the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeledger.operators.quality import torrent_violations
from tapeledger.plans import standins as S
from tapeledger.session import union_all
from tapeledger.sources import audio as A
from tapeledger.sources import torrents as T


def le(n: Column, width: int) -> Column:
    """A number as ``width`` bytes, lowest first."""
    n = n.cast("long")
    turned = [F.shiftleft(F.shiftright(n, 8 * i).bitwiseAND(255), 8 * (width - 1 - i)) for i in range(width)]
    return be(reduce(lambda a, b: a.bitwiseOR(b), turned), width)


def be(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def raw(text: str) -> Column:
    return F.lit(text.encode())


WAV_SHAPE = """
SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 48000 ELSE 44100 END AS rate, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS channels,
  CASE WHEN doc_id % 7 = 0 THEN 24 WHEN doc_id % 7 = 1 THEN 8 ELSE 16 END AS bits, CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 1 END AS tag,
  doc_id % 3 = 0 AS has_list, doc_id % 13 = 0 AS broken
FROM {documents}"""


def wav_headers(spark, sf_dir):
    rows = S.select(spark, sf_dir, WAV_SHAPE)
    data = F.col("text").cast("binary")
    size = F.octet_length("text").cast("long")
    # An odd chunk nobody knows, followed by its pad byte.
    extra = F.when(F.col("has_list"), F.concat(raw("LIST"), le(F.lit(5), 4), raw("hello\0"))).otherwise(F.lit(b""))
    frame = F.col("channels") * F.ceil(F.col("bits") / 8)
    fmt = F.concat(
        raw("fmt "), le(F.lit(16), 4), le(F.col("tag"), 2), le(F.col("channels"), 2), le(F.col("rate"), 4),
        le(F.col("rate") * frame, 4), le(frame, 2), le(F.col("bits"), 2),
    )
    magic = F.when(F.col("broken"), raw("RIFX")).otherwise(raw("RIFF"))
    content = F.concat(magic, le(F.lit(36) + size, 4), raw("WAVE"), extra, fmt, raw("data"), le(size, 4), data)
    headers = A.read_wav_headers(rows.select("doc_id", content.alias("content")))
    digests = A.file_digests(headers.join(rows.select("doc_id", content.alias("content")), "doc_id").drop("stream", "reason", "comments"))
    found = headers.drop("data_offset", "data_len").join(digests.select("doc_id", "data_offset", "data_len", "st5"), "doc_id")
    return found.select(
        "doc_id", "stream.sample_rate", "stream.channels", "stream.bits_per_sample", "stream.total_frames", "data_offset", "data_len", "st5", "reason"
    )


FLAC_LINES = "SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_name AS title, p_brand AS brand"
FLAC_FACTS = """
  CASE WHEN l_partkey % 4 = 0 THEN 96000 ELSE 44100 END AS rate, CAST(1 + l_partkey % 8 AS INT) AS channels, CASE WHEN l_partkey % 3 = 0 THEN 24 ELSE 16 END AS bits,
  CASE WHEN l_partkey % 17 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 END AS frames,
  CASE WHEN l_partkey % 9 = 0 THEN '00000000000000000000000000000000' ELSE md5(CAST(l_partkey AS STRING)) END AS digest,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'encoder ' || CAST(l_suppkey AS STRING) END AS vendor, l_suppkey % 11 = 0 AS broken"""
FLAC_FROM = """
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
FLAC_SHAPE = f"\n{FLAC_LINES},{FLAC_FACTS}{FLAC_FROM}"


def flac_headers(spark, sf_dir):
    # Lines move to their sets; what their own columns tell is added where they then stand.
    rows = S.tracks(spark, sf_dir, FLAC_LINES + FLAC_FROM, f"SELECT set_id, ordinal, title, brand,{FLAC_FACTS} FROM {{base}}")[0]

    def text(value: Column) -> Column:
        return F.concat(le(F.octet_length(value), 4), value.cast("binary"))

    rate, frames = F.col("rate").cast("long"), F.col("frames")
    packed = (
        F.shiftleft(rate, 44)
        .bitwiseOR(F.shiftleft((F.col("channels") - 1).cast("long"), 41))
        .bitwiseOR(F.shiftleft((F.col("bits") - 1).cast("long"), 36))
        .bitwiseOR(frames)
    )
    stream = F.concat(F.lit(bytes(10)), be(packed, 8), F.unhex("digest"))
    comments = F.concat(
        text(F.col("vendor")), le(F.lit(3), 4), text(F.concat(F.lit("title="), F.col("title"))),
        text(F.concat(F.lit("ARTIST="), F.col("brand"))), text(F.lit("TITLE=again")),
    )
    rows, comments = rows.withColumn("comments", comments), F.col("comments")
    content = F.concat(
        F.when(F.col("broken"), raw("fLaX")).otherwise(raw("fLaC")), F.lit(b"\0"), be(F.lit(34), 3), stream,
        F.lit(b"\x01"), be(F.lit(4), 3), raw("skip"), F.lit(b"\x84"), be(F.octet_length(comments), 3), comments,
    )
    probed = A.read_flac_headers(rows.select("set_id", "ordinal", content.alias("content"))).withColumn("format", F.lit("FLAC"))
    tagged = A.read_tags(probed)
    return tagged.select(
        "set_id", "ordinal", "stream.sample_rate", "stream.channels", "stream.bits_per_sample", "stream.total_frames",
        "stream.audio_md5", "encoder", "title", "artist", F.size(F.try_element_at("comments", F.lit("TITLE"))).alias("titles"), "reason",
    )


INFO = """
SELECT doc_id AS set_id, octet_length(CAST(text AS BINARY)) AS size, sha1(CAST(text AS BINARY)) AS hash, doc_id % 19 = 0 AS unsorted, doc_id % 23 = 0 AS dots,
  doc_id % 29 = 0 AS short, doc_id % 2 = 0 AS many, doc_id % 7 = 0 AS tiered, source
FROM {documents}"""


def torrent_bytes(spark, sf_dir):
    """A document's text as a one-piece or several-piece torrent, some of them faulty."""
    rows = S.select(spark, sf_dir, INFO)
    size = F.col("size").cast("string")
    count = F.ceil(F.col("size") / 16384).cast("int")
    hashes = F.unhex(F.repeat("hash", count - F.when(F.col("short"), 1).otherwise(0)))
    name = F.when(F.col("dots"), "2:..").otherwise(F.concat(F.lit("5:n"), F.lpad(F.pmod("set_id", F.lit(9999)).cast("string"), 4, "0")))
    layout = F.when(
        F.col("many"), F.concat(F.lit("5:filesld6:lengthi"), size, F.lit("e4:pathl1:d1:feee"))
    ).otherwise(F.concat(F.lit("6:lengthi"), size, F.lit("e")))
    info = F.concat(
        F.concat(F.lit("d"), layout, F.lit("4:name"), name, F.lit("12:piece lengthi16384e6:pieces"), F.octet_length(hashes).cast("string"), F.lit(":")).cast("binary"),
        hashes,
        F.concat(F.lit("7:privatei1e6:source"), F.length("source").cast("string"), F.lit(":"), F.col("source"), F.lit("e")).cast("binary"),
    )
    tiers = F.when(F.col("tiered"), "13:announce-listll8:http://a8:http://bel8:http://cee").otherwise("")
    lead = F.concat(F.lit("d8:announce8:http://a"), tiers, F.lit("13:creation datei5e"))
    swapped = F.lit("d13:creation datei5e8:announce8:http://a")
    content = F.concat(F.when(F.col("unsorted"), swapped).otherwise(lead).cast("binary"), raw("4:info"), info, raw("e"))
    return rows.select("set_id", content.alias("content"), F.sha1(info).alias("info_sha1"))


def torrents(spark, sf_dir):
    documents, _ = T.decode_torrents(torrent_bytes(spark, sf_dir))
    return documents.select(
        "set_id", "name", "length", "is_single_file", "private", "source", "info_hash", (F.col("info_hash") == F.col("info_sha1")).alias("hash_matches"),
        F.array_join(F.flatten("announce"), ",").alias("trackers"), "multitracker", "creation_date", (F.octet_length("pieces") / 20).cast("int").alias("pieces"),
    )


def torrent_rules(spark, sf_dir):
    documents, bad = T.decode_torrents(torrent_bytes(spark, sf_dir))
    found = torrent_violations(T.rule_columns(documents), T.torrent_files(documents)).select("set_id", "rule")
    return union_all(found, bad.select("set_id", F.col("reason").alias("rule")))


def torrent_listing(spark, sf_dir):
    documents, _ = T.decode_torrents(torrent_bytes(spark, sf_dir))
    files = T.torrent_files(documents).select("set_id", "ordinal", "path", "length", "is_pad")
    first = T.torrent_pieces(documents).groupBy("set_id").agg(F.count(F.lit(1)).alias("pieces"), F.min("sha1").alias("sha1"))
    return files.join(first, "set_id", "left")


SIZE = "octet_length(encode(text))"
FACTS = f"""
WITH t AS (SELECT doc_id AS set_id, source, {SIZE} AS size, sha1(text) AS hash, ({SIZE} + 16383) // 16384 - CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS n,
  CASE WHEN doc_id % 23 = 0 THEN '..' ELSE 'n' || lpad(CAST(doc_id % 9999 AS VARCHAR), 4, '0') END AS name, doc_id % 2 = 0 AS many, doc_id % 7 = 0 AS tiered FROM documents),
i AS (SELECT *, hex(encode('d' || CASE WHEN many THEN '5:filesld6:lengthi' || size || 'e4:pathl1:d1:feee' ELSE '6:lengthi' || size || 'e' END || '4:name' || length(name) || ':' || name
  || '12:piece lengthi16384e6:pieces' || (n * 20) || ':')) || repeat(upper(hash), CAST(n AS INT)) || hex(encode('7:privatei1e6:source' || length(source) || ':' || source || 'e')) AS h FROM t),
ok AS (SELECT * FROM i WHERE set_id % 19 <> 0)"""

QUERIES = {
    "read_wav_headers": (
        wav_headers,
        f"""WITH w AS (SELECT *, {SIZE} AS n, CASE WHEN broken THEN 'NOT_RIFF_WAVE' WHEN tag = 3 THEN 'NOT_PCM' END AS reason FROM ({S.plain(WAV_SHAPE)}))
SELECT doc_id, CAST(CASE WHEN reason IS NULL THEN rate END AS BIGINT) AS sample_rate, CASE WHEN reason IS NULL THEN channels END AS channels, CASE WHEN reason IS NULL THEN bits END AS bits_per_sample,
  CASE WHEN reason IS NULL THEN n // (channels * (bits // 8)) END AS total_frames, CASE WHEN reason IS NULL THEN CAST(44 + CASE WHEN has_list THEN 14 ELSE 0 END AS BIGINT) END AS data_offset,
  CASE WHEN reason IS NULL THEN CAST(n AS BIGINT) END AS data_len, CASE WHEN reason IS NULL THEN md5(text) END AS st5, reason FROM w""",
    ),
    "read_flac_headers": (
        flac_headers,
        f"""SELECT set_id, ordinal, CAST(CASE WHEN NOT broken THEN rate END AS BIGINT) AS sample_rate, CASE WHEN NOT broken THEN channels END AS channels, CASE WHEN NOT broken THEN bits END AS bits_per_sample,
  CASE WHEN NOT broken THEN nullif(frames, 0) END AS total_frames, CASE WHEN NOT broken AND digest NOT LIKE '0000000000%' THEN digest END AS audio_md5,
  CASE WHEN NOT broken THEN nullif(vendor, '') END AS encoder, CASE WHEN NOT broken THEN title END AS title, CASE WHEN NOT broken THEN brand END AS artist,
  CASE WHEN NOT broken THEN 2 END AS titles, CASE WHEN broken THEN 'NOT_FLAC_DATA' END AS reason FROM ({S.tracks_sql(FLAC_SHAPE)})""",
    ),
    "read_torrents": (
        torrents,
        f"""{FACTS} SELECT set_id, name, CASE WHEN NOT many THEN CAST(size AS BIGINT) END AS length, NOT many AS is_single_file, TRUE AS private, source, sha1(unhex(h)) AS info_hash, TRUE AS hash_matches,
  CASE WHEN tiered THEN 'http://a,http://b,http://c' ELSE 'http://a' END AS trackers, tiered AS multitracker, CAST(5 AS BIGINT) AS creation_date, CAST(n AS INT) AS pieces FROM ok""",
    ),
    "refused_torrents": (
        torrent_rules,
        f"""{FACTS} SELECT set_id, 'UNSORTED_KEYS' AS rule FROM t WHERE set_id % 19 = 0 UNION ALL SELECT set_id, 'UNSAFE_NAME' FROM ok WHERE name = '..'
UNION ALL SELECT set_id, 'PIECE_COUNT' FROM ok WHERE set_id % 29 = 0 UNION ALL SELECT set_id, 'DOT_COMPONENT' FROM ok WHERE name = '..' AND NOT many""",
    ),
    "torrent_files": (
        torrent_listing,
        f"""{FACTS} SELECT set_id, CAST(0 AS BIGINT) AS ordinal, CASE WHEN many THEN 'd/f' ELSE name END AS path, CAST(size AS BIGINT) AS length, FALSE AS is_pad,
  CASE WHEN n > 0 THEN CAST(n AS BIGINT) END AS pieces, CASE WHEN n > 0 THEN hash END AS sha1 FROM ok""",
    ),
}
