"""Stream layout, piece checks and identities over the stand-in text files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions.formats import auto_piece_length, piece_count
from tapeledger.operators import layout as L
from tapeledger.operators import quality as Q
from tapeledger.operators.ordered import longest_set, number_rows
from tapeledger.plans import standins as S
from tapeledger.session import stored

PIECE = 2048
NAME = "'doc_' || CAST(doc_id AS STRING) || '.txt'"

# Files of a set in stream order: every document, and besides some empty files and some that stand for padding.
FILES = f"""
SELECT source AS set_id, doc_id, {NAME} AS file_name, source || '/' || {NAME} AS path, text, false AS is_pad FROM {{documents}}
UNION ALL SELECT source, doc_id, 'empty_' || {NAME}, source || '/empty_' || {NAME}, '', false FROM {{documents}} WHERE doc_id % 67 = 9
UNION ALL SELECT source, doc_id, 'pad_' || {NAME}, source || '/pad_' || {NAME}, text, true FROM {{documents}} WHERE doc_id % 53 = 8"""

# What lies on disk of the listed files: some are gone, longer, unreadable, or not files at all.
ON_DISK = """doc_id % 89 <> 7"""
UNREADABLE = "CASE WHEN doc_id % 101 = 9 THEN 'permission denied' END"


def files(spark, sf_dir, keep="true"):
    """Numbered files with their lengths; contents stay behind."""
    rows = S.select(spark, sf_dir, FILES).filter(keep).withColumn("length", F.octet_length("text").cast("long")).drop("text")
    longest = longest_set(rows, ["set_id"])
    return number_rows(rows, ["set_id"], ["file_name"], longest=longest), longest


def spans(spark, sf_dir, keep="true"):
    rows, longest = files(spark, sf_dir, keep)
    return L.file_spans(rows, longest=longest)


def with_content(spark, sf_dir, laid):
    """Contents join the finished layout by path, so no byte is sorted or numbered with its set."""
    bytes_of = S.select(spark, sf_dir, FILES).filter("NOT is_pad").select("path", F.col("text").cast("binary").alias("content"))
    return laid.join(bytes_of, "path", "left")


def inventory(spark, sf_dir):
    listed = S.select(spark, sf_dir, FILES).filter(ON_DISK)
    return listed.select(
        "path",
        (F.octet_length("text") + F.when(F.expr("doc_id % 71 = 6"), 1).otherwise(0)).cast("long").alias("size"),
        F.expr("doc_id % 113 <> 3").alias("is_file"),
        F.expr(UNREADABLE).alias("error"),
    )


def prechecked(spark, sf_dir):
    laid = spans(spark, sf_dir)
    return L.size_precheck(laid, inventory(spark, sf_dir)), laid


def damaged(laid):
    """The same bytes with the middle one of some files replaced."""
    hit = F.expr("doc_id % 97 = 5 AND length > 0 AND NOT is_pad")
    changed = F.expr(
        "concat(substring(content, 1, CAST(length div 2 AS INT)), X'21', substring(content, CAST(length div 2 AS INT) + 2))"
    )
    return laid.withColumn("content", F.when(hit, changed).otherwise(F.col("content")))


def outcomes(spark, sf_dir):
    """Spans and the size check are read by every branch, so they are kept; contents are not."""
    laid = stored(spans(spark, sf_dir), "spans")
    checked = stored(L.size_precheck(laid, inventory(spark, sf_dir)), "checked")
    segments = L.piece_segments(checked, F.lit(PIECE))
    full = with_content(spark, sf_dir, laid)
    expected = L.piece_digests(L.piece_slices(full, PIECE))
    actual = L.piece_digests(L.piece_slices(damaged(full), PIECE))
    return L.piece_outcomes(segments, expected, actual), segments, checked


def attributed(spark, sf_dir):
    found, segments, checked = outcomes(spark, sf_dir)
    return L.attribute_failures(segments, found, checked)


def segments(spark, sf_dir):
    cut = L.piece_segments(spans(spark, sf_dir), F.lit(PIECE))
    return cut.select("set_id", "ordinal", "piece", "from_byte", "piece_at", "bytes")


def auto_length(spark, sf_dir):
    rows, _ = files(spark, sf_dir)
    totals = rows.groupBy("set_id").agg(F.sum("length").alias("base"))
    scaled = totals.select("set_id", F.explode(F.array(*[F.col("base") * (10**k) for k in range(8)])).alias("total"))
    size = auto_piece_length(F.col("total"))
    return scaled.select("set_id", "total", size.alias("piece_length"), piece_count(F.col("total"), size).alias("pieces"))


def drafts(spark, sf_dir):
    rows, _ = files(spark, sf_dir)
    totals = rows.groupBy("set_id").agg(F.sum("length").alias("total"))
    return totals.select(
        "set_id",
        F.concat(F.lit("set "), F.col("set_id")).alias("name"),
        auto_piece_length(F.col("total")).alias("piece_length"),
        F.expr("length(set_id) = 4").alias("private"),
        F.expr("CASE WHEN set_id LIKE '%1' THEN 'tag' END").alias("source"),
        F.lit(False).alias("is_single_file"),
    )


def identity(spark, sf_dir):
    laid = spans(spark, sf_dir)
    pieces = L.piece_digests(L.piece_slices(with_content(spark, sf_dir, laid), 16384))
    fixed = drafts(spark, sf_dir).withColumn("piece_length", F.lit(16384).cast("long"))
    listed = laid.select("set_id", "ordinal", "length", "is_pad", F.array("file_name").alias("path_parts"))
    return L.set_identity(fixed, listed, pieces)


def audio_digest(spark, sf_dir):
    laid = spans(spark, sf_dir, "NOT is_pad")
    return L.set_audio_digest(L.piece_slices(with_content(spark, sf_dir, laid), PIECE))


def extra_files(spark, sf_dir):
    rows = S.select(spark, sf_dir, FILES)
    listed = rows.filter("NOT is_pad").select("set_id", "path")
    roots = rows.select("set_id", F.col("set_id").alias("root"), F.expr("set_id = 'src3'").alias("is_single_file")).distinct()
    return L.extras(roots, listed, inventory(spark, sf_dir))


GIVEN = """
SELECT c_custkey AS set_id, 'show' || CAST(c_custkey % 7 AS STRING) AS name, c_custkey % 5 = 0 AS is_single_file,
       CASE WHEN c_custkey % 11 = 0 THEN 'nowhere' || CAST(c_custkey AS STRING)
            WHEN c_custkey % 3 = 0 THEN 'vault/n' || CAST(c_nationkey AS STRING)
            WHEN c_custkey % 13 = 0 THEN 'vault/n' || CAST(c_nationkey AS STRING) || '/note.txt'
            ELSE 'vault/n' || CAST(c_nationkey AS STRING) || '/show' || CAST(c_custkey % 7 AS STRING) END AS given
FROM {customer}"""
DIRS = """
SELECT 'vault/n' || CAST(n_nationkey AS STRING) AS path FROM {nation}
UNION SELECT 'vault/n' || CAST(c_nationkey AS STRING) || '/show' || CAST(c_custkey % 5 AS STRING) FROM {customer} WHERE c_acctbal > 5000"""
NOTES = "SELECT 'vault/n' || CAST(n_nationkey AS STRING) || '/note.txt' AS path FROM {nation} WHERE n_nationkey % 4 <> 1"

TORRENT_PLACES = """
SELECT CASE WHEN o_custkey % 5 = 0 THEN 'c' || CAST(o_custkey AS STRING) || '.torrent'
            WHEN o_custkey % 5 = 1 THEN 'c' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.torrent'
            WHEN o_custkey % 5 = 2 AND o_orderkey % 4 = 0 THEN 'c' || CAST(o_custkey AS STRING) || '/one.torrent' || CAST(o_orderkey AS STRING)
            ELSE 'c' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey % 2 AS STRING) || '.torrent' END AS path
FROM {orders}"""
SHOW_DIRS = "SELECT 'c' || CAST(c_custkey AS STRING) AS dir FROM {customer}"


def lookup(spark, sf_dir):
    listing = S.select(spark, sf_dir, TORRENT_PLACES).distinct().withColumn("is_file", F.lit(True))
    return L.set_torrent_lookup(S.select(spark, sf_dir, SHOW_DIRS), listing)


def roots(spark, sf_dir):
    return L.resolve_root(*(S.select(spark, sf_dir, t) for t in (GIVEN, DIRS, NOTES)))


def summary(spark, sf_dir):
    laid = spans(spark, sf_dir)
    url = F.concat(F.lit("http://"), F.col("set_id"), F.lit("/announce"))
    torrents = drafts(spark, sf_dir).select(
        "set_id", "name", "piece_length",
        F.array(F.array(url, F.concat(url, F.lit("2"))), F.array(F.concat(url, F.lit("3")))).alias("announce"),
        F.col("private").alias("multitracker"),
    )
    return L.torrent_summary(torrents, laid)


# Documents with one or several faults each.
TORRENTS = """
SELECT p_partkey AS set_id, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 17 = 1 THEN '..'
         WHEN p_partkey % 17 = 2 THEN 'a/b' ELSE p_name END AS name,
       CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 19 = 1 THEN 0
            WHEN p_partkey % 19 = 2 THEN 2147483648 ELSE CAST(16384 AS BIGINT) END AS piece_length,
       CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 23 = 1 THEN 30
            ELSE CAST(20 * ((p_size * 9000 + 16383 - (p_size * 9000 + 16383) % 16384) / 16384) AS BIGINT) END AS pieces_bytes,
       CASE WHEN p_partkey % 29 = 0 OR (p_type = 'ECONOMY' AND p_partkey % 5 <> 0) THEN NULL ELSE CAST(p_size * 9000 AS BIGINT) END AS length,
       p_type = 'ECONOMY' AS has_files,
       CASE WHEN p_partkey % 37 = 0 THEN 2 END AS meta_version
FROM {part}"""
TORRENT_FILES = """
SELECT p_partkey AS set_id, CAST(0 AS BIGINT) AS ordinal, CAST(p_size AS BIGINT) AS length,
       CASE WHEN p_partkey % 2 = 0 THEN 'CON.txt' WHEN p_partkey % 3 = 0 THEN '' ELSE 'ok.flac' END AS component
FROM {part} WHERE p_type = 'ECONOMY'"""


def violations(spark, sf_dir):
    rows = S.select(spark, sf_dir, TORRENT_FILES).withColumn("path_parts", F.array("component")).drop("component")
    return Q.torrent_violations(S.select(spark, sf_dir, TORRENTS), rows)


DRAFTS = """
SELECT p_partkey AS set_id, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS name, CAST(CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE 16384 END AS BIGINT) AS piece_length,
  p_type = 'ECONOMY' AS is_single_file, CAST(CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE p_size * 9000 END AS BIGINT) AS length, p_size > 2 AS has_files, p_partkey % 29 = 0 AS no_path,
  CAST(floor((p_size * 9000 + 16383) / 16384) AS BIGINT) - CASE WHEN p_partkey % 37 = 0 THEN 1 ELSE 0 END AS pieces
FROM {part}"""


def draft_rules(spark, sf_dir):
    rows = S.select(spark, sf_dir, DRAFTS)
    nowhere = F.array().cast("array<string>")
    listed = rows.filter("has_files").select(
        "set_id", F.lit(0).alias("ordinal"), "length", F.when(F.col("no_path"), nowhere).otherwise(F.array(F.lit("x"))).alias("path_parts")
    )
    pieces = rows.filter("pieces > 0").select("set_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces"))).alias("piece"))
    return Q.draft_violations(rows.select("set_id", "name", "piece_length", "is_single_file"), listed, pieces)


LISTING = """
SELECT set_id, set_id || '/' || name AS path, name, kind, entries FROM (
SELECT source AS set_id,
       CASE WHEN doc_id % 10 = 0 THEN '._' || CAST(doc_id AS STRING) WHEN doc_id % 10 = 1 THEN 'x' || CAST(doc_id AS STRING) || '.torrent'
            WHEN doc_id % 10 = 2 THEN '.' || CAST(doc_id AS STRING) || '.part' WHEN doc_id % 40 = 3 THEN 'Thumbs.db'
            ELSE 'd' || CAST(doc_id AS STRING) END AS name,
       CASE WHEN doc_id % 30 = 7 THEN 'dir' WHEN doc_id % 30 = 8 THEN 'symlink' ELSE 'file' END AS kind,
       CAST(CASE WHEN doc_id % 60 = 7 THEN 0 ELSE 3 END AS BIGINT) AS entries
FROM {documents}) l"""


def selection(spark, sf_dir):
    return Q.selection_report(S.select(spark, sf_dir, LISTING))


# --- SQL twins -------------------------------------------------------------------------------

BASE = f"""
f AS (SELECT *, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS length
      FROM ({S.numbered(FILES, 'set_id', 'file_name')})),
s AS (SELECT *, CAST(sum(length) OVER (PARTITION BY set_id ORDER BY ordinal) AS BIGINT) AS "end" FROM f),
spans AS (SELECT *, "end" - length AS start FROM s)"""


def cut(size, name="seg", source="spans"):
    return f"""
{name}_p AS (SELECT set_id, unnest(range((max("end") + {size - 1}) // {size})) AS piece FROM {source} GROUP BY set_id),
{name} AS (SELECT s.*, p.piece, greatest(s.start, p.piece * {size}) - s.start AS from_byte,
          greatest(s.start, p.piece * {size}) - p.piece * {size} AS piece_at,
          least(s."end", (p.piece + 1) * {size}) - greatest(s.start, p.piece * {size}) AS bytes
        FROM {source} s JOIN {name}_p p ON s.set_id = p.set_id AND s.start < (p.piece + 1) * {size} AND s."end" > p.piece * {size}
        WHERE s.length > 0)"""


SLICE = "CASE WHEN is_pad THEN repeat('00', CAST(bytes AS INT)) ELSE substr({h}, CAST(2 * from_byte + 1 AS INT), CAST(2 * bytes AS INT)) END"
BAD_H = "CASE WHEN doc_id % 97 = 5 AND length > 0 AND NOT is_pad THEN substr(h, 1, CAST(2 * (length // 2) AS INT)) || '21' || substr(h, CAST(2 * (length // 2) + 3 AS INT)) ELSE h END"

PRECHECK = f"""
inv AS (SELECT path, octet_length(encode(text)) + CASE WHEN doc_id % 71 = 6 THEN 1 ELSE 0 END AS size,
          doc_id % 113 <> 3 AS is_file, {UNREADABLE} AS error FROM ({S.plain(FILES)}) WHERE {ON_DISK}),
pre AS (SELECT spans.*, CASE WHEN is_pad THEN 'PADDING' WHEN inv.path IS NULL THEN 'MISSING'
          WHEN error IS NOT NULL OR NOT is_file THEN 'UNREADABLE' WHEN size = length THEN 'SIZE_OK' ELSE 'WRONG_SIZE' END AS status,
          CAST(size AS BIGINT) AS size, coalesce(error, CASE WHEN NOT is_file THEN 'not a regular file' END) AS why
        FROM spans LEFT JOIN inv USING (path))"""

OUTCOMES = f"""
WITH {BASE}, {PRECHECK}, {cut(PIECE, source='pre')},
o AS (SELECT set_id, piece, CASE WHEN NOT bool_and(status IN ('SIZE_OK', 'PADDING')) THEN 'UNVERIFIABLE'
        WHEN string_agg({SLICE.format(h='h')}, '' ORDER BY piece_at) = string_agg({SLICE.format(h=f'({BAD_H})')}, '' ORDER BY piece_at) THEN 'OK'
        ELSE 'FAILED' END AS outcome, count(*) FILTER (WHERE NOT is_pad) AS real_files
      FROM seg GROUP BY set_id, piece)"""

ATTRIBUTED = f"""{OUTCOMES},
j AS (SELECT seg.set_id, seg.ordinal, o.* EXCLUDE (set_id) FROM seg JOIN o ON seg.set_id = o.set_id AND seg.piece = o.piece WHERE NOT is_pad),
g AS (SELECT set_id, ordinal, count(*) FILTER (WHERE outcome = 'OK') AS verified,
        count(*) FILTER (WHERE outcome = 'UNVERIFIABLE') AS unverifiable,
        count(*) FILTER (WHERE outcome = 'FAILED' AND real_files = 1) AS bad,
        min(piece) FILTER (WHERE outcome = 'FAILED' AND real_files = 1) AS first_bad,
        min(piece) FILTER (WHERE outcome = 'FAILED' AND real_files > 1) AS shared_piece,
        arg_min(real_files, piece) FILTER (WHERE outcome = 'FAILED' AND real_files > 1) AS sharers
      FROM j GROUP BY set_id, ordinal),
a AS (SELECT pre.set_id, pre.ordinal, g.* EXCLUDE (set_id, ordinal),
        CASE WHEN status <> 'SIZE_OK' THEN status WHEN bad > 0 THEN 'CORRUPT' WHEN shared_piece IS NOT NULL THEN 'SUSPECT'
             WHEN unverifiable > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state
      FROM pre LEFT JOIN g ON pre.set_id = g.set_id AND pre.ordinal = g.ordinal)"""

DRAFT = """SELECT set_id, 'set ' || set_id AS name, length(set_id) = 4 AS private, CASE WHEN set_id LIKE '%1' THEN 'tag' END AS source,
  CAST(sum(length) AS BIGINT) AS total FROM spans GROUP BY set_id"""
AUTO = "coalesce((SELECT min(1 << e) FROM range(14, 25) t(e) WHERE (total + (1 << e) - 1) // (1 << e) <= 2000), 1 << 24)"

RULES = [
    ("V2_ONLY", "meta_version >= 2 AND pieces_bytes IS NULL"),
    ("NO_NAME", "name IS NULL"),
    ("UNSAFE_NAME", "name IN ('', '.', '..') OR name LIKE '%/%'"),
    ("NO_PIECE_LENGTH", "piece_length IS NULL"),
    ("IMPLAUSIBLE_PIECE_LENGTH", "piece_length <= 0 OR piece_length > 1073741824"),
    ("NO_PIECES", "pieces_bytes IS NULL AND NOT coalesce(meta_version >= 2, FALSE)"),
    ("PIECES_NOT_20", "pieces_bytes % 20 <> 0"),
    ("LENGTH_AND_FILES", "length IS NOT NULL AND has_files"),
    ("NO_LENGTH", "length IS NULL AND NOT has_files"),
    (
        "PIECE_COUNT",
        "piece_length BETWEEN 1 AND 1073741824 AND pieces_bytes % 20 = 0 AND (length IS NULL) = has_files "
        "AND pieces_bytes // 20 <> (total + piece_length - 1) // nullif(piece_length, 0)",
    ),
]
VIOLATIONS = f"""
WITH t AS (SELECT x.*, CASE WHEN has_files THEN (SELECT CAST(sum(length) AS BIGINT) FROM ({S.plain(TORRENT_FILES)}) f WHERE f.set_id = x.set_id) ELSE length END AS total
  FROM ({S.plain(TORRENTS)}) x)
""" + "\nUNION ALL ".join(
    f"SELECT set_id, CAST(NULL AS BIGINT) AS ordinal, '{rule}' AS rule FROM t WHERE {test}" for rule, test in RULES
) + f"""
UNION ALL SELECT set_id, ordinal, CASE component WHEN '' THEN 'EMPTY_COMPONENT' ELSE 'RESERVED_DEVICE' END
FROM ({S.plain(TORRENT_FILES)}) WHERE component IN ('', 'CON.txt')"""

QUERIES = {
    "file_spans": (
        lambda spark, sf_dir: spans(spark, sf_dir).select("set_id", "ordinal", "file_name", "length", "start", "end"),
        f'WITH {BASE} SELECT set_id, ordinal, file_name, length, start, "end" FROM spans',
    ),
    "auto_piece_length": (
        auto_length,
        f"""WITH {BASE}, t AS (SELECT set_id, CAST(sum(length) * (10 ** k) AS BIGINT) AS total FROM spans, range(8) r(k) GROUP BY set_id, k),
l AS (SELECT *, CAST({AUTO} AS BIGINT) AS piece_length FROM t)
SELECT *, (total + piece_length - 1) // piece_length AS pieces FROM l""",
    ),
    "piece_segments": (
        segments,
        f"WITH {BASE}, {cut(PIECE)} SELECT set_id, ordinal, piece, from_byte, piece_at, bytes FROM seg",
    ),
    "piece_digests": (
        lambda spark, sf_dir: L.piece_digests(L.piece_slices(with_content(spark, sf_dir, spans(spark, sf_dir)), PIECE)),
        f"WITH {BASE}, {cut(PIECE)} SELECT set_id, piece, sha1(unhex(string_agg({SLICE.format(h='h')}, '' ORDER BY piece_at))) AS sha1 FROM seg GROUP BY set_id, piece",
    ),
    "set_audio_digest": (
        audio_digest,
        f"""WITH f AS (SELECT *, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS length
  FROM ({S.numbered(f"SELECT * FROM ({FILES}) x WHERE NOT is_pad", 'set_id', 'file_name')})),
s AS (SELECT *, CAST(sum(length) OVER (PARTITION BY set_id ORDER BY ordinal) AS BIGINT) AS "end" FROM f),
spans AS (SELECT *, "end" - length AS start FROM s), {cut(PIECE)},
d0 AS (SELECT set_id, piece AS i, md5(unhex(string_agg({SLICE.format(h='h')}, '' ORDER BY piece_at))) AS d FROM seg GROUP BY ALL),
d1 AS (SELECT set_id, i // 65536 AS k, md5(string_agg(d, '' ORDER BY i)) AS d FROM d0 GROUP BY ALL),
d2 AS (SELECT set_id, md5(string_agg(d, '' ORDER BY k)) AS d FROM d1 GROUP BY ALL)
SELECT set_id, md5(md5(d)) AS tree_md5 FROM d2""",
    ),
    "size_precheck": (
        lambda spark, sf_dir: prechecked(spark, sf_dir)[0].select("set_id", "ordinal", "path", "status", "expected", "actual", "reason"),
        f"""WITH {BASE}, {PRECHECK} SELECT set_id, ordinal, path, status, CASE WHEN status = 'WRONG_SIZE' THEN length END AS expected,
  CASE WHEN status = 'WRONG_SIZE' THEN size END AS actual, CASE WHEN status = 'UNREADABLE' THEN why END AS reason FROM pre""",
    ),
    "extras": (
        extra_files,
        f"""SELECT set_id, path FROM ({S.plain(FILES)}) WHERE {ON_DISK} AND doc_id % 113 <> 3 AND is_pad AND set_id <> 'src3'""",
    ),
    "resolve_root": (
        roots,
        f"""WITH g AS ({S.plain(GIVEN)}), d AS ({S.plain(DIRS)}), n AS ({S.plain(NOTES)}),
r AS (SELECT *, CASE WHEN given IN (SELECT path FROM n) THEN regexp_replace(given, '/[^/]*$', '')
  WHEN given NOT IN (SELECT path FROM d) THEN NULL WHEN is_single_file THEN given
  WHEN given || '/' || name IN (SELECT path FROM d) THEN given || '/' || name ELSE given END AS root FROM g)
SELECT *, CASE WHEN root IS NULL THEN 'NO_SUCH_FOLDER' END AS refused FROM r""",
    ),
    "piece_counts": (
        lambda spark, sf_dir: L.piece_counts(outcomes(spark, sf_dir)[0]),
        f"""{OUTCOMES} SELECT set_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'OK') AS ok,
  count(*) FILTER (WHERE outcome = 'FAILED') AS failed, count(*) FILTER (WHERE outcome = 'UNVERIFIABLE') AS unverifiable
FROM o GROUP BY set_id""",
    ),
    "attribute_failures": (
        attributed,
        f"""{ATTRIBUTED} SELECT set_id, ordinal, state AS status, CASE WHEN state = 'CORRUPT' THEN bad END AS bad_pieces,
  CASE WHEN state = 'CORRUPT' THEN first_bad END AS first_bad_piece, CASE WHEN state = 'SUSPECT' THEN shared_piece END AS suspect_piece,
  CASE WHEN state = 'SUSPECT' THEN sharers - 1 END AS shared_with, CASE WHEN state = 'PARTIAL' THEN verified END AS verified,
  CASE WHEN state = 'PARTIAL' THEN unverifiable END AS unverifiable FROM a""",
    ),
    "bad_pieces": (
        lambda spark, sf_dir: L.bad_pieces(*outcomes(spark, sf_dir)[1::-1]),
        f"{ATTRIBUTED} SELECT set_id, piece, ordinal, real_files = 1 AS exclusive FROM j WHERE outcome = 'FAILED'",
    ),
    "torrent_verdict": (
        lambda spark, sf_dir: L.torrent_verdict(attributed(spark, sf_dir)),
        f"""{ATTRIBUTED} SELECT set_id, CASE WHEN count(*) FILTER (WHERE state NOT IN ('COMPLETE', 'PADDING')) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS verdict,
  count(*) FILTER (WHERE state NOT IN ('COMPLETE', 'PADDING')) AS needs_attention FROM a GROUP BY set_id""",
    ),
    "torrent_verdict_quick": (
        lambda spark, sf_dir: L.torrent_verdict(prechecked(spark, sf_dir)[0], quick=True),
        f"""WITH {BASE}, {PRECHECK} SELECT set_id, CASE WHEN count(*) FILTER (WHERE status NOT IN ('SIZE_OK', 'PADDING')) > 0 THEN 'INCOMPLETE' ELSE 'SIZES_MATCH' END AS verdict,
  count(*) FILTER (WHERE status NOT IN ('SIZE_OK', 'PADDING')) AS needs_attention FROM pre GROUP BY set_id""",
    ),
    "torrent_summary": (
        summary,
        f"""WITH {BASE}, d AS ({DRAFT}), l AS (SELECT *, CAST({AUTO} AS BIGINT) AS piece_length FROM d)
SELECT l.set_id, l.name, k.real_files, k.padding_files, l.total AS total_bytes, l.piece_length,
  (l.total + l.piece_length - 1) // l.piece_length AS pieces, 3 AS trackers, l.private AS multitracker
FROM l JOIN (SELECT set_id, count(*) FILTER (WHERE NOT is_pad) AS real_files, count(*) FILTER (WHERE is_pad) AS padding_files FROM spans GROUP BY set_id) k USING (set_id)""",
    ),
    "set_identity": (
        identity,
        f"""WITH {BASE}, {cut(16384)}, d AS ({DRAFT}),
p AS (SELECT set_id, piece, sha1(unhex(string_agg({SLICE.format(h='h')}, '' ORDER BY piece_at))) AS d FROM seg GROUP BY set_id, piece),
q AS (SELECT set_id, string_agg(upper(d), '' ORDER BY piece) AS hashes, count(*) AS n FROM p GROUP BY set_id),
e AS (SELECT set_id, string_agg('d' || CASE WHEN is_pad THEN '4:attr1:p' ELSE '' END || '6:lengthi' || length || 'e4:pathl'
        || octet_length(encode(file_name)) || ':' || file_name || 'ee', '' ORDER BY ordinal) AS entries FROM spans GROUP BY set_id),
b AS (SELECT d.set_id, hex(encode('d5:filesl' || entries || 'e4:name' || octet_length(encode(name)) || ':' || name
        || '12:piece lengthi16384e6:pieces' || (n * 20) || ':')) || hashes
        || hex(encode(CASE WHEN private THEN '7:privatei1e' ELSE '' END || coalesce('6:source' || length(source) || ':' || source, '') || 'e')) AS doc
      FROM d JOIN q USING (set_id) JOIN e USING (set_id))
SELECT set_id, length(doc) // 2 AS bytes, sha1(unhex(doc)) AS info_hash FROM b""",
    ),
    "set_torrent_lookup": (
        lookup,
        f"""WITH d AS ({S.plain(SHOW_DIRS)}), t AS (SELECT DISTINCT path FROM ({S.plain(TORRENT_PLACES)}) WHERE path LIKE '%.torrent'),
i AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS n, min(path) AS path FROM t WHERE path LIKE '%/%' GROUP BY 1),
r AS (SELECT d.dir, coalesce(t.path, CASE WHEN n = 1 THEN i.path END) AS torrent, n FROM d
  LEFT JOIN t ON t.path = d.dir || '.torrent' LEFT JOIN i ON i.dir = d.dir)
SELECT dir, torrent, CASE WHEN torrent IS NULL THEN CASE WHEN n > 1 THEN 'SEVERAL' ELSE 'NONE' END END AS refused FROM r""",
    ),
    "torrent_violations": (violations, VIOLATIONS),
    "draft_violations": (
        draft_rules,
        f"""WITH d AS (SELECT *, CASE WHEN has_files THEN length ELSE 0 END AS total FROM ({S.plain(DRAFTS)}))
SELECT set_id, 'EMPTY_NAME' AS rule FROM d WHERE name = '' UNION ALL SELECT set_id, 'ZERO_PIECE_LENGTH' FROM d WHERE piece_length = 0 UNION ALL SELECT set_id, 'NO_DATA' FROM d WHERE total = 0
UNION ALL SELECT set_id, 'PIECE_COUNT' FROM d WHERE piece_length > 0 AND total > 0 AND pieces <> (total + 16383) // 16384
UNION ALL SELECT set_id, 'NO_FILES' FROM d WHERE NOT is_single_file AND NOT has_files UNION ALL SELECT set_id, 'EMPTY_PATH' FROM d WHERE NOT is_single_file AND has_files AND no_path""",
    ),
    "selection_report": (
        selection,
        f"""SELECT * FROM (SELECT set_id, path, CASE WHEN kind = 'symlink' THEN 'SYMLINK' WHEN kind = 'dir' AND entries = 0 THEN 'EMPTY_DIRECTORY'
  WHEN kind = 'file' AND (name LIKE '.\\_%' ESCAPE '\\' OR name LIKE '%.torrent' OR (name LIKE '.%' AND name LIKE '%.part') OR name = 'Thumbs.db') THEN 'NOISE' END AS reason
FROM ({S.plain(LISTING)})) WHERE reason IS NOT NULL""",
    ),
}
