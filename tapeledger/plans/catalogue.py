"""Tracker lists, sample clips, displays and totals over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions import display as D
from tapeledger.functions import formats as M
from tapeledger.functions import tags as T
from tapeledger.operators import catalogue as C
from tapeledger.operators import clips as K
from tapeledger.operators import inventory as I
from tapeledger.operators.ordered import first_occurrence, number_rows
from tapeledger.operators.repair import set_format
from tapeledger.plans import standins as S
from tapeledger.sinks.render import provenance_audit, render_provenance
from tapeledger.sources.text import parse_passkeys, parse_tracker_lists

KEYED = "chr(123) || 'passkey' || chr(125)"
HEALTH = """CASE s_suppkey % 9 WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'UNREACHABLE' WHEN 2 THEN 'PERSONAL_UPLOAD'
  WHEN 3 THEN 'UNCHECKED' ELSE 'ANNOUNCES' END"""
BUNDLED = f"""
SELECT 'supplier' || substr(s_name, 10) AS id, s_suppkey AS entry_no, s_name AS name,
       'http://t' || CAST(s_suppkey % 40 AS STRING) || '.example/' || CASE WHEN s_suppkey % 7 = 3 THEN {KEYED} ELSE 'announce' END AS announce,
       s_suppkey % 5 = 0 AS private, CASE WHEN s_suppkey % 11 < 4 THEN 'SRC' || CAST(s_suppkey % 2 AS STRING) END AS source, {HEALTH} AS health
FROM {{supplier}}"""
LIST_LINES = """
SELECT 'n' || CAST(c_nationkey AS STRING) || '.lst' AS list_path, c_custkey,
  CASE c_custkey % 12 WHEN 0 THEN '# ' || c_name WHEN 1 THEN c_name WHEN 2 THEN '|http://x' WHEN 3 THEN c_name || '|'
    WHEN 4 THEN c_name || '|http://c.example|other' WHEN 5 THEN 'Same Name|http://s' || CAST(c_custkey AS STRING)
    WHEN 6 THEN c_name || ' | http://p.example/' || CAST(c_custkey AS STRING) || ' | private | source=TAG' || chr(13)
    WHEN 7 THEN c_name || '|http://i.example|id= my' || CAST(c_custkey % 50 AS STRING)
    WHEN 8 THEN '!!!|http://z.example' WHEN 9 THEN 'Supplier#' || substr(c_name, 10) || '|http://own.example/' || CAST(c_custkey AS STRING)
    WHEN 10 THEN '' ELSE c_name || '|udp://u.example||' END AS line
FROM {customer}"""
KEY_LINES = """
SELECT 'keys.lst' AS list_path, c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN '# none' WHEN 1 THEN 'supplier' || lpad(CAST(c_custkey % 90 AS STRING), 9, '0') || '|k' || CAST(c_custkey AS STRING)
    WHEN 2 THEN 'nokey' ELSE ' id' || CAST(c_custkey % 60 AS STRING) || ' | a|b ' END AS line
FROM {customer}"""
SPECS = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_partkey % 29 = 0 THEN 'nobody' WHEN l_partkey % 5 = 0 THEN 'http://t' || CAST(l_suppkey % 3 AS STRING) || '.example/announce'
    WHEN l_partkey % 3 = 0 THEN 'supplier' || lpad(CAST(l_suppkey % 90 AS STRING), 9, '0')
    ELSE 'supplier' || lpad(CAST(4 + 9 * (l_suppkey % 11) AS STRING), 9, '0') END AS spec
FROM {lineitem}"""


def list_lines(spark, sf_dir, text):
    rows = number_rows(S.select(spark, sf_dir, text), ["list_path"], ["c_custkey"], "line_no")
    return rows.select("list_path", (F.col("line_no") + 1).alias("line_no"), "line")


def user_list(spark, sf_dir):
    """One user's list: the first entry of each id over all lists."""
    kept, _ = parse_tracker_lists(list_lines(spark, sf_dir, LIST_LINES))
    ranked = first_occurrence(kept, ["id"], F.struct(F.col("list_path"), F.col("line_no")))
    return ranked.filter("is_first").drop("is_first").withColumn("health", F.lit("UNCHECKED"))


def merged(spark, sf_dir):
    return C.merge_catalogue(S.select(spark, sf_dir, BUNDLED), user_list(spark, sf_dir))


def resolved(spark, sf_dir):
    rows, longest, lines = S.sized_tracks(spark, sf_dir, SPECS)
    keys, _ = parse_passkeys(list_lines(spark, sf_dir, KEY_LINES))
    bundled = S.select(spark, sf_dir, BUNDLED).drop("entry_no")
    return C.resolve_trackers(rows, bundled, keys.drop("list_path"), longest, lines)


def resolved_rows(spark, sf_dir):
    return resolved(spark, sf_dir).withColumn("warnings", F.array_join("warnings", ","))


def tiers(spark, sf_dir):
    """Announce tiers out of page addresses, with repeats and blanks."""
    rows = S.table(spark, sf_dir, "pages")
    url = F.col("url")
    lists = F.array(F.array(url, F.lit(""), url), F.array(F.lit("")), F.array(F.lit("http://b"), F.lit("http://c"), F.lit("http://b")))
    announce = F.when(F.expr("page_id % 3 = 0"), url).when(F.expr("page_id % 3 = 1"), F.lit("http://a")).otherwise("")
    made = T.announce_tiers(announce, F.when(F.expr("page_id % 5 <> 0"), lists))
    return rows.select(
        "page_id", F.array_join(F.transform(made, lambda t: F.array_join(t, ",")), ";").alias("tiers"),
        F.array_join(F.flatten(made), ",").alias("flat"),
    )


CLIPS = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS frames, 44100 AS sample_rate,
  CASE WHEN l_partkey % 8 = 0 THEN CAST(l_partkey % 100 AS DOUBLE) WHEN l_partkey % 97 = 1 THEN CAST(-1 AS DOUBLE) END AS start,
  CASE WHEN l_partkey % 6 = 0 THEN CAST(l_partkey % 50 AS DOUBLE) END AS length
FROM {lineitem}"""
MODES = ["320", "256k", "v0", "v2", "33"]


def clips(spark, sf_dir):
    rows, _ = S.tracks(spark, sf_dir, CLIPS)
    return K.clip_plan(rows, MODES, 1_000_000).drop("sample_rate")


AMOUNTS = "SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM {orders}"
TEXT_FORMS = """
SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN CAST(o_custkey AS STRING) || ':30'
  WHEN 2 THEN '1:02:' || CAST(o_custkey % 70 AS STRING) WHEN 3 THEN ' 1:30.5 ' WHEN 4 THEN '1:2:3:4' WHEN 5 THEN CAST(o_custkey AS STRING) || 'K'
  WHEN 6 THEN '1.5MiB' WHEN 7 THEN CAST(o_custkey % 9 AS STRING) || ' mb' WHEN 8 THEN 'x' WHEN 9 THEN '' WHEN 10 THEN '0' ELSE '-5' END AS raw
FROM {orders}"""


def parsed_text(spark, sf_dir):
    rows = S.select(spark, sf_dir, TEXT_FORMS)
    return rows.select("id", "raw", D.parse_time(F.col("raw")).alias("secs"), D.parse_size(F.col("raw")).alias("bytes"))


def shown(spark, sf_dir):
    rows, n = S.select(spark, sf_dir, AMOUNTS), F.col("n")
    secs = n / 7.0
    return rows.select(
        "id", "n", D.bytes_text(n).alias("binary_text"), D.bytes_text(n * 100_000).alias("big_text"), D.format_size(n).alias("size_text"),
        D.format_limit(n * 10).alias("limit_text"), D.format_time(secs).alias("time_text"), D.duration_precise(secs).alias("precise"),
        D.duration_short(secs).alias("short"), D.epoch_text(n * 20 - 300_000_000).alias("epoch"), D.format_length(n / 4.0).alias("length_text"),
        D.pieces_phrase(F.when(F.expr("n % 2 = 0"), F.array(n)).otherwise(F.array(n, n + 1))).alias("phrase"),
    )


FILES = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  's' || CAST(l_orderkey AS STRING) || '/f' || CAST(l_partkey AS STRING) || '.' || CASE l_partkey % 10 WHEN 0 THEN 'SHN' WHEN 1 THEN 'wav' WHEN 2 THEN 'ape'
    WHEN 3 THEN 'txt' WHEN 4 THEN 'fla' WHEN 5 THEN 'WAVE' WHEN 6 THEN 'tta' ELSE 'flac' END AS path,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS file_size
FROM {lineitem}"""
FORMAT = """CASE lower(split_part(path, '.', 2)) WHEN 'flac' THEN 'FLAC' WHEN 'fla' THEN 'FLAC' WHEN 'wav' THEN 'WAV' WHEN 'wave' THEN 'WAV'
  WHEN 'shn' THEN 'SHN' WHEN 'ape' THEN 'APE' WHEN 'tta' THEN 'TTA' END"""
NEEDS = "CASE f WHEN 'SHN' THEN 'NEEDS shntool' WHEN 'APE' THEN 'NEEDS mac' WHEN 'TTA' THEN 'NEEDS ttaenc' END"


def split(spark, sf_dir, bare=False):
    rows, _ = S.tracks(spark, sf_dir, FILES)
    return I.split_readable(rows, bare)


def classified(spark, sf_dir):
    good, bad = split(spark, sf_dir, bare=True)
    return I.union_sets(good.withColumn("reason", F.lit(None).cast("string")), bad).select("set_id", "ordinal", "path", "format", "reason")


def unions(spark, sf_dir):
    good, _ = split(spark, sf_dir)
    return I.union_sets(good, good).groupBy("set_id").agg(F.count(F.lit(1)).alias("files"))


def formats(spark, sf_dir):
    rows, _ = S.tracks(spark, sf_dir, FILES)
    named = rows.withColumn("format", M.classify_format(F.col("path"))).withColumn("file_name", M.base_name(F.col("path")))
    return set_format(named.filter(F.col("format").isNotNull()))


VERIFIED = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, c_mktsegment AS band, CAST(year(o_orderdate) AS BIGINT) AS year,
  CASE WHEN l_partkey % 4 = 0 THEN 'WAV' ELSE 'FLAC' END AS format, CAST(round(l_extendedprice * 100) AS BIGINT) AS file_size,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE md5(CAST(l_partkey AS STRING)) END AS stored,
  CASE WHEN l_partkey % 17 = 0 THEN md5('other') ELSE md5(CAST(l_partkey AS STRING)) END AS computed,
  CASE WHEN l_partkey % 41 = 0 THEN 'cut short' END AS error, CASE WHEN l_suppkey % 5 = 0 THEN 8 ELSE 16 END AS bits
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey"""
STATUS = "CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN stored IS NULL THEN 'NO_MD5' WHEN stored = computed THEN 'OK' ELSE 'MISMATCH' END"


def verified(spark, sf_dir):
    rows = S.select(spark, sf_dir, VERIFIED)
    status = M.verify_outcome(F.col("stored"), F.col("computed"), F.col("error"))
    return rows.withColumn("status", status)


def verification(spark, sf_dir):
    rows = verified(spark, sf_dir).withColumn("fails", M.fails_run(F.col("status")))
    return rows.groupBy("set_id", "status", "fails").agg(F.count(F.lit(1)).alias("files"))


def conversions(spark, sf_dir):
    rule = M.conversion_checked(F.col("format"), F.col("bits"), F.col("stored"), F.col("computed"))
    rows = S.select(spark, sf_dir, VERIFIED).withColumn("r", rule)
    return rows.groupBy("set_id", "format", "r.checked", "r.outcome", "r.may_set_aside").agg(F.count(F.lit(1)).alias("files"))


def rollup(spark, sf_dir):
    return I.collection_rollup(verified(spark, sf_dir), ["band", "year", "format"], ["MISMATCH", "FAILED"])


PROVENANCE = """
SELECT l_orderkey AS set_id, CASE WHEN l_partkey % 2 = 0 THEN 'FLAC -> WAV' ELSE 'WAV -> FLAC' END AS operation,
  'in' || CAST(l_partkey AS STRING) AS input, 'out' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS output,
  CASE WHEN l_partkey % 2 = 0 THEN 'ledger' ELSE 'flac' END AS agent, CASE WHEN l_partkey % 2 = 0 THEN '1.0' ELSE 'flac 1.' || CAST(l_suppkey % 3 AS STRING) END AS version,
  CASE WHEN l_partkey % 2 = 1 THEN '/bin/flac' END AS tool_path, CASE WHEN l_partkey % 2 = 1 THEN sha2_text END AS sha256,
  'flac -' || CAST(l_suppkey % 9 AS STRING) AS args, l_partkey % 2 = 1 AS ran
FROM (SELECT *, md5(CAST(l_suppkey % 3 AS STRING)) AS sha2_text FROM {lineitem}) l"""


def provenance(spark, sf_dir):
    rows = S.select(spark, sf_dir, PROVENANCE)
    return rows.withColumn("argv", F.when(F.col("ran"), F.split("args", " ")))


PROV_TEXT = """operation || ': ' || input || ' -> ' || output || chr(10) || CASE WHEN tool_path IS NULL THEN '  in-process (' || agent || ' ' || version || ')'
  ELSE '  ' || version || chr(10) || '  ' || tool_path || ' (sha256 ' || sha256 || ')' || chr(10) || '  argv: ' || args END || chr(10)"""

LIST_PARSE = f"""
l AS (SELECT list_path, line_zero + 1 AS line_no, trim(line, chr(13) || ' ') AS s FROM ({S.numbered(LIST_LINES, 'list_path', 'c_custkey', 'line_zero')})),
c AS (SELECT *, list_transform(str_split(s, '|'), lambda x: trim(x)) AS cells FROM l WHERE s <> '' AND NOT starts_with(s, '#')),
e AS (SELECT list_path, line_no, cells[1] AS name, cells[2] AS announce, cells[3:] AS extra,
  list_filter(cells[3:], lambda x: starts_with(x, 'id=')) AS ids, list_filter(cells[3:], lambda x: starts_with(x, 'source=')) AS srcs FROM c),
f AS (SELECT list_path, line_no, coalesce(trim(substr(ids[-1], 4)), lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'))) AS id, name, announce,
  coalesce(list_contains(extra, 'private'), FALSE) AS private, trim(substr(srcs[-1], 8)) AS source,
  len(list_filter(extra, lambda x: x NOT IN ('', 'private') AND NOT starts_with(x, 'id=') AND NOT starts_with(x, 'source='))) AS strange FROM e),
g AS (SELECT *, CASE WHEN announce IS NULL THEN 'NO_BAR' WHEN name = '' THEN 'NO_NAME' WHEN announce = '' THEN 'NO_URL' WHEN strange > 0 THEN 'UNKNOWN_FIELD' WHEN id = '' THEN 'NO_ID' END AS bad FROM f),
h AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY list_path, id, bad ORDER BY line_no) > 1 THEN 'DUPLICATE_ID' END AS detail FROM g)"""
USER = f"{LIST_PARSE}, u AS (SELECT * FROM h WHERE detail IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_path, line_no) = 1), b AS ({S.plain(BUNDLED)})"
MERGED = f"""
WITH {USER}, m AS (
SELECT b.id, b.name, b.announce, b.private, b.source, b.health, CASE WHEN u.id IS NULL THEN 'BUNDLED' ELSE 'OVERRIDDEN' END AS origin, 0 AS block, b.entry_no AS place,
  CASE WHEN u.id IS NULL THEN 0 ELSE 1 END AS after FROM b LEFT JOIN u ON b.id = u.id
UNION ALL SELECT u.id, u.name, u.announce, u.private, u.source, 'UNCHECKED', 'USER', CASE WHEN b.id IS NULL THEN 1 ELSE 0 END, coalesce(b.entry_no, u.line_no), 0
FROM u LEFT JOIN b ON b.id = u.id)"""
KEYS = f"""
kl AS (SELECT *, trim(line) AS s FROM ({S.numbered(KEY_LINES, 'list_path', 'c_custkey', 'line_zero')}) WHERE NOT starts_with(line, '#')),
keys AS (SELECT list_path, trim(split_part(s, '|', 1)) AS id, arg_max(trim(substr(s, instr(s, '|') + 1)), line_zero) AS passkey FROM kl WHERE contains(s, '|') GROUP BY 1, 2)"""
RESOLVED = f"""
WITH b AS ({S.plain(BUNDLED)}), {KEYS}, s AS ({S.tracks_sql(SPECS)}),
o AS (SELECT set_id, ordinal, spec, contains(spec, '://') AS is_url, CASE WHEN contains(spec, '://') THEN spec WHEN contains(announce, {KEYED}) THEN replace(announce, {KEYED}, passkey) ELSE announce END AS full_url,
  CASE WHEN NOT contains(spec, '://') THEN coalesce(private, FALSE) ELSE FALSE END AS prv, source AS src, health, b.id IS NULL AS missing
  FROM s LEFT JOIN b ON s.spec = b.id LEFT JOIN keys k ON s.spec = k.id),
q AS (SELECT *, arg_min(src, ordinal) FILTER (WHERE src IS NOT NULL) OVER (PARTITION BY set_id) AS first_src, sum(prv::INT) OVER (PARTITION BY set_id) AS sites,
  full_url IS NOT NULL AND row_number() OVER (PARTITION BY set_id, full_url ORDER BY ordinal) = 1 AS leads FROM o),
r AS (SELECT *, CASE WHEN NOT is_url AND missing THEN 'UNKNOWN_ID' WHEN health = 'BROKEN' THEN 'BROKEN' WHEN full_url IS NULL THEN 'NO_PASSKEY' WHEN src <> first_src THEN 'SOURCE_CONFLICT' END AS why FROM q),
z AS (SELECT set_id, min(ordinal) AS bad_at, arg_min(why, ordinal) AS bad FROM r WHERE why IS NOT NULL GROUP BY set_id),
res AS (SELECT r.set_id, ordinal, spec, CASE WHEN bad IS NULL AND leads THEN full_url END AS url,
  CASE WHEN bad IS NULL AND leads THEN CAST(sum(leads::INT) OVER (PARTITION BY r.set_id ORDER BY ordinal) AS BIGINT) - 1 END AS tier,
  concat_ws(',', CASE WHEN health IN ('UNREACHABLE', 'PERSONAL_UPLOAD') THEN health END, CASE WHEN NOT first_row THEN 'DUPLICATE_URL' END) AS warnings,
  CAST(sites AS BIGINT) AS private_sites, CASE WHEN bad IS NULL THEN first_src END AS source, bad AS refused, bad_at AS refused_at
  FROM (SELECT *, row_number() OVER (PARTITION BY set_id, full_url ORDER BY ordinal) = 1 AS first_row FROM r) r LEFT JOIN z USING (set_id))"""

KBPS = "CASE mode WHEN '320' THEN 320 WHEN '256k' THEN 256 WHEN 'v0' THEN 245 WHEN 'v2' THEN 190 END"
CLIP_SQL = f"""
WITH t AS (SELECT set_id, ordinal, frames, mode, {KBPS} AS kbps, frames / 44100.0::DOUBLE AS secs, start AS want_start, length AS want_length
  FROM ({S.tracks_sql(CLIPS)}), (SELECT unnest(['320', '256k', 'v0', 'v2', '33']) AS mode)),
a AS (SELECT *, CASE WHEN kbps IS NOT NULL THEN floor((1000000 - 6144) * 8.0::DOUBLE / 1000.0 / kbps) END AS longest FROM t),
b AS (SELECT *, CASE WHEN kbps IS NULL THEN 1.0 ELSE least(greatest(longest, 1.0), 30.0) END AS fit FROM a),
c AS (SELECT *, coalesce(want_length, CASE WHEN secs IS NULL THEN fit ELSE greatest(least(fit, floor(secs)), 1.0) END) AS len FROM b),
d AS (SELECT *, coalesce(want_start, CASE WHEN secs IS NULL THEN 0.0 ELSE floor(greatest((secs - greatest(least(len, floor(secs)), 1.0)) / 2.0, 0.0)) END) AS st FROM c),
e AS (SELECT *, CASE WHEN kbps IS NOT NULL THEN CAST(ceil(greatest(len, 0.0) * kbps * 1000.0 / 8.0) AS BIGINT) + 6144 END AS estimate, CAST(round(st * 44100) AS BIGINT) AS f0 FROM d),
f AS (SELECT *, CASE WHEN kbps IS NULL THEN 'BAD_MODE' WHEN st < 0 OR len <= 0 THEN 'BAD_CLIP' WHEN mode NOT LIKE 'v%' AND estimate > 1000000 THEN 'TOO_LARGE' WHEN f0 >= frames THEN 'START_PAST_END' END AS refused FROM e)
SELECT set_id, ordinal, frames, mode, CAST(st AS DOUBLE) AS start, CAST(len AS DOUBLE) AS length, estimate, CAST(longest AS DOUBLE) AS longest,
  CASE WHEN refused IS NULL THEN f0 END AS from_frame, CASE WHEN refused IS NULL THEN least(f0 + CAST(round(len * 44100) AS BIGINT), frames) END AS to_frame, refused FROM f"""


def units(x):
    cases = " ".join(
        f"WHEN {x} < {1024 ** (k + 1)} THEN printf('%.1f', {x} / {float(1024 ** k)}::DOUBLE) || ' {u}'" for k, u in ((1, "KiB"), (2, "MiB"), (3, "GiB"))
    )
    return f"CASE WHEN {x} < 1024 THEN {x} || ' B' {cases} ELSE printf('%.1f', {x} / {float(1024 ** 4)}::DOUBLE) || ' TiB' END"


def two(x):
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


DISPLAY = f"""
WITH a AS (SELECT *, n / 7.0::DOUBLE AS s FROM ({S.plain(AMOUNTS)})),
b AS (SELECT *, CAST(floor(s) AS BIGINT) AS w, CAST(round(s * 1000) AS BIGINT) AS ms, CAST(round(s) AS BIGINT) AS r, n * 20 - 300000000 AS ep FROM a)
SELECT id, n, {units('n')} AS binary_text, {units('(n * 100000)')} AS big_text,
  CASE WHEN n >= 10000000 THEN printf('%.1f', n / 1e6::DOUBLE) || ' MB' ELSE ((n + 999) // 1000) || ' KB' END AS size_text,
  CASE WHEN n * 10 % 1000000 = 0 THEN (n * 10 // 1000000) || 'M' WHEN n * 10 % 1000 = 0 THEN (n * 10 // 1000) || 'K' ELSE CAST(n * 10 AS VARCHAR) END AS limit_text,
  CASE WHEN w >= 3600 THEN (w // 3600) || ':' || {two('w // 60 % 60')} || ':' || {two('w % 60')} ELSE (w // 60) || ':' || {two('w % 60')} END AS time_text,
  (ms // 60000) || ':' || {two('ms % 60000 // 1000')} || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS precise,
  (r // 60) || ':' || {two('r % 60')} AS short, strftime(make_timestamp(ep * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS epoch,
  CASE WHEN n % 4 = 0 THEN CAST(n // 4 AS VARCHAR) ELSE printf('%.1f', n / 4.0::DOUBLE) END AS length_text,
  CASE WHEN n % 2 = 0 THEN 'piece ' || n ELSE 'pieces ' || n || ', ' || (n + 1) END AS phrase FROM b"""

QUERIES = {
    "read_tracker_lists": (
        lambda spark, sf_dir: parse_tracker_lists(list_lines(spark, sf_dir, LIST_LINES))[0],
        f"WITH {LIST_PARSE} SELECT list_path, line_no, id, name, announce, private, source FROM h WHERE detail IS NULL",
    ),
    "bad_tracker_lines": (
        lambda spark, sf_dir: parse_tracker_lists(list_lines(spark, sf_dir, LIST_LINES))[1],
        f"WITH {LIST_PARSE} SELECT list_path, line_no, detail FROM h WHERE detail IS NOT NULL",
    ),
    "read_passkeys": (
        lambda spark, sf_dir: parse_passkeys(list_lines(spark, sf_dir, KEY_LINES))[0],
        f"WITH {KEYS} SELECT * FROM keys",
    ),
    "merge_catalogue": (merged, f"{MERGED} SELECT * FROM m"),
    "catalogue_counts": (
        lambda spark, sf_dir: C.catalogue_counts(merged(spark, sf_dir)),
        f"""{MERGED} SELECT count(*) FILTER (WHERE health NOT IN ('BROKEN', 'UNREACHABLE')) AS usable, count(*) FILTER (WHERE health NOT IN ('BROKEN', 'UNREACHABLE')) AS responding
FROM m WHERE origin <> 'OVERRIDDEN'""",
    ),
    "resolve_trackers": (resolved_rows, f"{RESOLVED} SELECT * FROM res"),
    "resolved_sets": (
        lambda spark, sf_dir: C.resolved_sets(resolved(spark, sf_dir)),
        f"""{RESOLVED} SELECT set_id, count(url) AS tiers, max(private_sites) > 0 AS private, max(source) AS source, max(private_sites) > 1 AS several_private, max(refused) AS refused
FROM res GROUP BY set_id""",
    ),
    "announce_tiers": (
        tiers,
        """WITH p AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'http://a' ELSE '' END AS a, CASE WHEN page_id % 5 <> 0 THEN url || ';http://b,http://c' ELSE '' END AS t FROM pages),
q AS (SELECT page_id, CASE WHEN a = '' OR (page_id % 5 <> 0 AND a = url) THEN t WHEN t = '' THEN a ELSE a || ';' || t END AS tiers FROM p)
SELECT page_id, tiers, replace(tiers, ';', ',') AS flat FROM q""",
    ),
    "clip_plan": (clips, CLIP_SQL),
    "parse_time_size": (
        parsed_text,
        f"""SELECT id, raw, CASE id % 12 WHEN 0 THEN CAST(raw AS DOUBLE) WHEN 1 THEN CAST(split_part(raw, ':', 1) AS DOUBLE) * 60 + 30
    WHEN 2 THEN CASE WHEN CAST(split_part(raw, ':', 3) AS INT) < 60 THEN 3720 + CAST(split_part(raw, ':', 3) AS DOUBLE) END WHEN 3 THEN 90.5::DOUBLE WHEN 10 THEN 0.0::DOUBLE END AS secs,
  CASE id % 12 WHEN 0 THEN nullif(CAST(raw AS BIGINT), 0) WHEN 5 THEN nullif(CAST(split_part(raw, 'K', 1) AS BIGINT), 0) * 1000 WHEN 6 THEN 1572864
    WHEN 7 THEN nullif(CAST(substr(raw, 1, 1) AS BIGINT), 0) * 1000000 END AS bytes FROM ({S.plain(TEXT_FORMS)})""",
    ),
    "display_text": (shown, DISPLAY),
    "classify_format": (
        classified,
        f"""SELECT set_id, ordinal, path, f AS format, CASE WHEN f IS NULL THEN 'UNKNOWN_FORMAT' ELSE {NEEDS} END AS reason FROM (SELECT *, {FORMAT} AS f FROM ({S.tracks_sql(FILES)}))""",
    ),
    "format_summary": (
        lambda spark, sf_dir: I.format_summary(*split(spark, sf_dir)),
        f"""WITH a AS (SELECT *, {FORMAT} AS f FROM ({S.tracks_sql(FILES)})), b AS (SELECT set_id, f, count(*) AS n, min(ordinal) AS o FROM a WHERE f IN ('FLAC', 'WAV') GROUP BY ALL),
c AS (SELECT set_id, CAST(sum(n) AS BIGINT) AS files, string_agg(n || ' ' || f, ', ' ORDER BY o) AS t FROM b GROUP BY set_id),
d AS (SELECT set_id, count(*) AS skipped FROM a WHERE f NOT IN ('FLAC', 'WAV') GROUP BY set_id)
SELECT set_id, coalesce(files, 0) AS files, coalesce(skipped, 0) AS skipped, CASE WHEN files IS NULL THEN 'no audio files' ELSE files || ' files: ' || t || CASE WHEN skipped > 0 THEN ' (' || skipped || ' skipped)' ELSE '' END END AS summary
FROM c FULL JOIN d USING (set_id)""",
    ),
    "set_format": (
        formats,
        f"""WITH a AS (SELECT *, {FORMAT} AS f, split_part(path, '/', 2) AS file_name FROM ({S.tracks_sql(FILES)})), b AS (SELECT * FROM a WHERE f IS NOT NULL),
c AS (SELECT set_id, arg_min(f, ordinal) AS lead, arg_min(file_name, ordinal) AS lead_name FROM b GROUP BY set_id),
d AS (SELECT b.set_id, arg_min(file_name, ordinal) AS other FROM b JOIN c USING (set_id) WHERE f <> lead GROUP BY b.set_id),
e AS (SELECT c.*, other, CASE WHEN lead NOT IN ('FLAC', 'WAV') THEN 'UNSUPPORTED' WHEN other IS NOT NULL THEN 'MIXED' END AS refused FROM c LEFT JOIN d USING (set_id))
SELECT set_id, CASE WHEN refused IS NULL THEN lead END AS format, refused, CASE refused WHEN 'UNSUPPORTED' THEN lead_name WHEN 'MIXED' THEN other END AS offender FROM e""",
    ),
    "union_sets": (
        unions,
        f"""SELECT set_id, count(*) * 2 AS files FROM (SELECT *, {FORMAT} AS f FROM ({S.plain(FILES)})) WHERE f IN ('FLAC', 'WAV') GROUP BY set_id""",
    ),
    "verify_outcome": (
        verification,
        f"""SELECT set_id, status, status IN ('MISMATCH', 'FAILED') AS fails, count(*) AS files FROM (SELECT *, {STATUS} AS status FROM ({S.plain(VERIFIED)})) GROUP BY ALL""",
    ),
    "conversion_checked": (
        conversions,
        f"""WITH a AS (SELECT *, stored IS NOT NULL AND (format = 'FLAC' OR bits <> 8) AS checked FROM ({S.plain(VERIFIED)})),
b AS (SELECT *, CASE WHEN format = 'WAV' AND stored IS NULL THEN 'REFUSED' WHEN checked AND stored <> computed THEN 'REFUSED' ELSE 'CONVERTED' END AS outcome FROM a)
SELECT set_id, format, checked, outcome, checked AND outcome = 'CONVERTED' AS may_set_aside, count(*) AS files FROM b GROUP BY ALL""",
    ),
    "collection_rollup": (
        rollup,
        f"""SELECT band, year, format, CAST(grouping(band, year, format) AS BIGINT) AS level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE {STATUS} IN ('MISMATCH', 'FAILED')) AS failures FROM ({S.plain(VERIFIED)}) GROUP BY ROLLUP (band, year, format)""",
    ),
    "render_provenance": (
        lambda spark, sf_dir: render_provenance(provenance(spark, sf_dir)).select("set_id", "output", "text"),
        f"SELECT set_id, output, {PROV_TEXT} AS text FROM ({S.plain(PROVENANCE)})",
    ),
    "provenance_audit": (
        lambda spark, sf_dir: provenance_audit(provenance(spark, sf_dir)),
        f"""SELECT operation, agent, version, sha256, count(*) AS outputs, count(DISTINCT CASE WHEN ran THEN args END) AS argument_lists, min(output) AS first_output
FROM ({S.plain(PROVENANCE)}) GROUP BY ALL""",
    ),
}
