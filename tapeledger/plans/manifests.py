"""Manifests, twins and snapshots over the stand-in text files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.operators import manifests as M
from tapeledger.operators.ordered import longest_set, number_rows
from tapeledger.plans import standins as S

BODY = "substr(text, instr(text, chr(10)) + 1)"
NAME = "'doc_' || CAST(doc_id AS STRING) || '.txt'"
KIND = "CASE WHEN length(source) = 4 OR doc_id % 3 = 0 THEN 'md5' WHEN doc_id % 3 = 1 THEN 'ffp' ELSE 'st5' END"

# Digests of the files that exist: the lists name some that are not there, some are unreadable.
DIGESTS = f"""
SELECT source AS set_id, source AS dir, {NAME} AS file_name, doc_id, {KIND} AS kind,
       CASE WHEN doc_id % 101 = 9 THEN NULL WHEN {KIND} = 'md5' THEN md5(text) ELSE md5({BODY}) END AS digest,
       CASE WHEN doc_id % 101 = 9 THEN 'unreadable' END AS error
FROM {{documents}}"""
PRESENT = f"{DIGESTS} WHERE doc_id % 89 <> 7"

# What the lists say: altered digests, upper case, comments, broken lines, both line ends.
LINES = f"""
SELECT list_path, doc_id,
       CASE WHEN doc_id % 107 = 3 THEN '; ' || name
            WHEN doc_id % 103 = 2 AND kind = 'ffp' THEN name
            WHEN doc_id % 103 = 2 AND doc_id % 2 = 0 THEN 'abcd  ' || name
            WHEN doc_id % 103 = 2 THEN 'nothex  ' || name
            WHEN kind = 'ffp' THEN name || ':' || hash
            WHEN kind = 'md5' AND doc_id % 2 = 0 THEN hash || ' *' || name
            WHEN kind = 'md5' THEN hash || '  ' || name
            WHEN doc_id % 2 = 0 THEN hash || '  [shntool]  ' || name
            ELSE hash || '  ' || name END
       || CASE WHEN doc_id % 5 = 0 THEN chr(13) ELSE '' END AS line
FROM (SELECT *, source || '/' || source || '.' || kind AS list_path,
             CASE WHEN doc_id % 83 = 11 THEN upper(raw) ELSE raw END AS hash
      FROM (SELECT doc_id, source, {NAME} AS name, {KIND} AS kind,
                   CASE WHEN doc_id % 97 = 5 THEN md5(text || '!') WHEN {KIND} = 'md5' THEN md5(text)
                        ELSE md5({BODY}) END AS raw
            FROM {{documents}}))"""

# Two snapshots of all files, and two between which some were added or removed.
BEFORE_ALL = f"""
SELECT source || '/' || {NAME} AS path, md5(text) AS file_md5, md5({BODY}) AS audio_md5
FROM {{documents}}"""
BEFORE = f"{BEFORE_ALL} WHERE doc_id % 43 <> 7"
AFTER_ALL = f"""
SELECT CASE WHEN doc_id % 29 = 3 THEN 'moved/' ELSE '' END || source || '/' || {NAME} AS path,
       CASE WHEN doc_id % 31 = 4 OR doc_id % 37 = 5 THEN md5('new' || text) ELSE md5(text) END AS file_md5,
       CASE WHEN doc_id % 37 = 5 THEN md5({BODY} || 'x') ELSE md5({BODY}) END AS audio_md5
FROM {{documents}}"""
AFTER = f"{AFTER_ALL} WHERE doc_id % 41 <> 6"

# Files of one set in several formats, twins by stem.
STEM = """'f' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) || '_' || CAST(l_linenumber AS STRING)
  || '_' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)"""
TWIN_FILES = f"""
SELECT CAST(l_orderkey AS STRING) AS dir, {STEM} || '.flac' AS file_name, 'FLAC' AS format,
       CASE WHEN l_partkey % 19 = 4 THEN NULL ELSE md5(CAST(l_partkey AS STRING)) END AS audio_md5
FROM {{lineitem}}
UNION ALL
SELECT CAST(l_orderkey AS STRING), CASE WHEN l_partkey % 3 = 0 THEN 'alone' ELSE '' END || {STEM} || '.wav', 'WAV',
       md5(CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 17 = 3 THEN 'x' ELSE '' END)
FROM {{lineitem}}"""


def lines(spark, sf_dir):
    rows = number_rows(S.select(spark, sf_dir, LINES), ["list_path"], ["doc_id"], "line_no")
    return rows.drop("doc_id").withColumn("line_no", F.col("line_no") + 1)


def manifest(spark, sf_dir):
    return M.parse_manifests(lines(spark, sf_dir))


def digests(spark, sf_dir):
    rows = S.select(spark, sf_dir, DIGESTS)
    longest = longest_set(rows.select("set_id"), ["set_id"])
    return number_rows(rows, ["set_id"], ["file_name"], longest=longest), longest


CHECK_COLUMNS = ["dir", "list_path", "kind", "line_no", "file_name", "status", "expected", "actual", "error"]


def check(spark, sf_dir):
    good, _ = manifest(spark, sf_dir)
    return M.check_manifest(good, S.select(spark, sf_dir, PRESENT)).select(CHECK_COLUMNS)


def check_all(spark, sf_dir):
    good, _ = manifest(spark, sf_dir)
    checked = M.check_all_lists(good, S.select(spark, sf_dir, PRESENT))
    return checked.select("dir", "list_path", "line_no", "label", "status")


def tally(spark, sf_dir):
    return M.outcome_tally(
        check(spark, sf_dir), ["dir"], ["OK", "MISSING", "MISMATCH", "FAILED"], ["MISSING", "MISMATCH", "FAILED"]
    )


def audit_unchanged(spark, sf_dir):
    before = S.select(spark, sf_dir, BEFORE_ALL).withColumn("path", F.expr("regexp_extract(path, '[^/]*$', 0)"))
    after = S.select(spark, sf_dir, AFTER_ALL).withColumn("path", F.expr("regexp_extract(path, '[^/]*$', 0)"))
    return M.audio_unchanged(before, after)


def complete(spark, sf_dir):
    rows, longest = digests(spark, sf_dir)
    return M.complete_only(rows.drop("doc_id"), longest).select("set_id", "ordinal", "file_name", "digest")


def rendered(spark, sf_dir):
    rows, longest = digests(spark, sf_dir)
    return M.render_manifests(rows, "st5", "partial", longest)


TWIN_PARSE = f"""
l AS (SELECT *, trim(replace(line, chr(13), '')) AS s, split_part(list_path, '.', 2) AS kind,
        split_part(list_path, '/', 1) AS dir
      FROM ({S.numbered(LINES, 'list_path', 'doc_id', 'line_zero')})),
c AS (SELECT *, line_zero + 1 AS line_no,
        CASE WHEN kind = 'ffp' THEN regexp_extract(s, '^(.*):([^:]*)$', 1)
             WHEN contains(s, '  [shntool]  ') THEN split_part(s, '  [shntool]  ', 2)
             ELSE regexp_extract(s, '^(\\S+)\\s+\\*?(.*)$', 2) END AS name,
        lower(CASE WHEN kind = 'ffp' THEN regexp_extract(s, '^(.*):([^:]*)$', 2)
             WHEN contains(s, '  [shntool]  ') THEN split_part(s, '  [shntool]  ', 1)
             ELSE regexp_extract(s, '^(\\S+)\\s', 1) END) AS hash
      FROM l WHERE s <> '' AND NOT starts_with(s, ';') AND NOT starts_with(s, '#')),
p AS (SELECT *, CASE WHEN kind = 'ffp' AND NOT contains(s, ':') THEN 'expected "name:hash"'
             WHEN kind <> 'ffp' AND NOT regexp_matches(s, '\\s') THEN 'expected "hash  name"'
             WHEN NOT regexp_full_match(hash, '([0-9a-f][0-9a-f])*') THEN 'not hexadecimal'
             WHEN length(hash) <> 32 THEN 'digest is not 16 bytes' END AS detail FROM c),
m AS (SELECT dir, list_path, kind, line_no, name AS file_name, hash AS digest FROM p WHERE detail IS NULL)"""

TWIN_CHECK = f"""{TWIN_PARSE},
d AS ({S.plain(PRESENT)}),
r AS (SELECT m.*, CASE WHEN d.file_name IS NULL THEN 'MISSING' WHEN d.error IS NOT NULL THEN 'FAILED'
             WHEN m.digest = d.digest THEN 'OK' ELSE 'MISMATCH' END AS status,
        d.digest AS found, d.error AS problem
      FROM m LEFT JOIN d ON m.dir = d.dir AND m.file_name = d.file_name AND m.kind = d.kind)"""

SNAPSHOTS = f"b AS ({S.plain(BEFORE)}), a AS ({S.plain(AFTER)})"

QUERIES = {
    "parse_manifest_lines": (
        lambda spark, sf_dir: manifest(spark, sf_dir)[0],
        f"WITH {TWIN_PARSE} SELECT * FROM m",
    ),
    "bad_manifest_lines": (
        lambda spark, sf_dir: manifest(spark, sf_dir)[1],
        f"WITH {TWIN_PARSE} SELECT list_path, line_no, kind, detail FROM p WHERE detail IS NOT NULL",
    ),
    "list_status": (
        lambda spark, sf_dir: M.list_status(*manifest(spark, sf_dir)),
        f"""WITH {TWIN_PARSE} SELECT list_path, count(*) FILTER (WHERE detail IS NULL) AS entries,
  count(*) FILTER (WHERE detail IS NOT NULL) AS bad_lines, bool_and(detail IS NULL) AS list_ok
FROM p GROUP BY list_path""",
    ),
    "check_manifest": (
        check,
        f"""WITH {TWIN_CHECK} SELECT dir, list_path, kind, line_no, file_name, status,
  CASE WHEN status = 'MISMATCH' THEN digest END AS expected, CASE WHEN status = 'MISMATCH' THEN found END AS actual,
  CASE WHEN status = 'FAILED' THEN problem END AS error FROM r""",
    ),
    "check_all_lists": (
        check_all,
        f"""WITH {TWIN_CHECK} SELECT r.dir, list_path, line_no,
  CASE WHEN n > 1 THEN split_part(list_path, '/', 2) || ' · ' || file_name ELSE file_name END AS label, status
FROM r JOIN (SELECT dir, count(DISTINCT list_path) AS n FROM m GROUP BY dir) k ON r.dir = k.dir""",
    ),
    "outcome_tally": (
        tally,
        f"""WITH {TWIN_CHECK} SELECT dir, count(*) FILTER (WHERE status = 'OK') AS ok,
  count(*) FILTER (WHERE status = 'MISSING') AS missing, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch,
  count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) AS done, bool_and(status = 'OK') AS clean
FROM r GROUP BY dir""",
    ),
    "complete_only": (
        complete,
        f"""WITH d AS ({S.numbered(DIGESTS, 'set_id', 'file_name')})
SELECT set_id, ordinal, file_name, digest FROM d
WHERE set_id NOT IN (SELECT set_id FROM d WHERE digest IS NULL)""",
    ),
    "render_manifests": (
        rendered,
        f"""SELECT set_id, ordinal // 10000 AS part,
  string_agg(digest || '  [shntool]  ' || file_name || chr(10), '' ORDER BY ordinal) AS text
FROM ({S.numbered(DIGESTS, 'set_id', 'file_name')}) WHERE digest IS NOT NULL GROUP BY ALL""",
    ),
    "match_twins": (
        lambda spark, sf_dir: M.match_twins(S.select(spark, sf_dir, TWIN_FILES)),
        f"""WITH t AS (SELECT *, regexp_extract(file_name, '^(.*)\\.[a-z]+$', 1) AS stem FROM ({S.plain(TWIN_FILES)})),
f AS (SELECT dir, stem, count(*) AS n, min(file_name) AS flac_name, min(audio_md5) AS flac_md5 FROM t WHERE format = 'FLAC' GROUP BY ALL),
w AS (SELECT dir, stem, count(*) AS n, min(file_name) AS wav_name, min(audio_md5) AS wav_md5 FROM t WHERE format = 'WAV' GROUP BY ALL)
SELECT f.dir, f.stem, flac_name, flac_md5, wav_name, wav_md5, CASE WHEN f.n > 1 OR w.n > 1 THEN 'AMBIGUOUS' WHEN flac_md5 IS NULL OR wav_md5 IS NULL THEN 'UNCHECKED'
       WHEN flac_md5 = wav_md5 THEN 'LOSSLESS' ELSE 'DIFFERS' END AS twin
FROM f JOIN w ON f.dir = w.dir AND f.stem = w.stem""",
    ),
    "duplicate_audio": (
        lambda spark, sf_dir: M.duplicate_audio(S.select(spark, sf_dir, TWIN_FILES)),
        f"""WITH t AS ({S.plain(TWIN_FILES)}), d AS (SELECT audio_md5, count(*) AS copies FROM t WHERE audio_md5 IS NOT NULL GROUP BY audio_md5 HAVING count(*) > 1)
SELECT dir, file_name, audio_md5, copies FROM t JOIN d USING (audio_md5)""",
    ),
    "classify_change": (
        lambda spark, sf_dir: M.classify_change(S.select(spark, sf_dir, BEFORE), S.select(spark, sf_dir, AFTER)),
        f"""WITH {SNAPSHOTS},
g AS (SELECT *, row_number() OVER (PARTITION BY file_md5 ORDER BY path) AS k FROM b WHERE path NOT IN (SELECT path FROM a)),
n AS (SELECT *, row_number() OVER (PARTITION BY file_md5 ORDER BY path) AS k FROM a WHERE path NOT IN (SELECT path FROM b))
SELECT b.path, a.path AS new_path, CASE WHEN b.file_md5 = a.file_md5 THEN 'UNCHANGED'
  WHEN b.audio_md5 = a.audio_md5 THEN 'RETAGGED' ELSE 'AUDIO_CHANGED' END AS change FROM b JOIN a USING (path)
UNION ALL
SELECT g.path, n.path, CASE WHEN n.path IS NULL THEN 'REMOVED' WHEN g.path IS NULL THEN 'ADDED' ELSE 'MOVED' END
FROM g FULL JOIN n ON g.file_md5 = n.file_md5 AND g.k = n.k""",
    ),
    "audio_unchanged": (
        audit_unchanged,
        f"""WITH b AS (SELECT *, split_part(path, '/', -1) AS name FROM ({S.plain(BEFORE_ALL)})), a AS (SELECT *, split_part(path, '/', -1) AS name FROM ({S.plain(AFTER_ALL)}))
SELECT name AS path, b.audio_md5 AS before_md5, a.audio_md5 AS after_md5,
  CASE WHEN b.audio_md5 = a.audio_md5 THEN 'UNCHANGED' ELSE 'AUDIO_CHANGED' END AS verdict FROM b JOIN a USING (name)""",
    ),
}
