"""Names and rename plans over the stand-in shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions import names as N
from tapeledger.operators import rename as R
from tapeledger.operators.ordered import number_rows
from tapeledger.plans import standins as S

DATES = """
SELECT o_orderkey AS id, CASE o_orderkey % 8
  WHEN 0 THEN day WHEN 1 THEN substr(day, 3) WHEN 2 THEN substr(day, 1, 5) || '02-30' WHEN 3 THEN substr(day, 2)
  WHEN 4 THEN substr(day, 1, 8) || '7' WHEN 5 THEN '0000' || substr(day, 5) WHEN 6 THEN CAST(10 + o_orderkey % 89 AS STRING) || substr(day, 5)
  ELSE day || '-01' END AS raw
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {orders}) d"""


def dates(spark, sf_dir):
    parsed = S.select(spark, sf_dir, DATES).withColumn("p", N.parse_show_date(F.col("raw")))
    date, form = F.col("p.date"), F.col("p.year_form")
    return parsed.select(
        "id", "raw", date.alias("show_date"), form.alias("year_form"),
        N.render_show_date(date, form).alias("rendered"), N.render_show_date(date, F.lit("SHORT")).alias("short"),
    )


def track_names(spark, sf_dir):
    rows, _ = S.names(spark, sf_dir)
    parsed = rows.withColumn("p", N.parse_track_name(F.col("file_name")))
    p = [F.col(f"p.{c}") for c in ("band", "date", "year_form", "disc", "track", "suffix", "ext")]
    return parsed.select(
        "set_id", "ordinal", "file_name", p[0].alias("name_band"), p[1].alias("show_date"), p[2].alias("year_form"),
        p[3].alias("disc"), p[4].alias("track"), p[5].alias("suffix"), p[6].alias("ext"),
        N.render_track_name(p[0], p[1], p[2], p[3], p[4], p[5], p[6]).alias("rendered"),
        N.track_label(p[3], p[4], F.col("ordinal") + 1).alias("label"),
        N.destination_name(F.col("path"), "wav").alias("destination"),
    )


def folders(spark, sf_dir):
    rows, _ = S.names(spark, sf_dir)
    parsed = rows.select("set_id", "folder").distinct().withColumn("p", N.parse_show_folder(F.col("folder")))
    return parsed.select(
        "set_id", "folder", F.col("p.band").alias("show_band"), F.col("p.date").alias("show_date"),
        F.col("p.year_form").alias("year_form"), F.array_join("p.segments", "|").alias("segments"),
        F.col("p.format").alias("format"), N.default_output(F.concat(F.lit("shows/"), F.col("folder"))).alias("torrent"),
    )


def info_names(spark, sf_dir):
    rows, _ = S.names(spark, sf_dir)
    first = rows.groupBy("set_id", "folder").agg(F.min_by("file_name", "ordinal").alias("first_track"))
    return first.withColumn("info_file", N.info_file_name(F.col("folder"), F.col("first_track")))


def cleaned(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select(
        "doc_id", N.sanitize(F.col("text")).alias("sanitized"), N.slug(F.col("text")).alias("slug")
    )


SPEC = """
SELECT o_orderkey AS set_id,
       CASE WHEN o_orderkey % 9 = 0 THEN '  ' WHEN o_orderkey % 2 = 0 THEN ' gd ' END AS band,
       CASE WHEN o_orderkey % 7 = 0 THEN '1977-13-01' WHEN o_orderkey % 3 = 0 THEN '77-05-08' END AS date,
       CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN o_orderkey % 4 = 0 THEN ' 2 ' ELSE '' END AS disc,
       o_orderkey % 5 = 0 AS short_year
FROM {orders}"""


def spec(spark, sf_dir):
    rows, longest = S.names(spark, sf_dir)
    fields = S.select(spark, sf_dir, SPEC).join(rows.select("set_id", "folder").distinct(), "set_id")
    return R.name_spec(fields), rows, longest


def targets(spark, sf_dir):
    specs, rows, longest = spec(spark, sf_dir)
    return R.rename_target(rows, specs, longest=longest)


# A plan in which files of a set fall on one another, on others' names, or stay put.
PLAN = """
SELECT set_id, ordinal, path AS from_path,
       CASE WHEN l_partkey % 4 = 0 THEN path
            WHEN l_partkey % 4 = 1 THEN 'shows/' || folder || '/t' || CAST(ordinal % 3 AS STRING) || '.flac'
            ELSE 'shows/' || folder || '/' || band || day || 't' || CAST(ordinal AS STRING) || '.flac' END AS to_path
FROM {base}"""
# Files already on disk under some of the targets.
EXISTING = """
SELECT CASE WHEN l_suppkey % 6 = 0 THEN 'shows/' || folder || '/' || band || day || 't' || CAST(ordinal AS STRING) || '.flac'
            ELSE path END AS path
FROM {base}"""


def collisions(spark, sf_dir):
    rows, longest = S.names(spark, sf_dir)
    return R.rename_collisions(spark.sql(PLAN, base=rows), longest), rows


def conflicts(spark, sf_dir):
    rows, _, lines = S.sized_names(spark, sf_dir)
    return R.rename_conflicts(spark.sql(PLAN, base=rows), spark.sql(EXISTING, base=rows), 3 * lines)


def verdicts(spark, sf_dir):
    rows, _, lines = S.sized_names(spark, sf_dir)
    return R.rename_report(spark.sql(PLAN, base=rows), spark.sql(EXISTING, base=rows), 3 * lines)


# Paths where a file and a folder share the start of their names.
ORDERED = """
SELECT source AS set_id, source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'd' || CAST(doc_id % 7 AS STRING) || '/t' || CAST(doc_id AS STRING)
  WHEN doc_id % 3 = 1 THEN 'd' || CAST(doc_id % 7 AS STRING) || '.' || CAST(doc_id AS STRING) ELSE 'D' || CAST(doc_id AS STRING) END AS path
FROM {documents}"""


def orders(spark, sf_dir):
    rows = S.select(spark, sf_dir, ORDERED)
    by_folder = number_rows(rows, ["set_id"], [N.folder_order(F.col("path"))], "folder_ordinal")
    return number_rows(by_folder, ["set_id"], [N.stream_order(F.col("path"))], "stream_ordinal")


BAND = "'[\\p{L}\\p{N}_-]*\\p{L}[\\p{L}\\p{N}_-]*'"


def dated(names: str, tag: str = "") -> str:
    """Twin of the band-and-date split: every dash of every distinct stem, the first valid one kept."""
    return f"""
stems{tag} AS (SELECT DISTINCT stem FROM ({names})),
spots{tag} AS (SELECT stem, p, y, substr(stem, p - y, y) AS yy, substr(stem, p - y, y + 6) AS t, substr(stem, 1, p - y - 1) AS b, substr(stem, p + 6) AS rest
  FROM (SELECT stem, unnest(range(1, length(stem) + 1)) AS p FROM stems{tag}), (VALUES (4), (2)) v(y)
  WHERE substr(stem, p, 1) = '-' AND p - y >= 1),
good{tag} AS (SELECT *, TRY_CAST(CASE WHEN y = 4 THEN '' WHEN yy <= '30' THEN '20' ELSE '19' END || t AS DATE) AS dt FROM spots{tag}
  WHERE regexp_full_match(t, '[0-9]+-[0-9][0-9]-[0-9][0-9]') AND yy <> '0000' AND regexp_full_match(b, {BAND})),
head{tag} AS (SELECT stem, arg_min(b, p * 10 - y) AS b, arg_min(dt, p * 10 - y) AS dt, arg_min(CASE y WHEN 4 THEN 'LONG' ELSE 'SHORT' END, p * 10 - y) AS form,
  arg_min(rest, p * 10 - y) AS rest FROM good{tag} WHERE dt IS NOT NULL GROUP BY stem)"""


def day_text(date, form):
    return f"CASE WHEN {form} = 'SHORT' THEN strftime({date}, '%y-%m-%d') ELSE strftime({date}, '%Y-%m-%d') END"


NAMES = f"n AS ({S.names_sql()})"

PARSED = f"""
{NAMES},
k AS (SELECT DISTINCT file_name, regexp_extract(file_name, '^(.*)\\.[A-Za-z0-9]+$', 1) AS stem FROM n),
{dated('SELECT stem FROM k')},
tn AS (SELECT file_name, b, dt, form, CAST(nullif(regexp_extract(rest, '^d([0-9]+)t', 1), '') AS BIGINT) AS disc,
  CAST(regexp_extract(rest, '^(?:d[0-9]+)?t([0-9]+)', 1) AS BIGINT) AS track,
  nullif(regexp_extract(rest, '^(?:d[0-9]+)?t[0-9]+(.*)$', 1), '') AS suffix, regexp_extract(file_name, '([A-Za-z0-9]+)$', 1) AS ext
  FROM k JOIN head USING (stem) WHERE regexp_full_match(rest, '(d[0-9]{{1,9}})?t[0-9]{{1,9}}.*'))"""

FOLDER = f"""
fo AS (SELECT DISTINCT set_id, folder, split_part(folder, '.', 1) AS stem FROM n),
{dated('SELECT stem FROM fo', '_f')},
sf AS (SELECT fo.*, b, dt, form, str_split(folder, '.') AS cells FROM fo LEFT JOIN (SELECT * FROM head_f WHERE rest = '') h ON fo.stem = h.stem),
sg AS (SELECT *, CASE WHEN len(cells) > 1 AND cells[-1] IN ('shnf', 'flac16', 'flac24') THEN cells[-1] END AS fmt FROM sf)"""

SPECS = f"""
{FOLDER},
sp AS (SELECT s.set_id, trim(coalesce(s.band, b)) AS band,
  CASE WHEN s.date IS NULL THEN dt WHEN s.date = '77-05-08' THEN DATE '1977-05-08' END AS date, trim(disc) AS d, short_year
  FROM ({S.plain(SPEC)}) s JOIN sg USING (set_id)),
spec AS (SELECT set_id, band, date, TRY_CAST(d AS BIGINT) AS disc, short_year, CASE WHEN coalesce(band, '') = '' THEN 'NO_BAND' WHEN date IS NULL THEN 'BAD_DATE'
  WHEN d = 'x' THEN 'BAD_DISC' END AS error FROM sp)"""

STATUS = f"""
WITH n AS ({S.names_sql()}), p AS ({PLAN.replace('{base}', 'n')}), x AS ({EXISTING.replace('{base}', 'n')}),
c AS (SELECT p.*, CASE WHEN uses > 1 THEN 'COLLISION' WHEN from_path = to_path THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
  FROM p JOIN (SELECT set_id, to_path, count(*) AS uses FROM p GROUP BY ALL) u USING (set_id, to_path)),
bad AS (SELECT set_id, ordinal, to_path FROM c WHERE status = 'CHANGED' AND to_path IN (SELECT path FROM x)
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.set_id = c.set_id AND p.from_path = c.to_path))"""

TRACK_TEXT = "CASE WHEN track < 10 THEN '0' ELSE '' END || track"

QUERIES = {
    "parse_show_date": (
        dates,
        f"""WITH d AS (SELECT *, CASE WHEN regexp_full_match(raw, '([0-9][0-9])?[0-9][0-9]-[0-9][0-9]-[0-9][0-9]') AND raw NOT LIKE '0000%'
  THEN TRY_CAST(CASE WHEN length(raw) = 10 THEN '' WHEN raw < '31' THEN '20' ELSE '19' END || raw AS DATE) END AS dt FROM ({S.plain(DATES)}))
SELECT id, raw, dt AS show_date, CASE WHEN dt IS NOT NULL THEN CASE WHEN length(raw) = 10 THEN 'LONG' ELSE 'SHORT' END END AS year_form,
  CASE WHEN dt IS NOT NULL THEN raw END AS rendered, strftime(dt, '%y-%m-%d') AS short FROM d""",
    ),
    "parse_track_name": (
        track_names,
        f"""WITH {PARSED} SELECT set_id, ordinal, n.file_name, b AS name_band, dt AS show_date, form AS year_form, disc, track, suffix, ext,
  b || {day_text('dt', 'form')} || coalesce('d' || disc, '') || 't' || {TRACK_TEXT} || coalesce(suffix, '') || '.' || ext AS rendered,
  coalesce('d' || disc, '') || 't' || CASE WHEN coalesce(track, ordinal + 1) < 10 THEN '0' ELSE '' END || coalesce(track, ordinal + 1) AS label,
  regexp_replace(path, '\\.[^.]*$', '.wav') AS destination
FROM n LEFT JOIN tn ON n.file_name = tn.file_name""",
    ),
    "parse_show_folder": (
        folders,
        f"""WITH {NAMES}, {FOLDER} SELECT set_id, folder, b AS show_band, dt AS show_date, form AS year_form,
  CASE WHEN b IS NOT NULL THEN array_to_string(CASE WHEN fmt IS NULL THEN cells[2:] ELSE cells[2:len(cells) - 1] END, '|') END AS segments,
  CASE WHEN b IS NOT NULL THEN fmt END AS format, 'shows/' || folder || '.torrent' AS torrent FROM sg""",
    ),
    "info_file_name": (
        info_names,
        f"""WITH {PARSED}, fo AS (SELECT set_id, folder, arg_min(file_name, ordinal) AS first_track FROM n GROUP BY ALL),
{dated("SELECT split_part(folder, '.', 1) AS stem FROM fo", '_f')}
SELECT fo.*, coalesce(h.b || {day_text('h.dt', 'h.form')}, tn.b || {day_text('tn.dt', 'tn.form')}, folder) || '.txt' AS info_file
FROM fo LEFT JOIN (SELECT * FROM head_f WHERE rest = '') h ON split_part(folder, '.', 1) = h.stem LEFT JOIN tn ON tn.file_name = fo.first_track""",
    ),
    "sanitize_slug": (
        cleaned,
        """SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9._-]', '', 'g') AS sanitized,
  lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS slug FROM documents""",
    ),
    "name_spec": (lambda spark, sf_dir: spec(spark, sf_dir)[0], f"WITH {NAMES}, {SPECS} SELECT * FROM spec"),
    "rename_target": (
        targets,
        f"""WITH {PARSED}, {SPECS}
SELECT n.set_id, ordinal, path AS from_path, 'shows/' || folder || '/' || s.band || CASE WHEN short_year THEN strftime(s.date, '%y-%m-%d') ELSE strftime(s.date, '%Y-%m-%d') END
  || coalesce('d' || s.disc, '') || 't' || CASE WHEN ordinal < 9 THEN '0' ELSE '' END || (ordinal + 1) || coalesce(suffix, '') || '.' || regexp_extract(n.file_name, '\\.([^.]*)$', 1) AS to_path
FROM n JOIN spec s ON n.set_id = s.set_id AND s.error IS NULL LEFT JOIN tn ON n.file_name = tn.file_name""",
    ),
    "rename_collisions": (lambda spark, sf_dir: collisions(spark, sf_dir)[0], f"{STATUS} SELECT set_id, ordinal, from_path, to_path, status FROM c"),
    "rename_conflicts": (conflicts, f"{STATUS} SELECT * FROM bad"),
    "rename_verdict": (
        verdicts,
        f"""{STATUS} SELECT s.*, conflict, CASE WHEN colliding > 0 THEN 'COLLISION' WHEN conflict IS NOT NULL THEN 'TARGET_EXISTS' END AS refused
FROM (SELECT set_id, count(*) FILTER (WHERE status = 'CHANGED') AS changed, count(*) FILTER (WHERE status = 'COLLISION') AS colliding FROM c GROUP BY set_id) s
LEFT JOIN (SELECT set_id, min(to_path) AS conflict FROM bad GROUP BY set_id) USING (set_id)""",
    ),
    "folder_vs_stream_order": (
        orders,
        f"""SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY str_split(path, '/')) - 1 AS folder_ordinal,
  row_number() OVER (PARTITION BY set_id ORDER BY path) - 1 AS stream_ordinal FROM ({S.plain(ORDERED)})""",
    ),
}
