"""Tags, titles and setlists over the stand-in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions import tags as T
from tapeledger.functions.display import duration_short
from tapeledger.functions.formats import is_cdda
from tapeledger.operators import setlist as L
from tapeledger.operators import tags as G
from tapeledger.operators.ordered import attach, longest_set, number_rows, spread
from tapeledger.plans import standins as S
from tapeledger.session import stored
from tapeledger.sources.text import split_titles

FIELDS = list(T.TAG_FIELDS)


def positions(spark, sf_dir):
    rows, longest = S.tags(spark, sf_dir)
    placed = G.track_position(rows.select("set_id", "ordinal", "format"), longest)
    return placed.select("set_id", "ordinal", "track_number", "track_total")


def applied(spark, sf_dir):
    rows, _ = S.tags(spark, sf_dir)
    after = G.apply_edits(rows, S.edits(spark, rows))
    return after.withColumn("number", T.track_number(F.col("track_number")))


def changes(spark, sf_dir):
    rows, _ = S.tags(spark, sf_dir)
    return G.tag_changes(rows, S.edits(spark, rows))


def comments(spark, sf_dir):
    """Raw comments with a repeated key and a foreign one, and what an edit leaves of them."""
    rows, _ = S.tags(spark, sf_dir)
    raw = F.map_filter(
        F.create_map(
            F.lit("TITLE"), F.array("title", F.lit("second")),
            F.lit("ARTIST"), F.array("artist"),
            F.lit("REPLAYGAIN"), F.array(F.lit("-1 dB")),
        ),
        lambda _k, v: F.get(v, F.lit(0)).isNotNull(),
    )
    edit = F.when(
        F.expr("l_partkey % 2 = 0"), F.create_map(F.lit("TITLE"), F.lit(""), F.lit("GENRE"), F.lit("rock"))
    ).otherwise(F.create_map(F.lit("ARTIST"), F.lit("x")))
    merged = rows.withColumn("m", T.additive_merge(raw, edit)).withColumn("p", T.project_comments(F.col("m")))

    def shown(key):
        return F.array_join(F.try_element_at("m", F.lit(key)), "|")

    return merged.select(
        "set_id", "ordinal", shown("TITLE").alias("title"), shown("ARTIST").alias("artist"), shown("GENRE").alias("genre"),
        shown("REPLAYGAIN").alias("kept"), F.size("m").cast("long").alias("keys"), F.col("p.title").alias("first_title"),
    )


def values(spark, sf_dir):
    rows, _ = S.tags(spark, sf_dir)
    return G.show_values(rows).select("set_id", "field", "value", "distinct_values", "disagrees")


def disagreements(spark, sf_dir):
    rows, longest = S.tags(spark, sf_dir)
    return G.show_disagreements(rows, longest).select("set_id", "field", "value", "first_seen", "value_no")


def seeded(spark, sf_dir):
    rows, _ = S.tags(spark, sf_dir)
    return G.seed_show(rows, S.select(spark, sf_dir, S.FOLDERS))


def track_edits(spark, sf_dir):
    """The edit each file gets from its set's show fields, its own title, place and count."""
    rows, longest = S.tags(spark, sf_dir)
    show = G.seed_show(rows, S.select(spark, sf_dir, S.FOLDERS))
    renamed = show.select("set_id", *[F.col(f).alias(f"show_{f}") for f in FIELDS])
    placed = G.track_position(rows.select("set_id", "ordinal", "format", "title"), longest)
    joined = attach(placed, renamed, ["set_id"], "inner", longest=longest)
    fields = {f: F.col(f"show_{f}") for f in FIELDS}
    edit = T.edit_for_track(fields, F.col("title"), F.col("track_number"), F.col("track_total"))
    return joined.select("set_id", "ordinal", edit.alias("e")).select("set_id", "ordinal", "e.*")


TURNS = "SELECT conv_id AS set_id, turn, role, text FROM {conversations}"


def titles(spark, sf_dir):
    """Every line of every turn as a title, against every turn as a track."""
    rows = S.select(spark, sf_dir, TURNS)
    longest = longest_set(rows.select("set_id"), ["set_id"])
    split = rows.select("set_id", "turn", F.posexplode(split_titles(F.col("text"))).alias("pos", "title"))
    lines = number_rows(split, ["set_id"], ["turn", "pos"], "title_no")
    tracks = number_rows(rows, ["set_id"], ["turn"], "track_number", longest=longest)
    one = F.col("track_number") + 1
    return G.align_titles(
        tracks.select("set_id", one.alias("track_number")),
        lines.select("set_id", (F.col("title_no") + 1).alias("title_no"), "title"),
    )


def runs(spark, sf_dir):
    """Tracks with a disc number that comes and goes, in runs."""
    rows, longest = S.tags(spark, sf_dir)
    return in_runs(rows, longest), rows, longest


def in_runs(rows, longest):
    flac = number_rows(rows.filter("format = 'FLAC'").drop("track_number"), ["set_id"], ["ordinal"], "place", longest=longest)
    named = flac.select(
        "set_id", F.col("place").alias("ordinal"), (F.col("place") + 1).alias("track_number"), "title", "frames", "sample_rate",
        F.expr(FILE_NAME).alias("file_name"), is_cdda(F.col("sample_rate"), F.lit(2), F.lit(16)).alias("is_cdda"),
    )
    return L.disc_runs(L.label_tracks(named), longest)


FILE_NAME = """CASE WHEN l_partkey % 3 = 0 THEN 'gd1977-05-08d1t' || CAST(10 + l_partkey % 5 AS STRING) || '.flac'
  WHEN l_partkey % 3 = 1 THEN 'gd1977-05-08d2t0' || CAST(l_partkey % 5 AS STRING) || '.flac' ELSE 'side' || CAST(l_partkey AS STRING) || '.flac' END"""


def run_rows(spark, sf_dir):
    return runs(spark, sf_dir)[0].select("set_id", "ordinal", "file_name", "disc", "label", "run_no")


def run_totals(spark, sf_dir):
    totals = L.disc_totals(runs(spark, sf_dir)[0])
    return totals.select("set_id", "run_no", "disc", "first_ordinal", "tracks", duration_short(F.col("secs")).alias("length"), "all_cdda", "too_long")


def set_totals(spark, sf_dir):
    return L.set_total(runs(spark, sf_dir)[0]).select("set_id", duration_short(F.col("secs")).alias("length"))


TEXTS = """
SELECT 'set' || CAST(l_orderkey AS STRING) AS dir, CASE WHEN l_partkey % 9 = 0 THEN 'gd1977-05-08.txt' ELSE 'note' || CAST(l_partkey AS STRING)
  || CASE WHEN l_partkey % 9 = 1 THEN '.TXT' WHEN l_partkey % 9 = 2 THEN '.txt' ELSE '.md' END END AS file_name
FROM {lineitem}"""


def text_files(spark, sf_dir, lines=None):
    planned = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("set_id"), F.expr("'set' || CAST(o_orderkey AS STRING)").alias("dir"),
        F.lit("gd1977-05-08.txt").alias("info_file"),
    )
    return L.other_text_files(planned, S.select(spark, sf_dir, TEXTS), lines)


def problems(spark, sf_dir):
    """The numbered tags are read by every rule, so they are kept; rules about single files need no runs."""
    rows, longest, lines = S.sized_tags(spark, sf_dir)
    rows = spread(stored(rows, "tags"), ["set_id"], lines, longest)
    inventory = rows.withColumn("file_name", F.expr(FILE_NAME))
    flac = inventory.filter("format = 'FLAC'")
    return L.setlist_problems(inventory, flac, flac, in_runs(rows, longest), text_files(spark, sf_dir, lines))


def rendered(spark, sf_dir):
    numbered, rows, longest = runs(spark, sf_dir)
    return L.render_setlists(numbered, G.show_record(rows.filter("format = 'FLAC'")), longest)


# --- SQL twins -------------------------------------------------------------------------------

TAGS = f"t AS ({S.tags_sql()})"
EDITED = f"{TAGS}, e AS ({S.edits_sql('t')})"
SEEN = f"""
WITH {TAGS}, l AS (UNPIVOT (SELECT set_id, ordinal, artist AS "ARTIST", date AS "DATE", album AS "ALBUM", location AS "LOCATION", comment AS "COMMENT" FROM t)
  ON "ARTIST", "DATE", "ALBUM", "LOCATION", "COMMENT" INTO NAME field VALUE value),
s AS (SELECT set_id, field, value, min(ordinal) AS first_seen FROM l WHERE value <> '' GROUP BY ALL)"""

SHOW = f"""
WITH {TAGS}, fo AS ({S.plain(S.FOLDERS)}),
tagged AS (SELECT * FROM t WHERE coalesce({', '.join(FIELDS)}) IS NOT NULL),
firsts AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY ordinal) = 1),
shown AS (SELECT fo.set_id, {', '.join('f.' + f if f != 'date' else "coalesce(f.date, CASE WHEN regexp_matches(folder, '^gd([0-9][0-9])?[0-9][0-9]-') THEN (CASE WHEN length(split_part(folder, '.', 1)) = 12 THEN '' WHEN substr(folder, 3, 2) <= '30' THEN '20' ELSE '19' END) || substr(split_part(folder, '.', 1), 3) END) AS date" for f in FIELDS)}
  FROM (SELECT DISTINCT set_id FROM t) k JOIN fo USING (set_id) LEFT JOIN firsts f USING (set_id))"""

RUNS = f"""
{TAGS}, fl AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY ordinal) - 1 AS place, {FILE_NAME} AS file_name FROM t WHERE format = 'FLAC'),
d AS (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS disc, CASE l_partkey % 3 WHEN 0 THEN 'd1t' || (10 + l_partkey % 5) WHEN 1 THEN 'd2t0' || (l_partkey % 5)
   ELSE 't' || CASE WHEN place < 9 THEN '0' ELSE '' END || (place + 1) END AS label, sample_rate = 44100 AS cd FROM fl),
c AS (SELECT *, CASE WHEN place > 0 AND disc IS DISTINCT FROM lag(disc) OVER (PARTITION BY set_id ORDER BY place) THEN 1 ELSE 0 END AS flip FROM d),
runs AS (SELECT *, CAST(sum(flip) OVER (PARTITION BY set_id ORDER BY place) AS BIGINT) AS run_no FROM c),
tot AS (SELECT set_id, run_no, min(disc) AS disc, min(place) AS first_ordinal, count(*) AS tracks, coalesce(CAST(sum(frames // sample_rate * 705600000 + frames % sample_rate * 705600000 // sample_rate) AS BIGINT), 0) / 705600000.0::DOUBLE AS secs,
   bool_and(cd) AS all_cdda FROM runs GROUP BY ALL)"""


def clock(secs):
    return f"(CAST(round({secs}) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(round({secs}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


APPLY = ", ".join(f"CASE WHEN e.{f} IS NULL THEN t.{f} WHEN e.{f} <> '' THEN e.{f} END AS {f}" for f in FIELDS)
CHANGED = "\nUNION ALL ".join(
    f"SELECT t.set_id, t.ordinal, {i} AS field_no, '{k}' AS field, t.{f} AS before, e.{f} AS after FROM t JOIN e ON t.set_id = e.set_id AND t.ordinal = e.ordinal "
    f"WHERE e.{f} IS NOT NULL AND t.{f} IS DISTINCT FROM e.{f}"
    for i, (f, k) in enumerate(T.TAG_FIELDS.items())
)

QUERIES = {
    "track_position": (
        positions,
        f"""WITH {TAGS} SELECT set_id, ordinal, row_number() OVER (PARTITION BY set_id ORDER BY ordinal) AS track_number,
  count(*) OVER (PARTITION BY set_id) AS track_total FROM t WHERE format = 'FLAC'""",
    ),
    "tags_applied": (
        applied,
        f"""WITH {EDITED}, a AS (SELECT t.set_id, t.ordinal, {APPLY} FROM t JOIN e ON t.set_id = e.set_id AND t.ordinal = e.ordinal)
SELECT *, CASE WHEN regexp_full_match(track_number, '[0-9]+') THEN CAST(track_number AS BIGINT) END AS number FROM a""",
    ),
    "tag_changes": (changes, f"WITH {EDITED} {CHANGED}"),
    "additive_merge": (
        comments,
        f"""WITH {TAGS} SELECT set_id, ordinal, CASE WHEN l_partkey % 2 = 1 THEN title || '|second' END AS title,
  CASE WHEN l_partkey % 2 = 1 THEN 'x' ELSE artist END AS artist, CASE WHEN l_partkey % 2 = 0 THEN 'rock' END AS genre, '-1 dB' AS kept,
  1 + CASE WHEN l_partkey % 2 = 1 AND title IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN l_partkey % 2 = 1 OR artist IS NOT NULL THEN 1 ELSE 0 END
    + CASE WHEN l_partkey % 2 = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS keys, CASE WHEN l_partkey % 2 = 1 THEN title END AS first_title FROM t""",
    ),
    "show_values": (
        values,
        f"""{SEEN} SELECT set_id, field, arg_min(value, first_seen) AS value, count(*) AS distinct_values, count(*) > 1 AS disagrees FROM s GROUP BY set_id, field""",
    ),
    "show_disagreements": (
        disagreements,
        f"""{SEEN} SELECT set_id, field, value, first_seen, row_number() OVER (PARTITION BY set_id, field ORDER BY first_seen) - 1 AS value_no
FROM s QUALIFY count(*) OVER (PARTITION BY set_id, field) > 1""",
    ),
    "seed_show": (seeded, f"{SHOW} SELECT * FROM shown"),
    "edit_for_track": (
        track_edits,
        f"""{SHOW}, p AS (SELECT set_id, ordinal, title, row_number() OVER (PARTITION BY set_id ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY set_id) AS total
  FROM t WHERE format = 'FLAC')
SELECT p.set_id, p.ordinal, p.title, artist, album, date, CAST(n AS VARCHAR) AS track_number, CAST(total AS VARCHAR) AS track_total, genre, comment, location
FROM p JOIN shown USING (set_id)""",
    ),
    "align_titles": (
        titles,
        f"""WITH x AS (SELECT set_id, turn, unnest(str_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS title,
    generate_subscripts(str_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)), 1) AS pos
  FROM (SELECT set_id, turn, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM ({S.plain(TURNS)})) WHERE text <> ''),
l AS (SELECT * FROM (SELECT set_id, title, row_number() OVER (PARTITION BY set_id ORDER BY turn, pos) AS n FROM x)),
k AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY turn) AS n FROM ({S.plain(TURNS)})),
r AS (SELECT set_id, coalesce(lines, 0) > tracks AS bad FROM (SELECT set_id, count(*) AS tracks FROM k GROUP BY 1) LEFT JOIN (SELECT set_id, count(*) AS lines FROM l GROUP BY 1) USING (set_id))
SELECT k.set_id, k.n AS track_number, CASE WHEN NOT bad THEN nullif(title, '') END AS title, CASE WHEN bad THEN 'TITLE_COUNT' END AS refused
FROM k JOIN r USING (set_id) LEFT JOIN l ON k.set_id = l.set_id AND k.n = l.n""",
    ),
    "disc_runs": (run_rows, f"WITH {RUNS} SELECT set_id, place AS ordinal, file_name, CAST(disc AS BIGINT) AS disc, label, run_no FROM runs"),
    "disc_totals": (
        run_totals,
        f"""WITH {RUNS} SELECT set_id, run_no, CAST(disc AS BIGINT) AS disc, first_ordinal, tracks, {clock('secs')} AS length, all_cdda, all_cdda AND secs > 4800 AS too_long FROM tot""",
    ),
    "set_total": (
        set_totals,
        f"WITH {RUNS} SELECT set_id, {clock('secs')} AS length FROM (SELECT set_id, coalesce(CAST(sum(frames // sample_rate * 705600000 + frames % sample_rate * 705600000 // sample_rate) AS BIGINT), 0) / 705600000.0::DOUBLE AS secs FROM runs GROUP BY set_id)",
    ),
    "other_text_files": (
        text_files,
        f"""SELECT CAST(substr(dir, 4) AS BIGINT) AS set_id, file_name FROM ({S.plain(TEXTS)}) WHERE lower(file_name) LIKE '%.txt' AND file_name <> 'gd1977-05-08.txt'""",
    ),
    "setlist_problems": (
        problems,
        f"""{SEEN.replace('FROM t)', "FROM t WHERE format = 'FLAC')")}, {RUNS.replace(TAGS + ', ', '')}
SELECT set_id, 'NOT_FLAC' AS problem, {FILE_NAME} AS subject FROM t WHERE format <> 'FLAC'
UNION ALL SELECT set_id, 'MISSING_TITLE', file_name FROM fl WHERE coalesce(title, '') = ''
UNION ALL SELECT set_id, 'NO_LENGTH', file_name FROM fl WHERE frames IS NULL
UNION ALL SELECT set_id, 'DISAGREES', field FROM s GROUP BY set_id, field HAVING count(*) > 1
UNION ALL SELECT set_id, 'TOO_LONG', coalesce('disc ' || disc, 'the set') FROM tot WHERE all_cdda AND secs > 4800
UNION ALL SELECT CAST(substr(dir, 4) AS BIGINT), 'OTHER_TEXT', file_name FROM ({S.plain(TEXTS)}) WHERE lower(file_name) LIKE '%.txt' AND file_name <> 'gd1977-05-08.txt'""",
    ),
    "render_setlists": (
        rendered,
        f"""WITH {RUNS},
w AS (SELECT set_id, max(length(coalesce(nullif(title, ''), '(no title)'))) AS width, bool_or(disc IS NOT NULL) AS discs,
   {', '.join(f"arg_min({f}, place) FILTER (WHERE {f} <> '') AS {f}" for f in T.SHOW_FIELDS)}, coalesce(CAST(sum(frames // sample_rate * 705600000 + frames % sample_rate * 705600000 // sample_rate) AS BIGINT), 0) / 705600000.0::DOUBLE AS secs FROM runs GROUP BY set_id),
named AS (SELECT r.*, width, coalesce(nullif(title, ''), '(no title)') AS shown_title, coalesce({clock('CAST(frames AS DOUBLE) / sample_rate')}, '?:??') AS tm FROM runs r JOIN w USING (set_id)),
lines AS (
  SELECT set_id, 0 AS a, 0 AS b, 0 AS c, artist AS line FROM w WHERE artist IS NOT NULL UNION ALL SELECT set_id, 0, 0, 1, date FROM w WHERE date IS NOT NULL
  UNION ALL SELECT set_id, 0, 0, 2, album FROM w WHERE album IS NOT NULL UNION ALL SELECT set_id, 0, 0, 3, location FROM w WHERE location IS NOT NULL
  UNION ALL SELECT set_id, 0, 0, 4, '' FROM w UNION ALL SELECT set_id, 0, 0, 5, 'Source: ' || coalesce(comment, '') FROM w UNION ALL SELECT set_id, 0, 0, 6, '' FROM w
  UNION ALL SELECT set_id, 1, run_no, -1, coalesce('Disc ' || disc, 'Other') || ' [' || {clock('tot.secs')} || ']' FROM tot JOIN w USING (set_id) WHERE discs
  UNION ALL SELECT set_id, 1, run_no, place, label || '  ' || rpad(shown_title, CAST(width AS INT), ' ') || '  ' || CASE WHEN length(tm) < 5 THEN lpad(tm, 5, ' ') ELSE tm END FROM named
  UNION ALL SELECT set_id, 1, run_no, 1000000000000, '' FROM tot UNION ALL SELECT set_id, 2, 0, 0, 'Total: ' || {clock('secs')} FROM w),
placed AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY a, b, c) - 1 AS n FROM lines)
SELECT set_id, n // 10000 AS part, string_agg(line || chr(13) || chr(10), '' ORDER BY n) AS text FROM placed GROUP BY ALL""",
    ),
}
