"""Stand-in collections built from the given tables.

The tables hold no audio, so each collection is a plain select in a dialect that Spark and
DuckDB share: the registered query and its SQL twin start from the same text and part ways
after it. Names alone join their tables in another order on the Spark side. Table names stand in braces. Row numbers are added by ``number_rows`` on the Spark
side and by ``numbered`` on the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeledger.operators.ordered import number_rows, set_sizes, spread

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run shared-dialect SQL over the tables it names in braces."""
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """The same SQL for an engine that knows the tables by name."""
    return text.format(**{n: n for n in TABLES})


def numbered(text: str, keys: str, order: str, ordinal: str = "ordinal") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS {ordinal} "
        f"FROM ({plain(text)})"
    )


# --- tracks: an order is a set, its lines are files ------------------------------------------

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

CD_TRACKS = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS frames,
       44100 AS sample_rate, 2 AS channels, 16 AS bits_per_sample
FROM {lineitem}"""

# Short files, unknown lengths and files that are not CD audio: sets that must be refused.
MIXED_TRACKS = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CASE WHEN l_partkey % 61 = 3 THEN NULL
            ELSE CAST(round(l_extendedprice * 100) AS BIGINT) % 1300 END AS frames,
       CASE WHEN l_suppkey % 13 = 4 AND l_returnflag = 'N' THEN 48000 ELSE 44100 END AS sample_rate,
       2 AS channels,
       CASE WHEN l_suppkey % 17 = 2 AND l_returnflag = 'R' THEN 24 ELSE 16 END AS bits_per_sample
FROM {lineitem}"""


def tracks(spark: SparkSession, sf_dir: str, text: str = CD_TRACKS, told: str | None = None) -> tuple[DataFrame, int]:
    """Numbered tracks and the length of the longest set."""
    return sized_tracks(spark, sf_dir, text, told)[:2]


def sized_tracks(spark: SparkSession, sf_dir: str, text: str = CD_TRACKS, told: str | None = None) -> tuple[DataFrame, int, int]:
    """Numbered tracks, the length of the longest set and the number of all; ``told`` selects from ``{base}``, the tracks once numbered."""
    longest, lines = set_sizes(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    rows = number_rows(select(spark, sf_dir, text), ["set_id"], LINE_ORDER, longest=longest, rows=lines)
    return spark.sql(told, base=rows) if told else rows.drop(*LINE_ORDER), longest, lines


def tracks_sql(text: str = CD_TRACKS) -> str:
    return numbered(text, "set_id", ", ".join(LINE_ORDER))


# --- names: shows by customer segment and order date -----------------------------------------

NAME_ROWS = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, lower(substr(c_mktsegment, 1, 2)) AS band,
       o_orderkey % 10 AS shape
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey"""

# The two sides of the same join, for the Spark side.
NAME_LINES = "SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM {lineitem}"
NAME_SHOWS = """
SELECT o_orderkey AS set_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, lower(substr(c_mktsegment, 1, 2)) AS band,
       o_orderkey % 10 AS shape
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

# Well-formed names of every kind, and names that only look like one.
NAMED = """
SELECT set_id, ordinal, band, day, l_partkey, l_suppkey, folder, file_name,
       'shows/' || folder || '/' || file_name AS path
FROM (SELECT *,
  CASE shape WHEN 0 THEN 'misc ' || CAST(set_id AS STRING)
             WHEN 1 THEN band || substr(day, 3) || '.aud.flac16'
             WHEN 2 THEN band || day
             WHEN 3 THEN band || day || 'x.shnf'
             ELSE band || day || '.sbd.k' || CAST(set_id AS STRING) || '.sbeok.shnf' END AS folder,
  CASE l_partkey % 13
    WHEN 0 THEN band || day || 't' || nn || '.flac'
    WHEN 1 THEN day || 'd1t' || nn || '.flac'
    WHEN 2 THEN band || substr(day, 3) || 'd1t' || nn || 'song.flac'
    WHEN 3 THEN band || '2-' || day || 'd2t' || nn || '.wav'
    WHEN 4 THEN band || substr(day, 1, 5) || '02-30d1t' || nn || '.flac'
    WHEN 5 THEN band || day || 'd1.flac'
    WHEN 6 THEN 't' || chr(228) || day || 't1' || nn || 'x.FLAC'
    WHEN 7 THEN band || '77-13-01-' || day || 'd1t' || nn || '.shn'
    WHEN 8 THEN band || '.' || day || 't' || nn || '.flac'
    WHEN 9 THEN band || day || 'd99999999999t' || nn || '.flac'
    ELSE band || day || 'd' || CAST(CAST(floor(ordinal / 3) AS BIGINT) + 1 AS STRING) || 't' || nn || '.flac' END AS file_name
 FROM (SELECT *, CASE WHEN ordinal < 9 THEN '0' ELSE '' END || CAST(ordinal + 1 AS STRING) AS nn FROM {base}) b) n"""


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Numbered names and the length of the longest set."""
    return sized_names(spark, sf_dir)[:2]


def sized_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The rows of ``NAME_ROWS``, numbered and named: shows first, so that lines move once, to their set."""
    longest, lines = set_sizes(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    sides = [spread(select(spark, sf_dir, text), ["set_id"], lines, longest) for text in (NAME_LINES, NAME_SHOWS)]
    rows = number_rows(sides[0].join(sides[1], "set_id"), ["set_id"], LINE_ORDER, longest=longest)
    return spark.sql(NAMED, base=rows), longest, lines


def names_sql() -> str:
    return NAMED.replace("{base}", f"({numbered(NAME_ROWS, 'set_id', ', '.join(LINE_ORDER))})")


# --- tags: titles from parts, artists from suppliers -----------------------------------------

TAG_ROWS = """
SELECT l_orderkey AS set_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CASE WHEN l_partkey % 5 = 4 THEN 'WAV' ELSE 'FLAC' END AS format,
       CASE WHEN l_partkey % 7 = 3 THEN NULL WHEN l_partkey % 11 = 3 THEN '' ELSE p_name END AS title,
       CASE WHEN l_suppkey % 4 = 1 THEN NULL ELSE 'artist ' || CAST(l_orderkey % 9 + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS STRING) END AS artist,
       CASE WHEN l_suppkey % 5 = 1 THEN NULL ELSE p_brand END AS album,
       CASE WHEN l_suppkey % 3 = 1 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date,
       CASE WHEN l_suppkey % 4 = 1 THEN NULL WHEN l_partkey % 6 = 0 THEN '1/17' ELSE '0' || CAST(l_linenumber AS STRING) END AS track_number,
       CAST(NULL AS STRING) AS track_total,
       CASE WHEN l_suppkey % 4 = 1 THEN NULL ELSE p_type END AS genre,
       CASE WHEN l_suppkey % 6 = 1 THEN '' WHEN l_suppkey % 6 = 2 THEN 'sbd' ELSE NULL END AS comment,
       CASE WHEN l_suppkey % 4 = 1 THEN NULL WHEN l_suppkey % 8 < 4 THEN 'town' ELSE NULL END AS location,
       CASE WHEN l_partkey % 61 = 3 THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * 5 END AS frames,
       CASE WHEN l_suppkey % 13 = 4 THEN 48000 ELSE 44100 END AS sample_rate
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

EDIT_ROWS = """
SELECT set_id, ordinal,
       CASE WHEN l_partkey % 3 = 0 THEN title WHEN l_partkey % 3 = 1 THEN 'new title' END AS title,
       CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN 'artist 1' END AS artist,
       CAST(NULL AS STRING) AS album,
       CASE WHEN l_partkey % 5 = 0 THEN '1977-05-08' END AS date,
       CASE WHEN l_partkey % 2 = 0 THEN CAST(ordinal + 1 AS STRING) END AS track_number,
       CASE WHEN l_partkey % 2 = 0 THEN '9' END AS track_total,
       CASE WHEN l_partkey % 9 = 0 THEN '' END AS genre,
       CASE WHEN l_partkey % 10 = 0 THEN 'aud' END AS comment,
       CASE WHEN l_partkey % 10 = 1 THEN 'town' END AS location
FROM {base}"""

FOLDERS = """
SELECT o_orderkey AS set_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'gd' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '.sbd.shnf'
            WHEN o_orderkey % 3 = 1 THEN 'gd' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3)
            ELSE 'folder' END AS folder
FROM {orders}"""


def tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Numbered tags and the length of the longest set."""
    return sized_tags(spark, sf_dir)[:2]


def sized_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Numbered tags, the length of the longest set and the number of all rows."""
    longest, lines = set_sizes(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    rows = number_rows(select(spark, sf_dir, TAG_ROWS), ["set_id"], LINE_ORDER, longest=longest, rows=lines)
    return rows, longest, lines


def tags_sql() -> str:
    return numbered(TAG_ROWS, "set_id", ", ".join(LINE_ORDER))


def edits(spark: SparkSession, tag_rows: DataFrame) -> DataFrame:
    return spark.sql(EDIT_ROWS, base=tag_rows)


def edits_sql(base: str) -> str:
    return EDIT_ROWS.replace("{base}", base)
