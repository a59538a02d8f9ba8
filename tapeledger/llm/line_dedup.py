"""Repeated lines, found with levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.common import SPACE, lower_ascii, new_table, packed, read, unpacked, written

OURS = ["n_lines", "n_dropped", "kept_text", "kept_sha256"]
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_IN = 3
KEY = ["h1", "h2"]
RUN_SCHEMA = "h1 long, h2 long, n_docs long, keeper long"


class LineRuns:
    """Line hashes seen so far, as sorted runs on levels.

    A run is a table in the shared folder, sorted by the 128-bit hash within hash partitions, with
    each key once: the documents that held it when it was first seen and the largest of their ids.
    ``add`` merges a batch against all runs: keys that none holds become a run of level 0, the
    others a table of repeats. When a level has ``fan_in`` runs, they are merged into one run of the
    next level, so a batch meets few runs and a key is rewritten once a level. Runs are never
    changed in place: a lost executor costs a re-run task only.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths)

    def runs(self) -> DataFrame:
        return self._read([p for level in self.levels for p in level])

    def add(self, batch: DataFrame) -> None:
        """Add a batch of keys, each once, with ``n_docs`` and ``keeper``."""
        path = new_table(self.spark, "lines")
        known = self.runs().select(*KEY, F.lit(1).alias("known"))
        met = batch.join(known.hint("merge"), KEY, "left").withColumn("known", F.coalesce("known", F.lit(0)))
        met.sortWithinPartitions("known", *KEY).write.partitionBy("known").parquet(path)
        kinds = {row[0] for row in self.spark.read.schema(f"{RUN_SCHEMA}, known int").parquet(path).select("known").distinct().collect()}
        if 0 in kinds:
            self.levels[0].append(f"{path}/known=0")
        if 1 in kinds:
            self.repeats.append(f"{path}/known=1")
        self._compact(0)

    def _compact(self, level: int) -> None:
        if len(self.levels[level]) < self.fan_in:
            return
        path = new_table(self.spark, f"lines-level{level + 1}")
        self._read(self.levels[level]).repartition(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(path)
        self._compact(level + 1)

    def totals(self) -> DataFrame:
        """Every key with the documents that hold it and the largest of their ids."""
        every = self.runs().unionAll(self._read(self.repeats))
        return every.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """Drop lines that ``min_docs`` or more documents hold, but in the largest id holding them.

    A line's key is the line stripped of white space, A-Z lower-cased; only keys of ``min_chars`` code
    points or more count. Every row counts as one document, also if its id repeats; a null text is
    one empty line; a null id is smaller than all others, so its lines go. Returns the rows and
    columns of ``df`` plus ``n_lines``, ``n_dropped``, ``kept_text`` and ``kept_sha256``; columns of
    ``df`` with these names are replaced. A document that loses all its lines keeps the empty text.

    Documents arrive in ``batches`` (by hash of the id). Each is reduced to one row a key before it
    meets the runs, so a line in a third of all documents costs one row a task. Dropped lines go
    back to their document as positions; no line's text is shuffled, and each text once.
    """
    spark, source, columns = df.sparkSession, packed(df), df.columns
    row_id, text = F.col("r")[id_col].cast("long"), F.col("r")[text_col]
    runs = LineRuns(spark)
    for b in range(batches):
        mine = source.filter(F.pmod(F.xxhash64(row_id), F.lit(batches)) == b)
        key = F.array_distinct(F.transform(_lines(text), line_key))
        long_keys = F.filter(key, lambda k: F.length(k) >= min_chars)
        keys = mine.select(row_id.alias("id"), F.explode(long_keys).alias("key"))
        runs.add(keys.select("id", *_hash(F.col("key"))).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper")))
    repeated = written(runs.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper"), "repeated-lines")
    owner = [row_id.alias("id"), F.xxhash64(text).alias("t")]
    lines = source.select(*owner, F.posexplode(F.transform(_lines(text), line_key)).alias("at", "key")).filter(F.length("key") >= min_chars)
    drops = (
        lines.select("id", "t", "at", *_hash(F.col("key")))
        .join(repeated, KEY)
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "t")
        .agg(F.sort_array(F.collect_set("at")).alias("drops"))
        .select(F.col("id").alias("drop_id"), F.col("t").alias("drop_t"), "drops")
    )
    found = source.select("r", *owner).join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left")
    no_drops = F.array().cast("array<int>")
    cut = found.select("r", _lines(text).alias("lines"), F.coalesce("drops", no_drops).alias("drops"))
    # Line i stays if it lies between two dropped ones: slices of the lines, no search per line.
    start = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get("drops", i - 1) + 2)
    end = lambda i: F.when(i == F.size("drops"), F.size("lines")).otherwise(F.get("drops", i))
    between = F.transform(F.sequence(F.lit(0), F.size("drops")), lambda i: F.slice("lines", start(i), end(i) - start(i) + 1))
    kept = F.array_join(F.when(F.size("drops") == 0, F.col("lines")).otherwise(F.flatten(between)), "\n")
    out = cut.select("r", F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return unpacked(out.withColumn("kept_sha256", F.sha2("kept_text", 256)), columns, OURS)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


QUERIES = {
    "op1_line_dedup": (
        op1_line_dedup,
        r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT doc_id, line_no, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, o.keeper IS NOT NULL AND o.keeper <> doc_id AS dropped FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    )
}
