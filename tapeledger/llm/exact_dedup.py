"""Exact duplicates by sorting content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeledger.llm.common import SPACE_RUN, packed, partitions, quoted, read, unpacked, written

OURS = ["keep_id", "group_size", "kept", "text_sha256"]
PREFIX = 64  # code points of the content that splitters are made of


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark the rows of ``df`` whose text equals that of a row with a smaller id.

    Texts are compared after replacing each run of white space by one space; null counts as empty.
    Returns all columns and rows of ``df`` plus ``keep_id`` (id of the row that stays),
    ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text). Of rows with equal text
    and equal id exactly one stays; a null id comes after all others, and a group of null ids has a
    null ``keep_id`` and keeps one row. Columns of ``df`` named as ours are replaced. An empty table
    gives an empty table.

    The rows are range-partitioned by content at sampled splitters and sorted, which puts equal
    texts next to each other; a window over the full text then compares neighbours. A splitter is
    the first code points and a digest as tie-break, so the driver's sample is small however long
    the texts are. A text whose copies would overfill a partition is dealt over several by id, in
    proportion to its bytes; the runs of such a text are merged afterwards, one row a run. There
    are at most four such texts per partition, which bounds what is broadcast.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    source, columns = packed(df), df.columns
    text = F.coalesce(F.col("r")[text_col], F.lit(""))
    norm = F.regexp_replace(text, SPACE_RUN, " ")
    heavy = _heavy(source, norm, text, n)
    runs = _runs(source.withColumn("h", F.xxhash64(norm)).join(F.broadcast(heavy), "h", "left"), id_col, norm, n)
    split = _runs(source.withColumn("h", F.xxhash64(norm)).join(F.broadcast(heavy), "h"), id_col, norm, n)
    whole = (
        split.filter("place = 1")
        .groupBy(F.col("text_sha256"))
        .agg(F.min("first_id").alias("all_first"), F.sum("run_size").alias("all_size"))
    )
    best = F.when(F.col("all_size").isNotNull(), F.col("all_first")).otherwise(F.col("first_id"))
    merged = runs.join(F.broadcast(whole), "text_sha256", "left").select(
        "r",
        "text_sha256",
        best.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        # The parts of a text are dealt by id, so rows of one id are in one run.
        ((F.col("place") == 1) & F.col("r")[id_col].eqNullSafe(best)).alias("kept"),
    )
    return unpacked(merged, columns, OURS)


def _heavy(source: DataFrame, norm, text, n: int) -> DataFrame:
    """Digests of texts whose copies hold over a quarter of a partition's fair share of bytes, and the parts each is dealt to."""
    total = source.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    share = max(total // (4 * n), 1)
    sizes = source.groupBy(F.xxhash64(norm).alias("h")).agg(F.sum(F.octet_length(text) + 64).alias("bytes"), F.count(F.lit(1)).alias("copies"))
    heavy = sizes.filter((F.col("bytes") > share) & (F.col("copies") > 1))
    return written(heavy.select("h", F.least(F.col("copies"), F.ceil(F.col("bytes") / share)).alias("parts")), "heavy")


def _runs(source: DataFrame, id_col: str, norm, n: int) -> DataFrame:
    """Rows in content order with their place in, first id of and size of the run of equal texts."""
    row_id = F.col("r")[id_col]
    part = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(row_id), F.col("parts")))
    keyed = source.select("r", "h", part.alias("part"), F.left(norm, F.lit(PREFIX)).alias("prefix"))
    ranged = keyed.repartitionByRange(n, "prefix", "h", "part").withColumn("norm", norm).withColumn("row_id", row_id)
    # Ranges of (prefix, h, part) hold whole groups of this window, so it adds no shuffle.
    run = Window.partitionBy("prefix", "h", "part", "norm").orderBy(F.col("row_id").asc_nulls_last())
    every = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.select(
        "r",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(run).alias("place"),
        F.first("row_id").over(every).alias("first_id"),
        F.count(F.lit(1)).over(every).alias("run_size"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", *OURS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    return exact_dedup(docs).filter("kept").select(*[quoted(c) for c in docs.columns])


QUERIES = {
    "op3_exact_dedup": (
        op3_exact_dedup,
        r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)""",
    )
}
