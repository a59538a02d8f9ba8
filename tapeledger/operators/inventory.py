"""Inventories as tables: quarantine, unions, summaries and collection totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.formats import classify_format, is_readable, required_tool
from tapeledger.session import union_all


def split_readable(files: DataFrame, bare: bool = False) -> tuple[DataFrame, DataFrame]:
    """Inventory and quarantine. Files of no audio format are ignored inside a folder, and
    quarantined when they were named themselves (``bare``)."""
    named = files.withColumn("format", classify_format(F.col("path")))
    known = F.col("format").isNotNull()
    reason = F.when(~known, "UNKNOWN_FORMAT").when(
        ~is_readable(F.col("format")), F.concat(F.lit("NEEDS "), required_tool(F.col("format")))
    )
    judged = named.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    bad = judged.filter(F.col("reason").isNotNull())
    return good, bad if bare else bad.filter(known)


def union_sets(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, duplicates kept."""
    return union_all(*frames)


def format_summary(inventory: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """Files per format in first-seen order, and the sentence that says so."""
    per_format = inventory.groupBy("set_id", "format").agg(
        F.count(F.lit(1)).alias("files"), F.min("ordinal").alias("first_ordinal")
    )
    seen = F.array_sort(F.collect_list(F.struct("first_ordinal", "files", "format")))
    # One entry per format: the list is as short as the list of formats.
    listed = per_format.groupBy("set_id").agg(F.sum("files").alias("files"), seen.alias("_seen"))
    parts = F.array_join(F.transform("_seen", lambda s: F.concat(s["files"].cast("string"), F.lit(" "), s["format"])), ", ")
    line = F.concat(F.col("files").cast("string"), F.lit(" files: "), parts)
    if quarantine is None:
        return listed.select("set_id", "files", F.lit(0).cast("long").alias("skipped"), line.alias("summary"))
    skipped = quarantine.groupBy("set_id").agg(F.count(F.lit(1)).alias("_skipped"))
    n = F.coalesce("_skipped", F.lit(0))
    text = F.when(F.coalesce("files", F.lit(0)) == 0, "no audio files").when(
        n > 0, F.concat(line, F.lit(" ("), n.cast("string"), F.lit(" skipped)"))
    ).otherwise(line)
    return listed.join(skipped, "set_id", "full").select(
        "set_id", F.coalesce("files", F.lit(0)).alias("files"), n.alias("skipped"), text.alias("summary")
    )


def collection_rollup(results: DataFrame, dims: Sequence[str], bad: Sequence[str]) -> DataFrame:
    """Audit totals with subtotals: files, bytes and failures by each prefix of ``dims``."""
    return results.rollup(*dims).agg(
        F.grouping_id().cast("long").alias("level"),
        F.count(F.lit(1)).alias("files"),
        F.sum("file_size").alias("bytes"),
        F.count_if(F.col("status").isin(list(bad))).alias("failures"),
    )
