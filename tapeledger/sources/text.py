"""Text files as numbered lines, and the lists written in them.

Files are read line by line, so one long file is split over many tasks. Lines are numbered by
where they stand: file, offset of the split in it, place in the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeledger.functions.names import slug, strip_space
from tapeledger.operators.manifests import parse_manifests
from tapeledger.operators.ordered import first_occurrence
from tapeledger.session import stored, union_all


# In any mixture of cases.
LIST_GLOB = "*.{[fF][fF][pP],[mM][dD]5,[sS][tT]5}"


def plain_path(address: Column) -> Column:
    """The path other readers report: file addresses come percent-encoded from the text reader."""
    return F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))


def read_lines(
    spark: SparkSession, paths, line_sep: str | None = "\n", glob: str | None = None, recursive: bool = False
) -> DataFrame:
    """``list_path, line_no, line``; line numbers start at 1 and count every line.

    The text is read once, when this is called, and kept in the checkpoint folder.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("list_path"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    return number_lines(stored(rows, "lines"))


def number_lines(rows: DataFrame) -> DataFrame:
    """Lines of ``list_path, _from`` (start of the split of the file), ``_at`` and ``line`` with their numbers.

    A task reads a split from its first line to its last, so ``_at`` grows by one from line to line of a
    split. A line's number is its place in its split and the lines of earlier splits of the file, which are
    known from one row a split; lines are neither sorted nor shuffled, unless there are more
    splits than Spark broadcasts.
    """
    splits = rows.groupBy("list_path", "_from").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("list_path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(splits.select("list_path", "_from", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")), "splits")
    return rows.join(begins, ["list_path", "_from"]).select("list_path", (F.col("_at") + F.col("_shift") + 1).alias("line_no"), "line")


def read_manifests(spark: SparkSession, paths, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every list of the three kinds in a folder (or the given files); other files are not opened."""
    return parse_manifests(read_lines(spark, paths, glob=LIST_GLOB, recursive=recursive))


def parse_tracker_lists(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``Name|URL[|private][|source=T][|id=S]`` lines as entries and refused lines."""
    line = strip_space(F.col("line"))
    rows = lines.withColumn("_l", line).filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    cells = rows.withColumn("_c", F.transform(F.split("_l", r"\|"), strip_space)).withColumn(
        "_extra", F.slice("_c", 3, F.greatest(F.size("_c") - 2, F.lit(0)))
    )

    def last(prefix: str):
        hits = F.filter("_extra", lambda f: f.startswith(prefix))
        return strip_space(F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 1 << 30))

    unknown = F.filter(
        "_extra",
        lambda f: (f != "") & (f != "private") & ~f.startswith("id=") & ~f.startswith("source="),
    )
    name, announce = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    entries = cells.select(
        "list_path",
        "line_no",
        F.coalesce(last("id="), slug(name)).alias("id"),
        name.alias("name"),
        announce.alias("announce"),
        F.array_contains("_extra", "private").alias("private"),
        last("source=").alias("source"),
        F.when(announce.isNull(), "NO_BAR")
        .when(name == "", "NO_NAME")
        .when(announce == "", "NO_URL")
        .when(F.size(unknown) > 0, "UNKNOWN_FIELD")
        .when(F.coalesce(last("id="), slug(name)) == "", "NO_ID")
        .alias("detail"),
    )
    sound = entries.filter(F.col("detail").isNull()).drop("detail")
    ranked = first_occurrence(sound, ["list_path", "id"], F.col("line_no"))
    kept = ranked.filter("is_first").drop("is_first")
    again = ranked.filter("NOT is_first").select("list_path", "line_no", F.lit("DUPLICATE_ID").alias("detail"))
    unsound = entries.filter(F.col("detail").isNotNull()).select("list_path", "line_no", "detail")
    refused = union_all(unsound, again)
    return kept, refused


def read_tracker_lists(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    return parse_tracker_lists(read_lines(spark, paths))


def parse_passkeys(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id|key`` lines; a later line for the same id replaces an earlier one."""
    line = strip_space(F.col("line"))
    rows = lines.withColumn("_l", line).filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    shape = r"(?s)^([^|]*)\|(.*)$"
    keyed = rows.select(
        "list_path",
        "line_no",
        F.when(F.contains("_l", F.lit("|")), strip_space(F.regexp_extract("_l", shape, 1))).alias("id"),
        strip_space(F.regexp_extract("_l", shape, 2)).alias("passkey"),
    )
    kept = keyed.filter(F.col("id").isNotNull()).groupBy("list_path", "id").agg(
        F.max_by("passkey", "line_no").alias("passkey")
    )
    refused = keyed.filter(F.col("id").isNull()).select("list_path", "line_no", F.lit("NO_BAR").alias("detail"))
    return kept, refused


def read_passkeys(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    return parse_passkeys(read_lines(spark, paths))


def read_titles(spark: SparkSession, paths) -> DataFrame:
    r"""One title per line; ``\n``, ``\r\n`` and a bare ``\r`` all end a line."""
    lines = read_lines(spark, paths, line_sep=None)
    return lines.select("list_path", F.col("line_no").alias("title_no"), F.col("line").alias("title"))


def split_titles(text):
    """The same rule for text held in a column: an array of titles."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(unified == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(unified, r"\n\z", ""), "\n")
    )
