"""Rules a document, a setlist or a selection must keep; one row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.functions.formats import (
    MAX_DECLARED_PIECE,
    dir_name,
    is_noise,
    path_violation,
    piece_count,
)
from tapeledger.session import union_all
from tapeledger.sources.opening import list_tree


def rule(name: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))


def broken_rules(*rules: Column) -> Column:
    """All broken rules of a row in one pass."""
    return F.explode(F.array_compact(F.array(*rules)))


def torrent_violations(torrents: DataFrame, files: DataFrame) -> DataFrame:
    """Why a torrent document is refused; ``ordinal`` is set for rules about one file.

    ``torrents``: ``set_id, name, piece_length, pieces_bytes, length, has_files, meta_version``;
    ``files``: ``set_id, ordinal, path_parts, length``.
    """
    totals = files.groupBy("set_id").agg(F.try_sum("length").alias("_total"), F.count(F.lit(1)).alias("_files"))
    t = torrents.join(totals, "set_id", "left")
    length, pieces, size, name = (F.col(c) for c in ("length", "pieces_bytes", "piece_length", "name"))
    listed = F.col("has_files")
    total = F.when(listed, F.coalesce("_total", F.when(F.col("_files").isNull(), F.lit(0)))).otherwise(length)
    second_version = F.coalesce(F.col("meta_version") >= 2, F.lit(False))
    plausible = size.between(1, MAX_DECLARED_PIECE)
    one_layout = length.isNull() == listed
    found = broken_rules(
        rule("V2_ONLY", second_version & pieces.isNull()),
        rule("NO_NAME", name.isNull()),
        rule("UNSAFE_NAME", path_violation(F.array(name)).isNotNull()),
        rule("NO_PIECE_LENGTH", size.isNull()),
        rule("IMPLAUSIBLE_PIECE_LENGTH", ~plausible),
        rule("NO_PIECES", pieces.isNull() & ~second_version),
        rule("PIECES_NOT_20", F.pmod(pieces, F.lit(20)) != 0),
        rule("LENGTH_AND_FILES", length.isNotNull() & listed),
        rule("NO_LENGTH", length.isNull() & ~listed),
        rule("TOTAL_OVERFLOW", listed & (F.col("_files") > 0) & F.col("_total").isNull()),
        rule(
            "PIECE_COUNT",
            F.when(
                plausible & (F.pmod(pieces, F.lit(20)) == 0) & one_layout,
                F.call_function("div", pieces, F.lit(20)) != piece_count(total, size),
            ),
        ),
    )
    whole = t.select("set_id", F.lit(None).cast("long").alias("ordinal"), found.alias("rule"))
    unsafe = path_violation(F.col("path_parts"))
    per_file = files.select("set_id", "ordinal", unsafe.alias("rule")).filter(F.col("rule").isNotNull())
    return union_all(whole, per_file)


def draft_violations(drafts: DataFrame, files: DataFrame, pieces: DataFrame) -> DataFrame:
    """Why a draft must not be written: nothing our own reader would refuse later.

    ``drafts``: ``set_id, name, piece_length, is_single_file``; ``files``: ``set_id, ordinal,
    path_parts, length``; ``pieces``: ``set_id, piece``.
    """
    totals = files.groupBy("set_id").agg(
        F.sum("length").alias("_total"),
        F.count_if(F.size("path_parts") == 0).alias("_empty_paths"),
        F.count(F.lit(1)).alias("_files"),
    )
    counts = pieces.groupBy("set_id").agg(F.count(F.lit(1)).alias("_pieces"))
    d = drafts.join(totals, "set_id", "left").join(counts, "set_id", "left")
    size, total = F.col("piece_length"), F.coalesce("_total", F.lit(0))
    many = ~F.col("is_single_file")
    return d.select(
        "set_id",
        broken_rules(
            rule("EMPTY_NAME", F.col("name") == ""),
            rule("ZERO_PIECE_LENGTH", size == 0),
            rule("NO_DATA", total == 0),
            rule(
                "PIECE_COUNT",
                F.when((size > 0) & (total > 0), F.coalesce("_pieces", F.lit(0)) != piece_count(total, size)),
            ),
            rule("NO_FILES", many & F.col("_files").isNull()),
            rule("EMPTY_PATH", many & (F.col("_empty_paths") > 0)),
        ).alias("rule"),
    )


def selection_report(listing: DataFrame, include_all: bool = False) -> DataFrame:
    """Left-out entries of ``set_id, path, name, kind, entries`` with the reason.

    A symbolic link refuses its whole set. A folder is empty if it holds neither a folder nor a kept file.
    ``disk_selection`` makes such a listing; an object store shows neither links nor empty folders.
    """
    noise = (F.col("kind") == "file") & is_noise(F.col("name")) & F.lit(not include_all)
    reason = (
        F.when(F.col("kind") == "symlink", "SYMLINK")
        .when((F.col("kind") == "dir") & (F.col("entries") == 0), "EMPTY_DIRECTORY")
        .when(noise, "NOISE")
    )
    return listing.select("set_id", "path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def folder_contents(tree: DataFrame, include_all: bool = False) -> DataFrame:
    """The rows of a listing (``set_id, path, name, kind, reason``) with ``entries`` and ``files_below`` of folders.

    ``entries`` are the folders and kept files directly in a folder, ``files_below`` the kept files at any depth:
    every file counts once in each folder above it, partially added up before the shuffle. Noise is not
    kept unless all is; a folder that could not be listed has null counts.
    """
    kept = (F.col("kind") == "dir") | ((F.col("kind") == "file") & (~is_noise(F.col("name")) | F.lit(include_all)))
    steps = F.split(F.substr("path", F.length("set_id") + 1), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.concat("set_id", F.array_join(F.slice(steps, 1, n), "/")))
    listed = tree.filter(F.col("reason").isNull())
    lifted = listed.filter(kept).select("set_id", "kind", dir_name(F.col("path")).alias("_parent"), F.explode(above).alias("path"))
    counts = lifted.groupBy("set_id", "path").agg(
        F.count_if(F.col("path") == F.col("_parent")).alias("entries"), F.count_if(F.col("kind") == "file").alias("files_below")
    )
    unlisted = tree.filter(F.col("reason").isNotNull()).select("set_id", "path", F.lit(True).alias("_unlisted")).distinct()
    folders = listed.filter(F.col("kind") == "dir").join(counts, ["set_id", "path"], "left").join(unlisted, ["set_id", "path"], "left")
    number = lambda c: F.when(F.col("_unlisted").isNull(), F.coalesce(F.col(c), F.lit(0).cast("long"))).alias(c)
    none = lambda c: F.lit(None).cast("long").alias(c)
    shape = ["set_id", "path", "name", "kind"]
    return union_all(
        folders.select(*shape, number("entries"), number("files_below")),
        listed.filter(F.col("kind") != "dir").select(*shape, none("entries"), none("files_below")),
    )


def disk_selection(spark: SparkSession, roots, include_all: bool = False) -> DataFrame:
    """``selection_report`` of folders as they are on disk, and folders that cannot be listed with the reason."""
    tree = list_tree(spark, roots)
    left_out = selection_report(folder_contents(tree, include_all), include_all)
    return union_all(left_out, tree.filter(F.col("reason").isNotNull()).select("set_id", "path", "reason"))
