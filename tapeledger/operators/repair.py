"""Boundary repair: how many frames cross each file boundary so that every file fills sectors.

The plan looks sequential, because moving frames across one boundary changes what the next file
starts with. Each move leaves the running total of frames unchanged modulo the sector size, so
the remainder at a boundary is the running sum of the original lengths modulo the sector size,
and the plan is one scan over each set.

Tracks: ``set_id, ordinal, frames, sample_rate, channels, bits_per_sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.formats import SECTOR_FRAMES, is_cdda, is_readable
from tapeledger.operators.ordered import longest_set, number_rows, scan_sets

SET = ["set_id"]


def plan_shift(
    tracks: DataFrame,
    direction: str = "backward",
    pad_tail: bool = False,
    longest: int | None = None,
) -> DataFrame:
    """One row per file with the shift at its right-hand boundary.

    ``shift`` is positive for frames handed to the next file, negative for frames borrowed from
    it, null on the last file. A refused set keeps its rows with ``refused`` and ``refused_at``
    (the first offending file) and no plan.
    """
    longest = longest_set(tracks, SET) if longest is None else longest
    cdda = F.coalesce(is_cdda(F.col("sample_rate"), F.col("channels"), F.col("bits_per_sample")), F.lit(False))
    unusable = F.when(~cdda, "NOT_CDDA").when(F.col("frames").isNull(), "NO_LENGTH")
    offender = F.when(unusable.isNotNull(), F.struct(F.col("ordinal").alias("at"), unusable.alias("why")))
    scanned = scan_sets(
        tracks,
        SET,
        running={"_upto": (F.sum, F.coalesce("frames", F.lit(0)))},
        nexts={"_next": F.struct(F.col("ordinal").alias("ordinal"), F.col("frames").alias("frames"))},
        totals={"_unusable": (F.min, offender), "_all": (F.sum, F.col("frames"))},
        longest=longest,
    )
    remainder = F.pmod("_upto", F.lit(SECTOR_FRAMES))
    borrow = remainder - SECTOR_FRAMES
    moved = {
        "backward": remainder,
        "forward": F.when(remainder == 0, 0).otherwise(borrow),
        "nearest": F.when((remainder != 0) & (-borrow < remainder), borrow).otherwise(remainder),
    }[direction]
    shifted = scanned.withColumn("shift", F.when(F.col("_next").isNotNull(), moved.cast("long")))
    too_short = F.when(
        (F.col("shift") < 0) & (F.col("_next.frames") + F.col("shift") < 0),
        F.struct(F.col("_next.ordinal").alias("at"), F.lit("TOO_SHORT").alias("why")),
    )
    judged = scan_sets(shifted, SET, totals={"_short": (F.min, too_short)}, longest=longest)

    verdict = F.coalesce("_unusable", "_short")
    planned = verdict.isNull()
    tail = F.pmod("_all", F.lit(SECTOR_FRAMES)).cast("long")
    padding = F.when(tail != 0, F.lit(SECTOR_FRAMES) - tail) if pad_tail else F.lit(None).cast("long")
    fixed = F.lit(True) if pad_tail else tail == 0
    return judged.select(
        *tracks.columns,
        F.when(planned, F.col("shift")).alias("shift"),
        F.col("_next").isNull().alias("is_last"),
        F.when(planned, padding).alias("tail_padding"),
        F.when(planned, fixed).alias("fully_fixed"),
        verdict["why"].alias("refused"),
        verdict["at"].alias("refused_at"),
    )


def fix_rows(plan: DataFrame, longest: int | None = None) -> DataFrame:
    """What the plan does to each file; files of refused sets are left out."""
    kept = plan.filter(F.col("refused").isNull())
    scanned = scan_sets(kept, SET, prevs={"_in": F.col("shift")}, longest=longest)
    padding = F.when(F.col("is_last"), F.coalesce("tail_padding", F.lit(0))).otherwise(0).cast("long")
    shifted_in, shifted_out = (F.coalesce(c, F.lit(0)).cast("long") for c in ("_in", "shift"))
    return scanned.select(
        *plan.columns,
        shifted_in.alias("shifted_in"),
        shifted_out.alias("shifted_out"),
        padding.alias("padding"),
        (F.col("frames") + shifted_in - shifted_out + padding).alias("new_frames"),
        ((shifted_in != 0) | (shifted_out != 0) | (padding != 0)).alias("touched"),
    )


def independent_groups(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """Cut each set at every boundary nothing crosses; one row per group.

    Only touched groups need work. A touched group of one file is a padded tail.
    """
    starts = ((F.col("ordinal") > 0) & (F.col("shifted_in") == 0)).cast("long")
    grouped = scan_sets(rows, SET, running={"group_no": (F.sum, starts)}, longest=longest)
    return grouped.groupBy(*SET, "group_no").agg(
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.count(F.lit(1)).alias("files"),
        F.bool_or("touched").alias("touched"),
    )


def repair_ranges(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """Which frames of which source fill each output, in order.

    Old and new file starts are cut points of one stream. Between two neighbouring cut points
    lies one piece of one source inside one output, so sorting the cut points replaces the
    overlap join. Tail padding is not in the sources and not in the ranges.
    """
    longest = longest_set(rows, SET) if longest is None else longest
    spans = scan_sets(
        rows.withColumn("_new", F.col("new_frames") - F.col("padding")),
        SET,
        running={"_old_end": (F.sum, F.col("frames")), "_new_end": (F.sum, F.col("_new"))},
        longest=longest,
    )

    def cut(kind: str, at: Column, old: Column, new: Column) -> Column:
        return F.struct(
            at.alias("at"),
            F.lit(kind).alias("kind"),
            old.cast("long").alias("old"),
            new.cast("long").alias("new"),
        )

    none = F.lit(None)
    cuts = spans.select(
        *SET,
        F.col("ordinal").alias("row"),
        F.explode(
            F.array_compact(
                F.array(
                    cut("a_old", F.col("_old_end") - F.col("frames"), F.col("ordinal"), none),
                    cut("b_new", F.col("_new_end") - F.col("_new"), none, F.col("ordinal")),
                    F.when(F.col("is_last"), cut("c_end", F.col("_old_end"), none, none)),
                )
            )
        ).alias("c"),
    ).select(*SET, "row", "c.*")
    points = number_rows(cuts, SET, ["at", "kind", "row"], ordinal="cut_no", longest=2 * longest + 1)
    scanned = scan_sets(
        points,
        SET,
        running={
            "source": (F.max, F.col("old")),
            "output": (F.max, F.col("new")),
            "_source_start": (F.max, F.when(F.col("old").isNotNull(), F.col("at"))),
        },
        nexts={"_until": F.col("at")},
        ordinal="cut_no",
        longest=2 * longest + 1,
    )
    return scanned.filter(F.col("_until") > F.col("at")).select(
        *SET,
        "output",
        "source",
        (F.col("at") - F.col("_source_start")).alias("from_frame"),
        (F.col("_until") - F.col("_source_start")).alias("to_frame"),
    )


def fix_summary(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Per set: feasible, fully fixed, tail padding, boundaries moved and files touched."""
    touched = rows.groupBy(*SET).agg(F.count_if("touched").alias("files_touched"))
    return (
        plan.groupBy(*SET)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.min("refused").alias("refused"),
            F.min("refused_at").alias("refused_at"),
            F.bool_and("fully_fixed").alias("fully_fixed"),
            F.max("tail_padding").alias("tail_padding"),
            F.count_if(F.col("shift") != 0).alias("boundaries_moved"),
        )
        .join(touched, SET, "left")
        .select(
            *SET,
            "files",
            F.col("refused").isNull().alias("feasible"),
            "refused",
            "refused_at",
            "fully_fixed",
            "tail_padding",
            "boundaries_moved",
            "files_touched",
        )
    )


def set_format(inventory: DataFrame) -> DataFrame:
    """The one format a set can be repaired as, or the first file that stands in the way."""
    per_format = inventory.groupBy(*SET, "format").agg(
        F.min(F.struct("ordinal", "file_name")).alias("first")
    )
    entry = F.struct(
        F.col("first.ordinal").alias("ordinal"),
        F.col("first.file_name").alias("file_name"),
        F.col("format").alias("format"),
    )
    # One entry per format, so the lists hold at most as many entries as there are formats.
    ranked = per_format.groupBy(*SET).agg(F.array_sort(F.collect_list(entry)).alias("seen"))
    first, other = F.get("seen", F.lit(0)), F.get("seen", F.lit(1))
    readable = F.coalesce(is_readable(first["format"]), F.lit(False))
    refused = F.when(~readable, "UNSUPPORTED").when(other.isNotNull(), "MIXED")
    return ranked.select(
        *SET,
        F.when(refused.isNull(), first["format"]).alias("format"),
        refused.alias("refused"),
        F.when(refused == "UNSUPPORTED", first["file_name"])
        .when(refused == "MIXED", other["file_name"])
        .alias("offender"),
    )
