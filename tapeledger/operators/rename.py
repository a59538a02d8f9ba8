"""Rename plans: what each file of a set should be called, and why a set must not be renamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.functions.binding import let
from tapeledger.functions.formats import base_name, dir_name
from tapeledger.functions.names import (
    MAX_U32,
    parse_show_date,
    parse_show_folder,
    parse_track_name,
    render_track_name,
)
from tapeledger.operators.ordered import attach, longest_set, rows_per_block, spread
from tapeledger.session import union_all

SET = ["set_id"]


def name_spec(fields: DataFrame) -> DataFrame:
    """Checked naming parameters per set, or the first thing wrong with them.

    ``fields``: ``set_id, folder, band, date, disc, short_year`` as typed; a field left null is
    read from the folder's name.
    """
    def typed(show: Column) -> Column:
        return F.struct(
            F.trim(F.coalesce("band", show["band"])).alias("band"),
            F.when(F.col("date").isNull(), show["date"])
            .otherwise(parse_show_date(F.trim("date"))["date"])
            .alias("date"),
            F.trim(F.coalesce("disc", F.lit(""))).alias("disc"),
        )

    def judged(v: Column) -> Column:
        number = F.when(v["disc"].rlike(r"^\+?[0-9]+\z"), v["disc"].try_cast("long"))
        error = (
            F.when(F.coalesce(v["band"], F.lit("")) == "", "NO_BAND")
            .when(v["date"].isNull(), "BAD_DATE")
            .when((v["disc"] != "") & ~F.coalesce(number <= MAX_U32, F.lit(False)), "BAD_DISC")
        )
        return F.struct(v["band"].alias("band"), v["date"].alias("date"), number.alias("disc"), error.alias("error"))

    spec = let(let(parse_show_folder(F.col("folder")), typed), judged)
    short = F.coalesce("short_year", F.lit(False)).alias("short_year")
    return fields.select(*SET, spec.alias("s"), short).select(*SET, "s.band", "s.date", "s.disc", "short_year", "s.error")


def rename_target(files: DataFrame, spec: DataFrame, keep_suffix: bool = True, longest: int | None = None) -> DataFrame:
    """``set_id, ordinal, from_path, to_path``: same folder and extension, number by position."""
    ready = spec.filter(F.col("error").isNull()).drop("error")
    joined = attach(files.select(*SET, "ordinal", "path"), ready, SET, "inner", longest=longest)
    name = base_name(F.col("path"))
    ext = F.regexp_extract(name, r"(?s)\.([^.]*)\z", 1)
    suffix = parse_track_name(name)["suffix"] if keep_suffix else F.lit(None).cast("string")
    target = render_track_name(
        F.col("band"),
        F.col("date"),
        F.when(F.col("short_year"), "SHORT").otherwise("LONG"),
        F.col("disc"),
        F.col("ordinal") + 1,
        suffix,
        ext,
    )
    folder = dir_name(F.col("path"))
    beside = let(target, lambda t: F.when(folder == "", t).otherwise(F.concat(folder, F.lit("/"), t)))
    return joined.select(*SET, "ordinal", F.col("path").alias("from_path"), beside.alias("to_path"))


def rename_collisions(plan: DataFrame, longest: int | None = None) -> DataFrame:
    """UNCHANGED, CHANGED, or COLLISION when a set has several files for one name.

    Short sets are counted where they stand. Names of a long set are counted apart and joined.
    """
    longest = longest_set(plan, SET) if longest is None else longest
    if longest <= rows_per_block(plan):
        uses = F.count(F.lit(1)).over(Window.partitionBy(*SET, "to_path"))
        counted = plan.withColumn("_uses", uses).filter(F.col("set_id").isNotNull() & F.col("to_path").isNotNull())
    else:
        counts = plan.groupBy(*SET, "to_path").agg(F.count(F.lit(1)).alias("_uses"))
        counted = plan.join(counts, [*SET, "to_path"])
    return counted.select(
        *plan.columns,
        F.when(F.col("_uses") > 1, "COLLISION")
        .when(F.col("to_path") == F.col("from_path"), "UNCHANGED")
        .otherwise("CHANGED")
        .alias("status"),
    )


def judged_plan(plan: DataFrame, inventory: DataFrame, rows: int | None = None) -> DataFrame:
    """``plan`` (``set_id, ordinal, from_path, to_path``) with ``status`` and ``conflict``, in one pass over paths.

    Every path is a row for each way it is met: as a target, as a source of its set, as a file on disk.
    One shuffle by path brings these together; nothing is joined. A target is in conflict if it is a
    changed name, is on disk, and no file of its set leaves it. Whether a file stays is told before
    paths move, so rows carry one path unless ``from_path`` is asked for. ``rows``, how many rows all of this is, sets the number of tasks.
    """
    role = lambda path, is_target: F.struct(F.col(path).alias("path"), F.lit(is_target).alias("is_target"))
    stays = (F.col("to_path") == F.col("from_path")).alias("stays")
    met = plan.select(*SET, "ordinal", "from_path", stays, F.explode(F.array(role("to_path", True), role("from_path", False))).alias("m"))
    met = met.select(*SET, "ordinal", "from_path", "stays", "m.path", "m.is_target", F.lit(False).alias("on_disk"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in met.schema.fields}
    disk = inventory.filter(F.col("path").isNotNull()).select(
        *[empty[c] for c in (*SET, "ordinal", "from_path", "stays")], "path", F.lit(False).alias("is_target"), F.lit(True).alias("on_disk")
    )
    by_path, in_set = Window.partitionBy("path"), Window.partitionBy("path", *SET)
    seen = spread(union_all(met, disk), ["path"], rows, 0).withColumns(
        {
            "_disk": F.max("on_disk").over(by_path),
            "_uses": F.count_if("is_target").over(in_set),
            "_left": F.max(~F.col("is_target") & ~F.col("on_disk")).over(in_set),
        }
    )
    status = F.when(F.col("_uses") > 1, "COLLISION").when(F.col("stays"), "UNCHANGED").otherwise("CHANGED")
    conflict = (status == "CHANGED") & F.col("_disk") & ~F.col("_left")
    return seen.filter("is_target").select(*SET, "ordinal", "from_path", F.col("path").alias("to_path"), status.alias("status"), conflict.alias("conflict"))


def rename_conflicts(plan: DataFrame, inventory: DataFrame, rows: int | None = None) -> DataFrame:
    """Changed targets that exist on disk and are not themselves being renamed."""
    return judged_plan(plan, inventory, rows).filter("conflict").select(*SET, "ordinal", "to_path")


def rename_report(plan: DataFrame, inventory: DataFrame, rows: int | None = None) -> DataFrame:
    """``rename_verdict`` from plan and inventory alone."""
    counts = judged_plan(plan, inventory, rows).groupBy(*SET).agg(
        F.count_if(F.col("status") == "CHANGED").alias("changed"),
        F.count_if(F.col("status") == "COLLISION").alias("colliding"),
        F.min(F.when(F.col("conflict"), F.col("to_path"))).alias("conflict"),
    )
    refused = F.when(F.col("colliding") > 0, "COLLISION").when(F.col("conflict").isNotNull(), "TARGET_EXISTS")
    return counts.withColumn("refused", refused)


def rename_verdict(plan: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per set: files that change, and why the whole set is refused."""
    blocked = conflicts.groupBy(*SET).agg(F.min("to_path").alias("conflict"))
    counts = plan.groupBy(*SET).agg(
        F.count_if(F.col("status") == "CHANGED").alias("changed"),
        F.count_if(F.col("status") == "COLLISION").alias("colliding"),
    )
    refused = F.when(F.col("colliding") > 0, "COLLISION").when(F.col("conflict").isNotNull(), "TARGET_EXISTS")
    return counts.join(blocked, SET, "left").withColumn("refused", refused)
