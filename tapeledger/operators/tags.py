"""Tags of whole sets: positions, edits, differences and show-level values.

Tag rows: ``set_id, ordinal`` and the nine fields as nullable strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.formats import is_taggable
from tapeledger.functions.names import parse_show_folder, render_show_date
from tapeledger.functions.tags import SHOW_FIELDS, TAG_FIELDS, no_tags, tags_applied
from tapeledger.operators.ordered import longest_set, number_rows, scan_sets

SET = ["set_id"]
FILE = ["set_id", "ordinal"]


def track_position(inventory: DataFrame, longest: int | None = None) -> DataFrame:
    """1-based position among a set's taggable files, and how many there are."""
    taggable = inventory.filter(is_taggable(F.col("format")))
    placed = number_rows(taggable, SET, ["ordinal"], "_place", longest=longest)
    counted = scan_sets(
        placed, SET, totals={"track_total": (F.sum, F.lit(1).cast("long"))}, ordinal="_place", longest=longest
    )
    return counted.withColumn("track_number", F.col("_place") + 1).drop("_place")


def apply_edits(before: DataFrame, edit: DataFrame) -> DataFrame:
    """Every file's tags after the edit."""
    joined = before.alias("b").join(edit.select(*FILE, *TAG_FIELDS).alias("e"), FILE)
    current = {f: F.col(f"b.{f}") for f in TAG_FIELDS}
    change = {f: F.col(f"e.{f}") for f in TAG_FIELDS}
    return joined.select(*FILE, *tags_applied(current, change).values())


def tag_changes(before: DataFrame, edit: DataFrame) -> DataFrame:
    """Long-form difference, in field order: only fields the edit names and alters.

    Clearing a field that is absent is listed: absent and empty are not the same.
    """
    joined = before.alias("b").join(edit.select(*FILE, *TAG_FIELDS).alias("e"), FILE)
    fields = F.array(
        *[
            F.struct(
                F.lit(i).alias("field_no"),
                F.lit(key).alias("field"),
                F.col(f"b.{f}").alias("before"),
                F.col(f"e.{f}").alias("after"),
            )
            for i, (f, key) in enumerate(TAG_FIELDS.items())
        ]
    )
    altered = F.filter(
        fields, lambda c: c["after"].isNotNull() & ~c["before"].eqNullSafe(c["after"])
    )
    return joined.select(*FILE, F.explode(altered).alias("c")).select(*FILE, "c.*")


def _seen(tags: DataFrame) -> DataFrame:
    """Distinct non-empty show-level values with the first file that has each."""
    fields = F.array(
        *[
            F.struct(F.lit(i).alias("field_no"), F.lit(TAG_FIELDS[f]).alias("field"), F.col(f).alias("value"))
            for i, f in enumerate(SHOW_FIELDS)
        ]
    )
    long = tags.select(*FILE, F.explode(F.filter(fields, lambda c: c["value"] != "")).alias("c"))
    return long.groupBy(*SET, "c.field_no", "c.field", "c.value").agg(F.min("ordinal").alias("first_seen"))


def show_values(tags: DataFrame) -> DataFrame:
    """First value per set and show field, and whether the files disagree."""
    return (
        _seen(tags)
        .groupBy(*SET, "field_no", "field")
        .agg(F.min_by("value", "first_seen").alias("value"), F.count(F.lit(1)).alias("distinct_values"))
        .withColumn("disagrees", F.col("distinct_values") > 1)
    )


def show_disagreements(tags: DataFrame, longest: int | None = None) -> DataFrame:
    """The values of each field that differs inside a set, numbered as first seen.

    A field has no more values than its set has files, so ``longest`` is that of ``tags``.
    """
    longest = longest_set(tags, SET) if longest is None else longest
    keys = [*SET, "field_no", "field"]
    ranked = number_rows(_seen(tags), keys, ["first_seen"], "value_no", longest=longest)
    counted = scan_sets(
        ranked, keys, totals={"_values": (F.sum, F.lit(1).cast("long"))}, ordinal="value_no", longest=longest
    )
    return counted.filter(F.col("_values") > 1).drop("_values")


def seed_show(tags: DataFrame, folders: DataFrame) -> DataFrame:
    """The first file's record that has any tag at all; the date may come from the folder."""
    fields = {f: F.col(f) for f in TAG_FIELDS}
    first = F.min(F.when(~no_tags(fields), F.struct("ordinal", *TAG_FIELDS)))
    show = parse_show_folder(F.col("folder"))
    return (
        tags.groupBy(*SET)
        .agg(first.alias("_first"))
        .join(folders.select(*SET, "folder"), SET, "left")
        .withColumn("_folder_date", render_show_date(show["date"], F.lit("LONG")))
        .select(
            *SET,
            *[
                (F.coalesce(F.col("_first.date"), "_folder_date") if f == "date" else F.col(f"_first.{f}")).alias(f)
                for f in TAG_FIELDS
            ],
        )
    )


def align_titles(tracks: DataFrame, titles: DataFrame, strict: bool = False) -> DataFrame:
    """Titles to tracks by place; an empty or missing line leaves a title alone.

    ``tracks``: ``set_id, track_number``; ``titles``: ``set_id, title_no, title``. More lines
    than tracks refuse the set; ``strict`` refuses any difference. Refused sets keep their rows.
    """
    t = tracks.groupBy(*SET).agg(F.count(F.lit(1)).alias("_tracks"))
    lines = titles.groupBy(*SET).agg(F.count(F.lit(1)).alias("_lines"))
    both = t.join(lines, SET, "left").na.fill(0, ["_lines"])
    wrong = F.col("_lines") != F.col("_tracks") if strict else F.col("_lines") > F.col("_tracks")
    refused = both.select(*SET, F.when(wrong, "TITLE_COUNT").alias("refused"))
    placed = tracks.join(
        titles.select(*SET, F.col("title_no").alias("track_number"), F.nullif(F.col("title"), F.lit("")).alias("title")),
        [*SET, "track_number"],
        "left",
    )
    return placed.join(refused, SET).select(
        *SET, "track_number", F.when(F.col("refused").isNull(), F.col("title")).alias("title"), "refused"
    )


def show_record(tags: DataFrame) -> DataFrame:
    """One row per set with the first non-empty value of each show field."""
    firsts = [
        F.min(F.when(F.col(f) != "", F.struct(F.col("ordinal").alias("o"), F.col(f).alias("v")))).alias(f)
        for f in SHOW_FIELDS
    ]
    return tags.groupBy(*SET).agg(*firsts).select(*SET, *[F.col(f"{f}.v").alias(f) for f in SHOW_FIELDS])
