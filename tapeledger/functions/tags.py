"""Tag structs, raw comment maps and tracker tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag fields in order, as column name -> key in the file.
TAG_FIELDS = {
    "title": "TITLE",
    "artist": "ARTIST",
    "album": "ALBUM",
    "date": "DATE",
    "track_number": "TRACKNUMBER",
    "track_total": "TRACKTOTAL",
    "genre": "GENRE",
    "comment": "COMMENT",
    "location": "LOCATION",
}
# Fields an info file takes from the whole set, in header order.
SHOW_FIELDS = ["artist", "date", "album", "location", "comment"]


def tags_applied(current: dict[str, Column], edit: dict[str, Column]) -> dict[str, Column]:
    """Edit over current: null keeps, an empty string removes."""
    return {
        field: F.when(edit[field].isNull(), current[field])
        .when(edit[field] != "", edit[field])
        .alias(field)
        for field in TAG_FIELDS
    }


def no_tags(tags: dict[str, Column]) -> Column:
    return F.coalesce(*[tags[f] for f in TAG_FIELDS]).isNull()


def additive_merge(comments: Column, edit: Column) -> Column:
    """Raw comment map with the edit's keys set or removed and every other key kept."""
    merged = F.map_zip_with(
        comments,
        edit,
        lambda _key, old, new: F.when(new.isNull(), old).when(new != "", F.array(new)),
    )
    return F.map_filter(merged, lambda _key, values: values.isNotNull())


def comment_fields(comments: Column) -> dict[str, Column]:
    """The nine fields; the first value of a repeated key wins."""
    return {field: F.get(F.try_element_at(comments, F.lit(key)), F.lit(0)) for field, key in TAG_FIELDS.items()}


def project_comments(comments: Column) -> Column:
    """The nine fields as a struct."""
    return F.struct(*[value.alias(field) for field, value in comment_fields(comments).items()])


def edit_for_track(show: dict[str, Column], title: Column, position: Column, count: Column) -> Column:
    """The show's fields with this track's own title, position and the count of tracks."""
    own = {
        "title": title,
        "track_number": position.cast("string"),
        "track_total": count.cast("string"),
    }
    return F.struct(*[own.get(f, show.get(f, F.lit(None).cast("string"))).alias(f) for f in TAG_FIELDS])


def track_number(text: Column) -> Column:
    """The whole string as a 32-bit number: ``01`` is 1, ``1/17`` is null."""
    value = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long"))
    return F.when(value <= 4294967295, value)


def announce_tiers(announce: Column, tiers: Column) -> Column:
    """Tiers without repeats or empties, led by ``announce`` when no tier has it."""
    clean = F.filter(
        F.transform(
            F.coalesce(tiers, F.array().cast("array<array<string>>")),
            lambda tier: F.array_distinct(F.filter(tier, lambda u: u != "")),
        ),
        lambda tier: F.size(tier) > 0,
    )
    absent = (announce != "") & ~F.array_contains(F.flatten(clean), announce)
    lead = F.array(F.array(announce))
    return F.when(F.coalesce(absent, F.lit(False)), F.concat(lead, clean)).otherwise(clean)


def fill_passkey(announce: Column, key: Column) -> Column:
    """The URL with its key filled in; null when it needs one that is not there."""
    placeholder = F.lit("{passkey}")
    return F.when(~F.contains(announce, placeholder), announce).otherwise(
        F.replace(announce, placeholder, key)
    )
