"""A set's info file: disc runs, totals, problems and text.

Tracks: ``set_id, ordinal, file_name, label, disc, title, frames, sample_rate, is_cdda``, in
file order, FLAC files only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.display import duration_short
from tapeledger.functions.formats import tick_secs, ticks
from tapeledger.functions.names import parse_track_name, track_label
from tapeledger.operators.ordered import attach, number_rows, scan_sets, spread, text_parts
from tapeledger.functions.tags import SHOW_FIELDS
from tapeledger.operators.tags import show_values
from tapeledger.session import union_all

SET = ["set_id"]
# Fixed value: seconds a CD-R holds.
CD_MAX_SECS = 4800.0
NO_TITLE = "(no title)"
# Problems an info file can have.
PROBLEMS = ["MISSING_TITLE", "DISAGREES", "NO_LENGTH", "TOO_LONG", "NOT_FLAC", "OTHER_TEXT"]


def label_tracks(tracks: DataFrame) -> DataFrame:
    """Disc and label from each file's name; its position when the name does not parse."""
    named = tracks.withColumn("_n", parse_track_name(F.col("file_name")))
    return named.select(
        *tracks.columns,
        F.col("_n.disc").alias("disc"),
        track_label(F.col("_n.disc"), F.col("_n.track"), F.col("track_number")).alias("label"),
    )


def disc_runs(tracks: DataFrame, longest: int | None = None) -> DataFrame:
    """Number the consecutive runs of one disc number; no number counts as a value."""
    lagged = scan_sets(tracks, SET, prevs={"_before": F.struct(F.col("disc").alias("disc"))}, longest=longest)
    new_run = F.col("_before").isNotNull() & ~F.col("_before.disc").eqNullSafe(F.col("disc"))
    runs = scan_sets(
        lagged.withColumn("_new", new_run.cast("long")), SET, running={"run_no": (F.sum, F.col("_new"))}, longest=longest
    )
    return runs.drop("_before", "_new")


def _length() -> Column:
    return ticks(F.col("frames"), F.col("sample_rate"))


def disc_totals(runs: DataFrame) -> DataFrame:
    """Length of each run, unknown lengths skipped; too long for a CD-R when all is CD audio."""
    return (
        runs.groupBy(*SET, "run_no")
        .agg(
            F.min("disc").alias("disc"),
            F.min("ordinal").alias("first_ordinal"),
            F.count(F.lit(1)).alias("tracks"),
            tick_secs(F.coalesce(F.sum(_length()), F.lit(0))).alias("secs"),
            F.bool_and("is_cdda").alias("all_cdda"),
        )
        .withColumn("too_long", F.col("all_cdda") & (F.col("secs") > CD_MAX_SECS))
    )


def set_total(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*SET).agg(tick_secs(F.coalesce(F.sum(_length()), F.lit(0))).alias("secs"))


def other_text_files(plan: DataFrame, inventory: DataFrame, rows: int | None = None) -> DataFrame:
    """``.txt`` files of a folder other than its planned info file.

    ``plan``: ``set_id, dir, info_file``; ``inventory``: ``dir, file_name``, of
    ``rows`` rows if that is known.
    """
    texts = inventory.filter(F.col("file_name").rlike(r"(?i)^.+\.txt\z")).select("dir", "file_name")
    planned = plan.select("dir", F.col("info_file").alias("file_name"))
    kept = spread(texts, ["dir", "file_name"], rows, 0).join(planned, ["dir", "file_name"], "left_anti")
    return spread(kept, ["dir"], rows, 0).join(plan.select(*SET, "dir"), "dir").select(*SET, "file_name")


def setlist_problems(
    inventory: DataFrame, tracks: DataFrame, tags: DataFrame, runs: DataFrame, other_text: DataFrame | None = None
) -> DataFrame:
    """``set_id, problem, subject``: everything the info file cannot say cleanly."""
    left_out = inventory.filter(~F.coalesce(F.col("format") == "FLAC", F.lit(False))).select(
        *SET, F.lit("NOT_FLAC").alias("problem"), F.col("file_name").alias("subject")
    )
    per_track = F.array_compact(
        F.array(
            F.when(F.coalesce("title", F.lit("")) == "", "MISSING_TITLE"),
            F.when(F.col("frames").isNull(), "NO_LENGTH"),
        )
    )
    on_files = tracks.select(*SET, F.explode(per_track).alias("problem"), F.col("file_name").alias("subject"))
    fields = show_values(tags).filter("disagrees")
    on_fields = fields.select(*SET, F.lit("DISAGREES").alias("problem"), F.col("field").alias("subject"))
    long_discs = disc_totals(runs).filter("too_long")
    what = F.coalesce(F.concat(F.lit("disc "), F.col("disc").cast("string")), F.lit("the set"))
    on_discs = long_discs.select(*SET, F.lit("TOO_LONG").alias("problem"), what.alias("subject"))
    found = union_all(left_out, on_files, on_fields, on_discs)
    if other_text is not None:
        found = union_all(
            found, other_text.select(*SET, F.lit("OTHER_TEXT").alias("problem"), F.col("file_name").alias("subject"))
        )
    return found


def setlist_lines(
    runs: DataFrame, show: DataFrame, longest: int | None = None, signature: str | None = None
) -> DataFrame:
    """Every line of every info file, numbered from 0.

    ``show``: ``set_id, artist, date, album, location, comment``, one row per set.
    ``signature`` is a last line naming the program that wrote the file.
    """
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(NO_TITLE))
    named = show.select(*SET, *[F.col(f).alias(f"_show_{f}") for f in SHOW_FIELDS])
    run = F.struct("run_no")
    whole = scan_sets(
        attach(runs, named, SET, longest=longest).withColumn("_ticks", _length()),
        SET,
        prevs={"_before": run},
        nexts={"_after": run},
        totals={
            "_width": (F.max, F.length(title)),
            "_has_discs": (F.bool_or, F.col("disc").isNotNull()),
            "_set_ticks": (F.sum, F.coalesce("_ticks", F.lit(0))),
        },
        longest=longest,
    )
    rows = scan_sets(
        whole, [*SET, "run_no"], totals={"_run_ticks": (F.sum, F.coalesce("_ticks", F.lit(0)))}, longest=longest
    )

    first, last = F.col("_before").isNull(), F.col("_after").isNull()
    opens = first | (F.col("_before.run_no") != F.col("run_no"))
    closes = last | (F.col("_after.run_no") != F.col("run_no"))
    empty = F.lit("")
    head = [F.col(f"_show_{f}") for f in ("artist", "date", "album", "location")]
    source = F.concat(F.lit("Source: "), F.coalesce("_show_comment", empty))
    disc = F.coalesce(F.concat(F.lit("Disc "), F.col("disc").cast("string")), F.lit("Other"))
    disc_line = F.concat(disc, F.lit(" ["), duration_short(tick_secs(F.col("_run_ticks"))), F.lit("]"))
    time = F.coalesce(duration_short(F.col("frames") / F.col("sample_rate")), F.lit("?:??"))
    aligned = F.when(F.length(time) < 5, F.lpad(time, 5, " ")).otherwise(time)
    track = F.concat(F.col("label"), F.lit("  "), F.rpad(title, F.col("_width"), F.lit(" ")), F.lit("  "), aligned)
    total = F.concat(F.lit("Total: "), duration_short(tick_secs(F.col("_set_ticks"))))
    foot = [total] if signature is None else [total, empty, F.lit(signature)]
    # A set's first row opens the file, a run's first and last rows frame the run.
    lines = F.array(
        *[F.when(first, text) for text in [*head, empty, source, empty]],
        F.when(opens & F.col("_has_discs"), disc_line),
        track,
        F.when(closes, empty),
        *[F.when(last, text) for text in foot],
    )
    exploded = rows.select(*SET, "ordinal", F.posexplode(F.array_compact(lines)).alias("place", "line"))
    # A track adds at most three lines besides the head and foot of its set.
    bound = None if longest is None else 3 * longest + 10
    numbered = number_rows(exploded, SET, ["ordinal", "place"], "line_no", longest=bound)
    return numbered.select(*SET, "line_no", "line")


def render_setlists(
    runs: DataFrame, show: DataFrame, longest: int | None = None, signature: str | None = None
) -> DataFrame:
    """Info files as CRLF text, in parts of bounded size."""
    return text_parts(setlist_lines(runs, show, longest, signature), SET, "line", "\r\n", ordinal="line_no")
