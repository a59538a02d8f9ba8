"""Manifests against files, twins across formats, and two snapshots of a collection.

Manifest: ``dir, list_path, kind, line_no, file_name, digest``.
Digests: ``dir, file_name, kind, digest, error``, one row per existing file and kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.formats import base_name, dir_name, ffp
from tapeledger.functions.names import manifest_kind, manifest_line, manifest_text
from tapeledger.operators.ordered import longest_set, number_rows, scan_sets, text_parts
from tapeledger.session import union_all


def parse_manifests(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows and refused lines from ``list_path, line_no, line``.

    One bad line does not hide the rest of its list; ``list_status`` says which lists had any.
    """
    parsed = (
        lines.withColumn("kind", manifest_kind(F.col("list_path")))
        .filter(F.col("kind").isNotNull())
        .withColumn("p", manifest_line(F.col("kind"), F.col("line")))
        .filter(~F.col("p.skip"))
        .select(
            dir_name(F.col("list_path")).alias("dir"), "list_path", "kind", "line_no", "line",
            "p.file_name", "p.digest", "p.detail",
        )
    )
    good = parsed.filter(F.col("detail").isNull()).drop("detail", "line")
    bad = parsed.filter(F.col("detail").isNotNull()).select("list_path", "line_no", "kind", "detail")
    return good, bad


def digest_rows(hashed: DataFrame) -> DataFrame:
    """What each named file hashes to, for the kind its list asks for.

    ``hashed``: ``dir, file_name, kind, format, stream, file_md5, st5, reason``. The audio of a
    compressed file is not decoded, so its ST5 is reported as an error and never as a mismatch.
    """
    kind = F.col("kind")
    digest = (
        F.when(kind == "ffp", F.col("stream.audio_md5")).when(kind == "md5", F.col("file_md5")).otherwise(F.col("st5"))
    )
    why = F.when(kind == "ffp", ffp(F.col("stream.audio_md5"))["error"]).otherwise("audio is not decoded")
    error = F.when(digest.isNull(), F.coalesce("reason", why))
    return hashed.select("dir", "file_name", "kind", digest.alias("digest"), error.alias("error"))


def list_status(manifest: DataFrame, bad_lines: DataFrame) -> DataFrame:
    """Entries and refused lines per list; a list is sound when nothing was refused."""
    both = union_all(
        manifest.select("list_path", F.lit(0).alias("bad")), bad_lines.select("list_path", F.lit(1).alias("bad"))
    )
    return both.groupBy("list_path").agg(
        F.count_if(F.col("bad") == 0).alias("entries"),
        F.count_if(F.col("bad") == 1).alias("bad_lines"),
        (F.max("bad") == 0).alias("list_ok"),
    )


def check_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """OK, MISMATCH, MISSING or FAILED per entry; names resolve beside their list."""
    found = digests.select(
        "dir", "file_name", "kind",
        F.col("digest").alias("_actual"), F.col("error").alias("_error"), F.lit(True).alias("_exists"),
    )
    status = (
        F.when(F.col("_exists").isNull(), "MISSING")
        .when(F.col("_error").isNotNull() | F.col("_actual").isNull(), "FAILED")
        .when(F.col("digest") == F.col("_actual"), "OK")
        .otherwise("MISMATCH")
    )
    joined = manifest.join(found, ["dir", "file_name", "kind"], "left").withColumn("status", status)
    mismatch = F.col("status") == "MISMATCH"
    return joined.select(
        *manifest.columns,
        "status",
        F.when(mismatch, F.col("digest")).alias("expected"),
        F.when(mismatch, F.col("_actual")).alias("actual"),
        F.when(F.col("status") == "FAILED", F.coalesce("_error", F.lit("no digest"))).alias("error"),
    )


def check_all_lists(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Every list of every folder; a row names its list only when its folder has several."""
    lists = manifest.select("dir", "list_path").distinct()
    several = lists.groupBy("dir").agg((F.count(F.lit(1)) > 1).alias("_several"))
    # Keyed by list, a folder's rows spread over its lists when they are shuffled.
    per_list = lists.join(several, "dir").drop("dir")
    checked = check_manifest(manifest, digests).join(per_list, "list_path")
    label = F.when(
        F.col("_several"), F.concat(base_name(F.col("list_path")), F.lit(" · "), F.col("file_name"))
    ).otherwise(F.col("file_name"))
    return checked.withColumn("label", label).drop("_several")


def complete_only(digests: DataFrame, longest: int | None = None) -> DataFrame:
    """Rows of the sets in which every member has a digest; no partial list looks complete."""
    whole = scan_sets(
        digests, ["set_id"], totals={"_whole": (F.bool_and, F.col("digest").isNotNull())}, longest=longest
    )
    return whole.filter("_whole").drop("_whole")


def manifest_lines(digests: DataFrame, kind: str, policy: str = "complete", longest: int | None = None) -> DataFrame:
    """One manifest line per file. ``policy="partial"`` keeps sets with gaps."""
    kept = complete_only(digests, longest) if policy == "complete" else digests.filter("digest IS NOT NULL")
    line = manifest_text(F.lit(kind), F.col("file_name"), F.col("digest"))
    return kept.select("set_id", "ordinal", line.alias("line"))


def render_manifests(digests: DataFrame, kind: str, policy: str = "complete", longest: int | None = None) -> DataFrame:
    return text_parts(manifest_lines(digests, kind, policy, longest), ["set_id"], "line")


def outcome_tally(
    results: DataFrame, keys: Sequence[str], labels: Sequence[str], bad: Sequence[str]
) -> DataFrame:
    """Count per outcome, rows done, and whether no bad outcome turned up."""
    status = F.col("status")
    return results.groupBy(*keys).agg(
        *[F.count_if(status == label).alias(label.lower()) for label in labels],
        F.count_if(status.isin(list(labels))).alias("done"),
        (~F.coalesce(F.bool_or(status.isin(list(bad))), F.lit(False))).alias("clean"),
    )


def match_twins(inventory: DataFrame) -> DataFrame:
    """FLAC and WAV of one stem in one folder; equal audio digests mean a lossless pair.

    One grouping by folder and stem. A stem that several files of one format share is ``AMBIGUOUS``:
    one row, with the first name and the least digest of each format.
    """
    stem = F.regexp_extract("file_name", r"(?s)^(.+)\.[^.]*$", 1)
    kinds = {"flac": F.col("format") == "FLAC", "wav": F.col("format") == "WAV"}
    found = (
        inventory.filter(F.col("format").isin("FLAC", "WAV"))
        .groupBy("dir", stem.alias("stem"))
        .agg(*[
            c
            for name, of in kinds.items()
            for c in (
                F.count_if(of).alias(f"_{name}s"),
                F.min(F.when(of, F.col("file_name"))).alias(f"{name}_name"),
                F.min(F.when(of, F.col("audio_md5"))).alias(f"{name}_md5"),
            )
        ])
        .filter("_flacs > 0 AND _wavs > 0")
    )
    flac, wav = F.col("flac_md5"), F.col("wav_md5")
    verdict = (
        F.when((F.col("_flacs") > 1) | (F.col("_wavs") > 1), "AMBIGUOUS")
        .when(flac.isNull() | wav.isNull(), "UNCHECKED")
        .when(flac == wav, "LOSSLESS")
        .otherwise("DIFFERS")
    )
    return found.select("dir", "stem", "flac_name", "flac_md5", "wav_name", "wav_md5", verdict.alias("twin"))


def duplicate_audio(inventory: DataFrame) -> DataFrame:
    """Every file whose audio another file has too, with how many have it; files without a digest are left out.

    Copies are rows, never a list: counts are combined before they are shuffled, and the join on a
    digest with very many files can be split.
    """
    copies = inventory.filter(F.col("audio_md5").isNotNull()).groupBy("audio_md5").agg(F.count(F.lit(1)).alias("copies"))
    return inventory.join(copies.filter("copies > 1"), "audio_md5").select("dir", "file_name", "audio_md5", "copies")


def classify_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to each file between two snapshots of ``path, file_md5, audio_md5``.

    Files whose path is gone are paired with new paths of the same bytes, the first copy with
    the first and so on, so a large group of copies gives one row per file and not all pairs.
    """
    b = before.select("path", F.col("file_md5").alias("b_file"), F.col("audio_md5").alias("b_audio"), F.lit(True).alias("b_in"))
    a = after.select("path", F.col("file_md5").alias("a_file"), F.col("audio_md5").alias("a_audio"), F.lit(True).alias("a_in"))
    both = b.join(a, "path", "full")
    stayed = both.filter(F.col("b_in") & F.col("a_in")).select(
        "path",
        F.col("path").alias("new_path"),
        F.when(F.col("b_file").eqNullSafe(F.col("a_file")), "UNCHANGED")
        .when(F.col("b_audio") == F.col("a_audio"), "RETAGGED")
        .otherwise("AUDIO_CHANGED")
        .alias("change"),
    )
    gone = both.filter(F.col("a_in").isNull()).select("path", F.col("b_file").alias("file_md5"))
    come = both.filter(F.col("b_in").isNull()).select(F.col("path").alias("new_path"), F.col("a_file").alias("file_md5"))
    # One measurement bounds both sides.
    loose = both.filter(F.col("a_in").isNull() | F.col("b_in").isNull())
    longest = longest_set(loose.select(F.coalesce("b_file", "a_file").alias("file_md5")), ["file_md5"])
    gone = number_rows(gone, ["file_md5"], ["path"], "copy_no", longest)
    come = number_rows(come, ["file_md5"], ["new_path"], "copy_no", longest)
    moved = gone.join(come, ["file_md5", "copy_no"], "full").select(
        "path",
        "new_path",
        F.when(F.col("new_path").isNull(), "REMOVED")
        .when(F.col("path").isNull(), "ADDED")
        .otherwise("MOVED")
        .alias("change"),
    )
    return union_all(stayed, moved)


def audio_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """The stop rule of a metadata change: the audio digest must be what it was."""
    pairs = before.select("path", F.col("audio_md5").alias("before_md5")).join(
        after.select("path", F.col("audio_md5").alias("after_md5")), "path"
    )
    same = F.col("before_md5") == F.col("after_md5")
    return pairs.withColumn(
        "verdict",
        F.when(F.col("before_md5").isNull() | F.col("after_md5").isNull(), "NO_MD5")
        .when(same, "UNCHANGED")
        .otherwise("AUDIO_CHANGED"),
    )
