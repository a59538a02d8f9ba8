"""Whole checks of a collection on disk: its checksum lists, its torrents, its sector boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.functions.formats import classify_format, dir_name, is_readable
from tapeledger.functions.names import parse_track_name
from tapeledger.functions.tags import TAG_FIELDS, edit_for_track
from tapeledger.operators import layout as L
from tapeledger.operators import tags as G
from tapeledger.operators.digests import hashed_pieces
from tapeledger.operators.manifests import check_all_lists, digest_rows
from tapeledger.operators.ordered import attach, longest_set, number_rows
from tapeledger.operators.quality import torrent_violations
from tapeledger.operators.repair import fix_rows, fix_summary, plan_shift
from tapeledger.schemas import STREAM
from tapeledger.session import cut_lineage, union_all
from tapeledger.sources import audio as A
from tapeledger.sources.opening import list_files
from tapeledger.sources.text import read_manifests
from tapeledger.sources.torrents import read_torrents, rule_columns, torrent_files, torrent_pieces

SET = ["set_id"]
VERSION = "2"


def check_lists(spark: SparkSession, root: str, recursive: bool = True, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every entry of every list under ``root`` against the file it names, and refused lines.

    Only files that a list names are opened, and only as far as its kind needs. ``listed`` is what
    ``list_files`` found there, if it is known already.
    """
    manifest, bad_lines = read_manifests(spark, root, recursive)
    wanted = manifest.select("dir", "file_name", "kind").distinct()
    named = wanted.withColumn("path", F.concat_ws("/", "dir", "file_name"))
    listed = list_files(spark, root, recursive) if listed is None else listed
    present = listed.drop("reason").join(named, "path").withColumn("format", classify_format(F.col("path")))

    none = {"stream": STREAM, "data_offset": "bigint", "data_len": "bigint", "reason": "string"}
    empty = {n: F.lit(None).cast(t) for n, t in none.items()}
    by_bytes = present.filter(F.col("kind") == "md5").withColumns(empty)
    by_audio = present.filter((F.col("kind") != "md5") & F.coalesce(is_readable(F.col("format")), F.lit(False)))
    unknown = present.filter((F.col("kind") != "md5") & ~F.coalesce(is_readable(F.col("format")), F.lit(False)))
    probed = A.probe(by_audio).drop("comments", "encoder")
    unread = unknown.withColumns(empty).withColumn("reason", F.lit("UNKNOWN_FORMAT"))

    # MD5 needs all bytes, ST5 a WAV's audio; an FFP is in the header already read.
    hashing = (F.col("kind") == "md5") | ((F.col("kind") == "st5") & F.col("data_len").isNotNull())
    # One look at each file: both kinds of entry below read it from here.
    every = cut_lineage(union_all(by_bytes, probed))
    hashed = A.file_digests(every.filter(hashing).drop("reason"))
    rest = union_all(every.filter(~hashing), unread).withColumns(
        {"file_md5": F.lit(None).cast("string"), "st5": F.lit(None).cast("string")}
    )
    return check_all_lists(manifest, digest_rows(union_all(hashed, rest))), bad_lines


def _folders(listing: DataFrame) -> DataFrame:
    """Every folder that holds a listed file, at any depth."""
    cells = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(cells)), lambda n: F.array_join(F.slice(cells, 1, n), "/"))
    holding = listing.select(dir_name(F.col("path")).alias("dir")).distinct()
    return holding.select(F.explode(above).alias("path")).distinct()


def check_torrents(
    documents: DataFrame, given: DataFrame, listing: DataFrame, quick: bool = False
) -> dict[str, DataFrame]:
    """Torrents against the files on disk.

    ``documents`` as decoded, ``given``: ``set_id, given`` (where to look), ``listing``: ``path,
    file_size``. Returns ``files`` (a status each), ``verdicts``, ``extras``, ``roots`` and,
    unless ``quick``, ``pieces``. A quick check never opens a file.
    """
    documents = cut_lineage(documents)
    roots = L.resolve_root(
        documents.select(*SET, "name", "is_single_file").join(given, SET), _folders(listing), listing.select("path")
    )
    listed = torrent_files(documents)
    longest = longest_set(listed, SET)
    found_root = roots.filter(F.col("refused").isNull()).select(*SET, "root")
    sizes = documents.select(*SET, "piece_length")
    placed = attach(listed, found_root.join(sizes, SET), SET, "inner", longest=longest).withColumn(
        "path", F.concat_ws("/", "root", "path")
    )
    disk = listing.select(
        "path", F.col("file_size").alias("size"), F.lit(True).alias("is_file"), F.lit(None).cast("string").alias("error")
    )
    checked = L.size_precheck(placed, disk)
    extras = L.extras(roots.select(*SET, "root", "is_single_file"), placed, disk)
    report = {"roots": roots, "extras": extras}
    if quick:
        return report | {"files": checked, "verdicts": L.torrent_verdict(checked, quick=True)}

    spans = L.file_spans(checked, longest=longest)
    readable = spans.filter(F.col("status").isin("SIZE_OK", "PADDING"))
    slices = L.piece_slices(A.read_chunks(readable), F.col("piece_length"))
    # Reading is the dear step: one pass gives digests and failures, a few bytes a piece, which are kept.
    hashed = cut_lineage(hashed_pieces(slices).withColumnRenamed("digest", "sha1"))
    failed = hashed.filter(F.col("ordinal").isNotNull()).select(*SET, "ordinal", F.lit(True).alias("_failed")).distinct()
    judged = spans.join(failed, [*SET, "ordinal"], "left").withColumn(
        "status", F.when(F.col("_failed"), "UNREADABLE").otherwise(F.col("status"))
    )
    segments = L.piece_segments(judged.drop("_failed"), F.col("piece_length"))
    actual = hashed.filter(F.col("ordinal").isNull()).select(*SET, "piece", "sha1")
    outcomes = L.piece_outcomes(segments, torrent_pieces(documents), actual)
    files = L.attribute_failures(segments, outcomes, judged)
    return report | {
        "files": files,
        "verdicts": L.torrent_verdict(files),
        "pieces": L.piece_counts(outcomes),
        "bad_pieces": L.bad_pieces(segments, outcomes),
    }


def plan_repairs(inventory: DataFrame, direction: str = "backward", pad_tail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Repair plan of every folder of a probed inventory: rows per file, and a summary per set."""
    shape = ("stream.sample_rate", "stream.channels", "stream.bits_per_sample")
    # Headers are looked at once; the plan then works on this narrow table.
    probed = cut_lineage(
        inventory.select(dir_name(F.col("path")).alias("set_id"), "path", F.col("stream.total_frames").alias("frames"), *shape)
    )
    longest = longest_set(probed, SET)
    numbered = number_rows(probed, SET, ["path"], longest=longest)
    plan = plan_shift(numbered, direction, pad_tail, longest)
    rows = fix_rows(plan, longest)
    return rows, fix_summary(plan, rows)


def plan_tags(inventory: DataFrame) -> DataFrame:
    """Every tag field a probed file would change: ``path, field, before, after``; ``field`` is null where none would.

    A folder's files get the show's fields of its first tagged file, the date from the folder's name
    if that has none, their own title, place and count. Files that carry no tags are left out.
    """
    tagged = A.read_tags(inventory).filter(F.col("tag_status") == "OK")
    rows = cut_lineage(tagged.select(dir_name(F.col("path")).alias("set_id"), "path", "format", *TAG_FIELDS))
    longest = longest_set(rows, SET)
    rows = cut_lineage(number_rows(rows, SET, ["path"], longest=longest))
    folders = rows.select(*SET).distinct().withColumn("folder", F.regexp_extract("set_id", "[^/]*$", 0))
    show = G.seed_show(rows, folders).select(*SET, *[F.col(f).alias(f"show_{f}") for f in TAG_FIELDS])
    own = rows.select(*SET, "ordinal", "format", "title")
    joined = attach(G.track_position(own, longest), show, SET, "inner", longest=longest)
    edit = edit_for_track({f: F.col(f"show_{f}") for f in TAG_FIELDS}, F.col("title"), F.col("track_number"), F.col("track_total"))
    changes = G.tag_changes(rows, joined.select(*SET, "ordinal", edit.alias("e")).select(*SET, "ordinal", "e.*"))
    return rows.select(*SET, "ordinal", "path").join(changes, [*SET, "ordinal"], "left").select("path", "field", "before", "after")


def audit_collection(
    spark: SparkSession, root: str, direction: str = "nearest", pad_tail: bool = True, recursive: bool = True, quick: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One audit of everything under ``root``: findings, totals and provenance.

    Findings are rows ``section, set_id, path, status, detail``: LIST (each entry of each checksum
    list), LIST_LINE (lines no list can have), UNUSED (files and folders that could not be read, with
    reason), REPAIR (each set's boundaries: REFUSED, ALIGNED, FIXED or PARTLY_FIXED), NAME
    (whether a file's name says band, date and track), TORRENT (each torrent's files, looked for
    beside it, with a status each; its verdict, bad pieces and files it does not list; torrents REFUSED, with the
    reason; ``quick`` compares sizes only) and TAG (each tag field a file would change, from and to;
    UNCHANGED and NOT_TAGGABLE files). A bad folder, file or line is a row and stops
    nothing. The tree is listed once. Totals count findings by section, set and status. Write each with ``audit_report``.
    """
    there = list_files(spark, root, recursive)
    checked, bad_lines = check_lists(spark, root, recursive, there)
    inventory, unused = A.scan_inventory(spark, root, recursive, there)
    inventory = cut_lineage(inventory)
    documents, refused = read_torrents(spark, root, recursive, there)
    documents = cut_lineage(documents)
    listed = torrent_files(documents)
    broken = cut_lineage(torrent_violations(rule_columns(documents), listed).filter(F.col("rule").isNotNull()))
    sound = documents.join(broken.select(*SET).distinct(), SET, "left_anti")
    beside = sound.select(*SET, dir_name(F.col("set_id")).alias("given"))
    listing = there.filter(F.col("reason").isNull())
    torrents = check_torrents(sound, beside, listing, quick)
    roots = torrents["roots"]
    files = torrents["files"].select(*SET, "ordinal", "status").join(listed.select(*SET, "ordinal", "path"), [*SET, "ordinal"])
    files = files.join(roots.select(*SET, "root"), SET).withColumn("path", F.concat_ws("/", "root", "path"))
    _, summary = plan_repairs(inventory, direction, pad_tail)
    none = F.lit(None).cast("string")

    def section(rows: DataFrame, name: str, set_id, path, status, detail) -> DataFrame:
        values = {"set_id": set_id, "path": path, "status": status, "detail": detail}
        return rows.select(F.lit(name).alias("section"), *[c.cast("string").alias(n) for n, c in values.items()])

    path, moved = F.col("path"), F.coalesce("boundaries_moved", F.lit(0))
    repaired = (
        F.when(F.col("refused").isNotNull(), "REFUSED")
        .when((moved == 0) & (F.coalesce("tail_padding", F.lit(0)) == 0) & F.col("fully_fixed"), "ALIGNED")
        .when(F.col("fully_fixed"), "FIXED")
        .otherwise("PARTLY_FIXED")
    )
    set_id, change = F.col("set_id"), F.concat_ws(" ", "field", F.lit(":"), F.coalesce("before", F.lit("")), F.lit("->"), "after")
    untagged = A.read_tags(inventory).filter(F.col("tag_status") != "OK")
    plan = plan_tags(inventory)
    pieces = [] if quick else [section(torrents["bad_pieces"], "TORRENT", set_id, set_id, F.lit("BAD_PIECE"), F.col("piece"))]
    named = parse_track_name(F.regexp_extract(path, "[^/]*$", 0)).isNotNull()
    found = cut_lineage(
        union_all(
            section(checked, "LIST", F.col("dir"), F.concat_ws("/", "dir", "file_name"), F.col("status"), F.col("error")),
            section(bad_lines, "LIST_LINE", dir_name(F.col("list_path")), F.col("list_path"), F.lit("BAD_LINE"), F.col("detail")),
            section(unused, "UNUSED", dir_name(path), path, F.lit("UNUSED"), F.col("reason")),
            section(summary, "REPAIR", F.col("set_id"), F.col("set_id"), repaired, F.col("refused")),
            section(inventory, "NAME", dir_name(path), path, F.when(named, "NAMED").otherwise("OTHER"), none),
            section(refused, "TORRENT", set_id, path, F.lit("REFUSED"), F.col("reason")),
            section(broken, "TORRENT", set_id, set_id, F.lit("REFUSED"), F.col("rule")),
            section(roots.filter("refused IS NOT NULL"), "TORRENT", set_id, set_id, F.lit("REFUSED"), F.col("refused")),
            section(files, "TORRENT", set_id, path, F.col("status"), none),
            section(torrents["verdicts"], "TORRENT", set_id, set_id, F.col("verdict"), F.col("needs_attention")),
            section(torrents["extras"], "TORRENT", set_id, path, F.lit("EXTRA"), none),
            *pieces,
            section(plan, "TAG", dir_name(path), path, F.when(F.col("field").isNull(), "UNCHANGED").otherwise("CHANGE"), F.when(F.col("field").isNotNull(), change)),
            section(untagged, "TAG", dir_name(path), path, F.col("tag_status"), none),
        )
    )
    totals = found.groupBy("section", "set_id", "status").agg(F.count(F.lit(1)).alias("findings"))
    made = found.groupBy("section").agg(F.count(F.lit(1)).alias("findings")).select(
        F.lit("audit").alias("operation"), F.lit(root).alias("input"), F.col("section").alias("output"),
        F.lit("tapeledger").alias("agent"), F.lit(VERSION).alias("version"), none.alias("tool_path"), none.alias("sha256"),
        F.array(F.lit(direction), F.lit(str(pad_tail))).alias("argv"),
    )
    return found, totals, made
