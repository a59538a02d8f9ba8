"""Files laid end to end in one stream, the pieces cut from it, and who a bad piece can blame.

Files: ``set_id, ordinal, length, is_pad`` in stream order. Pieces are numbered from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.formats import base_name, dir_name, needs_attention
from tapeledger.operators.digests import chained_sha1, hashed_pieces, joined_bytes, tree_digest
from tapeledger.operators.ordered import scan_sets
from tapeledger.session import union_all

SET = ["set_id"]
# Piece numbers one row may hold before they are exploded.
PIECES_PER_ROW = 4096


def file_spans(files: DataFrame, length: Column | None = None, longest: int | None = None) -> DataFrame:
    """Where each file starts and ends in the stream."""
    length = F.col("length") if length is None else length
    ends = scan_sets(files, SET, running={"end": (F.sum, length)}, longest=longest)
    return ends.withColumn("start", F.col("end") - length)


def _piece_of(at: Column, piece_length: Column) -> Column:
    return F.call_function("div", at, piece_length)


def piece_segments(spans: DataFrame, piece_length: Column) -> DataFrame:
    """The part of each file in each piece it overlaps; empty files have none.

    Piece numbers are generated from each span, so no span is ever compared with every piece.
    They come in two steps to keep the arrays of very large files small.
    """
    size = piece_length.cast("long")
    first, last = _piece_of(F.col("start"), size), _piece_of(F.col("end") - 1, size)
    run = F.lit(PIECES_PER_ROW).cast("long")
    chunks = (
        spans.filter(F.col("end") > F.col("start"))
        .withColumns({"_size": size, "_first": first, "_last": last})
        .withColumn("_run", F.explode(F.sequence(_piece_of(F.col("_first"), run), _piece_of(F.col("_last"), run))))
    )
    pieces = chunks.withColumn(
        "piece",
        F.explode(
            F.sequence(
                F.greatest(F.col("_first"), F.col("_run") * run),
                F.least(F.col("_last"), F.col("_run") * run + (run - 1)),
            )
        ),
    )
    begin = F.col("piece") * F.col("_size")
    start = F.greatest("start", begin)
    stop = F.least(F.col("end"), begin + F.col("_size"))
    return pieces.select(
        *[c for c in spans.columns if c not in ("start", "end", "content")],
        "piece",
        (start - F.col("start")).alias("from_byte"),
        (start - begin).alias("piece_at"),
        (stop - start).alias("bytes"),
    )


def piece_slices(chunks: DataFrame, piece_length: int | Column) -> DataFrame:
    """Cut chunks of content (``set_id, start, length, is_pad, content``) at piece edges.

    ``start`` is the chunk's offset in the stream. A file may come as one chunk or as many.
    Padding has ``bytes`` and no ``data``, so zeros are never laid out. The slices are cut before they are exploded, so no row carries its whole chunk along.
    """
    size = (F.lit(piece_length) if isinstance(piece_length, int) else piece_length).cast("long")
    start, end = F.col("start"), F.col("start") + F.col("length")
    kept = [c for c in ("ordinal", "reason") if c in chunks.columns]

    def slice_of(piece: Column) -> Column:
        begin = piece * size
        lo, hi = F.greatest(start, begin), F.least(end, begin + size)
        data = F.when(~F.col("is_pad"), F.substring("content", (lo - start + 1).cast("int"), (hi - lo).cast("int")))
        return F.struct(piece.alias("piece"), (lo - begin).alias("piece_at"), (hi - lo).alias("bytes"), data.alias("data"))

    pieces = F.sequence(_piece_of(start, size), _piece_of(end - 1, size))
    return (
        chunks.filter(F.col("length") > 0)
        .select(*SET, *kept, F.explode(F.transform(pieces, slice_of)).alias("s"))
        .select(*SET, *kept, "s.*")
    )


def piece_digests(slices: DataFrame, algorithm: str = "sha1") -> DataFrame:
    """Digest of each piece that could be read, whatever its length."""
    found = hashed_pieces(slices, algorithm).filter(F.col("digest").isNotNull())
    return found.select(*SET, "piece", F.col("digest").alias(algorithm))


def set_audio_digest(slices: DataFrame) -> DataFrame:
    """One digest per set for its members' audio laid end to end, padding left out upstream.

    A single MD5 over a set cannot be shared between tasks, and it is only ever compared. A
    tree over the pieces of a fixed grid answers the same question in parallel.
    """
    return tree_digest(piece_digests(slices, "md5"), SET, "piece", "md5")


def size_precheck(torrent_files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Sizes against the listing; contents are never read.

    ``torrent_files``: ``set_id, ordinal, path, length, is_pad``; ``inventory``: ``path, size,
    is_file, error`` with ``path`` resolved the same way on both sides.
    """
    found = inventory.select(
        "path", F.col("size").alias("actual"), "is_file", F.col("error").alias("_error"), F.lit(True).alias("_in")
    )
    reason = F.coalesce(F.col("_error"), F.when(~F.col("is_file"), "not a regular file"))
    status = (
        F.when(F.col("is_pad"), "PADDING")
        .when(F.col("_in").isNull(), "MISSING")
        .when(reason.isNotNull(), "UNREADABLE")
        .when(F.col("actual") == F.col("length"), "SIZE_OK")
        .otherwise("WRONG_SIZE")
    )
    joined = torrent_files.join(found, "path", "left").withColumn("status", status)
    wrong = F.col("status") == "WRONG_SIZE"
    return joined.select(
        *torrent_files.columns,
        "status",
        F.when(wrong, F.col("length")).alias("expected"),
        F.when(wrong, F.col("actual")).alias("actual"),
        F.when(F.col("status") == "UNREADABLE", reason).alias("reason"),
    )


def extras(roots: DataFrame, torrent_files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files under a torrent's folder that it does not list; none for single-file torrents.

    ``roots``: ``set_id, root, is_single_file``. Each path is offered to its ancestors by
    equality, so no path is matched against every root.
    """
    cells = F.split("path", "/")
    depth = F.size(cells)
    # The last cell is the file itself; its folders are all shorter prefixes.
    ancestors = F.transform(
        F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda n: F.array_join(F.slice(cells, 1, n), "/")
    )
    placed = inventory.filter(F.col("is_file") & (depth > 1)).select("path", F.explode(ancestors).alias("root"))
    inside = placed.join(roots.filter(~F.col("is_single_file")).select("set_id", "root"), "root")
    return except_listed(inside.select("set_id", "path"), torrent_files.select("set_id", "path"))


def except_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose keys (all of ``listed``'s columns) are not listed; columns are kept."""
    return rows.join(listed, listed.columns, "left_anti")


def resolve_root(torrents: DataFrame, dirs: DataFrame, files: DataFrame) -> DataFrame:
    """The folder a torrent's paths hang off.

    ``torrents``: ``set_id, name, is_single_file, given``. Pointing at the file itself, at the
    folder that holds the set's folder, or at that folder all work.
    """
    given_dir = dirs.select(F.col("path").alias("given"), F.lit(True).alias("_is_dir"))
    inside_dir = dirs.select(F.col("path").alias("_inside"), F.lit(True).alias("_has_inside"))
    given_file = files.select(F.col("path").alias("given"), F.lit(True).alias("_is_file"))
    joined = (
        torrents.withColumn("_inside", F.concat_ws("/", "given", "name"))
        .join(given_dir, "given", "left")
        .join(given_file, "given", "left")
        .join(inside_dir, "_inside", "left")
    )
    parent = dir_name(F.col("given"))
    root = (
        F.when(F.col("_is_file"), F.when(parent == "", ".").otherwise(parent))
        .when(F.col("_is_dir").isNull(), None)
        .when(F.col("is_single_file"), F.col("given"))
        .when(F.col("_has_inside"), F.col("_inside"))
        .otherwise(F.col("given"))
    )
    return joined.select(
        *torrents.columns, root.alias("root"), F.when(root.isNull(), "NO_SUCH_FOLDER").alias("refused")
    )


def piece_outcomes(segments: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """OK, FAILED or UNVERIFIABLE per piece, with how many real files share it.

    ``segments`` carry ``status`` from the size check; ``expected`` and ``actual`` hold ``sha1``.
    """
    readable = F.col("status").isin("SIZE_OK", "PADDING")
    per_piece = segments.groupBy(*SET, "piece").agg(
        F.bool_and(readable).alias("_usable"), F.count_if(~F.col("is_pad")).alias("real_files")
    )
    hashes = expected.withColumnRenamed("sha1", "_expected").join(
        actual.withColumnRenamed("sha1", "_actual"), [*SET, "piece"], "left"
    )
    outcome = (
        F.when(~F.coalesce("_usable", F.lit(False)) | F.col("_actual").isNull(), "UNVERIFIABLE")
        .when(F.col("_expected") == F.col("_actual"), "OK")
        .otherwise("FAILED")
    )
    return hashes.join(per_piece, [*SET, "piece"], "left").select(
        *SET, "piece", outcome.alias("outcome"), F.coalesce("real_files", F.lit(0)).alias("real_files")
    )


def attribute_failures(segments: DataFrame, outcomes: DataFrame, files: DataFrame) -> DataFrame:
    """Per-file status from per-piece outcomes.

    A failed piece inside one real file convicts it; one shared by several convicts none of
    them. Whether a piece is shared is a count per piece, so files are never paired up. Lists
    of bad pieces and of sharers are rows of ``bad_pieces``. An empty file overlaps no piece
    and is complete when it is there.
    """
    failed = F.col("outcome") == "FAILED"
    alone, shared = failed & (F.col("real_files") == 1), failed & (F.col("real_files") > 1)
    per_file = (
        segments.filter(~F.col("is_pad"))
        .select(*SET, "ordinal", "piece")
        .join(outcomes, [*SET, "piece"])
        .groupBy(*SET, "ordinal")
        .agg(
            F.count_if(F.col("outcome") == "OK").alias("_verified"),
            F.count_if(F.col("outcome") == "UNVERIFIABLE").alias("_unverifiable"),
            F.count_if(alone).alias("_bad"),
            F.min(F.when(alone, F.col("piece"))).alias("_first_bad"),
            F.min(F.when(shared, F.struct("piece", "real_files"))).alias("_shared"),
        )
    )
    joined = files.join(per_file, [*SET, "ordinal"], "left")
    status = (
        F.when(F.col("status") != "SIZE_OK", F.col("status"))
        .when(F.col("_bad") > 0, "CORRUPT")
        .when(F.col("_shared").isNotNull(), "SUSPECT")
        .when(F.col("_unverifiable") > 0, "PARTIAL")
        .otherwise("COMPLETE")
    )
    judged = joined.withColumn("_status", status)

    def only(state: str, value: Column) -> Column:
        return F.when(F.col("_status") == state, value)

    return judged.select(
        *SET,
        "ordinal",
        F.col("_status").alias("status"),
        only("CORRUPT", F.col("_bad")).alias("bad_pieces"),
        only("CORRUPT", F.col("_first_bad")).alias("first_bad_piece"),
        only("SUSPECT", F.col("_shared.piece")).alias("suspect_piece"),
        only("SUSPECT", F.col("_shared.real_files") - 1).alias("shared_with"),
        only("PARTIAL", F.col("_verified")).alias("verified"),
        only("PARTIAL", F.col("_unverifiable")).alias("unverifiable"),
    )


def bad_pieces(segments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every real file of every failed piece; ``exclusive`` when it is the piece's only one."""
    failed = outcomes.filter(F.col("outcome") == "FAILED")
    return (
        segments.filter(~F.col("is_pad"))
        .select(*SET, "ordinal", "piece")
        .join(failed, [*SET, "piece"])
        .select(*SET, "piece", "ordinal", (F.col("real_files") == 1).alias("exclusive"))
    )


def piece_counts(outcomes: DataFrame) -> DataFrame:
    status = F.col("outcome")
    return outcomes.groupBy(*SET).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "OK").alias("ok"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(status == "UNVERIFIABLE").alias("unverifiable"),
    )


def torrent_verdict(statuses: DataFrame, quick: bool = False) -> DataFrame:
    clean = "SIZES_MATCH" if quick else "COMPLETE"
    verdict = F.when(F.bool_or(needs_attention(F.col("status"))), "INCOMPLETE").otherwise(clean)
    return statuses.groupBy(*SET).agg(
        verdict.alias("verdict"), F.count_if(needs_attention(F.col("status"))).alias("needs_attention")
    )


def torrent_summary(torrents: DataFrame, files: DataFrame) -> DataFrame:
    """Real and padding files, bytes, pieces and trackers per torrent.

    ``torrents``: ``set_id, name, piece_length, announce, multitracker``.
    """
    totals = files.groupBy(*SET).agg(
        F.count_if(~F.col("is_pad")).alias("real_files"),
        F.count_if("is_pad").alias("padding_files"),
        F.sum("length").alias("total_bytes"),
    )
    size = F.col("piece_length").cast("long")
    return torrents.join(totals, SET, "left").select(
        *SET,
        "name",
        "real_files",
        "padding_files",
        "total_bytes",
        "piece_length",
        _piece_of(F.col("total_bytes") + size - 1, size).alias("pieces"),
        F.size(F.flatten("announce")).alias("trackers"),
        "multitracker",
    )


def set_torrent_lookup(dirs: DataFrame, inventory: DataFrame) -> DataFrame:
    """``<folder>.torrent`` beside the folder, else the only ``.torrent`` inside it."""
    torrents = inventory.filter(F.col("is_file") & base_name(F.col("path")).rlike(r"^.+\.torrent\z"))
    beside = torrents.select(
        F.regexp_replace("path", r"\.torrent\z", "").alias("dir"), F.col("path").alias("_beside")
    )
    inside = (
        torrents.groupBy(dir_name(F.col("path")).alias("dir"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_inside"))
    )
    found = dirs.select("dir").join(beside, "dir", "left").join(inside, "dir", "left")
    path = F.when(F.col("_beside").isNotNull(), F.col("_beside")).when(F.col("_n") == 1, F.col("_inside"))
    refused = F.when(path.isNull(), F.when(F.col("_n") > 1, "SEVERAL").otherwise("NONE"))
    return found.select("dir", path.alias("torrent"), refused.alias("refused"))


def _text(value: Column) -> Column:
    return F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)


def _number(value: Column) -> Column:
    return F.concat(F.lit("i"), value.cast("string"), F.lit("e"))


def set_identity(
    drafts: DataFrame, files: DataFrame, pieces: DataFrame, rows_per_part: int = 4096
) -> DataFrame:
    """Length and SHA-1 of every set's canonical ``info`` document.

    ``drafts``: ``set_id, name, piece_length, private, source, is_single_file``; ``files``:
    ``set_id, ordinal, path_parts, length, is_pad``; ``pieces``: ``set_id, piece, sha1``.
    File entries and hashes are encoded in parts of bounded size by many tasks; only the hash
    over a set's parts is one chain.
    """
    entry = F.concat(
        F.lit("d"),
        F.when(F.col("is_pad"), "4:attr1:p").otherwise(""),
        F.lit("6:length"),
        _number(F.col("length")),
        F.lit("4:pathl"),
        F.array_join(F.transform("path_parts", _text), ""),
        F.lit("ee"),
    )

    def parts(rows: DataFrame, section: int, order: str, data: Column) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), data.alias("data"))))
        return (
            rows.withColumn("part", F.floor(F.col(order) / rows_per_part).cast("long"))
            .groupBy(*SET, "part")
            .agg(packed.alias("_p"))
            .select(*SET, F.lit(section).alias("section"), "part", joined_bytes(F.col("_p"), "data").alias("data"))
        )

    many = drafts.filter(~F.col("is_single_file")).select("set_id")
    entries = parts(files.join(many, SET, "left_semi"), 1, "ordinal", entry.cast("binary"))
    hashes = parts(pieces, 3, "piece", F.unhex("sha1"))
    totals = files.groupBy(*SET).agg(F.sum("length").alias("_total"))
    counts = pieces.groupBy(*SET).agg(F.count(F.lit(1)).alias("_pieces"))
    framed = drafts.join(totals, SET).join(counts, SET)
    single = F.col("is_single_file")
    head = F.concat(F.lit("d"), F.when(single, F.concat(F.lit("6:length"), _number(F.col("_total")))).otherwise("5:filesl"))
    middle = F.concat(
        F.when(single, "").otherwise("e"),
        F.lit("4:name"),
        _text(F.col("name")),
        F.lit("12:piece length"),
        _number(F.col("piece_length")),
        F.lit("6:pieces"),
        (F.col("_pieces") * 20).cast("string"),
        F.lit(":"),
    )
    tail = F.concat(
        F.when(F.col("private"), "7:privatei1e").otherwise(""),
        F.when(F.col("source").isNotNull(), F.concat(F.lit("6:source"), _text(F.col("source")))).otherwise(""),
        F.lit("e"),
    )
    frame = framed.select(
        *SET,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("section"), F.lit(0).cast("long").alias("part"), c.cast("binary").alias("data"))
                    for s, c in ((0, head), (2, middle), (4, tail))
                ]
            )
        ).alias("p"),
    ).select(*SET, "p.*")
    document = union_all(frame, entries, hashes)
    return chained_sha1(document, "set_id", ["section", "part"], "data").withColumnRenamed("sha1", "info_hash")
