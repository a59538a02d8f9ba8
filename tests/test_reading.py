"""Reading that must neither drop files nor stop at a bad one."""

import hashlib
import struct

from pyspark.sql import functions as F

from tapeledger.functions.formats import bytes_per_frame
from tapeledger.operators.digests import hashed_pieces, tree_digest
from tapeledger.operators.manifests import duplicate_audio, match_twins
from tapeledger.operators.ordered import submission_order
from tapeledger.sinks.render import audit_report
from tapeledger.sources import opening
from tapeledger.sources.audio import read_chunks, scan_inventory
from tapeledger.sources.opening import list_files, map_files
from tapeledger.sources.text import read_manifests
from tapeledger.sources.torrents import read_torrents


def wav(rate, frames=10):
    data = b"\0" * 4 * frames
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate & 0xFFFFFFFF, 0, 4, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_folders_are_listed_level_by_level(spark, tmp_path):
    for name in ("one/a/b/c/deep.txt", "one/a/x.txt", "one/y.txt", "z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("abc")
    (tmp_path / "one/a/empty.txt").touch()
    (tmp_path / "one/nothing").mkdir()
    got = {r.path.removeprefix(f"file:{tmp_path}/"): (r.file_size, r.reason) for r in list_files(spark, str(tmp_path)).collect()}
    assert got == {"one/a/b/c/deep.txt": (3, None), "one/a/x.txt": (3, None), "one/a/empty.txt": (0, None), "one/y.txt": (3, None), "z.txt": (3, None)}
    flat = list_files(spark, [str(tmp_path), str(tmp_path / "gone")], recursive=False).collect()
    assert {(r.path.rsplit("/", 1)[1], r.file_size) for r in flat} == {("z.txt", 3), ("gone", None)}


def test_a_folder_that_cannot_be_listed_is_a_row(spark):
    rows = list(opening._listing("nowhere://host/folder"))
    assert len(rows) == 1 and rows[0][1:3] == (None, False) and rows[0][3].startswith("UNLISTED")


def test_any_header_is_a_row(spark, tmp_path):
    (tmp_path / "good.wav").write_bytes(wav(44100))
    (tmp_path / "fast.wav").write_bytes(wav(0xFFFFFFFF))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    good, bad = scan_inventory(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.stream.sample_rate for r in good.collect()} == {"good.wav": 44100, "fast.wav": 0xFFFFFFFF}
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.wav"]


def test_a_value_that_does_not_fit_is_a_reason(spark):
    df = spark.createDataFrame([(1, b"a"), (2, b"b")], "n int, content binary")
    got = map_files(df, lambda row, f: {"v": 1 << 40 if row["n"] == 1 else 7}, "v int, reason string").collect()
    assert {r.n: (r.v, (r.reason or "")[:9]) for r in got} == {1: (None, "BAD_VALUE"), 2: (7, "")}


def test_contents_are_handed_on_by_bytes(spark, tmp_path, monkeypatch):
    data = bytes(range(256)) * 40
    (tmp_path / "f.bin").write_bytes(data)
    monkeypatch.setattr(opening, "FLUSH_BYTES", 1000)
    files = spark.createDataFrame([("s", str(tmp_path / "f.bin"), 0, len(data), False), ("s", "pad", len(data), 300, True)], "set_id string, path string, start long, length long, is_pad boolean")
    rows = read_chunks(files, 512).orderBy("start").collect()
    assert b"".join(bytes(r.content) if r.content is not None else b"" for r in rows) == data and sum(r.length for r in rows) == len(data) + 300


def test_pieces_are_hashed_in_slices(spark):
    rows = [("a", 0, 0, 2, b"ab", None, 1), ("a", 0, 2, 3, None, None, 2), ("a", 0, 5, 1, b"c", None, 3), ("a", 1, 0, 2, b"xy", None, 3), ("b", 0, 0, 1, b"q", None, 1), ("b", 0, 1, 1, None, "UNREADABLE", 2)]
    df = spark.createDataFrame(rows, "set_id string, piece long, piece_at long, bytes long, data binary, reason string, ordinal long")
    for algorithm in ("sha1", "md5"):
        got = {(r.set_id, r.piece, r.ordinal): r.digest for r in hashed_pieces(df, algorithm).collect()}
        assert got == {("a", 0, None): hashlib.new(algorithm, b"ab\0\0\0c").hexdigest(), ("a", 1, None): hashlib.new(algorithm, b"xy").hexdigest(), ("b", 0, 2): None}


def test_a_tree_has_one_root(spark):
    df = spark.range(3000).select(F.lit("s").alias("set_id"), F.col("id").alias("piece"), F.md5(F.col("id").cast("string")).alias("d"))
    assert tree_digest(df, ["set_id"], "piece", "d", fan_in=16).count() == 1
    one = tree_digest(df, ["set_id"], "piece", "d").first().tree_md5
    assert one != tree_digest(df.withColumn("d", F.when(F.col("piece") == 2999, F.md5(F.lit("x"))).otherwise(F.col("d"))), ["set_id"], "piece", "d").first().tree_md5


def test_lists_are_found_in_any_case(spark, tmp_path):
    for i, name in enumerate(["a.st5", "B.St5", "c.FFP", "d.mD5", "e.txt"]):
        digest = hashlib.md5(bytes([i])).hexdigest()
        (tmp_path / name).write_text(f"x.flac:{digest}\n" if name.lower().endswith("ffp") else f"{digest}  x.wav\n")
    good, bad = read_manifests(spark, str(tmp_path))
    assert sorted(r.list_path.rsplit("/", 1)[1] for r in good.collect()) == ["B.St5", "a.st5", "c.FFP", "d.mD5"] and bad.count() == 0


def test_a_report_replaces_its_own_run(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(3)], "n int")
    for _ in range(2):
        audit_report(df, str(tmp_path / "report"), "2024-05-01")
    audit_report(df.limit(1), str(tmp_path / "report"), "2024-05-02")
    audit_report(df.limit(2), str(tmp_path / "report"), "2024-05-01", "second")
    got = spark.read.parquet(str(tmp_path / "report")).groupBy("run_date", "run_id").count().collect()
    assert {(str(r.run_date), r.run_id): r["count"] for r in got} == {("2024-05-01", "audit"): 3, ("2024-05-02", "audit"): 1, ("2024-05-01", "second"): 2}


def test_twins_and_copies(spark):
    rows = [("d", "a.flac", "FLAC", "1"), ("d", "a.wav", "WAV", "1"), ("d", "b.flac", "FLAC", "2"), ("d", "b.fla", "FLAC", "3"), ("d", "b.wav", "WAV", "2"), ("d", "c.flac", "FLAC", None), ("d", "c.wav", "WAV", "4"), ("e", "a.wav", "WAV", "1")]
    df = spark.createDataFrame(rows, "dir string, file_name string, format string, audio_md5 string")
    assert {(r.dir, r.stem): r.twin for r in match_twins(df).collect()} == {("d", "a"): "LOSSLESS", ("d", "b"): "AMBIGUOUS", ("d", "c"): "UNCHECKED"}
    assert sorted((r.dir, r.file_name, r.copies) for r in duplicate_audio(df).collect()) == [("d", "a.flac", 3), ("d", "a.wav", 3), ("d", "b.flac", 2), ("d", "b.wav", 2), ("e", "a.wav", 3)]


def test_small_rules(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 0)], "set_id string, ordinal int")
    assert [tuple(r) for r in submission_order(df).collect()] == [("a", 0), ("a", 2), ("b", 1)]
    r = spark.range(1).select(bytes_per_frame(F.lit(2), F.lit(16)).alias("a"), bytes_per_frame(F.lit(1), F.lit(20)).alias("b")).first()
    assert (r.a, r.b) == (4, 3)


def test_a_folder_that_cannot_be_listed_is_among_the_refused_torrents(spark, tmp_path):
    (tmp_path / "good.torrent").write_bytes(b"d4:infod4:name1:xee")
    (tmp_path / "bad.torrent").write_bytes(b"junk")
    documents, refused = read_torrents(spark, [str(tmp_path), "nowhere://host/folder"])
    assert [r.set_id.rsplit("/", 1)[1] for r in documents.collect()] == ["good.torrent"]
    got = {r.set_id.rsplit("/", 1)[1]: r.reason for r in refused.collect()}
    assert got.keys() == {"bad.torrent", "folder"} and got["folder"].startswith("UNLISTED")
