import hashlib

from pyspark.sql import functions as F

from test_layout import bencode, content, hashes
from test_sources import flac, wav
from tapeledger.operators import audit as U
from tapeledger.sources import audio as A
from tapeledger.sources import torrents as T
from tapeledger.sources.opening import list_files


def md5(data):
    return hashlib.md5(data).hexdigest()


def test_lists_on_disk(spark, tmp_path):
    show = tmp_path / "vault" / "gd 77+%41"
    (show / "disc1").mkdir(parents=True)
    a, w = flac(), wav()
    (show / "a.flac").write_bytes(a)
    (show / "disc1" / "b.wav").write_bytes(w)
    (show / "none.flac").write_bytes(flac(md5=bytes(16)))
    (show / "x.md5").write_text(f"{md5(a)} *a.flac\n{md5(b'no')}  disc1/b.wav\n{md5(a)}  gone.flac\noops\n")
    (show / "x.ffp").write_text(f"a.flac:{bytes(range(16)).hex()}\nnone.flac:{md5(a)}\nx.md5:{md5(a)}\n")
    (show / "disc1" / "x.st5").write_text(f"{md5(w[44:])}  [shntool]  b.wav\n")
    checked, bad = U.check_lists(spark, str(tmp_path / "vault"))
    got = sorted((r.label, r.status, r.error) for r in checked.collect())
    assert got == [
        ("b.wav", "OK", None), ("x.ffp · a.flac", "OK", None), ("x.ffp · none.flac", "FAILED", "no audio MD5 in the header"),
        ("x.ffp · x.md5", "FAILED", "UNKNOWN_FORMAT"), ("x.md5 · a.flac", "OK", None), ("x.md5 · disc1/b.wav", "MISMATCH", None), ("x.md5 · gone.flac", "MISSING", None),
    ]
    assert [(r.line_no, r.kind) for r in bad.collect()] == [(4, "md5")]


def torrent(root, name, files, size=1 << 14):
    listed = [(content(n, n), False) for _, n in files]
    for (path, _), (data, _) in zip(files, listed):
        target = root / name / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    info = {
        "name": name, "piece length": size, "pieces": b"".join(bytes.fromhex(h) for h in hashes(listed, size)),
        "files": [{"length": n, "path": path.split("/")} for path, n in files],
    }
    return bencode({"info": info})


def test_torrents_on_disk(spark, tmp_path):
    root = tmp_path / "vault"
    plan = {
        "good": [("d/1", 40_000), ("2", 0), ("3", 20_000)], "bad": [("1", 50_000), ("2", 60_000)],
        "gone": [("1", 20_000), ("2", 20_000), ("3", 100_000)], "small": [("1", 100)],
    }
    docs = [(s, torrent(root, s, files, 1 << 10 if s == "small" else 1 << 14)) for s, files in plan.items()]
    data = bytearray((root / "bad" / "1").read_bytes())
    data[20_000] ^= 1
    (root / "bad" / "1").write_bytes(bytes(data))
    (root / "gone" / "2").unlink()
    (root / "good" / "info.txt").write_text("hello")
    documents, refused = T.decode_torrents(spark.createDataFrame(docs, "set_id string, content binary"))
    assert refused.count() == 0
    listing = list_files(spark, str(root))
    # Pointing at the folder above a set, and at the set itself, both work.
    given = documents.select("set_id", F.concat(F.lit(f"file:{root}"), F.when(F.col("set_id") == "bad", "/bad").otherwise("")).alias("given"))
    report = U.check_torrents(documents, given, listing)
    got = {(r.set_id, r.ordinal): r.status for r in report["files"].collect()}
    assert [got["good", i] for i in range(3)] == ["COMPLETE"] * 3
    assert [got["bad", i] for i in range(2)] == ["CORRUPT", "COMPLETE"]
    assert [got["gone", i] for i in range(3)] == ["PARTIAL", "MISSING", "PARTIAL"]
    assert {r.set_id: r.verdict for r in report["verdicts"].collect()} == {"good": "COMPLETE", "small": "COMPLETE", "bad": "INCOMPLETE", "gone": "INCOMPLETE"}
    assert [r.path.rsplit("/", 1)[1] for r in report["extras"].collect()] == ["info.txt"]
    assert [(r.set_id, r.piece, r.exclusive) for r in report["bad_pieces"].collect()] == [("bad", 1, True)]
    quick = U.check_torrents(documents, given, listing, quick=True)
    assert {r.set_id: r.verdict for r in quick["verdicts"].collect()} == {"good": "SIZES_MATCH", "small": "SIZES_MATCH", "bad": "SIZES_MATCH", "gone": "INCOMPLETE"}
    assert "_from" not in quick["files"]._jdf.queryExecution().executedPlan().toString()


def test_a_file_that_cannot_be_read(spark, tmp_path):
    root = tmp_path / "vault"
    doc = torrent(root, "s", [("1", 20_000), ("2", 20_000)])
    documents, _ = T.decode_torrents(spark.createDataFrame([("s", doc)], "set_id string, content binary"))
    listing = spark.createDataFrame([(f"file:{root}/s/1", 20_000), (f"file:{root}/s/2", 20_000)], "path string, file_size long")
    (root / "s" / "2").unlink()
    report = U.check_torrents(documents, spark.createDataFrame([("s", f"file:{root}")], "set_id string, given string"), listing)
    assert {r.ordinal: r.status for r in report["files"].collect()} == {0: "PARTIAL", 1: "UNREADABLE"}


def test_repair_plan_of_a_folder(spark, tmp_path):
    for i, frames in enumerate((5883, 11760)):
        (tmp_path / f"t{i}.flac").write_bytes(flac(frames=frames))
    inventory, _ = A.scan_inventory(spark, str(tmp_path))
    rows, summary = U.plan_repairs(inventory)
    assert [(r.new_frames, r.touched) for r in rows.orderBy("ordinal").collect()] == [(5880, True), (11763, True)]
    assert [(r.feasible, r.fully_fixed, r.boundaries_moved) for r in summary.collect()] == [(True, False, 1)]


def test_a_collection_with_a_bad_folder(spark, tmp_path, monkeypatch):
    # The audit lists the tree itself, once, and hands the listing on.
    calls, once = [], U.list_files
    monkeypatch.setattr(U, "list_files", lambda *a: calls.append(a) or once(*a))
    monkeypatch.delattr("tapeledger.sources.audio.list_files")
    monkeypatch.delattr("tapeledger.sources.torrents.list_files")
    good, bad = tmp_path / "vault" / "good", tmp_path / "vault" / "bad"
    good.mkdir(parents=True)
    bad.mkdir()
    a, w = flac(), wav()
    (good / "ow1986-07-19t01.flac").write_bytes(a)
    (good / "b.wav").write_bytes(w)
    (good / "x.md5").write_text(f"{md5(a)}  ow1986-07-19t01.flac\n{md5(b'no')}  b.wav\n")
    (bad / "broken.wav").write_bytes(b"RIFF")
    (bad / "x.md5").write_text("not a line\n")
    found, totals, made = U.audit_collection(spark, str(tmp_path / "vault"))
    got = {(r.section, r.path.rsplit("/", 1)[1], r.status) for r in found.collect()}
    assert got >= {
        ("LIST", "ow1986-07-19t01.flac", "OK"), ("LIST", "b.wav", "MISMATCH"), ("LIST_LINE", "x.md5", "BAD_LINE"), ("UNUSED", "broken.wav", "UNUSED"),
        ("NAME", "ow1986-07-19t01.flac", "NAMED"), ("NAME", "b.wav", "OTHER"),
    }
    assert any(r[:2] == ("REPAIR", "good") for r in got) and not any(r[:2] == ("REPAIR", "bad") for r in got)
    assert totals.agg(F.sum("findings")).first()[0] == found.count() and {r.output for r in made.collect()} == {r[0] for r in got}
    assert len(calls) == 1


def test_a_collection_with_torrents_and_tags(spark, tmp_path):
    root = tmp_path / "vault"
    for name, files in {"s": [("1", 20_000), ("2", 20_000)], "bad": [("1", 40_000)]}.items():
        doc = torrent(root, name, files)
        (root / f"{name}.torrent").write_bytes(doc)
    (root / "s" / "2").unlink()
    (root / "bad" / "1").write_bytes(b"x" * 40_000)
    (root / "junk.torrent").write_bytes(b"junk")
    (root / "zero.torrent").write_bytes(bencode({"info": {"name": "z", "piece length": 0, "pieces": b"", "length": 1}}))
    (root / "a.flac").write_bytes(flac())
    (root / "b.wav").write_bytes(wav())
    found, totals, made = U.audit_collection(spark, str(root))
    got = {(r.section, r.set_id.rsplit("/", 1)[1], r.path.rsplit("/", 1)[1], r.status) for r in found.collect()}
    assert got >= {
        ("TORRENT", "s.torrent", "2", "MISSING"), ("TORRENT", "s.torrent", "s.torrent", "INCOMPLETE"), ("TORRENT", "bad.torrent", "1", "CORRUPT"),
        ("TORRENT", "bad.torrent", "bad.torrent", "BAD_PIECE"), ("TORRENT", "junk.torrent", "junk.torrent", "REFUSED"),
        ("TORRENT", "zero.torrent", "zero.torrent", "REFUSED"), ("TAG", "vault", "a.flac", "CHANGE"), ("TAG", "vault", "b.wav", "NOT_TAGGABLE"),
    }
    assert totals.agg(F.sum("findings")).first()[0] == found.count() and {r.output for r in made.collect()} >= {"TORRENT", "TAG"}
