import hashlib
import random

from tapeledger.operators import manifests as M
from tapeledger.sources import text as X

H = hashlib.md5(b"x").hexdigest()
G = hashlib.md5(b"y").hexdigest()


def test_reading_lists(spark, tmp_path):
    show = tmp_path / "show"
    show.mkdir()
    (show / "a.ffp").write_bytes(f"﻿; made by hand\r\nt1.flac:{H}\r\n\r\nbroken line\r\nt2:x.flac:{G}\r\n".encode())
    (show / "a.md5").write_text(f"# c\n{H} *t1.flac\nzz  t2.flac\n")
    (show / "a.txt").write_text("not a list\n")
    good, bad = X.read_manifests(spark, str(show))
    got = sorted((r.kind, r.line_no, r.file_name, r.digest, r.dir.endswith("/show")) for r in good.collect())
    assert got == [("ffp", 2, "t1.flac", H, True), ("ffp", 5, "t2:x.flac", G, True), ("md5", 2, "t1.flac", H, True)]
    assert sorted((r.kind, r.line_no) for r in bad.collect()) == [("ffp", 4), ("md5", 3)]
    assert {(r.list_path[-3:], r.list_ok) for r in M.list_status(good, bad).collect()} == {("ffp", False), ("md5", False)}


def test_line_numbers_survive_splits(spark, tmp_path):
    lines = [f"line {i}" for i in range(20_000)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = X.read_lines(spark, str(tmp_path / "long.txt"))
        assert [r.line for r in read.orderBy("line_no").collect()] == lines
        assert read.selectExpr("min(line_no)", "max(line_no)").first() == (1, 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_titles(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"one\r\ntwo\rthree\n\nfive\n")
    got = [r.title for r in X.read_titles(spark, str(tmp_path)).orderBy("title_no").collect()]
    assert got == ["one", "two", "three", "", "five"]
    df = spark.createDataFrame([("one\r\ntwo\rthree\n\nfive\n",), ("",), ("a",), ("\n",)], "t string")
    assert [r.s for r in df.select(X.split_titles(df.t).alias("s")).collect()] == [got, [], ["a"], [""]]


def test_tracker_lists_and_passkeys(spark, tmp_path):
    (tmp_path / "my.lst").write_bytes(
        b"# mine\r\nLoud Legs|http://l/announce\r\nOther|http://o/{passkey}|private|source=TAG|id=oth\r\nno bar\r\n|http://x\r\nName|\r\n"
        b"Third|http://t|odd=1\r\nloud-legs|http://again\r\n!!|http://n\r\n"
    )
    kept, refused = X.read_tracker_lists(spark, str(tmp_path / "my.lst"))
    got = sorted((r.id, r.announce, r.private, r.source) for r in kept.collect())
    assert got == [("loudlegs", "http://l/announce", False, None), ("oth", "http://o/{passkey}", True, "TAG")]
    assert sorted((r.line_no, r.detail) for r in refused.collect()) == [
        (4, "NO_BAR"), (5, "NO_NAME"), (6, "NO_URL"), (7, "UNKNOWN_FIELD"), (8, "DUPLICATE_ID"), (9, "NO_ID"),
    ]
    (tmp_path / "keys.lst").write_text("# k\n a | one\nb|x|y\na|two\nbad\n")
    keys, bad = X.read_passkeys(spark, str(tmp_path / "keys.lst"))
    assert sorted((r.id, r.passkey) for r in keys.collect()) == [("a", "two"), ("b", "x|y")]
    assert [r.line_no for r in bad.collect()] == [5]


MANIFEST = "dir string, list_path string, kind string, line_no long, file_name string, digest string"
DIGESTS = "dir string, file_name string, kind string, digest string, error string"


def test_check(spark):
    manifest = spark.createDataFrame(
        [("d", "d/a.md5", "md5", 1, "ok", H), ("d", "d/a.md5", "md5", 2, "bad", H), ("d", "d/a.md5", "md5", 3, "gone", H), ("d", "d/a.ffp", "ffp", 1, "err", H), ("e", "e/x.md5", "md5", 1, "ok", H)],
        MANIFEST,
    )
    digests = spark.createDataFrame(
        [("d", "ok", "md5", H, None), ("d", "bad", "md5", G, None), ("d", "err", "ffp", None, "no audio MD5"), ("d", "extra", "md5", G, None), ("e", "ok", "md5", H, None)], DIGESTS
    )
    got = {(r.dir, r.file_name): (r.status, r.expected, r.actual, r.error) for r in M.check_manifest(manifest, digests).collect()}
    assert got == {
        ("d", "ok"): ("OK", None, None, None), ("d", "bad"): ("MISMATCH", H, G, None), ("d", "gone"): ("MISSING", None, None, None),
        ("d", "err"): ("FAILED", None, None, "no audio MD5"), ("e", "ok"): ("OK", None, None, None),
    }
    checked = M.check_all_lists(manifest, digests)
    assert {r.label for r in checked.collect()} == {"a.md5 · ok", "a.md5 · bad", "a.md5 · gone", "a.ffp · err", "ok"}
    tally = {r.dir: (r.ok, r.missing, r.mismatch, r.failed, r.done, r.clean) for r in M.outcome_tally(checked, ["dir"], ["OK", "MISSING", "MISMATCH", "FAILED"], ["MISSING", "MISMATCH", "FAILED"]).collect()}
    assert tally == {"d": (1, 1, 1, 1, 4, False), "e": (1, 0, 0, 0, 1, True)}


def test_rendering_and_completeness(spark, any_split):
    data = [("a", i, f"t{i}", H) for i in range(9)] + [("b", 0, "x", H), ("b", 1, "y", None)]
    df = spark.createDataFrame(data, "set_id string, ordinal long, file_name string, digest string")
    assert {r.set_id for r in M.complete_only(df).collect()} == {"a"}
    whole = M.render_manifests(df, "ffp").collect()
    assert [(r.set_id, r.text) for r in whole] == [("a", "".join(f"t{i}:{H}\n" for i in range(9)))]
    partial = {r.set_id: r.text for r in M.render_manifests(df, "st5", "partial").collect()}
    assert partial["b"] == f"{H}  [shntool]  x\n"
    # What is written can be read back.
    lines = spark.createDataFrame([("b/b.st5", 1, partial["b"])], "list_path string, line_no long, line string")
    assert [(r.file_name, r.digest) for r in M.parse_manifests(lines)[0].collect()] == [("x", H)]


def test_twins(spark):
    df = spark.createDataFrame(
        [("d", "a.flac", "FLAC", H), ("d", "a.wav", "WAV", H), ("d", "b.flac", "FLAC", H), ("d", "b.wav", "WAV", G), ("d", "c.flac", "FLAC", None), ("d", "c.wav", "WAV", G), ("e", "a.wav", "WAV", H)],
        "dir string, file_name string, format string, audio_md5 string",
    )
    assert sorted((r.stem, r.twin) for r in M.match_twins(df).collect()) == [("a", "LOSSLESS"), ("b", "DIFFERS"), ("c", "UNCHECKED")]


def test_changes_between_snapshots(spark, any_split):
    rnd = random.Random(2)
    before = {f"p{i}": (rnd.choice("abc"), rnd.choice("xy")) for i in range(40)}
    after = {}
    for p, (f, a) in before.items():
        what = rnd.randrange(5)
        if what == 1:
            after["m" + p] = (f, a)
        elif what == 2:
            after[p] = (f + "2", a)
        elif what == 3:
            after[p] = (f + "3", a + "3")
        elif what == 0:
            after[p] = (f, a)
    after["new"] = ("zz", "zz")
    schema = "path string, file_md5 string, audio_md5 string"
    frames = [spark.createDataFrame([(p, f, a) for p, (f, a) in s.items()], schema) for s in (before, after)]
    got = sorted(((r.path, r.new_path, r.change) for r in M.classify_change(*frames).collect()), key=str)
    want = []
    for p in before.keys() & after.keys():
        (bf, ba), (af, aa) = before[p], after[p]
        want.append((p, p, "UNCHANGED" if bf == af else "RETAGGED" if ba == aa else "AUDIO_CHANGED"))
    for f in {v[0] for v in before.values()} | {v[0] for v in after.values()}:
        gone = sorted(p for p in before if p not in after and before[p][0] == f)
        come = sorted(p for p in after if p not in before and after[p][0] == f)
        for i in range(max(len(gone), len(come))):
            g, c = gone[i] if i < len(gone) else None, come[i] if i < len(come) else None
            want.append((g, c, "MOVED" if g and c else "REMOVED" if g else "ADDED"))
    assert got == sorted(want, key=str)
