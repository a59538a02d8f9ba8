import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeledger.functions import names as N

TRACKS = {
    "fe2004-10-06d1t01.shn": ("fe", "2004-10-06", "LONG", 1, 1, None, "shn"),
    "ow1984-11-17d1t01overture.shn": ("ow", "1984-11-17", "LONG", 1, 1, "overture", "shn"),
    "ow86-07-19d1t01.flac": ("ow", "1986-07-19", "SHORT", 1, 1, None, "flac"),
    "nim1991-03-14d2t14.flac": ("nim", "1991-03-14", "LONG", 2, 14, None, "flac"),
    "k91994-06-30d1t05.flac": ("k9", "1994-06-30", "LONG", 1, 5, None, "flac"),
    "fe2004-10-06t07.flac": ("fe", "2004-10-06", "LONG", None, 7, None, "flac"),
    "ow30-07-19t100.flac": ("ow", "2030-07-19", "SHORT", None, 100, None, "flac"),
    "ow31-07-19t1.flac": ("ow", "1931-07-19", "SHORT", None, 1, None, "flac"),
    "tä-x1986-07-19t01.flac": ("tä-x", "1986-07-19", "LONG", None, 1, None, "flac"),
    "1986-07-19d1t01.flac": None,
    "ow1986-07-19.txt": None,
    "ow1986-13-08t01.flac": None,
    "ow1986-02-30t01.flac": None,
    "ow1986-7-9t01.flac": None,
    "ow1986-07-19t01": None,
    "ow1986-07-19t01.": None,
    "ow.x1986-07-19t01.flac": None,
    "ow1986-07-19dt01.flac": None,
    "ow1986-07-19t4294967296.flac": None,
    "ow1986-07-19t01.flac\n": None,
}


def test_track_names(spark):
    df = spark.createDataFrame([(n,) for n in TRACKS], "n string")
    p = F.col("p")
    fields = [p[c] for c in ("band", "date", "year_form", "disc", "track", "suffix", "ext")]
    got = df.select("n", N.parse_track_name(F.col("n")).alias("p")).withColumn("again", N.render_track_name(*fields))
    for r in got.collect():
        want = TRACKS[r.n]
        if want is None:
            assert r.p is None, r.n
        else:
            assert tuple(r.p) == (want[0], dt.date.fromisoformat(want[1]), *want[2:]), r.n
            # Rendering gives the name back, but for a track written with one digit.
            assert r.again == r.n.replace("t1.", "t01."), r.n


@pytest.mark.parametrize(
    "folder, want",
    [
        ("ow1992-09-05.sbd.halsey.31807.sbeok.shnf", (["sbd", "halsey", "31807", "sbeok"], "shnf")),
        ("fe2005-10-06.flac16", ([], "flac16")),
        ("fe2005-10-06", ([], None)),
        ("ow86-07-19.flac", (["flac"], None)),
        ("fe2005-10-06x.flac16", None),
        ("2005-10-06.flac16", None),
    ],
)
def test_folders(spark, folder, want):
    p = spark.createDataFrame([(folder,)], "f string").select(N.parse_show_folder(F.col("f")).alias("p")).first().p
    assert (p and (p.segments, p.format)) == want


def test_small_ones(spark):
    r = spark.range(1).select(
        N.sanitize(F.lit("a b&c/_-.é1")).alias("s"),
        N.slug(F.lit("Loud Legs 2!")).alias("g"),
        N.track_label(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(7)).alias("l1"),
        N.track_label(F.lit(1), F.lit(12), F.lit(7)).alias("l2"),
        N.info_file_name(F.lit("folder"), F.lit("ow86-07-19d1t01.flac")).alias("i1"),
        N.info_file_name(F.lit("folder"), F.lit("x.flac")).alias("i2"),
        N.info_file_name(F.lit("fe2005-10-06.flac16"), F.lit("x.flac")).alias("i3"),
        N.destination_name(F.lit("a/ow86-07-19.d1t01.flac"), "wav").alias("d"),
        N.default_output(F.lit("/x/show/")).alias("o"),
    ).first()
    assert tuple(r) == ("abc_-.1", "loudlegs2", "t07", "d1t12", "ow86-07-19.txt", "folder.txt", "fe2005-10-06.txt", "a/ow86-07-19.d1t01.wav", "/x/show.torrent")


HASH = "81e1447c2e9989a2ece5b94b4ccf2958"
LINES = [
    ("ffp", f"a:b.flac:{HASH}", ("a:b.flac", HASH, None)),
    ("ffp", f"﻿x.flac:{HASH.upper()}\r", ("x.flac", HASH, None)),
    ("ffp", "x.flac", (None, None, N.NO_COLON)),
    ("ffp", f":{HASH}", (None, None, N.NO_NAME)),
    ("md5", f"{HASH} *x y.flac", ("x y.flac", HASH, None)),
    ("md5", f"{HASH}  x y.flac", ("x y.flac", HASH, None)),
    ("md5", f"{HASH}\tx", ("x", HASH, None)),
    ("st5", f"{HASH}  [shntool]  [a] b.wav", ("[a] b.wav", HASH, None)),
    ("st5", f"{HASH}  [a] b.wav", ("[a] b.wav", HASH, None)),
    ("md5", HASH, (None, None, N.NO_SPACE)),
    ("md5", f"{HASH[:-1]}  x", (None, None, N.NOT_HEX)),
    ("md5", f"{HASH[:-2]}  x", (None, None, N.NOT_16)),
    ("md5", "nothex  x", (None, None, N.NOT_HEX)),
    ("md5", f"{HASH} *", (None, None, N.NO_NAME)),
]


def test_manifest_lines(spark):
    df = spark.createDataFrame([(i, k, text) for i, (k, text, _) in enumerate(LINES)], "i int, k string, t string")
    for r in df.select("i", N.manifest_line(F.col("k"), F.col("t")).alias("p")).collect():
        assert tuple(r.p)[1:] == LINES[r.i][2], LINES[r.i]
    skipped = spark.createDataFrame([("; x",), ("# x",), ("  ",), ("﻿",)], "t string")
    assert all(r.p.skip for r in skipped.select(N.manifest_line(F.lit("md5"), F.col("t")).alias("p")).collect())


def test_two_orders_differ_where_one_name_starts_another(spark):
    paths = ["d1/t01", "d1.txt", "a b", "Zed", "a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    by_stream = [r.p for r in df.orderBy(N.stream_order(F.col("p"))).collect()]
    by_folder = [r.p for r in df.orderBy(N.folder_order(F.col("p"))).collect()]
    assert by_stream == ["Zed", "a b", "a.txt", "d1.txt", "d1/t01"]
    assert by_folder == ["Zed", "a b", "a.txt", "d1/t01", "d1.txt"]
