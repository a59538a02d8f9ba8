import datetime as dt

from pyspark.sql import functions as F

from tapeledger.functions.tags import TAG_FIELDS
from tapeledger.operators import clips as K
from tapeledger.operators import rename as R
from tapeledger.operators import setlist as L
from tapeledger.operators import tags as G

SCHEMA = "set_id string, ordinal long, " + ", ".join(f"{f} string" for f in TAG_FIELDS)


def tag_table(spark, rows):
    return spark.createDataFrame([(s, i, *[t.get(f) for f in TAG_FIELDS]) for s, i, t in rows], SCHEMA)


def test_changes_and_edits(spark):
    before = tag_table(spark, [("s", 0, {"title": "a", "artist": "x"}), ("s", 1, {})])
    edit = tag_table(spark, [("s", 0, {"title": "a", "artist": "", "date": "1986"}), ("s", 1, {"genre": ""})])
    got = [tuple(r) for r in G.tag_changes(before, edit).orderBy("ordinal", "field_no").collect()]
    assert [(g[1], *g[3:]) for g in got] == [(0, "ARTIST", "x", ""), (0, "DATE", None, "1986"), (1, "GENRE", None, "")]
    after = G.apply_edits(before, edit).orderBy("ordinal").collect()
    assert (after[0].title, after[0].artist, after[0].date, after[1].genre) == ("a", None, "1986", None)


def test_show_values(spark, any_split):
    rows = [("s", 0, {"artist": ""}), ("s", 1, {"artist": "b"}), ("s", 2, {"artist": "a", "album": "x"}), ("s", 3, {"artist": "b"}), ("e", 0, {})]
    rows += [("s", i, {"comment": f"c{i % 7}"}) for i in range(4, 20)]
    tags = tag_table(spark, rows)
    got = {(r.set_id, r.field): (r.value, r.distinct_values) for r in G.show_values(tags).collect()}
    assert got == {("s", "ARTIST"): ("b", 2), ("s", "ALBUM"): ("x", 1), ("s", "COMMENT"): ("c4", 7)}
    listed = {}
    for r in G.show_disagreements(tags).orderBy("value_no").collect():
        listed.setdefault(r.field, []).append(r.value)
    assert listed == {"ARTIST": ["b", "a"], "COMMENT": ["c4", "c5", "c6", "c0", "c1", "c2", "c3"]}
    folders = spark.createDataFrame([("s", "ow86-07-19.flac16"), ("e", "ow1992-09-05")], "set_id string, folder string")
    seeded = {r.set_id: r for r in G.seed_show(tags, folders).collect()}
    assert (seeded["s"].artist, seeded["s"].album, seeded["s"].date) == ("", None, "1986-07-19")
    assert (seeded["e"].artist, seeded["e"].date) == (None, "1992-09-05")


def test_positions_skip_other_formats(spark, any_split):
    formats = ["FLAC", "WAV", "FLAC", "FLAC", "APE", "FLAC", "FLAC"]
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate(formats)], "set_id string, ordinal long, format string")
    got = [(r.ordinal, r.track_number, r.track_total) for r in G.track_position(df).orderBy("ordinal").collect()]
    assert got == [(0, 1, 5), (2, 2, 5), (3, 3, 5), (5, 4, 5), (6, 5, 5)]


def test_titles(spark):
    tracks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "set_id string, track_number long")
    titles = spark.createDataFrame([("a", 1, ""), ("b", 1, "x"), ("b", 2, "y")], "set_id string, title_no long, title string")
    got = {(r.set_id, r.track_number): (r.title, r.refused) for r in G.align_titles(tracks, titles).collect()}
    assert got == {("a", 1): (None, None), ("a", 2): (None, None), ("b", 1): (None, "TITLE_COUNT")}
    assert {r.refused for r in G.align_titles(tracks, titles, strict=True).collect()} == {"TITLE_COUNT"}


def setlist(spark, tracks):
    schema = "set_id string, ordinal long, track_number long, file_name string, title string, frames long, sample_rate int, is_cdda boolean"
    data = [("s", i, i + 1, name, title, frames, 44100, cdda) for i, (name, title, frames, cdda) in enumerate(tracks)]
    return L.disc_runs(L.label_tracks(spark.createDataFrame(data, schema)))


CD = 44100
TRACKS = [
    ("ow86-07-19d1t01.flac", "Long Title", 60 * CD, True),
    ("ow86-07-19d1t02.flac", None, 4800 * CD, True),
    ("x.flac", "", None, True),
    ("ow86-07-19d1t03.flac", "b", 6000 * CD, False),
]


def test_setlist_text(spark, any_split):
    runs = setlist(spark, TRACKS)
    show = spark.createDataFrame([("s", "Band", "1986-07-19", None, "Town", "sbd")], "set_id string, artist string, date string, album string, location string, comment string")
    text = "".join(r.text for r in L.render_setlists(runs, show, signature="by hand").orderBy("part").collect())
    assert text == "\r\n".join(
        ["Band", "1986-07-19", "Town", "", "Source: sbd", "", "Disc 1 [81:00]", "d1t01  Long Title   1:00", "d1t02  (no title)  80:00", "",
         "Other [0:00]", "t03  (no title)   ?:??", "", "Disc 1 [100:00]", "d1t03  b           100:00", "", "Total: 181:00", "", "by hand", ""]
    )
    totals = [(r.disc, r.tracks, r.too_long) for r in L.disc_totals(runs).orderBy("run_no").collect()]
    assert totals == [(1, 2, True), (None, 1, False), (1, 1, False)]


def test_short_tracks_add_up_before_rounding(spark):
    runs = setlist(spark, [(f"ow86-07-19t0{i}.flac", "x", int(0.4 * CD), True) for i in range(3)])
    show = spark.createDataFrame([("s", None, None, None, None, None)], "set_id string, artist string, date string, album string, location string, comment string")
    lines = [r.line for r in L.setlist_lines(runs, show).orderBy("line_no").collect()]
    assert lines == ["", "Source: ", "", "t00  x   0:00", "t01  x   0:00", "t02  x   0:00", "", "Total: 0:01"]


def test_setlist_problems(spark):
    runs = setlist(spark, TRACKS)
    inventory = spark.createDataFrame([("s", "x.wav", "WAV"), ("s", "x.flac", "FLAC")], "set_id string, file_name string, format string")
    tags = tag_table(spark, [("s", 0, {"artist": "a"}), ("s", 1, {"artist": "b"})])
    plan = spark.createDataFrame([("s", "d", "ow86-07-19.txt")], "set_id string, dir string, info_file string")
    texts = spark.createDataFrame([("d", "ow86-07-19.txt"), ("d", "old.TXT"), ("d", "a.md5"), ("e", "x.txt")], "dir string, file_name string")
    got = sorted(tuple(r)[1:] for r in L.setlist_problems(inventory, runs, tags, runs, L.other_text_files(plan, texts)).collect())
    assert got == [
        ("DISAGREES", "ARTIST"), ("MISSING_TITLE", "ow86-07-19d1t02.flac"), ("MISSING_TITLE", "x.flac"), ("NOT_FLAC", "x.wav"),
        ("NO_LENGTH", "x.flac"), ("OTHER_TEXT", "old.TXT"), ("TOO_LONG", "disc 1"),
    ]


def test_rename(spark, any_split):
    files = [("s", i, f"d/{n}") for i, n in enumerate(["a.flac", "ow1984-11-17d1t01overture.SHN", "noext", "ow1986-07-19d2t04.flac", "e.flac", "f.flac"])]
    df = spark.createDataFrame(files, "set_id string, ordinal long, path string")
    fields = spark.createDataFrame(
        [("s", "ow1986-07-19.x", None, None, " 2 ", False), ("n", "folder", None, "1986-07-19", "", False), ("d", "folder", "ow", "1986-02-30", "", None), ("x", "ow86-07-19", "", None, "two", True)],
        "set_id string, folder string, band string, date string, disc string, short_year boolean",
    )
    spec = R.name_spec(fields)
    got = {r.set_id: (r.band, r.date, r.disc, r.error) for r in spec.collect()}
    assert got["s"] == ("ow", dt.date(1986, 7, 19), 2, None)
    assert (got["n"][3], got["d"][3], got["x"][3]) == ("NO_BAND", "BAD_DATE", "NO_BAND")
    plan = R.rename_collisions(R.rename_target(df, spec))
    by_ordinal = {r.ordinal: (r.to_path, r.status) for r in plan.collect()}
    assert by_ordinal[0] == ("d/ow1986-07-19d2t01.flac", "CHANGED")
    assert by_ordinal[1] == ("d/ow1986-07-19d2t02overture.SHN", "CHANGED")
    assert by_ordinal[2][0] == "d/ow1986-07-19d2t03."
    assert by_ordinal[3] == ("d/ow1986-07-19d2t04.flac", "UNCHANGED")
    disk = spark.createDataFrame([("d/ow1986-07-19d2t01.flac",), ("d/ow1986-07-19d2t04.flac",)], "path string")
    conflicts = R.rename_conflicts(plan, disk)
    assert [r.to_path for r in conflicts.collect()] == ["d/ow1986-07-19d2t01.flac"]
    assert [(r.changed, r.refused) for r in R.rename_verdict(plan, conflicts).collect()] == [(5, "TARGET_EXISTS")]


def test_collisions(spark):
    plan = spark.createDataFrame([("s", 0, "a", "x"), ("s", 1, "b", "x"), ("s", 2, "c", "c"), ("t", 0, "a", "x")], "set_id string, ordinal long, from_path string, to_path string")
    got = sorted((r.set_id, r.ordinal, r.status) for r in R.rename_collisions(plan).collect())
    assert got == [("s", 0, "COLLISION"), ("s", 1, "COLLISION"), ("s", 2, "UNCHANGED"), ("t", 0, "CHANGED")]


def test_clips(spark):
    df = spark.createDataFrame(
        [(0, 100 * CD, None, None), (1, None, None, None), (2, 100 * CD, 99.0, 30.0), (3, 100 * CD, 100.0, 5.0), (4, 100 * CD, None, 10.0), (5, 10 * CD + 22050, None, None), (6, 100 * CD, -1.0, 5.0), (7, 100 * CD, 0.0, 60.0)],
        "n int, frames long, start double, length double",
    ).withColumn("sample_rate", F.lit(44100))
    got = {(r.n, r.mode): r for r in K.clip_plan(df, ["256", "320", "v0"], 1_000_000).collect()}
    assert (got[0, "256"].start, got[0, "256"].length, got[0, "320"].length) == (35.0, 30.0, 24.0)
    assert (got[1, "256"].start, got[1, "256"].length, got[1, "256"].to_frame) == (0.0, 30.0, 30 * CD)
    assert (got[2, "256"].from_frame, got[2, "256"].to_frame) == (99 * CD, 100 * CD)
    assert got[3, "256"].refused == "START_PAST_END"
    assert (got[4, "256"].start, got[4, "256"].length) == (45.0, 10.0)
    assert (got[5, "256"].start, got[5, "256"].length) == (0.0, 10.0)
    assert got[6, "256"].refused == "BAD_CLIP"
    assert (got[7, "256"].refused, got[7, "v0"].refused) == ("TOO_LARGE", None)
