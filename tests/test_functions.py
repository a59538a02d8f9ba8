from pyspark.sql import functions as F

from tapeledger.functions import clips as C
from tapeledger.functions import display as D
from tapeledger.functions import formats as M
from tapeledger.functions import tags as T


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def texts(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_formats(spark):
    names = ["a/b.FLAC", "x.fla", "x.wave", "x.ape", "x.wv", ".flac", "flac", "a.flac/b", "x.txt", "x."]
    assert texts(spark, M.classify_format, names) == ["FLAC", "FLAC", "WAV", "APE", "WavPack", None, None, None, None, None]
    assert texts(spark, lambda c: M.required_tool(M.classify_format(c)), ["x.shn", "x.tta"]) == ["shntool", "ttaenc"]


def test_sbe(spark):
    def check(frames, rate=44100, channels=2, bits=16):
        value = F.lit(frames).cast("long")
        return tuple(one(spark, M.sbe_check(value, F.lit(rate), F.lit(channels), F.lit(bits)))[0])

    assert check(5880) == ("ALIGNED", None, None)
    assert check(6017) == ("MISALIGNED", 137, None)
    assert check(0) == ("ALIGNED", None, None)
    assert check(5880, bits=24) == ("NOT_APPLICABLE", None, "NOT_CDDA")
    assert check(None) == ("NOT_APPLICABLE", None, "NO_LENGTH")


def test_noise_padding_and_paths(spark):
    names = [".DS_Store", "._x", "a.torrent", ".a.part", "a.part", ".ds_store", "x.flac"]
    assert texts(spark, M.is_noise, names) == [True, True, True, True, False, False, False]

    def path(*parts):
        return F.array(*[F.lit(p) for p in parts])

    cases = [("a", "b"), ("a", ".."), ("",), ("a/b",), ("a\\b",), ("a\0b",), ("con.txt",), ("lpt10",), ("console",)]
    want = [None, "DOT_COMPONENT", "EMPTY_COMPONENT", "SEPARATOR", "SEPARATOR", "NUL_BYTE", "RESERVED_DEVICE", None, None]
    assert list(one(spark, *[M.path_violation(path(*c)) for c in cases])) == want
    none = F.lit(None).cast("string")
    assert one(
        spark, M.is_padding(path("a"), F.lit("xp")), M.is_padding(path(".pad", "1"), none),
        M.is_padding(path("a", "_____padding_file_0"), none), M.is_padding(path("a", ".pad"), none),
    ) == (True, True, True, False)


def test_piece_length(spark):
    mib = 1 << 20
    sizes = [1, 2000 << 14, (2000 << 14) + 1, 700 * mib, 1 << 50]
    got = one(spark, *[M.auto_piece_length(F.lit(n)) for n in sizes])
    assert got == (1 << 14, 1 << 14, 1 << 15, 1 << 19, 1 << 24)
    assert one(spark, *[M.check_piece_length(F.lit(n)) for n in (1 << 14, 1 << 24, 1 << 13, 1 << 25, 20000)]) == (
        None, None, "PIECE_LENGTH", "PIECE_LENGTH", "PIECE_LENGTH",
    )
    assert one(spark, *[M.piece_count(F.lit(n), F.lit(128)) for n in (0, 1, 128, 129)]) == (0, 1, 1, 2)


def test_verification_and_conversion(spark):
    null, a, b = F.lit(None).cast("string"), F.lit("a"), F.lit("b")
    assert one(
        spark, M.verify_outcome(a, a, null), M.verify_outcome(a, b, null), M.verify_outcome(null, b, null), M.verify_outcome(a, a, F.lit("x"))
    ) == ("OK", "MISMATCH", "NO_MD5", "FAILED")

    def rule(fmt, bits, stored, computed):
        return tuple(one(spark, M.conversion_checked(F.lit(fmt), F.lit(bits), stored, computed))[0])

    assert rule("WAV", 16, a, a) == (True, "CONVERTED", True)
    assert rule("WAV", 8, a, b) == (False, "CONVERTED", False)
    assert rule("WAV", 16, a, b) == (True, "REFUSED", False)
    assert rule("WAV", 16, null, b) == (False, "REFUSED", False)
    assert rule("FLAC", 16, null, b) == (False, "CONVERTED", False)


def test_times_and_sizes(spark):
    times = ["90", "1:30", "1:02:03", "1:30.5", " 5 ", "", "1:60", "1:99:00", "1:2:3:4", "x", "-1", "1e400"]
    assert texts(spark, D.parse_time, times) == [90.0, 90.0, 3723.0, 90.5, 5.0] + [None] * 7
    sizes = ["1M", "900K", "1MiB", "1000000", "1.5 mb", "0", "x", "5 parsecs", "1.2.3"]
    assert texts(spark, D.parse_size, sizes) == [1_000_000, 900_000, 1 << 20, 1_000_000, 1_500_000, None, None, None, None]
    assert one(spark, D.format_time(F.lit(59.9)), D.format_time(F.lit(3723.0))) == ("0:59", "1:02:03")
    assert one(spark, D.duration_precise(F.lit(59.9996)), D.duration_short(F.lit(59.5)), D.duration_short(F.lit(6000.0))) == ("1:00.000", "1:00", "100:00")
    assert one(spark, D.bytes_text(F.lit(1280)), D.bytes_text(F.lit(1792)), D.bytes_text(F.lit(1023)), D.bytes_text(F.lit(1 << 20))) == (
        "1.2 KiB", "1.8 KiB", "1023 B", "1.0 MiB",
    )
    assert one(spark, D.format_size(F.lit(942_001)), D.format_size(F.lit(10_050_000))) == ("943 KB", "10.1 MB")
    assert one(spark, D.epoch_text(F.lit(0)), D.epoch_text(F.lit(-1)), D.epoch_text(F.lit(951_782_400))) == (
        "1970-01-01 00:00:00 UTC", "1969-12-31 23:59:59 UTC", "2000-02-29 00:00:00 UTC",
    )
    assert one(spark, D.pieces_phrase(F.array(F.lit(3))), D.pieces_phrase(F.array(F.lit(3), F.lit(5)))) == ("piece 3", "pieces 3, 5")
    assert one(spark, D.format_limit(F.lit(1_000_000)), D.format_limit(F.lit(900_000)), D.format_limit(F.lit(17))) == ("1M", "900K", "17")


def test_modes(spark):
    df = spark.createDataFrame([(m,) for m in ("320", "256kbps", "V0", "v9", "v10", "33", "x")], "m string")
    got = [r.p and tuple(r.p) for r in df.select(C.parse_mode(F.col("m")).alias("p")).collect()]
    assert got == [("CBR", 320, 320), ("CBR", 256, 256), ("VBR", 0, 245), ("VBR", 9, 65), None, None, None]
    # Thirty seconds at 256 kbps fit one megabyte, at 320 kbps only twenty-four do.
    assert one(spark, *[C.longest_fitting(F.lit(k), F.lit(1_000_000)) for k in (256, 320)]) == (31.0, 24.0)
    assert one(spark, C.estimate_bytes(F.lit(256), F.lit(30.0))) == (966_144,)


def test_tag_functions(spark):
    def tiers(announce, lists):
        return one(spark, T.announce_tiers(F.lit(announce), lists))[0]

    def nested(*ts):
        return F.array(*[F.array(*[F.lit(u) for u in t]) for t in ts])

    none = F.lit(None).cast("array<array<string>>")
    assert tiers("a", none) == [["a"]]
    assert tiers("", none) == []
    assert tiers("a", nested(["b", "a", "b"], [""])) == [["b", "a"]]
    assert tiers("x", nested(["b"], ["c"])) == [["x"], ["b"], ["c"]]
    numbers = ["01", "+7", "1/17", "", "4294967295", "4294967296", "-1"]
    assert texts(spark, T.track_number, numbers) == [1, 7, None, None, 4294967295, None, None]
    keyed = "http://t/{passkey}/announce"
    null = F.lit(None).cast("string")
    assert one(spark, T.fill_passkey(F.lit(keyed), F.lit("k")), T.fill_passkey(F.lit(keyed), null), T.fill_passkey(F.lit("http://t"), null)) == (
        "http://t/k/announce", None, "http://t",
    )
    old = F.create_map(F.lit("TITLE"), F.array(F.lit("a"), F.lit("b")), F.lit("OTHER"), F.array(F.lit("kept")))
    edit = F.create_map(F.lit("TITLE"), F.lit(""), F.lit("GENRE"), F.lit("rock"))
    assert one(spark, T.additive_merge(old, edit)) == ({"OTHER": ["kept"], "GENRE": ["rock"]},)
