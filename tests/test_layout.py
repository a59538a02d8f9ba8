import hashlib
import random

from pyspark.sql import functions as F

from tapeledger.operators import layout as L
from tapeledger.operators import quality as Q
from tapeledger.sources import torrents as T

FILES = "set_id string, ordinal long, length long, is_pad boolean, content binary"


def build(spark, sets):
    data = [(s, i, len(c), pad, c) for s, files in sets.items() for i, (c, pad) in enumerate(files)]
    return L.file_spans(spark.createDataFrame(data, FILES))


def hashes(files, size):
    stream = b"".join(bytes(len(c)) if pad else c for c, pad in files)
    return [hashlib.sha1(stream[i : i + size]).hexdigest() for i in range(0, len(stream), size)]


def judge(spark, sets, statuses, damaged, size=128):
    """Statuses per set and file, from the operators."""
    laid = build(spark, sets)
    size_status = spark.createDataFrame([(s, i, st) for s, sts in statuses.items() for i, st in enumerate(sts)], "set_id string, ordinal long, status string")
    checked = laid.join(size_status, ["set_id", "ordinal"])
    segments = L.piece_segments(checked.drop("content"), F.lit(size))
    expected = L.piece_digests(L.piece_slices(laid, size))
    actual = L.piece_digests(L.piece_slices(build(spark, damaged), size))
    outcomes = L.piece_outcomes(segments, expected, actual)
    found = {(r.set_id, r.ordinal): r for r in L.attribute_failures(segments, outcomes, checked).collect()}
    counts = {r.set_id: (r.total, r.ok, r.failed, r.unverifiable) for r in L.piece_counts(outcomes).collect()}
    bad = [tuple(r) for r in L.bad_pieces(segments, outcomes).collect()]
    return found, counts, bad


def flip(files, at):
    """One byte of the stream changed."""
    out, begin = [], 0
    for c, pad in files:
        if begin <= at < begin + len(c):
            c = c[: at - begin] + bytes([c[at - begin] ^ 1]) + c[at - begin + 1 :]
        out.append((c, pad))
        begin += len(c)
    return out


def content(n, seed):
    return random.Random(seed).randbytes(n)


MULTI = [(content(100, 1), False), (content(250, 2), False), (content(150, 3), False)]


def test_blame(spark):
    sets = {"exclusive": MULTI, "shared": MULTI, "missing": MULTI, "cut": MULTI, "good": MULTI}
    ok = ["SIZE_OK"] * 3
    statuses = {"exclusive": ok, "shared": ok, "good": ok, "missing": ["SIZE_OK", "SIZE_OK", "MISSING"], "cut": ["SIZE_OK", "WRONG_SIZE", "SIZE_OK"]}
    damaged = dict(sets, exclusive=flip(MULTI, 130), shared=flip(MULTI, 10))
    found, counts, bad = judge(spark, sets, statuses, damaged)

    def status(s):
        return [found[s, i].status for i in range(3)]

    assert status("good") == ["COMPLETE"] * 3
    assert status("exclusive") == ["COMPLETE", "CORRUPT", "COMPLETE"]
    assert (found["exclusive", 1].bad_pieces, found["exclusive", 1].first_bad_piece) == (1, 1)
    assert status("shared") == ["SUSPECT", "SUSPECT", "COMPLETE"]
    assert (found["shared", 0].suspect_piece, found["shared", 0].shared_with) == (0, 1)
    assert status("missing") == ["COMPLETE", "PARTIAL", "MISSING"]
    assert (found["missing", 1].verified, found["missing", 1].unverifiable) == (2, 1)
    assert counts["missing"] == (4, 2, 0, 2)
    assert status("cut") == ["PARTIAL", "WRONG_SIZE", "PARTIAL"]
    assert sorted(bad) == [("exclusive", 1, 1, True), ("shared", 0, 0, False), ("shared", 0, 1, False)]


def test_padding_is_zeros_and_never_shares_blame(spark):
    files = [(content(100, 4), False), (b"x" * 28, True), (content(256, 5), False)]
    found, counts, _ = judge(spark, {"p": files}, {"p": ["SIZE_OK", "PADDING", "SIZE_OK"]}, {"p": flip(files, 3)})
    assert counts["p"] == (3, 2, 1, 0)
    assert [found["p", i].status for i in range(3)] == ["CORRUPT", "PADDING", "COMPLETE"]


def test_an_empty_file_inside_a_bad_piece_is_complete(spark):
    # A walk that compares spans with strict bounds would draw the empty file into the piece
    # it stands in and call it SUSPECT; it holds no byte of it and is complete when present.
    files = [(content(50, 6), False), (b"", False), (content(70, 7), False)]
    found, _, _ = judge(spark, {"e": files}, {"e": ["SIZE_OK"] * 3}, {"e": flip(files, 3)})
    assert [found["e", i].status for i in range(3)] == ["SUSPECT", "COMPLETE", "SUSPECT"]
    assert found["e", 0].shared_with == 1


def naive(files, statuses, outcomes, size):
    spans, at = [], 0
    for c, _ in files:
        spans.append((at, at + len(c)))
        at += len(c)
    out = []
    for i, (c, pad) in enumerate(files):
        if statuses[i] != "SIZE_OK":
            out.append(statuses[i])
            continue
        alone, shared, unv = 0, 0, 0
        for p, o in enumerate(outcomes):
            a, b = p * size, min((p + 1) * size, at)
            if not c or a >= spans[i][1] or b <= spans[i][0]:
                continue
            others = [j for j, (s, e) in enumerate(spans) if j != i and s < b and e > a and e > s and not files[j][1]]
            alone += o == "FAILED" and not others
            shared += o == "FAILED" and bool(others)
            unv += o == "UNVERIFIABLE"
        out.append("CORRUPT" if alone else "SUSPECT" if shared else "PARTIAL" if unv else "COMPLETE")
    return out


def test_random_sets_match_the_plain_rules(spark, any_split):
    rnd = random.Random(11)
    sets, statuses, damaged = {}, {}, {}
    for n in range(12):
        files = [(content(rnd.choice([0, 3, rnd.randrange(400)]), rnd.random()), rnd.random() < 0.1) for _ in range(rnd.randint(2, 12))]
        total = sum(len(c) for c, _ in files)
        sets[f"s{n}"] = files
        statuses[f"s{n}"] = ["PADDING" if pad else rnd.choice(["SIZE_OK"] * 6 + ["MISSING", "WRONG_SIZE"]) for _, pad in files]
        bad = files
        for _ in range(rnd.randint(0, 3)):
            bad = flip(bad, rnd.randrange(total)) if total else bad
        damaged[f"s{n}"] = bad
    found, _, _ = judge(spark, sets, statuses, damaged, size=64)
    for s, files in sets.items():
        good, now = hashes(files, 64), hashes(damaged[s], 64)
        spans, at = [], 0
        for c, _ in files:
            spans.append((at, at + len(c)))
            at += len(c)
        outcomes = []
        for p, (g, h) in enumerate(zip(good, now)):
            touched = [i for i, (a, b) in enumerate(spans) if a < min((p + 1) * 64, at) and b > p * 64 and b > a]
            usable = all(statuses[s][i] in ("SIZE_OK", "PADDING") for i in touched)
            outcomes.append("UNVERIFIABLE" if not usable else "OK" if g == h else "FAILED")
        assert [found[s, i].status for i in range(len(files))] == naive(files, statuses[s], outcomes, 64), s


def test_chunks_and_whole_files_hash_alike(spark):
    whole = build(spark, {"m": MULTI})
    pieces = [r.sha1 for r in L.piece_digests(L.piece_slices(whole, 128)).orderBy("piece").collect()]
    assert pieces == hashes(MULTI, 128)
    chunks = whole.select(
        "set_id", "is_pad", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(30).alias("n")), F.struct(F.lit(30).alias("a"), (F.col("length") - 30).alias("n")))).alias("c"), "start", "content"
    ).select("set_id", "is_pad", (F.col("start") + F.col("c.a")).alias("start"), F.col("c.n").cast("long").alias("length"), F.substring("content", F.col("c.a") + 1, F.col("c.n").cast("int")).alias("content"))
    assert [r.sha1 for r in L.piece_digests(L.piece_slices(chunks, 128)).orderBy("piece").collect()] == pieces


def test_many_small_files_in_one_piece(spark):
    files = [(bytes([i]), False) for i in range(40)]
    got = [r.sha1 for r in L.piece_digests(L.piece_slices(build(spark, {"m": files}), 64)).collect()]
    assert got == hashes(files, 64)


def bencode(v):
    if isinstance(v, int):
        return b"i%de" % v
    if isinstance(v, str):
        v = v.encode()
    if isinstance(v, bytes):
        return b"%d:%s" % (len(v), v)
    if isinstance(v, list):
        return b"l" + b"".join(map(bencode, v)) + b"e"
    return b"d" + b"".join(bencode(k) + bencode(v[k]) for k in sorted(v)) + b"e"


def info_of(files, size, /, **more):
    hash_bytes = b"".join(bytes.fromhex(h) for h in hashes(files, size))
    return {"piece length": size, "pieces": hash_bytes, **more}


def test_identity_matches_an_independent_encoder(spark):
    laid = build(spark, {"multi": MULTI, "one": MULTI[:1]})
    pieces = L.piece_digests(L.piece_slices(laid, 128))
    paths = F.when(F.col("ordinal") == 0, F.array(F.lit("d"), F.lit("tä"))).otherwise(F.array(F.col("ordinal").cast("string")))
    drafts = spark.createDataFrame(
        [("multi", "show é", 128, True, "TAG", False), ("one", "file", 128, False, None, True)],
        "set_id string, name string, piece_length long, private boolean, source string, is_single_file boolean",
    )
    got = {r.set_id: r for r in L.set_identity(drafts, laid.withColumn("path_parts", paths), pieces, rows_per_part=2).collect()}
    multi = info_of(
        MULTI, 128, name="show é", private=1, source="TAG",
        files=[{"length": 100, "path": ["d", "tä"]}, {"length": 250, "path": ["1"]}, {"length": 150, "path": ["2"]}],
    )
    one = info_of(MULTI[:1], 128, name="file", length=100)
    for s, info in (("multi", multi), ("one", one)):
        data = bencode(info)
        assert (got[s].bytes, got[s].info_hash) == (len(data), hashlib.sha1(data).hexdigest())


def refused(spark, *documents):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(documents)], "set_id string, content binary")
    docs, bad = T.decode_torrents(df)
    found = {(r.set_id, r.rule) for r in Q.torrent_violations(T.rule_columns(docs), T.torrent_files(docs)).collect()}
    return found | {(r.set_id, r.reason) for r in bad.collect()}


def test_refused_documents(spark):
    good = info_of(MULTI[:1], 128, name="file", length=100)
    entry = [{"length": 100, "path": ["a"]}]
    multi = {k: v for k, v in good.items() if k != "length"}
    cases = [
        ({"info": good}, None),
        ({"info": dict(good, name="..")}, "UNSAFE_NAME"),
        ({"info": dict(good, pieces=b"x" * 30)}, "PIECES_NOT_20"),
        ({"info": dict(good, pieces=b"x" * 40)}, "PIECE_COUNT"),
        ({"info": dict(good, **{"piece length": 0})}, "IMPLAUSIBLE_PIECE_LENGTH"),
        ({"info": dict(good, files=entry)}, "LENGTH_AND_FILES"),
        ({"info": multi}, "NO_LENGTH"),
        ({"info": {"meta version": 2, "name": "x", "piece length": 128, "length": 1}}, "V2_ONLY"),
        ({"info": dict(multi, files=[{"length": 100, "path": ["a/b"]}])}, "SEPARATOR"),
        ({"info": dict(multi, files=[{"length": 100, "path": []}])}, "EMPTY_PATH"),
        ({"info": dict(good, length=-1)}, "NUMBER_RANGE"),
        ({}, "NO_INFO"),
    ]
    raw = [bencode(d) for d, _ in cases] + [b"d4:name1:x4:infodee", b"d4:infod4:namei01eee", b"", b"garbage", b"d4:info"]
    got = refused(spark, *raw)
    by_doc = {}
    for doc, rule in got:
        by_doc.setdefault(int(doc), set()).add(rule)
    for i, (_, rule) in enumerate(cases):
        assert (rule in by_doc[i]) if rule else i not in by_doc, (i, rule, by_doc.get(i))
    assert by_doc[len(cases)] == {"UNSORTED_KEYS"}
    assert all(by_doc[len(cases) + i] for i in range(1, 5))


def test_reading_back_keeps_the_original_bytes(spark):
    info = info_of(MULTI, 128, name="show", files=[{"attr": "p", "length": 100, "path": ["x"]}, {"length": 400, "path": ["d", "y"]}], extra="kept")
    doc = bencode({"announce": "http://a", "announce-list": [["http://b", "http://b"], [""]], "info": info})
    docs, _ = T.decode_torrents(spark.createDataFrame([("s", doc)], "set_id string, content binary"))
    r = docs.first()
    assert r.info_hash == hashlib.sha1(bencode(info)).hexdigest()
    assert (r.announce, r.multitracker, r.is_single_file) == ([["http://a"], ["http://b"]], True, False)
    assert [(f.path, f.is_pad) for f in T.torrent_files(docs).orderBy("ordinal").collect()] == [("x", True), ("d/y", False)]
    assert [p.sha1 for p in T.torrent_pieces(docs).orderBy("piece").collect()] == hashes(MULTI, 128)


def test_draft_rules(spark):
    drafts = spark.createDataFrame([("a", "", 0, False), ("b", "x", 128, False), ("c", "x", 128, True)], "set_id string, name string, piece_length long, is_single_file boolean")
    files = spark.createDataFrame([("b", 0, [], 10), ("c", 0, ["x"], 300)], "set_id string, ordinal long, path_parts array<string>, length long")
    pieces = spark.createDataFrame([("b", 0), ("c", 0)], "set_id string, piece long")
    got = {tuple(r) for r in Q.draft_violations(drafts, files, pieces).collect()}
    assert got == {("a", "EMPTY_NAME"), ("a", "ZERO_PIECE_LENGTH"), ("a", "NO_DATA"), ("a", "NO_FILES"), ("b", "EMPTY_PATH"), ("c", "PIECE_COUNT")}


def test_reading_torrents_from_disk(spark, tmp_path):
    good = bencode({"info": info_of(MULTI[:1], 128, name="file", length=100)})
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.torrent").write_bytes(good)
    (tmp_path / "b.torrent").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(good)
    docs, bad = T.read_torrents(spark, str(tmp_path))
    assert [r.set_id.rsplit("/", 1)[1] for r in docs.collect()] == ["a.torrent"]
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()] == [("b.torrent", "BENCODE")]


def test_a_union_keeps_a_set_in_one_task(spark):
    # Enough rows that adaptive execution re-plans the parts of the document on their own.
    files = spark.range(20_000).select(
        (F.col("id") % 5).cast("string").alias("set_id"), F.floor(F.col("id") / 5).alias("ordinal"), F.lit(3).cast("long").alias("length"),
        F.lit(False).alias("is_pad"), F.array(F.col("id").cast("string")).alias("path_parts"), F.lit(b"abc").alias("content"),
    )
    pieces = L.piece_digests(L.piece_slices(L.file_spans(files), 64))
    drafts = files.groupBy("set_id").agg(F.lit("n").alias("name"), F.lit(64).alias("piece_length"), F.lit(False).alias("private"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("is_single_file"))
    got = {r.set_id: r.info_hash for r in L.set_identity(drafts, files, pieces).collect()}
    for s in range(5):
        mine = [(b"abc", False)] * 4000
        info = info_of(mine, 64, name="n", files=[{"length": 3, "path": [str(5 * i + s)]} for i in range(4000)])
        assert got[str(s)] == hashlib.sha1(bencode(info)).hexdigest()
    assert len(got) == 5
