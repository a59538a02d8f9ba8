import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapeledger.operators import inventory as I
from tapeledger.operators import layout as L
from tapeledger.sources import audio as A
from tapeledger.sources.columns import flac_columns
from tapeledger.sources.opening import map_files

PCM = bytes(range(256)) * 20


def wav(data=PCM, rate=44100, channels=2, bits=16, tag=1, before=b"", size=None):
    frame = channels * -(-bits // 8)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, channels, rate, rate * frame, frame, bits)
    body = b"WAVE" + before + fmt + struct.pack("<4sI", b"data", len(data) if size is None else size) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def flac(frames=5880, md5=bytes(range(16)), vendor="enc", comments=("TITLE=a", "title=b", "Artist=x=y"), rate=44100, channels=2, bits=16):
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | frames
    stream = bytes(10) + packed.to_bytes(8, "big") + md5
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    block = text(vendor) + struct.pack("<I", len(comments)) + b"".join(map(text, comments))
    return b"fLaC\0" + (34).to_bytes(3, "big") + stream + b"\x02\0\0\3xyz\x84" + len(block).to_bytes(3, "big") + block + b"frames"


def tree(root):
    disc = root / "disc 1"
    disc.mkdir(parents=True)
    odd = struct.pack("<4sI", b"LIST", 5) + b"hello\0"
    (root / "a.flac").write_bytes(flac())
    (root / "b.WAV").write_bytes(wav(before=odd))
    (disc / "täpe.flac").write_bytes(flac(frames=0, md5=bytes(16), vendor=""))
    (disc / "c.shn").write_bytes(b"x")
    (disc / "d.flac").write_bytes(b"fLaC")
    (root / "e.wav").write_bytes(wav(tag=3))
    (root / "note.txt").write_text("n")
    return root


def names(df):
    return {r.path.rsplit("/", 1)[1]: r for r in df.collect()}


def test_scan(spark, tmp_path):
    root = tree(tmp_path / "show")
    good, bad = A.scan_inventory(spark, str(root))
    found = names(good)
    assert set(found) == {"a.flac", "b.WAV", "täpe.flac"}
    assert tuple(found["a.flac"].stream) == (44100, 2, 16, 5880, bytes(range(16)).hex())
    assert found["a.flac"].encoder == "enc"
    assert (found["täpe.flac"].stream.total_frames, found["täpe.flac"].stream.audio_md5, found["täpe.flac"].encoder) == (None, None, None)
    w = found["b.WAV"]
    assert (w.stream.total_frames, w.data_offset, w.data_len, w.stream.audio_md5, w.encoder) == (len(PCM) // 4, 58, len(PCM), None, None)
    assert {n: r.reason for n, r in names(bad).items()} == {"c.shn": "NEEDS shntool", "d.flac": "NO_STREAMINFO", "e.wav": "NOT_PCM"}
    flat, _ = A.scan_inventory(spark, str(root), recursive=False)
    assert set(names(flat)) == {"a.flac", "b.WAV"}
    twice, quarantined = A.collect_paths(spark, [str(root)], [str(root / "a.flac"), str(root / "note.txt")])
    assert sorted(r.path.rsplit("/", 1)[1] for r in twice.collect()) == ["a.flac", "a.flac", "b.WAV", "täpe.flac"]
    assert names(quarantined)["note.txt"].reason == "UNKNOWN_FORMAT"


def test_tags(spark, tmp_path):
    good, _ = A.scan_inventory(spark, str(tree(tmp_path / "show")))
    tags = names(A.read_tags(good))
    assert (tags["a.flac"].title, tags["a.flac"].artist, tags["a.flac"].comments["TITLE"]) == ("a", "x=y", ["a", "b"])
    assert (tags["b.WAV"].tag_status, tags["b.WAV"].title) == ("NOT_TAGGABLE", None)


def test_digests_and_chunks(spark, tmp_path):
    root = tree(tmp_path / "show")
    good, _ = A.scan_inventory(spark, str(root))
    digests = names(A.file_digests(good.select("path", "data_offset", "data_len")))
    assert digests["b.WAV"].st5 == hashlib.md5(PCM).hexdigest()
    assert digests["b.WAV"].file_md5 == hashlib.md5((root / "b.WAV").read_bytes()).hexdigest()
    assert digests["a.flac"].st5 is None
    files = good.select(F.lit("s").alias("set_id"), "path", F.col("file_size").alias("length"), F.lit(False).alias("is_pad")).withColumn(
        "ordinal", F.when(F.col("path").endswith("a.flac"), 0).when(F.col("path").endswith("b.WAV"), 1).otherwise(2).cast("long")
    )
    spans = L.file_spans(files)
    pieces = [r.sha1 for r in L.piece_digests(L.piece_slices(A.read_chunks(spans, 100), 1024)).orderBy("piece").collect()]
    data = b"".join((root / n).read_bytes() for n in ("a.flac", "b.WAV", "disc 1/täpe.flac"))
    assert pieces == [hashlib.sha1(data[i : i + 1024]).hexdigest() for i in range(0, len(data), 1024)]


def test_headers_are_read_without_the_rest(spark, tmp_path):
    # A file that promises more audio than it holds still has a header; its digest fails.
    path = tmp_path / "cut.wav"
    path.write_bytes(wav(size=len(PCM) + 1000))
    listed = spark.createDataFrame([(str(path), "WAV")], "path string, format string")
    probed = A.read_wav_headers(listed)
    assert probed.first().stream.total_frames == (len(PCM) + 1000) // 4
    assert A.file_digests(probed.drop("stream", "comments", "reason")).first().reason == "TRUNCATED"
    missing = spark.createDataFrame([(str(tmp_path / "none.wav"), "WAV")], "path string, format string")
    assert A.read_wav_headers(missing).first().reason


def told_by_row(content):
    try:
        facts = A.flac_facts(io.BytesIO(content))
    except ValueError as e:
        return None, None, None, str(e)
    return facts["stream"], facts["encoder"], facts["comments"], None


def odd_flacs():
    """Regular headers and headers of every other kind."""
    text = lambda b: struct.pack("<I", len(b)) + b
    part = lambda kind, b, last=0: bytes([kind | last]) + len(b).to_bytes(3, "big") + b
    stream = flac()[8:42]
    said = text(b"v") + struct.pack("<I", 2) + text(b"no sign") + text(b"=\xff=\xc3\xa4")
    found = [flac(frames=f, md5=m, vendor=v, comments=c) for f in (0, (1 << 36) - 1) for m in (bytes(16), bytes(range(16))) for v in ("", "vä")
             for c in ((), ("TITLE=a", "x=", "title=b", "=c", "tItLe=d=e"), ("stra\u00dfe=1", "STRASSE=2", "ä=ö"), tuple(f"k{i % 7}={i}" for i in range(100)))]
    found += [flac(rate=(1 << 20) - 1, channels=8, bits=32), flac(rate=0, channels=1, bits=1), b"fLaX" + flac()[4:], b"", b"fLa", b"fLaC", b"RIFF"]
    for blocks in ([(4, said), (0, stream)], [(4, said)], [(0, stream)], [(0, stream), (0, stream), (4, said)], [(4, said), (4, b""), (0, stream)], [(0, stream[:20])],
                   [(0, stream + b"more"), (4, said)], [(1, b"")] * 200 + [(0, stream), (4, said)], [(0, stream), (4, b"\xff\xff\xff\xff")], [(0, stream), (4, text(b"") + b"\xff\xff\xff\x7f")]):
        found += [b"fLaC" + b"".join(part(k, b, 128 * (last and i == len(blocks) - 1)) for i, (k, b) in enumerate(blocks)) + b"frames" for last in (0, 1)]
    whole = flac()
    return found + [whole[:n] for n in range(len(whole))] + [whole[:i] + bytes([whole[i] ^ 0x81]) + whole[i + 1 :] for i in range(len(whole))]


def test_headers_by_column_are_headers_by_row():
    contents = odd_flacs()
    for size in (len(contents), 7, 1):
        for i in range(0, len(contents), size):
            some = [*contents[i : i + size], None]
            for kind in (pa.binary(), pa.large_binary()):
                told, found = flac_columns(pa.array([b"before", *some, b"after"], kind).slice(1, len(some)))
                assert not told[-1]
                got = list(zip(*[found[n].to_pylist() for n in ("stream", "encoder", "comments", "reason")]))
                assert got == [told_by_row(c) for c, t in zip(some, told) if t]
    # Whole files are told by column; only odd ones are left.
    assert flac_columns(pa.array([flac()] * 3 + [b"fLaX"]))[0].all()
    assert len(flac_columns(pa.array([], pa.binary()))[0]) == 0


def test_contents_are_read_at_once_where_they_can_be(spark, tmp_path):
    (tmp_path / "a.flac").write_bytes(flac(vendor="on disk"))
    data = [(i, None, c) for i, c in enumerate(odd_flacs())] + [(-1, str(tmp_path / "a.flac"), None), (-2, str(tmp_path / "none"), None)]
    df = spark.createDataFrame(data, "n int, path string, content binary")
    got = {r.n: r for r in A.read_flac_headers(df).collect()}
    assert len(got) == len(data) and got[-1].encoder == "on disk" and got[-2].reason
    for n, _, content in data[:-2]:
        stream, encoder, comments, reason = told_by_row(content)
        r = got[n]
        assert (r.stream and r.stream.asDict(), r.encoder, r.comments, r.reason) == (stream, encoder, None if comments is None else dict(comments), reason)

    def many(contents):
        told = np.array([c == b"x" for c in contents.to_pylist()])
        return told, {"v": pa.array([1] * int(told.sum()))}

    df = spark.createDataFrame([(1, b"x"), (2, b"y"), (3, b"x"), (4, b"")], "n int, content binary")
    both = map_files(df, lambda _row, f: {"v": 10 + len(f.read())}, "v int, reason string", many)
    assert {r.n: (r.v, r.reason) for r in both.collect()} == {1: (1, None), 2: (11, None), 3: (1, None), 4: (10, None)}


def test_summary(spark):
    inventory = spark.createDataFrame([("a", 0, "WAV"), ("a", 1, "FLAC"), ("a", 2, "FLAC")], "set_id string, ordinal long, format string")
    skipped = spark.createDataFrame([("a",), ("b",)], "set_id string")
    got = {r.set_id: r.summary for r in I.format_summary(inventory, skipped).collect()}
    assert got == {"a": "3 files: 1 WAV, 2 FLAC (1 skipped)", "b": "no audio files"}
