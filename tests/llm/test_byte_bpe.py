import os
import random

import public_tokenizers
import pytest
import tiktoken

from plain import sha
from tapeledger.llm import byte_bpe

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.load_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id long, text string, ids string, r int, decoded string, `odd name` int"


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.build_tokenizer(RANKS), public_tokenizers.PATTERN)


def check(encoder, texts):
    ids, counts = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == PLAIN.encode_ordinary(text), repr(text[:200])
        at += n


def test_byte_characters_are_a_bijection():
    shown = byte_bpe.byte_characters()
    assert len(set(shown)) == 256 and all(c.isprintable() and not c.isspace() for c in shown)


def test_every_code_point_is_split_as_the_plain_encoder_splits_it(encoder):
    for low in range(0, 0x110000, 1 << 14):
        check(encoder, [f"a{c}b 1{c}2 .{c}, {c}  {c}\n" for c in map(chr, range(low, min(low + (1 << 14), 0x110000))) if not "\ud800" <= c <= "\udfff"])


@pytest.mark.parametrize("alphabet", ["ab", "a", " \n\ta", "01a'", "sS'tre vl", "äöé中文 ", "　  a\x85\x1c", "=-_*#", "\U0001f600‍ ԰"])
def test_random_strings(encoder, alphabet):
    rng = random.Random(alphabet)
    check(encoder, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(500)])


def test_long_texts_are_cut_where_no_match_can_cross(encoder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 7)
    monkeypatch.setattr(byte_bpe, "TABLE_CHARS", 50)
    rng = random.Random(4)
    for _ in range(20):
        check(encoder, ["".join(rng.choice("ab1'\n  ,é") for _ in range(rng.randint(0, 200))) for _ in range(20)])
    check(encoder, ["a" * 5000, "word " * 20_000, " " * 2000 + "x"])


def starts_of(text, ids):
    out, before = [], b""
    for i in ids:
        out.append(len(before.decode("utf-8", "ignore")))
        before += PLAIN.decode_single_token_bytes(i)
    return out


def test_texts_of_all_kinds_come_back(spark):
    texts = [None, "", " ", "one  two\n\n three's", "naïve 中文 \U0001f600!", "<|endoftext|>", "x" * 5000, "\x00\x01", "same", "same"]
    rows = [(i % 9, t, "mine", 1, "d", 2) for i, t in enumerate(texts)]
    done = byte_bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, public_tokenizers.PATTERN)
    assert sorted(done.columns) == sorted(["doc_id", "text", "r", "decoded", "odd name", "ids", "starts"])
    back = byte_bpe.decode(done, PATH)
    assert sorted(back.columns) == sorted(["doc_id", "text", "r", "odd name", "ids", "starts", "decoded", "decoded_text"])
    got = back.collect()
    assert sorted(str(r.text) for r in got) == sorted(map(str, texts))
    for r in got:
        text = r.text or ""
        assert r.ids == PLAIN.encode_ordinary(text) and r.starts == starts_of(text, r.ids)
        assert bytes(r.decoded) == text.encode() and r.decoded_text == text and r["odd name"] == 2
    at_once = byte_bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, public_tokenizers.PATTERN, decoded=True)
    assert sorted(map(str, at_once.select(back.columns).collect())) == sorted(map(str, got))
    nothing = byte_bpe.encode(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN)
    assert byte_bpe.decode(nothing, PATH).count() == 0


def test_ids_that_end_within_a_character(spark):
    ids = PLAIN.encode_ordinary("\U0001f9ff")
    assert len(ids) > 1
    rows = spark.createDataFrame([(1, ids), (2, ids[:-1]), (3, []), (4, None), (5, [-1, 10**8, None])], "k int, ids array<int>")
    got = {r.k: (r.decoded, r.decoded_text) for r in byte_bpe.decode(rows, PATH).collect()}
    assert got[1] == ("\U0001f9ff".encode(), "\U0001f9ff") and got[3] == (b"", "") and got[4] == (None, None)
    assert got[2][1].endswith("�") and got[2][0] == b"".join(map(PLAIN.decode_single_token_bytes, ids[:-1]))
    assert got[5][1] == "�" * 3


@given
def test_query_agrees_with_the_plain_encoder(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op12_byte_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = PLAIN.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(r.text or ""))
    assert not got
