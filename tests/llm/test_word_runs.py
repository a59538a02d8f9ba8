import os
import random
import time
import zlib

import numpy as np
import pytest

from plain import WORD, sha
from tapeledger.llm import word_runs
from tapeledger.llm.wordhash import mixed

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
SCHEMA = "doc_id long, text string, runs string, r int, n_words int, `odd name` int"


def plain_runs(w):
    """Every stretch by trying every period, the smallest first."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            a = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            length = i - a + q
            if length >= max(12, 2 * q):
                found.setdefault((a - q, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def check(texts):
    ids = {}
    numbers = [np.array([ids.setdefault(c, len(ids)) for c in t], np.uint64) for t in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    got = word_runs.runs_of(mixed(np.concatenate(numbers), 1), bounds)
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_runs(t), t[:300]


@pytest.mark.parametrize("pairs", [1 << 20, 3])
def test_random_words(monkeypatch, pairs):
    monkeypatch.setattr(word_runs, "PAIRS", pairs)
    rng = random.Random(pairs)
    for letters in ("a", "ab", "aab", "abc", "aaaaaab"):
        check(["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(150)])


def test_nested_and_neighbouring_periods():
    rng = random.Random(5)
    texts = ["", "a", "a" * 11, "a" * 12, "a" * 300, "ab" * 6, "ab" * 5 + "a", "abcdefghij" * 2, "abcdef" * 2, "abcdefg" * 2, "a" * 30 + "b" + "a" * 30, ("a" * 9 + "b") * 8]
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    texts.append(b)  # Fibonacci words are full of runs
    for _ in range(300):
        root = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        inner = root * rng.randint(1, 6)
        outer = (inner + "".join(rng.choice("abd") for _ in range(rng.randint(0, 4)))) * rng.randint(1, 5)
        texts.append("".join(rng.choice("abcd") for _ in range(rng.randint(0, 5))) + outer + root * rng.randint(0, 9) + outer[: rng.randint(0, 40)])
    check(texts)


def test_one_word_a_very_long_time():
    start = time.time()
    n = 200_000
    got = word_runs.runs_of(np.full(n, 7, np.uint64), np.array([0, n]))
    assert got == {0: [(0, n, 1)]}
    block = np.concatenate([np.full(500, 7, np.uint64), [np.uint64(8)]])
    got = word_runs.runs_of(np.tile(block, 400), np.array([0, len(block) * 400]))
    assert len(got[0]) == 401 and (0, len(block) * 400, 501) in got[0]
    assert time.time() - start < 60


def plain_row(doc_id, w):
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_texts_of_all_kinds(spark):
    texts = [None, "", " \n", "one", "a b " * 20, "x\ty\nz  " * 9 + "end", "same same " * 8, "same same " * 8, "é 中 " * 15, "w " * 90_000]
    df = spark.createDataFrame([(i % 8, t, "mine", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)
    done = word_runs.periodic_runs(df)
    assert sorted(done.columns) == sorted(["doc_id", "text", "r", "odd name", "n_words", "runs", "collapsed"])
    got = sorted(((r.doc_id, r.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in done.collect()))
    want = []
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        runs = plain_runs(w) if len(w) < 9999 else [(0, len(w), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i % 8, t or "", len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert word_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_and_empty_texts_stay_as_they_are(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, None), (3, ""), (4, " ")], "doc_id long, text string")
    assert sorted(map(str, word_runs.looped(df).collect())) == sorted(map(str, df.collect()))


@given
def test_query_agrees_with_trying_every_period(spark):
    got = {r.doc_id: tuple(r) for r in word_runs.op13_word_runs(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        w = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 4000:  # trying every period takes too long
            got.pop(r.doc_id)
        else:
            assert got.pop(r.doc_id) == plain_row(r.doc_id, w)
    assert not got
