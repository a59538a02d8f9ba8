import hashlib
import heapq
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plain import WORD, sha
from tapeledger.llm import prefix_trie
from tapeledger.operators.ordered import BLOCK_ROWS_CONF

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, `odd name` int"
LESS = -(1 << 63)


def plain_trie(rows, shared):
    talks = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        talks[LESS if c is None else c].append((turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    talks = {c: [t[3] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in talks.items()}
    if shared:
        h = {c: zlib.crc32(str(c).encode()) % 4 if c != LESS else 0 for c in talks}
        talks = {c: (talks.get(c - c % 20, [])[: h[c]] if c != LESS else []) + ts[h[c] :] for c, ts in talks.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[tuple(talks[c][:d])].append(c)
        ends[tuple(talks[c])].append(c)
    leaves, saved, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
    real = lambda c: None if c == LESS else c
    told = lambda c: "null" if c == LESS else str(c)
    return sorted(
        (
            (real(members[n][0]), len(n), real(members[n[:-1]][0]) if n else None, len(members[n]), kids[n], leaves[n], saved[n], sha(",".join(map(told, ends[n]))))
            for n in list(members)
        ),
        key=str,
    )


def grown(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(0, 7)):
            text = rng.choice(["hello there", "ok", "", None, "tell me more of it", "no\tthanks"])
            rows.append((c if rng.random() < 0.98 else None, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), text, 1, "k", 2))
    return rows


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("ratio,blocks,queue", [(4096, None, 1 << 16), (2, "3", 1), (5, None, 2)])
def test_tries_of_all_kinds(spark, shared, ratio, blocks, queue, monkeypatch):
    monkeypatch.setattr(prefix_trie.SpillingQueue.__init__, "__defaults__", (queue,))
    rows = grown(ratio, 90)
    if blocks:
        spark.conf.set(BLOCK_ROWS_CONF, blocks)
    try:
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shared_heads=shared, ratio=ratio).collect()
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    assert sorted(map(tuple, got), key=str) == plain_trie(rows, shared)


def test_one_beginning_and_one_conversation_hold_most_rows(spark):
    same = [("user", "the same start"), ("assistant", "and answer")]
    rows = [(c, i, *t, 1, "k", 2) for c in range(400) for i, t in enumerate(same)]
    rows += [(c, 2, "user", f"then {c}", 1, "k", 2) for c in range(0, 400, 3)] + [(999, i, "user", f"turn {i % 5}", 1, "k", 2) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df, ratio=7).collect()), key=str) == plain_trie(rows, False)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).count() == 0 and prefix_trie.prefix_trie(empty, shared_heads=True).count() == 0


def test_repeated_rows_are_repeated_turns(spark):
    rows = grown(3, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.prefix_trie(df.unionAll(df)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows + rows, False)


@pytest.mark.parametrize("limit", [0, 1, 7, 1000])
def test_queue_is_a_heap_whatever_it_keeps_in_memory(limit):
    rng, queue, heap = random.Random(limit), prefix_trie.SpillingQueue(limit), []
    for _ in range(4000):
        if heap and rng.random() < 0.45:
            assert queue.least() == heap[0] and queue.pop() == heapq.heappop(heap)
        else:
            item = (rng.randint(0, 50), rng.randint(0, 10**6))
            queue.push(item)
            heapq.heappush(heap, item)
    while heap:
        assert queue.pop() == heapq.heappop(heap)
    assert queue.least() is None


@given
def test_query_agrees_with_plain_trie(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = prefix_trie.op11_prefix_trie(spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie([tuple(r) for r in rows], True)
    assert sum(1 for r in got if r.depth == 0) == 1
