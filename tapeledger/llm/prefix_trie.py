"""Conversations as a trie of their beginnings, with totals of every subtree."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.common import WORD, quoted, read, written
from tapeledger.operators.ordered import attach, longest_set, number_rows, scan_sets

NO_ID = -(1 << 63)
FAMILY = 20  # conversations that share the head of their first one
HEADS = 4  # a shared head has fewer turns than this
RATIO = 4096  # most members of a shard's root for one member of its deepest nodes
QUEUE = 1 << 16  # messages a task holds before it writes some to disk
ID_BITS = 12  # ids that are equal but for so many bits are gathered before they are shuffled to their node
SUMS = ["s1", "s2", "s3", "s4"]


class SpillingQueue:
    """A priority queue of tuples that holds at most ``limit`` of them in memory; the others lie sorted in files of the task."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = self._written(sorted(self.heap))
            self.heap = []
            heapq.heappush(self.runs, (next(run), len(self.runs), run))

    @staticmethod
    def _written(items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        for at in range(0, len(items), 1024):
            pickle.dump(items[at : at + 1024], file)
        file.seek(0)

        def back():
            with file:
                for _ in range(0, len(items), 1024):
                    yield from pickle.load(file)

        return back()

    def least(self) -> tuple | None:
        ends = [self.heap[0]] if self.heap else []
        return min(ends + [self.runs[0][0]] if self.runs else ends, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, n, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, n, run))
            return item
        return heapq.heappop(self.heap)


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``ordinal``, ``digest`` of role and text, and ``words`` of every turn; texts are left behind."""
    role, text = (F.coalesce(F.col(quoted(c)), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = df.select(
        F.coalesce(F.col(quoted(conv_col)).cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col(quoted(turn_col)).alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return written(number_rows(rows, ["conv"], ["turn", "digest"]).drop("turn"), "turns")


def _alone(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: turns with their ``depth``, and conversations with their ``length``."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    rows = attach(turns, convs, ["conv"])
    return rows.select("conv", (F.col("ordinal") + 1).alias("depth"), "digest", "words", "length"), convs


def _with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of the first one of their family of ``FAMILY`` ids.

    Conversation c takes the first h turns of conversation c - c % FAMILY (all if it has fewer, none if it is
    absent), h being a checksum of c, and goes on with its own turns after its first h. The null conversation stays as it is.
    """
    known = F.col("conv") != NO_ID
    head = F.when(known, F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).otherwise(0)
    convs = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "conversations")
    base = F.when(known, F.col("conv") - F.col("conv") % FAMILY)
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = convs.select("conv", "n", head.alias("h"), base.alias("base")).join(sizes, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = plan.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = written(plan.select("conv", "base", "h", "taken", "length"), "plan")
    own = attach(turns, plan, ["conv"]).filter("ordinal >= h").select("conv", (F.col("taken") + F.col("ordinal") - F.col("h") + 1).alias("depth"), "digest", "words", "length")
    heads = turns.filter(F.col("ordinal") < HEADS - 1).withColumnRenamed("conv", "base")
    wanted = plan.filter("taken > 0").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)))
    lent = wanted.join(heads, ["base", "ordinal"]).select("conv", (F.col("ordinal") + 1).alias("depth"), "digest", "words", "length")
    return written(own.unionAll(lent), "rebuilt"), plan.select("conv", "length")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


ROOT = bytes.fromhex(hashlib.md5(b"0:0:0:0:0").hexdigest())


def _paths(rows: DataFrame) -> DataFrame:
    """``key`` and ``parent`` of every turn: 128 bits that tell its depth and all turns up to it.

    They come from running sums of a digest of each turn at its place, which long conversations get block by block.
    """
    marked = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    parts = {f"p{i}": F.conv(F.substring(marked, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    rows = rows.withColumns(parts)
    summed = scan_sets(rows, ["conv"], running={s: (F.sum, F.col(f"p{i}")) for i, s in enumerate(SUMS)}, ordinal="depth", longest=longest_set(rows, ["conv"]))
    before = [F.col(s) - F.col(f"p{i}") for i, s in enumerate(SUMS)]
    mine, parent = _key(F.col("depth"), [F.col(s) for s in SUMS]), _key(F.col("depth") - 1, before)
    return written(summed.select("conv", "depth", mine.alias("key"), parent.alias("parent"), "words", (F.col("depth") == F.col("length")).alias("last")), "paths")


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of the nodes at which conversations end.

    A digest over very many ids is a chain by definition. Ids are gathered in short sorted lists first, and
    the lists of one node pass through its task one after the other.
    """
    ends = paths.filter("last").select("key", "conv").unionAll(convs.filter("length = 0").select(F.lit(ROOT).alias("key"), "conv"))
    told = F.transform("ids", lambda i: F.when(i == NO_ID, F.lit("null")).otherwise(i.cast("string")))
    lists = written(ends, "ends").groupBy("key", F.expr(f"shiftright(conv, {ID_BITS})").alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    lists = lists.select("key", "block", F.array_join(told, ",").alias("ids")).repartition("key").sortWithinPartitions("key", "block")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            yield pack(done)
        if now is not None:
            yield pack([(now, digest.hexdigest())])

    def pack(done):
        keys, digests = zip(*done, strict=True) if done else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])

    return lists.mapInArrow(run, "key binary, ends_sha256 string")


TOTALS = "key binary, parent binary, is_root boolean, n_leaves long, saved_tokens long"


def _passed_up(batches):
    """Totals of the nodes of shards, which come in reverse level order: a node's children before it.

    Each node takes its children's messages from the queue, adds its own share, and sends its total to its parent;
    that of a shard's root leaves the shard.
    """
    queue, shard = SpillingQueue(), None
    for batch in batches:
        out = []
        for top, depth, key, parent, own, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if top != shard:
                shard, queue = top, SpillingQueue()
            leaves, saved = leaves + (children == 0), saved + own
            place = (-depth, key)
            while (first := queue.least()) is not None and first[:2] == place:
                _, _, more_leaves, more_saved = queue.pop()
                leaves, saved = leaves + more_leaves, saved + more_saved
            if key != shard:
                queue.push((1 - depth, parent, leaves, saved))
            out.append((key, parent, key == shard, leaves, saved))
        columns = zip(*out, strict=True) if out else ((), (), (), (), ())
        kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "parent", "is_root", "n_leaves", "saved_tokens"])


def _totals(nodes: DataFrame, paths: DataFrame, ratio: int) -> DataFrame:
    """``key``, ``n_leaves`` and ``saved_tokens`` of the nodes with more than one member.

    Nodes fall in bands of members, each ``ratio`` times as wide as the one before. A shard is what
    a band holds below a node whose parent is in a higher band, so it has at most ``ratio`` nodes of one
    depth, however many children or members one has. Band by band, shards pass totals up within, and those of
    their roots go on to parents in higher bands, summed up before they are shuffled. Nodes with one member are
    chains that end in one leaf and save nothing.
    """
    most = nodes.agg(F.max("n_convs")).first()[0] or 0
    bands, cap = 1, ratio
    while cap < most:
        bands, cap = bands + 1, cap * ratio
    band = F.lit(bands)
    for b in range(bands - 1, 0, -1):
        band = F.when(F.col("n_convs") <= ratio**b, b).otherwise(band)
    inner = nodes.filter("n_convs > 1").withColumn("band", band)
    roots = paths.select("conv", "depth", "key").join(inner.select("key", "band"), "key").groupBy("conv", "band").agg(F.min_by("key", "depth").alias("root"))
    placed = inner.join(roots, ["conv", "band"], "left").withColumn("root", F.when(F.col("band") == bands, F.lit(ROOT)).otherwise(F.col("root")))
    placed = written(placed.select("root", "band", "depth", "key", "parent", ((F.col("n_convs") - 1) * F.col("words")).alias("own"), "n_children"), "placed")
    chains = nodes.filter("n_convs = 1").groupBy("parent").agg(F.count(F.lit(1)).alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    messages, done = written(chains, "messages"), []
    for b in range(1, bands + 1):
        sums = messages.groupBy("parent").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        told = placed.filter(F.col("band") == b).join(sums.withColumnRenamed("parent", "key"), "key", "left")
        rows = told.select(
            "root", "depth", "key", "parent", "own", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")
        )
        ordered = rows.repartition("root").sortWithinPartitions("root", F.col("depth").desc(), "key")
        done.append(written(ordered.mapInArrow(_passed_up, TOTALS), "totals"))
        messages = messages.unionAll(done[-1].filter("is_root").select("parent", "n_leaves", "saved_tokens"))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("key", "n_leaves", "saved_tokens")


def _trie(rows: DataFrame, convs: DataFrame, ratio: int) -> DataFrame:
    paths = _paths(rows)
    grown = paths.groupBy("key").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words")
    )
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("key"), "conv", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words")
    )
    found = written(grown.withColumn("depth", F.col("depth").cast("long")).unionAll(root), "found")
    children = found.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(found.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    totals = _totals(nodes, paths, ratio)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    full = nodes.join(totals, "key", "left").join(_ends(paths, convs), "key", "left").join(parents, "parent", "left")
    return full.select(
        real("conv").alias("conv_id"),
        "depth",
        real("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared_heads: bool = False, ratio: int = RATIO
) -> DataFrame:
    """One row per distinct beginning of conversations: a node of their trie.

    A node of depth d is a sequence of d turns (role and text); the root, of depth 0, has no turns. Columns:
    ``conv_id`` (smallest of the node's members, the conversations that begin so), ``depth``, ``parent_conv_id`` (the
    parent's, null at the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in the
    subtree, the node included), ``saved_tokens`` (words that need not be read again where members share turns, summed over the
    subtree) and ``ends_sha256`` (digest of the ids, joined by commas, of the members that end here).

    Turns are in order of their number, null first, then of a digest of role and text; null roles and
    texts are empty. Rows without a conversation id make up one conversation, which sorts before all others, is
    written ``null`` in digests and whose id stays null. Repeated rows are repeated turns. Further columns are
    ignored; an empty table has no nodes. ``shared_heads`` rebuilds conversations first (``_with_shared_heads``).

    Only digests and counts are shuffled. Nodes are told apart by 128 bits. Subtree totals are passed
    up time-forward: nodes sorted externally in reverse level order, messages to parents in spilling
    queues, within shards, then from the roots of shards to those above (``_totals``).
    """
    turns = _turns(df, conv_col, turn_col, role_col, text_col)
    rows, convs = (_with_shared_heads if shared_heads else _alone)(turns)
    return _trie(rows, convs, ratio)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"), shared_heads=True)


QUERIES = {
    "op11_prefix_trie": (
        op11_prefix_trie,
        r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
o AS (SELECT coalesce(conv_id, -9223372036854775808) AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS o FROM conversations),
n AS (SELECT c, n, CASE WHEN c = -9223372036854775808 THEN 0 ELSE
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda b: ascii(b)::BIGINT)), lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1])), 4294967295) % 4 END AS h,
  CASE WHEN c <> -9223372036854775808 THEN c - c % 20 END AS base FROM (SELECT c, count(*) AS n FROM o GROUP BY c), crc),
i AS (SELECT a.c, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS k, least(a.h, coalesce(b.n, 0)) + greatest(a.n - a.h, 0) AS len FROM n a LEFT JOIN n b ON b.c = a.base),
r AS (SELECT o.c, k + o - h + 1 AS d, digest, words, len FROM o JOIN i ON o.c = i.c WHERE o >= h
  UNION ALL SELECT i.c, o + 1, digest, words, len FROM i JOIN o ON o.c = i.base AND o < k),
p AS (SELECT c, d, words, len, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS key FROM r UNION ALL SELECT c, 0, 0, len, '' FROM i),
u AS (SELECT key, d, min(c) AS conv, count(*) AS n_convs, min(words) AS words, CASE WHEN d > 0 THEN left(key, (d - 1) * 32) END AS parent FROM p GROUP BY key, d),
kids AS (SELECT parent, count(*) AS n FROM u WHERE parent IS NOT NULL GROUP BY parent),
sub AS (SELECT a.key, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved
  FROM u JOIN p a ON a.c = u.conv AND a.d <= u.d LEFT JOIN kids ON kids.parent = u.key GROUP BY a.key),
e AS (SELECT key, sha256(string_agg(CASE WHEN c = -9223372036854775808 THEN 'null' ELSE c::VARCHAR END, ',' ORDER BY c)) AS ends FROM p WHERE d = len GROUP BY key)
SELECT nullif(u.conv, -9223372036854775808) AS conv_id, u.d AS depth, nullif(v.conv, -9223372036854775808) AS parent_conv_id, u.n_convs, coalesce(kids.n, 0) AS n_children,
  n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u LEFT JOIN u v ON v.key = u.parent LEFT JOIN kids ON kids.parent = u.key JOIN sub ON sub.key = u.key LEFT JOIN e ON e.key = u.key""",
    )
}
