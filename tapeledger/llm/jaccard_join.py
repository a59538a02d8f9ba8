"""Near duplicates: a similarity join on word shingles with several global token orders."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeledger.llm.common import dropped, packed, quoted, read, short_batches, tidy, written
from tapeledger.llm.components import components, hooked
from tapeledger.llm.wordhash import SHINGLE, chunks, mixed, shingles, words

NUMBER, OF = 3, 4  # two sets are linked at a Jaccard similarity of NUMBER / OF or more
COUNTERS = 1 << 20  # counters of the frequency sketch, whatever the size of the corpus
SLICE = 1 << 14
MASK_BITS = (1 << 20, 1 << 27)  # fewest and most bits of the mask of wanted ids; eight for each of them in between
NO_ID = -(1 << 63)
ORDERS = (11, 12)  # salts of the token orders
STARS = 8  # orders by hash under which sets are first brought together
EARLY_ROUNDS = 2  # verifications of two pairs a component, before that of all pairs left
HELD = 400_000  # token rows a task puts together
EXTRA = 20  # one further prefix token in so many, and one further shared token asked for

TOKEN_ROWS = "token long, id long, n int, e int, place int, deal int"


def _sets(column, k: int):
    """Row and sorted distinct shingles of each text of a column."""
    for first, data, offsets in chunks(column):
        rows, hashes, _, _ = words(data, offsets)
        yield from enumerate(shingles(rows, hashes, len(offsets) - 1, k), first)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    a, b = mixed(tokens, 21).sum(dtype=np.uint64), mixed(tokens, 22).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _summaries(nodes: DataFrame, k: int) -> DataFrame:
    """Per row: id, set size and 128-bit signature of the set; per task: slices of a sketch of token frequencies.

    A set counts once a task, so copies of one text hardly raise the frequency of its tokens.
    """

    def run(batches):
        counts, seen = np.zeros(COUNTERS, np.int64), set()
        for batch in batches:
            found = []
            for _, tokens in _sets(batch.column(1), k):
                a, b = _signature(tokens)
                found.append((len(tokens), a, b))
                if len(tokens) and (a, b) not in seen:
                    seen.add((a, b))
                    np.add.at(counts, _slot(tokens), 1)
            n, a, b = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(n), pa.binary())],
                names=["id", "n", "s1", "s2", "counts"],
            )
        if seen:
            parts = [zlib.compress(counts[i : i + SLICE].astype(np.int32).tobytes(), 1) for i in range(0, COUNTERS, SLICE)]
            at = pa.array(range(len(parts)), pa.int64())
            yield pa.RecordBatch.from_arrays([at, pa.nulls(len(parts), pa.int64()), at, at, pa.array(parts, pa.binary())], names=["id", "n", "s1", "s2", "counts"])

    return nodes.mapInArrow(tidy(run), "id long, n long, s1 long, s2 long, counts binary")


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def _frequency_classes(summaries: DataFrame) -> np.ndarray:
    """The binary logarithm of every counter of the merged sketch: one byte each, so of fixed size."""

    def run(batches):
        total = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(zlib.decompress(part.as_buffer()), np.int32).astype(np.int64)
                total[at] = total[at] + counts if at in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["id", "counts"])

    slices = summaries.filter("n IS NULL").select("id", "counts")
    merged = slices.repartition(COUNTERS // SLICE, "id").mapInArrow(run, "id long, counts binary")
    classes = np.zeros(COUNTERS, np.uint8)
    for row in merged.toLocalIterator():
        counts = np.frombuffer(row["counts"], np.int64)
        classes[row["id"] * SLICE : (row["id"] + 1) * SLICE] = np.log2(np.maximum(counts, 1) * 1.0)
    return classes


def _ordered(tokens: np.ndarray, classes: np.ndarray, salt: int) -> np.ndarray:
    """The tokens in one global order: rarer frequency classes first, within a class by a hash."""
    rank = (classes[_slot(tokens)].astype(np.uint64) << np.uint64(58)) | (mixed(tokens, salt) >> np.uint64(6))
    return tokens[np.argsort(rank)]


def _least(n: int) -> int:
    """The smallest size of a set similar to one of ``n``, which is the least they share."""
    return (NUMBER * n + OF - 1) // OF


def _prefix(n: int) -> int:
    """Similar sets share a token of so many first ones, in any order."""
    return n - _least(n) + 1


def _long_prefix(n: int) -> int:
    """Similar sets share at least ``1 + m // EXTRA`` tokens of so many first ones, if the smaller has ``m``."""
    return n - _least(n) + 1 + n // EXTRA


def _token_batch(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    """Rows of ``TOKEN_ROWS`` for (id, set size, shared tokens, tokens in order)."""
    sizes = [len(t) for *_, t in rows]
    each = lambda i, kind: np.repeat(np.array([r[i] for r in rows], kind), sizes)
    token = np.concatenate([t for *_, t in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]) if rows else np.zeros(0, np.int32)
    columns = [token, each(0, np.int64), each(1, np.int32), each(2, np.int32), place, _dealt(token, each(0, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "n", "e", "place", "deal"])


def _dealt(token: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per row: 0 if its token has one id in the batch; else 1 for one row of the token and -2 or less for all others.

    Rows below 0 are known to share their token and need not meet its other rows.
    """
    deal = np.zeros(len(token), np.int32)
    if not len(token):
        return deal
    order = np.argsort(token, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    several = np.minimum.reduceat(ids[order], starts) < np.maximum.reduceat(ids[order], starts)
    known = order[np.repeat(several, np.diff(np.append(starts, len(token))))]
    deal[known] = -2 - (mixed(ids[known].view(np.uint64), 31) >> np.uint64(34)).astype(np.int32)
    deal[order[starts[several]]] = 1
    return deal


def _of_several(rows: DataFrame) -> DataFrame:
    """Rows whose token more than one id has; an id that repeats it does not count twice.

    Of a token that a batch holds several times, one row goes to the task that compares the token's
    ids; the others are dealt over all tasks, so a token of very many sets is a row a batch there.
    """
    same = Window.partitionBy("token", F.least("deal", F.lit(0)))
    shared = (F.col("deal") < 0) | (F.col("top") > 0) | (F.col("a") < F.col("b"))
    found = rows.withColumns({"a": F.min("id").over(same), "b": F.max("id").over(same), "top": F.max("deal").over(same)})
    return found.filter(shared).drop("a", "b", "top", "deal")


def _alive(nodes: DataFrame, sized: DataFrame, groups: DataFrame, classes, k: int) -> DataFrame:
    """One id of each set that shares enough prefix tokens with other sets to be similar to one: a necessary condition.

    Only token and signature are shuffled, for one row a set and task: equal sets, in whatever
    tasks, are one set here, so a token that only copies of one text have is not shared. In a prefix longer by some, as many
    more tokens must be shared, which a passage common to two texts that differ otherwise is not.
    """

    def run(batches):
        table, seen, held, size = classes.value, set(), [], 0
        for batch in batches:
            for _, tokens in _sets(batch.column(0), k):
                signature = _signature(tokens)
                if not len(tokens) or signature in seen:
                    continue
                seen.add(signature)
                held.append((signature[0], _ordered(tokens, table, ORDERS[0])[: _long_prefix(len(tokens))]))
                size += len(held[-1][1])
                if size > HELD:
                    yield _pairs(held)
                    held, size = [], 0
        yield _pairs(held)

    rows = nodes.select("text").mapInArrow(tidy(run), "token long, id long, deal int")
    shared = _of_several(rows).groupBy("id").count().withColumnRenamed("id", "s1")
    need = 1 + F.floor((NUMBER * F.col("n") + OF - 1) / OF).cast("long") / EXTRA
    return shared.join(groups, "s1").filter(F.col("count") >= F.floor(need)).select(F.col("v").alias("id")).distinct()


def _pairs(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    token = np.concatenate([p for _, p in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
    ids = np.repeat(np.array([i for i, _ in rows], np.int64), [len(p) for _, p in rows])
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(ids), pa.array(_dealt(token, ids))], names=["token", "id", "deal"])


def _lists(batch: pa.RecordBatch):
    """Id, set size and shared tokens of each row."""
    for i, n, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        yield i, n, part.values.to_numpy().view(np.uint64)


def _held(batches, rows_of):
    """Batches of token rows of bounded size."""
    rows, size = [], 0
    for batch in batches:
        for i, n, tokens in _lists(batch):
            rows.append((i, n, len(tokens), rows_of(n, tokens)))
            size += len(rows[-1][3])
            if size > HELD:
                yield _token_batch(rows)
                rows, size = [], 0
    yield _token_batch(rows)


def _prefixes(sets: DataFrame, classes, salt: int) -> DataFrame:
    """Prefix tokens of each set under one order; tokens that no other set has need no place in it."""
    first = lambda n, tokens: _ordered(tokens, classes.value, salt)[: len(tokens) - _least(n) + 1]
    return sets.mapInArrow(tidy(lambda batches: _held(batches, first)), TOKEN_ROWS)


def _smallest(sets: DataFrame) -> DataFrame:
    """The first token of each set under each of ``STARS`` orders by hash, made different between the orders."""

    def firsts(n: int, tokens: np.ndarray) -> np.ndarray:
        return np.array([mixed(tokens, 200 + o).min() for o in range(STARS)], np.uint64) ^ np.arange(STARS, dtype=np.uint64) if len(tokens) else tokens

    return sets.mapInArrow(tidy(lambda batches: _held(batches, firsts)), TOKEN_ROWS).drop("deal")


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose token more than one id has."""
    return written(_of_several(rows), name)


def _near(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not in ``ids`` (a written table), by a bit mask of bounded size."""
    wanted, (bits, most) = 8 * ids.count(), MASK_BITS
    while bits < min(wanted, most):
        bits *= 2
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    cell, bit = (slot / 32).cast("int"), F.pmod(slot, F.lit(32)).cast("int")
    bits = ids.select(cell.alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    mask = F.broadcast(bits.groupBy("cell").agg(F.bit_or("bits").alias("mask")))
    hit = F.call_function("shiftright", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("cell", cell).join(mask, "cell").filter(hit).select(*rows.columns)


def _wanted(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``nodes`` with an id in ``ids``, each once there.

    An inner join, as a semi join would be pushed below the mask and shuffle all rows.
    """
    return _near(nodes, ids).join(ids, "id")


def _token_sets(nodes: DataFrame, k: int) -> DataFrame:
    """Every token of every set, a row each, and the number of the set among those of its id."""

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, tokens in _sets(batch.column(1), k):
                rows.append((ids[row], len(tokens), _signature(tokens)[0], tokens))
                size += len(tokens)
                if size > HELD:
                    yield pack(rows)
                    rows, size = [], 0
        yield pack(rows)

    def pack(rows):
        sizes = [len(t) for *_, t in rows]
        token = np.concatenate([t for *_, t in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
        each = lambda i, kind: pa.array(np.repeat(np.array([r[i] for r in rows], kind), sizes))
        ids = each(0, np.int64)
        columns = [pa.array(token), ids, each(1, np.int32), each(2, np.int64), pa.array(_dealt(token, ids.to_numpy()))]
        return pa.RecordBatch.from_arrays(columns, names=["token", "id", "n", "sid", "deal"])

    return nodes.mapInArrow(tidy(run), "token long, id long, n int, sid long, deal int")


def _able_sets(nodes: DataFrame, sized: DataFrame, k: int) -> DataFrame:
    """Sets without the tokens that no other id has; those with too few left are left out.

    What two sets share is among these tokens, so they bound the similarity to any other set: an
    altered copy whose altered runs are its own falls out here, whatever it is a copy of. Repeated
    rows of an id are one set, each token once.
    """
    rows = _token_sets(nodes, k)
    repeated = sized.groupBy("id").count().filter("count > 1").limit(1).count() > 0
    if not repeated:
        rows = rows.withColumn("sid", F.lit(0).cast("long"))  # each id has one set
    gathered = (F.collect_set if repeated else F.collect_list)("token")
    sets = _of_several(rows).groupBy("id", "n", "sid").agg(F.sort_array(gathered).alias("tokens"))
    return sets.filter(OF * F.size("tokens") >= NUMBER * F.col("n")).select("id", "n", "tokens")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``u``, ``v``) whose sets are similar enough, by counting what they share."""
    pairs = written(pairs.select("u", "v"), "pairs")

    def side(name: str) -> DataFrame:
        mine = _near(sets, pairs.select(F.col(name).alias("id")))
        return mine.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"tokens_{name}"))

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(OF * both >= NUMBER * (n + m - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "tokens_u", "tokens_v")
    return joined.mapInArrow(tidy(run), "u long, v long")


def _stars(firsts: DataFrame) -> DataFrame:
    """Each set with the sets most like it that can hold a group together.

    Of the sets with one first token, the centre is the one with the fewest tokens of its own, the
    original of altered copies if it is there. A set is paired with a centre it meets under half of
    the orders or more.
    """
    firsts = written(firsts, "firsts")
    centre = written(firsts.groupBy("token").agg(F.min(F.struct(F.col("n") - F.col("e"), "id", "n", "e")).alias("c")), "centres")
    met = firsts.join(centre, "token").filter(F.col("id") != F.col("c.id"))
    able = (OF + NUMBER) * F.least(F.col("e"), F.col("c.e")) >= NUMBER * (F.col("n") + F.col("c.n"))
    pairs = met.filter(able).groupBy(F.greatest("id", "c.id").alias("u"), F.least("id", "c.id").alias("v")).count()
    return pairs.filter(F.col("count") >= STARS // 2).select("u", "v")


def _candidates(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs from different components that share a prefix token, and can still reach the threshold there.

    Tokens all of whose rows are in one component are left out before pairs are formed. At the
    first token two sets share, their overlap is at most one plus the shorter rest; pairs below what
    the threshold asks for are not formed.
    """
    known = shared.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed_tokens = written(known.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select("token"), "mixed")
    rows = known.join(mixed_tokens, "token", "left_semi")
    x, y = rows.alias("x"), rows.alias("y")
    rest = F.least(F.col("x.e") - F.col("x.place"), F.col("y.e") - F.col("y.place"))
    able = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.id") > F.col("y.id"))
        & (F.col("x.c") != F.col("y.c"))
        & (OF * F.least("x.n", "y.n") >= NUMBER * F.greatest("x.n", "y.n"))
        & ((OF + NUMBER) * rest >= NUMBER * (F.col("x.n") + F.col("y.n")))
    )
    found = x.join(y, able).groupBy(F.col("x.id").alias("u"), F.col("y.id").alias("v"), F.col("x.c").alias("cu"), F.col("y.c").alias("cv"))
    return found.agg((F.count(F.lit(1)) / F.min(F.col("x.n") + F.col("y.n"))).alias("shared"))


def _linked(pairs: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Links that hold together what similar pairs of different components hold together.

    In early rounds two pairs of each component are verified, the one that shares most prefix tokens
    for its size and the one with the smallest component; components found similar are merged, so that most pairs within large groups of near copies
    need no verification. Then all pairs still between two components are verified.
    """
    found = []
    for _ in range(EARLY_ROUNDS):
        ends = pairs.select("u", "v", "cu", "cv", "shared", F.explode(F.array("cu", "cv")).alias("c"))
        pair = F.struct("u", "v", "cu", "cv")
        chosen = ends.groupBy("c").agg(F.max_by(pair, "shared").alias("a"), F.min_by(pair, F.col("cu") + F.col("cv")).alias("b"))
        best = written(chosen.select(F.explode(F.array("a", "b")).alias("p")).select("p.*").distinct(), "best")
        links = written(_verified(best, sets).distinct().join(best, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v")), "links")
        found.append(links)
        if links.limit(1).count() == 0:
            break
        merged = hooked(links)
        for side in ("cu", "cv"):
            pairs = pairs.join(merged.select(F.col("node").alias(side), F.col("component").alias("m")), side, "left").withColumn(side, F.coalesce("m", side)).drop("m")
        pairs = written(pairs.filter("cu <> cv").join(best.select("u", "v"), ["u", "v"], "left_anti"), "pairs")
    return [*found, _verified(pairs, sets)]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` of every row of ``df``.

    A text's set is that of its distinct runs of ``k`` words (A-Z lower-cased); a shorter text is one
    run, one without words has an empty set and no links. Two texts are linked at a Jaccard similarity of
    0.75 or more; ``component_id`` is the smallest id that links reach. Repeated ids are one node,
    with the links of all its rows; null ids are one node too, before all others, and its id stays
    null. No row is left out; an empty table gives an empty table; other columns are ignored.

    Equal sets are one set. Tokens are put in two global orders, both by classes of
    estimated frequency (counted over all texts in a sketch of fixed size, so that passages common to
    many texts come last) and within a class by different hashes. Two similar sets share a token
    in their prefixes under every order. Sets that share too few tokens with all others go no
    further. Then sets are compared with the most central one that has the same first token, which
    ties large groups of near copies together without forming their pairs. Last, all pairs of different components that share prefix tokens under the
    first order are intersected with those under the second, and verified, two pairs a
    component at a time first. The driver sees the
    sketch (of fixed size) and counts.
    """
    spark = df.sparkSession
    node = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("id")
    nodes = df.select(node, F.col(quoted(text_col)).alias("text"))
    summaries = written(_summaries(nodes, k), "summaries")
    classes = spark.sparkContext.broadcast(_frequency_classes(summaries))
    sized = summaries.filter("n IS NOT NULL").select("id", "n", "s1", "s2")
    groups = written(sized.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("v")), "groups")
    equal = written(sized.join(groups, ["n", "s1", "s2"]).filter("id > v").select(F.col("id").alias("u"), "v").distinct(), "equal")

    alive = written(_alive(nodes, sized, groups, classes, k), "alive")
    sets = written(_able_sets(_wanted(nodes, alive), sized, k), "sets")
    first = _shared(_prefixes(sets, classes, ORDERS[0]), "prefixes")
    second = _shared(_prefixes(sets, classes, ORDERS[1]), "prefixes")
    dropped(alive, groups)

    stars = _stars(_smallest(sets))
    early = written(_verified(stars.join(equal, ["u", "v"], "left_anti"), sets), "links").unionAll(equal.select("u", "v"))
    labels = written(hooked(early).withColumnRenamed("node", "id"), "labels")
    both = written(_candidates(first, labels).join(_candidates(second, labels), ["u", "v"], "left_semi"), "candidates")
    dropped(first, second, labels)
    tied = early
    for links in _linked(both, sets):
        tied = tied.unionAll(links)
    tied = written(tied, "tied")
    dropped(sets, both)
    final = components(tied).withColumnRenamed("node", "id")

    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = sized.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(real("id").alias("id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (null first), with the columns of ``docs``.

    Rows of a repeated id are told apart: if there are any, rows are numbered in a table, and these
    numbers are the nodes.
    """
    short_batches(spark)
    node = F.coalesce(F.col(quoted("doc_id")).cast("long"), F.lit(NO_ID)).alias("id")
    if not docs.select(node).groupBy("id").count().filter("count > 1").limit(1).count():
        found = near_duplicates(docs)
        gone = found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("gone_id")).distinct()
        return docs.join(gone, docs[quoted("doc_id")] == gone["gone_id"], "left_anti")
    rows = written(packed(docs).withColumn("id", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select("id", F.col("r")["text"].alias("text")), "id")
    order = F.struct(F.col("r")["doc_id"].cast("long").alias("doc_id"), "id")  # a null comes first
    kept = found.join(rows.select("id", order.alias("o")), "id").groupBy("component_id").agg(F.min("o").alias("o"))
    return rows.join(kept.select(F.col("o.id").alias("id")), "id", "left_semi").select("r.*")


QUERIES = {"op4_jaccard_join": (op4_jaccard_join, None)}
