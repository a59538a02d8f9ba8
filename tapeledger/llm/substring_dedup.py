"""Long repeated substrings, by sorting sampled suffixes and inducing the rest from them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeledger.llm.common import packed, quoted, read, unpacked, written
from tapeledger.llm.wordhash import CHUNK, VALUES, mixed, powers, utf8

LENGTH = 100  # bytes of a repeat
GRAM = 32  # bytes by which suffixes are sampled
BLOCK = 200_000  # rows reduced together before they are shuffled: seven numbers each, sorted, so some 40 MB in a task
HOT = 512  # contexts of one gram in a block from which the gram is dealt over SALTS tasks
SALTS = 64
MASK_BITS = 1 << 20
NO_ID = -(1 << 63)
OURS = ["n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"]

REP, OPEN, MARKER, SPAN = 0, 1, 2, 3
SUFFIX = ["h", "salt", "r", "lead", "more", "id", "dup", "at", "kind"]
SUFFIX_ROWS = "h long, salt int, r long, lead int, more int, id long, dup int, at long, kind int"
FOUND = "id long, dup int, a long, b long, open boolean"
WINDOW_ROWS = "h long, g int, id long, dup int, at long, until long"


def _text_parts(data: np.ndarray, offsets: np.ndarray):
    """Row, first byte and bytes of texts, a long one in parts that overlap by a window less a byte; short ones are left out."""
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        for at in range(a, b - LENGTH + 1, CHUNK // 2):
            yield row, at - a, data[at : min(b, at + CHUNK // 2 + LENGTH - 1)]


def _gathered(parts):
    """Parts put together to about half a chunk of bytes: rows, first bytes, bytes and offsets."""
    rows, firsts, held, size = [], [], [], 0
    for row, first, part in parts:
        if held and size + len(part) > CHUNK // 2 + LENGTH:
            yield np.array(rows), np.array(firsts), np.concatenate(held), np.cumsum([0, *map(len, held)])
            rows, firsts, held, size = [], [], [], 0
        rows.append(row)
        firsts.append(first)
        held.append(part)
        size += len(part)
    if held:
        yield np.array(rows), np.array(firsts), np.concatenate(held), np.cumsum([0, *map(len, held)])


def _sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sums[b] - sums[a]) * powers(len(sums))[1][a]


def sampled_suffixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The suffixes that windows of ``LENGTH`` bytes are induced from.

    Each window is assigned to the start of its gram of least hash, the leftmost if several have
    it. Equal windows so have their suffix at the same place, wherever they are. Returns part, hash
    of the gram, hash of all bytes of its windows, start of the gram, first and last window.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return (empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    sums = _sums(data, VALUES)
    starts = np.arange(n - GRAM + 1)
    gram = mixed(_hash(sums, starts, starts + GRAM), 31)
    key = (gram & np.uint64(2**64 - 2**20)) | starts.astype(np.uint64)
    span, reach = LENGTH - GRAM + 1, 1
    least = key
    while reach * 2 <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    windows = np.arange(len(least))
    part = np.searchsorted(offsets, windows, side="right") - 1
    inside = windows + LENGTH <= offsets[part + 1]
    windows, part, place = windows[inside], part[inside], (least[inside] & np.uint64(2**20 - 1)).astype(np.int64)
    if not len(windows):
        return (empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    fresh = np.flatnonzero(np.diff(place, prepend=-1) != 0)
    first, last = windows[fresh], windows[np.append(fresh[1:], len(windows)) - 1]
    content = mixed(_hash(sums, first, last + LENGTH), 32) + (last - first).astype(np.uint64)
    return part[fresh], gram[place[fresh]], content, place[fresh], first, last


def _sorted(held: list[tuple], n: int, keys) -> list[np.ndarray]:
    """What was gathered as one sorted column after the other; ``held`` is emptied first, so rows are in memory once and a half."""
    cols = []
    for i in range(n):
        cols.append(np.concatenate([part[i] for part in held]))
    held.clear()
    order = np.lexsort(keys(cols))
    for i in range(n):
        cols[i] = cols[i][order]
    return cols


def _suffix_rows(batches):
    """Sampled suffixes of all texts, those of equal context reduced to the first of a block.

    Of suffixes with one gram and one context, all but the first are repeats whatever the rest of
    the corpus holds: their windows go on as spans. A gram with very many contexts in the block is
    dealt over several tasks; a marker tells its own task that it has more contexts elsewhere.
    """
    held, count = [], 0

    def flush():
        h, r, lead, more, ids, dups, at = _sorted(held, 7, lambda c: (c[6], c[5], c[4], c[3], c[2], c[1], c[0]))
        new_gram = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_gram.copy()
        new[1:] |= (r[1:] != r[:-1]) | (lead[1:] != lead[:-1]) | (more[1:] != more[:-1])
        group = np.cumsum(new_gram) - 1
        hot = np.bincount(group, weights=new)[group] >= HOT
        kind = np.where(new, np.where(hot, OPEN, REP), SPAN)
        salt = np.where(hot, 1 + (r % np.uint64(SALTS)).astype(np.int64), 0)
        marks = np.flatnonzero(new_gram & hot)
        key = np.where(new, h, mixed(ids.astype(np.uint64) + at.astype(np.uint64), 41))
        yield _batch(
            np.concatenate([key, h[marks]]).view(np.int64), np.concatenate([salt, np.zeros(len(marks), np.int64)]), np.concatenate([r, np.zeros(len(marks), np.uint64)]).view(np.int64),
            np.concatenate([lead, np.full(len(marks), -1)]), np.concatenate([more, np.zeros(len(marks), np.int64)]), np.concatenate([ids, np.zeros(len(marks), np.int64)]),
            np.concatenate([dups, np.zeros(len(marks), np.int64)]), np.concatenate([at, np.zeros(len(marks), np.int64)]), np.concatenate([kind, np.full(len(marks), MARKER)]),
        )

    for batch in batches:
        ids, dups = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for rows, firsts, data, offsets in _gathered(_text_parts(*utf8(batch.column(2)))):
            part, gram, content, place, first, last = sampled_suffixes(data, offsets)
            held.append((gram, content, place - first, last - first, ids[rows[part]], dups[rows[part]], first - offsets[part] + firsts[part]))
            count += len(gram)
            if count >= BLOCK:
                yield from flush()
                count = 0
    if count:
        yield from flush()


def _batch(*columns) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types, strict=True)], names=SUFFIX)


def _found_batch(ids, dups, a, b, is_open) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.astype(np.int64)), pa.array(dups.astype(np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(is_open.astype(bool))],
        names=["id", "dup", "a", "b", "open"],
    )


def _compared(batches):
    """Suffixes in sorted order, each compared with its neighbour.

    One whose context equals its neighbour's is a repeat: the bytes of its windows are a span to
    remove. The first ones of different contexts of a gram share no whole context, but may share
    windows: they are open. A gram with one context is unique. Only the last suffix and its gram's
    state are kept from one batch to the next.
    """
    last, classes, flagged, pending = None, 0, False, None
    for batch in batches:
        c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(SUFFIX)}
        spans = c["kind"] == SPAN
        if spans.any():
            a = c["at"][spans]
            yield _found_batch(c["id"][spans], c["dup"][spans], a, a + c["more"][spans] + LENGTH, np.zeros(len(a)))
        c = {n: v[~spans] for n, v in c.items()}
        n = len(c["h"])
        if not n:
            continue
        key = np.stack([c["h"], c["salt"].astype(np.int64)])
        context = np.stack([c["r"], c["lead"].astype(np.int64), c["more"].astype(np.int64)])
        new_gram, new = np.ones(n, bool), np.ones(n, bool)
        new_gram[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        new[1:] = new_gram[1:] | (context[:, 1:] != context[:, :-1]).any(0)
        if last is not None:
            new_gram[0] = tuple(key[:, 0]) != last[0]
            new[0] = new_gram[0] or tuple(context[:, 0]) != last[1]
        group = np.cumsum(new_gram)  # 0: goes on from the batch before
        marker = c["kind"] == MARKER
        size = int(group[-1]) + 1
        seen = np.bincount(group, weights=new, minlength=size)
        told = np.bincount(group, weights=c["kind"] != REP, minlength=size) > 0
        seen[0] += classes
        told[0] |= flagged
        several = told | (seen >= 2)
        first = new & ~marker
        is_open = first & several[group]
        again = ~new & ~marker
        if pending is not None and several[0]:
            yield _found_batch(*(np.array([v]) for v in pending), np.ones(1))
            pending = None
        out = is_open | again
        b = c["at"] + c["more"] + np.where(is_open, 0, LENGTH)
        yield _found_batch(c["id"][out], c["dup"][out], c["at"][out], b[out], is_open[out])
        end = size - 1
        if end > 0:
            pending = None
        if not several[end]:
            mine = np.flatnonzero(first & (group == end))
            if len(mine):
                i = mine[0]
                pending = (c["id"][i], c["dup"][i], c["at"][i], b[i] - LENGTH)
        else:
            pending = None
        classes, flagged = min(int(seen[end]), 2), bool(told[end])
        last = (tuple(key[:, -1]), tuple(context[:, -1]))


_OTHER = mixed(np.arange(256, dtype=np.uint64), 77)


def _window_rows(batches):
    """Hashes of the windows of open suffixes; those that repeat in a block as spans, without a hash.

    Windows go on in the order of the texts, so that rows next to each other differ in little but the hash.
    """
    held, count = [], 0

    def flush():
        h, g, ids, dups, at = (np.concatenate([part[i] for part in held]) for i in range(5))
        held.clear()
        order = np.lexsort((at, dups, ids, g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        kept = np.sort(order[new])
        yield batch_of(h[kept], g[kept], ids[kept], dups[kept], at[kept], np.zeros(len(kept), np.int64))
        order = order[~new]
        ids, dups, at = ids[order], dups[order], at[order]
        if len(at):
            order = np.lexsort((at, dups, ids))
            ids, dups, at = ids[order], dups[order], at[order]
            begin = np.ones(len(at), bool)
            begin[1:] = (ids[1:] != ids[:-1]) | (dups[1:] != dups[:-1]) | (at[1:] > at[:-1] + LENGTH)
            ends = at[np.append(np.flatnonzero(begin)[1:], len(at)) - 1] + LENGTH
            ids, dups, at = ids[begin], dups[begin], at[begin]
            yield batch_of(mixed(ids.astype(np.uint64) + at.astype(np.uint64), 43), np.zeros(len(at), np.int64), ids, dups, at, ends)

    def batch_of(h, g, ids, dups, at, until):
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(g.astype(np.int32)), pa.array(ids), pa.array(dups.astype(np.int32)), pa.array(at), pa.array(until)],
            names=["h", "g", "id", "dup", "at", "until"],
        )

    for batch in batches:
        ids, dups = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = utf8(batch.column(2))
        for row in range(len(ids)):
            text, ranges = data[offsets[row] : offsets[row + 1]], batch.column(3)[row].values
            a, b = np.sort(ranges.field(0).to_numpy()), np.sort(ranges.field(1).to_numpy())
            # Ranges of windows do not overlap, but for those of a suffix cut between parts.
            steps = np.repeat(a - np.concatenate([[0], np.cumsum(b - a + 1)[:-1]]), b - a + 1) + np.arange((b - a + 1).sum())
            steps = np.unique(steps)
            for part in np.array_split(steps, len(steps) // (CHUNK // 2) + 1):
                if not len(part):
                    continue
                low = int(part[0])
                piece = text[low : int(part[-1]) + LENGTH]
                at = part - low
                h = mixed(_hash(_sums(piece, VALUES), at, at + LENGTH), 33)
                g = (mixed(_hash(_sums(piece, _OTHER), at, at + LENGTH), 34) >> np.uint64(33)).astype(np.int64)
                held.append((h, g, np.full(len(part), ids[row]), np.full(len(part), dups[row]), part))
                count += len(part)
                if count >= BLOCK:
                    yield from flush()
                    count = 0
    if count:
        yield from flush()


def _repeated_windows(batches):
    """Spans of windows in sorted order that equal the window before."""
    last = None
    for batch in batches:
        h, g, ids, dups, at, until = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        spans = until > 0
        again = np.zeros(len(h), bool)
        keep = np.flatnonzero(~spans)
        if len(keep):
            kh, kg = h[keep], g[keep]
            same = np.zeros(len(keep), bool)
            same[1:] = (kh[1:] == kh[:-1]) & (kg[1:] == kg[:-1])
            same[0] = last == (kh[0], kg[0])
            again[keep] = same
            last = (kh[-1], kg[-1])
        out = spans | again
        yield _found_batch(ids[out], dups[out], at[out], np.where(spans, until, at + LENGTH)[out], np.zeros(int(out.sum())))


def _dealt_windows(windows: DataFrame) -> DataFrame:
    """Windows sorted by hash and place, equal ones in one task.

    They are the most that is on disk at once, so they move as four numbers, of which only the hash and
    the place in the text differ from one row to the next: places and lengths are below 2^31, as is ``g``.
    """
    high = lambda c, low: F.shiftleft(F.col(c).cast("long"), 32).bitwiseOR(low.cast("long"))
    length = F.when(F.col("until") > 0, F.col("until") - F.col("at")).otherwise(0)
    narrow = windows.select("id", high("g", length).alias("g"), "h", high("dup", F.col("at")).alias("place"))
    narrow = narrow.repartition("h").sortWithinPartitions("h", "g", "id", "place")
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    until = F.when(low("g") > 0, low("place") + low("g")).otherwise(0)
    return narrow.select("h", F.shiftright("g", 32).cast("int").alias("g"), "id", F.shiftright("place", 32).cast("int").alias("dup"), low("place").alias("at"), until.alias("until"))


def _cell(bits: int = MASK_BITS):
    slot = F.pmod(F.xxhash64("id", "dup"), F.lit(bits))
    return (slot / 32).cast("int"), F.expr(f"cast(pmod(pmod(xxhash64(id, dup), {bits}), 32) as int)")


def _masked(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """``nodes`` with ``near``: false only if (id, dup) is not among ``keys``; by a bit mask of fixed size."""
    cell, bit = _cell()
    mask = keys.select(cell.alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    mask = F.broadcast(mask.groupBy("cell").agg(F.bit_or("bits").alias("mask")))
    hit = F.call_function("shiftright", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1
    return nodes.withColumn("cell", cell).join(mask, "cell", "left").withColumn("near", F.coalesce(hit, F.lit(False))).drop("cell", "mask")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte of a text covered by a string of ``LENGTH`` bytes that also starts earlier.

    Earlier means in a smaller id, or before in the same text; strings are judged on the input, so
    overlaps count and nothing depends on what else goes. Returns the rows and columns of ``df`` plus
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_bytes`` (binary, as a cut may
    fall within a character) and ``kept_sha256``; columns of ``df`` with these names are replaced. A
    null text is empty; null ids come before all others; rows that repeat an id are in order of
    their texts. An empty table gives an empty table.

    All windows of ``LENGTH`` bytes are induced from a sample of suffixes, one in about 35 bytes, that
    depends on the bytes around only: a window belongs to the suffix at its gram of least hash. The
    sampled suffixes are sorted externally by gram and context, and neighbours compared: equal
    contexts carry all their windows with them. Only where contexts differ and the gram agrees, at
    the rims of repeats, are single windows hashed (96 bits) and sorted. Texts are shuffled only if they
    have such rims or lose bytes; a text is read in parts, so its length needs no memory.
    """
    columns = df.columns
    r = F.col("r")
    source = packed(df).withColumn("id", F.coalesce(r[id_col].cast("long"), F.lit(NO_ID)))
    if source.groupBy("id").count().filter("count > 1").limit(1).count():
        source = source.withColumn("dup", F.row_number().over(Window.partitionBy("id").orderBy(r[text_col])) - 1)
    else:
        source = source.withColumn("dup", F.lit(0))
    nodes = source.select("id", "dup", r[text_col].alias("text"))
    suffixes = nodes.mapInArrow(_suffix_rows, SUFFIX_ROWS)
    sorted_suffixes = suffixes.repartition("h", "salt").sortWithinPartitions("h", "salt", "r", "lead", "more", "id", "dup", "at")
    found = written(sorted_suffixes.mapInArrow(_compared, FOUND), "suffixes")
    ranges = found.filter("open").groupBy("id", "dup").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    rims = written(ranges, "rims")
    near = _masked(nodes, rims.select("id", "dup")).filter("near").drop("near").join(rims, ["id", "dup"])
    windows = near.mapInArrow(_window_rows, WINDOW_ROWS)
    more = _dealt_windows(windows).mapInArrow(_repeated_windows, FOUND)
    spans = found.filter("NOT open").unionAll(more).select("id", "dup", F.struct("a", "b").alias("s"))
    cuts = written(spans.groupBy("id", "dup").agg(F.collect_list("s").alias("spans")), "spans")
    marked = _masked(source, cuts.select("id", "dup"))
    hit = marked.filter("near").join(cuts, ["id", "dup"], "left").select("r", F.col("r")[text_col].alias("text"), "spans")
    whole = marked.filter("NOT near").select("r", F.col("r")[text_col].alias("text"), F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans"))
    return unpacked(_cut(hit.unionAll(whole)), columns, OURS)


def _cut(texts: DataFrame) -> DataFrame:
    """The kept bytes and counts of texts with their spans."""
    row = texts.schema["r"]
    schema = texts.select("r").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_bytes", "binary").add("kept_sha256", "string")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                spans = batch.column(2)[i]
                kept, n_spans = text, 0
                if spans.is_valid and len(spans):
                    a, b = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, reach = a[order], np.maximum.accumulate(b[order])
                    begin = np.ones(len(a), bool)
                    begin[1:] = a[1:] > reach[:-1]
                    firsts = a[begin]
                    lasts = reach[np.append(np.flatnonzero(begin)[1:], len(a)) - 1]
                    n_spans = len(firsts)
                    kept = np.concatenate([text[x:y] for x, y in zip([0, *lasts.tolist()], [*firsts.tolist(), len(text)], strict=True)])
                raw = kept.tobytes()
                out.append((len(text), len(text) - len(raw), n_spans, raw, hashlib.sha256(raw).hexdigest()))
            n, removed, n_spans, raw, digest = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(raw, pa.binary()), pa.array(digest, pa.string())],
                names=[row.name, *OURS],
            )

    return texts.mapInArrow(run, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op6_suffix_dedup": (op6_suffix_dedup, None)}
