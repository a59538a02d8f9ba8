"""Benchmark items in documents, up to a number of edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tapeledger.llm.common import quoted, read, short_batches, tidy
from tapeledger.llm.wordhash import IS_SPACE, LOWERED, chunks

ERROR_RATE = 1 / 16  # edits allowed per code point of an item
BLOCK_CHARS = 2_000_000  # code points of items that a task searches for at once


def normalised(data: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
    """Texts with A-Z lower-cased and each run of white space as one space, none at the ends."""
    space = IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1][offsets[:-1] < len(data)]
    keep[starts] = True
    out = np.where(space, np.uint8(32), LOWERED[data])[keep].tobytes()
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield out[a:b].decode("utf-8", "replace").strip(" ")


def normal(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return next(normalised(raw, np.array([0, len(raw)])))


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """The item cut into one piece more than it may have edits: one of them is free of edits in any match."""
    n = int(len(item) * rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item as bit masks: how few edits turn it into some substring of a text (Myers' bit-parallel rows)."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance and the first end at which a substring of ``text`` has it."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score = full, 0, self.length
        least, at, get = score, 0, self.masks.get
        for end, c in enumerate(text, 1):
            eq = get(c, 0)
            low = eq | minus
            diagonal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(diagonal | plus)
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1, down << 1  # a match may begin anywhere, so the first row stays 0
            plus = (down | ~(low | up)) & full
            minus = up & low & full
            if score < least:
                least, at = score, end
        return least, at


class Matcher:
    """Items to look for in texts: an automaton of all their pieces, and patterns to verify with."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = {}
        self.patterns: dict[int, Pattern] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for key, (item_id, item) in enumerate(items):
            self.items[key] = (item_id, item, int(len(item) * rate))
            for at, piece in pieces(item, rate):
                found.setdefault(piece, []).append((key, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """By item: the least distance within its budget and where in the text the match ends."""
        places: dict[int, set[int]] = {}
        for end, (length, owners) in self.automaton.iter(text):
            for key, at in owners:
                # Starts of matches that one window covers count once.
                places.setdefault(key, set()).add((end + 1 - length - at) // (self.items[key][2] + 1))
        out: dict[int, tuple[int, int]] = {}
        for key, starts in places.items():
            item_id, item, budget = self.items[key]
            for start in sorted(starts):
                a = max(0, start * (budget + 1) - budget)
                window = text[a : (start + 1) * (budget + 1) + len(item) + budget]
                hit = window.find(item)
                if hit >= 0:
                    distance, end = 0, hit + len(item)
                else:
                    if key not in self.patterns:
                        self.patterns[key] = Pattern(item)
                    distance, end = self.patterns[key].best(window)
                if distance <= budget and (item_id not in out or (distance, a + end) < out[item_id]):
                    out[item_id] = (distance, a + end)
        return out


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size; items without words are left out."""
    block, held = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        item = normal(row[1])
        if not item:
            continue
        if block and held + len(item) > size:
            yield block
            block, held = [], 0
        block.append((row[0], item))
        held += len(item)
    if block:
        yield block


def _searched(batches, place: int, items: list, rate: float, emit):
    matcher = Matcher(items, rate)
    for batch in batches:
        found = []
        for first, data, offsets in chunks(batch.column(place)):
            for row, text in enumerate(normalised(data, offsets), first):
                if len(text):
                    hits = matcher.matches(text)
                    if hits:
                        found.append((row, hits))
        yield emit(batch, found)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and benchmark item that it contains: id, ``item_id``, ``distance``, ``match_end``.

    A document contains an item if some part of its text is at most ``rate`` times the item's length
    edits away, both with A-Z lower-cased and white space runs as one space. Each item is cut into
    one piece more than that budget; a match leaves one piece unharmed, so exact hits of pieces give
    all candidates, which Myers' bit-parallel distance verifies. ``match_end`` counts code points
    of the normalised document up to the end of the best match; ``item_id`` is of any type. Null and empty documents and items
    match nothing; repeated documents give a row each, repeated items one. The items are searched
    for in blocks of bounded size, with one pass over the documents each; nothing is shuffled.
    """
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    kind = benchmark.schema["item_id"].dataType
    schema = StructType().add("doc_id", "long").add("item_id", kind).add("distance", "integer").add("match_end", "long")
    arrow = to_arrow_type(kind)
    names = ["doc_id", "item_id", "distance", "match_end"]
    out = docs.sparkSession.createDataFrame([], schema)

    def emit(batch, found):
        rows = [(row, item, d, e) for row, hits in found for item, (d, e) in hits.items()]
        at, items, distances, ends = zip(*rows, strict=True) if rows else ((), (), (), ())
        ids = batch.column(0).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(items, arrow), pa.array(distances, pa.int32()), pa.array(ends, pa.int64())], names=names)

    parts = [source.mapInArrow(lambda b, items=block: _searched(b, 1, items, rate, emit), schema) for block in item_blocks(benchmark)]
    for part in parts[1:]:
        parts[0] = parts[0].unionAll(part)
    return parts[0] if parts else out


def without_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    place = docs.columns.index(text_col)

    def emit(batch, found):
        clean = np.ones(batch.num_rows, bool)
        clean[[row for row, _ in found]] = False
        return batch.filter(pa.array(clean))

    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(tidy(lambda b, items=block: _searched(b, place, items, rate, emit)), docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that contain no item of ``benchmark``; null and empty texts stay."""
    short_batches(spark)
    return without_hits(docs, read(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": (op10_decontamination, None)}
