"""Byte-level BPE: texts to token ids by the ranks of a vocabulary file, and ids back to bytes."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tapeledger.llm.common import packed, read, unpacked
from tapeledger.llm.wordhash import utf8

PART = 1 << 16  # code points of a text that are split at a time, or up to the next safe place
FRESH = 1 << 14  # new pieces that are tokenised together
GROUP = 1 << 20  # bytes of texts that are put together before their ids go out
TABLE_CHARS = 1 << 21  # code points of distinct pieces whose ids a task keeps
ENCODED = ["ids", "starts"]
DECODED = ["decoded", "decoded_text"]
LOST = "�".encode()  # what an id outside the vocabulary decodes to

# Blocks in which both splitters know every character alike (tested); the rest is split by the tokenizers library.
SETTLED = regex.compile(r"[\u0000-՗Ḁ-῿ -⁯　-ヿ一-鿿가-힣]*")
# A match of the pattern never goes on from another character into white space.
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f])[ \n]")


def byte_characters() -> list[str]:
    """One visible character for every byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks; a line of the file is a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def build_tokenizer(ranks: dict[bytes, int]) -> Tokenizer:
    """A tokenizer of single pieces that merges as the ranks say.

    Ranks allow any two neighbours to merge whose bytes together are a token, the one of least rank
    first; so every way to cut a token into two tokens becomes a merge, in order of rank. A piece that
    is a token is taken whole.
    """
    shown = byte_characters()
    name = lambda token: "".join(shown[b] for b in token)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
        for cut in range(len(token) - 1, 0, -1):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((name(token[:cut]), name(token[cut:])))
    model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


class ByteTable:
    """The bytes of every id, from the characters that stand for them."""

    def __init__(self, vocab: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_characters())}
        size = max(vocab.values(), default=-1) + 1
        tokens = [LOST] * (size + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Ids, those outside the vocabulary replaced by the last place of the table."""
        last = len(self.lengths) - 1
        return np.where((ids < 0) | (ids >= last), last, ids)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        return self.bytes[spread(self.begins[ids], self.lengths[ids])]


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges that start at ``begins``."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts; each distinct piece is tokenised once as long as the table of pieces is kept."""

    def __init__(self, tokenizer: Tokenizer, pattern: str):
        self.tokenizer = tokenizer
        self.quick = regex.compile(pattern)
        self.exact = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.held = 0

    def learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), FRESH):
            some = pieces[at : at + FRESH]
            self.numbers.update(zip(some, range(len(self.numbers), len(self.numbers) + len(some)), strict=True))
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.lengths = np.concatenate([self.lengths, np.array([len(i) for i in ids], np.int64)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
            self.held += sum(map(len, some))

    def split(self, text: str) -> Iterable[str]:
        """Matches of the pattern in a text, which is split in parts that begin where a match must."""
        at = 0
        while at < len(text):
            cut = SAFE.search(text, at + PART) if len(text) - at > PART else None
            part = text[at : cut.start()] if cut else text[at:]
            at += len(part)
            if part.isascii() or SETTLED.fullmatch(part):
                yield from self.quick.findall(part)
            else:
                yield from (piece for piece, _ in self.exact.pre_tokenize_str(part))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        if self.held > TABLE_CHARS:
            self.forget()
        pieces, sizes = [], []
        for text in texts:
            before = len(pieces)
            pieces.extend(self.split(text))
            sizes.append(len(pieces) - before)
        self.learn(list({p for p in pieces if p not in self.numbers}))
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        which = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        begins, lengths = np.cumsum(self.lengths) - self.lengths, self.lengths[which]
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.flat[spread(begins[which], lengths)], np.diff(upto)


def _groups(column) -> Iterator[tuple[int, int]]:
    """First and last row (excluded) of groups of rows of about ``GROUP`` bytes."""
    _, offsets = utf8(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP, side="right")) - 1)
        yield row, end
        row = end


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _starts(table: ByteTable, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The code point at which each token begins; one that begins within a character begins at that character."""
    lengths = table.lengths[ids]
    lead = (table.joined(ids) & 0xC0) != 0x80
    before = np.cumsum(lead)
    begins = np.cumsum(lengths) - lengths
    points = before[begins] - 1 if len(ids) else np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    base = np.where(counts > 0, points[np.minimum(firsts, max(0, len(points) - 1))] if len(points) else 0, 0)
    return points - np.repeat(base, counts)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """All rows and columns of ``df`` plus ``ids`` and ``starts``: the tokens of each text and where they begin.

    Each match of ``pattern`` is merged for itself by the ranks of the file at ``ranks_path`` (read by the
    driver; the tokenizer, of the size of the vocabulary, travels to the tasks). No special tokens: their
    strings are text like any other. ``starts`` counts code points from 0; a token that begins within
    a character begins at that character. A null or empty text has no tokens; repeated rows are encoded
    each; columns of ``df`` named as ours are replaced; an empty table gives an empty table. ``decoded`` adds
    what ``decode`` makes of the ids, in the same task.

    There is no shuffle. Long texts are split in parts at white space that no match can cross, so memory
    grows with the longest run without any and with the ids of one text.
    """
    spark = df.sparkSession
    tokenizer = build_tokenizer(load_ranks(ranks_path))
    sent = spark.sparkContext.broadcast(tokenizer.to_str())
    rows, ours = packed(df), [*ENCODED, *DECODED] if decoded else ENCODED
    schema = rows.select("r").schema.add("ids", ArrayType(IntegerType())).add("starts", ArrayType(IntegerType()))
    if decoded:
        schema = schema.add("decoded", "binary").add("decoded_text", "string")

    def run(batches):
        # Spark runs a task a core; threads of the library's own would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = Tokenizer.from_str(sent.value)
        encoder, table = Encoder(made, pattern), ByteTable(made.get_vocab())
        for batch in batches:
            column = batch.column(0).field(text_col)
            for a, b in _groups(column):
                ids, counts = encoder.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
                columns = [batch.column(0).slice(a, b - a), _lists(ids, counts), _lists(_starts(table, ids, counts), counts)]
                if decoded:
                    upto = np.concatenate([[0], np.cumsum(counts)])
                    found = [table.joined(ids[i:j]).tobytes() for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                    columns += [pa.array(found, pa.binary()), pa.array([raw.decode("utf-8", "replace") for raw in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["r", *ours])

    return unpacked(rows.mapInArrow(run, schema), df.columns, ours)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """All rows and columns of ``df`` plus ``decoded`` (bytes) and ``decoded_text``.

    The characters that stand for bytes are turned back by the reversed table and the bytes of all
    tokens joined before they are read as UTF-8, so a character split over tokens is whole again;
    in ``decoded_text`` bytes that are no character, as where ids end within one, become U+FFFD. An id
    outside the vocabulary, or null, gives U+FFFD; null ids give null. Columns of ``df`` named as ours are
    replaced; an empty table gives an empty table.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(build_tokenizer(load_ranks(ranks_path)).get_vocab())
    rows = packed(df)
    schema = rows.select("r").schema.add("decoded", "binary").add("decoded_text", "string")

    def run(batches):
        table = ByteTable(sent.value)
        for batch in batches:
            column, row = batch.column(0).field(ids_col), 0
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            while row < batch.num_rows:
                end, size = row, 0
                while end < batch.num_rows and size < GROUP // 4:
                    size += sizes[end]
                    end += 1
                found = [_decoded(table, ids) for ids in column.slice(row, end - row)]
                texts = [None if raw is None else raw.decode("utf-8", "replace") for raw in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(found, pa.binary()), pa.array(texts, pa.string())], names=["r", *DECODED])
                row = end

    return unpacked(rows.mapInArrow(run, schema), df.columns, DECODED)


def _decoded(table: ByteTable, ids: pa.ListScalar) -> bytes | None:
    if not ids.is_valid:
        return None
    values = ids.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return table.joined(table.known(values)).tobytes()


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_byte_bpe": (op12_byte_bpe, None)}
