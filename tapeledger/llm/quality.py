"""Quality of documents by ordinal regression on graded ratings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.common import quoted, read
from tapeledger.llm.toxicity import training_fold
from tapeledger.llm.wordhash import LOWERED, VALUES, chunks, mixed, powers, words

WORD_BUCKETS = 1 << 15
SHAPE_BUCKETS = 1 << 12
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS + 1  # the last one counts words that repeat the word before
SAMPLE_DOCS = 3000  # rated documents of each grade that the weights are fitted to, at most
SAMPLE_CHARS = 20_000  # code points of a document of the sample, at most
KEEP = 0.5

# A word's shape: lower-case letters as a, upper-case as A, digits as 9, other letters as a; signs stay.
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[97:123] = 97
SHAPES[65:91] = 65
SHAPES[48:58] = 57
SHAPES[128:] = 97


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the hashed features of some texts.

    Buckets count words, word shapes and repeats; the value is the root of the share of words.
    """
    n_rows = len(offsets) - 1
    rows, hashes, starts, ends = words(data, offsets)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    shape = SHAPES[data]
    turn = np.ones(len(data), bool)
    turn[1:] = (shape[1:] != shape[:-1]) | ~np.isin(shape[1:], [97, 65, 57])
    turn[starts] = True
    at = np.concatenate([[0], np.cumsum(turn)])
    shape = shape[turn]
    up, down = powers(len(shape))
    sums = np.zeros(len(shape) + 1, np.uint64)
    np.cumsum(VALUES[shape] * up[: len(shape)], out=sums[1:])
    shapes = mixed((sums[at[ends]] - sums[at[starts]]) * down[at[starts]], 5)
    again = np.zeros(len(rows), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    bucket = np.concatenate([
        (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64),
        WORD_BUCKETS + (shapes % np.uint64(SHAPE_BUCKETS)).astype(np.int64),
        np.full(int(again.sum()), BUCKETS - 1),
    ])
    row = np.concatenate([rows, rows, rows[again]])
    cells, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
    total = np.bincount(rows, minlength=n_rows)
    row = cells // BUCKETS
    return row, cells % BUCKETS, np.sqrt(counts / total[row])


@dataclass
class Ordinal:
    """Weights of hashed features, shared by all grades, and the ordered thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def evidence(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, data, offsets in chunks(column):
            row, bucket, value = features(data, offsets)
            out.append(np.bincount(row, weights=value * self.weights[bucket], minlength=len(offsets) - 1))
        return np.concatenate(out)

    def tails(self, column: pa.Array) -> np.ndarray:
        """Probability of each grade from 1 up, or a higher one; one row a text."""
        z = self.evidence(column)[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], grades: list[int], n_grades: int, epochs: int = 40, rate: float = 0.15, ridge: float = 2e-5, seed: int = 42) -> Ordinal:
    """Fit weights and thresholds by the likelihood of the cumulative link model.

    The gaps between thresholds are exponentials, so their order holds by construction. Grades
    weigh the same in sum, however many documents have them.
    """
    column, y = pa.array(texts, pa.large_string()), np.array(grades, np.int64)
    cells = [(first + row, bucket, value) for first, data, offsets in chunks(column) for row, bucket, value in [features(data, offsets)]]
    row, bucket, value = (np.concatenate(x) for x in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    n, tops = len(y), max(1, n_grades - 1)
    w, low, gaps = np.zeros(BUCKETS), -1.0, np.zeros(tops - 1)
    cuts = lambda: low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    if not n:
        return Ordinal(w, cuts())
    share = np.bincount(y, minlength=n_grades)
    weight = (1 / np.maximum(share, 1))[y]
    weight /= weight.sum()
    bounds = np.searchsorted(row, np.arange(n + 1))
    random, square = np.random.default_rng(seed), np.full(BUCKETS, 1e-8)
    square_low, square_gaps = 1e-8, np.full(tops - 1, 1e-8)
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(n), max(1, n // 256)):
            spans = bounds[batch + 1] - bounds[batch]
            at = np.repeat(bounds[batch] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            local = np.repeat(np.arange(len(batch)), spans)
            z = np.bincount(local, weights=value[at] * w[bucket[at]], minlength=len(batch))
            theta = np.concatenate([[-np.inf], cuts(), [np.inf]])
            upper = 1 / (1 + np.exp(-np.clip(theta[y[batch] + 1] - z, -30, 30)))
            lower = 1 / (1 + np.exp(-np.clip(theta[y[batch]] - z, -30, 30)))
            mass = np.maximum(upper - lower, 1e-9)
            scale = weight[batch] / weight[batch].sum()
            d_upper, d_lower = scale * upper * (1 - upper) / mass, scale * lower * (1 - lower) / mass
            g = np.bincount(bucket[at], weights=value[at] * (d_upper - d_lower)[local], minlength=BUCKETS) + ridge * w
            by_cut = np.bincount(y[batch], weights=-d_upper, minlength=n_grades)[:tops] + np.bincount(y[batch], weights=d_lower, minlength=n_grades)[1 : tops + 1]
            square += g * g
            w -= rate * g / np.sqrt(square)
            g_low, g_gaps = by_cut.sum(), np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:]
            square_low += g_low**2
            square_gaps += g_gaps**2
            low -= rate * g_low / np.sqrt(square_low)
            gaps = np.clip(gaps - rate * g_gaps / np.sqrt(square_gaps), -5, 3)
    return Ordinal(w, cuts())


def graded(labels: DataFrame) -> DataFrame:
    """Ratings as grades: 0 poor, 1 good but toxic, 2 good; rows without a quality label have none."""
    good = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2)
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, good)
    return labels.select("doc_id", grade.alias("grade")).filter("grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fitted(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, seed: int = 42) -> Ordinal:
    """Weights from at most ``SAMPLE_DOCS`` rated documents of each grade, by hash of the id, of the training fold."""
    known = ratings.select(F.col("doc_id").alias("i"), F.col("grade").alias("y")).filter(training_fold(F.col("doc_id")))
    order = F.xxhash64(F.lit(seed), F.col("i"))
    parts = [known.filter(F.col("y") == g).orderBy(order, "i").limit(SAMPLE_DOCS) for g in range(n_grades)]
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    texts = docs.select(F.col("doc_id").alias("i"), "text").filter(F.length("text") <= SAMPLE_CHARS)
    rows = sorted((r["i"], r["text"], r["y"]) for r in texts.join(F.broadcast(parts[0]), "i").select("i", "text", "y").collect())
    return train([r[1] for r in rows], [r[2] for r in rows], n_grades, seed=seed)


def graded_texts(df: DataFrame, model: Ordinal, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``df`` with ``expected_grade``, ``tail_prob`` (of a grade of 1 or more) and ``kept`` (tail_prob at least ``keep``).

    Looks at every word of every text; null and empty texts are judged without evidence. Columns
    of ``df`` named as ours are replaced. One pass over the rows, nothing is shuffled.
    """
    ours = ["expected_grade", "tail_prob", "kept"]
    columns = [c for c in df.columns if c.lower() not in ours]
    chosen, place = [df.columns.index(c) for c in columns], df.columns.index(text_col)
    schema = df.select(*[quoted(c) for c in columns]).schema.add(ours[0], "double").add(ours[1], "double").add(ours[2], "boolean")

    def run(batches):
        for batch in batches:
            tails = model.tails(batch.column(place))
            arrays = [batch.column(i) for i in chosen]
            arrays += [pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 0] >= keep)]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in chosen] + ours)

    return df.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, graded(read(spark, sf_dir, "labels")))
    return graded_texts(docs, model).select("doc_id", "expected_grade", "tail_prob", "kept")


QUERIES = {"op9_quality": (op9_quality, None)}
