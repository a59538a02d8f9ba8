"""Toxic documents by a subsequence string-kernel machine."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.common import give_back, quoted, read, short_batches, tidy
from tapeledger.llm.wordhash import IS_SPACE, LOWERED, chunks, mixed, powers

DECAY = 0.6  # weight of a subsequence for each letter it spans
SPAN = 9  # letters that a subsequence spans at most
LONGEST = 24  # letters of a word looked at together; a longer word is looked at in overlapping windows
SAMPLE_DOCS = 2500  # labelled documents of each label that the machine is trained on, at most
SAMPLE_CHARS = 20_000  # code points of a document of the sample, at most
NEGATIVES = 12_000  # clean words in the training set, at most
LANDMARKS = 160
THRESHOLD = 0.7
SURE = 0.75  # share of toxic texts among those with a run of letters, from which it is a first witness
CLEAN_SHARE = 0.2  # a witness is at most this much as common in clean texts as in toxic ones
FOLDS = 3  # parts of the sample, for the calibration
BORDER = 0.3  # margin from which a word is a witness afterwards

# Letters a-z are 1 to 26, bytes of other letters 27 to 58; all else but white space is left out, so
# that a word with stops or signs put between its letters is the word.
LETTERS = 59
CODES = np.full(256, 255, np.uint8)
CODES[97:123] = np.arange(1, 27)
CODES[128:] = 27 + (np.arange(128, 256) & 31)
CODES = CODES[LOWERED]
CODES[IS_SPACE] = 0


def _triples(length: int) -> list[tuple[int, int, int, float]]:
    """Places of the subsequences of three letters, and their weight in a word of this length."""
    if length < 3:  # a short word is padded with code 0 to three letters
        return [(0, 1, 2, 1.0)]
    found = [(i, j, k, DECAY ** (k - i + 1)) for i in range(length) for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)]
    norm = float(np.sqrt(sum(w * w for *_, w in found)))
    return [(i, j, k, w / norm) for i, j, k, w in found]


TRIPLES = {n: _triples(n) for n in range(1, LONGEST + 1)}


def _cells(codes: np.ndarray, triple: tuple) -> np.ndarray:
    i, j, k, _ = triple
    return (codes[:, i].astype(np.int32) * LETTERS + codes[:, j]) * LETTERS + codes[:, k]


def expand(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of the gap-weighted subsequence kernel of order three, normalised, one row a word.

    Returns the features that some word has, and a column of values for each.
    """
    found: list[tuple[int, int, float]] = []
    for r, word in enumerate(words):
        codes = np.frombuffer(word.ljust(3, b"\0"), np.uint8)[None, :LONGEST]
        found += [(r, int(_cells(codes, t)[0]), t[3]) for t in TRIPLES[min(len(word), LONGEST)]]
    rows, cells, values = (np.array(x) for x in zip(*found, strict=True))
    features, at = np.unique(cells, return_inverse=True)
    out = np.zeros((len(words), len(features)), np.float32)
    np.add.at(out, (rows, at), values)
    return features, out


def _by_length(lengths: np.ndarray):
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(1, LONGEST + 2))
    for n in range(1, LONGEST + 1):
        if bounds[n] > bounds[n - 1]:
            yield n, order[bounds[n - 1] : bounds[n]]


def apply_table(table: np.ndarray, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sum of ``table`` over the subsequences of each word: its inner product with the machine's weight vector.

    ``table`` is a vector over the features, or has a column for each landmark and, by ``rows``, a row
    for each feature that landmarks have.
    """
    out = np.zeros((len(starts), *table.shape[1:]), np.float32)
    padded = np.concatenate([stream, np.zeros(LONGEST, np.uint8)])
    for n, which in _by_length(lengths):
        for part in np.array_split(which, len(which) // 20_000 + 1):
            codes = padded[starts[part][:, None] + np.arange(max(n, 3))]
            if n < 3:
                codes = np.where(np.arange(3) < n, codes, 0)
            total = out[part]
            for t in TRIPLES[n]:
                cells = _cells(codes, t)
                total += np.float32(t[3]) * table[cells if rows is None else rows[cells]]
            out[part] = total
    return out


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts: a stream of letter codes, and row, start and length of each word in it.

    Letters that stand alone one after another count as one word. Words over ``LONGEST`` letters
    appear as overlapping windows that cover them.
    """
    n_rows = len(offsets) - 1
    rows = np.repeat(np.arange(n_rows), np.diff(offsets))
    codes = np.zeros(len(data) + n_rows, np.uint8)
    codes[np.arange(len(data)) + rows] = CODES[data]
    ends = np.zeros(len(codes), bool)
    ends[offsets[1:] + np.arange(n_rows)] = True  # a gap after each row
    row_of = np.cumsum(ends) - ends
    keep = codes != 255
    codes, row_of, ends = codes[keep], row_of[keep], ends[keep]
    gap = codes == 0
    again = np.zeros(len(codes), bool)
    again[1:] = gap[1:] & gap[:-1] & ~ends[1:] & ~ends[:-1]
    codes, row_of, ends = codes[~again], row_of[~again], ends[~again]
    gap = codes == 0
    spaces = np.flatnonzero(gap)
    before = np.diff(np.concatenate([[-1], spaces])) - 1  # letters between a gap and the one before it
    after = np.concatenate([before[1:], [0]]) if len(before) else before
    joint = spaces[(before == 1) & (after == 1) & ~ends[spaces]]
    keep = np.ones(len(codes), bool)
    keep[joint] = False
    codes, row_of = codes[keep], row_of[keep]
    gap = codes == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    long = np.flatnonzero(lengths > LONGEST)
    if len(long):
        half = LONGEST // 2
        more_at, more_n = [], []
        for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
            at = np.append(np.arange(s, s + n - LONGEST, half), s + n - LONGEST)
            more_at.append(at)
            more_n.append(np.full(len(at), LONGEST))
        keep = np.ones(len(starts), bool)
        keep[long] = False
        starts, lengths = np.concatenate([starts[keep], *more_at]), np.concatenate([lengths[keep], *more_n])
        order = np.argsort(starts, kind="stable")
        starts, lengths = starts[order], lengths[order]
    return codes, row_of[starts], starts, lengths


@dataclass
class Machine:
    """The weight vector as a table over subsequences, and the calibration from margin to probability."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, column: pa.Array) -> np.ndarray:
        """The largest margin of any word of each text; of a text without words, that of no evidence."""
        out = []
        for _, data, offsets in chunks(column):
            n = len(offsets) - 1
            best = np.full(n, self.bias, np.float32)
            stream, rows, starts, lengths = letter_words(data, offsets)
            if len(starts):
                # A word is scored once a chunk, by its hash.
                up, down = powers(len(stream))
                sums = np.zeros(len(stream) + 1, np.uint64)
                np.cumsum(mixed(stream.astype(np.uint64), 3) * up[: len(stream)], out=sums[1:])
                hashes = (sums[starts + lengths] - sums[starts]) * down[starts]
                _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                scores = apply_table(self.table, stream, starts[first], lengths[first])[which] + np.float32(self.bias)
                at = np.flatnonzero(np.diff(rows, prepend=-1))
                best[rows[at]] = np.maximum(best[rows[at]], np.maximum.reduceat(scores, at))
            out.append(best)
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        z = np.clip(self.slope * self.margins(column).astype(np.float64) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 25) -> np.ndarray:
    """A linear machine by Newton steps on the squared hinge loss; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        g = ridge @ w - c * (x[on] * (weight[on] * y[on] * slack[on])[:, None]).sum(0)
        h = ridge + c * (x[on] * weight[on][:, None]).T @ x[on]
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a calibration curve, with targets kept off 0 and 1."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - t) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(texts: list[str], toxic: list[int], seed: int = 42) -> Machine:
    """Fit a machine to labelled texts.

    Only whole texts are labelled, so a toxic text is a bag of words of which at least one is an
    insult: its first witness is the word with the run of letters that tells the labels apart best,
    later ones are the words with the largest margin. A toxic text without a clear witness teaches
    nothing, as labels may be wrong. Clean texts give the negative words, those
    nearest to the border first. A subsequence kernel compares words; landmarks (witnesses and
    clean words) span the approximated feature space in which a linear machine is fitted. Its
    weights are then added up into one table over subsequences, so that scoring costs the same
    for any number of landmarks. The margins that the calibration sees are those of machines that were
    not fitted to the text: each of ``FOLDS`` parts of the sample is judged by one fitted to the others.

    The kernel is of order three over letters a-z and 32 codes for bytes of other letters; digits and ASCII signs are
    left out, and a subsequence spans ``SPAN`` letters at most.
    """
    if not texts or len(set(toxic)) < 2:
        return Machine(np.zeros(LETTERS**3, np.float32), 0.0, 1e-3, 30.0 if toxic and all(toxic) else -30.0)
    column = pa.array(texts, pa.large_string())
    y = np.array(toxic)
    bags: list[list[bytes]] = [[] for _ in texts]
    known: dict[bytes, bytes] = {}  # each word once in memory, however many texts hold it
    for first, data, offsets in chunks(column):
        stream, rows, starts, lengths = letter_words(data, offsets)
        raw = stream.tobytes()
        for r, s, n in zip(rows.tolist(), starts.tolist(), lengths.tolist(), strict=True):
            word = raw[s : s + n]
            bags[first + r].append(known.setdefault(word, word))
        for r in set(rows.tolist()):
            bags[first + r] = list(dict.fromkeys(bags[first + r]))
    del known
    # Folds by rank within each label, so that every fold has its share of a rare label.
    fold = np.zeros(len(y), np.int64)
    for v in (0, 1):
        fold[y == v] = np.arange((y == v).sum()) % FOLDS
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        out = np.flatnonzero(fold == f)
        if len(set(y[fold != f])) == 2 and len(out):
            margin[out] = _fitted(bags, y, fold != f, seed).margins(column.take(pa.array(out)))
            give_back()
    machine = _fitted(bags, y, np.ones(len(y), bool), seed)
    told = (y == 0) | (margin > np.quantile(margin[y == 0], 0.9))
    machine.slope, machine.shift = _logistic(margin[told], y[told])
    return machine


def _fitted(bags: list[list[bytes]], y: np.ndarray, fit: np.ndarray, seed: int) -> Machine:
    """A machine fitted to some of the texts, not calibrated."""
    runs = lambda i: {w[j : j + 4] for w in bags[i] for j in range(max(1, len(w) - 3))}
    pieces = [Counter(), Counter()]
    for i in np.flatnonzero(fit & (y == 1)):
        pieces[1].update(runs(i))
    for i in np.flatnonzero(fit & (y == 0)):  # only what toxic texts hold is asked for
        pieces[0].update(r for r in runs(i) if r in pieces[1])
    n0, n1 = max(1, int((y[fit] == 0).sum())), max(1, int((y[fit] == 1).sum()))

    def surely(word: bytes) -> tuple[float, int]:
        """How surely the best run of four letters in a word means the label, and how many texts say so."""
        best = (0.0, 0)
        for j in range(max(1, len(word) - 3)):
            seen = pieces[1][word[j : j + 4]]
            best = max(best, (seen / (seen + pieces[0][word[j : j + 4]] * n1 / n0 + 1), seen))
        return best

    held = [Counter(w for i in np.flatnonzero(fit & (y == v)) for w in bags[i]) for v in (0, 1)]
    # A word that clean texts hold as well is no insult.
    able = {w for w, seen in held[1].items() if held[0][w] * n1 <= CLEAN_SHARE * seen * n0}
    positive = [i for i in np.flatnonzero(fit & (y == 1)) if any(w in able for w in bags[i])]
    bags = {i: [w for w in bags[i] if w in able] for i in positive}
    found = {i: max((surely(w), w) for w in bags[i]) for i in positive}
    witness = {i: w for i, ((sure, _), w) in found.items() if sure >= SURE} or {i: w for i, (_, w) in found.items()}
    del pieces
    clean = sorted(held[0])
    random = np.random.default_rng(seed)
    chosen = [clean[i] for i in random.permutation(len(clean))[: NEGATIVES // 2]]
    if not chosen or not positive:
        return Machine(np.zeros(LETTERS**3, np.float32), 0.0, 1e-3, 0.0)
    all_words = sorted({w for i in positive for w in bags[i]} | set(clean))
    index = {w: i for i, w in enumerate(all_words)}
    at = np.cumsum([0, *[len(w) for w in all_words]])
    stream = np.frombuffer(b"".join(all_words), np.uint8)
    lengths = np.diff(at)
    machine = None
    for _ in range(4):
        counts = Counter(witness.values())
        insults = sorted(counts, key=lambda w: (-counts[w], w))
        marks = list(dict.fromkeys(insults[: LANDMARKS * 3 // 4] + chosen[-LANDMARKS // 4 :]))
        cells, features = expand(marks)
        gram = (features @ features.T).astype(np.float64)
        values, vectors = np.linalg.eigh(gram)
        good = values > 1e-4 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        members = insults + chosen
        ids = np.array([index[w] for w in members])
        lookup = np.zeros(LETTERS**3, np.int32)
        lookup[cells] = np.arange(1, len(cells) + 1)
        by_feature = np.concatenate([np.zeros((1, len(marks)), np.float32), features.T])
        kernel = apply_table(by_feature, stream, at[ids], lengths[ids], lookup)
        x = np.concatenate([kernel @ root, np.ones((len(ids), 1))], 1)
        target = np.concatenate([np.ones(len(insults)), -np.ones(len(chosen))])
        weight = np.concatenate([[counts[w] / len(witness) for w in insults], [held[0][w] / n0 for w in chosen]]) * 1000
        w = _squared_hinge(x, target, weight)
        table = np.zeros(LETTERS**3, np.float32)
        table[cells] = (root @ w[:-1]) @ features
        margins = apply_table(table, stream, at[:-1], lengths) + w[-1]
        machine = Machine(table, float(w[-1]), 1.0, 0.0)
        found = {i: max(bags[i], key=lambda b: margins[index[b]]) for i in positive}
        witness = {i: w for i, w in found.items() if margins[index[w]] > BORDER} or witness
        near = sorted(clean, key=lambda b: -margins[index[b]])[: NEGATIVES // 4]
        chosen = list(dict.fromkeys(chosen[: NEGATIVES // 2] + near + chosen[NEGATIVES // 2 :]))[:NEGATIVES]
    return machine


def training_fold(doc_id) -> object:
    """True for rows that labels may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, seed: int = 42) -> Machine:
    """A machine fitted to at most ``SAMPLE_DOCS`` labelled documents of each label, by hash of the id.

    Labels of null, and of ids outside the training fold, are not used. The sample is bounded in
    documents and in code points of each, so it fits the driver whatever the size of the tables.
    """
    known = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).filter(training_fold(F.col("doc_id")) & F.col("y").isin(0, 1))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(seed), F.col("i"))
    sample = [known.filter(F.col("y") == v).orderBy(order, "i").limit(SAMPLE_DOCS) for v in (0, 1)]
    sample = F.broadcast(sample[0].unionByName(sample[1]))
    texts = docs.select(F.col("doc_id").alias("i"), "text").filter(F.length("text") <= SAMPLE_CHARS)
    rows = sorted((r["i"], r["text"], r["y"]) for r in texts.join(sample, "i").select("i", "text", "y").collect())
    order = np.random.default_rng(seed).permutation(len(rows))
    sample = [rows[i][1] for i in order], [rows[i][2] for i in order]
    del rows
    give_back()
    machine = train(*sample, seed)
    del sample
    give_back()
    return machine


def score_texts(df: DataFrame, machine: Machine, score_col: str = "score", text_col: str = "text", keep: float | None = None) -> DataFrame:
    """``df`` with a toxicity score from 0 to 1; with ``keep``, only rows that score below it, without the score.

    The score of a text is that of its most insulting word and looks at every word; null and empty
    texts get the score of no evidence. A column named like the score is replaced.
    """
    columns = [c for c in df.columns if c.lower() != score_col.lower()] if keep is None else df.columns
    source = df.select(*[quoted(c) for c in df.columns])
    schema = source.select(*[quoted(c) for c in columns]).schema
    place = df.columns.index(text_col)
    chosen = [df.columns.index(c) for c in columns]
    if keep is None:
        schema = schema.add(score_col, "double")

    def run(batches):
        for batch in batches:
            scores = machine.scores(batch.column(place))
            arrays = [batch.column(i) for i in chosen]
            names = [batch.schema.names[i] for i in chosen]
            if keep is None:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores)], names=[*names, score_col])
            else:
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(scores < keep))

    return source.mapInArrow(tidy(run), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fitted(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score_texts(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, with all their columns whatever their names; null and empty texts stay."""
    short_batches(spark)
    machine = fitted(docs, read(spark, sf_dir, "labels"))
    return score_texts(docs, machine, keep=THRESHOLD)


QUERIES = {"op8_toxicity": (op8_toxicity, None)}
