"""Periodic runs: stretches of words that repeat themselves, found on diagonals of equal words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tapeledger.llm.common import WORD, packed, read, unpacked
from tapeledger.llm.wordhash import CHUNK, chunks, mixed, powers, words

LEAST = 12  # words of a run, besides twice its period
SEED = 6  # the fewest words in a row that agree on the diagonal of any run
PAIRS = 1 << 20  # pairs of occurrences looked at together
OURS = ["n_words", "runs", "collapsed"]
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Slices of about ``PAIRS`` in sum."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        yield slice(at, end)
        at = end


class Diagonals:
    """Where diagonals of equal words begin that are long enough for a run.

    A diagonal is a lag and the words that equal the word so far before. ``words`` of all texts lie in one array; ``bounds``
    are the first words of the texts. Word hashes have 64 bits; hashes of stretches only choose which
    diagonals are worth following.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        self.x, n = hashes, len(hashes)
        sizes = np.diff(bounds)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.end = bounds[:-1][self.text], bounds[1:][self.text]
        self.longest = int(sizes.max(initial=0))
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(hashes, 51) * up[:n], out=self.sums[1:])

    def _hash(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and lag of the diagonals, by word and lag.

        Lags from g to 2g - 1 are looked for among occurrences of the same g words less than 2g
        apart, g being powers of two (and six words for lags up to seven): the diagonal of a run agrees
        on that many words. A diagonal begins where the words before differ, so only occurrences
        with different words before them are paired: a text of one word repeated has few such pairs.
        """
        at, found = np.arange(len(self.x)), []
        gram, low, high = SEED, 1, 7
        while len(at) and low * 2 <= self.longest:
            at = at[at + gram <= self.end[at]]
            key = mixed(self._hash(at, gram) + self.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 52)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = key[1:] != key[:-1]
            group = np.cumsum(fresh) - 1
            several = (np.bincount(group) > 1)[group] if len(group) else fresh
            at, group = at[several], group[several]
            found.extend(self._pairs(at, group, low, high))
            at = np.sort(at)
            gram = low = high + 1
            high = 2 * low - 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, lag = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((lag, first))
        return first[order], lag[order]

    def _pairs(self, at: np.ndarray, group: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of occurrences in ``low`` to ``high`` words from each other that begin a long diagonal."""
        if not len(at):
            return
        leading = at == self.begin[at]
        left = self.x[at - 1]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (left[1:] != left[:-1]) | leading[:-1]
        series = np.cumsum(fresh) - 1  # neighbouring occurrences with one word before them
        opens = np.flatnonzero(fresh)
        closes = np.append(opens[1:], len(at))
        place = group * (len(self.x) + 1) + at
        lows = np.searchsorted(place, place - np.minimum(high, at - self.begin[at]), side="left")
        highs = np.searchsorted(place, place - low, side="right")
        mine = np.flatnonzero((highs > lows) & (at - self.begin[at] >= low))
        lows, highs = lows[mine], highs[mine]
        reach = series[highs - 1] - series[lows] + 1
        for some in _slices(reach):
            whole = np.repeat(np.arange(some.start, some.start + len(reach[some])), reach[some])
            other = _spread(series[lows[some]], reach[some])
            differ = leading[opens[other]] | (left[opens[other]] != left[mine[whole]])
            whole, other = whole[differ], other[differ]
            a, b = np.maximum(lows[whole], opens[other]), np.minimum(highs[whole], closes[other])
            for part in _slices(b - a):
                later = at[mine[np.repeat(whole[part], (b - a)[part])]]
                lag = later - at[_spread(a[part], (b - a)[part])]
                need = np.maximum(lag, LEAST - lag)
                fits = later + need <= self.end[later]
                later, lag, need = later[fits], lag[fits], need[fits]
                same = self._hash(later - lag, need) == self._hash(later, need)
                yield later[same], lag[same]


def followed(text: list[int], starts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of a text, word by word along the diagonals that ``starts`` opens.

    Each word adds one to the match length of every open lag at which it equals the earlier word; a
    lag at which it does not is closed, and is a run if it was long enough. A lag that is a multiple of an
    open one and started in the same stretch says nothing new and is not opened.
    """
    out, lags, n, at, k = [], {}, len(text), 0, 0
    while lags or k < len(starts):
        if not lags:
            at = starts[k][0]
        while k < len(starts) and starts[k][0] == at:
            lag = starts[k][1]
            if not any(p + m == lag and lag % p == 0 for p, m in lags.items()):
                lags[lag] = 0
            k += 1
        word = text[at] if at < n else None
        for lag in list(lags):
            if word is not None and text[at - lag] == word:
                lags[lag] += 1
            else:
                length = lags.pop(lag) + lag
                if length >= max(LEAST, 2 * lag):
                    out.append((at - length, length, lag))
        at += 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def runs_of(hashes: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of every text that has any, by number of the text."""
    first, lag = Diagonals(hashes, bounds).starts()
    text = np.searchsorted(bounds, first, side="right") - 1
    cuts = np.flatnonzero(np.diff(text, prepend=-1))
    out = {}
    for a, b in zip(cuts.tolist(), [*cuts.tolist(), len(text)][1:], strict=True):
        begin, end = int(bounds[text[a]]), int(bounds[text[a] + 1])
        found = followed(hashes[begin:end].tolist(), list(zip((first[a:b] - begin).tolist(), lag[a:b].tolist(), strict=True)))
        if found:
            out[int(text[a])] = found
    return out


def _joined(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Words joined by one space."""
    parts = []
    for some in _slices(b - a + 1):
        size = (b - a + 1)[some]
        out = data[np.minimum(_spread(a[some], size), len(data) - 1)]
        out[np.cumsum(size) - 1] = 32
        parts.append(out.tobytes())
    return b"".join(parts)[:-1]


def _rows(column: pa.Array) -> Iterator[tuple[int, list]]:
    """First row of a group of rows, and number of words, runs and collapsed text of each."""
    for row, data, offsets in chunks(column, CHUNK):
        text, hashes, a, b = words(data, offsets, lower=False)
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        found = runs_of(hashes, bounds)
        drop = np.zeros(len(hashes) + 1, np.int64)
        for i, runs in found.items():
            for start, length, period in runs:
                drop[bounds[i] + start + period] += 1
                drop[bounds[i] + start + length] -= 1
        kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
        ends = np.searchsorted(kept, bounds)
        out = []
        for i in range(len(offsets) - 1):
            mine = kept[ends[i] : ends[i + 1]]
            out.append((int(bounds[i + 1] - bounds[i]), found.get(i, []), _joined(data, a[mine], b[mine])))
        yield row, out


def periodic_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` plus ``n_words``, ``runs`` and ``collapsed``.

    A text's words are its longest stretches without ASCII white space, numbered from 0. A run is a stretch of
    words with smallest period q (words q apart are identical) of at least ``LEAST`` and 2q words that no neighbouring word
    extends; ``runs`` has start, length and period of every run, by start, then period. ``collapsed``
    is the text without the words that a run holds after its first q words, joined by one space. A null or
    empty text has no words and no runs and an empty ``collapsed``; rows are judged each for itself;
    columns of ``df`` named as ours are replaced; an empty table gives an empty table.

    Words are followed online: each adds to the match lengths of the open lags, and a lag that ends
    long enough is emitted at once (``followed``). Of the lags that earlier occurrences give, only those
    are opened whose next words repeat what is needed, told beforehand by hashes (``Diagonals``), so few
    are open at a time, in a text of one word repeated too. No shuffle; the longest text bounds memory.
    """
    rows = packed(df)
    schema = rows.select("r").schema.add("n_words", "long").add("runs", _run_type(df)).add("collapsed", StringType())
    of_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for row, out in _rows(batch.column(0).field(text_col)):
                n, runs, texts = zip(*out, strict=True)
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in each] for each in runs]
                columns = [batch.column(0).slice(row, len(out)), pa.array(n, pa.int64()), pa.array(runs, of_runs), pa.array([t.decode() for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["r", *OURS])

    return unpacked(rows.mapInArrow(run, schema), df.columns, OURS)


def _run_type(df: DataFrame):
    return df.select(F.lit(None).cast(f"array<{RUN}>").alias("runs")).schema["runs"].dataType


def looped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with about every tenth text made periodic from some word on, as told by the checksum of its id.

    With h the checksum and g a tenth of it, a text of n words with h % 10 = 0 repeats, from word g % n on,
    the next 1 + (n - g % n) / (3 + g % 8) words. Texts without words, and of null ids, stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    found = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)))
    n = F.size("_words")
    at = F.when(n > 0, g % n)
    split = df.withColumn("_words", found).withColumn("_at", at).withColumn("_period", 1 + F.floor((n - F.col("_at")) / (3 + g % 8)))

    def word(w: Column, i: Column) -> Column:
        origin = F.col("_at") + (i - F.col("_at")) % F.col("_period")
        return F.when(i < F.col("_at"), w).otherwise(F.get("_words", origin.cast("int")))

    again = F.array_join(F.transform("_words", word), " ")
    return split.withColumn(text_col, F.when(n > 0, again).otherwise(F.col(text_col))).drop("_words", "_at", "_period")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = periodic_runs(looped(docs)).select("doc_id", "runs", best.alias("best"), "collapsed")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_word_runs": (op13_word_runs, None)}
