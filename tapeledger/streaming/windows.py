"""Outcomes counted by event time: in fixed, overlapping and session windows, batch or streaming.

A stream gets a watermark ``late`` behind its newest event: a window is emitted once the watermark has
passed its end, its state goes with it, and rows of windows already emitted are dropped and counted
(``late_rows``). A batch drops nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _watched(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("ts", late) if df.isStreaming else df


def outcome_windows(
    outcomes: DataFrame, size: str, slide: str | None = None, keys: Sequence[str] = (), outcome: str = "outcome", late: str = "1 hour"
) -> DataFrame:
    """``window_start, window_end``, ``keys``, the outcome and ``n``, its count in the window.

    Windows of ``size`` begin at every multiple of ``slide`` (of ``size`` if none is given) since the
    epoch; a row counts in every window that holds its ``ts``, start included, end excluded. A row
    without ``ts`` is in no window.
    """
    spans = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = _watched(outcomes, late).groupBy(spans.alias("w"), *keys, outcome).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, outcome, "n")


def outcome_sessions(
    outcomes: DataFrame, gap_seconds: int, keys: Sequence[str], values: Sequence[str], outcome: str = "outcome", late: str = "1 hour"
) -> DataFrame:
    """Per key and session: ``session_start``, ``session_end`` (``gap_seconds`` after the last row), ``n`` and
    a count of each of ``values``.

    A session goes on as long as rows of its key come within the gap of each other; a late row between
    two open sessions makes them one. In a batch, rows of one key that fall in one stretch of a
    gap's length are one session whatever else there is, so they are added up before the
    shuffle, and a key with most of the rows brings no more than a row a stretch and task.
    """
    counts = {f"n_{v.lower()}": F.count_if(F.col(outcome) == v) for v in values}
    if outcomes.isStreaming:
        merged = _watched(outcomes, late).groupBy(*keys, F.session_window("ts", f"{gap_seconds} seconds").alias("w"))
        found = merged.agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in counts.items()])
        return _sessions(found, keys, ["n", *counts], F.col("w.start"), F.col("w.end"))
    stretch = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / gap_seconds)
    spans = outcomes.filter(F.col("ts").isNotNull()).groupBy(*keys, stretch.alias("_stretch")).agg(
        F.min("ts").alias("ts"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in counts.items()]
    )
    length = F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) + gap_seconds * 1_000_000
    # A number of microseconds as the kind of interval that session windows take.
    gap = F.concat(length.cast("string"), F.lit(" microseconds")).cast("interval")
    merged = spans.groupBy(*keys, F.session_window("ts", gap).alias("w"))
    found = merged.agg(*[F.sum(n).alias(n) for n in ("n", *counts)])
    return _sessions(found, keys, ["n", *counts], F.col("w.start"), F.col("w.end"))


def _sessions(found: DataFrame, keys: Sequence[str], counts: Sequence[str], start: Column, end: Column) -> DataFrame:
    return found.select(*keys, start.alias("session_start"), end.alias("session_end"), *counts)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a running or ended query has dropped for coming after the watermark, as far as its progress reports go back."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)
