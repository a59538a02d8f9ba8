"""Jobs that give no end in time, told by event-time timers, and progress of batches kept job by job.

Both keep their state in a store on disk: streams need the session of ``keyed_state``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeledger.streaming.jobs import JOB, TERMINAL

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> SparkSession:
    """Let the session's streams keep state in RocksDB, which timers and maps of state need. Call it once."""
    spark.conf.set(STORE_CONF, STORE)
    return spark


def _seconds(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds())


def _first_times(events: DataFrame) -> list:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("kind")
    return [F.when(kind == "STARTED", at).alias("started"), F.when(kind.isin(TERMINAL), at).alias("ended")]


def stalled_jobs(events: DataFrame, timeout: str = "1 hour", as_of=None) -> DataFrame:
    """Jobs that had no end within ``timeout`` of their start: ``started_at, deadline, ended_at``.

    ``ended_at`` is the late end that closed the job, null while there is none. First start and first end count. A
    job without a start has no deadline. One whose deadline has not passed at ``as_of`` (the newest event,
    if not given) is not stalled yet, unless its end is known to be late.
    """
    at = events.select(*JOB, *_first_times(events))
    jobs = at.groupBy(*JOB).agg(F.min("started").alias("started"), F.min("ended").alias("ended"))
    if as_of is None:
        as_of = events.agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0]
    deadline = F.col("started") + _seconds(timeout) * 1_000_000
    late = F.when(F.col("ended").isNull(), deadline < F.lit(as_of).cast("long")).otherwise(F.col("ended") > deadline)
    found = jobs.filter(F.col("started").isNotNull() & late)
    return found.select(*JOB, F.timestamp_micros("started").alias("started_at"), F.timestamp_micros(deadline).alias("deadline"), F.timestamp_micros("ended").alias("ended_at"))


class _Stalls(StatefulProcessor):
    """One job: its first start and end, and a timer at its deadline, then at the time it may be forgotten."""

    def __init__(self, timeout_us: int, keep_us: int):
        self.timeout, self.keep = timeout_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started long, ended long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.job.get() if self.job.exists() else (None, None, False)
        started, ended, told = known
        for pdf in rows:
            started = _least(started, pdf["started"].min())
            ended = _least(ended, pdf["ended"].min())
        if told and known[1] is None and ended is not None:
            # The end that a job already reported has been waiting for.
            self._forget()
            yield self._row(key, "CLOSED", started, ended)
            return
        if started is not None and started != known[0] and not told:
            self._wake(started + self.timeout)
        elif started is None and known == (None, None, False):
            self._wake((ended if ended is not None else timerValues.getCurrentWatermarkInMs() * 1000) + self.keep)
        self.job.update((started, ended, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, ended, told = self.job.get() if self.job.exists() else (None, None, True)
        if told or started is None:
            self._forget()
            return
        deadline = started + self.timeout
        if ended is not None and ended <= deadline:
            # In time. What comes in the next while is a repeated event of an ended job.
            self.job.update((started, ended, True))
            self._wake(deadline + self.keep)
        elif ended is not None:
            self._forget()
            yield self._row(key, "CLOSED", started, ended)
        else:
            self.job.update((started, None, True))
            self._wake(deadline + self.keep)
            yield self._row(key, "STALLED", started, None)

    def close(self) -> None:
        pass

    def _wake(self, at_us: int) -> None:
        """One timer a job; it never rings before the last microsecond of its time has passed."""
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(int(at_us // 1000) + 1)

    def _forget(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.job.clear()

    def _row(self, key, state: str, started: int, ended: int | None) -> pd.DataFrame:
        row = {"batch_id": [key[0]], "job_id": [key[1]], "state": [state], "started": [started], "deadline": [started + self.timeout]}
        return pd.DataFrame(row | {"ended": pd.array([ended], dtype="Int64")})


def _least(a, b) -> int | None:
    found = [int(v) for v in (a, b) if v is not None and not pd.isna(v)]
    return min(found, default=None)


def track_stalled(events: DataFrame, timeout: str = "1 hour", late: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """``stalled_jobs`` of a stream: ``state`` STALLED when the watermark passes a job's deadline, CLOSED when its late end comes.

    The watermark is ``late`` behind the newest event. A job is forgotten when it is closed, or ``keep`` after
    its deadline; an end later than that is an end without a start. Each batch of events is cut to
    one row a job before it is shuffled. Needs ``keyed_state``; update or append mode.
    """
    at = events.select(*JOB, "ts", *_first_times(events))
    kinds = {f.name: f.dataType.simpleString() for f in at.schema.fields}

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.groupby(JOB, as_index=False, dropna=False)[["ts", "started", "ended"]].agg({"ts": "max", "started": "min", "ended": "min"})

    narrow = at.mapInPandas(cut, ", ".join(f"{n} {kinds[n]}" for n in (*JOB, "ts", "started", "ended")))
    rows = narrow.withWatermark("ts", late).groupBy(*JOB).transformWithStateInPandas(
        _Stalls(_seconds(timeout) * 1_000_000, _seconds(keep) * 1_000_000),
        f"batch_id {kinds['batch_id']}, job_id {kinds['job_id']}, state string, started long, deadline long, ended long",
        "Update",
        "EventTime",
    )
    return rows.select(*JOB, "state", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("deadline").alias("deadline"), F.timestamp_micros("ended").alias("ended_at"))


class _Progress(StatefulProcessor):
    """One batch: what is known of each of its jobs, and how many of them have started and ended."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id long", "started boolean, ended boolean")
        self.counts = handle.getValueState("counts", "done long, submitted long, wake long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, submitted, wake = self.counts.get() if self.counts.exists() else (0, 0, 0)
        before, newest = (done, submitted) if self.counts.exists() else None, 0
        for pdf in rows:
            newest = max(newest, int(pdf["at"].max()))
            for job, started, ended in zip(pdf["job_id"], pdf["started"], pdf["ended"]):
                place = (int(job),)
                known = self.jobs.getValue(place) if self.jobs.containsKey(place) else (False, False)
                seen = (known[0] or bool(started), known[1] or bool(ended))
                if seen != tuple(known):
                    submitted, done = submitted + seen[0] - known[0], done + seen[1] - known[1]
                    self.jobs.updateValue(place, seen)
        until = max(newest, timerValues.getCurrentWatermarkInMs()) + self.keep
        if until > wake:
            if wake:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(until)
            wake = until
        self.counts.update((done, submitted, wake))
        if (done, submitted) != before:
            yield pd.DataFrame({"batch_id": [key[0]], "done": [done], "submitted": [submitted]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.jobs.clear()
        self.counts.clear()
        return iter([])

    def close(self) -> None:
        pass


def track_progress(events: DataFrame, late: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """``batch_progress`` of a stream that never ends: a row of ``batch_id, done, submitted`` when a batch's counts change.

    The jobs of a batch are a map of state, so a doubled end counts once without a second grouping
    and without complete mode. A batch is forgotten ``keep`` after its last news; news of it after that begin it
    anew. Each batch of events is cut to one row a job before it is shuffled, and ``job_id`` is not null. Needs
    ``keyed_state``; update mode.
    """
    kind = F.col("kind")
    at = events.select(
        "batch_id", F.col("job_id").cast("long").alias("job_id"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (kind == "STARTED").alias("started"), kind.isin(TERMINAL).alias("ended")
    ).filter(F.col("job_id").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in at.schema.fields}

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.groupby(JOB, as_index=False, dropna=False).agg({"ts": "max", "at": "max", "started": "max", "ended": "max"})

    narrow = at.mapInPandas(cut, ", ".join(f"{n} {kinds[n]}" for n in (*JOB, "ts", "at", "started", "ended")))
    return narrow.withWatermark("ts", late).groupBy("batch_id").transformWithStateInPandas(
        _Progress(_seconds(keep) * 1000), f"batch_id {kinds['batch_id']}, done long, submitted long", "Update", "EventTime"
    )
