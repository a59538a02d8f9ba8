"""Job events, batch or streaming: the same aggregations run on both.

Events: ``batch_id, job_id, kind, label, done, total, output, ts`` with kind STARTED, PROGRESS,
FINISHED or CANCELLED. Started is sent when a job is submitted, so cancelled jobs have one too.
State is what aggregation keeps, one small row per job or batch; a stream with a watermark on
``ts`` keeps it no longer than that in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


JOB = ["batch_id", "job_id"]
TERMINAL = ["FINISHED", "CANCELLED"]


def _rank() -> Column:
    """Events may arrive in any order: a finished job is not reopened by late progress."""
    kind = F.col("kind")
    return F.when(kind.isin(TERMINAL), 2).when(kind == "PROGRESS", 1).otherwise(0)


def job_state(events: DataFrame) -> DataFrame:
    """Latest state per job."""
    newest = F.max(F.struct(_rank().alias("rank"), "ts", "kind", "done", "total", "output"))
    return events.groupBy(*JOB).agg(newest.alias("s")).select(
        *JOB,
        F.col("s.kind").alias("state"),
        F.col("s.done").alias("done"),
        F.col("s.total").alias("total"),
        F.when(F.col("s.kind") == "FINISHED", F.col("s.output")).alias("output"),
        F.col("s.ts").alias("ts"),
    )


def batch_progress(events: DataFrame) -> DataFrame:
    """Jobs done of jobs submitted; a cancelled job counts as done, and a job with two ends once.

    Jobs are told apart before they are counted, which takes two groupings: for batches, and for the
    events a stream has written so far.
    """
    jobs = events.groupBy(*JOB).agg(
        F.bool_or(F.col("kind").isin(TERMINAL)).alias("_ended"), F.bool_or(F.col("kind") == "STARTED").alias("_started")
    )
    return jobs.groupBy("batch_id").agg(F.count_if("_ended").alias("done"), F.count_if("_started").alias("submitted"))


def cancelled_rows(events: DataFrame) -> DataFrame:
    """Jobs that never ran: no output, unlike a job that ran and stopped itself."""
    return job_state(events).filter(F.col("state") == "CANCELLED").select(*JOB, "output", "ts")


def _ends_and_starts() -> list[Column]:
    ends = F.when(F.col("kind").isin(TERMINAL), F.col("ts"))
    starts = F.when(F.col("kind") == "STARTED", F.col("ts"))
    return [F.count(ends).alias("terminals"), F.min(ends).alias("_end"), F.min(starts).alias("_start")]


def _violations(per_job: DataFrame) -> DataFrame:
    violation = (
        F.when(F.col("terminals") == 0, "NO_TERMINAL")
        .when(F.col("terminals") > 1, "SEVERAL_TERMINALS")
        .when(F.col("_start").isNull(), "NOT_STARTED")
        .when(F.col("_start") > F.col("_end"), "STARTED_LATE")
    )
    return per_job.select(*JOB, "terminals", violation.alias("violation")).filter(F.col("violation").isNotNull())


def terminal_once(events: DataFrame) -> DataFrame:
    """Jobs that break the contract: one terminal event, and a start before it."""
    return _violations(events.groupBy(*JOB).agg(*_ends_and_starts()))


def terminal_once_closed(events: DataFrame, keep: str = "1 hour") -> DataFrame:
    """``terminal_once`` for streams that never end: a job is judged once, ``keep`` after its last event.

    An event delivered twice (same job, kind and ``ts``) within ``keep`` counts once; a job that is silent for longer
    than ``keep`` and then goes on is judged anew. Append mode: rows come when the watermark, ``keep``
    behind the newest event, has passed the job, and its state goes with them.
    """
    once = events.withWatermark("ts", keep).dropDuplicatesWithinWatermark([*JOB, "kind", "ts"])
    return _violations(once.groupBy(*JOB, F.session_window("ts", keep).alias("_w")).agg(*_ends_and_starts()))


def stream_manifest_check(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files checked as they land: a stream of ``dir, file_name, kind, digest, error`` against
    the entries that name them. An inner join: only a batch run can say a file never came."""
    found = digests.select(
        "dir", "file_name", "kind", F.col("digest").alias("actual"), F.col("error")
    )
    status = (
        F.when(F.col("error").isNotNull() | F.col("actual").isNull(), "FAILED")
        .when(F.col("digest") == F.col("actual"), "OK")
        .otherwise("MISMATCH")
    )
    return found.join(manifest, ["dir", "file_name", "kind"]).select(
        "dir", "list_path", "kind", "line_no", "file_name", status.alias("status")
    )


TRACKED = "batch_id string, job_id bigint, state string, done int, total int, output string, ts timestamp"
_KEPT = "rank int, ts timestamp, kind string, done int, total int, output string"


def _ranked(pdf: pd.DataFrame) -> pd.DataFrame:
    rank = pdf["kind"].map({"STARTED": 0, "PROGRESS": 1}).fillna(2).astype("int32")
    return pdf.assign(rank=rank).sort_values(["rank", "ts"], kind="stable")


def track_jobs(events: DataFrame, keep: str = "1 hour") -> DataFrame:
    """``job_state`` for streams that never end: a job's state goes ``keep`` after its last news.

    Rows appear when a job's state changes. Each batch of events is cut to one row per job
    before it is shuffled, so a job with very many events costs no more than any other.
    """
    columns = "batch_id string, job_id bigint, kind string, done int, total int, output string, ts timestamp"

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield _ranked(pdf).drop_duplicates(JOB, keep="last").drop(columns="rank")

    def plain(value):
        return None if pd.isna(value) else value

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        best = before
        for pdf in frames:
            last = _ranked(pdf).iloc[-1]
            seen = (
                int(last["rank"]), last["ts"].to_pydatetime(), last["kind"],
                *[None if pd.isna(last[c]) else int(last[c]) for c in ("done", "total")], plain(last["output"]),
            )
            best = seen if best is None or seen[:2] > tuple(best)[:2] else best
        if best != before:
            state.update(best)
            output = best[5] if best[2] == "FINISHED" else None
            yield pd.DataFrame([(*key, best[2], best[3], best[4], output, best[1])], columns=TRACKED_NAMES)
        wake = max(state.getCurrentWatermarkMs(), int(pd.Timestamp(best[1]).timestamp() * 1000)) + keep_ms
        state.setTimeoutTimestamp(wake)

    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    cut = events.select(*[F.col(c) for c in ("batch_id", "job_id", "kind", "done", "total", "output", "ts")])
    return (
        cut.mapInPandas(newest, columns)
        .withWatermark("ts", keep)
        .groupBy(*JOB)
        .applyInPandasWithState(fold, TRACKED, _KEPT, "update", GroupStateTimeout.EventTimeTimeout)
    )


TRACKED_NAMES = [c.split()[0] for c in TRACKED.split(", ")]


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write all input that is there as parquet, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
