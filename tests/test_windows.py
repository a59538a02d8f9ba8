import datetime as dt

import pytest

from conftest import rows
from tapeledger.streaming import jobs as J
from tapeledger.streaming import stalls
from tapeledger.streaming import windows as W

OUTCOME = "k string, ts timestamp, outcome string"
EVENT = "batch_id string, job_id long, kind string, label string, done int, total int, output string, ts timestamp"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def event(job, kind, minute, batch="b"):
    return (batch, job, kind, f"job {job}", None, 10, None, at(minute))


class Feed:
    """A stream fed delivery by delivery; keeps the rows of every micro-batch."""

    def __init__(self, spark, tmp_path, schema, operator, mode):
        self.spark, self.schema, self.source, self.batches = spark, schema, str(tmp_path / "in"), []
        spark.createDataFrame([], schema).write.parquet(self.source)
        stream = operator(spark.readStream.schema(schema).parquet(self.source))
        writer = stream.writeStream.foreachBatch(lambda df, _: self.batches.append(df.collect())).outputMode(mode)
        self.query = writer.option("checkpointLocation", str(tmp_path / "state")).start()

    def give(self, *deliveries):
        for delivery in deliveries:
            self.spark.createDataFrame(delivery, self.schema).coalesce(1).write.mode("append").parquet(self.source)
            self.query.processAllAvailable()

    def seen(self):
        return [tuple(r) for batch in self.batches for r in batch]

    def state_rows(self):
        return [p for p in self.query.recentProgress if p.stateOperators][-1].stateOperators[0].numRowsTotal

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.query.stop()


@pytest.fixture
def keyed(spark):
    before = spark.conf.get(stalls.STORE_CONF)
    yield stalls.keyed_state(spark)
    spark.conf.set(stalls.STORE_CONF, before)


GIVEN = [("a", at(0), "OK"), ("a", at(9, 59), "OK"), ("a", at(10), "BAD"), ("b", at(12), "OK"), ("b", None, "OK")]


def test_windows_of_a_batch(spark):
    df = spark.createDataFrame(GIVEN, OUTCOME)
    assert rows(W.outcome_windows(df, "10 minutes")) == [(at(0), at(10), "OK", 2), (at(10), at(20), "BAD", 1), (at(10), at(20), "OK", 1)]
    sliding = rows(W.outcome_windows(df, "10 minutes", "5 minutes", ["k"]))
    assert sliding == sorted(
        [(at(-5), at(5), "a", "OK", 1), (at(0), at(10), "a", "OK", 2), (at(5), at(15), "a", "OK", 1), (at(5), at(15), "a", "BAD", 1), (at(10), at(20), "a", "BAD", 1), (at(5), at(15), "b", "OK", 1), (at(10), at(20), "b", "OK", 1)]
    )
    assert W.outcome_windows(df.limit(0), "10 minutes").count() == 0


def test_sessions_of_a_batch(spark):
    minutes = [0, 4, 9, 15, 30, 30, 36, 55]
    df = spark.createDataFrame([("a", at(m), "OK" if m % 2 else "BAD") for m in minutes] + [("b", None, "OK")], OUTCOME)
    got = rows(W.outcome_sessions(df, 360, ["k"], ["OK", "BAD"]))
    # 9 and 15, and 30 and 36, are just the gap apart.
    assert got == [("a", at(0), at(21), 4, 2, 2), ("a", at(30), at(42), 3, 0, 3), ("a", at(55), at(61), 1, 1, 0)]


def test_tumbling_stream_emits_once_and_drops_the_late(spark, tmp_path):
    with Feed(spark, tmp_path, OUTCOME, lambda df: W.outcome_windows(df, "10 minutes", late="5 minutes"), "append") as feed:
        feed.give([("a", at(1), "OK"), ("a", at(12), "OK")])
        assert feed.seen() == []
        feed.give([("a", at(2), "OK")])  # out of order, in time
        feed.give([("a", at(16), "BAD")], [("a", at(17), "OK")])  # the watermark passes minute 10
        assert feed.seen() == [(at(0), at(10), "OK", 2)] and W.late_rows(feed.query) == 0
        feed.give([("a", at(3), "OK")])  # too late
        feed.give([("a", at(40), "OK")], [("a", at(41), "OK")])
        assert sorted(feed.seen()) == [(at(0), at(10), "OK", 2), (at(10), at(20), "BAD", 1), (at(10), at(20), "OK", 2)]
        assert W.late_rows(feed.query) == 1 and feed.state_rows() == 1


def test_sliding_stream_counts_a_row_in_every_window(spark, tmp_path):
    given = [("a", at(1), "OK"), ("a", at(7), "OK"), ("a", at(60), "OK")]
    with Feed(spark, tmp_path, OUTCOME, lambda df: W.outcome_windows(df, "10 minutes", "5 minutes", late="5 minutes"), "append") as feed:
        feed.give(given, [("a", at(61), "OK")])
        whole = rows(W.outcome_windows(spark.createDataFrame(given, OUTCOME), "10 minutes", "5 minutes"))
        assert sorted(feed.seen()) == [r for r in whole if r[1] <= at(55)]


def test_two_open_sessions_become_one(spark, tmp_path):
    operator = lambda df: W.outcome_sessions(df, 300, ["k"], ["OK"], late="20 minutes")
    first = [("a", at(0), "OK"), ("a", at(8), "BAD"), ("b", at(8), "OK")]
    between = [("a", at(4), "OK")]
    with Feed(spark, tmp_path, OUTCOME, operator, "append") as feed:
        feed.give(first)
        assert feed.state_rows() == 3
        feed.give(between)
        assert feed.state_rows() == 2
        feed.give([("c", at(60), "OK")], [("c", at(61), "OK")])
        assert sorted(feed.seen()) == [("a", at(0), at(13), 3, 2), ("b", at(8), at(13), 1, 1)]
    assert sorted(feed.seen()) == rows(W.outcome_sessions(spark.createDataFrame(first + between, OUTCOME), 300, ["k"], ["OK"]))


STARTS = [event(j, "STARTED", 0) for j in (1, 2, 3, 4)] + [event(1, "FINISHED", 20), event(5, "FINISHED", 3)]


def test_stalled_jobs_of_a_batch(spark):
    df = spark.createDataFrame(STARTS + [event(2, "CANCELLED", 31), event(3, "FINISHED", 30), event(6, "STARTED", 60), event(6, "PROGRESS", 89)], EVENT)
    found = {r.job_id: (r.started_at, r.deadline, r.ended_at) for r in stalls.stalled_jobs(df, "30 minutes").collect()}
    assert found == {2: (at(0), at(30), at(31)), 4: (at(0), at(30), None)}
    assert 6 in {r.job_id for r in stalls.stalled_jobs(df, "20 minutes").collect()}
    assert stalls.stalled_jobs(df.limit(0)).count() == 0


def test_timers_fire_by_watermark_and_a_late_end_closes(keyed, tmp_path):
    operator = lambda df: stalls.track_stalled(df, "30 minutes", "5 minutes", "2 hours")
    with Feed(keyed, tmp_path, EVENT, operator, "update") as feed:
        feed.give(STARTS)
        feed.give([event(2, "PROGRESS", 33)])  # the watermark is at minute 28
        assert feed.seen() == []
        feed.give([event(3, "FINISHED", 29)])  # before the deadline, and the watermark has not passed it
        feed.give([event(2, "CANCELLED", 34), event(7, "STARTED", 36)], [event(7, "PROGRESS", 37)])
        late = [r[:3] + r[5:] for r in feed.seen()]
        assert sorted(late, key=str) == [("b", 2, "CLOSED", at(34)), ("b", 4, "STALLED", None)]
        feed.give([event(4, "FINISHED", 40)])
        assert feed.seen()[-1] == ("b", 4, "CLOSED", at(0), at(30), at(40))
        everything = STARTS + [event(3, "FINISHED", 29), event(2, "CANCELLED", 34), event(4, "FINISHED", 40)]
        batch = {r.job_id: tuple(r)[2:] for r in stalls.stalled_jobs(keyed.createDataFrame(everything, EVENT), "30 minutes").collect()}
        assert {r[1]: r[3:] for r in feed.seen()} == batch
        feed.give([event(9, "STARTED", 600)], [event(9, "PROGRESS", 601)])
        assert {r[1] for r in feed.seen() if r[2] == "STALLED"} == {4, 7}  # job 9 has time left
        feed.give([event(9, "FINISHED", 602)], [event(9, "PROGRESS", 603)])
        assert feed.state_rows() <= 4  # job 9, its timer and the index of timers


def test_progress_of_a_running_stream(keyed, tmp_path):
    first = [event(1, "STARTED", 0), event(2, "STARTED", 0), event(1, "FINISHED", 1), event(1, "FINISHED", 2), event(1, "STARTED", 0, "c")]
    later = [event(1, "CANCELLED", 3), event(2, "CANCELLED", 3), event(3, "FINISHED", 3), event(1, "PROGRESS", 4, "c")]
    with Feed(keyed, tmp_path, EVENT, lambda df: stalls.track_progress(df, "5 minutes", "1 hour"), "update") as feed:
        feed.give(first)
        assert sorted(feed.seen()) == [("b", 1, 2), ("c", 0, 1)]
        feed.give(later)
        assert feed.seen()[2:] == [("b", 3, 2)]  # nothing new for the other batch
        batch = rows(J.batch_progress(keyed.createDataFrame(first + later, EVENT)))
        assert sorted({r[0]: r for r in feed.seen()}.values()) == batch
        feed.give([event(1, "STARTED", 300, "d")], [event(1, "PROGRESS", 301, "d")], [event(1, "PROGRESS", 302, "d")])
        assert feed.seen()[-1] == ("d", 0, 1) and feed.state_rows() <= 4


def test_contract_of_jobs_is_judged_once_and_forgotten(spark, tmp_path):
    first = [event(1, "STARTED", 0), event(2, "STARTED", 0), event(3, "STARTED", 0), event(1, "FINISHED", 2), event(6, "STARTED", 0), event(6, "FINISHED", 1)]
    later = [event(2, "CANCELLED", 4), event(4, "FINISHED", 5), event(5, "STARTED", 9), event(5, "FINISHED", 8), event(6, "CANCELLED", 2)]
    with Feed(spark, tmp_path, EVENT, lambda df: J.terminal_once_closed(df, "20 minutes"), "append") as feed:
        feed.give(first, later, [event(4, "FINISHED", 5)])  # delivered again
        assert feed.seen() == []
        feed.give([event(9, "STARTED", 90)], [event(9, "PROGRESS", 91)], [event(9, "PROGRESS", 92)])
        batch = rows(J.terminal_once(spark.createDataFrame(first + later, EVENT)))
        assert sorted(feed.seen()) == batch and {r[3] for r in batch} == {"NO_TERMINAL", "SEVERAL_TERMINALS", "NOT_STARTED", "STARTED_LATE"}
        assert max(op.numRowsTotal for op in [p for p in feed.query.recentProgress if p.stateOperators][-1].stateOperators) <= 3
