import datetime as dt

from tapeledger.streaming import jobs as J

SCHEMA = "batch_id string, job_id long, kind string, label string, done int, total int, output string, ts timestamp"


def event(job, kind, minute, done=None, output=None):
    return ("b", job, kind, f"job {job}", done, 10, output, dt.datetime(2024, 1, 1, 0, minute))


FIRST = [event(1, "STARTED", 0), event(2, "STARTED", 0), event(3, "STARTED", 0), event(1, "PROGRESS", 1, 5), event(1, "FINISHED", 2, output="ok")]
LATER = [event(1, "PROGRESS", 3, 7), event(2, "CANCELLED", 4), event(2, "PROGRESS", 1, 1), event(4, "FINISHED", 5, output="x"), event(5, "STARTED", 9), event(5, "FINISHED", 8), event(6, "STARTED", 0), event(6, "FINISHED", 1), event(6, "CANCELLED", 2)]

STATES = {1: ("FINISHED", "ok"), 2: ("CANCELLED", None), 3: ("STARTED", None), 4: ("FINISHED", "x"), 5: ("FINISHED", None), 6: ("CANCELLED", None)}
VIOLATIONS = {3: "NO_TERMINAL", 4: "NOT_STARTED", 5: "STARTED_LATE", 6: "SEVERAL_TERMINALS"}


def test_batch(spark):
    df = spark.createDataFrame(FIRST + LATER, SCHEMA)
    assert {r.job_id: (r.state, r.output) for r in J.job_state(df).collect()} == STATES
    assert [(r.done, r.submitted) for r in J.batch_progress(df).collect()] == [(5, 5)]  # six ends
    assert sorted(r.job_id for r in J.cancelled_rows(df).collect()) == [2, 6]
    assert {r.job_id: r.violation for r in J.terminal_once(df).collect()} == VIOLATIONS


def streamed(spark, tmp_path, operator, name):
    """Two deliveries, the second with late and out-of-order events."""
    source, state = str(tmp_path / "in"), str(tmp_path / f"state-{name}")
    spark.createDataFrame(FIRST, SCHEMA).coalesce(1).write.mode("overwrite").parquet(source)
    stream = operator(spark.readStream.schema(SCHEMA).parquet(source))
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", state).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame(LATER, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        query.stop()


def test_streams_end_where_the_batch_does(spark, tmp_path):
    got = streamed(spark, tmp_path, J.job_state, "states")
    assert {r.job_id: (r.state, r.output) for r in got} == STATES
    assert {r.job_id: r.violation for r in streamed(spark, tmp_path / "t", J.terminal_once, "terminals")} == VIOLATIONS


def test_files_are_checked_as_they_land(spark, tmp_path):
    schema = "dir string, file_name string, kind string, digest string, error string"
    manifest = spark.createDataFrame(
        [("d", "d/l.md5", "md5", 1, "a", "h1"), ("d", "d/l.md5", "md5", 2, "b", "h2"), ("d", "d/l.md5", "md5", 3, "c", "h3")],
        "dir string, list_path string, kind string, line_no long, file_name string, digest string",
    )
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    checked = lambda: J.stream_manifest_check(spark.readStream.schema(schema).parquet(source), manifest)
    spark.createDataFrame([("d", "a", "md5", "h1", None)], schema).write.parquet(source)
    J.run_available(checked(), out, state)
    spark.createDataFrame([("d", "b", "md5", "x", None), ("d", "z", "md5", "x", None)], schema).write.mode("append").parquet(source)
    J.run_available(checked(), out, state)
    assert sorted((r.file_name, r.status) for r in spark.read.parquet(out).collect()) == [("a", "OK"), ("b", "MISMATCH")]


def test_tracked_jobs_are_forgotten_in_time(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []

    def keep_rows(df, _batch):
        seen.append({r.job_id: (r.state, r.output) for r in df.collect()})

    def deliver(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()

    spark.createDataFrame(FIRST, SCHEMA).coalesce(1).write.parquet(source)
    stream = J.track_jobs(spark.readStream.schema(SCHEMA).parquet(source), "10 minutes")
    query = stream.writeStream.foreachBatch(keep_rows).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        deliver(LATER)
        latest = {}
        for batch in seen:
            latest.update(batch)
        assert latest == STATES
        # Late progress changed nothing for a finished job.
        assert all(1 not in batch for batch in seen[1:])
        deliver([event(9, "STARTED", 59)])
        deliver([event(9, "PROGRESS", 59)])
        query.processAllAvailable()
        kept = [p for p in query.recentProgress if p.stateOperators][-1].stateOperators[0].numRowsTotal
        assert kept == 1
    finally:
        query.stop()
