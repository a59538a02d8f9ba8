"""Job events: the given event stream read as the life of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.operators.manifests import parse_manifests
from tapeledger.plans import manifests as P
from tapeledger.plans import standins as S
from tapeledger.streaming import jobs as J
from tapeledger.streaming import stalls
from tapeledger.streaming import windows as W

EVENTS = """
SELECT user_id % 20 AS batch_id, user_id AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'STARTED' WHEN 'purchase' THEN 'FINISHED' WHEN 'error' THEN 'CANCELLED' ELSE 'PROGRESS' END AS kind,
  'job ' || CAST(user_id AS STRING) AS label, event_id % 100 AS done, CAST(100 AS BIGINT) AS total,
  CASE WHEN event_type = 'purchase' THEN 'out' || CAST(event_id AS STRING) END AS output
FROM {events}"""
# Jobs without an end are what the contract check looks for.
BROKEN = f"{EVENTS} WHERE NOT (user_id % 3 = 0 AND event_type IN ('purchase', 'error') AND event_id % 50 <> 7)"


def events(spark, sf_dir, of=EVENTS):
    return S.select(spark, sf_dir, of)


def progress(spark, sf_dir):
    return J.batch_progress(events(spark, sf_dir))


def landed(spark, sf_dir):
    """Each document's digest against the lists, as a batch; the same join runs on arriving files."""
    digests = S.table(spark, sf_dir, "documents").select(
        F.col("source").alias("dir"), F.expr(P.NAME).alias("file_name"), F.expr(P.KIND).alias("kind"),
        F.expr(f"CASE WHEN {P.KIND} = 'md5' THEN md5(text) ELSE md5({P.BODY}) END").alias("digest"),
        F.lit(None).cast("string").alias("error"),
    )
    manifest, _ = parse_manifests(P.lines(spark, sf_dir))
    return J.stream_manifest_check(digests, manifest)


# What became of jobs, by batch; some events carry no time.
OUTCOMES = """
SELECT user_id % 20 AS batch_id, CASE WHEN event_id % 97 <> 5 THEN ts END AS ts, CASE event_type WHEN 'signup' THEN 'STARTED' WHEN 'purchase' THEN 'FINISHED'
  WHEN 'error' THEN 'CANCELLED' ELSE 'PROGRESS' END AS outcome
FROM {events}"""
SLIDE = 900  # seconds; windows of four slides
GAP = 2700  # seconds without an event that end a session
PATIENCE = 43200  # seconds a job may take


def tumbling(spark, sf_dir):
    return W.outcome_windows(S.select(spark, sf_dir, OUTCOMES), f"{SLIDE} seconds")


def sliding(spark, sf_dir):
    return W.outcome_windows(S.select(spark, sf_dir, OUTCOMES), f"{4 * SLIDE} seconds", f"{SLIDE} seconds", ["batch_id"])


def sessions(spark, sf_dir):
    return W.outcome_sessions(S.select(spark, sf_dir, OUTCOMES), GAP, ["batch_id"], ["FINISHED", "CANCELLED"])


def stalled(spark, sf_dir):
    found = stalls.stalled_jobs(events(spark, sf_dir, BROKEN), f"{PATIENCE} seconds")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "deadline", "ended_at")})


def at(number: str) -> str:
    """A time from whole seconds."""
    return f"make_timestamp(CAST({number} AS BIGINT) * 1000000)"


TWIN_BROKEN = f"WITH e AS ({S.plain(BROKEN)})"
RANKED = f"""
WITH e AS ({S.plain(EVENTS)}),
s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY batch_id, job_id
  ORDER BY CASE WHEN kind IN ('FINISHED', 'CANCELLED') THEN 2 WHEN kind = 'PROGRESS' THEN 1 ELSE 0 END DESC, ts DESC) = 1)"""

QUERIES = {
    "job_state": (
        lambda spark, sf_dir: J.job_state(events(spark, sf_dir)),
        f"{RANKED} SELECT batch_id, job_id, kind AS state, done, total, output, ts FROM s",
    ),
    "batch_progress": (
        progress,
        f"""{RANKED} SELECT batch_id, count(DISTINCT job_id) FILTER (WHERE kind IN ('FINISHED', 'CANCELLED')) AS done, count(DISTINCT job_id) FILTER (WHERE kind = 'STARTED') AS submitted FROM e GROUP BY batch_id""",
    ),
    "cancelled_rows": (
        lambda spark, sf_dir: J.cancelled_rows(events(spark, sf_dir)),
        f"{RANKED} SELECT batch_id, job_id, CAST(NULL AS VARCHAR) AS output, ts FROM s WHERE kind = 'CANCELLED'",
    ),
    "terminal_once": (
        lambda spark, sf_dir: J.terminal_once(events(spark, sf_dir, BROKEN)),
        f"""{TWIN_BROKEN}, j AS (SELECT batch_id, job_id, count(*) FILTER (WHERE kind IN ('FINISHED', 'CANCELLED')) AS terminals,
  min(ts) FILTER (WHERE kind IN ('FINISHED', 'CANCELLED')) AS ended, min(ts) FILTER (WHERE kind = 'STARTED') AS started FROM e GROUP BY ALL)
SELECT batch_id, job_id, terminals, CASE WHEN terminals = 0 THEN 'NO_TERMINAL' WHEN terminals > 1 THEN 'SEVERAL_TERMINALS' WHEN started IS NULL THEN 'NOT_STARTED' ELSE 'STARTED_LATE' END AS violation
FROM j WHERE terminals <> 1 OR started IS NULL OR started > ended""",
    ),
    "stream_manifest_check": (
        landed,
        f"""WITH {P.TWIN_PARSE}, d AS (SELECT source AS dir, {P.NAME} AS file_name, {P.KIND} AS kind, CASE WHEN {P.KIND} = 'md5' THEN md5(text) ELSE md5({P.BODY}) END AS actual FROM documents)
SELECT m.dir, list_path, m.kind, line_no, m.file_name, CASE WHEN digest = actual THEN 'OK' ELSE 'MISMATCH' END AS status
FROM m JOIN d ON m.dir = d.dir AND m.file_name = d.file_name AND m.kind = d.kind""",
    ),
    "outcome_windows": (
        tumbling,
        f"""WITH o AS ({S.plain(OUTCOMES)}), w AS (SELECT epoch_us(ts) // {SLIDE * 1000000} AS k, outcome, count(*) AS n FROM o WHERE ts IS NOT NULL GROUP BY ALL)
SELECT {at(f"k * {SLIDE}")} AS window_start, {at(f"(k + 1) * {SLIDE}")} AS window_end, outcome, n FROM w""",
    ),
    "outcome_windows_sliding": (
        sliding,
        f"""WITH o AS ({S.plain(OUTCOMES)}), w AS (SELECT epoch_us(ts) // {SLIDE * 1000000} - back AS k, batch_id, outcome, count(*) AS n FROM o, range(4) r(back) WHERE ts IS NOT NULL GROUP BY ALL)
SELECT {at(f"k * {SLIDE}")} AS window_start, {at(f"(k + 4) * {SLIDE}")} AS window_end, batch_id, outcome, n FROM w""",
    ),
    "outcome_sessions": (
        sessions,
        f"""WITH o AS ({S.plain(OUTCOMES)}),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY batch_id ORDER BY ts)) <= {GAP * 1000000} THEN 0 ELSE 1 END AS fresh FROM o WHERE ts IS NOT NULL),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY batch_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT batch_id, min(ts) AS session_start, max(ts) + INTERVAL {GAP} SECONDS AS session_end, count(*) AS n,
  count(*) FILTER (WHERE outcome = 'FINISHED') AS n_finished, count(*) FILTER (WHERE outcome = 'CANCELLED') AS n_cancelled FROM i GROUP BY batch_id, island""",
    ),
    "stalled_jobs": (
        stalled,
        f"""{TWIN_BROKEN}, j AS (SELECT batch_id, job_id, min(ts) FILTER (WHERE kind = 'STARTED') AS started_at, min(ts) FILTER (WHERE kind IN ('FINISHED', 'CANCELLED')) AS ended_at FROM e GROUP BY ALL),
d AS (SELECT *, started_at + INTERVAL {PATIENCE} SECONDS AS deadline FROM j)
SELECT batch_id, job_id, started_at, deadline, ended_at FROM d WHERE coalesce(ended_at > deadline, deadline < (SELECT max(ts) FROM e))""",
    ),
}
