"""Sector alignment and boundary repair over the stand-in tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeledger.functions.formats import duration_secs, sbe_check
from tapeledger.operators import repair as R
from tapeledger.plans import standins as S

PLAN_COLUMNS = ["set_id", "ordinal", "frames", "shift", "is_last", "tail_padding", "fully_fixed", "refused", "refused_at"]


def plan(direction, text=S.CD_TRACKS, pad_tail=False):
    def run(spark, sf_dir):
        rows, longest = S.tracks(spark, sf_dir, text)
        return R.plan_shift(rows, direction, pad_tail, longest).select(PLAN_COLUMNS)

    return run


def fixed(spark, sf_dir, direction="nearest", text=S.CD_TRACKS, pad_tail=True):
    rows, longest = S.tracks(spark, sf_dir, text)
    planned = R.plan_shift(rows, direction, pad_tail, longest)
    return planned, R.fix_rows(planned, longest), longest


def sbe(spark, sf_dir):
    rows, _ = S.tracks(spark, sf_dir, S.MIXED_TRACKS)
    cols = [F.col(c) for c in ("frames", "sample_rate", "channels", "bits_per_sample")]
    checked = rows.withColumn("c", sbe_check(*cols)).withColumn("secs", duration_secs(cols[0], cols[1]))
    return checked.select("set_id", "ordinal", "frames", "c.*", "secs")


def fix_rows(spark, sf_dir):
    _, rows, _ = fixed(spark, sf_dir)
    return rows.select(
        "set_id", "ordinal", "frames", "shifted_in", "shifted_out", "padding", "new_frames", "touched"
    )


def groups(spark, sf_dir):
    # Backward repair over short files leaves more boundaries where nothing moves.
    _, rows, longest = fixed(spark, sf_dir, "backward", ALIGNED_HALF)
    return R.independent_groups(rows, longest)


def ranges(spark, sf_dir):
    _, rows, longest = fixed(spark, sf_dir, "backward", SHORT_TRACKS)
    return R.repair_ranges(rows, longest)


def summary(spark, sf_dir):
    planned, rows, _ = fixed(spark, sf_dir, "forward", S.MIXED_TRACKS, False)
    return R.fix_summary(planned, rows)


# Half the files whole sectors already, so sets fall into independent groups.
ALIGNED_HALF = S.CD_TRACKS.replace(
    "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 97) * 588 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END",
)
# Empty and very short files, so ranges skip files and reach past them.
SHORT_TRACKS = S.CD_TRACKS.replace(
    "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) % 900 END",
)

SHIFT = {
    "backward": "r",
    "forward": "CASE WHEN r = 0 THEN 0 ELSE r - 588 END",
    "nearest": "CASE WHEN r <> 0 AND 588 - r < r THEN r - 588 ELSE r END",
}


def plan_sql(direction, text=S.CD_TRACKS, pad_tail=False):
    padding = "CASE WHEN whole % 588 <> 0 THEN 588 - whole % 588 END" if pad_tail else "CAST(NULL AS BIGINT)"
    done = "TRUE" if pad_tail else "whole % 588 = 0"
    return f"""
WITH t AS ({S.tracks_sql(text)}),
a AS (SELECT *, CAST(sum(coalesce(frames, 0)) OVER w % 588 AS BIGINT) AS r,
        lead(ordinal) OVER w AS next_ordinal, lead(frames) OVER w AS next_frames,
        CAST(sum(frames) OVER (PARTITION BY set_id) AS BIGINT) AS whole,
        CASE WHEN NOT (sample_rate = 44100 AND channels = 2 AND bits_per_sample = 16) THEN 'NOT_CDDA'
             WHEN frames IS NULL THEN 'NO_LENGTH' END AS bad
      FROM t WINDOW w AS (PARTITION BY set_id ORDER BY ordinal)),
b AS (SELECT *, CASE WHEN next_ordinal IS NOT NULL THEN {SHIFT[direction]} END AS s FROM a),
c AS (SELECT *, CASE WHEN s < 0 AND next_frames + s < 0 THEN next_ordinal END AS short_at FROM b),
d AS (SELECT set_id, min(CASE WHEN bad IS NOT NULL THEN ordinal END) AS bad_at,
        arg_min(bad, ordinal) FILTER (WHERE bad IS NOT NULL) AS bad_why, min(short_at) AS short_at
      FROM c GROUP BY set_id),
e AS (SELECT set_id, coalesce(bad_why, CASE WHEN short_at IS NOT NULL THEN 'TOO_SHORT' END) AS refused,
        CASE WHEN bad_why IS NOT NULL THEN bad_at ELSE short_at END AS refused_at FROM d),
plan AS (SELECT c.set_id, ordinal, frames, CASE WHEN refused IS NULL THEN CAST(s AS BIGINT) END AS shift,
        next_ordinal IS NULL AS is_last, CASE WHEN refused IS NULL THEN CAST({padding} AS BIGINT) END AS tail_padding,
        CASE WHEN refused IS NULL THEN {done} END AS fully_fixed, refused, refused_at
      FROM c JOIN e USING (set_id))"""


def rows_sql(direction, text, pad_tail):
    return f"""{plan_sql(direction, text, pad_tail)},
f AS (SELECT *, coalesce(lag(shift) OVER (PARTITION BY set_id ORDER BY ordinal), 0) AS shifted_in,
        coalesce(shift, 0) AS shifted_out,
        CASE WHEN is_last THEN coalesce(tail_padding, 0) ELSE 0 END AS padding
      FROM plan WHERE refused IS NULL),
fix AS (SELECT *, frames + shifted_in - shifted_out + padding AS new_frames,
        shifted_in <> 0 OR shifted_out <> 0 OR padding <> 0 AS touched FROM f)"""


PLAN_LIST = ", ".join(PLAN_COLUMNS)

QUERIES = {
    "sbe_check": (
        sbe,
        f"""
SELECT set_id, ordinal, frames,
  CASE WHEN reason IS NOT NULL THEN 'NOT_APPLICABLE' WHEN frames % 588 = 0 THEN 'ALIGNED' ELSE 'MISALIGNED' END AS sbe,
  CASE WHEN reason IS NULL AND frames % 588 <> 0 THEN frames % 588 END AS remainder_frames,
  reason, CAST(frames AS DOUBLE) / sample_rate AS secs
FROM (SELECT *, CASE WHEN sample_rate <> 44100 OR channels <> 2 OR bits_per_sample <> 16 THEN 'NOT_CDDA'
        WHEN frames IS NULL THEN 'NO_LENGTH' END AS reason FROM ({S.tracks_sql(S.MIXED_TRACKS)}))""",
    ),
    "plan_shift_backward": (plan("backward"), f"{plan_sql('backward')} SELECT {PLAN_LIST} FROM plan"),
    "plan_shift_forward": (
        plan("forward", pad_tail=True),
        f"{plan_sql('forward', pad_tail=True)} SELECT {PLAN_LIST} FROM plan",
    ),
    "plan_shift_nearest": (plan("nearest"), f"{plan_sql('nearest')} SELECT {PLAN_LIST} FROM plan"),
    "plan_shift_refused": (
        plan("nearest", S.MIXED_TRACKS),
        f"{plan_sql('nearest', S.MIXED_TRACKS)} SELECT {PLAN_LIST} FROM plan",
    ),
    "fix_rows": (
        fix_rows,
        f"""{rows_sql('nearest', S.CD_TRACKS, True)}
SELECT set_id, ordinal, frames, shifted_in, shifted_out, padding, new_frames, touched FROM fix""",
    ),
    "independent_groups": (
        groups,
        f"""{rows_sql('backward', ALIGNED_HALF, True)}
SELECT set_id, group_no, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal,
  count(*) AS files, bool_or(touched) AS touched
FROM (SELECT *, CAST(sum(CASE WHEN ordinal > 0 AND shifted_in = 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY set_id ORDER BY ordinal) AS BIGINT) AS group_no FROM fix)
GROUP BY set_id, group_no""",
    ),
    "repair_ranges": (
        ranges,
        f"""{rows_sql('backward', SHORT_TRACKS, True)},
s AS (SELECT *, new_frames - padding AS cut, CAST(sum(frames) OVER w AS BIGINT) AS old_end,
        CAST(sum(new_frames - padding) OVER w AS BIGINT) AS new_end
      FROM fix WINDOW w AS (PARTITION BY set_id ORDER BY ordinal))
SELECT o.set_id, n.ordinal AS output, o.ordinal AS source,
  greatest(o.old_end - o.frames, n.new_end - n.cut) - (o.old_end - o.frames) AS from_frame,
  least(o.old_end, n.new_end) - (o.old_end - o.frames) AS to_frame
FROM s o JOIN s n ON o.set_id = n.set_id
 AND greatest(o.old_end - o.frames, n.new_end - n.cut) < least(o.old_end, n.new_end)""",
    ),
    "fix_summary": (
        summary,
        f"""{rows_sql('forward', S.MIXED_TRACKS, False)}
SELECT p.set_id, p.files, p.refused IS NULL AS feasible, p.refused, p.refused_at, p.fully_fixed,
  p.tail_padding, p.boundaries_moved, x.files_touched
FROM (SELECT set_id, count(*) AS files, min(refused) AS refused, min(refused_at) AS refused_at,
        bool_and(fully_fixed) AS fully_fixed, max(tail_padding) AS tail_padding,
        count(*) FILTER (WHERE shift <> 0) AS boundaries_moved FROM plan GROUP BY set_id) p
LEFT JOIN (SELECT set_id, count(*) FILTER (WHERE touched) AS files_touched FROM fix GROUP BY set_id) x USING (set_id)""",
    ),
}
