import random

import pytest

from tapeledger.operators import repair as R

SCHEMA = "set_id string, ordinal long, frames long, sample_rate int, channels int, bits_per_sample int"


def table(spark, sets):
    data = [(s, i, f, 44100 if f != "hi" else 48000, 2, 16) for s, frames in sets.items() for i, f in enumerate(frames)]
    data = [(s, i, None if f == "hi" else f, rate, c, b) for s, i, f, rate, c, b in data]
    return spark.createDataFrame(data, SCHEMA)


def walk(frames, direction):
    """The rule as it reads: boundary after boundary, each changing what the next file holds."""
    now, shifts = list(frames), []
    for i in range(len(now) - 1):
        r = now[i] % 588
        if r == 0:
            s = 0
        elif direction == "backward":
            s = r
        elif direction == "forward":
            s = r - 588
        else:
            s = r - 588 if 588 - r < r else r
        if s < 0 and now[i + 1] + s < 0:
            return None, i + 1
        now[i] -= s
        now[i + 1] += s
        shifts.append(s)
    return shifts, now[-1] % 588


@pytest.mark.parametrize("direction, frames, want", [("backward", [5883, 11760], 3), ("forward", [5883, 11760], -585), ("nearest", [6465, 11760], -3)])
def test_one_boundary(spark, direction, frames, want):
    got = R.plan_shift(table(spark, {"s": frames}), direction).orderBy("ordinal").collect()
    assert [r["shift"] for r in got] == [want, None]


def test_tail(spark):
    rows = R.plan_shift(table(spark, {"s": [5883, 11760, 2940]}), "backward").orderBy("ordinal").collect()
    assert [r["shift"] for r in rows] == [3, 3, None]
    assert [r.fully_fixed for r in rows] == [False] * 3
    padded = R.plan_shift(table(spark, {"s": [6021]}), "backward", pad_tail=True)
    assert [(r.tail_padding, r.fully_fixed) for r in padded.collect()] == [(447, True)]
    fixed = R.fix_rows(R.plan_shift(table(spark, {"s": [2264, 10, 1176]}), "backward", pad_tail=True))
    assert [r.new_frames for r in fixed.orderBy("ordinal").collect()] == [1764, 0, 1764]


def test_random_sets_match_the_walk(spark, any_split):
    rnd = random.Random(3)
    sets = {
        f"s{n}": [rnd.choice([0, rnd.randrange(2000), 588 * rnd.randrange(4)]) for _ in range(rnd.randint(1, 25))]
        for n in range(60)
    }
    for direction in ("backward", "forward", "nearest"):
        plan = R.plan_shift(table(spark, sets), direction, pad_tail=True)
        got = {}
        for r in plan.collect():
            got.setdefault(r.set_id, {})[r.ordinal] = r
        for s, frames in sets.items():
            shifts, tail = walk(frames, direction)
            mine = [got[s][i] for i in range(len(frames))]
            if shifts is None:
                assert {(r.refused, r.refused_at, r["shift"]) for r in mine} == {("TOO_SHORT", tail, None)}
            else:
                assert [r["shift"] for r in mine] == [*shifts, None]
                assert mine[0].tail_padding == (588 - tail if tail else None)


def test_refusals_name_the_first_file(spark, any_split):
    sets = {"a": [588, "hi", 10], "b": [588, None, "hi"], "c": [600, 588]}
    got = {r.set_id: (r.refused, r.refused_at) for r in R.plan_shift(table(spark, sets), "backward").collect()}
    assert got == {"a": ("NOT_CDDA", 1), "b": ("NO_LENGTH", 1), "c": (None, None)}


def naive_ranges(old, new):
    out, j, at = [], 0, 0
    for o, need in enumerate(new):
        while need:
            left = old[j] - at
            if left == 0:
                j, at = j + 1, 0
                continue
            take = min(need, left)
            out.append((o, j, at, at + take))
            at, need = at + take, need - take
    return out


def test_ranges(spark, any_split):
    schema = "set_id string, ordinal long, frames long, new_frames long, padding long, is_last boolean"
    rnd = random.Random(5)
    sets = {"doc": ([10, 5, 8], [7, 10, 6])}
    for n in range(20):
        old = [rnd.choice([0, 0, rnd.randrange(20)]) for _ in range(rnd.randint(1, 12))]
        cuts = sorted(rnd.randint(0, sum(old)) for _ in range(len(old) - 1))
        new = [b - a for a, b in zip([0, *cuts], [*cuts, sum(old)])]
        sets[f"r{n}"] = (old, new)
    data = [
        (s, i, o, n + (5 if i == len(old) - 1 else 0), 5 if i == len(old) - 1 else 0, i == len(old) - 1)
        for s, (old, new) in sets.items()
        for i, (o, n) in enumerate(zip(old, new))
    ]
    got = {}
    for r in R.repair_ranges(spark.createDataFrame(data, schema)).collect():
        got.setdefault(r.set_id, []).append((r.output, r.source, r.from_frame, r.to_frame))
    for s, (old, new) in sets.items():
        assert sorted(got.get(s, [])) == naive_ranges(old, new), s


def test_groups_cut_where_nothing_moves(spark, any_split):
    rows = R.fix_rows(R.plan_shift(table(spark, {"s": [588, 589, 587, 588, 1176, 600]}), "backward", pad_tail=True))
    got = [(r.first_ordinal, r.last_ordinal, r.touched) for r in R.independent_groups(rows).orderBy("group_no").collect()]
    assert got == [(0, 0, False), (1, 2, True), (3, 3, False), (4, 4, False), (5, 5, True)]


def test_set_format(spark):
    data = [("a", 0, "FLAC", "x"), ("a", 1, "FLAC", "y"), ("b", 0, "FLAC", "x"), ("b", 1, "WAV", "y"), ("b", 2, "APE", "z"), ("c", 0, "APE", "x"), ("c", 1, "WAV", "y")]
    got = {r.set_id: tuple(r)[1:] for r in R.set_format(spark.createDataFrame(data, "set_id string, ordinal long, format string, file_name string")).collect()}
    assert got == {"a": ("FLAC", None, None), "b": (None, "MIXED", "y"), "c": (None, "UNSUPPORTED", "x")}
