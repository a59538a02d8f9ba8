"""Work of a task stays bounded while tables grow, and what is the same for every row is done once."""

import contextlib
import io
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tapeledger.functions import names as N
from tapeledger.operators import ordered as O
from tapeledger.plans.registry import all_queries

SMALL = "/root/testdata/sf0.001"


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["rename_collisions", "info_file_name", "repair_ranges", "rename_target", "rename_conflicts", "render_setlists", "resolve_trackers"])
def test_more_rows_make_more_tasks(spark, monkeypatch, name):
    run = all_queries()[name][0]
    want = rows(run(spark, SMALL))
    monkeypatch.setattr(O, "TASK_ROWS", 200)
    df = run(spark, SMALL)
    # 6,000 lines are thirty tasks' rows; the session asks for four.
    assert df.rdd.getNumPartitions() >= 30
    assert rows(df) == want


def test_problems_deal_whole_sets_out(spark, monkeypatch):
    run = all_queries()["setlist_problems"][0]
    want = rows(run(spark, SMALL))
    monkeypatch.setattr(O, "TASK_ROWS", 200)
    assert rows(run(spark, SMALL)) == want
    assert "REPARTITION_BY_NUM" in explained(O.spread(spark.range(10), ["id"], 6000, 1))


def test_sets_cut_into_blocks_are_not_dealt_out_whole(spark, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", 2)
    df = spark.range(100)
    assert O.spread(df, ["id"], 100, O.rows_per_block(df) + 1) is df
    assert O.spread(df, ["id"], None, 1) is df


def test_collisions_are_counted_where_sets_stand(spark):
    plan = explained(all_queries()["rename_collisions"][0](spark, SMALL))
    assert plan.count("lineitem.parquet") == 1


def test_name_of_many_dashes(spark):
    name = "gd" + "-00-00" * 20_000 + "-1977-05-08t1.flac"
    df = spark.createDataFrame([(name,)], "name string")
    start = time.time()
    got = df.select(N.parse_track_name(F.col("name")).alias("p")).first().p
    assert time.time() - start < 20
    assert (len(got.band), str(got.date), got.track) == (120_003, "1977-05-08", 1)


def test_leap_days(spark):
    years = ["1900", "2000", "1904", "1903", "0000", "0004", "00", "04", "31", "32"]
    df = spark.createDataFrame([(y, f"gd{y}-02-29t1.x") for y in years], "y string, name string")
    got = {r.y: r.p and (r.p.band, str(r.p.date)) for r in df.select("y", N.parse_track_name(F.col("name")).alias("p")).collect()}
    assert got == {
        "1900": ("gd19", "2000-02-29"), "2000": ("gd", "2000-02-29"), "1904": ("gd", "1904-02-29"), "1903": None, "0000": ("gd00", "2000-02-29"),
        "0004": ("gd", "0004-02-29"), "00": ("gd", "2000-02-29"), "04": ("gd", "2004-02-29"), "31": None, "32": ("gd", "1932-02-29"),
    }


def test_slug_and_sanitized_text_share_their_pass(spark):
    df = all_queries()["sanitize_slug"][0](spark, SMALL)
    assert "[^A-Za-z0-9]," not in explained(df)
    text = spark.createDataFrame([(" Ä.b_C-d\t\n1 ",), ("",), (None,)], "t string")
    got = text.select(N.sanitize(F.col("t")), N.slug(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(".b_C-d1", "bcd1"), ("", ""), (None, None)]


def test_only_one_path_moves_when_a_plan_is_judged(spark):
    plan = explained(all_queries()["rename_conflicts"][0](spark, SMALL))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("from_path" in line for line in windows)


def test_specs_are_resolved_in_one_pass(spark):
    assert explained(all_queries()["resolve_trackers"][0](spark, SMALL)).count("lineitem.parquet") == 1


def test_modes_are_parsed_once(spark):
    assert "regexp" not in explained(all_queries()["clip_plan"][0](spark, SMALL)).lower()


def test_headers_move_lines_and_look_up_what_is_asked(spark):
    plan = explained(all_queries()["read_flac_headers"][0](spark, SMALL))
    shuffled, after = plan.split("Exchange hashpartitioning")[1], plan.split("Exchange hashpartitioning")[0]
    # Digests and lengths are made of a line's own columns, where it stands in its set.
    assert "md5" not in shuffled and "md5" in after
    assert "TITLE" in plan and "ALBUM" not in plan and "LOCATION" not in plan


def test_sets_are_bounded_by_buckets_and_long_ones_counted(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") < 50, 0).otherwise(F.col("id")).alias("k"))
    monkeypatch.setattr(O, "BUCKETS", 4)
    most, all_rows = O.set_sizes(df, ["k"])
    assert 750 <= most <= 3000 and all_rows == 3000
    # A bound over a task's rows says nothing about the sets.
    monkeypatch.setattr(O, "BLOCK_ROWS", 700)
    assert O.set_sizes(df, ["k"]) == (50, 3000) and O.longest_set(df, ["k"]) == 50
    assert O.set_sizes(df.limit(0), ["k"]) == (0, 0)
    nulls = spark.createDataFrame([(None,)] * 5 + [(1,)], "k long")
    assert O.set_sizes(nulls, ["k"])[1] == 6 and O.set_sizes(nulls, ["k"])[0] >= 5
