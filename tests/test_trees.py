"""Folders as they are on disk, lines numbered where they stand, and names judged in one pass."""

import os
import random

from pyspark.sql import functions as F

from conftest import rows
from tapeledger.operators import quality as Q
from tapeledger.operators import rename as R
from tapeledger.sources.opening import list_tree
from tapeledger.sources.text import read_lines


def grow(root):
    for name in ("a.flac", "disc 1/b.flac", "disc 1/.DS_Store", "noise/.DS_Store", "outer/inner/.keep/x.txt", "täpe/c.flac"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    for name in ("nothing", "shell/hollow/core"):
        (root / name).mkdir(parents=True)
    return root


def test_what_a_selection_leaves_out(spark, tmp_path):
    root = grow(tmp_path / "show")
    short = lambda df: {(r.path.split("/show/", 1)[-1], r.reason) for r in df.collect()}
    noise = {("disc 1/.DS_Store", "NOISE"), ("noise/.DS_Store", "NOISE")}
    empty = {("nothing", "EMPTY_DIRECTORY"), ("shell/hollow/core", "EMPTY_DIRECTORY")}
    assert short(Q.disk_selection(spark, str(root))) == noise | empty | {("noise", "EMPTY_DIRECTORY")}
    assert short(Q.disk_selection(spark, str(root), include_all=True)) == empty
    os.symlink(root, root / "disc 1" / "back")  # a link to a folder above it
    os.symlink(root / "a.flac", root / "link.flac")
    os.symlink(root / "gone", root / "dangling")
    links = {(n, "SYMLINK") for n in ("disc 1/back", "link.flac", "dangling")}
    assert short(Q.disk_selection(spark, [str(root) + "/"])) == noise | empty | links | {("noise", "EMPTY_DIRECTORY")}
    refused = Q.disk_selection(spark, [str(root), "nowhere://host/folder"]).filter(F.col("reason").startswith("UNLISTED")).collect()
    assert [r.path for r in refused] == ["nowhere://host/folder"]


def test_contents_are_carried_up_the_tree(spark, tmp_path):
    root = grow(tmp_path / "show")
    tree = list_tree(spark, str(root))
    got = {r.path.split("/show/", 1)[-1]: (r.entries, r.files_below) for r in Q.folder_contents(tree).collect() if r.kind == "dir"}
    assert got == {
        "disc 1": (1, 1), "noise": (0, 0), "outer": (1, 1), "outer/inner": (1, 1), "outer/inner/.keep": (1, 1), "täpe": (1, 1), "nothing": (0, 0),
        "shell": (1, 0), "shell/hollow": (1, 0), "shell/hollow/core": (0, 0),
    }


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"f{i}.txt": "".join("x" * rng.randint(0, 60) + "\n" for _ in range(rng.choice([0, 1, 3000]))) for i in range(6)}
    texts["long.txt"] = "".join(f"line {i}\n" for i in range(40_000)) + "no end"
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_lines(spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "text" not in plan.lower().replace("list_path", "")  # the text is not read again, nor sorted
    want = [(n, i + 1, line) for n, text in texts.items() for i, line in enumerate(text.splitlines())]
    assert sorted((r.list_path.rsplit("/", 1)[1], r.line_no, r.line) for r in got) == sorted(want)


def test_names_are_judged_in_one_pass(spark):
    plan = [
        ("s", 0, "d/a", "d/b"), ("s", 1, "d/b", "d/c"), ("s", 2, "d/e", "d/f"), ("s", 3, "d/g", "d/g"),
        ("t", 0, "d/x", "d/a"), ("t", 1, "k/y", "k/z"), ("t", 2, "k/w", "k/z"), ("u", 0, "m/a", "m/new"),
    ]
    df = spark.createDataFrame(plan, "set_id string, ordinal long, from_path string, to_path string")
    disk = spark.createDataFrame([(p,) for p in ("d/a", "d/b", "d/f", "d/g", "k/z", "k/z", "d/a", None)], "path string")
    judged = {(r.set_id, r.ordinal): (r.status, r.conflict) for r in R.judged_plan(df, disk).collect()}
    assert judged == {
        ("s", 0): ("CHANGED", False), ("s", 1): ("CHANGED", False), ("s", 2): ("CHANGED", True), ("s", 3): ("UNCHANGED", False),
        ("t", 0): ("CHANGED", True), ("t", 1): ("COLLISION", False), ("t", 2): ("COLLISION", False), ("u", 0): ("CHANGED", False),
    }
    assert rows(R.rename_collisions(df).select("set_id", "ordinal", "status")) == sorted((*k, v[0]) for k, v in judged.items())
    old = R.rename_verdict(R.rename_collisions(df), R.rename_conflicts(df, disk))
    report = R.rename_report(df, disk)
    assert rows(report) == rows(old.select(*report.columns))
    plan_text = R.rename_report(df, disk)._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("Exchange hashpartitioning") == 2 and "Join" not in plan_text  # by path, then by set
