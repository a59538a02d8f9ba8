import random

from pyspark.sql import functions as F

from conftest import rows
from tapeledger.operators.ordered import attach, first_occurrence, number_rows, scan_sets, text_parts


def sample():
    rnd = random.Random(7)
    out = []
    for s in range(6):
        n = 60 if s == 0 else rnd.randint(1, 9)
        for i in range(n):
            out.append((s, f"{rnd.random():.12f}", rnd.choice([None, 0, 1, 5, -3]), rnd.random() < 0.9))
    rnd.shuffle(out)
    return out


def test_number_and_scan_match_a_loop(spark, any_split):
    data = sample()
    df = spark.createDataFrame(data, "s int, k string, v int, ok boolean").repartition(5)
    numbered = number_rows(df, ["s"], ["k"])
    scanned = scan_sets(
        numbered,
        ["s"],
        running={"total": (F.sum, F.col("v")), "top": (F.max, F.col("v"))},
        nexts={"nxt": F.col("v")},
        prevs={"prv": F.struct(F.col("v"))},
        totals={"all_ok": (F.bool_and, F.col("ok")), "whole": (F.sum, F.col("v")), "low": (F.min, F.col("v"))},
    )
    want = []
    for s in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == s), key=lambda d: d[1])
        values = [d[2] for d in mine]
        known = [v for v in values if v is not None]
        for i, d in enumerate(mine):
            upto = [v for v in values[: i + 1] if v is not None]
            want.append(
                (
                    s, d[1], i, sum(upto) if upto else None, max(upto, default=None),
                    values[i + 1] if i + 1 < len(mine) else None,
                    (values[i - 1],) if i else None,
                    all(m[3] for m in mine), sum(known) if known else None, min(known, default=None),
                )
            )
    got = scanned.select("s", "k", "ordinal", "total", "top", "nxt", "prv", "all_ok", "whole", "low").collect()
    assert sorted(map(str, (tuple(r[:6]) + (tuple(r[6]) if r[6] is not None else None,) + tuple(r[7:]) for r in got))) == sorted(map(str, want))


def test_attach_keeps_every_row(spark, any_split):
    df = number_rows(spark.createDataFrame(sample(), "s int, k string, v int, ok boolean"), ["s"], ["k"])
    values = spark.createDataFrame([(0, "a"), (1, "b"), (9, "z")], "s int, w string")
    got = attach(df, values, ["s"])
    assert got.count() == df.count()
    assert {(r.s, r.w) for r in got.collect()} == {(0, "a"), (1, "b"), (2, None), (3, None), (4, None), (5, None)}


def test_first_occurrence_flags_one_row_per_group(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "n int, u string")
    got = first_occurrence(df, ["u"], F.col("n"))
    assert rows(got.select("n", "is_first")) == [(1, True), (2, False), (3, True), (4, False), (5, True)]


def test_text_parts_lose_nothing(spark):
    df = spark.range(25).select(F.lit("s").alias("set_id"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("line"))
    parts = text_parts(df, ["set_id"], "line", part_lines=10).orderBy("part").collect()
    assert len(parts) == 3
    assert "".join(p.text for p in parts) == "".join(f"{i}\n" for i in range(25))
