import os
import random
import time
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeledger.llm import chat, decontaminate, exact_dedup, html_text, jaccard_join, line_dedup, mixing, quality, substring_dedup, toxicity
from tapeledger.llm.common import BATCH, BATCH_BYTES, short_batches, written
from tapeledger.llm.components import components
from tapeledger.llm.registry import all_queries
from tapeledger.plans.standins import TABLES
from tools.check_queries import canonical

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
SCHEMA = "doc_id long, text string, lang string, kept string, size int, `r` int, `odd name` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "mine", 5, 6, 7) for i, t in rows], SCHEMA)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


MESSY = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One  two"), (6, "one two"), (7, words(1, 60)), (8, words(1, 60)), (9, words(1, 60).upper()),
    (10, words(1, 58) + " other end"), (11, words(2, 3000)), (12, "É" * 150), (13, "aé " * 400), (14, words(3, 40) + "\n" + words(4, 30)), (15, words(4, 30) + "\n" + words(5, 9)),
    (16, words(4, 30)), (17, "x" * 300), (18, "x" * 120 + "y" + "x" * 120), (19, words(6, 30) + " " + words(1, 60)),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [tuple(r) for r in rows]


@given
@pytest.mark.parametrize("name", [n for n, (_, sql) in all_queries().items() if sql])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    run, sql = all_queries()[name]
    df, twin = run(spark, DATA), con.execute(sql)
    columns = [d[0] for d in twin.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, twin.fetchall())


# Line dedup


def test_line_dedup(spark):
    got = line_dedup.line_dedup(table(spark, MESSY))
    assert set(got.columns) == {"doc_id", "text", "lang", "kept", "size", "r", "odd name", "n_lines", "n_dropped", "kept_text", "kept_sha256"}
    assert {tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == plain.line_dedup(MESSY)


def test_line_dedup_counts_rows_and_null_ids(spark):
    line = "a line of twenty characters and more"
    rows = [(None, line), (7, f"  {line.upper()}\nshort"), (7, line), (3, f"{line}\n{line}")]
    got = line_dedup.line_dedup(table(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(map(tuple, got)) == Counter([(None, 1, 1, ""), (7, 2, 0, f"  {line.upper()}\nshort"), (7, 1, 0, line), (3, 2, 2, "")])
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_line_runs_are_compacted_and_hold_a_key_once(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(h, h, 1, b) for h in range(b, b + 4)], line_dedup.RUN_SCHEMA))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.runs().groupBy("h1").count().filter("count > 1").count() == 0
    assert sorted(tuple(r) for r in runs.totals().select("h1", "n_docs", "keeper").collect()) == [(h, min(h, 4) - max(0, h - 3) + 1, min(h, 4)) for h in range(8)]


# Mixing


@given
@pytest.mark.parametrize("block_rows", [50_000, 3])
def test_mixture_is_near_its_targets(spark, block_rows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(docs, block_rows=block_rows)
    assert got.filter("copies > 3 OR copies < 0").count() == 0
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest"), F.first("source_size").alias("all")).collect()
    assert sum(r.target for r in by) == pytest.approx(sum(r["all"] for r in by))
    assert all(abs(r.taken - r.target) <= 3 * r.longest * (1 if block_rows > 3 else 4) for r in by)
    assert mixing.emitted(got).count() == got.agg(F.sum("copies")).first()[0]
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(docs, block_rows=block_rows).collect()))


def test_mixture_of_odd_sources(spark):
    rows = [(1, "a b c", "s"), (2, None, None), (3, "a", ""), (3, "a", ""), (None, " ", "empty"), (4, "one two", "t")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.count() == 6 and got.agg(F.sum("size")).first()[0] == 7
    assert got.filter("source IS NULL AND target = 0 AND taken = 0").count() == 1
    targets = {r.source: r.target for r in got.select("source", "target").distinct().collect()}

    assert sum(targets.values()) == pytest.approx(7) and all(t <= 3 * s for t, s in ((targets[""], 2), (targets["s"], 3), (targets["t"], 2)))
    assert targets[""] == pytest.approx(targets["t"]) and targets["s"] == pytest.approx(targets["t"] / 5)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["b"] == pytest.approx(1080 * 2 / 3) or got["c"] == 300
    assert sum(got.values()) == pytest.approx(1110)


# Exact dedup


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_exact_dedup(spark, partitions):
    """With 40 partitions the common text overfills one and is dealt over several."""
    rows = MESSY + [(i, "the  same\ntext") for i in range(200, 100, -1)] + [(100, "the same text"), (100, "the same text"), (None, "the same text"), (None, "lone"), (None, "lone")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = exact_dedup.exact_dedup(table(spark, rows)).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(plain.re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for norm, ids in groups.items():
        mine = [r for r in got if plain.re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") == norm]
        least = min((i for i in ids if i is not None), default=None)
        assert all(r.group_size == len(ids) and r.keep_id == least and r.text_sha256 == plain.sha(norm) for r in mine)
        assert [r.doc_id for r in mine if r.kept] == [least]
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


# Jaccard join


def test_near_duplicates_of_messy_rows(spark):
    got = jaccard_join.near_duplicates(table(spark, MESSY))
    assert sorted(map(tuple, got.collect()), key=str) == plain.near_duplicates(MESSY)
    assert jaccard_join.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = words(10, 80), words(11, 80)
    rows = [(5, a), (5, b), (9, a + " x"), (12, b + " y"), (None, b + " z z"), (None, None), (20, words(12, 50))]
    got = {(r.id, r.component_id) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}
    assert got == {(5, None), (9, None), (12, None), (None, None), (20, 20)}


def test_near_duplicates_of_a_table_united_with_itself(spark):
    """Repeated rows count once: sets that share 60 of 80 shingles (0.6), or 42 (0.36), stay apart."""
    run = words(13, 64)
    rows = [(1, f"{run} {words(14, 20)}"), (2, f"{run} {words(15, 20)}"), (3, f"{words(16, 38)} {' '.join(run.split()[:46])}"), *MESSY[3:]]
    rows = [(i + 100 * (n > 2), t) for n, (i, t) in enumerate(rows)]
    twice = rows + rows + rows[:1]
    got = jaccard_join.near_duplicates(table(spark, twice).repartition(3))
    want = plain.near_duplicates(twice)
    assert sorted(map(tuple, got.collect()), key=str) == want and {(1, 80, 1), (2, 80, 2), (3, 80, 3)} <= set(want)


def test_stage_keeps_one_row_of_a_group_where_ids_repeat(spark):
    a, b, c = words(30, 80), words(31, 80), words(32, 80)
    rows = [(3, a + " x"), (5, a), (5, b), (7, c), (7, c + " y"), (7, c), (None, words(33, 80)), (None, words(33, 80) + " z"), (None, None), (None, None)]
    docs = table(spark, rows)
    got = jaccard_join.jaccard_stage(spark, docs, DATA)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, (r.text or "")[:20]) for r in got.collect())
    assert kept == Counter({(3, a[:20]): 1, (5, b[:20]): 1, (7, c[:20]): 1, (None, words(33, 80)[:20]): 1, (None, ""): 2})


def test_rows_of_a_frequent_token_are_dealt_over_tasks():
    token = pa.array([7] * 900 + [8, 9, 9, 5]).to_numpy()
    ids = pa.array([*range(900), 1, 2, 2, 3]).to_numpy()
    deal = jaccard_join._dealt(token, ids)
    assert list(deal[900:]) == [0, 0, 0, 0]  # one id each, if twice
    assert sorted(set(deal[:900]))[-1] == 1 and (deal[:900] == 1).sum() == 1 and len(set(deal[:900])) > 800 and (deal[:900] < 0).sum() == 899


def test_tokens_are_put_together_across_batches():
    lists = pa.array([[i, i + 1, i + 2] for i in range(6)], pa.list_(pa.int64()))
    whole = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([3] * 6, pa.int32()), lists], names=["id", "n", "tokens"])
    got = list(jaccard_join._held(iter([whole.slice(i, 1) for i in range(6)]), lambda n, tokens: tokens))
    assert [b.num_rows for b in got] == [18]
    assert got[0].equals(next(jaccard_join._held(iter([whole]), lambda n, tokens: tokens)))


@pytest.mark.parametrize("stage", ["toxicity", "jaccard_join", "decontamination"])
def test_stages_hand_texts_to_tasks_in_short_batches(spark, stage):
    spark.conf.unset(BATCH)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
    big = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = big.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    spark.conf.set(BATCH, "1m")
    short_batches(spark)
    assert spark.conf.get(BATCH) == "1m"
    spark.conf.unset(BATCH)


def test_tokens_of_several_ids(spark):
    rows = [(7, 1, 0), (7, 1, 0), (8, 1, 0), (8, 2, 0), (9, 5, 1), (9, 6, -4), (9, 7, -5), (9, 8, 0), (6, 1, 0)]
    got = jaccard_join._of_several(spark.createDataFrame(rows, "token long, id long, deal int"))
    assert sorted(map(tuple, got.collect())) == [(8, 1), (8, 2), (9, 5), (9, 6), (9, 7), (9, 8)]


def test_chains_of_near_copies(spark):
    """Neighbours are linked and far ones not, so the group only holds by many links."""
    base = words(20, 400).split()
    rows = [(i, " ".join(base[i * 12 : i * 12 + 120])) for i in range(20)]
    random.Random(1).shuffle(rows)
    got = jaccard_join.near_duplicates(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain.near_duplicates(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 500), (500, 7), (9, 9)] + [(1000, i) for i in range(1001, 1100)]
    random.Random(3).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 500: 1, 7: 1, **{i: 1000 for i in range(1000, 1100)}}


@given
def test_near_duplicates_agree_with_all_pairs(spark, documents):
    got = jaccard_join.op4_jaccard_join(spark, DATA)
    assert sorted(map(tuple, got.collect()), key=str) == plain.near_duplicates(documents)


# HTML extraction


def test_html_blocks():
    tree = html_text.trained()
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<nav><a href=x>Home</a></nav>", tree) == ""
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script></head><body>
      <header><h1>Site</h1></header><nav class="top-menu"><ul><li><a href="/a>b">A</a></li></ul></nav><!-- <p>no</p> -->
      <article><h1>Head &amp;amp; &lt;b&gt;</h1><p>One<br>two <a href="x">three</a>\t four<p>five<b>six</b></p>
        <div class="ad-slot"><p>Buy</p></div><p hidden>secret</p><aside>side</aside><p></p><form><p>mail</p></form>
        <section id="comments"><p>a reader says a long thing about this article</p></section><p>caf&eacute;</article>
      <div class="cookie-notice"><p>We use cookies</p></div><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page, tree) == "Head &amp; <b>\n\nOne two three four\n\nfivesix\n\ncafé"


def test_html_without_an_article_element():
    tree, long = html_text.trained(), words(30, 60)
    page = f"<div><a href=1>{words(31, 2)}</a></div><div>{long}<br></div><div><i>{long}</i></div><ul><li><a href=2>more</a></ul>"
    assert html_text.main_text(page, tree) == f"{long}\n\n{long}"
    assert html_text.main_text(f"<main><p>short</p><p>{long}", tree) == f"short\n\n{long}"


def test_html_words_links_and_neighbours_decide():
    tree = html_text.trained()
    long, short = words(40, 50), words(41, 6)
    # the same short block between long ones, and between links
    assert short in html_text.main_text(f"<div>{long}</div><div>{short}</div><div>{long}</div>", tree)
    links = "<div><a href=1>one two</a></div>"
    assert short not in html_text.main_text(f"{links}<div>{short}</div>{links}", tree)
    # the same long block as text, and as links
    assert html_text.main_text(f"<div>{long}</div>", tree) == long
    assert html_text.main_text(f"<div><a href=1>{long}</a></div>", tree) == ""
    # inside an article: a link among texts, and links among links
    assert html_text.main_text(f"<article><p>{long}</p><p><a href=1>{short}</a></p><p>{long}</p></article>", tree).count("\n\n") == 2
    assert html_text.main_text(f"<article><p>{long}</p>{links}{links}{links}</article>", tree).count("one two") <= 2
    # a name that says little does not decide alone
    assert html_text.main_text(f'<div class="side-story">{long}</div>', tree) == long
    assert html_text.main_text(f'<div class="side-story">{short}</div>', tree) == ""
    assert html_text.main_text(f'<div class="comments"><p>{long}</p></div><form>{long}</form>', tree) == ""


@pytest.mark.parametrize(
    "page", ["<a " * 330_000, '<a "' * 250_000, "<div>" * 100_000 + "</span>" * 100_000, "<div>" * 60_000 + "<span></span>" * 60_000, '<a ">"' * 160_000, "<head>" * 160_000, "<" * 1_000_000, "<!-- " * 200_000,
             "<p>" * 300_000, "<div hidden>" * 80_000, "<script>" * 120_000]
)
def test_html_of_a_megabyte_of_broken_markup(page):
    start = time.time()
    html_text.main_text(page, html_text.trained())
    assert time.time() - start < 10


@given
def test_html_query_agrees_with_the_article_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = html_text.op5_html(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        article = plain.re.search(r"<article>(.*?)</article>", pages[r.page_id], plain.re.S)[1]
        parts = [plain.re.sub(r"\s+", " ", html_text.unescape(plain.re.sub(r"<[^>]+>", " ", b))).strip() for b in plain.re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, "<article><p>x</article>", "old")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract_text(df).collect())) == [(1, "", 0), (1, "x", 1)]
    assert html_text.extract_text(df.limit(0)).count() == 0


# Substring dedup


def test_repeated_bytes_of_messy_rows(spark):
    got = substring_dedup.substring_dedup(table(spark, MESSY))
    assert {tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == plain.repeated_bytes(MESSY)
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_repeated_bytes_of_null_and_repeated_ids(spark):
    text = words(40, 100)
    rows = [(None, text), (3, text[50:]), (3, "0" + text), (3, "0" + text)]
    order = [rows[0], rows[2], rows[3], rows[1]]
    got = substring_dedup.substring_dedup(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {tuple(r) for r in got} == plain.repeated_bytes(order)


def test_repeated_bytes_across_parts_and_blocks(spark, monkeypatch):
    """Texts longer than a part, and grams with more contexts than one task takes."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 700)
    monkeypatch.setattr(substring_dedup, "BLOCK", 40)
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    passage = words(50, 30)
    rows = [(i, words(60 + i, 20 + 15 * i) + " " + passage[i : 150 + i] + " " + words(90 + i, 20)) for i in range(12)] + [(50, words(70, 400)), (51, "ab" + words(70, 400)[300:1900])]
    order = ["h", "salt", "r", "lead", "more", "id", "dup", "at"]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([t for _, t in rows])], names=["id", "dup", "text"])
    suffixes = pa.Table.from_batches(substring_dedup._suffix_rows(iter([batch]))).sort_by([(c, "ascending") for c in order])
    found = pa.Table.from_batches(substring_dedup._compared(iter(suffixes.to_batches(max_chunksize=7)))).to_pylist()
    texts, ranges = dict(rows), {}
    for f in found:
        if f["open"]:
            ranges.setdefault(f["id"], []).append({"a": f["a"], "b": f["b"]})
    near = pa.RecordBatch.from_pylist(
        [{"id": i, "dup": 0, "text": texts[i], "ranges": v} for i, v in ranges.items()],
        schema=pa.schema([("id", pa.int64()), ("dup", pa.int32()), ("text", pa.string()), ("ranges", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]),
    )
    windows = pa.Table.from_batches(substring_dedup._window_rows(iter([near]))).sort_by([(c, "ascending") for c in ("h", "g", "id", "dup", "at")])
    found += pa.Table.from_batches(substring_dedup._repeated_windows(iter(windows.to_batches(max_chunksize=5)))).to_pylist()
    gone = {i: bytearray(len(t)) for i, t in rows}
    for f in found:
        if not f["open"]:
            gone[f["id"]][f["a"] : f["b"]] = b"\1" * (f["b"] - f["a"])
    got = {(i, len(t), sum(gone[i]), plain.sha("".join(c for c, g in zip(t, gone[i], strict=True) if not g))) for i, t in rows}
    assert got == {(i, n, m, h) for i, n, m, _, h in plain.repeated_bytes(rows)}


def test_windows_move_as_four_numbers(spark):
    most = (1 << 31) - 1
    windows = [(7, 3, 1, 0, 9, 0), (7, 3, 1, 0, 4, 0), (7, 3, -(1 << 63), most, most, 0), (7, 2, 5, 1, 0, 0), (-1, most, 6, 0, 1 << 20, 0), (5, 0, 6, 2, most - 100, most), (6, 0, 6, 0, 0, 100)]
    dealt = substring_dedup._dealt_windows(spark.createDataFrame(windows, substring_dedup.WINDOW_ROWS))
    got = [tuple(r) for r in dealt.collect()]
    assert sorted(got) == sorted(windows)
    assert [w for w in got if w[0] == 7] == sorted(w for w in windows if w[0] == 7)
    assert len(dealt._jdf.queryExecution().optimizedPlan().children().head().children().head().output().toList().mkString(",").split(",")) == 4


def test_windows_leave_a_task_in_the_order_of_texts():
    texts = [words(80 + i, 60) for i in range(3)]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    near = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([0, 0, 0], pa.int32()), pa.array(texts), pa.array([[{"a": 0, "b": 40}]] * 3, kind)], names=["id", "dup", "text", "ranges"]
    )
    got = [(r["id"], r["at"]) for b in substring_dedup._window_rows(iter([near])) for r in b.to_pylist()]
    assert got == [(i, at) for i in (1, 2, 3) for at in range(41)]


@given
def test_repeated_bytes_agree_with_all_windows(spark, documents):
    assert {tuple(r) for r in substring_dedup.op6_suffix_dedup(spark, DATA).collect()} == plain.repeated_bytes(documents)


# Chat


def test_chat_reads_back(spark):
    rows = [
        (1, 1, "user", "a </s>[INST] \\[x\\]"), (1, 0, "system", "<<SYS>> <\\ [\\"), (1, 2, "assistant", "b\\"), (2, 5, "assistant", None), (2, 5, "assistant", "c"),
        (3, None, "user", "q"), (3, 1, "tool [/ROLE] ", "r"), (3, 2, None, ""), (None, 0, "user", "x"), (None, 1, "assistant", "\n<s>"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_chat(df).withColumn("back", chat.parse_chat(F.col("formatted"))).withColumn("learnt", chat.loss_text(F.col("segments"))).collect()}
    for conv, r in got.items():
        want = sorted((t, role or "", text or "") for c, t, role, text in [(c, -1 if t is None else t, a, b) for c, t, a, b in rows] if c == conv)
        assert [(b.role, b.text) for b in r.back] == [w[1:] for w in want]
        assert r.learnt == "".join(w[2] for w in want if w[1] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted and r.n_turns == len(want)
    assert {c: (r.valid, r.valid_turns) for c, r in got.items()} == {1: (True, 3), 2: (False, 0), 3: (False, 1), None: (True, 2)}
    assert chat.format_chat(df.limit(0)).count() == 0


# Toxicity, quality


def insulted(rng, roots, n):
    texts, labels = [], []
    for i in range(n):
        w = words(rng.random(), 40).split()
        if i % 3 == 0:
            w[rng.randrange(40)] = rng.choice(roots)
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_toxicity_finds_gapped_and_stretched_insults():
    rng = random.Random(5)
    machine = toxicity.train(*insulted(rng, ["moronix", "stupidly", "worthless"], 600))
    score = lambda *t: machine.scores(pa.array(list(t)))
    clean, plain_ones = [words(1000 + i, 30) for i in range(20)], ["so moronix it is", "a STUPIDLY", "worthless"]
    odd = ["a m.o.r.o.n.i.x b", "s t u p i d l y", "wor-thl*ess", "stuppidly", "worthlesss", "abc " * 50 + "mo_ronix"]
    assert (score(*plain_ones) >= 0.7).all() and (score(*odd) >= 0.7).all() and (score(*clean) < 0.7).mean() >= 0.95
    assert (score("", None, " \n") < 0.7).all() and score("x" * 100_000)[0] < 0.7


def plain_kernel(a, b):
    """Gap-weighted subsequences of three letters, all places of both words with each other."""

    def features(word):
        out = Counter()
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        size = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in combinations(range(len(word)), 3) if k - i < toxicity.SPAN) ** 0.5
        return {f: v / size for f, v in out.items()}

    x, y = features(a), features(b)
    return sum(v * y.get(f, 0) for f, v in x.items())


def test_toxicity_kernel_agrees_with_a_plain_one():
    known = ["moron", "moroon", "m0ron".replace("0", "o"), "worthless", "abc", "letters", "abracadabra", "moronically"]
    codes = [bytes(toxicity.CODES[np.frombuffer(w.encode(), np.uint8)]) for w in known]
    _, features = toxicity.expand(codes)
    got = features @ features.T
    for i, a in enumerate(known):
        for j, b in enumerate(known):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-5)


@given
@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_toxicity_of_held_out_labels(spark, size):
    folder = DATA.replace("0.001", size)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = docs.join(labels.filter(~toxicity.training_fold(F.col("doc_id"))).select("doc_id", "toxic"), "doc_id")
    found = toxicity.score_texts(held.select("doc_id", "text", "toxic"), toxicity.fitted(docs, labels))
    told = Counter((r.toxic, r.score >= toxicity.THRESHOLD) for r in found.select("toxic", "score").collect())
    assert told[1, True] >= 0.5 * (told[1, True] + told[1, False])
    assert told[1, True] >= 0.9 * (told[1, True] + told[0, True])


def test_toxicity_of_messy_rows(spark):
    machine = toxicity.train(*insulted(random.Random(6), ["moronix"], 300))
    df = table(spark, [*MESSY, (None, "moronix"), (4, "one")])
    got = toxicity.score_texts(df, machine)
    assert got.columns == [*df.columns, "score"] and got.count() == len(MESSY) + 2 and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score_texts(df, machine, keep=0.7).columns == df.columns
    assert toxicity.score_texts(df.limit(0), machine).count() == 0
    none = toxicity.fitted(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_texts(df, none).filter("score >= 0.7").count() == 0


@given
def test_toxicity_uses_no_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.training_fold(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.fitted(docs, labels), toxicity.fitted(docs, flipped)
    assert (a.table == b.table).all() and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_quality_orders_grades():
    rng, texts, grades = random.Random(7), [], []
    for i in range(600):
        w = words(rng.random(), 30).split()
        texts.append(" ".join([x.upper() + "!!" for x in w] if i % 3 == 0 else ["spam", *w] if i % 3 == 1 else w))
        grades.append(i % 3)
    model = quality.train(texts, grades, 3)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    tails = model.tails(pa.array(["LOUD!! WORDS!! HERE!!", words(2000, 30), "", None]))
    assert tails[0, 0] < 0.5 < tails[1, 0] and (tails[:, 0] >= tails[:, 1]).all()


def test_quality_of_messy_rows(spark):
    df = table(spark, [*MESSY, (None, None)])
    model = quality.fitted(df, quality.graded(spark.createDataFrame([(1, 1, 0), (7, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")))
    got = quality.graded_texts(df, model)
    assert got.count() == len(MESSY) + 1 and got.filter("expected_grade IS NULL OR tail_prob IS NULL").count() == 0
    assert quality.graded_texts(df.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_quality_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").filter(~toxicity.training_fold(F.col("doc_id")))
    got = quality.op9_quality(spark, data).join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.9 * len(got) and len(got) > 50


# Decontamination


def test_patterns_agree_with_the_full_table():
    rng = random.Random(8)
    for _ in range(200):
        item = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))) + item[rng.randint(0, 3) :] + "ab"
        assert decontaminate.Pattern(item).best(text)[0] == plain.least_distance(item, text)


def test_hits_agree_with_the_full_table(spark):
    rng, items = random.Random(9), [(i, words(200 + i, 12)) for i in range(6)] + [(90, None), (91, "  "), (92, "ab")]
    docs = []
    for i in range(30):
        item = items[i % 6][1]
        for _ in range(i % 8):
            at = rng.randrange(len(item))
            item = item[:at] + rng.choice(["", "q", "zz"]) + item[at + 1 :]
        docs.append((i, words(i, 15) + "  " + item.upper().replace(" ", "\n") + " " + words(300 + i, 10)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1])]
    got = decontaminate.benchmark_hits(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    want = Counter()
    for d, t in docs:
        for i, x in items:
            x = plain.normal(x)
            if x and t and (least := plain.least_distance(x, plain.normal(t))) <= int(len(x) * decontaminate.ERROR_RATE):
                want[d, i, least] += 1
    assert Counter((r.doc_id, r.item_id, r.distance) for r in got.collect()) == want and len(want) > 10


def test_items_in_blocks_give_the_same_hits(spark, monkeypatch):
    items = spark.createDataFrame([(i, words(i, 10)) for i in range(9)], "item_id long, text string")
    docs = table(spark, [(i, words(i % 12, 10)) for i in range(24)])
    whole = sorted(map(tuple, decontaminate.benchmark_hits(docs, items).collect()))
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", ("item_id", "text", 60))
    assert sorted(map(tuple, decontaminate.benchmark_hits(docs, items).collect())) == whole and len(whole) == 18
    assert decontaminate.without_hits(docs, items).count() == 6
    assert decontaminate.benchmark_hits(docs, items.limit(0)).count() == 0


# The pipeline


@given
def test_pipeline_agrees_with_plain_stages(spark, documents):
    toxic = {r.doc_id for r in toxicity.op8_toxicity(spark, DATA).filter("predicted = 1").collect()}
    left = [(i, t) for i, t in documents if i not in toxic]
    seen = {}
    for i, t in left:
        seen.setdefault(plain.re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    left = [(i, t) for i, _, c in plain.near_duplicates(list(seen.values())) if i == c for j, t in seen.values() if j == i]
    items = [plain.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = set()
    for i, t in left:
        text = plain.normal(t)
        pieces = [p for x in items for p in decontaminate.pieces(x) if p[1] in text]
        if pieces and any(plain.least_distance(x, text) <= int(len(x) * decontaminate.ERROR_RATE) for x in items if any(p in text for _, p in decontaminate.pieces(x))):
            leaked.add(i)
    kept = {i for i, _ in left if i not in leaked}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.col("doc_id").isin(list(kept)))
    want = Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect())
    assert got == want and leaked and len(kept) < len(documents)


def test_stages_keep_the_columns_of_documents(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "mixing"]


@given
def test_stages_take_odd_rows(spark):
    docs = table(spark, [*MESSY, (None, "null id"), (None, None), (4, "one")]).withColumn("source", F.lit(None).cast("string"))
    docs = docs.withColumns({c: F.lit(9) for c in ("copy", "TARGET", "id", "key", "token", "item_id")})
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DATA), "odd")  # written, so that names must not clash
        assert name == "mixing" or out.columns == docs.columns
        docs = out
    assert docs.count() > 0 and "TARGET" not in docs.columns and docs.filter("copy IS NULL OR size IS NULL").count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_the_mixing_stage_emits_what_the_mixture_takes(spark, repeated):
    rows = [(i, words(i, 1 + i % 40)) for i in range(60)]
    docs = table(spark, rows + rows if repeated else rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    want = mixing.emitted(mixing.mix(docs.drop("size"))).groupBy("doc_id", "text", "size").count().collect()
    got = mixing.mixing_stage(spark, docs, DATA).groupBy("doc_id", "text", "size").count().collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_items_of_any_type(spark):
    item = words(9, 30)
    bench = spark.createDataFrame([("x-1", item), (None, words(8, 30))], "item_id string, text string")
    docs = table(spark, [(1, f"before {item} after"), (2, words(7, 30)), (3, words(8, 30)), (None, item)])
    got = decontaminate.benchmark_hits(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == [("1", "x-1"), ("3", "None"), ("None", "x-1")]
