"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeledger.llm.common import WORD, packed, read, unpacked, written

OURS = ["size", "source_size", "target", "copies", "taken"]
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42
BLOCK_ROWS = 5_000
SOURCE = ["source_key", "no_source"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source with its ``source_size``, ``n_docs`` and ``target``.

    ``sizes`` has ``source`` and ``size``. Sources by code point, null last, take the weights in
    turn and share the sum of all sizes; a target stops at ``cap`` times its source's size, and
    what is over is shared anew by weight until none is above. Only sums reach the driver; the
    ranking of the sources, one row each, is the one step that is not shared out.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = written(by_source.withColumn("weight", weight), "sources")
    total, weight_sum = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / (weight_sum or 1)
    most = cap * F.col("source_size")
    while total:
        full = most <= F.lit(level) * F.col("weight")
        capped, free = table.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (total - (capped or 0)) / free
        if raised == level:
            break
        level = raised
    share = F.lit(level) * F.col("weight")
    return table.select("source", "source_size", "n_docs", F.when(most <= share, most.cast("double")).otherwise(share).alias("target"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
    size_col: str | None = None,
    key_cols: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document enters a mixture of the sources, by systematic sampling.

    Returns all rows and columns of ``df`` plus ``size`` (words), ``source_size``, ``target`` (words,
    of the source), ``copies`` and ``taken`` (words: copies times size); columns of ``df`` with these
    names are replaced. Every document of a source expects ``target / source_size`` copies. The
    expected copies are summed up in order of size, one random offset per source (fixed by ``seed``)
    is added, and a document is taken once for each whole number its sum crosses, so the words taken
    differ from the target by little more than the longest document. No document is taken over
    ``cap`` times. Null texts have size 0, a null source is a source of its own, repeated rows count
    each, an empty table gives an empty table, and a source without words has target 0.

    All columns of ``df`` go through one shuffle. Where only the numbers are wanted, pass narrow rows
    with a column of sizes (``size_col``) in place of texts; ``key_cols`` put rows of one size and id in order.

    A running number in a source is the number within a block of about ``block_rows`` documents
    plus the sizes of earlier blocks, so the largest source is sorted by many tasks.
    """
    columns = df.columns
    r = F.col("r")
    size = word_count(r[text_col]) if size_col is None else r[size_col]
    keyed = packed(df).select("r", r[source_col].alias("source"), size.alias("size"))
    targets = source_targets(keyed.select("source", "size"), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 3), 16, 10).cast("double")
    known = targets.select(
        *_key(F.col("source")), "source_size", "target", rate.alias("rate"), ((draw + 0.5) / 4096).alias("offset"), F.ceil(F.col("n_docs") / block_rows).alias("blocks")
    )
    spread = F.conv(F.substring(F.md5(F.coalesce(r[id_col].cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    rows = keyed.select("r", "size", *_key(F.col("source"))).join(known, SOURCE).withColumn("block", F.pmod(spread, F.col("blocks")))
    counts = keyed.select(r[id_col].alias("id"), *_key(F.col("source"))).join(known.select(*SOURCE, "blocks"), SOURCE)
    spread_id = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    counts = counts.groupBy(*SOURCE, F.pmod(spread_id, F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*SOURCE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*SOURCE, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    in_block = Window.partitionBy(*SOURCE, "block").orderBy("size", r[id_col], *[r[c] for c in key_cols])
    numbered = rows.withColumn("nth", F.row_number().over(in_block)).join(before, [*SOURCE, "block"]).withColumn("nth", F.col("nth") + F.col("before"))
    crossed = F.floor(F.col("rate") * F.col("nth") + F.col("offset")) - F.floor(F.col("rate") * (F.col("nth") - 1) + F.col("offset"))
    out = numbered.select("r", "size", "source_size", "target", crossed.cast("long").alias("copies"))
    return unpacked(out.withColumn("taken", F.col("copies") * F.col("size")), columns, OURS)


def _key(source) -> list:
    return [F.coalesce(source, F.lit("")).alias(SOURCE[0]), source.isNull().alias(SOURCE[1])]


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of a mixture, each as often as it is taken, numbered by ``copy`` from 1."""
    return mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix(docs, size_col="words").select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, once for each time they are taken, numbered by ``copy``.

    All columns of ``docs`` stay, but for those named as ``copy`` or a column that ``mix`` adds, which are
    replaced. Null and empty texts have size 0 and may be taken; a null source is a source of its own; repeated
    rows and rows of one or no id are documents each; an empty table gives an empty table.

    Only ids, sources and sizes are numbered. Rows meet their numbers in one hash join that holds the numbers and
    streams the texts. Ids are the keys; if some are repeated or null, rows are first numbered in a table.
    """
    ours = ["copy", "size", "source_size", "target", "taken"]
    rows = packed(docs)
    r = F.col("r")
    ids = rows.select(r["doc_id"].alias("id")).groupBy("id").count()
    if ids.filter("count > 1 OR id IS NULL").limit(1).count():
        rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
    else:
        rows = rows.withColumn("key", r["doc_id"])
    narrow = rows.select("key", r["doc_id"].alias("doc_id"), r["source"].alias("source"), word_count(r["text"]).alias("words"))
    taken = emitted(mix(narrow, size_col="words", key_cols=("key",)))
    numbers = written(taken.select("key", *ours), "numbers")
    return unpacked(rows.join(numbers.hint("shuffle_hash"), "key"), docs.columns, ours)


QUERIES = {
    "op2_mixing": (
        op2_mixing,
        r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
  [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight FROM d GROUP BY source),
t AS (SELECT sum(source_size)::DOUBLE AS total, sum(weight) AS weight_sum FROM s),
step(k, level) AS (
  SELECT 0, total / weight_sum FROM t
  UNION ALL
  SELECT k + 1, (SELECT (max(total) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size <= level * weight), 0)) / sum(weight) FILTER (WHERE 3 * source_size > level * weight) FROM s, t)
  FROM step WHERE k < 30),
g AS (SELECT source, source_size, CASE WHEN 3 * source_size <= level * weight THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target,
  ceil(n_docs / 5000.0)::BIGINT AS blocks, (('0x' || substr(md5('42/' || coalesce(source, '')), 1, 3))::BIGINT + 0.5::DOUBLE) / 4096 AS u
  FROM s, (SELECT level FROM step WHERE k = 30)),
n AS (SELECT d.doc_id, d.size, g.source_size, g.target, u, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks, d.size, d.doc_id) AS nth
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(rate * nth + u) - floor(rate * (nth - 1) + u)) * size)::BIGINT AS taken FROM n""",
    )
}
