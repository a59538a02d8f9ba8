"""Order inside a set, without putting a whole set into one task.

Order is data here: it decides track numbers, stream offsets and repair chains. Rows carry an
``ordinal`` that is numbered once. Everything that depends on it is a *scan*: running sums,
neighbours and whole-set totals.

A set short enough for one task is scanned with plain windows over the set. When some set is
longer than ``BLOCK_ROWS`` every scan runs over blocks of at most that many consecutive rows:
each block is scanned on its own, the blocks' summaries (one row per block) are scanned per
set, and the two are joined on (set, block). Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeledger.session import cut_lineage

# Rows of one set that a single task may sort, unless the session sets its own bound.
BLOCK_ROWS = 1 << 18
BLOCK_ROWS_CONF = "spark.tapeledger.blockRows"
# Rows a task gets when whole sets are dealt out: more rows make more tasks, not larger ones.
TASK_ROWS = 1 << 17
# Counts a task hands on to bound the largest set.
BUCKETS = 1 << 16

Aggregate = tuple[Callable[[Column], Column], Column]


def rows_per_block(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS)))


def _counted(df: DataFrame, *by: str | Column) -> tuple[int, int]:
    """Rows in the largest group and in all: one map-side combined count, two numbers to the driver."""
    row = df.groupBy(*by).count().agg(F.max("count").alias("n"), F.sum("count").alias("rows")).first()
    return int(row["n"] or 0), int(row["rows"] or 0)


def set_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """A number of rows that no set exceeds, and the rows in all.

    Sets are counted in ``BUCKETS`` by hash, so that no task hands on more counts than these. Where the
    fullest bucket is no more than one task may sort, that bound will do; else ``df`` is read again
    and the largest set itself is counted.
    """
    bound = _counted(df, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
    return bound if bound[0] <= rows_per_block(df) else _counted(df, *keys)


def longest_set(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest set."""
    return _counted(df, *keys)[0]


def spread(df: DataFrame, keys: Sequence[str], rows: int | None, longest: int) -> DataFrame:
    """Deal whole sets out to as many tasks as ``rows`` rows need at ``TASK_ROWS`` each.

    The session's number of shuffle partitions holds for small inputs, where adaptive execution may
    lower it, for sets that are cut into blocks, and when the number of rows is not known.
    """
    parts = -(-(rows or 0) // TASK_ROWS)
    if longest > rows_per_block(df) or parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts, *keys)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    ordinal: str = "ordinal",
    longest: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its set. ``order`` must have no ties.

    ``rows``, the number of all rows if it is known, sets the number of tasks; scans of the result keep it.
    """
    keys = list(keys)
    longest = longest_set(df, keys) if longest is None else longest
    block_rows = rows_per_block(df)
    by_order = [F.col(c) if isinstance(c, str) else c for c in order]
    if longest <= block_rows:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by_order))
        return spread(df, keys, rows, longest).withColumn(ordinal, (place - 1).cast("long"))

    # A range partitioning sorts a long set over many tasks. Its bounds are sampled, so the
    # partition number is fixed by a checkpoint before two branches read it.
    sort_names = [f"_o{i}" for i in range(len(by_order))]
    keyed = df.withColumns(dict(zip(sort_names, by_order)))
    parts = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        -(-df.count() // BLOCK_ROWS),
    )
    ranged = cut_lineage(
        keyed.repartitionByRange(parts, *keys, *sort_names).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part")
        .count()
        .select(*keys, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*sort_names)
    return (
        ranged.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*keys, "_part"])
        .withColumn(ordinal, F.col("_offset") + F.col("_rn") - 1)
        .drop("_offset", "_rn", "_part", *sort_names)
    )


def scan_sets(
    df: DataFrame,
    keys: Sequence[str],
    running: Mapping[str, Aggregate] | None = None,
    nexts: Mapping[str, Column] | None = None,
    prevs: Mapping[str, Column] | None = None,
    totals: Mapping[str, Aggregate] | None = None,
    ordinal: str = "ordinal",
    longest: int | None = None,
) -> DataFrame:
    """Add scan columns to ``df``.

    ``running`` holds inclusive running aggregates, ``nexts`` / ``prevs`` the neighbour's value,
    ``totals`` aggregates over the whole set. ``running`` takes sum, max and min; ``totals``
    takes any aggregate that merges with itself (sum, min, max, bool_or, bool_and).
    """
    keys = list(keys)
    running, nexts, prevs, totals = (dict(m or {}) for m in (running, nexts, prevs, totals))
    longest = longest_set(df, keys) if longest is None else longest
    block_rows = rows_per_block(df)

    def windows(part_keys):
        ordered = Window.partitionBy(*part_keys).orderBy(ordinal)
        return ordered, ordered.rowsBetween(Window.unboundedPreceding, 0)

    if longest <= block_rows:
        ordered, upto = windows(keys)
        whole = Window.partitionBy(*keys)
        return df.withColumns(
            {n: agg(c).over(upto) for n, (agg, c) in running.items()}
            | {n: F.lead(c).over(ordered) for n, c in nexts.items()}
            | {n: F.lag(c).over(ordered) for n, c in prevs.items()}
            | {n: agg(c).over(whole) for n, (agg, c) in totals.items()}
        )

    blocked = df.withColumn("_block", F.floor(F.col(ordinal) / block_rows).cast("long"))
    part_keys = [*keys, "_block"]
    ordered, upto = windows(part_keys)
    local = blocked.withColumns(
        {f"_r_{n}": agg(c).over(upto) for n, (agg, c) in running.items()}
        | {f"_n_{n}": F.lead(F.struct(c.alias("v"))).over(ordered) for n, c in nexts.items()}
        | {f"_p_{n}": F.lag(F.struct(c.alias("v"))).over(ordered) for n, c in prevs.items()}
    )

    summary = blocked.groupBy(*part_keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[agg(c).alias(f"_s_{n}") for n, (agg, c) in running.items()],
        *[F.min_by(F.struct(c.alias("v")), ordinal).alias(f"_h_{n}") for n, c in nexts.items()],
        *[F.max_by(F.struct(c.alias("v")), ordinal).alias(f"_l_{n}") for n, c in prevs.items()],
        *[agg(c).alias(f"_t_{n}") for n, (agg, c) in totals.items()],
    )
    by_block = Window.partitionBy(*keys).orderBy("_block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    edges = summary.select(
        *part_keys,
        *[agg(F.col(f"_s_{n}")).over(earlier).alias(f"_b_{n}") for n, (agg, _) in running.items()],
        *[F.lead(f"_h_{n}").over(by_block).alias(f"_nb_{n}") for n in nexts],
        *[F.lag(f"_l_{n}").over(by_block).alias(f"_pb_{n}") for n in prevs],
        *[agg(F.col(f"_t_{n}")).over(every).alias(n) for n, (agg, _) in totals.items()],
    )
    joined = local.join(edges, part_keys)
    out = joined.withColumns(
        {n: _carry(agg, f"_b_{n}", f"_r_{n}") for n, (agg, _) in running.items()}
        | {n: F.coalesce(f"_n_{n}", f"_nb_{n}")["v"] for n in nexts}
        | {n: F.coalesce(f"_p_{n}", f"_pb_{n}")["v"] for n in prevs}
    )
    return out.select(*df.columns, *running, *nexts, *prevs, *totals)


def _carry(agg, before: str, local: str) -> Column:
    if agg is F.sum:
        both = F.col(before) + F.col(local)
        return F.coalesce(both, F.col(local), F.col(before))
    merge = {F.max: F.greatest, F.min: F.least}[agg]
    return merge(F.col(before), F.col(local))


def attach(
    rows: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    ordinal: str = "ordinal",
    longest: int | None = None,
) -> DataFrame:
    """Join one-row-per-set ``values`` onto ``rows``; a long set is spread over its blocks."""
    keys = list(keys)
    longest = longest_set(rows, keys) if longest is None else longest
    block_rows = rows_per_block(rows)
    if longest <= block_rows:
        return rows.join(values, keys, how)
    block = F.floor(F.col(ordinal) / block_rows).cast("long")
    blocks = rows.select(*keys, block.alias("_block")).distinct()
    spread = values.join(blocks, keys)
    return rows.withColumn("_block", block).join(spread, [*keys, "_block"], how).drop("_block")


def first_occurrence(
    df: DataFrame, keys: Sequence[str], order: Column, flag: str = "is_first"
) -> DataFrame:
    """Flag the first row of each group of duplicates; groups of any size merge map-side."""
    keys = list(keys)
    firsts = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    joined = df.alias("a").join(firsts.alias("b"), same, "left")
    return joined.select("a.*", (order == F.col("b._first")).alias(flag))


def submission_order(results: DataFrame, *order: str) -> DataFrame:
    """Results in the order they were asked for, whatever order they finished in."""
    return results.orderBy(*(order or ("set_id", "ordinal")))


def text_parts(
    lines: DataFrame,
    keys: Sequence[str],
    line: str,
    end: str = "\n",
    ordinal: str = "ordinal",
    part_lines: int = 10_000,
) -> DataFrame:
    """Join ordered lines into text, at most ``part_lines`` lines a row.

    Parts laid end to end in ``part`` order are the document, so a document of any length
    stays whole without any row having to hold it.
    """
    part = F.floor(F.col(ordinal) / part_lines).cast("long")
    pairs = F.array_sort(F.collect_list(F.struct(ordinal, line)))
    text = F.concat(F.array_join(F.transform(pairs, lambda p: p[line]), end), F.lit(end))
    return lines.withColumn("part", part).groupBy(*keys, "part").agg(text.alias("text"))
