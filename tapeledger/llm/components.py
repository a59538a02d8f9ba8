"""Connected components of a graph of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.common import written


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _pairs(tied.unionAll(least.select("u", F.col("m").alias("v"))))


def hooked(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``: some smaller id that the node reaches, or its own.

    Two nodes with one component are connected; that connected ones have one is left to chance. It
    costs two groupings where ``components`` takes many, and joins stars, and stars of stars, whole.
    """
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    near = written(near, "hooks")
    far = near.select(F.col("node").alias("m"), F.col("m").alias("component"))
    return near.join(far, "m").select("node", "component")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest id reachable) of every node of ``edges`` (``u``, ``v``).

    Alternates large-star and small-star steps until the links are stars around the smallest ids;
    each step is written to the shared folder. A hub's links are reduced before they are shuffled.
    The driver sees one count and one sum of hashes a step. Loops and repeated links do no harm.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(_pairs(ordered), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = written(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
