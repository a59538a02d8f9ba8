"""Session-level settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a scratch one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if configured:
        if not known:
            context.setCheckpointDir(configured)
        return configured
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so later plans see one fixed set of rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: computed once, read by column, its size known to later plans."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Spark 4.1 lets a union claim its inputs' partitioning. Adaptive execution may then re-plan the
# inputs apart, and a grouping that skipped its shuffle on the strength of that claim sees one
# key in several tasks. Off, a grouping after a union always shuffles.
UNION_PARTITIONING_CONF = "spark.sql.unionOutputPartitioning"


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name, duplicates kept, safe to group afterwards."""
    frames[0].sparkSession.conf.set(UNION_PARTITIONING_CONF, "false")
    return reduce(lambda a, b: a.unionByName(b), frames)
