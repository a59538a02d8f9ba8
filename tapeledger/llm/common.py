"""What the text operators share: tables, the shared folder, column names, white space."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters every operator here means by "white space".
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches, from ``spark.checkpoint.dir``; a scratch one in local mode if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Shuffle files of a table that is written are of no further use; without this they fill the disks until the session ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_PLACES: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and it outlives lost executors."""
    spark = df.sparkSession
    path, before = new_table(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once everything that reads them is written itself."""
    for table in tables:
        path = _PLACES.pop(table, None)
        if path is not None:
            java = table.sparkSession._jvm
            place = java.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 22


def short_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python about ``BATCH_BYTES`` at a time, unless it has a bound of its own.

    Spark's bounds are 10,000 rows and 64 MB, which a task holds several times over in both processes.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def tidy(run):
    """``run``, a function on batches, that gives memory back at its end: the process waits for other tasks and would keep it."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Return what this process has freed to the system, where its C library can; a driver that trained a model keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast way where the text is plain ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed(df: DataFrame, name: str = "r") -> DataFrame:
    """All columns in one struct, so that no column of ours can clash with one of the caller's."""
    return df.select(F.struct(*[df[quoted(c)] for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], ours: list[str], name: str = "r") -> DataFrame:
    """The caller's columns, then ours; one of the caller's with a name of ours gives way to it."""
    taken = {c.lower() for c in ours}
    kept = [F.col(name)[c].alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *ours)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
