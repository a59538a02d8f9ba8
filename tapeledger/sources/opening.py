"""Opening a file inside a task, from its bytes or from its path."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapeledger.session import cut_lineage, union_all

# Bytes of file contents a task hands on at a time.
FLUSH_BYTES = 1 << 25
# What a value without a place in its column raises.
UNFIT = (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError)


def locate(path: str):
    """The store a path lives in, its name there, and what to put before names to get paths."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path, "file:"
    store, inside = fs.FileSystem.from_uri(quote(path, safe="/:"))
    return store, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def open_path(path: str):
    """A seekable file for a local path or any address the storage layer knows."""
    store, inside, _ = locate(path)
    return store.open_input_file(inside)


LISTED = "path string, file_size bigint, is_dir boolean, reason string"


def _listing(path: str) -> Iterator[tuple[str, int | None, bool, str | None]]:
    """A file itself, or what a folder holds; one that cannot be listed is a row with the reason."""
    try:
        store, inside, before = locate(path)
        info = store.get_file_info(inside)
        if info.type != fs.FileType.Directory:
            size = info.size if info.type == fs.FileType.File else None
            yield before + inside, size, False, None
            return
        for entry in store.get_file_info(fs.FileSelector(inside)):
            is_dir = entry.type == fs.FileType.Directory
            yield before + entry.path, None if is_dir else entry.size, is_dir, None
    except (OSError, ValueError) as e:
        yield path, None, False, f"UNLISTED: {e}"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = _listing(path)
            while chunk := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*chunk), (pa.string(), pa.int64(), pa.bool_(), pa.string()))],
                    names=["path", "file_size", "is_dir", "reason"],
                )


TREE = "set_id string, path string, name string, kind string, file_size bigint, reason string"


def _entries(root: str, path: str) -> Iterator[tuple]:
    """What a folder holds, links told apart; nothing is followed."""
    try:
        store, inside, before = locate(path)
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(inside) as held:
                for entry in held:
                    kind = "symlink" if entry.is_symlink() else "dir" if entry.is_dir() else "file"
                    size = entry.stat().st_size if kind == "file" else None
                    yield root, f"{before}{inside.rstrip('/')}/{entry.name}", entry.name, kind, size, None
            return
        for entry in store.get_file_info(fs.FileSelector(inside)):
            kind = "dir" if entry.type == fs.FileType.Directory else "file"
            yield root, before + entry.path, entry.base_name, kind, entry.size if kind == "file" else None, None
    except (OSError, ValueError) as e:
        yield root, path, path.rstrip("/").rsplit("/", 1)[-1], "dir", None, f"UNLISTED: {e}"


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(n, pa.int64() if n == "file_size" else pa.string()) for n in ("set_id", "path", "name", "kind", "file_size", "reason")])
    for batch in batches:
        for root, path in zip(batch.column("set_id").to_pylist(), batch.column("path").to_pylist()):
            rows = _entries(root, path)
            while chunk := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), kinds)], schema=kinds)


def _address(root: str) -> str:
    """A root as the paths below it begin."""
    try:
        _, inside, before = locate(root)
        return before + inside.rstrip("/")
    except (OSError, ValueError):
        return root.rstrip("/")


def list_tree(spark: SparkSession, roots) -> DataFrame:
    """``set_id`` (the root's full path), ``path, name, kind, file_size, reason`` of everything below the roots.

    ``kind`` is file, dir or symlink (local folders only; object stores have none). Links are not followed,
    so a link to a folder above it does no harm. A folder that cannot be listed has a second row, with a
    ``reason``. Listed level by level like ``list_files``.
    """
    given = [_address(r) for r in ([roots] if isinstance(roots, str) else roots)]
    folders = spark.createDataFrame([(r, r) for r in given], "set_id string, path string")
    found, wide = [], max(len(given), int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        level = cut_lineage(folders.repartition(wide, "path").mapInArrow(_entered, TREE))
        found.append(level)
        folders = level.filter("kind = 'dir' AND reason IS NULL").select("set_id", "path")
        if folders.limit(1).count() == 0:
            return union_all(*found)


def list_files(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """``path, file_size, reason`` of every file under the given folders, and of files given themselves.

    Folders are listed level by level, every folder of a level by a task of its own choice of
    rows, so neither the driver nor one task holds a collection's listing however it is nested;
    the driver sees one count per level. The levels are kept in the checkpoint folder, so the call
    lists once and later plans read the result. Empty files are listed too, which the binary
    file source leaves out. A path that is not there has no size; a folder that cannot be listed
    is a row with a ``reason``, and the rest is listed all the same.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    folders = spark.createDataFrame([(p,) for p in given], "path string")
    found, wide = [], max(len(given), int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        level = cut_lineage(folders.repartition(wide, "path").mapInArrow(_listed, LISTED))
        found.append(level.filter("NOT is_dir"))
        folders = level.filter("is_dir").select("path")
        if not recursive or folders.limit(1).count() == 0:
            break
    return union_all(*found).select("path", "file_size", "reason")


def read_exact(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("TRUNCATED")
    return data


def map_files(
    files: DataFrame,
    read: Callable[[dict, object], dict],
    fields: str,
    read_many: Callable[[pa.Array], tuple[np.ndarray, dict[str, pa.Array]]] | None = None,
) -> DataFrame:
    """Add ``fields`` by looking into each file.

    A row with ``content`` is read from it, any other is opened by ``path``, so only the bytes
    that are looked at leave the storage. A file that cannot be read becomes a row with a
    ``reason``. ``read_many`` is asked first, if there is one: it tells of a batch of contents which
    it could read, and what it found in these, by column; ``read`` sees the others.
    """
    kept = [c for c in files.columns if c != "content"]
    added = StructType.fromDDL(fields)
    out = StructType(files.select(*kept).schema.fields + added.fields)
    arrow = to_arrow_schema(out)
    names = added.names

    def look(row: dict, content: bytes | None) -> dict:
        try:
            if content is not None:
                return read(row, io.BytesIO(content))
            with open_path(row["path"]) as f:
                return read(row, f)
        except (ValueError, OSError) as e:
            return {"reason": str(e) or "UNREADABLE"}

    def columns_of(found: list[dict]) -> list[pa.Array]:
        return [pa.array([r.get(n) for r in found], type=arrow.field(n).type) for n in names]

    def fits(row: dict) -> dict:
        """What was found, or the reason why it has no place in the columns."""
        try:
            columns_of([row])
        except UNFIT as e:
            return {"reason": f"BAD_VALUE: {e}"}
        return row

    def batch_of(part: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        # By column; row by row only to find out which of them does not fit.
        try:
            added = columns_of(found)
        except UNFIT:
            added = columns_of([fits(row) for row in found])
        return with_columns(part, added)

    def with_columns(part: pa.RecordBatch, added: list[pa.Array]) -> pa.RecordBatch:
        columns = [part.column(c) for c in kept] + added
        return pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Flushed by bytes: a row may bring megabytes, and a batch of them more than a task holds.
        for batch in batches:
            if read_many is not None and "content" in batch.schema.names:
                done, columns = read_many(batch.column("content"))
                if done.any():
                    part = batch if done.all() else batch.filter(pa.array(done))
                    yield with_columns(part, [columns[n] if n in columns else pa.nulls(part.num_rows) for n in names])
                    batch = batch.filter(pa.array(~done))
            told = batch.select(kept).to_pylist() if kept else [{}] * batch.num_rows
            contents = batch.column("content") if "content" in batch.schema.names else [None] * batch.num_rows
            first, found, held = 0, [], 0
            for at, (row, content) in enumerate(zip(told, contents)):
                found.append(look(row, content.as_py() if content is not None else None))
                held += sum(len(v) for v in found[-1].values() if isinstance(v, bytes))
                if held >= FLUSH_BYTES:
                    yield batch_of(batch.slice(first, len(found)), found)
                    first, found, held = at + 1, [], 0
            if found:
                yield batch_of(batch.slice(first, len(found)), found)

    return files.mapInArrow(run, out)
