"""File trees: listed by tasks, level by level, and written by tasks.

The names below a path become a table in the shared scratch folder. Tasks list the folders of
a level and hand the folders they find to the next one, so neither the driver nor one task
holds the names of a tree. Stores that only Hadoop's client opens are walked by the driver, one
folder at a time, in batches of bounded size that are written as they fill.
"""

from __future__ import annotations

import os
import re
import stat
import sys
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.sources.scratch import scratch_path, written

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows that a folder's listing, or the driver's walk, holds at a time
BATCH = 10_000
#: files and bytes of them that a task opens in all, and that it holds at a time
TASK_FILES, TASK_BYTES = 20_000, 1 << 28
HELD_FILES, HELD_BYTES = 1_000, 1 << 23
ENTRY = "path string, is_folder boolean, length long, modificationTime timestamp, hidden boolean"
_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?)?(.*)", re.DOTALL)


def hidden_name(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a full path, and the path within it."""
    scheme, authority, inner = _PARTS.fullmatch(path).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), inner
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return store, base.rstrip("/") + inner


def _reachable(path: str) -> bool:
    """Whether tasks can list below a path."""
    try:
        store, inner = opened(path)
        return store.get_file_info(inner).type != fs.FileType.NotFound
    except (OSError, ValueError, pa.ArrowException):
        return False


def _local_entries(folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """Name, whether it is a folder, size and time of what a local folder holds, one at a time."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                found = entry.stat()
                yield entry.name, stat.S_ISDIR(found.st_mode), found.st_size, found.st_mtime_ns
            except FileNotFoundError:  # a link to nothing
                yield entry.name, False, None, None


def _entries(folder: str, hidden: bool) -> Iterator[tuple]:
    store, inner = opened(folder)
    if isinstance(store, fs.LocalFileSystem):
        found = _local_entries(inner)
    else:
        infos = store.get_file_info(fs.FileSelector(inner))
        found = ((f.base_name, f.type == fs.FileType.Directory, f.size, f.mtime_ns) for f in infos)
    for name, is_folder, size, when in found:
        yield (
            f"{folder.rstrip('/')}/{name}", is_folder, 0 if is_folder else size,
            (when or 0) // 1_000_000 * 1000, hidden or hidden_name(name),
        )


def _list_folders(folders: DataFrame) -> DataFrame:
    """The entries of ``folders(path, hidden)``."""
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[3] = arrays[3].cast(pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays(arrays, names=["path", "is_folder", "length", "modificationTime", "hidden"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for folder, hidden in zip(batch.column("path").to_pylist(), batch.column("hidden").to_pylist(), strict=True):
                for entry in _entries(folder, hidden):
                    rows.append(entry)
                    if len(rows) == BATCH:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    return folders.mapInArrow(run, ENTRY)


def _roots(spark: SparkSession, path: str | list[str]) -> list[tuple]:
    """Files and folders that a path names, or a pattern of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for given in [path] if isinstance(path, str) else path:
        where = jvm.org.apache.hadoop.fs.Path(given)
        for status in where.getFileSystem(conf).globStatus(where) or []:
            when = datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc)
            found.append((status.getPath().toString(), status.isDirectory(), status.getLen(), when, False))
    return found


def tasks_read(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether tasks can list and open all that a path names."""
    return all(_reachable(root[0]) for root in _roots(spark, path))


def _walked(spark: SparkSession, folders: list[tuple[str, bool]]) -> DataFrame:
    """The files below some folders, by the driver: it holds open folders and one batch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, rows, todo = scratch_path(spark, "listing"), [], list(folders)

    def flush() -> None:
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(target)
        rows.clear()

    while todo:
        folder, hidden = todo.pop()
        where = jvm.org.apache.hadoop.fs.Path(folder)
        names = where.getFileSystem(conf).listStatusIterator(where)
        while names.hasNext():
            status = names.next()
            name = status.getPath().getName()
            below = hidden or hidden_name(name)
            if status.isDirectory():
                todo.append((status.getPath().toString(), below))
                continue
            when = datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc)
            rows.append((status.getPath().toString(), False, status.getLen(), when, below))
            if len(rows) == BATCH:
                flush()
    flush()
    return spark.read.schema(ENTRY).parquet(target)


def list_tree(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length, modificationTime, hidden`` of every file below ``path``, a table in the
    scratch folder. ``hidden``: Spark's readers pass over its name, or a folder's above it."""
    roots = _roots(spark, path)
    levels = [spark.createDataFrame([r for r in roots if not r[1]], ENTRY)]
    folders = [(r[0], r[4]) for r in roots if r[1]]
    near = [f for f in folders if _reachable(f[0])]
    far = [f for f in folders if f not in near]
    if far:
        levels.append(_walked(spark, far))
    frontier, n = spark.createDataFrame(near, "path string, hidden boolean"), len(near)
    most = 4 * spark.sparkContext.defaultParallelism
    while n:
        level = written(_list_folders(frontier.repartition(min(n, most))), "listing")
        levels.append(level)
        frontier = level.filter("is_folder").select("path", "hidden")
        n = frontier.count()
    files = reduce(DataFrame.unionByName, levels).filter("not is_folder")
    return files.select("path", "length", "modificationTime", "hidden")


def read_listed(files: DataFrame) -> DataFrame:
    """``path, length, content`` of listed files ``(path, length)``, opened by tasks.

    No names pass through the driver, and a task holds one file, or a few small ones, at a time.
    """
    spark = files.sparkSession
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism), n // TASK_FILES, size // TASK_BYTES)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        types = (pa.string(), pa.int64(), pa.large_binary())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.binary())], names=["path", "length", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, inner = opened(path)
                with store.open_input_stream(inner, compression=None) as file:
                    rows.append((path, length, file.read()))
                held += length
                if held >= HELD_BYTES or len(rows) == HELD_FILES:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    return files.select("path", "length").repartition(tasks).mapInArrow(run, "path string, length long, content binary")


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """Write every row as a file of its own: ``path`` below ``root``, and the bytes of ``content``.

    Returns ``path, length`` of what was written; nothing is written before an action runs. A
    file appears under its name only when it is whole, and a task that runs again replaces it.
    A null content is an empty file; a path may not leave the root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        made: set[str] = set()
        for batch in batches:
            full, sizes = [], []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or ".." in name.split("/"):
                    raise ValueError(f"not a path below the root: {name}")
                target = f"{base.rstrip('/')}/{name.lstrip('/')}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/._COPYING_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data or b"")
                store.move(part, target)
                full.append(f"{root.rstrip('/')}/{name.lstrip('/')}")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    chosen = files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    return chosen.mapInArrow(run, "path string, length long")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The files go when the driver ends."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    except Py4JError:  # the session is gone, and the files with its scratch folder
        pass
