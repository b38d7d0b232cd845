"""Folders listed by tasks: the names of their files never come to the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.session import scratch_path

# Folders a task lists, entries it hands on at once.
TASK_FOLDERS, ENTRIES = 1024, 10_000
LISTED = "rel_path string, length bigint"


def store_of(path: str, known: dict[str | None, FileSystem]) -> tuple[FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there; file systems are kept in ``known``."""
    root, rest = re.match(r"((?!file:)\w[\w+.-]*://[^/]*)?(?:file:/*(?=/))?(.*)", path, re.S).groups()
    if root not in known:
        known[root] = FileSystem.from_uri(f"{root}/")[0] if root else LocalFileSystem()
    return known[root], rest if not root or root.startswith("hdfs") else root.partition("://")[2] + rest


def read_file(path: str, known: dict[str | None, FileSystem]) -> bytes:
    store, where = store_of(path, known)
    with store.open_input_stream(where) as stream:
        return stream.readall()


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark's readers write it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(given).toString()


def listable(spark: SparkSession, root: str) -> bool:
    """Whether tasks can list a folder: it is there, it is no pattern, and Arrow knows its file system."""
    try:
        store, where = store_of(_qualified(spark, root), {})
        return store.get_file_info(where).type == FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def _entries(store: FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """What a folder holds: names with their sizes, null for folders."""
    if not isinstance(store, LocalFileSystem):
        for found in store.get_file_info(FileSelector(folder)):
            yield found.base_name, None if found.type == FileType.Directory else found.size
        return
    # a folder of any size is handed on as it is read
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                yield entry.name, None if entry.is_dir() else entry.stat().st_size
            except FileNotFoundError:
                continue  # a link to nothing, or gone meanwhile


def _left_out(name: str, size: int | None) -> bool:
    """Names that Spark's readers pass over, and files without a byte."""
    if size is None and name.startswith(("_metadata", "_common_metadata")):
        return False
    return size == 0 or name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, root: str, exts: Sequence[str]) -> DataFrame:
    """The files below a ``listable`` folder with one of the suffixes: path, path below the folder, length.

    They are those that Spark's readers find. The folders of each level are dealt to tasks, which write what they hold
    to the shared folder; the driver learns how many folders come next.
    """
    top = _qualified(spark, root).rstrip("/")
    suffixes = tuple(f".{e}" for e in exts)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, FileSystem] = {}
        names: list[str] = []
        sizes: list[int | None] = []

        def lot() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["rel_path", "length"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, size in _entries(*store_of(f"{top}/{folder}", known)):
                    if _left_out(name, size) or (size is not None and not name.endswith(suffixes)):
                        continue
                    names.append(f"{folder}{name}" if size is not None else f"{folder}{name}/")
                    sizes.append(size)
                    if len(names) == ENTRIES:
                        yield lot()
                        names, sizes = [], []
        yield lot()

    cores = spark.sparkContext.defaultParallelism
    levels, folders, n = [], spark.range(1).select(F.lit("").alias("rel_path")), 1
    while n:
        levels.append(scratch_path(spark, "listing"))
        dealt = folders.repartition(max(min(cores, n), -(-n // TASK_FOLDERS)))
        dealt.mapInArrow(listed, LISTED).write.parquet(levels[-1])
        folders = spark.read.schema(LISTED).parquet(levels[-1]).where("length IS NULL").select("rel_path")
        n = folders.count()
    files = spark.read.schema(LISTED).parquet(*levels).where("length IS NOT NULL")
    return files.select(F.concat(F.lit(f"{top}/"), "rel_path").alias("path"), "rel_path", "length")
