"""Reading a source tree from disk, including the names Spark's own file sources hide.

Spark skips names that start with ``_`` or ``.``; a source tree has plenty of them. Directories are
listed level by level as Spark jobs (a directory is a row), so that no single task or the driver walks
the tree, and file contents are read in tasks. The tree must be mounted on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.paths import SCAN_EXTENSIONS
from sparkwarden.functions.text import read_text
from sparkwarden.operators.plugins import batches_of
from sparkwarden.session import scratch_path

ENTRY_SCHEMA = "kind STRING, path STRING, modified BIGINT, length BIGINT"
ENTRY_ARROW = pa.schema([("kind", pa.string()), ("path", pa.string()), ("modified", pa.int64()), ("length", pa.int64())])
FILE_ARROW = pa.schema(
    [("root", pa.string()), ("file_path", pa.string()), ("data", pa.binary()), ("error", pa.string())]
)
MAX_BATCH = 10_000


def _entries(extensions: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for directory in batch.column(0).to_pylist():
            try:
                listing = os.scandir(directory)
            except OSError:
                continue
            with listing:
                for entry in listing:
                    if entry.is_dir(follow_symlinks=False):
                        yield {"kind": "dir", "path": entry.path}
                    elif entry.name.endswith(extensions) and entry.is_file():
                        try:
                            facts = entry.stat()
                        except OSError:
                            # gone since it was listed
                            continue
                        path = os.path.realpath(entry.path)
                        yield {"kind": "file", "path": path, "modified": facts.st_mtime_ns, "length": facts.st_size}


def list_tree(spark: SparkSession, root: str, extensions: Iterable[str] = SCAN_EXTENSIONS) -> DataFrame:
    """``(root, file_path)`` of all matching files, symbolic links resolved, each path once."""
    return list_versions(spark, root, extensions).select("root", "file_path")


def list_versions(spark: SparkSession, root: str, extensions: Iterable[str] = SCAN_EXTENSIONS) -> DataFrame:
    """``(root, file_path, modified, length)``: the files with the time of their last change, in nanoseconds, and their size."""
    root, wanted = os.path.realpath(root), tuple(extensions)
    out = scratch_path(spark, "tree")
    level, depth = spark.createDataFrame([(root,)], "path STRING"), 0
    while True:
        where = f"{out}/depth={depth}"
        level.mapInArrow(
            lambda batches: batches_of(_entries(wanted, batches), ENTRY_ARROW, MAX_BATCH), ENTRY_SCHEMA
        ).write.parquet(where)
        level = spark.read.schema(ENTRY_SCHEMA).parquet(where).filter("kind = 'dir'").select("path")
        if level.isEmpty():
            break
        # as many rows as directories: spread them before listing the next level
        level = level.repartition(spark.sparkContext.defaultParallelism)
        depth += 1
    files = spark.read.schema(f"{ENTRY_SCHEMA}, depth INT").parquet(out).filter("kind = 'file'")
    return files.select(F.lit(root).alias("root"), F.col("path").alias("file_path"), "modified", "length").dropDuplicates(["file_path"])


def _read_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data, error = None, None
            try:
                with open(row["file_path"], "rb") as handle:
                    data = handle.read()
            except OSError as exc:
                error = str(exc)
            # one file per batch: contents can be large
            yield pa.RecordBatch.from_pylist([{**row, "data": data, "error": error}], schema=FILE_ARROW)


def read_tree(spark: SparkSession, root: str, extensions: Iterable[str] = SCAN_EXTENSIONS,
              files_per_task: int = 500) -> DataFrame:
    """Corpus ``(root, file_path, content, error)``; an unreadable file has no content but an error.

    The path list is tiny next to the contents, so it is dealt out by number of files and not by size.
    """
    paths = list_tree(spark, root, extensions)
    parts = max(spark.sparkContext.defaultParallelism, -(-paths.count() // files_per_task))
    paths = paths.repartition(parts)
    rows = paths.mapInArrow(_read_bytes, "root STRING, file_path STRING, data BINARY, error STRING")
    return rows.select("root", "file_path", read_text(F.col("data")).alias("content"), "error")
