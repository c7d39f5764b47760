"""A source tree as a stream: new, edited and deleted files, names that Spark hides included.

The tree is listed by Spark jobs, and each listing is stored and compared with the one before. The differences
are what the stream reads: its offsets are numbers of listings, so a batch that is replayed reads the same changes.
Tree and state folder must be mounted on the driver and every executor.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from sparkwarden.functions.paths import SCAN_EXTENSIONS
from sparkwarden.functions.text import read_text
from sparkwarden.sources.tree import list_versions

CHANGE_SCHEMA = "file_path STRING, modified BIGINT, length BIGINT, deleted BOOLEAN"
ROW_SCHEMA = "file_path STRING, modified BIGINT, listing BIGINT, deleted BOOLEAN, data BINARY, error STRING"
ROW_ARROW = pa.schema(
    [("file_path", pa.string()), ("modified", pa.int64()), ("listing", pa.int64()), ("deleted", pa.bool_()), ("data", pa.binary()), ("error", pa.string())]
)


def last_listing(state: str) -> int:
    """The number of the last listing that was stored completely, 0 before the first."""
    try:
        return max((int(name) for name in os.listdir(f"{state}/done")), default=0)
    except FileNotFoundError:
        return 0


def refresh_listing(
    spark: SparkSession, root: str, state: str, extensions: Iterable[str] = SCAN_EXTENSIONS, files_per_part: int = 500
) -> int:
    """List the tree once more and store what changed since the last listing; the number of the newest listing.

    Without a change there is no new listing. One that breaks off leaves no mark and is written over by the next. A file counts as
    edited if its time or length differs; a file that is deleted and written again between two listings is an edit too.
    """
    number = last_listing(state)
    now_path, changes_path = f"{state}/listing/{number + 1}", f"{state}/changes/{number + 1}"
    list_versions(spark, root, extensions).select("file_path", "modified", "length").write.mode("overwrite").parquet(now_path)
    schema = "file_path STRING, modified BIGINT, length BIGINT"
    now = spark.read.schema(schema).parquet(now_path)
    before = spark.read.schema(schema).parquet(f"{state}/listing/{number}") if number else spark.createDataFrame([], schema)
    written = now.join(before, ["file_path", "modified", "length"], "left_anti").withColumn("deleted", F.lit(False))
    gone = before.join(now, "file_path", "left_anti").withColumn("deleted", F.lit(True))
    changes = written.unionByName(gone)
    parts = -(-changes.count() // files_per_part)
    if not parts:
        return number
    # contents are read per part: by number of files, not by the size of the names
    changes.repartition(parts).write.mode("overwrite").parquet(changes_path)
    os.makedirs(f"{state}/done", exist_ok=True)
    with open(f"{state}/done/{number + 1}", "w"):
        pass
    return number + 1


class ChangesReader(DataSourceStreamReader):
    """Offsets are listings; a partition is one stored part of the changes of one listing."""

    def __init__(self, state: str) -> None:
        self.state = state

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": last_listing(self.state)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for listing in range(start["listing"] + 1, end["listing"] + 1):
            folder = f"{self.state}/changes/{listing}"
            out += [InputPartition((listing, f"{folder}/{name}")) for name in sorted(os.listdir(folder)) if name.endswith(".parquet")]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        listing, path = partition.value
        for row in pq.ParquetFile(path).read().to_pylist():
            data, error = None, None
            if not row["deleted"]:
                try:
                    with open(row["file_path"], "rb") as handle:
                        data = handle.read()
                except OSError as exc:
                    error = str(exc)
            del row["length"]
            # one file per batch: contents can be large
            yield pa.RecordBatch.from_pylist([{**row, "listing": listing, "data": data, "error": error}], schema=ROW_ARROW)


class TreeChanges(DataSource):
    """The changes stored below the folder given as option ``state``."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return ROW_SCHEMA

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(self.options["state"])


def tree_stream(spark: SparkSession, root: str, state: str) -> DataFrame:
    """Corpus stream ``(root, file_path, content, error, modified, listing, deleted)`` of the listings in ``state``.

    A file comes once for every listing that found it new or edited, with the content it has when it is read, and once
    without content when it is gone. A file that cannot be read has an error instead.
    """
    spark.dataSource.register(TreeChanges)
    rows = spark.readStream.format("tree_changes").option("state", state).load()
    return rows.select(
        F.lit(os.path.realpath(root)).alias("root"), "file_path", read_text(F.col("data")).alias("content"), "error", "modified", "listing", "deleted"
    )


def follow_tree(
    spark: SparkSession, root: str, state: str, start: Callable[[DataFrame], StreamingQuery], extensions: Iterable[str] = SCAN_EXTENSIONS
) -> int:
    """One round: list the tree, then run a streaming job over what changed; the number of the newest listing."""
    newest = refresh_listing(spark, root, state, extensions)
    start(tree_stream(spark, root, state)).awaitTermination()
    return newest
