"""Reports as documents: one nested JSON file per run under the report's name, replaced as a whole when written again."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sparkwarden.session import scratch_path

ORDER_SCHEMA = "report_file STRING, head STRING, parts STRING"
# The fields of a document's metadata and of its results.
HEAD_SCHEMA = (
    "timestamp STRING, project_path STRING, model STRUCT<id: STRING, name: STRING, type: STRING>, platform STRING, "
    "total_files BIGINT, total_analyses BIGINT, successful_analyses BIGINT, failed_analyses BIGINT, total_findings BIGINT, "
    "critical_findings BIGINT"
)
ROW_SCHEMA = (
    "file_path STRING, analysis_type STRING, success BOOLEAN, execution_time DOUBLE, findings ARRAY<VARIANT>, score VARIANT, "
    "linter_results VARIANT, error STRING"
)
HEAD_FIELDS = (
    "timestamp", "project_path", "model", "platform", "total_files", "total_analyses", "successful_analyses", "failed_analyses",
    "total_findings", "critical_findings",
)
ROW_FIELDS = ("file_path", "analysis_type", "success", "execution_time", "findings", "score", "linter_results", "error")
# a document's first line, its rows one a line, its last line
OPEN, BETWEEN, CLOSE = '{"metadata": ', ', "results": [', "]}"
BLOCK = 1024 * 1024


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names by path or URI, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def rows_of(folder: str) -> Iterator[bytes]:
    """The stored lines below a folder in the order of their parts, as blocks with commas between lines."""
    store, root = file_system(folder)
    files = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part-")]
    held = b""
    for info in sorted(files, key=lambda f: (int(f.base_name.split("-")[1]), f.base_name)):
        with store.open_input_stream(info.path) as part:
            while block := held + part.read(BLOCK):
                if block == held:
                    break
                held = b"\n" if block.endswith(b"\n") else b""
                yield block[: len(block) - len(held)].replace(b"\n", b",\n")


@dataclass
class Documents(WriterCommitMessage):
    written: list[tuple[str, str]]


class DocumentWriter(DataSourceArrowWriter):
    """Tasks write documents aside; the commit moves each to its name, an abort leaves what was there."""

    def __init__(self, folder: str) -> None:
        self.folder, self.aside = folder.rstrip("/"), f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Documents:
        store, root = file_system(self.folder)
        store.create_dir(f"{root}/{self.aside}", recursive=True)
        written = []
        for batch in iterator:
            for row in batch.to_pylist():
                name = row["report_file"]
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"not a name of a report: {name}")
                place = f"{self.aside}/{uuid.uuid4().hex}"
                with store.open_output_stream(f"{root}/{place}") as out:
                    out.write(f"{OPEN}{row['head']}{BETWEEN}\n".encode())
                    filled = False
                    for block in rows_of(row["parts"]):
                        out.write(block)
                        filled = True
                    out.write(f"{chr(10) if filled else ''}{CLOSE}\n".encode())
                written.append((place, name))
        return Documents(written)

    def commit(self, messages: list[Documents | None]) -> None:
        store, root = file_system(self.folder)
        for place, name in [pair for message in messages if message for pair in message.written]:
            store.move(f"{root}/{place}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Documents | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.aside}")


class ReportDocuments(DataSource):
    """Sink of documents to put together: a name, its metadata and the folder that holds its rows."""

    @classmethod
    def name(cls) -> str:
        return "report_documents"

    def schema(self) -> str:
        return ORDER_SCHEMA

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def _folder(run_id: Column) -> Column:
    return F.when(run_id.isNull(), F.lit("none")).otherwise(F.sha2(run_id, 256))


def write_report_documents(meta: DataFrame, results: DataFrame, path: str) -> None:
    """Write the report of every row of ``meta`` as ``path/<report_file>``: ``{"metadata": {...}, "results": [...]}``.

    Results are in order of file and analysis type, fields without a value are left out. Rows are ordered and written as
    JSON by a range sort over all runs, so that a run with most of the rows is spread over many tasks; one task per document then only
    copies the stored bytes in blocks. Every document is replaced in one step, and the same run written twice leaves one document. If
    the job fails, all documents stay as they were. Of several runs with one name the latest stays, by time and run id. A run
    without results has an empty list; results of a run without metadata are not written; a null run id is a run like others;
    columns that a document does not have are ignored. A name that is empty or not a plain file name fails the job.
    """
    spark = meta.sparkSession
    spark.dataSource.register(ReportDocuments)
    parts = scratch_path(spark, "report-parts")
    order = ("run", "file_path", "analysis_type")
    kept = [F.col(f"r.{name}") for name in ROW_FIELDS if name in results.columns]
    lines = results.alias("r").select(
        _folder(F.col("r.run_id")).alias("run"), "r.file_path", "r.analysis_type", F.to_json(F.struct(*kept)).alias("value")
    )
    lines.repartitionByRange(*order).sortWithinPartitions(*order, "value").select("run", "value").write.partitionBy("run").text(parts)
    head = F.to_json(F.struct(*[name for name in HEAD_FIELDS if name in meta.columns]))
    named = meta.select("report_file", head.alias("head"), F.concat(F.lit(f"{parts}/run="), _folder(F.col("run_id"))).alias("parts"),
                        F.struct("timestamp", "run_id").alias("at"))
    latest = named.groupBy("report_file").agg(F.max_by(F.struct("head", "parts"), "at").alias("d")).select("report_file", "d.*")
    latest.write.format("report_documents").mode("append").option("path", path).save()


def read_report_documents(spark: SparkSession, path: str, report_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata and result rows of the documents that :func:`write_report_documents` wrote, or of one, by ``filename``.

    A document is read by line, so that a large one is split over tasks.
    """
    lines = spark.read.text(f"{path}/{report_file}" if report_file else path)
    line = lines.select(F.col("_metadata.file_name").alias("filename"), "value")
    first = F.col("value").startswith(OPEN)
    head = F.substring("value", len(OPEN) + 1, F.length("value") - len(OPEN) - len(BETWEEN))
    meta = line.filter(first).select("filename", F.from_json(head, HEAD_SCHEMA).alias("m")).select("filename", "m.*")
    row = F.regexp_replace("value", ",$", "")
    rows = line.filter(~first & (F.col("value") != CLOSE)).select("filename", F.from_json(row, ROW_SCHEMA).alias("r"))
    return meta, rows.select("filename", "r.*")
