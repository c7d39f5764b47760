"""Reading and writing backlog snapshots, scans, reports and JSON logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkwarden.operators.backlog import PROPOSAL_FIELDS, PROPOSAL_SCHEMA, with_defaults

REPORT_SCHEMA = (
    "metadata STRUCT<timestamp: STRING, project_path: STRING, platform: STRING, total_files: BIGINT, "
    "total_findings: BIGINT, critical_findings: BIGINT>, _corrupt_record STRING"
)
REPORT_FIELDS = ("timestamp", "project_path", "platform", "total_files", "total_findings", "critical_findings")
META_SCHEMA = (
    "run_id STRING, report_file STRING, timestamp STRING, project_path STRING, platform STRING, "
    "model STRUCT<id: STRING, name: STRING, type: STRING>, total_files BIGINT, total_analyses BIGINT, "
    "successful_analyses BIGINT, failed_analyses BIGINT, total_findings BIGINT, critical_findings BIGINT"
)
# run ids are text, whatever they look like
RESULT_SCHEMA = (
    "file_path STRING, analysis_type STRING, success BOOLEAN, execution_time DOUBLE, findings ARRAY<VARIANT>, "
    "score VARIANT, linter_results VARIANT, error STRING, run_id STRING"
)
# bytes of a row group of a stored backlog
ROW_GROUP = 16 * 1024 * 1024
SCAN_SCHEMA = "scan_id STRING, timestamp STRING, proposal_count BIGINT, _corrupt_record STRING"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False


def read_backlog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored backlog with defaults for missing fields; empty if there is none at ``path``.

    Records that cannot be read, or have no id, are left out.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], PROPOSAL_SCHEMA)
    return with_defaults(spark.read.schema(PROPOSAL_SCHEMA).format(fmt).load(path).filter("id IS NOT NULL"))


def write_backlog(backlog: DataFrame, path: str) -> DataFrame:
    """Write a new snapshot folder, never the one being read, and return the stored table.

    Rows are in the order of their ids over all files and each row group has a Bloom filter of its ids, so a look
    at one id reads the one group that may hold it, and mostly none for an unknown id. Row groups are kept small for that.
    """
    rows = backlog.select(*PROPOSAL_FIELDS).repartitionByRange("id").sortWithinPartitions("id")
    options = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": ROW_GROUP}
    rows.write.mode("errorifexists").options(**options).parquet(path)
    return backlog.sparkSession.read.schema(PROPOSAL_SCHEMA).parquet(path)


def import_json_index(spark: SparkSession, path: str) -> DataFrame:
    """A backlog kept as one JSON document ``{"proposals": {id: proposal}}``; unreadable: empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], PROPOSAL_SCHEMA)
    schema = f"proposals MAP<STRING, {StructType.fromDDL(PROPOSAL_SCHEMA).simpleString()}>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return with_defaults(rows.select(F.explode("proposals").alias("id", "p")).select("p.*"))


def write_scans(summary: DataFrame, proposals: DataFrame, path: str) -> None:
    """Scan counts and proposals, each below one folder per scan; a scan that was there is replaced."""
    for rows, name, kind in ((summary, "summary", "json"), (proposals, "proposals", "parquet")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").format(kind).save(
            f"{path}/{name}"
        )


def read_scan(spark: SparkSession, path: str, scan_id: str) -> tuple[DataFrame, DataFrame]:
    """Summary and proposals of one stored scan; both empty for an unknown id."""
    wanted = F.col("scan_id") == scan_id
    summary = spark.read.schema("scan_id STRING, timestamp STRING, proposal_count BIGINT").json(f"{path}/summary")
    proposals = spark.read.schema(PROPOSAL_SCHEMA).parquet(f"{path}/proposals")
    return summary.filter(wanted), proposals.filter(wanted)


def list_scans(spark: SparkSession, path: str) -> DataFrame:
    """Scan id, time and count of the summaries that :func:`write_scans` stored, last id first."""
    rows = spark.read.schema(SCAN_SCHEMA).json(path)
    return _light_scans(rows, F.col("scan_id")).orderBy(F.desc("scan_id"))


def list_scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder with one JSON document per scan, last file name first.

    Documents that do not parse are left out, a missing id is the file name, a missing time or count is empty.
    """
    rows = spark.read.schema(SCAN_SCHEMA).option("multiLine", True).json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return _light_scans(rows, F.coalesce("scan_id", stem), stem.alias("_name")).orderBy(F.desc("_name")).drop("_name")


def _light_scans(rows: DataFrame, scan_id: Column, *more: Column) -> DataFrame:
    return (
        rows.select(
            "_corrupt_record", scan_id.alias("scan_id"),
            F.coalesce("timestamp", F.lit("")).alias("timestamp"),
            F.coalesce("proposal_count", F.lit(0)).alias("proposal_count"), *more,
        )
        .filter(F.col("_corrupt_record").isNull())
        .drop("_corrupt_record")
    )


def write_report(meta: DataFrame, results: DataFrame, path: str) -> None:
    """Metadata and result rows as two JSON tables; results below one folder per run."""
    meta.write.mode("append").json(f"{path}/meta")
    results.write.mode("append").partitionBy("run_id").json(f"{path}/results")


def read_report(spark: SparkSession, path: str, report_file: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and result rows of one stored report; only the result folders of its runs are read."""
    meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta").filter(F.col("report_file") == report_file)
    runs = [row.run_id for row in meta.select("run_id").distinct().collect()]
    results = spark.read.schema(RESULT_SCHEMA).json(f"{path}/results")
    return meta, results.filter(F.col("run_id").isin(runs) if runs else F.lit(False))


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports written by :func:`write_report`, newest name first, with the six listed fields."""
    schema = (
        "report_file STRING, timestamp STRING, project_path STRING, platform STRING, total_files BIGINT, "
        "total_findings BIGINT, critical_findings BIGINT"
    )
    rows = spark.read.schema(schema).json(f"{path}/meta")
    listed = rows.select(F.col("report_file").alias("filename"), *REPORT_FIELDS)
    return _complete(listed).orderBy(F.desc("filename"))


def list_report_documents(spark: SparkSession, path: str) -> DataFrame:
    """Folder of single-document JSON reports; those malformed or lacking a field are left out."""
    rows = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    listed = rows.filter(F.col("_corrupt_record").isNull()).select(
        F.col("_metadata.file_name").alias("filename"), "metadata.*"
    )
    return _complete(listed).orderBy(F.desc("filename"))


def _complete(listed: DataFrame) -> DataFrame:
    return listed.dropna("any", subset=list(REPORT_FIELDS))


def append_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line; absent values are not written."""
    rows.write.mode("append").json(path)
