"""The backlog as versioned snapshots that take in the sightings of a stream, some batches at a time.

A snapshot is a table in buckets by a hash of the id. A manifest row names the batches that are folded in and, for
every bucket, the version that last wrote it. Readers take the manifest row of the highest version; a fold writes its
buckets first and its manifest row last, so one that breaks off changes nothing and the next one writes over its traces.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.backlog import PROPOSAL_FIELDS, PROPOSAL_SCHEMA, upsert_backlog
from sparkwarden.streaming.jobs import read_batches

MANIFEST = "version BIGINT, folded_to BIGINT, buckets ARRAY<BIGINT>"
BUCKETS = 64


def _bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")


def _newest(spark: SparkSession, snapshot: str) -> Row | None:
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{snapshot}/manifest")
    except AnalysisException:
        return None
    return rows.orderBy(F.desc("version")).first()


def _write(backlog: DataFrame, snapshot: str, version: int, folded_to: int, before: list[int]) -> None:
    """Store the given buckets as a version, then the manifest that makes them count."""
    spark, count = backlog.sparkSession, len(before)
    data = f"{snapshot}/data/{version}"
    placed = backlog.select(*PROPOSAL_FIELDS, _bucket(count).alias("bucket"))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    # at most one row for each bucket
    held = {r.bucket for r in spark.read.parquet(data).select("bucket").distinct().collect()} if not placed.isEmpty() else set()
    buckets = [version if b in held else old for b, old in enumerate(before)]
    row = spark.createDataFrame([(folded_to, buckets)], "folded_to BIGINT, buckets ARRAY<BIGINT>")
    row.coalesce(1).write.mode("overwrite").parquet(f"{snapshot}/manifest/version={version}")


def create_snapshot(backlog: DataFrame, snapshot: str, buckets: int = BUCKETS) -> None:
    """The first version: a backlog before any batch. More buckets let a fold of few ids write less."""
    _write(backlog, snapshot, 1, 0, [0] * buckets)


def _read(spark: SparkSession, snapshot: str, manifest: Row, wanted: list[int]) -> DataFrame:
    paths = [f"{snapshot}/data/{manifest.buckets[b]}/bucket={b}" for b in wanted if manifest.buckets[b]]
    return spark.read.schema(PROPOSAL_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], PROPOSAL_SCHEMA)


def read_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    """The backlog of the newest version; empty where there is none."""
    manifest = _newest(spark, snapshot)
    if manifest is None:
        return spark.createDataFrame([], PROPOSAL_SCHEMA)
    return _read(spark, snapshot, manifest, list(range(len(manifest.buckets))))


def get_from_snapshot(spark: SparkSession, snapshot: str, proposal_id: str) -> DataFrame:
    """One proposal by its id, read from its bucket alone."""
    manifest = _newest(spark, snapshot)
    if manifest is None:
        return spark.createDataFrame([], PROPOSAL_SCHEMA)
    at = spark.range(1).select(F.lit(proposal_id).alias("id")).select(_bucket(len(manifest.buckets)).alias("b")).first().b
    return _read(spark, snapshot, manifest, [at]).filter(F.col("id") == proposal_id)


def _pending(spark: SparkSession, snapshot: str, out: str, up_to: int | None = None) -> tuple[Row | None, DataFrame | None, int]:
    """The manifest, the sightings of the batches after it, and the batch before which they end."""
    manifest = _newest(spark, snapshot)
    start = manifest.folded_to if manifest else 0
    try:
        rows = read_batches(spark, out).filter(F.col("batch_id") >= start)
    except AnalysisException:
        return manifest, None, start
    if up_to is not None:
        rows = rows.filter(F.col("batch_id") < up_to)
    last = rows.agg(F.max("batch_id")).first()[0]
    return manifest, rows.withColumn("ord", F.struct("batch_id", "ord")), start if last is None else last + 1


def fold(spark: SparkSession, snapshot: str, out: str, up_to: int | None = None, buckets: int = BUCKETS) -> int:
    """Take the batches that ``sighting_stream`` stored in ``out`` and no fold has taken yet, those before ``up_to`` if given.

    Only these batches and the buckets of their ids are read, and only these buckets are written. Folding again changes
    nothing, as the manifest tells where to go on. Run it between streaming runs or from the one process that folds.
    Returns the first batch that is not folded.
    """
    manifest, rows, end = _pending(spark, snapshot, out, up_to)
    if rows is None or (manifest and end == manifest.folded_to) or rows.isEmpty():
        return manifest.folded_to if manifest else 0
    before = list(manifest.buckets) if manifest else [0] * buckets
    # at most one row for each bucket
    touched = [r.b for r in rows.select(_bucket(len(before)).alias("b")).distinct().collect()]
    prior = _read(spark, snapshot, manifest, touched) if manifest else spark.createDataFrame([], PROPOSAL_SCHEMA)
    _write(upsert_backlog(prior, rows), snapshot, manifest.version + 1 if manifest else 1, end, before)
    return end


def current_backlog(spark: SparkSession, snapshot: str, out: str) -> DataFrame:
    """The backlog as of now: the newest snapshot and the batches since."""
    _, rows, _ = _pending(spark, snapshot, out)
    backlog = read_snapshot(spark, snapshot)
    return backlog if rows is None else upsert_backlog(backlog, rows)
