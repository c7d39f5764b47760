"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # JSON objects with a repeated key keep the last value instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # An aggregate above a join on its key must not keep a hot key in one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Arrow batches carry whole files and prompts: bound them by size, not only by row count. A worker holds two at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that parsing and time formatting depend on.

    Functions sent to tasks travel by value, so executors do not need this package installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules["sparkwarden"])
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def _shared_base(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwarden-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    return f"{_shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Executors may come and go: later stages read the stored rows instead of recomputing them, so
    anything that depends on a physical layout (partition ids) stays fixed.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

