"""Classifying linter runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.text import strip

# Messages and display states.
NOT_FOUND = " not found in PATH"
TIMED_OUT = "Linter timed out after 60s"
STATUS_UNAVAILABLE, STATUS_OK, STATUS_ISSUES = "non disponibile", "ok", "warning/error"


def lint_outcomes(lint_runs: DataFrame) -> DataFrame:
    """One classified row per enabled run of ``lint_runs(file_path, linter, command, enabled, found,
    timed_out, returncode, stdout, stderr, error)``.

    Not installed: unavailable, no verdict. Timed out or otherwise failed: not successful. Else the
    exit code decides and both streams are kept, stripped.
    """
    missing, slow = ~F.col("found"), F.col("timed_out")
    crashed = F.col("error").isNotNull()
    ran = ~missing & ~slow & ~crashed
    error = F.when(missing, F.concat("command", F.lit(NOT_FOUND))).when(slow, TIMED_OUT).otherwise(F.col("error"))
    success = F.when(missing, F.lit(None).cast("boolean")).when(~ran, F.lit(False)).otherwise(
        F.col("returncode") == 0
    )
    rows = lint_runs.filter("enabled").select(
        "file_path",
        "linter",
        (~missing).alias("available"),
        success.alias("success"),
        F.when(ran, F.col("returncode")).alias("returncode"),
        F.when(ran, strip(F.col("stdout"))).alias("stdout"),
        F.when(ran, strip(F.col("stderr"))).alias("stderr"),
        error.alias("error"),
    )
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumn(
        "status",
        F.when(~F.col("available"), STATUS_UNAVAILABLE)
        .when(F.coalesce("success", F.lit(False)), STATUS_OK)
        .otherwise(STATUS_ISSUES),
    ).withColumn("detail", F.coalesce(blank("error"), blank("stderr"), blank("stdout"), F.lit("")))


def lint_by_file(outcomes: DataFrame, linters: list[str]) -> DataFrame:
    """A map linter → outcome per file, over the configured linters (which bounds the map)."""
    fields = ("available", "success", "returncode", "stdout", "stderr", "error")
    one = (
        outcomes.filter(F.col("linter").isin(linters))
        .groupBy("file_path", "linter")
        .agg(F.max(F.struct(*fields)).alias("outcome"))
    )
    return one.groupBy("file_path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("linter", "outcome")))).alias("linter_results")
    )
