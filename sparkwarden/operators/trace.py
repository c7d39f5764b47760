"""Trace events of scans and validation decisions, derived as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Actor, event types and tags of the event log.
ACTOR = "proposal_engine"
SCAN_START = "proposal.scan.start"
SCAN_END = "proposal.scan.end"
VIOLATION = "proposal.violation"
GENERATED = "proposal.generated"
VALIDATION = "proposal.validation"
DECISIONS = ("validated", "rejected")

EVENT_SCHEMA = "type STRING, actor STRING, level STRING, tags ARRAY<STRING>, payload STRING"


def _event(df: DataFrame, kind: str, level: Column, tags: list[Column], *payload: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"),
        F.lit(ACTOR).alias("actor"),
        level.alias("level"),
        F.array(*tags).cast("array<string>").alias("tags"),
        # fields without a value are left out of the payload
        F.to_json(F.struct(*payload)).alias("payload"),
    )


def _level(severity: Column) -> Column:
    return F.when(severity.isin("high", "critical"), "warn").otherwise("info")


def hit_events(proposals: DataFrame) -> DataFrame:
    """The violation and the generated event of every proposal, in one pass over the table."""
    evidence = F.get(F.col("evidence"), F.lit(0))
    path = evidence["file_path"].alias("file_path")
    kinds = F.array(
        F.struct(
            F.lit(VIOLATION).alias("type"),
            _level(F.col("severity")).alias("level"),
            F.col("source_rule").alias("tag"),
            F.to_json(
                F.struct(
                    F.col("source_rule").alias("rule_id"), path, "severity",
                    evidence["line_number"].alias("line_number"),
                )
            ).alias("payload"),
        ),
        F.struct(
            F.lit(GENERATED).alias("type"),
            F.lit("info").alias("level"),
            F.col("type").alias("tag"),
            F.to_json(
                F.struct(
                    F.col("id").alias("proposal_id"), F.col("type").alias("proposal_type"), "severity", path
                )
            ).alias("payload"),
        ),
    )
    return proposals.select(F.explode(kinds).alias("e")).select(
        "e.type", F.lit(ACTOR).alias("actor"), "e.level",
        F.array(F.lit(ACTOR), "e.tag").alias("tags"), "e.payload",
    )


def scan_events(scans: DataFrame) -> DataFrame:
    """Start and end events of ``scans(scan_id, project_path, status, proposal_count)``."""
    level = F.lit("info")
    start = _event(scans, SCAN_START, level, [], F.col("scan_id"), F.col("project_path"))
    end = _event(scans, SCAN_END, level, [], F.col("status"), F.col("proposal_count"), F.col("scan_id"))
    return start.unionByName(end)


def validation_events(judged: DataFrame) -> DataFrame:
    """One event per accepted move to validated or rejected; a blank reason is left out."""
    decided = judged.filter(F.col("accepted") & F.col("new_state").isin(*DECISIONS))
    return _event(
        decided,
        VALIDATION,
        F.lit("info"),
        [F.lit(ACTOR), F.lit("validation")],
        F.col("id").alias("proposal_id"),
        F.col("new_state").alias("decision"),
        F.nullif(F.col("reason"), F.lit("")).alias("reason"),
    )


def scan_trace(proposals: DataFrame, scans: DataFrame) -> DataFrame:
    """All events of finished scans."""
    return reduce(DataFrame.unionByName, [scan_events(scans), hit_events(proposals)])
