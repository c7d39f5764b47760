"""The proposal backlog: idempotent upsert, listings and scan summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.proposals import timestamp_of

# The lifecycle states.
STATES = ("detected", "candidate", "validated", "planned", "rejected")

PROPOSAL_SCHEMA = (
    "id STRING, type STRING, title STRING, description STRING, "
    "evidence ARRAY<STRUCT<file_path: STRING, line_number: INT, code_snippet: STRING, context: STRING>>, "
    "severity STRING, priority STRING, confidence DOUBLE, risk_level STRING, autofixable BOOLEAN, "
    "recommendation STRING, state STRING, created_at TIMESTAMP, updated_at TIMESTAMP, "
    "source_analysis STRING, source_rule STRING, scan_id STRING"
)
PROPOSAL_FIELDS = tuple(part.split()[0] for part in PROPOSAL_SCHEMA.replace(
    "ARRAY<STRUCT<file_path: STRING, line_number: INT, code_snippet: STRING, context: STRING>>", "ARRAY"
).split(", "))

# What a stored proposal gets where a field is missing.
DEFAULTS = {
    "severity": "medium",
    "priority": "p2",
    "confidence": 0.5,
    "risk_level": "medium",
    "autofixable": False,
    "recommendation": "",
    "state": "detected",
}


def with_defaults(stored: DataFrame) -> DataFrame:
    """Fill missing fields of stored proposals; evidence becomes an empty list."""
    no_evidence = F.array().cast(
        "array<struct<file_path:string,line_number:int,code_snippet:string,context:string>>"
    )
    return stored.fillna(DEFAULTS).withColumn("evidence", F.coalesce("evidence", no_evidence))


def first_per_id(batch: DataFrame) -> DataFrame:
    """One row per id of a batch: the first hit, how many there were, and the last scan id set."""
    fields = [c for c in PROPOSAL_FIELDS if c != "id"]
    with_scan = F.when(F.col("scan_id").isNotNull(), F.col("ord"))
    return batch.groupBy("id").agg(
        F.min_by(F.struct(*fields), F.col("ord")).alias("first"),
        F.count(F.lit(1)).alias("hits"),
        F.max_by("scan_id", with_scan).alias("last_scan_id"),
        F.max("created_at").alias("last_seen"),
    )


def upsert_backlog(prior: DataFrame, batch: DataFrame, as_of=None) -> DataFrame:
    """Merge a batch of proposals (with ``ord``) into the backlog, one row per id.

    A known id keeps every field including its state; only ``updated_at`` and, when given, ``scan_id``
    are refreshed. A new id takes its first hit; further hits of the batch only refresh it. Rows of
    the backlog that were not seen again stay. Two unique-key sides, so the join cannot be skewed.
    Without ``as_of`` the refresh time is that of the last hit of the id.
    """
    seen = first_per_id(batch)
    now = F.col("last_seen") if as_of is None else timestamp_of(as_of)
    old, new = F.col("old"), F.col("first")
    fields = [c for c in PROPOSAL_FIELDS if c != "id"]
    kept = prior.select("id", F.struct(*fields).alias("old"))
    refreshed = F.coalesce(F.col("hits"), F.lit(0)) > F.when(old.isNull(), 1).otherwise(0)
    special = {
        "updated_at": F.when(refreshed, now).otherwise(
            F.when(old.isNotNull(), old["updated_at"]).otherwise(new["updated_at"])
        ),
        "scan_id": F.coalesce(F.col("last_scan_id"), old["scan_id"], new["scan_id"]),
    }
    return kept.join(seen, "id", "full_outer").select(
        "id",
        *[
            special.get(c, F.when(old.isNotNull(), old[c]).otherwise(new[c])).alias(c)
            for c in fields
        ],
    )


def list_backlog(backlog: DataFrame, state: str | None = None) -> DataFrame:
    """Newest first, optionally of one state; an unknown state is refused."""
    if state is not None:
        if state not in STATES:
            raise ValueError(f"unknown state: {state}")
        backlog = backlog.filter(F.col("state") == state)
    return backlog.orderBy(F.desc("created_at"), "id")


def get_proposals(backlog: DataFrame, ids: str | DataFrame) -> DataFrame:
    """The rows of one id (pushed to the scan) or of a table of ids."""
    if isinstance(ids, str):
        return backlog.filter(F.col("id") == ids)
    return backlog.join(ids.select("id"), "id", "left_semi")


def scan_summary(proposals: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Hits per scan, before ids are made unique; scans without an id or hits leave no row."""
    at = timestamp if timestamp is not None else F.col("created_at")
    return (
        proposals.filter(F.coalesce("scan_id", F.lit("")) != "")
        .groupBy("scan_id")
        .agg(F.max(at).alias("timestamp"), F.count(F.lit(1)).alias("proposal_count"))
    )
