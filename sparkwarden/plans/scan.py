"""The proposal scan, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkwarden.operators.backlog import scan_summary, upsert_backlog
from sparkwarden.operators.hypotheses import build_hypotheses
from sparkwarden.operators.proposals import build_proposals, signals_of, timestamp_of
from sparkwarden.operators.tasks import discover_files
from sparkwarden.operators.trace import SCAN_END, SCAN_START, hit_events, scan_events, scan_trace
from sparkwarden.session import scratch_path
from sparkwarden.sources.config import AuditConfig
from sparkwarden.sources.stores import append_json


@dataclass(frozen=True)
class ProposalScan:
    proposals: DataFrame
    hypotheses: DataFrame
    backlog: DataFrame
    summary: DataFrame
    trace: DataFrame


def proposal_scan(
    corpus: DataFrame,
    prior: DataFrame,
    config: AuditConfig,
    scan_id: str,
    as_of: str,
    project_path: str,
    wanted: DataFrame | Sequence[str] | None = None,
    trace_path: str | None = None,
) -> ProposalScan:
    """Discover, match rules, group, and merge into the backlog.

    The proposals feed four outputs, so they are written once and the corpus is scanned only once; they are counted
    as they are written. With ``trace_path`` the scan's events are appended there as JSON lines: the start before
    anything runs, the hits and the end afterwards. A scan that fails ends with the status ``error`` and the proposals it
    had stored by then, and raises what made it fail.
    """
    spark = corpus.sparkSession
    status, count = "ok", 0

    def scans() -> DataFrame:
        schema = "scan_id STRING, project_path STRING, status STRING, proposal_count BIGINT"
        return spark.createDataFrame([(scan_id, project_path, status, count)], schema)

    def tell(events: DataFrame) -> None:
        if trace_path:
            append_json(events, trace_path)

    tell(scan_events(scans()).filter(F.col("type") == SCAN_START))
    try:
        files = discover_files(corpus, path_filter=config.path_filter(), wanted=wanted)
        seen, path = Observation(), scratch_path(spark, "proposals")
        found = build_proposals(files, as_of, scan_id, config.rules())
        found.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        proposals, count = spark.read.parquet(path), seen.get["n"]
        tell(hit_events(proposals))
    except Exception:
        status = "error"
        raise
    finally:
        tell(scan_events(scans()).filter(F.col("type") == SCAN_END))
    return ProposalScan(
        proposals=proposals,
        hypotheses=build_hypotheses(signals_of(proposals), timestamp_of(as_of)),
        backlog=upsert_backlog(prior, proposals, as_of),
        summary=scan_summary(proposals, timestamp_of(as_of)),
        trace=scan_trace(proposals, scans()),
    )
