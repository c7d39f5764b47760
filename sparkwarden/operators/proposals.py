"""Proposals, signals and findings derived from rule hits."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.text import proposal_id
from sparkwarden.operators.rules import BUILTIN_RULES, Rule, describe_hits, match_rules

HIT_ORDER = ("file_path", "rule_ord", "line_number", "pattern_ord", "match_no")


def timestamp_of(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.to_timestamp(F.lit(str(as_of)))


def build_proposals(
    corpus: DataFrame,
    as_of: datetime | str | Column,
    scan_id: str | Column | None = None,
    rules: Iterable[Rule] = BUILTIN_RULES,
) -> DataFrame:
    """One proposal row per rule hit. ``ord`` is its place in a sequential scan of sorted files.

    Stateless and shuffle-free, so the same function serves batch and streaming input.
    """
    rules = list(rules)
    scan = scan_id if isinstance(scan_id, Column) else F.lit(scan_id).cast("string")
    at = timestamp_of(as_of)
    hits = describe_hits(match_rules(corpus, rules), rules)
    return hits.select(
        proposal_id(F.col("rule_id"), F.col("file_path"), F.col("line_number")).alias("id"),
        F.col("rule_id").alias("type"),
        "title",
        "description",
        F.array(F.struct("file_path", "line_number", "code_snippet", "context")).alias("evidence"),
        "severity",
        "priority",
        "confidence",
        "risk_level",
        "autofixable",
        "recommendation",
        F.lit("detected").alias("state"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.lit(None).cast("string").alias("source_analysis"),
        F.col("rule_id").alias("source_rule"),
        scan.alias("scan_id"),
        F.struct(*HIT_ORDER).alias("ord"),
    )


def first_evidence(field: str) -> Column:
    return F.get(F.col("evidence"), F.lit(0))[field]


def signals_of(proposals: DataFrame) -> DataFrame:
    """The atomic observation behind every proposal."""
    rule = F.coalesce(F.nullif(F.col("source_rule"), F.lit("")), F.col("type"))
    return proposals.select(
        rule.alias("rule_id"),
        first_evidence("file_path").alias("file_path"),
        "ord",
        first_evidence("line_number").alias("line_number"),
        first_evidence("code_snippet").alias("code_snippet"),
        first_evidence("context").alias("context"),
        "severity",
        "confidence",
        rule.alias("source_detector"),
    )


def static_findings(proposals: DataFrame) -> DataFrame:
    """The findings of the static analyzer: seven fields per hit plus file and order."""
    return proposals.select(
        first_evidence("file_path").alias("file_path"),
        "ord",
        F.col("source_rule").alias("rule_id"),
        "severity",
        "title",
        "description",
        "evidence",
        "recommendation",
        "confidence",
    )
