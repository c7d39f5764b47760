"""Grouping signals by rule and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.skew import number_rows

# Severities from lowest to highest; anything else ranks with the lowest.
SEVERITY_ORDER = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity)
    return F.greatest(F.coalesce(place, F.lit(0)) - F.lit(1), F.lit(0)).cast("int")


def build_hypotheses(signals: DataFrame, created_at: Column | None = None) -> DataFrame:
    """One row per (rule, file) from ``signals``, which must carry a sortable ``ord``.

    Severity is the highest rank and, within it, the earliest signal's; confidence is the mean; the
    first signal is the primary one. Everything is an aggregate that combines before the shuffle, so
    a group of any size costs one partial row per input partition. The member signals stay in their
    own table, see :func:`signal_chunks`.
    """
    primary = F.struct("line_number", "code_snippet", "context", "severity", "confidence")
    # Highest rank first, then earliest: the minimum of (-rank, ord).
    key = F.struct((-severity_rank(F.col("severity"))).alias("rank"), F.col("ord").alias("ord"))
    analyzer = F.col("source_analyzer") if "source_analyzer" in signals.columns else F.lit("static")
    return signals.groupBy("rule_id", "file_path").agg(
        F.min_by(analyzer, F.col("ord")).alias("source_analyzer"),
        F.min_by("severity", key).alias("severity"),
        F.avg("confidence").alias("confidence"),
        F.lit(False).alias("validated"),
        F.lit(None).cast("string").alias("notes"),
        F.count(F.lit(1)).alias("signal_count"),
        F.min_by(primary, F.col("ord")).alias("primary_signal"),
        *([F.min(created_at).alias("created_at")] if created_at is not None else []),
    )


def signal_chunks(signals: DataFrame, per_chunk: int = 500) -> DataFrame:
    """Member signals nested per (rule, file, chunk), in order, ``per_chunk`` to a chunk.

    No array grows with its group; reading the chunks of a hypothesis by number gives its complete
    ordered signal list.
    """
    key = ["rule_id", "file_path"]
    item = F.struct("ord", "line_number", "code_snippet", "context", "severity", "confidence", "source_detector")
    placed = number_rows(signals, key, ["ord"], "_place", "signal_count")
    chunk = F.floor((F.col("_place") - 1) / F.lit(per_chunk)).alias("chunk")
    return placed.groupBy(*key, "signal_count", chunk).agg(F.array_sort(F.collect_list(item)).alias("signals"))
