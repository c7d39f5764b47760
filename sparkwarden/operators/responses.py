"""From raw analyzer responses to one result per file and analysis type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import json_text as J

# How each analyzer's output is read, and its messages.
DIRECT, NOISY, STRUCTURED = "direct", "noisy", "structured"
ANALYZER_MODES = {"llm": DIRECT, "aider": NOISY, "static": STRUCTURED}
CALL_FAILED = "Chiamata LLM fallita dopo {attempts} tentativi"
NO_JSON = "Nessun JSON valido nella risposta del modello"
FAILED = "Analysis failed"

TASK_KEY = ("run_id", "file_path", "analysis_type")
RESPONSE_SCHEMA = (
    "run_id STRING, file_path STRING, analysis_type STRING, analyzer_id STRING, analyzer_ord INT, "
    "mode STRING, attempt INT, call_ok BOOLEAN, timed_out BOOLEAN, raw STRING, error STRING, "
    "completed_at TIMESTAMP, execution_time DOUBLE"
)


def _parsed(mode: Column, raw: Column) -> Column:
    return F.when(mode == DIRECT, J.parse_direct(raw)).when(mode == NOISY, J.parse_noisy(raw))


def resolve_attempts(responses: DataFrame, max_retries: int = 2) -> DataFrame:
    """The deciding attempt of every task and analyzer.

    Attempts beyond the limit are ignored. The first one with usable JSON wins; in noisy mode a
    timeout ends the attempts at once; otherwise the last attempt's failure stands. Implemented as a
    ``min_by`` that combines before the shuffle.
    """
    mode, raw = F.col("mode"), F.when(F.col("call_ok"), F.col("raw"))
    tried = (
        responses.filter(F.col("attempt") <= max_retries + 1)
        .withColumn("parsed", _parsed(mode, raw))
        .withColumn(
            "usable",
            F.when(mode == DIRECT, J.usable_direct(F.col("parsed")))
            .when(mode == NOISY, J.usable_noisy(F.col("parsed")))
            .otherwise(F.col("call_ok")),
        )
    )
    stopped = (mode == NOISY) & F.col("timed_out")
    final = F.col("usable") | stopped
    rank = F.struct(
        F.when(final, 0).otherwise(1).alias("open"),
        F.when(final, F.col("attempt")).otherwise(-F.col("attempt")).alias("place"),
    )
    kept = ("analyzer_ord", "mode", "attempt", "call_ok", "timed_out", "raw", "error", "usable",
            "parsed", "completed_at", "execution_time")
    chosen = tried.groupBy(*TASK_KEY, "analyzer_id").agg(F.min_by(F.struct(*kept), rank).alias("r"))
    return chosen.select(*TASK_KEY, "analyzer_id", "r.*")


def analyzer_results(resolved: DataFrame, max_retries: int = 2) -> DataFrame:
    """Success, findings, score and messages of each analyzer's deciding attempt.

    ``abort`` carries the message of a parsed value that breaks the task altogether. ``ends`` marks what
    no later analyzer comes after: such a value, or a noisy answer whose findings cannot be listed. The latter
    has succeeded by then, so the task is a success without findings, score or text from it.
    """
    mode, ok = F.col("mode"), F.col("usable") & ~((F.col("mode") == NOISY) & F.col("timed_out"))
    found = resolved.withColumn("ok", ok).withColumn(
        "findings",
        F.when(mode == DIRECT, J.findings_direct(F.col("parsed")))
        .when(mode == NOISY, J.findings_noisy(F.col("parsed")))
        .otherwise(F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")),
    )
    abort = F.when(F.col("ok") & (mode == DIRECT), J.abort_direct(F.col("parsed"), F.col("raw")))
    unlisted = F.col("ok") & (mode == NOISY) & F.col("findings").isNull()
    error = (
        F.when(F.col("ok") | (mode == NOISY), F.lit(None).cast("string"))
        .when((mode == DIRECT) & F.col("call_ok"), F.lit(NO_JSON))
        .when(mode == DIRECT, F.replace(F.lit(CALL_FAILED), F.lit("{attempts}"), F.col("attempt").cast("string")))
        .otherwise(F.col("error"))
    )
    return found.select(
        *TASK_KEY,
        "analyzer_id",
        "analyzer_ord",
        F.col("ok").alias("success"),
        abort.alias("abort"),
        (abort.isNotNull() | unlisted).alias("ends"),
        F.when(F.col("ok"), F.col("findings")).alias("findings"),
        F.when(
            F.col("ok") & ~unlisted,
            F.when(mode == DIRECT, J.score_direct(F.col("parsed")).cast("string")).when(
                mode == NOISY, J.score_noisy(F.col("parsed"))
            ),
        ).alias("score"),
        F.when((mode != DIRECT) | F.col("call_ok"), F.when(mode != STRUCTURED, F.col("raw"))).alias("raw_output"),
        error.alias("error"),
        "completed_at",
        "execution_time",
    )


def merge_analyzers(results: DataFrame) -> DataFrame:
    """One row per task over its analyzers, in analyzer order.

    The input has one row per task and analyzer, so an array holds at most as many items as analyzers
    are configured. Nothing after an analyzer that ends the task counts, and of that one only whether it
    had succeeded.
    """
    item = F.struct(
        "analyzer_ord", "analyzer_id", "success", "abort", "ends", "findings", "score", "raw_output", "error"
    )
    grouped = results.groupBy(*TASK_KEY).agg(
        F.array_sort(
            F.collect_list(item),
            lambda a, b: (a["analyzer_ord"] - b["analyzer_ord"]).cast("int"),
        ).alias("all"),
        F.min(F.when(F.col("ends"), F.col("analyzer_ord"))).alias("stop"),
        F.max("completed_at").alias("completed_at"),
        F.sum("execution_time").alias("execution_time"),
    )
    reached = grouped.withColumn(
        "reached",
        F.filter("all", lambda r: F.col("stop").isNull() | (r["analyzer_ord"] < F.col("stop"))),
    )
    good = reached.withColumn("good", F.filter("reached", lambda r: r["success"]))
    scores = F.filter(F.transform("good", lambda r: r["score"]), lambda s: s.isNotNull())
    raws = F.filter(
        F.transform("good", lambda r: r["raw_output"]), lambda s: F.coalesce(s, F.lit("")) != ""
    )
    messages = F.concat(
        F.transform(
            F.filter("reached", lambda r: ~r["success"] & (F.coalesce(r["error"], F.lit("")) != "")),
            lambda r: F.concat(r["analyzer_id"], F.lit(": "), r["error"]),
        ),
        F.transform(
            F.filter("all", lambda r: (r["analyzer_ord"] == F.col("stop")) & r["abort"].isNotNull()), lambda r: r["abort"]
        ),
    )
    ended_well = F.exists("all", lambda r: (r["analyzer_ord"] == F.col("stop")) & r["success"] & r["abort"].isNull())
    success = (F.size("good") > 0) | F.coalesce(ended_well, F.lit(False))
    return good.select(
        *TASK_KEY,
        success.alias("success"),
        F.coalesce(
            F.flatten(F.transform("good", lambda r: r["findings"])), F.array().cast("array<variant>")
        ).alias("findings"),
        F.try_element_at(scores, F.lit(-1)).alias("score"),
        F.when(F.size(raws) > 0, F.array_join(raws, "\n\n")).alias("raw_output"),
        F.when(
            ~success, F.coalesce(F.nullif(F.array_join(messages, "; "), F.lit("")), F.lit(FAILED))
        ).alias("error"),
        "completed_at",
        "execution_time",
    )


def audit_results(responses: DataFrame, max_retries: int = 2) -> DataFrame:
    """Attempts to results: resolve, read, merge."""
    return merge_analyzers(analyzer_results(resolve_attempts(responses, max_retries), max_retries))
