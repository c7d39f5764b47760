"""The audit run, end to end: tasks, prompts, answers, results and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.plugins import Analyzer, analyze_batch
from sparkwarden.operators.proposals import build_proposals, static_findings
from sparkwarden.operators.reports import report_metadata, report_name, report_results
from sparkwarden.operators.responses import TASK_KEY, audit_results
from sparkwarden.operators.tasks import audit_tasks, discover_files, with_prompts
from sparkwarden.session import cut_lineage
from sparkwarden.sources.config import AuditConfig, best_practices


@dataclass(frozen=True)
class AuditRun:
    results: DataFrame
    meta: DataFrame
    report: DataFrame


def static_responses(files: DataFrame, tasks: DataFrame, config: AuditConfig, analyzer_ord: int, as_of: str | None = None) -> DataFrame:
    """The static analyzer's answers: the findings of each file as a JSON list, for all its tasks.

    They need no call, so they are complete as of the time of the run.
    """
    findings = static_findings(build_proposals(files, "1970-01-01 00:00:00", None, config.rules()))
    item = F.struct(
        "ord",
        F.to_json(
            F.struct("rule_id", "severity", "title", "description", "evidence", "recommendation", "confidence")
        ).alias("json"),
    )
    # one file's hits: bounded by the size of that file
    per_file = findings.groupBy("file_path").agg(
        F.concat(
            F.lit("["),
            F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["json"]), ","),
            F.lit("]"),
        ).alias("raw")
    )
    known = tasks.filter(F.col("error").isNull()).select(*TASK_KEY)
    return known.join(per_file, "file_path", "left").select(
        *TASK_KEY, F.lit("static").alias("analyzer_id"), F.lit(analyzer_ord).alias("analyzer_ord"),
        F.lit("structured").alias("mode"), F.lit(1).alias("attempt"), F.lit(True).alias("call_ok"),
        F.lit(False).alias("timed_out"), F.coalesce("raw", F.lit("[]")).alias("raw"),
        F.lit(None).cast("string").alias("error"), F.to_timestamp(F.lit(as_of)).alias("completed_at"),
        F.lit(0.0).alias("execution_time"),
    )


def failed_tasks(tasks: DataFrame, as_of: str | None = None) -> DataFrame:
    """Result rows of tasks that could not start: unknown analysis type, unreadable file. They end as of the time of the run."""
    return tasks.filter(F.col("error").isNotNull()).select(
        *TASK_KEY, F.lit(False).alias("success"), F.array().cast("array<variant>").alias("findings"),
        F.lit(None).cast("string").alias("score"), F.lit(None).cast("string").alias("raw_output"), "error",
        F.to_timestamp(F.lit(as_of)).alias("completed_at"), F.lit(0.0).alias("execution_time"),
    )


def audit_run(
    corpus: DataFrame,
    config: AuditConfig,
    platform: str,
    requested: Sequence[str],
    run_id: str,
    as_of: str,
    project_path: str,
    calls: Mapping[str, Analyzer] | None = None,
    practices: str = "",
    practices_paths: Sequence[str] = (),
    model_id: str | None = None,
    parallel_calls: int | None = None,
    pause: float = 0.0,
    lint_results: DataFrame | None = None,
) -> AuditRun:
    """Audit all files of a platform with the configured analyzers.

    ``calls`` maps analyzer ids to functions that take the two prompts and return raw text; an
    analyzer without one counts as unavailable. Failed attempts are repeated as often as the configuration
    allows, ``pause`` seconds apart. A file that could not be read (``error`` of the corpus) gives failed
    results. ``practices_paths`` are tried in order where ``practices`` is empty. Without files the run is
    empty, whatever analyzers there are. Results are stored once; all tables read them.
    """
    calls = calls or {}
    spark = corpus.sparkSession
    target = config.platform(platform)
    if target is None:
        raise ValueError(f"unknown platform: {platform}")
    files = discover_files(corpus, target.extensions, config.path_filter())
    empty = files.select("file_path").isEmpty()
    chosen = [] if empty else config.analyzers(set(calls))
    types = config.type_dimension(spark, platform)
    practices = practices or best_practices(spark, *practices_paths)
    tasks = with_prompts(audit_tasks(files, requested, types), practices).withColumn("run_id", F.lit(run_id))
    retries = {name: config.max_retries(name) for name, _ in chosen}
    answers = [
        static_responses(files, tasks, config, i, as_of)
        if name == "static"
        else analyze_batch(tasks, name, i, mode, calls[name], parallel_calls, retries[name] + 1, pause)
        for i, (name, mode) in enumerate(chosen)
    ]
    results = failed_tasks(tasks, as_of)
    if answers:
        # a call is made once: its answer is stored before anything reads it twice
        responses = cut_lineage(reduce(DataFrame.unionByName, answers))
        results = audit_results(responses, max(retries.values())).unionByName(results)
    results = cut_lineage(results)
    if lint_results is not None:
        results = results.join(lint_results, "file_path", "left")
    at = F.to_timestamp(F.lit(as_of))
    model = config.model(model_id) or {}
    meta = report_metadata(results, at).select(
        "*", F.lit(project_path).alias("project_path"), F.lit(target.name).alias("platform"),
        F.struct(*[F.lit(model.get(k)).cast("string").alias(k) for k in ("id", "name", "type")]).alias("model"),
        report_name(F.lit(target.name), at).alias("report_file"),
    )
    return AuditRun(results=results, meta=meta, report=report_results(results))
