"""The registered queries: every operator over the test tables."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import json_text as J
from sparkwarden.functions import paths as P
from sparkwarden.functions.text import proposal_id, read_text, redact
from sparkwarden.operators import backlog as B
from sparkwarden.operators import lint as L
from sparkwarden.operators import plugins, reports, tasks, trace
from sparkwarden.operators.hypotheses import build_hypotheses, signal_chunks
from sparkwarden.operators.proposals import build_proposals, first_evidence, signals_of, static_findings
from sparkwarden.operators.responses import analyzer_results, audit_results, merge_analyzers, resolve_attempts
from sparkwarden.operators.rules import BUILTIN_RULES, Rule, configured_rules, match_rules, numbered_lines
from sparkwarden.operators.transitions import judge_requests, move_states
from sparkwarden.plans import audit
from sparkwarden.queries import adapters as A
from sparkwarden.session import cut_lineage, prepare, scratch_path
from sparkwarden.sources import changes as changes_of
from sparkwarden.sources import documents, stores
from sparkwarden.sources.config import AuditConfig, default_config
from sparkwarden.streaming import jobs, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TIME = "yyyy-MM-dd HH:mm:ss"
EXACT_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
OVERRIDES = {
    "leaked_project_ids": {"severity": "high", "confidence": 0.5},
    "hardcoded_constants": {"enabled": False},
    "non_agnostic_prompts": {"priority": "p3", "risk_level": "low"},
}
# what users would look for in the raw documents
USER_RULES = tuple(
    Rule(rule_id=name, patterns=(pattern,), title="{match}", description="{match}", recommendation="", context="")
    for name, pattern in (
        ("token", r'token = "[0-9a-f]+"'),
        ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
        ("email", r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+"),
        ("licence", r"(?i)licen[cs]e"),
    )
)
REQUESTED_TYPES = ("deep_scan", "security_scan", "no_such_scan")
PRACTICES = "Keep secrets out of the code.\n" * 400


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(prepare(spark), sf_dir.rstrip("/"))

    QUERIES[make.__name__] = run
    return make


# ---- inputs -------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str, adapter: dict[str, str]) -> DataFrame:
    return A.select(A.table(spark, sf_dir, name), adapter)


def _corpus(spark, sf_dir):
    return _table(spark, sf_dir, "documents", A.CORPUS)


def _proposals(spark, sf_dir, **options):
    return build_proposals(_corpus(spark, sf_dir), A.AS_OF, A.SCAN_ID, **options)


def _responses(spark, sf_dir):
    return _table(spark, sf_dir, "events", A.RESPONSES)


def _results(spark, sf_dir):
    return audit_results(_responses(spark, sf_dir))


def _prior(spark, sf_dir):
    """The backlog an earlier scan left behind: labelled documents only, states already moved on."""
    labelled = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id")
    corpus = labelled.selectExpr(*[f"{e} AS {n}" for n, e in A.CORPUS.items()], f"{A.PRIOR_STATE} AS labelled")
    empty = spark.createDataFrame([], B.PROPOSAL_SCHEMA)
    found = B.upsert_backlog(empty, build_proposals(corpus, A.AS_OF, "scan-000"), A.AS_OF)
    states = corpus.select("file_path", "labelled")
    joined = found.withColumn("file_path", first_evidence("file_path")).join(states, "file_path")
    return joined.withColumn("state", F.col("labelled")).select(*B.PROPOSAL_FIELDS)


def _eligible(spark, sf_dir, source=_corpus):
    return tasks.eligible(source(spark, sf_dir), P.SCAN_EXTENSIONS, default_config().path_filter())


def _rescan(spark, sf_dir):
    return build_proposals(_eligible(spark, sf_dir), A.LATER, A.SCAN_ID)


def _text_time(name: str, pattern: str = TIME) -> Column:
    return F.date_format(name, pattern).alias(name)


def _flat(proposals: DataFrame) -> DataFrame:
    return proposals.select(
        "id", "type", "title", "description", "severity", "priority",
        F.round("confidence", 4).alias("confidence"), "risk_level", "autofixable", "recommendation", "state",
        _text_time("created_at"), _text_time("updated_at"), "source_rule", "scan_id",
        *[first_evidence(f).alias(f) for f in ("file_path", "line_number", "code_snippet", "context")],
    )


# ---- sources, paths, filters --------------------------------------------------------------------


@query
def discover_files(spark, sf_dir):
    return tasks.distinct_paths(_eligible(spark, sf_dir)).orderBy("file_path")


@query
def read_text_files(spark, sf_dir):
    tail = F.encode(F.lit("\r\nx\ry"), "UTF-8")
    raw = _table(spark, sf_dir, "documents", A.RAW_CORPUS).select(
        "file_path", F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("FF")), tail).alias("data")
    )
    text = raw.select("file_path", read_text(F.col("data")).alias("content"))
    return text.select("file_path", F.md5("content").alias("digest"), F.length("content").alias("chars"))


@query
def scan_file_list(spark, sf_dir):
    listed = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents"), "doc_id")
    wanted = listed.selectExpr(f"{A.FILE_PATH} AS file_path")
    chosen = tasks.discover_files(_corpus(spark, sf_dir), wanted=wanted)
    return chosen.select("file_path", F.length("content").alias("chars"))


@query
def dims_platform_types(spark, sf_dir):
    config = default_config()
    extension = F.regexp_extract("file_path", r"\.[^./]+$", 0).alias("extension")
    counts = _corpus(spark, sf_dir).select(extension).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))
    dims = config.extension_dimension(spark).join(config.type_dimension(spark), "platform")
    return (
        counts.join(F.broadcast(dims), "extension")
        .groupBy("platform", "platform_name", "analysis_type", "type_name")
        .agg(F.sum("n").alias("files"))
    )


@query
def audit_tasks(spark, sf_dir):
    config = default_config()
    files = tasks.eligible(_corpus(spark, sf_dir), config.platform("python").extensions, config.path_filter())
    return tasks.audit_tasks(files.select("root", "file_path"), REQUESTED_TYPES, config.type_dimension(spark, "python")).select(
        "file_path", "analysis_type", "type_name", "error"
    )


def _prompt_tasks(spark, sf_dir, requested):
    config = default_config()
    platform = config.platform("python")
    files = tasks.eligible(_corpus(spark, sf_dir), platform.extensions, config.path_filter())
    made = tasks.audit_tasks(files, requested, config.type_dimension(spark, "python"))
    return tasks.with_prompts(made, PRACTICES).withColumn("run_id", F.lit("run0"))


@query
def prompt_render(spark, sf_dir):
    full = tasks.full_prompt(F.col("prompt_template"), F.col("file_path"), F.lit(PRACTICES))
    bare = tasks.user_prompt(F.lit(""), F.col("file_path"), F.col("root"), F.col("content"))
    made = _prompt_tasks(spark, sf_dir, REQUESTED_TYPES)
    return made.select(
        "file_path", "analysis_type",
        F.md5(full).alias("full_prompt"), F.md5("prompt_system").alias("system_prompt"),
        F.md5("prompt_user").alias("user_prompt"), F.md5(bare).alias("default_prompt"),
    )


@query
def path_match(spark, sf_dir):
    docs = _corpus(spark, sf_dir).select("root", "file_path")
    pages = _table(spark, sf_dir, "pages", A.PATHS)
    path, root = F.col("file_path"), F.col("root")
    tests = []
    for i, pattern in enumerate(A.MATCH_PATTERNS):
        tests += [
            P.part_equals(path, root, pattern).alias(f"part_{i}"),
            P.glob_matches(path, root, pattern).alias(f"glob_{i}"),
            P.contains_text(path, pattern).alias(f"text_{i}"),
            P.matches_any(path, root, [pattern]).alias(f"match_{i}"),
        ]
    return docs.unionByName(pages).distinct().select("file_path", *tests)


@query
def filter_modes(spark, sf_dir):
    path, root = F.col("file_path"), F.col("root")
    kept = [
        P.PathFilter.from_config(
            {"include_patterns": A.INCLUDE, "exclude_patterns": A.EXCLUDE, "default_behavior": mode}
        ).keep(path, root).alias(mode)
        for mode in P.FILTER_MODES
    ]
    nothing = P.PathFilter(mode="include_only").keep(path, root).alias("nothing_included")
    return _corpus(spark, sf_dir).select("file_path", *kept, nothing)


@query
def scan_lines(spark, sf_dir):
    return numbered_lines(_corpus(spark, sf_dir))


# ---- rules and proposals ------------------------------------------------------------------------


def _hits(rule_id: str):
    def make(spark, sf_dir):
        rules = [r for r in BUILTIN_RULES if r.rule_id == rule_id]
        return _flat(_proposals(spark, sf_dir, rules=rules)).select(
            "id", "file_path", "line_number", "code_snippet", "context", "title", "severity"
        )

    return make


for _name, _rule in (
    ("detect_model_names", "hardcoded_model_names"),
    ("detect_constants", "hardcoded_constants"),
    ("detect_prompts", "non_agnostic_prompts"),
    ("detect_project_ids", "leaked_project_ids"),
):
    _make = _hits(_rule)
    _make.__name__ = _name
    query(_make)


@query
def proposals(spark, sf_dir):
    return _flat(_proposals(spark, sf_dir))


@query
def rule_overrides(spark, sf_dir):
    return _flat(_proposals(spark, sf_dir, rules=configured_rules(OVERRIDES)))


@query
def proposal_ids(spark, sf_dir):
    hits = match_rules(_corpus(spark, sf_dir), BUILTIN_RULES)
    rule, path = F.col("rule_id"), F.col("file_path")
    return hits.select(
        "rule_id", "file_path", "line_number",
        proposal_id(rule, path, F.col("line_number")).alias("id"),
        proposal_id(rule, path, F.lit(None).cast("int")).alias("file_id"),
    )


@query
def static_analyzer_findings(spark, sf_dir):
    found = static_findings(_proposals(spark, sf_dir))
    return found.select(
        "rule_id", "severity", "title", "description", F.to_json("evidence").alias("evidence"),
        "recommendation", F.round("confidence", 4).alias("confidence"),
    )


@query
def custom_rule(spark, sf_dir):
    raw = _table(spark, sf_dir, "documents", A.RAW_CORPUS)
    return match_rules(raw, USER_RULES).select("rule_id", "file_path", "line_number", "match_no", "match")


def _repeated_lines(path, content):
    seen = set()
    for number, line in enumerate(content.splitlines(), 1):
        if line.strip() and line in seen:
            yield {"line_number": number, "code_snippet": line.strip()[:200], "context": str(len(line))}
        seen.add(line)


@query
def custom_python_rule(spark, sf_dir):
    raw = _table(spark, sf_dir, "documents", A.RAW_CORPUS)
    return plugins.python_rule(raw, "repeated_lines", _repeated_lines, "low").select(
        "file_path", "rule_id", "line_number", "context", "severity", "error"
    )


@query
def custom_rule_in_sql(spark, sf_dir):
    """The same rule as a table function, called from SQL text."""
    plugins.register_rule(spark, "repeated_lines", "repeated_lines", _repeated_lines, "low")
    return spark.sql(
        "SELECT file_path, rule_id, line_number, context, severity, error FROM repeated_lines(TABLE(SELECT * FROM {raw}))",
        raw=_table(spark, sf_dir, "documents", A.RAW_CORPUS),
    )


# ---- signals and hypotheses ---------------------------------------------------------------------


@query
def signals(spark, sf_dir):
    return signals_of(_proposals(spark, sf_dir)).select(
        "rule_id", "file_path", "line_number", "code_snippet", "context", "severity",
        F.round("confidence", 4).alias("confidence"), "source_detector",
    )


def _flat_hypotheses(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "rule_id", "file_path", "source_analyzer", "severity", F.round("confidence", 6).alias("confidence"),
        "validated", "signal_count", F.col("primary_signal.line_number").alias("first_line"),
        F.col("primary_signal.code_snippet").alias("first_snippet"),
    )


@query
def hypotheses(spark, sf_dir):
    return _flat_hypotheses(build_hypotheses(signals_of(_proposals(spark, sf_dir))))


@query
def hypotheses_mixed(spark, sf_dir):
    return _flat_hypotheses(build_hypotheses(_table(spark, sf_dir, "events", A.SIGNALS)))


@query
def hypothesis_signals(spark, sf_dir):
    chunks = signal_chunks(_table(spark, sf_dir, "events", A.SIGNALS), per_chunk=20)
    return chunks.select(
        "rule_id", "file_path", "chunk", "signal_count", F.size("signals").alias("n"),
        F.array_join(F.transform("signals", lambda s: s["code_snippet"]), ",").alias("snippets"),
    )


# ---- backlog ------------------------------------------------------------------------------------


@query
def backlog_upsert(spark, sf_dir):
    return _flat(B.upsert_backlog(_prior(spark, sf_dir), _rescan(spark, sf_dir), A.LATER))


@query
def backlog_get(spark, sf_dir):
    return _flat(B.get_proposals(_prior(spark, sf_dir), _rescan(spark, sf_dir).select("id")))


@query
def backlog_list(spark, sf_dir):
    return B.list_backlog(_flat(_prior(spark, sf_dir)), "validated")


def _read_back(spark, lines: DataFrame) -> DataFrame:
    path = scratch_path(spark, "stored")
    lines.write.text(path)
    return stores.read_backlog(spark, path, "json").select(
        "id", "type", "title", F.size("evidence").alias("evidence"), "severity", "priority", "confidence",
        "risk_level", "autofixable", "recommendation", "state", "source_rule", "scan_id",
    )


@query
def backlog_defaults(spark, sf_dir):
    return _read_back(spark, _table(spark, sf_dir, "labels", A.STORED))


@query
def backlog_corrupt(spark, sf_dir):
    """Lines of ids that end in 0 are cut short, those of ids that end in 1 lack the id."""
    line = F.col("value")
    broken = F.when(line.rlike('"id":"p[0-9]*0"'), F.substring(line, 1, 40)).when(
        line.rlike('"id":"p[0-9]*1"'), F.regexp_replace(line, '"id"', '"no"')
    )
    return _read_back(spark, _table(spark, sf_dir, "labels", A.STORED).select(F.coalesce(broken, line).alias("value")))


def _by_source(spark, sf_dir):
    scan = F.concat(F.lit("scan-"), F.split_part("file_path", F.lit("/"), F.lit(4)))
    return build_proposals(_eligible(spark, sf_dir), A.AS_OF, scan)


@query
def scan_summary(spark, sf_dir):
    return B.scan_summary(_by_source(spark, sf_dir)).select("scan_id", _text_time("timestamp"), "proposal_count")


@query
def scan_list(spark, sf_dir):
    path = scratch_path(spark, "scans")
    found = cut_lineage(_by_source(spark, sf_dir))
    stores.write_scans(B.scan_summary(found), found.drop("ord"), path)
    return stores.list_scans(spark, f"{path}/summary")


@query
def scan_get(spark, sf_dir):
    """The stored proposals of the last scan, read back by its id; it is written twice and replaced."""
    path = scratch_path(spark, "scans")
    found = cut_lineage(_by_source(spark, sf_dir))
    for _ in range(2):
        stores.write_scans(B.scan_summary(found), found.drop("ord"), path)
    last = stores.list_scans(spark, f"{path}/summary").first().scan_id
    return _flat(stores.read_scan(spark, path, last)[1])


def _transition_inputs(spark, sf_dir):
    return _table(spark, sf_dir, "labels", A.START_STATES), _table(spark, sf_dir, "events", A.TRANSITIONS)


def _flat_outcomes(judged: DataFrame) -> DataFrame:
    return judged.select("id", _text_time("ts", EXACT_TIME), "seq", "from_state", "new_state", "accepted", "refusal")


@query
def transitions_apply(spark, sf_dir):
    return _flat_outcomes(judge_requests(*_transition_inputs(spark, sf_dir)))


@query
def transitions_backlog(spark, sf_dir):
    states, log = _transition_inputs(spark, sf_dir)
    return move_states(states, judge_requests(states, log)).select("id", "state", _text_time("updated_at", EXACT_TIME))


@query
def transition_events(spark, sf_dir):
    return _flat_events(trace.validation_events(judge_requests(*_transition_inputs(spark, sf_dir))))


# ---- trace --------------------------------------------------------------------------------------


def _flat_events(events: DataFrame) -> DataFrame:
    return events.withColumn("tags", F.array_join("tags", ","))


@query
def trace_events(spark, sf_dir):
    found = cut_lineage(_by_source(spark, sf_dir))
    scans = B.scan_summary(found).select(
        "scan_id", F.lit(A.ROOT).alias("project_path"), F.lit("ok").alias("status"), "proposal_count"
    )
    return _flat_events(trace.scan_trace(found, scans))


# ---- responses ----------------------------------------------------------------------------------


def _parse(function):
    def make(spark, sf_dir):
        raw = _table(spark, sf_dir, "events", A.RAW_OUTPUTS).withColumn("parsed", function(F.col("raw")))
        return raw.select("event_id", J.kind(F.col("parsed")).alias("kind"), F.to_json("parsed").alias("parsed"))

    return make


for _name, _function in (("parse_direct", J.parse_direct), ("parse_noisy", J.parse_noisy)):
    _make = _parse(_function)
    _make.__name__ = _name
    query(_make)


@query
def findings_scores(spark, sf_dir):
    raw = _table(spark, sf_dir, "events", A.RAW_OUTPUTS)
    parsed = raw.select("event_id", "raw", J.parse_direct(F.col("raw")).alias("d"), J.parse_noisy(F.col("raw")).alias("n"))
    direct, noisy = F.col("d"), F.col("n")
    return parsed.select(
        "event_id",
        J.usable_direct(direct).alias("direct_ok"), J.usable_noisy(noisy).alias("noisy_ok"),
        J.abort_direct(direct, F.col("raw")).alias("direct_abort"),
        F.to_json(J.findings_direct(direct)).alias("direct_findings"),
        F.to_json(J.findings_noisy(noisy)).alias("noisy_findings"),
        J.score_direct(direct).alias("direct_score"), J.score_noisy(noisy).alias("noisy_score"),
    )


@query
def retry_resolve(spark, sf_dir):
    return resolve_attempts(_responses(spark, sf_dir)).select(
        "run_id", "file_path", "analysis_type", "analyzer_id", "attempt", "call_ok", "timed_out", "usable", "raw"
    )


@query
def merge_results(spark, sf_dir):
    merged = merge_analyzers(analyzer_results(resolve_attempts(_responses(spark, sf_dir))))
    return merged.select(
        "run_id", "file_path", "analysis_type", "success", F.to_json("findings").alias("findings"), "score",
        "raw_output", "error",
    )


@query
def redact_messages(spark, sf_dir):
    rows = _table(spark, sf_dir, "events", A.MESSAGES)
    return rows.select("event_id", redact(F.col("message"), F.col("secret")).alias("message"))


def _answering(failing: str | None = None):
    """An analyzer whose answers, and how many attempts they take, depend on the length of its prompt alone."""
    # attempts at a task follow one another: only the last prompt is held
    last, tried = None, 0

    def answer(system: str, user: str) -> str:
        nonlocal last, tried
        size = len(user)
        last, tried = user, tried + 1 if user == last else 1
        if size % 7 == 0 or (size % 5 == 0 and tried < 3):
            raise RuntimeError("refused")
        if size % 17 == 0 and failing:
            return failing
        if size % 11 == 0:
            return "nothing to report"
        return f'Sure: {{"findings":[{{"severity":"high"}},{{"severity":"low"}}],"overall_score":{size % 100}}}'

    return answer


@query
def analyze_tasks(spark, sf_dir):
    made = _prompt_tasks(spark, sf_dir, ("deep_scan", "code_quality"))
    answers = plugins.analyze_batch(made, "llm", 0, "direct", _answering(), attempts=3)
    return audit_results(answers).select(
        "file_path", "analysis_type", "success", F.size("findings").alias("findings"), "score", "error"
    )


@query
def audit_run(spark, sf_dir):
    """The whole plan: three analyzers, repeated attempts, answers that end a task, unreadable files, an unknown type."""

    def aider(system: str, user: str) -> str:
        if len(user) % 3 == 0:
            raise TimeoutError("slow")
        return 'Done. {"findings":[{"severity":"critical"}]}' if len(user) % 3 == 1 else '{"findings":null,"overall_score":1}'

    chosen = AuditConfig(default_config().data | {"analyzers": {"llm": {"max_retries": 2}, "aider": {"max_retries": 1}, "static": {}}})
    corpus = _corpus(spark, sf_dir).withColumn("error", F.when(F.length("content") % 13 == 0, "cannot read"))
    calls = {"llm": _answering('["overall_score"]'), "aider": aider}
    run = audit.audit_run(
        corpus, chosen, "python", ("deep_scan", "code_quality", "no_such_scan"), "run0", A.AS_OF, A.ROOT, calls, practices=PRACTICES
    )
    return run.results.select(
        "file_path", "analysis_type", "success", F.size("findings").alias("findings"), "score", "error",
        F.col("completed_at").isNotNull().alias("completed"),
    )


# ---- linters ------------------------------------------------------------------------------------


@query
def linter_status(spark, sf_dir):
    return L.lint_outcomes(_table(spark, sf_dir, "events", A.LINT_RUNS))


@query
def linter_files(spark, sf_dir):
    runs = _table(spark, sf_dir, "events", A.LINT_RUNS).withColumn(
        "file_path", F.concat(F.lit("/srv/proj/app/"), F.md5("file_path").substr(1, 2))
    )
    per_file = L.lint_by_file(L.lint_outcomes(runs), default_config().enabled_linters("python"))
    pairs = F.transform(
        F.map_entries("linter_results"),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["success"].cast("string"), F.lit("-"))),
    )
    return per_file.select("file_path", F.array_join(pairs, ",").alias("linters"))


# ---- reports ------------------------------------------------------------------------------------


def _meta(results):
    meta = reports.report_metadata(results, F.col("completed_at"))
    return meta.select(
        "run_id", F.lit(A.ROOT).alias("project_path"), F.lit("Python Backend").alias("platform"),
        _text_time("timestamp"), "total_files", "total_analyses", "successful_analyses", "failed_analyses",
        "total_findings", "critical_findings",
        reports.report_name(F.lit("Python Backend"), F.col("timestamp")).alias("report_file"),
    )


@query
def report_meta(spark, sf_dir):
    return _meta(_results(spark, sf_dir))


@query
def report_results(spark, sf_dir):
    rows = reports.report_results(_results(spark, sf_dir))
    return rows.withColumns(
        {"findings": F.to_json("findings"), "score": F.to_json("score"), "execution_time": F.round("execution_time", 4)}
    )


@query
def report_list(spark, sf_dir):
    path = scratch_path(spark, "reports")
    results = cut_lineage(_results(spark, sf_dir))
    stores.write_report(_meta(results), reports.report_results(results), path)
    return stores.list_reports(spark, path)


@query
def report_get(spark, sf_dir):
    """The result rows of the first report by name, read back."""
    path = scratch_path(spark, "reports")
    results = cut_lineage(_results(spark, sf_dir))
    stores.write_report(_meta(results), reports.report_results(results), path)
    name = stores.list_reports(spark, path).orderBy("filename").first().filename
    _, rows = stores.read_report(spark, path, name)
    return rows.select(
        "run_id", "file_path", "analysis_type", "success", F.to_json("findings").alias("findings"), F.to_json("score").alias("score"), "error"
    )


@query
def report_documents(spark, sf_dir):
    """All reports as nested documents, written twice and read back, each row with its document's count."""
    path = scratch_path(spark, "documents")
    results = cut_lineage(_results(spark, sf_dir))
    for _ in range(2):
        documents.write_report_documents(_meta(results), reports.report_results(results), path)
    meta, rows = documents.read_report_documents(spark, path)
    counts = meta.select("filename", "platform", "total_analyses")
    return rows.join(counts, "filename").select(
        "filename", "platform", "total_analyses", "file_path", "analysis_type", "success",
        F.to_json("findings").alias("findings"), F.to_json("score").alias("score"), "error",
    )


def _read_log(spark, path):
    schema = (
        "file_path STRING, analysis_type STRING, success BOOLEAN, findings ARRAY<VARIANT>, score VARIANT, error STRING, "
        "execution_time DOUBLE"
    )
    return spark.read.schema(schema).json(path).withColumns(
        {"findings": F.to_json("findings"), "score": F.to_json("score"), "execution_time": F.round("execution_time", 4)}
    )


@query
def checkpoint_rows(spark, sf_dir):
    path = scratch_path(spark, "progress")
    stores.append_json(reports.checkpoint_rows(_results(spark, sf_dir)), path)
    return _read_log(spark, path)


@query
def findings_view(spark, sf_dir):
    return reports.findings_view(_results(spark, sf_dir))


@query
def progress(spark, sf_dir):
    done = reports.progress(_results(spark, sf_dir))
    return done.select("run_id", "file_path", "analysis_type", "done", "total")


# ---- streaming ----------------------------------------------------------------------------------


def _run(spark, start) -> str:
    """Run a streaming job over what is there; its output folder."""
    out = scratch_path(spark, "stream")
    start(out, scratch_path(spark, "checkpoint")).awaitTermination()
    return out


def _corpus_stream(spark, sf_dir):
    return A.select(A.stream(spark, sf_dir, "documents"), A.CORPUS)


@query
def stream_scan(spark, sf_dir):
    corpus = _corpus_stream(spark, sf_dir)
    keep = default_config().path_filter()
    out = _run(spark, lambda o, c: jobs.scan_stream(corpus, o, c, A.AS_OF, A.SCAN_ID, path_filter=keep))
    return _flat(spark.read.parquet(out))


def _in_rounds(spark, rows, start) -> str:
    """Let ``rows`` arrive in rounds, a micro-batch each; the job's output folder. ``start(stream, out, checkpoint, round)``."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("arriving", "stream", "checkpoint"))
    schema = rows.drop("round").schema
    for k in range(A.ROUNDS):
        rows.filter(F.col("round") == k).drop("round").write.parquet(f"{source}/r{k}")
        start(spark.readStream.schema(schema).parquet(f"{source}/r*"), out, checkpoint, k).awaitTermination()
    return out


@query
def stream_upsert(spark, sf_dir):
    """Three batches, two of them folded into the snapshot of the earlier backlog, one of these folded twice."""
    documents = A.table(spark, sf_dir, "documents")
    arriving = documents.selectExpr(*[f"{e} AS {n}" for n, e in A.CORPUS.items()], f"{A.ROUND} AS round")
    snapshot = scratch_path(spark, "snapshot")
    snapshots.create_snapshot(_prior(spark, sf_dir), snapshot, buckets=8)

    def start(stream, out, checkpoint, k):
        files = tasks.eligible(stream, P.SCAN_EXTENSIONS, default_config().path_filter())
        if k == 1:
            snapshots.fold(spark, snapshot, out)
        return jobs.sighting_stream(build_proposals(files, A.LATER, A.SCAN_ID), out, checkpoint)

    out = _in_rounds(spark, arriving, start)
    for _ in range(2):
        snapshots.fold(spark, snapshot, out, up_to=2)
    return _flat(snapshots.current_backlog(spark, snapshot, out))


@query
def stream_hypotheses(spark, sf_dir):
    """Three batches of file versions: edits beside and after the first version, late old ones; a compaction between."""
    documents = A.table(spark, sf_dir, "documents")
    parts = [
        documents.filter(where).selectExpr(*[f"{e} AS {n}" for n, e in adapter.items()], f"CAST({time} AS BIGINT) AS modified", f"{arrives} AS round")
        for adapter, where, arrives, time in A.VERSIONS
    ]
    start = lambda stream, out, checkpoint, _: jobs.hypothesis_stream(stream, out, checkpoint, A.AS_OF, compact_every=2)
    return _flat_hypotheses(jobs.latest_hypotheses(spark, _in_rounds(spark, reduce(DataFrame.unionByName, parts), start)))


@query
def stream_transitions(spark, sf_dir):
    """Requests in the order of their time, a third of the time to a batch; all states are stored once between."""
    states, log = _transition_inputs(spark, sf_dir)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = log.agg(F.coalesce(F.min(micros), F.lit(0)), F.coalesce(F.max(micros), F.lit(0))).first()
    at = F.floor(A.ROUNDS * (micros - first) / (last - first + 1)).cast("int")
    start = lambda stream, out, checkpoint, _: jobs.transition_stream(stream, states, out, checkpoint, compact_every=2)
    return _flat_outcomes(jobs.read_batches(spark, _in_rounds(spark, log.withColumn("round", at), start)))


@query
def stream_transitions_late(spark, sf_dir):
    """The same requests out of order, each up to a tenth of the time late; they are judged in order all the same."""
    states, log = _transition_inputs(spark, sf_dir)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = log.agg(F.coalesce(F.min(micros), F.lit(0)), F.coalesce(F.max(micros), F.lit(0))).first()
    most = (last - first) // 10 + 1
    comes = micros - first + F.pmod(F.xxhash64("id", "ts", "seq", "new_state"), F.lit(most))
    at = F.floor(A.ROUNDS * comes / (last - first + most)).cast("int")
    delay = F.expr(f"make_dt_interval(0, 0, 0, {most} / 1000000)")
    start = lambda stream, out, checkpoint, _: jobs.transition_stream(stream, states, out, checkpoint, compact_every=2, delay=delay)
    out = _in_rounds(spark, log.withColumn("round", at), start)
    return _flat_outcomes(jobs.outcomes(spark, log.schema, states, out, delay, compact_every=2))


@query
def stream_filter_reload(spark, sf_dir):
    """Three batches; the filter is another one for each."""
    paths = A.table(spark, sf_dir, "documents").selectExpr(f"{A.CORPUS['root']} AS root", f"{A.FILE_PATH} AS file_path", f"{A.ROUND} AS round")
    filters = [default_config().path_filter(), P.PathFilter(exclude=A.EXCLUDE), P.PathFilter()]
    now = {}

    def start(stream, out, checkpoint, k):
        now["filter"] = filters[k]
        return jobs.filtered_stream(stream, lambda: now["filter"], out, checkpoint)

    return jobs.read_batches(spark, _in_rounds(spark, paths, start)).select("root", "file_path")


def _write_files(root: str, rows: DataFrame) -> None:
    """Put ``rows(name, content)`` below a folder, a null content deletes; the files are written by tasks."""

    def put(batches):
        for batch in batches:
            # one file at a time: contents are not copied for the whole batch
            for name, content in zip(batch.column(0), batch.column(1)):
                path, data = f"{root}/{name}", content.as_buffer()
                if data is None:
                    os.remove(path)
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as handle:
                    handle.write(data)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.mapInArrow(put, "n BIGINT").agg(F.sum("n")).collect()


@query
def stream_tree(spark, sf_dir):
    """A tree on disk over three listings: new, edited and deleted files, names that Spark's file source hides."""
    base = re.sub("^file:/+", "/", scratch_path(spark, "files"))
    root, state = f"{base}/tree", f"{base}/state"
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    documents = A.table(spark, sf_dir, "documents")
    start = lambda stream: jobs._start(jobs._per_batch(stream, lambda batch, _: batch, out), checkpoint, None)
    for changes in A.TREE_ROUNDS:
        for where, content in changes:
            _write_files(root, documents.filter(where).selectExpr(f"{A.TREE_NAME} AS name", f"{content} AS content").repartition(8))
        changes_of.follow_tree(spark, root, state, start)
    return jobs.read_batches(spark, out).select(
        F.col("batch_id").cast("int").alias("batch"), F.substring("file_path", len(os.path.realpath(root)) + 2, 1 << 20).alias("name"),
        F.md5("content").alias("digest"), "deleted", "error",
    )


@query
def stream_checkpoint(spark, sf_dir):
    path = scratch_path(spark, "results")
    _results(spark, sf_dir).write.parquet(path)
    results = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return _read_log(spark, _run(spark, lambda o, c: jobs.checkpoint_stream(results, o, c)))


@query
def stream_trace(spark, sf_dir):
    corpus = _corpus_stream(spark, sf_dir)
    out = _run(spark, lambda o, c: jobs.trace_stream(corpus, o, c, A.AS_OF, A.SCAN_ID))
    return _flat_events(spark.read.schema(trace.EVENT_SCHEMA).json(out))


# blueprint names for the operators above
for _name, _made in (
    ("read_text", "read_text_files"),
    ("static_findings", "static_analyzer_findings"),
    ("merge_analyzers", "merge_results"),
    ("redact", "redact_messages"),
    ("analyze_batch", "analyze_tasks"),
):
    QUERIES[_name] = QUERIES.pop(_made)
