"""User-supplied Python: rules and analyzers, run on Arrow batches inside tasks."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from sparkwarden.functions.json_text import BRACE_BLOCK
from sparkwarden.operators.responses import DIRECT, NOISY

HIT_SCHEMA = (
    "file_path STRING, rule_id STRING, line_number INT, code_snippet STRING, context STRING, "
    "severity STRING, confidence DOUBLE, error STRING"
)
HIT_ARROW = pa.schema(
    [("file_path", pa.string()), ("rule_id", pa.string()), ("line_number", pa.int32()), ("code_snippet", pa.string()),
     ("context", pa.string()), ("severity", pa.string()), ("confidence", pa.float64()), ("error", pa.string())]
)
ANSWER_SCHEMA = (
    "run_id STRING, file_path STRING, analysis_type STRING, call_ok BOOLEAN, timed_out BOOLEAN, "
    "raw STRING, error STRING, completed_at TIMESTAMP, execution_time DOUBLE"
)
ANSWER_ARROW = pa.schema(
    [("run_id", pa.string()), ("file_path", pa.string()), ("analysis_type", pa.string()), ("call_ok", pa.bool_()),
     ("timed_out", pa.bool_()), ("raw", pa.string()), ("error", pa.string()),
     ("completed_at", pa.timestamp("us", "UTC")), ("execution_time", pa.float64())]
)
ROWS_PER_BATCH = 2_000

Detector = Callable[[str, str], Iterable[dict]]
Analyzer = Callable[[str, str], str]


def batches_of(rows: Iterable[dict], schema: pa.Schema, size: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded length from a stream of rows."""
    pending: list[dict] = []
    for row in rows:
        pending.append(row)
        if len(pending) >= size:
            yield pa.RecordBatch.from_pylist(pending, schema=schema)
            pending = []
    yield pa.RecordBatch.from_pylist(pending, schema=schema)


def python_rule(corpus: DataFrame, rule_id: str, detect: Detector, severity: str = "medium",
                confidence: float = 0.8) -> DataFrame:
    """Run ``detect(file_path, content)`` on every file.

    It yields dicts with line_number, code_snippet and context (severity and confidence optional). A
    file on which it raises leaves one row with ``error`` set, none of its hits, and does not stop the
    other files.
    """
    hits = _hits_of(rule_id, detect, severity, confidence)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from hits(batch.column(0), batch.column(1))

    return corpus.select("file_path", "content").mapInArrow(
        lambda batches: batches_of(matched(batches), HIT_ARROW), HIT_SCHEMA
    )


def register_rule(spark: SparkSession, name: str, rule_id: str, detect: Detector, severity: str = "medium",
                  confidence: float = 0.8) -> UserDefinedTableFunction:
    """Make a rule callable from SQL: ``SELECT * FROM name(TABLE(corpus))``, rows as :func:`python_rule` gives them.

    The table needs the columns ``file_path`` and ``content``; others are ignored. It is read where its partitions are, without a
    shuffle, in Arrow batches. A file on which the rule fails, one without content included if the rule does not expect it, leaves one
    row with ``error``; an empty table gives none. Files given twice are matched twice.
    """
    hits = _hits_of(rule_id, detect, severity, confidence)

    class MatchRule:
        def eval(self, files: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield from batches_of(hits(files.column("file_path"), files.column("content")), HIT_ARROW)

    return spark.udtf.register(name, F.arrow_udtf(MatchRule, returnType=HIT_SCHEMA))


def _hits_of(rule_id: str, detect: Detector, severity: str, confidence: float) -> Callable[[pa.Array, pa.Array], Iterator[dict]]:
    grades = {"rule_id": rule_id, "severity": severity, "confidence": confidence}

    def hits(paths: pa.Array, contents: pa.Array) -> Iterator[dict]:
        for path, content in zip(paths, contents):
            path = path.as_py()
            try:
                yield from [{"file_path": path, **grades, **hit} for hit in detect(path, content.as_py())]
            except Exception as exc:
                yield {"file_path": path, "rule_id": rule_id, "error": str(exc)}

    return hits


def _json(text: str):
    """The value of a strict JSON text; None for JSON null and for anything else."""
    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


def has_usable_json(mode: str, raw: str) -> bool:
    """Whether an answer needs no further attempt, read as ``parse_direct`` and ``parse_noisy`` do."""
    if mode == DIRECT:
        inner = re.search(r"\{.*\}", raw, re.DOTALL)
        return _json(raw) is not None or (inner is not None and _json(inner.group()) is not None)
    if mode == NOISY:
        values = (_json(text) for text in [*(m.group() for m in re.finditer(BRACE_BLOCK, raw)), raw.strip()])
        return bool(next((v for v in values if isinstance(v, dict)), None))
    return True


def analyze_batch(tasks: DataFrame, analyzer_id: str, analyzer_ord: int, mode: str, call: Analyzer,
                  parallel_calls: int | None = None, attempts: int = 1, pause: float = 0.0) -> DataFrame:
    """Call ``call(system_prompt, user_prompt)`` for every task that has prompts; raw answers out.

    A noisy analyzer gets the full prompt as its user prompt and an empty system prompt. A call that
    raises and an answer without usable JSON are failed attempts and may be repeated up to ``attempts``
    times, ``pause`` seconds apart, one row each; in noisy mode a timeout is not repeated.
    ``parallel_calls`` bounds the calls in flight for an external service by running in that many partitions.
    """
    prompts = (F.lit(""), F.col("prompt_full")) if mode == NOISY else (F.col("prompt_system"), F.col("prompt_user"))
    ready = tasks.filter(F.col("error").isNull()).select("run_id", "file_path", "analysis_type", *prompts)
    if parallel_calls:
        ready = ready.repartition(parallel_calls)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for values in zip(*batch.columns):
                run_id, path, kind, system, user = (v.as_py() for v in values)
                for attempt in range(1, attempts + 1):
                    row = {"run_id": run_id, "file_path": path, "analysis_type": kind, "attempt": attempt,
                           "call_ok": True, "timed_out": False}
                    began, done = time.monotonic(), False
                    try:
                        row["raw"] = call(system, user)
                        done = has_usable_json(mode, row["raw"] or "")
                    except Exception as exc:
                        row |= {"call_ok": False, "timed_out": isinstance(exc, TimeoutError), "error": str(exc)}
                        done = mode == NOISY and row["timed_out"]
                    yield row | {"completed_at": datetime.now(UTC), "execution_time": time.monotonic() - began}
                    if done:
                        break
                    if attempt < attempts:
                        time.sleep(pause)

    schema = ANSWER_ARROW.append(pa.field("attempt", pa.int32()))
    made = ready.mapInArrow(
        lambda batches: batches_of(answers(batches), schema, size=50), f"{ANSWER_SCHEMA}, attempt INT"
    )
    return made.select(
        "run_id", "file_path", "analysis_type",
        F.lit(analyzer_id).alias("analyzer_id"),
        F.lit(analyzer_ord).alias("analyzer_ord"),
        F.lit(mode).alias("mode"),
        "attempt", "call_ok", "timed_out", "raw", "error", "completed_at", "execution_time",
    )
