"""Report tables: metadata, result rows, finding views, checkpoints and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.text import slug
from sparkwarden.operators.skew import number_rows
from sparkwarden.session import cut_lineage

# Finding severities counted as critical, and display defaults.
CRITICAL_SEVERITIES = ("critical", "high")
DEFAULT_SEVERITY = "medium"
DEFAULT_CATEGORY = "General"
DEFAULT_DESCRIPTION = "No description"

CHECKPOINT_FIELDS = (
    "file_path", "analysis_type", "success", "findings", "score", "error", "execution_time",
)


def text_field(finding: Column, name: str) -> Column:
    """A field of a finding as text; absent fields and non-objects give NULL."""
    return F.try_variant_get(finding, f"$.{name}", "string")


def report_metadata(results: DataFrame, timestamp: Column) -> DataFrame:
    """Counts per run in one aggregate that combines before the shuffle."""
    critical = F.size(
        F.filter("findings", lambda f: F.coalesce(text_field(f, "severity").isin(*CRITICAL_SEVERITIES), F.lit(False)))
    )
    return results.groupBy("run_id").agg(
        F.max(timestamp).alias("timestamp"),
        F.countDistinct("file_path").alias("total_files"),
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if("success").alias("successful_analyses"),
        F.count_if(~F.col("success")).alias("failed_analyses"),
        F.sum(F.size("findings")).alias("total_findings"),
        F.sum(critical).alias("critical_findings"),
    )


def report_name(platform: Column, timestamp: Column) -> Column:
    return F.concat(
        F.lit("audit_"), slug(platform), F.lit("_"), F.date_format(timestamp, "yyyyMMdd_HHmmss"), F.lit(".json")
    )


def report_results(results: DataFrame) -> DataFrame:
    """Result rows of a report: no raw output, blank errors left out, the score as a JSON value."""
    return results.select(
        "run_id", "file_path", "analysis_type", "success", "execution_time", "findings", _score(),
        *(["linter_results"] if "linter_results" in results.columns else []),
        F.nullif(F.col("error"), F.lit("")).alias("error"),
    )


def checkpoint_rows(results: DataFrame) -> DataFrame:
    """The seven fields logged for every finished task; findings and score are JSON values, not quoted text."""
    return results.select(*[_score() if f == "score" else F.col(f) for f in CHECKPOINT_FIELDS])


def _score() -> Column:
    return F.try_parse_json("score").alias("score")


def findings_view(results: DataFrame) -> DataFrame:
    """One display row per finding; results without findings keep one row without a finding."""
    exploded = results.select(
        "run_id", "file_path", "analysis_type", F.posexplode_outer("findings").alias("position", "finding")
    )
    finding = F.col("finding")

    def shown(name: str) -> Column:
        # what a page treats as absent: no value, empty text, the number zero, false
        value = F.to_json(F.try_variant_get(finding, f"$.{name}", "variant"))
        return F.when(~value.rlike(r'\A(null|""|false|-?0+(\.0+)?)\z'), text_field(finding, name))

    present = finding.isNotNull()
    return exploded.select(
        "run_id", "file_path", "analysis_type", "position",
        F.when(present, F.upper(F.coalesce(shown("severity"), F.lit(DEFAULT_SEVERITY)))).alias("severity"),
        F.when(present, F.coalesce(shown("category"), shown("type"), F.lit(DEFAULT_CATEGORY))).alias("category"),
        F.when(present, F.coalesce(shown("description"), F.lit(DEFAULT_DESCRIPTION))).alias("description"),
        shown("line_number").alias("line_number"),
        shown("code_snippet").alias("code_snippet"),
        shown("recommendation").alias("recommendation"),
    )


def progress(results: DataFrame) -> DataFrame:
    """(done, total) per run in completion order."""
    rows = results.select("run_id", "completed_at", "file_path", "analysis_type")
    return number_rows(cut_lineage(rows), ["run_id"], ["completed_at", "file_path", "analysis_type"], "done", "total")
