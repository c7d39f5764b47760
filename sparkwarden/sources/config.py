"""The audit configuration: one small JSON document, its dimensions and defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.functions.paths import PathFilter
from sparkwarden.operators.responses import ANALYZER_MODES
from sparkwarden.operators.rules import Rule, configured_rules
from sparkwarden.operators.tasks import TYPE_SCHEMA

# The refusal without analyzers, and repeated attempts unless configured.
NO_ANALYZERS = (
    "No audit analyzers are available. "
    "Configure an enabled backend or install its runtime dependency."
)
MAX_RETRIES = 2

# Default platforms, linters and excluded paths. Prompt templates are configuration too;
# bring your own by loading a configuration file of the same layout.
_KEYS = "Answer only with JSON: an object with {key}, a list of objects with severity, {kind}, description, line_number, code_snippet and recommendation, and {score} from 0 to 100."


def _type(name: str, task: str, key: str, kind: str, score: str) -> dict:
    return {
        "name": name,
        "scope": ["file"],
        "prompt_template": f"{task} {{file_path}}. {{context}}" + _KEYS.format(key=key, kind=kind, score=score),
    }


DEFAULT_CONFIG: dict[str, Any] = {
    "platforms": {
        "python": {
            "name": "Python Backend",
            "file_extensions": [".py"],
            "linters": {
                "pylint": {"enabled": True, "command": "pylint", "args": ["--errors-only"]},
                "flake8": {
                    "enabled": True,
                    "command": "flake8",
                    "args": ["--max-line-length=120", "--ignore=E501,W503"],
                },
            },
            "analysis_types": {
                "deep_scan": _type("Deep Security & Logic Scan", "Audit security, logic and performance of", "findings", "category", "overall_score"),
                "security_scan": _type("Security Vulnerability Scan", "Look for vulnerabilities in", "vulnerabilities", "type", "security_score"),
                "code_quality": _type("Code Quality Analysis", "Judge structure and readability of", "issues", "category", "quality_score"),
                "performance": _type("Performance Analysis", "Look for slow or wasteful code in", "performance_issues", "type", "performance_score"),
            },
        },
        "php": {
            "name": "PHP Backend",
            "file_extensions": [".php"],
            "linters": {
                "phpcs": {"enabled": True, "command": "phpcs", "args": ["--standard=PSR12", "--report=json"]},
                "phpstan": {
                    "enabled": True,
                    "command": "phpstan",
                    "args": ["analyse", "--error-format=json", "--level=5"],
                },
            },
            "analysis_types": {
                "deep_scan": _type("Deep Security & Logic Scan", "Audit security, logic and performance of", "findings", "category", "overall_score"),
                "security_scan": _type("Security Vulnerability Scan", "Look for vulnerabilities in", "vulnerabilities", "type", "security_score"),
            },
        },
    },
    "models": [],
    "file_filtering": {
        "include_patterns": [],
        "exclude_patterns": [
            "node_modules", "__pycache__", ".venv", "venv", ".git", "dist", "build", "*.egg-info",
            ".pytest_cache", ".mypy_cache", "logs/old_logs", "test_results*", "audit_reports",
            ".ag-venv", ".cursor", ".claude",
        ],
        "default_behavior": "include_all",
    },
    "proposal_engine": {"detectors": {}},
    "analyzers": {"llm": {"enabled": True, "max_retries": 2}, "static": {"enabled": False}},
}


def best_practices(spark: SparkSession, *paths: str) -> str:
    """The text of the first document that can be read, in the given order; none: empty."""
    for path in paths:
        try:
            found = spark.read.text(path, wholetext=True).first()
        except AnalysisException:
            continue
        if found is not None:
            return found[0]
    return ""


@dataclass(frozen=True)
class Platform:
    key: str
    name: str
    extensions: tuple[str, ...]
    linters: dict[str, dict] = field(default_factory=dict)
    analysis_types: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class AuditConfig:
    """Lookups over the configuration document. It is small, so it lives on the driver."""

    data: dict[str, Any]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AuditConfig:
        """Read one JSON document from any file system Spark can reach."""
        text = spark.read.text(path, wholetext=True).first()
        if text is None:
            raise FileNotFoundError(path)
        return cls(json.loads(text[0]))

    def model(self, model_id: str) -> dict | None:
        return next((m for m in self.data.get("models", []) if m["id"] == model_id), None)

    def platform(self, key: str) -> Platform | None:
        found = self.data.get("platforms", {}).get(key)
        if not found:
            return None
        return Platform(
            key, found["name"], tuple(found["file_extensions"]),
            found.get("linters", {}), found.get("analysis_types", {}),
        )

    def path_filter(self) -> PathFilter:
        return PathFilter.from_config(self.data.get("file_filtering"))

    def rules(self) -> list[Rule]:
        return configured_rules(self.data.get("proposal_engine", {}).get("detectors"))

    def analyzers(self, available: set[str], static_fallback: bool = False) -> list[tuple[str, str]]:
        """(analyzer id, mode) of the enabled and available backends in configured order.

        Without any configured, the top-level ``aider`` section stands for them unless it is disabled.
        Entries that are no objects or name an unknown backend are skipped. With none left either the
        static analyzer steps in or the audit is refused.
        """
        chosen = [
            (name, ANALYZER_MODES[name])
            for name, options in self._analyzer_options().items()
            if isinstance(options, dict)
            and options.get("enabled", True)
            and name in ANALYZER_MODES
            and (name in available or name == "static")
        ]
        if not chosen and static_fallback:
            chosen = [("static", ANALYZER_MODES["static"])]
        if not chosen:
            raise RuntimeError(NO_ANALYZERS)
        return chosen

    def _analyzer_options(self) -> dict:
        configured, aider = self.data.get("analyzers"), self.data.get("aider", {})
        return configured or ({"aider": aider} if aider.get("enabled", True) else {})

    def max_retries(self, analyzer: str) -> int:
        return int((self._analyzer_options().get(analyzer) or {}).get("max_retries", MAX_RETRIES))

    def enabled_linters(self, platform: str) -> list[str]:
        found = self.platform(platform)
        return [n for n, o in found.linters.items() if o.get("enabled")] if found else []

    def type_dimension(self, spark: SparkSession, platform: str | None = None) -> DataFrame:
        """Analysis types of one or all platforms; as many rows as the document lists."""
        rows = [
            (key, name, options["name"], options["prompt_template"])
            for key, p in self.data.get("platforms", {}).items()
            if platform in (None, key)
            for name, options in p.get("analysis_types", {}).items()
        ]
        return spark.createDataFrame(rows, TYPE_SCHEMA)

    def extension_dimension(self, spark: SparkSession) -> DataFrame:
        rows = [
            (key, p["name"], ext)
            for key, p in self.data.get("platforms", {}).items()
            for ext in p.get("file_extensions", [])
        ]
        return spark.createDataFrame(rows, "platform STRING, platform_name STRING, extension STRING")


def default_config() -> AuditConfig:
    return AuditConfig(DEFAULT_CONFIG)
