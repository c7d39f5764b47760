"""Line rules: the built-in set, per-rule overrides, and matching as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.text import raw_lines, split_lines, strip, template

QUOTES = ('"', "'")


@dataclass(frozen=True)
class Rule:
    """A regex rule over single lines.

    ``patterns`` are tried in order and every match counts, unless ``once_per_line``. ``guard`` must
    also occur in the line. Lines whose stripped text starts with one of ``skip_prefixes`` are left
    out. ``needles`` are cheap to test before any pattern: of each group of strings, a line with a hit
    holds at least one.
    Templates may use {match}, {value}, {variable}, {file_path} and {line_number}.
    """

    rule_id: str
    patterns: tuple[str, ...]
    title: str
    description: str
    recommendation: str
    context: str
    severity: str = "medium"
    priority: str = "p2"
    risk_level: str = "medium"
    confidence: float = 0.8
    autofixable: bool = False
    guard: str | None = None
    once_per_line: bool = False
    value_group: int = 0
    skip_prefixes: tuple[str, ...] = ()
    snippet_length: int | None = None
    needles: tuple[tuple[str, ...], ...] = ()
    enabled: bool = True


# What the four built-in rules look for.
# (?iuU) gives Java the Unicode-aware ignore-case matching these patterns are written for.
MODEL_LITERAL = (
    r'(?iuU)"(gpt-4[^"]*|gpt-3\.5[^"]*|gpt-4o[^"]*|o[13]-[^"]*|claude-[23]-[^"]*|claude-3[^"]*'
    r'|meta-llama/[^"]*|Llama-[^"]*|Qwen/[^"]*|Qwen[23]-[^"]*|mistral[^"]*|gemini-[^"]*'
    r'|palm-[^"]*|deepseek[^"]*|phi-[^"]*|mixtral[^"]*)"'
)
LOCAL_URL = (
    r"""(?iuU)['"](https?://(?:localhost|(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}"""
    r"""(?:25[0-5]|2[0-4]\d|[01]?\d\d?))[^'"]*?)['"]"""
)
REMOTE_API = r"""(?iuU)['"](https?://api\.[a-z0-9\-]+\.[a-z]{2,}/v\d[^'"]*?)['"]"""
PROMPT_KEYWORD = r"(?iuU)\b(?:system_prompt|user_prompt|prompt_template|PROMPT|instruction)\b"
# A family name somewhere between the first quote of the line and a later one; starting at the
# first quote only keeps long lines linear.
QUOTED_FAMILY = r"""(?iuU)\A[^'"]*+['"].*?(?:gpt-4|gpt-3\.5|claude|llama|qwen|mistral|gemini|palm).*?['"]"""
IDENTIFIER_LITERAL = (
    r"""(?iuU)\b(?:project_id|project_name|org_id|organization_id|tenant_id|workspace_id"""
    r"""|client_id)\s*=\s*(?:f?['"])([^'"]{3,})['"]"""
)

# The grades and texts of the four built-in rules.
BUILTIN_RULES: tuple[Rule, ...] = (
    Rule(
        rule_id="hardcoded_model_names",
        patterns=(MODEL_LITERAL,),
        severity="high",
        priority="p1",
        risk_level="medium",
        confidence=0.85,
        title="Hardcoded model name {match} in {file_path}",
        description=(
            "The model name {match} is hardcoded at line {line_number}. Model names should be read "
            "from the configuration so they can be swapped without code changes."
        ),
        recommendation=(
            "Move the model name to the configuration file (e.g., audit_config.json) and reference "
            "it via the model/provider abstraction already present in ConfigManager."
        ),
        context="Found hardcoded model name: {match}",
        needles=(('"',),),
    ),
    Rule(
        rule_id="hardcoded_constants",
        patterns=(LOCAL_URL, REMOTE_API),
        severity="medium",
        priority="p2",
        risk_level="low",
        confidence=0.75,
        value_group=1,
        skip_prefixes=("#", "//"),
        title="Hardcoded URL/endpoint at {file_path}:{line_number}",
        description=(
            "The value '{value}' at line {line_number} appears to be a hardcoded URL or API "
            "endpoint. Such values should be externalised to configuration so they can be changed "
            "without code modifications."
        ),
        recommendation=(
            "Move this value to the configuration file and reference it via the existing "
            "ConfigManager. Consider adding an 'endpoints' section to audit_config.json."
        ),
        context="Found hardcoded URL/endpoint: {value}",
        needles=(QUOTES, ("://",)),
    ),
    Rule(
        rule_id="non_agnostic_prompts",
        patterns=(QUOTED_FAMILY,),
        guard=PROMPT_KEYWORD,
        severity="high",
        priority="p1",
        risk_level="medium",
        confidence=0.70,
        once_per_line=True,
        skip_prefixes=("#",),
        snippet_length=200,
        title="Non-model-agnostic prompt at {file_path}:{line_number}",
        description=(
            "Line {line_number} contains a prompt that references a specific model name. Prompts "
            "should be model-agnostic so they work across different providers."
        ),
        recommendation=(
            "Remove model-specific references from prompt templates. Use generic instructions that "
            "work across providers."
        ),
        context="Prompt variable contains a model-specific reference",
        needles=(QUOTES,),
    ),
    Rule(
        rule_id="leaked_project_ids",
        patterns=(IDENTIFIER_LITERAL,),
        severity="critical",
        priority="p0",
        risk_level="high",
        confidence=0.90,
        value_group=1,
        skip_prefixes=("#", "//"),
        snippet_length=200,
        title="Hardcoded identifier '{variable}' at {file_path}:{line_number}",
        description=(
            "The variable '{variable}' is assigned a literal value '{value}' at line {line_number}. "
            "Identifiers such as project_id, org_id, or tenant_id must not be hardcoded because they "
            "could inadvertently leak into LLM prompts or API calls."
        ),
        recommendation=(
            "Read this identifier from an environment variable or a dedicated secrets configuration. "
            "Never commit literal org/project IDs to source code."
        ),
        context="Variable '{variable}' assigned literal value '{value}'",
        needles=(QUOTES, ("=",), ("_",)),
    ),
)

OVERRIDABLE = ("severity", "priority", "risk_level", "confidence")

def configured_rules(
    overrides: Mapping[str, Mapping] | None = None, rules: Iterable[Rule] = BUILTIN_RULES
) -> list[Rule]:
    """Enabled rules in registry order, with graded fields replaced where the configuration does."""
    overrides = overrides or {}
    chosen = []
    for rule in rules:
        given = overrides.get(rule.rule_id) or {}
        if given.get("enabled", rule.enabled):
            changes = {k: given[k] for k in OVERRIDABLE if k in given}
            if "confidence" in changes:
                changes["confidence"] = float(changes["confidence"])
            chosen.append(replace(rule, **changes))
    return chosen


def _any(tests: Iterable[Column], default: bool) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(default)


def _needle_test(rule: Rule, text: Column) -> Column:
    groups = [_any((text.contains(n) for n in group), True) for group in rule.needles]
    return reduce(lambda a, b: a & b, groups, F.lit(True))


def _rule_test(rule: Rule, text: Column) -> Column:
    found = _any((text.rlike(p) for p in rule.patterns), False)
    found = text.rlike(rule.guard) & found if rule.guard else found
    return _needle_test(rule, text) & found


def numbered_lines(corpus: DataFrame) -> DataFrame:
    """``(file_path, line_number, line)`` with Python's line boundaries, counted from 1."""
    text = corpus.filter(F.col("content") != "")
    return text.select("file_path", F.posexplode(split_lines(F.col("content")))).select(
        "file_path", (F.col("pos") + 1).alias("line_number"), F.col("col").alias("line")
    )


def match_rules(corpus: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """All rule hits of a corpus ``(file_path, content)``; one narrow stage, nothing is shuffled.

    Files that no rule can hit are dropped before being split, lines likewise before extraction.
    Output: file_path, line_number, line, rule_id, rule_ord, pattern_ord, match_no, match, value.
    """
    rules = list(rules)
    possible = _any((_needle_test(r, F.col("content")) for r in rules), False)
    files = corpus.select("file_path", "content").filter(possible)
    # a last empty line cannot match, so the plain cut will do
    lines = files.select("file_path", F.posexplode(raw_lines(F.col("content"))).alias("at", "line")).select(
        "file_path", (F.col("at") + 1).alias("line_number"), "line"
    )
    lines = lines.filter(_any((_rule_test(r, F.col("line")) for r in rules), False))
    lines = lines.withColumn("stripped", strip(F.col("line")))

    line, tries = F.col("line"), []
    for rule_ord, rule in enumerate(rules):
        allowed = ~_any((F.col("stripped").startswith(p) for p in rule.skip_prefixes), False)
        if rule.once_per_line:
            # the whole line stands for its match; the tests decide whether there is one
            pairs = [(0, F.array(F.lit("")), F.array(F.lit("")))]
            allowed = allowed & _rule_test(rule, line)
        else:
            if rule.guard:
                allowed = allowed & line.rlike(rule.guard)
            pairs = [
                (
                    i,
                    F.regexp_extract_all(line, F.lit(p), F.lit(0)),
                    F.regexp_extract_all(line, F.lit(p), F.lit(rule.value_group)),
                )
                for i, p in enumerate(rule.patterns)
            ]
        for pattern_ord, matches, values in pairs:
            tries.append(
                F.struct(
                    F.lit(rule.rule_id).alias("rule_id"),
                    F.lit(rule_ord).alias("rule_ord"),
                    F.lit(pattern_ord).alias("pattern_ord"),
                    F.when(allowed, F.arrays_zip(matches.alias("match"), values.alias("value"))).alias(
                        "found"
                    ),
                )
            )
    if not tries:
        tries = [
            F.from_json(
                F.lit("{}"),
                "rule_id STRING, rule_ord INT, pattern_ord INT, "
                "found ARRAY<STRUCT<match: STRING, value: STRING>>",
            )
        ]
    return (
        lines.select("file_path", "line_number", "line", "stripped", F.explode(F.array(*tries)).alias("t"))
        .select(
            "file_path", "line_number", "line", "stripped", "t.rule_id", "t.rule_ord", "t.pattern_ord",
            F.posexplode("t.found").alias("match_no", "hit"),
        )
        .select("*", "hit.match", "hit.value")
        .drop("hit")
    )


def _per_rule(rules: list[Rule], make) -> Column:
    chain = None
    for rule in rules:
        test = F.col("rule_id") == rule.rule_id
        chain = F.when(test, make(rule)) if chain is None else chain.when(test, make(rule))
    return chain if chain is not None else F.lit(None)


def describe_hits(hits: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add the grades and texts of their rule to hits. The few rules are literals, so nothing is joined."""
    rules = list(rules)
    names = {
        "match": F.col("match"),
        "value": F.col("value"),
        "variable": strip(F.split_part(F.col("match"), F.lit("="), F.lit(1))),
        "file_path": F.col("file_path"),
        "line_number": F.col("line_number"),
    }

    def snippet(rule: Rule) -> Column:
        text = F.col("stripped")
        return F.substring(text, 1, rule.snippet_length) if rule.snippet_length else text

    return hits.select(
        "*",
        _per_rule(rules, snippet).alias("code_snippet"),
        *[
            _per_rule(rules, lambda r, f=f: template(getattr(r, f), **names)).alias(f)
            for f in ("context", "title", "description", "recommendation")
        ],
        *[_per_rule(rules, lambda r, f=f: F.lit(getattr(r, f))).alias(f) for f in (*OVERRIDABLE, "autofixable")],
    )
