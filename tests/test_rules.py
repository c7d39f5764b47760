import re

import pytest

from sparkwarden.operators.proposals import build_proposals, signals_of, static_findings
from sparkwarden.operators.rules import BUILTIN_RULES, Rule, configured_rules, match_rules

AS_OF = "2024-01-01 00:00:00"


def found(corpus, text, rule=None, **options):
    rows = build_proposals(corpus({"a.py": text}), AS_OF, "s", **options).orderBy("ord").collect()
    return [r for r in rows if rule in (None, r.type)]


@pytest.mark.parametrize(
    "text, rule, count",
    [
        ('writer = pick("claude-3-haiku", 3)', "hardcoded_model_names", 1),
        ("opts['engine'] = \"mistralai/Mixtral-8x7B\"", "hardcoded_model_names", 1),
        ('  # was "gpt-3.5" once', "hardcoded_model_names", 1),
        ("x = 'gpt-4'", "hardcoded_model_names", 0),
        ('engine = settings.get("engine", fallback)', "hardcoded_model_names", 0),
        ('a = "GPT-4o", "miſtral-7b", "o1-mini"', "hardcoded_model_names", 3),
        ('HEALTH = "http://localhost:9417/ping"', "hardcoded_constants", 1),
        ('post("https://api.weather.example/v3", body)', "hardcoded_constants", 1),
        ('x = "http://localhostfoo"', "hardcoded_constants", 1),
        ("x = 'http://256.1.1.1'", "hardcoded_constants", 0),
        ("x = 'http://10.0.0.1/a\"", "hardcoded_constants", 1),
        ('  # x = "http://localhost"', "hardcoded_constants", 0),
        ('  // x = "http://localhost"', "hardcoded_constants", 0),
        ("total += price * amount", "hardcoded_constants", 0),
        ('run(project_id = "billing-7")', "leaked_project_ids", 1),
        ("org_id = 'northwind-east'", "leaked_project_ids", 1),
        ('tenant_id\xa0=\xa0f"abc"', "leaked_project_ids", 1),
        ('org_id = "ab"', "leaked_project_ids", 0),
        ('    # tenant_id = "blue-42"', "leaked_project_ids", 0),
        ("project_id = vault.read(slot)", "leaked_project_ids", 0),
        ('system_prompt = "Answer as mistral would"', "non_agnostic_prompts", 1),
        ('// prompt = "for claude"', "non_agnostic_prompts", 1),
        ('# prompt = "for claude"', "non_agnostic_prompts", 0),
        ('my_prompt = "for claude"', "non_agnostic_prompts", 0),
        ('prompts = "for claude"', "non_agnostic_prompts", 0),
        ('summary = "tested with claude and others"', "non_agnostic_prompts", 0),
        ('prompt = claude + "x"', "non_agnostic_prompts", 0),
        ('prompt = "x" + claude', "non_agnostic_prompts", 0),
    ],
)
def test_rule_hits(corpus, text, rule, count):
    assert len(found(corpus, f"\n{text}\n", rule)) == count


def test_hit_details_and_order(corpus):
    text = 'x\r\n  project_id = "p-1"; org_id = "o-1"  \x0bu = "https://api.a-b.io/v1" + "http://127.0.0.1/x"'
    rows = found(corpus, text)
    evidence = [r.evidence[0] for r in rows]
    assert [(e.line_number, e.context) for e in evidence] == [
        (3, "Found hardcoded URL/endpoint: http://127.0.0.1/x"),
        (3, "Found hardcoded URL/endpoint: https://api.a-b.io/v1"),
        (2, "Variable 'project_id' assigned literal value 'p-1'"),
        (2, "Variable 'org_id' assigned literal value 'o-1'"),
    ]
    assert evidence[2].code_snippet == 'project_id = "p-1"; org_id = "o-1"'
    assert rows[0].id == rows[1].id and rows[0].id != rows[2].id
    assert (rows[2].severity, rows[2].priority, rows[2].risk_level, rows[2].confidence) == ("critical", "p0", "high", 0.9)
    assert rows[2].state == "detected" and rows[2].scan_id == "s" and not rows[2].autofixable


def test_snippets(corpus):
    pad = "y" * 300
    by_rule = {r.type: r.evidence[0].code_snippet for r in found(corpus, f'project_id = "abc" {pad}') + found(corpus, f'm = "gpt-4" {pad}')}
    assert len(by_rule["leaked_project_ids"]) == 200
    assert len(by_rule["hardcoded_model_names"]) > 300


def test_overrides(corpus):
    assert [r.rule_id for r in configured_rules()] == [r.rule_id for r in BUILTIN_RULES]
    rules = configured_rules({"leaked_project_ids": {"severity": "low", "confidence": "0.1"}, "hardcoded_constants": {"enabled": False}})
    assert len(rules) == 3
    row = found(corpus, 'org_id = "acme"; u = "http://localhost"', rules=rules)
    assert [(r.severity, r.priority, r.confidence) for r in row] == [("low", "p0", 0.1)]
    assert found(corpus, 'org_id = "acme"', rules=[]) == []


def test_user_rule_with_line_anchors(corpus):
    rule = Rule("todo", (r"^TODO(.*)$",), "{match}", "", "", "{value}", value_group=1)
    rows = match_rules(corpus({"a.py": "x\nTODO one\n TODO two\nTODO three"}), [rule]).collect()
    assert sorted((r.line_number, r.value) for r in rows) == [(2, " one"), (4, " three")]


def test_long_line_stays_linear(corpus):
    line = "prompt = " + "'x' " * 60_000
    assert found(corpus, line) == []


def test_hits_equal_python_on_random_lines(corpus):
    import random

    draw = random.Random(5)
    bits = ['"', "'", "gpt-4", "claude-3", "https://api.", "http://localhost", "x.io", "/v1", "project_id", " = ", "prompt", "#", "//", " ", "a", "llama"]
    lines = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 16))) for _ in range(2500)]
    url = re.compile(r"""['"](https?://(?:localhost|(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?))[^'"]*?)['"]""", re.I)
    family = re.compile(r"""f?['"].*?(?:gpt-4|gpt-3\.5|claude|llama|qwen|mistral|gemini|palm).*?['"]""", re.I)
    keyword = re.compile(r"\b(?:system_prompt|user_prompt|prompt_template|PROMPT|instruction)\b", re.I)
    want = set()
    for number, line in enumerate(lines, 1):
        stripped = line.strip()
        if not stripped.startswith(("#", "//")):
            want |= {(number, "hardcoded_constants", m[1]) for m in url.finditer(line)}
        if not stripped.startswith("#") and keyword.search(line) and family.search(line):
            want.add((number, "non_agnostic_prompts", ""))
    rows = match_rules(corpus({"a.py": "\n".join(lines)}), BUILTIN_RULES).collect()
    got = {(r.line_number, r.rule_id, r.value) for r in rows if r.rule_id == "non_agnostic_prompts" or (r.rule_id == "hardcoded_constants" and r.pattern_ord == 0)}
    assert got == want and len(want) > 20


def test_signals_and_static_findings(corpus):
    made = build_proposals(corpus({"a.py": 'm = "gpt-4"'}), AS_OF)
    signal = signals_of(made).first()
    assert (signal.rule_id, signal.line_number, signal.source_detector) == ("hardcoded_model_names", 1, "hardcoded_model_names")
    finding = static_findings(made).first()
    assert finding.rule_id == "hardcoded_model_names" and finding.evidence[0].file_path == "/srv/p/a.py"
