"""The same results as plain SQL over the test tables, for checking."""

from __future__ import annotations

import string
from typing import NamedTuple

from sparkwarden.operators import tasks
from sparkwarden.queries import adapters as A
from sparkwarden.queries.registry import OVERRIDES, PRACTICES, REQUESTED_TYPES, USER_RULES
from sparkwarden.sources.config import DEFAULT_CONFIG

# Fixed values, written out here so that a change of the library shows up as a difference.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
PROPOSAL_NAMESPACE = "7ba4b810-9dad-11d1-80b4-00c04fd430c8"
FINDING_KEYS = ("findings", "vulnerabilities", "issues", "performance_issues")
SCORE_KEYS = ("overall_score", "security_score", "quality_score", "performance_score")
ABORT_MESSAGES = {
    "list": "list indices must be integers or slices, not str",
    "string": "string indices must be integers, not 'str'",
    "int": "argument of type 'int' is not iterable",
    "float": "argument of type 'float' is not iterable",
    "bool": "argument of type 'bool' is not iterable",
}
NO_JSON = "Nessun JSON valido nella risposta del modello"
FAILED = "Analysis failed"
DEFAULT_SEVERITY = "medium"
DEFAULT_CATEGORY = "General"
DEFAULT_DESCRIPTION = "No description"
EVENT_VALIDATION = "proposal.validation"
EVENT_ACTOR = "proposal_engine"
EVENT_VIOLATION = "proposal.violation"
EVENT_GENERATED = "proposal.generated"
EVENT_SCAN_START = "proposal.scan.start"
EVENT_SCAN_END = "proposal.scan.end"
LINT_STATUS_UNAVAILABLE = "non disponibile"
LINT_STATUS_OK = "ok"
LINT_STATUS_ISSUES = "warning/error"
LINT_NOT_FOUND = " not found in PATH"
LINT_TIMED_OUT = "Linter timed out after 60s"


class Grades(NamedTuple):
    """What the SQL knows of a rule."""

    rule_id: str
    severity: str
    priority: str
    risk_level: str
    confidence: float
    snippet_length: int | None
    title: str
    description: str
    recommendation: str
    context: str


# Grades and texts of the built-in rules.
RULES = (
    Grades(
        rule_id="hardcoded_model_names",
        severity="high",
        priority="p1",
        risk_level="medium",
        confidence=0.85,
        snippet_length=None,
        title="Hardcoded model name {match} in {file_path}",
        description=(
            "The model name {match} is hardcoded at line {line_number}. Model names should be read from "
            "the configuration so they can be swapped without code changes."
        ),
        recommendation=(
            "Move the model name to the configuration file (e.g., audit_config.json) and reference it "
            "via the model/provider abstraction already present in ConfigManager."
        ),
        context="Found hardcoded model name: {match}",
    ),
    Grades(
        rule_id="hardcoded_constants",
        severity="medium",
        priority="p2",
        risk_level="low",
        confidence=0.75,
        snippet_length=None,
        title="Hardcoded URL/endpoint at {file_path}:{line_number}",
        description=(
            "The value '{value}' at line {line_number} appears to be a hardcoded URL or API endpoint. "
            "Such values should be externalised to configuration so they can be changed without code "
            "modifications."
        ),
        recommendation=(
            "Move this value to the configuration file and reference it via the existing ConfigManager. "
            "Consider adding an 'endpoints' section to audit_config.json."
        ),
        context="Found hardcoded URL/endpoint: {value}",
    ),
    Grades(
        rule_id="non_agnostic_prompts",
        severity="high",
        priority="p1",
        risk_level="medium",
        confidence=0.7,
        snippet_length=200,
        title="Non-model-agnostic prompt at {file_path}:{line_number}",
        description=(
            "Line {line_number} contains a prompt that references a specific model name. Prompts should "
            "be model-agnostic so they work across different providers."
        ),
        recommendation=(
            "Remove model-specific references from prompt templates. Use generic instructions that work "
            "across providers."
        ),
        context="Prompt variable contains a model-specific reference",
    ),
    Grades(
        rule_id="leaked_project_ids",
        severity="critical",
        priority="p0",
        risk_level="high",
        confidence=0.9,
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
    ),
)


def overridden(given: dict) -> list[Grades]:
    """The rules left on by a configuration, with the grades that it names."""
    left = [r for r in RULES if given.get(r.rule_id, {}).get("enabled", True)]
    return [r._replace(**{k: v for k, v in given.get(r.rule_id, {}).items() if k != "enabled"}) for r in left]


BLANK = r"[\s\x1C-\x1F\x{85}\p{Z}]"


def quote(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    parts = text.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def paren(text: str | None) -> str:
    return f"({quote(text)})"


def fill(template: str, **names: str) -> str:
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(quote(literal))
        if field:
            parts.append(names.get(field, f"CAST({field} AS VARCHAR)"))
    return "(" + " || ".join(parts or ["''"]) + ")"


def with_ctes(ctes: dict[str, str], body: str, recursive: bool = False) -> str:
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{listed}\n{body}"


# ---- corpus, lines, rule hits -------------------------------------------------------------------

CORPUS = A.as_sql(A.CORPUS, "documents")
RAW_CORPUS = A.as_sql(A.RAW_CORPUS, "documents")


def lines_of(source: str) -> str:
    return f"""SELECT root, file_path, CAST(generate_subscripts(ls, 1) AS INT) AS line_number, unnest(ls) AS line FROM (
 SELECT root, file_path, string_split_regex(regexp_replace(content, {quote(f'(?:{LINE_BREAK})$')}, ''), {quote(LINE_BREAK)}) AS ls
 FROM {source} WHERE content <> '')"""


STRIPPED = f"regexp_replace(regexp_replace(line, {quote(f'^{BLANK}+')}, ''), {quote(f'{BLANK}+$')}, '')"

# What the built-in rules look for.
_MODELS = r"""(?i)"(gpt-4[^"]*|gpt-3\.5[^"]*|gpt-4o[^"]*|o[13]-[^"]*|claude-[23]-[^"]*|claude-3[^"]*|meta-llama/[^"]*|Llama-[^"]*|Qwen/[^"]*|Qwen[23]-[^"]*|mistral[^"]*|gemini-[^"]*|palm-[^"]*|deepseek[^"]*|phi-[^"]*|mixtral[^"]*)\""""
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_LOCAL = rf"""(?i)['"](https?://(?:localhost|(?:{_OCTET}\.){{3}}{_OCTET})[^'"]*?)['"]"""
_REMOTE = r"""(?i)['"](https?://api\.[a-z0-9\-]+\.[a-z]{2,}/v\d[^'"]*?)['"]"""
_FAMILY = r"""(?i)f?['"].*?(?:gpt-4|gpt-3\.5|claude|llama|qwen|mistral|gemini|palm).*?['"]"""
_KEYWORD = r"(?i)\b(?:system_prompt|user_prompt|prompt_template|PROMPT|instruction)\b"
_IDS = r"""(?i)\b(?:project_id|project_name|org_id|organization_id|tenant_id|workspace_id|client_id)\s*=\s*(?:f?['"])([^'"]{3,})['"]"""
_NO_COMMENT = "NOT starts_with(stripped, '#') AND NOT starts_with(stripped, '//')"


def _extract(rule: str, rule_ord: int, pattern_ord: int, pattern: str, group: int, where: str = "TRUE") -> str:
    return f"""SELECT root, file_path, line_number, stripped, {quote(rule)} AS rule_id, {rule_ord} AS rule_ord,
 {pattern_ord} AS pattern_ord, generate_subscripts(m, 1) - 1 AS match_no, unnest(m) AS match, unnest(v) AS value
 FROM (SELECT *, regexp_extract_all(line, {quote(pattern)}, 0) AS m, regexp_extract_all(line, {quote(pattern)}, {group}) AS v
 FROM stripped_lines WHERE {where})"""


HITS = "\nUNION ALL\n".join(
    [
        _extract("hardcoded_model_names", 0, 0, _MODELS, 0),
        _extract("hardcoded_constants", 1, 0, _LOCAL, 1, _NO_COMMENT),
        _extract("hardcoded_constants", 1, 1, _REMOTE, 1, _NO_COMMENT),
        "SELECT root, file_path, line_number, stripped, 'non_agnostic_prompts', 2, 0, 0, '', '' FROM stripped_lines "
        f"WHERE NOT starts_with(stripped, '#') AND regexp_matches(line, {quote(_KEYWORD)}) "
        f"AND regexp_matches(line, {quote(_FAMILY)})",
        _extract("leaked_project_ids", 3, 0, _IDS, 1, _NO_COMMENT),
    ]
)


def uuid5(key: str) -> str:
    namespace = PROPOSAL_NAMESPACE.replace("-", "")
    h = f"sha1(unhex('{namespace}') || encode({key}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


ID = uuid5("rule_id || ':' || file_path || ':' || CAST(line_number AS VARCHAR)")
FILE_ID = uuid5("rule_id || ':' || file_path || ':'")
VARIABLE = f"trim(regexp_replace(split_part(match, '=', 1), {quote(f'{BLANK}+$')}, ''))"


def _by_rule(make, rules) -> str:
    return "CASE rule_id " + " ".join(f"WHEN {quote(r.rule_id)} THEN {make(r)}" for r in rules) + " END"


def proposals_of(rules, created: str, scan_id: str) -> str:
    def text(name):
        return _by_rule(lambda r: fill(getattr(r, name), variable=VARIABLE), rules)

    listed = ", ".join(quote(r.rule_id) for r in rules)
    snippet = _by_rule(lambda r: f"substr(stripped, 1, {r.snippet_length})" if r.snippet_length else "stripped", rules)
    return f"""SELECT {ID} AS id, rule_id AS type, {text('title')} AS title, {text('description')} AS description,
 {_by_rule(lambda r: quote(r.severity), rules)} AS severity, {_by_rule(lambda r: quote(r.priority), rules)} AS priority,
 CAST({_by_rule(lambda r: str(r.confidence), rules)} AS DOUBLE) AS confidence,
 {_by_rule(lambda r: quote(r.risk_level), rules)} AS risk_level, FALSE AS autofixable,
 {text('recommendation')} AS recommendation, 'detected' AS state, {quote(created)} AS created_at,
 {quote(created)} AS updated_at, rule_id AS source_rule, {scan_id} AS scan_id, file_path, line_number,
 {snippet} AS code_snippet, {text('context')} AS context, rule_ord, pattern_ord, match_no, root
 FROM hits WHERE rule_id IN ({listed})"""


FLAT = (
    "id, type, title, description, severity, priority, confidence, risk_level, autofixable, recommendation, state, "
    "created_at, updated_at, source_rule, scan_id, file_path, line_number, code_snippet, context"
)


def scan(corpus: str = CORPUS, rules=RULES, created: str = A.AS_OF, scan_id: str = quote(A.SCAN_ID)) -> dict:
    return {
        "corpus": corpus,
        "ls": lines_of("corpus"),
        "stripped_lines": f"SELECT *, {STRIPPED} AS stripped FROM ls",
        "hits": HITS,
        "found": proposals_of(rules, created, scan_id),
    }


# ---- path filters -------------------------------------------------------------------------------

# wildcard patterns by hand, as full-match expressions
_GLOBS = {
    "node_modules": "node_modules",
    "*.min.js": r".*\.min\.js",
    "SRC1*": "SRC1.*",
    "*/src1*": ".*/src1.*",
    "VENDOR": "VENDOR",
    "*.PY": r".*\.PY",
    "*.ph[!x]": r".*\.ph[^x]",
    "f1?.p[hy]*": r"f1.\.p[hy].*",
    "app/f2": "app/f2",
    "*7.py": r".*7\.py",
    "*.ts": r".*\.ts",
    "*.egg-info": r".*\.egg-info",
    "test_results*": "test_results.*",
}
RELATIVE = "substr(file_path, length(root) + 2)"
BASE = "regexp_extract(file_path, '[^/]*$')"


def _glob(pattern: str) -> str:
    regex = quote("(?s)" + _GLOBS[pattern])
    tests = [
        f"regexp_full_match({f}({p}), {regex})" for p in (RELATIVE, BASE, "file_path") for f in ("", "lower")
    ]
    return "(" + " OR ".join(tests) + ")"


def _part(pattern: str) -> str:
    return f"list_contains(string_split(lower({RELATIVE}), '/'), {quote(pattern.lower())})"


def _text(pattern: str) -> str:
    return f"contains(lower(file_path), {quote(pattern.lower())})"


def _match(pattern: str) -> str:
    globs = f" OR {_glob(pattern)}" if pattern in _GLOBS else ""
    return f"({_part(pattern)} OR {_text(pattern)}{globs})"


def _any_match(patterns) -> str:
    return "(" + (" OR ".join(_match(p) for p in patterns) or "FALSE") + ")"


EXCLUDED = _any_match(DEFAULT_CONFIG["file_filtering"]["exclude_patterns"])
SOURCE_FILE = "regexp_matches(file_path, '[.](py|php|js|ts)$')"
ELIGIBLE = f"SELECT * FROM ({CORPUS}) WHERE {SOURCE_FILE} AND NOT {EXCLUDED}"
PYTHON_FILES = f"SELECT * FROM ({CORPUS}) WHERE file_path LIKE '%.py' AND NOT {EXCLUDED}"

PATH_MATCH = f"""WITH p AS (SELECT DISTINCT root, file_path FROM (SELECT root, file_path FROM ({CORPUS})
 UNION ALL SELECT root, file_path FROM ({A.as_sql(A.PATHS, 'pages')})))
SELECT file_path, """ + ", ".join(
    f"{_part(p)} AS part_{i}, {_glob(p)} AS glob_{i}, {_text(p)} AS text_{i}, {_match(p)} AS match_{i}"
    for i, p in enumerate(A.MATCH_PATTERNS)
) + " FROM p"

_INCLUDED, _OUT = _any_match(["src1", "app/f2"]), _any_match(["*7.py", "node_modules", "*.ts"])
FILTER_MODES = f"""SELECT file_path, NOT {_OUT} AS include_all, ({_INCLUDED} AND NOT {_OUT}) AS include_only,
 NOT {_OUT} AS exclude_only, FALSE AS nothing_included FROM ({CORPUS})"""

# ---- dimensions, tasks, prompts -----------------------------------------------------------------

_TYPES = [
    (key, p["name"], ext, name, t["name"], t["prompt_template"])
    for key, p in DEFAULT_CONFIG["platforms"].items()
    for ext in p["file_extensions"]
    for name, t in p["analysis_types"].items()
]
TYPES = (
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in _TYPES)
    + ") v(platform, platform_name, extension, analysis_type, type_name, prompt_template)"
)


def _requested(names) -> str:
    return "(VALUES " + ", ".join(f"({quote(n)})" for n in names) + ") r(analysis_type)"


def task_rows(names) -> dict[str, str]:
    return {
        "files": PYTHON_FILES,
        "types": TYPES,
        "made": f"""SELECT f.root, f.file_path, f.content, r.analysis_type, t.type_name, t.prompt_template,
 CASE WHEN t.type_name IS NULL THEN {quote(tasks.UNKNOWN_TYPE)} END AS error
 FROM files f, {_requested(names)} LEFT JOIN types t ON t.platform = 'python' AND t.analysis_type = r.analysis_type""",
    }


def _filled(path: str) -> str:
    return f"replace(replace(prompt_template, '{{file_path}}', {path}), '{{context}}', '')"


FULL_PROMPT = f"({quote(tasks.ROLE_TEXT + tasks.PRACTICES_BEFORE + PRACTICES + tasks.PRACTICES_AFTER)} || chr(10) || chr(10) || {_filled('file_path')})"
SYSTEM_PROMPT = f"({quote(tasks.SYSTEM_TEXT + tasks.SYSTEM_PRACTICES + PRACTICES[: tasks.PRACTICES_LIMIT])})"
USER_PROMPT = (
    f"({_filled(RELATIVE)} || {quote(tasks.USER_FILE[0])} || {RELATIVE} || {quote(tasks.USER_FILE[1])} || content || {quote(tasks.USER_FILE[2])})"
)
DEFAULT_PROMPT = (
    f"({quote(tasks.USER_DEFAULT[0])} || {RELATIVE} || {quote(tasks.USER_DEFAULT[1])} || content || {quote(tasks.USER_DEFAULT[2])})"
)

# ---- JSON ---------------------------------------------------------------------------------------

_SPAN = r"regexp_extract(raw, '(?s)\{.*\}')"
DIRECT = f"CASE WHEN raw = '' THEN NULL WHEN json_valid(raw) THEN raw WHEN json_valid({_SPAN}) THEN {_SPAN} END"
_BLOCKS = r"regexp_extract_all(raw, '\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}')"
NOISY = (
    f"COALESCE(list_filter({_BLOCKS}, lambda x: json_valid(x))[1], "
    "CASE WHEN json_valid(trim(raw)) AND json_type(trim(raw)) = 'OBJECT' THEN trim(raw) END)"
)


def kind(column: str) -> str:
    return (
        f"CASE json_type({column}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' "
        "WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' "
        "WHEN 'DOUBLE' THEN 'float' END"
    )


def compact(column: str) -> str:
    return f"CAST(json({column}) AS VARCHAR)"


def direct_findings(j: str) -> str:
    lists = ", ".join(
        f"CASE WHEN json_type({j}, '$.{k}') = 'ARRAY' THEN json_extract({j}, '$.{k}') END" for k in FINDING_KEYS
    )
    return f"COALESCE({lists}, CAST('[]' AS JSON))"


def first_present(j: str, keys) -> str:
    tests = " ".join(f"WHEN json_type({j}, '$.{k}') IS NOT NULL THEN json_extract({j}, '$.{k}')" for k in keys)
    return f"(CASE {tests} END)"


def noisy_findings(j: str) -> str:
    f = first_present(j, FINDING_KEYS)
    letters = f"to_json(string_split(json_extract_string({f}, '$'), ''))"
    return (
        f"CASE WHEN {f} IS NULL THEN CAST('[]' AS JSON) WHEN json_type({f}) = 'ARRAY' THEN {f} "
        f"WHEN json_type({f}) = 'VARCHAR' THEN {letters} WHEN json_type({f}) = 'OBJECT' THEN to_json(json_keys({f})) END"
    )


def direct_score(j: str) -> str:
    s = first_present(j, SCORE_KEYS)
    text = f"json_extract_string({s}, '$')"
    return (
        f"CASE json_type({s}) WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match({text}, '\\s*[+-]?\\d+(_\\d+)*\\s*') "
        f"THEN CAST(replace(trim({text}), '_', '') AS BIGINT) END WHEN 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1 ELSE 0 END "
        f"WHEN 'NULL' THEN NULL ELSE CAST(trunc(CAST({text} AS DOUBLE)) AS BIGINT) END"
    )


def noisy_score(j: str) -> str:
    return f"nullif(CAST({first_present(j, SCORE_KEYS)} AS VARCHAR), 'null')"


def direct_abort(j: str) -> str:
    keys = FINDING_KEYS + SCORE_KEYS
    listed = " OR ".join(f"list_contains(CAST(from_json({j}, '[\"JSON\"]') AS VARCHAR[]), '\"{k}\"')" for k in keys)
    mentioned = " OR ".join(f"contains(json_extract_string({j}, '$'), '{k}')" for k in keys)
    return (
        f"CASE {kind(j)} WHEN 'list' THEN CASE WHEN {listed} THEN {quote(ABORT_MESSAGES['list'])} END "
        f"WHEN 'string' THEN CASE WHEN {mentioned} THEN {quote(ABORT_MESSAGES['string'])} END "
        + " ".join(f"WHEN '{k}' THEN {quote(ABORT_MESSAGES[k])}" for k in ("int", "float", "bool"))
        + " END"
    )


USABLE_DIRECT = "(parsed IS NOT NULL AND json_type(parsed) <> 'NULL')"
USABLE_NOISY = "(parsed IS NOT NULL AND json_type(parsed) = 'OBJECT' AND CAST(json(parsed) AS VARCHAR) <> '{}')"

RAW_OUTPUTS = A.as_sql(A.RAW_OUTPUTS, "events")


def parsed_query(function: str) -> str:
    return f"""SELECT event_id, {kind('p')} AS kind, {compact('p')} AS parsed
FROM (SELECT event_id, {function} AS p FROM ({RAW_OUTPUTS}))"""


FINDINGS_SCORES = f"""WITH r AS (SELECT event_id, {DIRECT} AS d, {NOISY} AS n FROM ({RAW_OUTPUTS}))
SELECT event_id, {USABLE_DIRECT.replace('parsed', 'd')} AS direct_ok, {USABLE_NOISY.replace('parsed', 'n')} AS noisy_ok,
 {direct_abort('d')} AS direct_abort,
 CASE WHEN json_type(d) = 'OBJECT' THEN CAST({direct_findings('d')} AS VARCHAR) ELSE '[]' END AS direct_findings,
 CASE WHEN n IS NULL THEN '[]' ELSE CAST({noisy_findings('n')} AS VARCHAR) END AS noisy_findings,
 CASE WHEN json_type(d) = 'OBJECT' THEN {direct_score('d')} END AS direct_score,
 {noisy_score('n')} AS noisy_score FROM r"""

# ---- trees ----------------------------------------------------------------------------------------


def _tree_rows(batch: int, where: str, content: str) -> str:
    text = f"replace(replace({content}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"""SELECT CAST({batch} AS INT) AS batch, {A.TREE_NAME} AS name, md5({text}) AS digest, {content} IS NULL AS deleted,
 CAST(NULL AS VARCHAR) AS error FROM documents WHERE {where} AND regexp_matches({A.TREE_NAME}, '[.](py|php|js|ts)$')"""


TREE = "\nUNION ALL\n".join(_tree_rows(k, *change) for k, changes in enumerate(A.TREE_ROUNDS) for change in changes)

# ---- responses to results -----------------------------------------------------------------------

_KEY = "run_id, file_path, analysis_type"
RESOLVED = {
    "resp": A.as_sql(A.RESPONSES, "events"),
    "tried": f"""SELECT *, CASE WHEN NOT call_ok THEN NULL WHEN mode = 'direct' THEN {DIRECT} ELSE {NOISY} END AS parsed
 FROM resp WHERE attempt <= 3""",
    "judged": f"SELECT *, CASE WHEN mode = 'direct' THEN {USABLE_DIRECT} ELSE {USABLE_NOISY} END AS usable FROM tried",
    "marked": "SELECT *, (usable OR (mode = 'noisy' AND timed_out)) AS final FROM judged",
    "chosen": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY}, analyzer_id
 ORDER BY CASE WHEN final THEN 0 ELSE 1 END, CASE WHEN final THEN attempt ELSE -attempt END) AS rn FROM marked) WHERE rn = 1""",
}
_OK = "(usable AND NOT (mode = 'noisy' AND timed_out))"
_SUCCESS = "COALESCE(bool_or(ok) FILTER (WHERE reached OR (unlisted AND analyzer_ord = stop)), FALSE)"
RESULTS = RESOLVED | {
    "read_rows": f"""SELECT *, {_OK} AS ok,
 CASE WHEN {_OK} AND mode = 'direct' THEN {direct_abort('parsed')} END AS abort,
 CASE WHEN mode = 'direct' THEN CASE WHEN json_type(parsed) = 'OBJECT' THEN {direct_findings('parsed')} ELSE CAST('[]' AS JSON) END
   ELSE {noisy_findings('parsed')} END AS found,
 CASE WHEN NOT {_OK} THEN NULL WHEN mode = 'direct' THEN CASE WHEN json_type(parsed) = 'OBJECT' THEN CAST({direct_score('parsed')} AS VARCHAR) END
   ELSE {noisy_score('parsed')} END AS score_text,
 CASE WHEN {_OK} OR mode = 'noisy' THEN NULL WHEN call_ok THEN {quote(NO_JSON)}
   ELSE 'Chiamata LLM fallita dopo ' || CAST(attempt AS VARCHAR) || ' tentativi' END AS message,
 {_OK} AND mode = 'noisy' AND {noisy_findings('parsed')} IS NULL AS unlisted FROM chosen""",
    "stops": f"""SELECT *, min(CASE WHEN abort IS NOT NULL OR unlisted THEN analyzer_ord END) OVER (PARTITION BY {_KEY}) AS stop FROM read_rows""",
    "sided": "SELECT *, (stop IS NULL OR analyzer_ord < stop) AS reached FROM stops",
    "results": f"""SELECT {_KEY}, {_SUCCESS} AS success,
 COALESCE(flatten(list(from_json(found, '["JSON"]') ORDER BY analyzer_ord) FILTER (WHERE reached AND ok)), []) AS findings,
 first(score_text ORDER BY analyzer_ord DESC) FILTER (WHERE reached AND ok AND score_text IS NOT NULL) AS score,
 string_agg(raw, chr(10) || chr(10) ORDER BY analyzer_ord) FILTER (WHERE reached AND ok AND raw <> '') AS raw_output,
 CASE WHEN {_SUCCESS} THEN NULL ELSE COALESCE(
   string_agg(CASE WHEN analyzer_ord = stop THEN abort ELSE analyzer_id || ': ' || message END, '; ' ORDER BY analyzer_ord)
   FILTER (WHERE (reached AND NOT ok AND message IS NOT NULL) OR analyzer_ord = stop), {quote(FAILED)}) END AS error,
 max(completed_at) AS completed_at, round(sum(execution_time), 4) AS execution_time
 FROM sided GROUP BY {_KEY}""",
}
FINDINGS_TEXT = "CAST(to_json(findings) AS VARCHAR)"
_STAMP = "strftime(max(completed_at), '%Y-%m-%d %H:%M:%S')"
META = f"""SELECT run_id, {quote(A.ROOT)} AS project_path, 'Python Backend' AS platform, {_STAMP} AS "timestamp",
 count(DISTINCT file_path) AS total_files, count(*) AS total_analyses, count(*) FILTER (WHERE success) AS successful_analyses,
 count(*) FILTER (WHERE NOT success) AS failed_analyses, CAST(sum(len(findings)) AS BIGINT) AS total_findings,
 CAST(sum(len(list_filter(findings, lambda f: json_extract_string(f, '$.severity') IN ('critical', 'high')))) AS BIGINT) AS critical_findings,
 'audit_python_backend_' || strftime(max(completed_at), '%Y%m%d_%H%M%S') || '.json' AS report_file FROM results GROUP BY run_id"""


def _shown(name: str) -> str:
    value, text = f"CAST(json_extract(f, '$.{name}') AS VARCHAR)", f"json_extract_string(f, '$.{name}')"
    return f"CASE WHEN {value} NOT IN ('null', '\"\"', '0', '0.0', 'false') THEN {text} END"


FINDINGS_VIEW = f"""SELECT {_KEY}, CAST(position - 1 AS INT) AS position,
 CASE WHEN f IS NOT NULL THEN upper(COALESCE({_shown('severity')}, {quote(DEFAULT_SEVERITY)})) END AS severity,
 CASE WHEN f IS NOT NULL THEN COALESCE({_shown('category')}, {_shown('type')}, {quote(DEFAULT_CATEGORY)}) END AS category,
 CASE WHEN f IS NOT NULL THEN COALESCE({_shown('description')}, {quote(DEFAULT_DESCRIPTION)}) END AS description,
 {_shown('line_number')} AS line_number, {_shown('code_snippet')} AS code_snippet, {_shown('recommendation')} AS recommendation
FROM (SELECT {_KEY}, unnest(findings) AS f, generate_subscripts(findings, 1) AS position FROM results WHERE len(findings) > 0
 UNION ALL SELECT {_KEY}, NULL, NULL FROM results WHERE len(findings) = 0)"""

# ---- hypotheses ---------------------------------------------------------------------------------

_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def hypotheses_of(source: str, order: str, analyzer: str) -> str:
    return f"""SELECT rule_id, file_path, first({analyzer} ORDER BY {order}) AS source_analyzer,
 first(severity ORDER BY {_RANK} DESC, {order}) AS severity, round(avg(confidence), 6) AS confidence, FALSE AS validated,
 count(*) AS signal_count, first(line_number ORDER BY {order}) AS first_line,
 first(code_snippet ORDER BY {order}) AS first_snippet FROM {source} GROUP BY rule_id, file_path"""


SIGNALS = A.as_sql(A.SIGNALS, "events")
# ---- backlog ------------------------------------------------------------------------------------

_LABELLED = f"""SELECT {', '.join(f'{e} AS {n}' for n, e in A.CORPUS.items())}, {A.PRIOR_STATE} AS labelled
 FROM documents JOIN labels USING (doc_id)"""
_FIRST = "row_number() OVER (PARTITION BY id ORDER BY pattern_ord, match_no) AS nth, count(*) OVER (PARTITION BY id) AS seen"


def _renamed(ctes: dict[str, str], prefix: str) -> dict[str, str]:
    out = {}
    for name, sql in ctes.items():
        for other in ctes:
            sql = sql.replace(f"FROM {other}", f"FROM {prefix}{other}")
        out[prefix + name] = sql
    return out


PRIOR = _renamed(scan(_LABELLED, created=A.AS_OF, scan_id="'scan-000'"), "old_") | {
    "prior": f"""SELECT p.* REPLACE (c.labelled AS state) FROM (SELECT *, {_FIRST} FROM old_found) p
 JOIN old_corpus c USING (file_path) WHERE nth = 1"""
}
RESCAN = scan(ELIGIBLE, created=A.LATER)
UPSERT = with_ctes(
    PRIOR | RESCAN | {
        "batch": f"SELECT * FROM (SELECT *, {_FIRST} FROM found) WHERE nth = 1",
    },
    f"""SELECT {FLAT} FROM (SELECT p.* REPLACE ({quote(A.SCAN_ID)} AS scan_id, {quote(A.LATER)} AS updated_at) FROM prior p
  WHERE id IN (SELECT id FROM batch)
 UNION ALL BY NAME SELECT p.* FROM prior p WHERE id NOT IN (SELECT id FROM batch)
 UNION ALL BY NAME SELECT b.* FROM batch b WHERE id NOT IN (SELECT id FROM prior))""",
)

DEFAULTS = f"""SELECT json_extract_string(value, '$.id') AS id, json_extract_string(value, '$.type') AS type,
 json_extract_string(value, '$.title') AS title, CAST(COALESCE(json_array_length(value, '$.evidence'), 0) AS INT) AS evidence,
 COALESCE(json_extract_string(value, '$.severity'), 'medium') AS severity,
 COALESCE(json_extract_string(value, '$.priority'), 'p2') AS priority,
 COALESCE(CAST(json_extract(value, '$.confidence') AS DOUBLE), 0.5) AS confidence,
 COALESCE(json_extract_string(value, '$.risk_level'), 'medium') AS risk_level,
 COALESCE(CAST(json_extract(value, '$.autofixable') AS BOOLEAN), FALSE) AS autofixable,
 COALESCE(json_extract_string(value, '$.recommendation'), '') AS recommendation,
 COALESCE(json_extract_string(value, '$.state'), 'detected') AS state,
 json_extract_string(value, '$.source_rule') AS source_rule, json_extract_string(value, '$.scan_id') AS scan_id
 FROM ({A.as_sql(A.STORED, 'labels')})"""

_SCAN_OF = "'scan-' || split_part(file_path, '/', 4)"
SCANS = scan(ELIGIBLE, scan_id=_SCAN_OF)

# ---- transitions --------------------------------------------------------------------------------


def _allowed(state: str, new: str) -> str:
    return (
        f"CASE {state} WHEN 'detected' THEN {new} IN ('candidate', 'rejected') WHEN 'candidate' THEN {new} IN ('validated', 'rejected') "
        f"WHEN 'validated' THEN {new} IN ('planned', 'rejected') WHEN 'planned' THEN {new} = 'rejected' ELSE FALSE END"
    )


# request by request, as a recursive replay
REPLAY = {
    "log": f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS rn FROM ({A.as_sql(A.TRANSITIONS, 'events')})",
    "states": A.as_sql(A.START_STATES, "labels"),
    "steps": f"""SELECT l.*, s.state AS from_state, {_allowed('s.state', 'l.new_state')} AS accepted, s.id IS NOT NULL AS known
 FROM log l LEFT JOIN states s USING (id) WHERE l.rn = 1
 UNION ALL SELECT l.*, CASE WHEN p.accepted THEN p.new_state ELSE p.from_state END,
 {_allowed('CASE WHEN p.accepted THEN p.new_state ELSE p.from_state END', 'l.new_state')}, p.known
 FROM steps p JOIN log l ON l.id = p.id AND l.rn = p.rn + 1""",
}
OUTCOMES = with_ctes(
    REPLAY,
    """SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, seq, from_state, new_state, accepted,
 CASE WHEN new_state NOT IN ('detected', 'candidate', 'validated', 'planned', 'rejected') THEN 'invalid_state'
 WHEN NOT known THEN 'not_found' WHEN NOT accepted THEN 'not_allowed' END AS refusal FROM steps""",
    recursive=True,
)
MOVED = with_ctes(
    REPLAY,
    """SELECT s.id, COALESCE(a.new_state, s.state) AS state,
 strftime(COALESCE(a.ts, s.updated_at), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
 FROM states s LEFT JOIN (SELECT id, last(new_state ORDER BY rn) AS new_state, max(ts) AS ts FROM steps WHERE accepted GROUP BY id) a USING (id)""",
    recursive=True,
)
DECISIONS = with_ctes(
    REPLAY,
    f"""SELECT {quote(EVENT_VALIDATION)} AS type, {quote(EVENT_ACTOR)} AS actor, 'info' AS level,
 'proposal_engine,validation' AS tags, '{{"proposal_id":"' || id || '","decision":"' || new_state || '"' ||
 CASE WHEN reason <> '' THEN ',"reason":"' || reason || '"' ELSE '' END || '}}' AS payload
 FROM steps WHERE accepted AND new_state IN ('validated', 'rejected')""",
    recursive=True,
)

# ---- trace --------------------------------------------------------------------------------------

HIT_EVENTS = f"""SELECT {quote(EVENT_VIOLATION)} AS type, 'proposal_engine' AS actor,
 CASE WHEN severity IN ('high', 'critical') THEN 'warn' ELSE 'info' END AS level, 'proposal_engine,' || source_rule AS tags,
 '{{"rule_id":"' || source_rule || '","file_path":"' || file_path || '","severity":"' || severity || '","line_number":' || line_number || '}}' AS payload
 FROM found UNION ALL SELECT {quote(EVENT_GENERATED)}, 'proposal_engine', 'info', 'proposal_engine,' || type,
 '{{"proposal_id":"' || id || '","proposal_type":"' || type || '","severity":"' || severity || '","file_path":"' || file_path || '"}}' FROM found"""
SCAN_EVENTS = f"""SELECT {quote(EVENT_SCAN_START)}, 'proposal_engine', 'info', '',
 '{{"scan_id":"' || scan_id || '","project_path":"{A.ROOT}"}}' FROM (SELECT DISTINCT scan_id FROM found)
 UNION ALL SELECT {quote(EVENT_SCAN_END)}, 'proposal_engine', 'info', '',
 '{{"status":"ok","proposal_count":' || count(*) || ',"scan_id":"' || scan_id || '"}}' FROM found GROUP BY scan_id"""

# ---- linters ------------------------------------------------------------------------------------

_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
_RAN = "(found AND NOT timed_out AND error IS NULL)"
LINT = f"""SELECT *, CASE WHEN NOT available THEN {quote(LINT_STATUS_UNAVAILABLE)} WHEN success THEN {quote(LINT_STATUS_OK)}
 ELSE {quote(LINT_STATUS_ISSUES)} END AS status, COALESCE(nullif(error, ''), nullif(stderr, ''), nullif(stdout, ''), '') AS detail
FROM (SELECT file_path, linter, found AS available,
 CASE WHEN NOT found THEN NULL WHEN NOT {_RAN} THEN FALSE ELSE returncode = 0 END AS success,
 CASE WHEN {_RAN} THEN returncode END AS returncode, CASE WHEN {_RAN} THEN {_TRIM('stdout')} END AS stdout,
 CASE WHEN {_RAN} THEN {_TRIM('stderr')} END AS stderr,
 CASE WHEN NOT found THEN command || {quote(LINT_NOT_FOUND)} WHEN timed_out THEN {quote(LINT_TIMED_OUT)} ELSE error END AS error
 FROM (%s) WHERE enabled)"""
LINT_ROWS = LINT % A.as_sql(A.LINT_RUNS, "events")
# of several runs of a linter on a file the greatest outcome counts; a missing verdict sorts first
LINT_FILES = f"""SELECT file_path, string_agg(linter || '=' || COALESCE(CAST(success AS VARCHAR), '-'), ',' ORDER BY linter) AS linters
FROM (SELECT '/srv/proj/app/' || substr(md5(file_path), 1, 2) AS file_path, linter,
 max(CASE WHEN available THEN CAST(success AS INT) ELSE -1 END) AS best FROM ({LINT_ROWS})
 WHERE linter IN ('pylint', 'flake8') GROUP BY 1, 2), LATERAL (SELECT CASE best WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS success)
GROUP BY file_path"""


def oracle_sql() -> dict[str, str]:
    user_hits = "\nUNION ALL\n".join(
        f"""SELECT '{r.rule_id}' AS rule_id, file_path, line_number, CAST(generate_subscripts(m, 1) - 1 AS INT) AS match_no, unnest(m) AS match
 FROM (SELECT *, regexp_extract_all(line, {quote(r.patterns[0])}) AS m FROM ls)"""
        for r in USER_RULES
    )
    hit_columns = "id, file_path, line_number, code_snippet, context, title, severity"
    one_rule = lambda rule: with_ctes(
        scan(), f"SELECT {hit_columns} FROM found WHERE type = {quote(rule)}"
    )
    requests = task_rows(("deep_scan", "code_quality"))
    size = f"length({USER_PROMPT})"
    eligible_scan = scan(ELIGIBLE)
    last = f"CASE WHEN doc_id % 5 = 0 THEN {A.EDITED['content']} ELSE {A.CORPUS['content']} END"
    hypotheses_last = with_ctes(
        scan(A.as_sql(A.CORPUS | {"content": last}, "documents")) | {"sig": "SELECT *, type AS rule_id FROM found"},
        hypotheses_of("sig", "line_number, pattern_ord, match_no", "'static'"),
    )
    hypotheses_all = with_ctes(
        scan() | {"sig": "SELECT *, type AS rule_id FROM found"},
        hypotheses_of("sig", "line_number, pattern_ord, match_no", "'static'"),
    )
    evidence = (
        "'[' || CAST(to_json({'file_path': file_path, 'line_number': line_number, 'code_snippet': code_snippet, "
        "'context': context}) AS VARCHAR) || ']'"
    )
    logged = with_ctes(
        RESULTS,
        f"SELECT file_path, analysis_type, success, {FINDINGS_TEXT} AS findings, score, error, execution_time FROM results",
    )
    repeated_lines = with_ctes(
        {"corpus": RAW_CORPUS, "ls": lines_of("corpus")},
        f"""SELECT file_path, 'repeated_lines' AS rule_id, CAST(line_number AS INT) AS line_number,
 CAST(length(line) AS VARCHAR) AS context, 'low' AS severity, CAST(NULL AS VARCHAR) AS error
 FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY line_number) AS nth FROM ls)
 WHERE nth > 1 AND NOT regexp_full_match(line, {quote(f'{BLANK}*')})""",
    )
    return {
        "discover_files": f"SELECT DISTINCT root, file_path FROM ({ELIGIBLE})",
        "read_text": f"""SELECT file_path, md5(t) AS digest, CAST(length(t) AS INT) AS chars FROM (SELECT file_path,
 regexp_replace(content, '\\r\\n?', chr(10), 'g') || chr(65533) || chr(10) || 'x' || chr(10) || 'y' AS t FROM ({RAW_CORPUS}))""",
        "scan_file_list": f"""SELECT file_path, CAST(length(content) AS INT) AS chars FROM ({CORPUS})
 WHERE file_path IN (SELECT {A.FILE_PATH} FROM labels JOIN documents USING (doc_id))""",
        "dims_platform_types": f"""WITH types AS ({TYPES}) SELECT platform, platform_name, analysis_type, type_name, count(*) AS files
 FROM ({CORPUS}) JOIN types ON suffix(file_path, extension) GROUP BY ALL""",
        "audit_tasks": with_ctes(
            task_rows(REQUESTED_TYPES), "SELECT file_path, analysis_type, type_name, error FROM made"
        ),
        "prompt_render": with_ctes(
            task_rows(REQUESTED_TYPES),
            f"""SELECT file_path, analysis_type, md5({FULL_PROMPT}) AS full_prompt,
 CASE WHEN error IS NULL THEN md5({SYSTEM_PROMPT}) END AS system_prompt,
 CASE WHEN error IS NULL THEN md5({USER_PROMPT}) END AS user_prompt, md5({DEFAULT_PROMPT}) AS default_prompt FROM made""",
        ),
        "path_match": PATH_MATCH,
        "filter_modes": FILTER_MODES,
        "scan_lines": with_ctes(
            {"corpus": CORPUS, "ls": lines_of("corpus")}, "SELECT file_path, CAST(line_number AS INT) AS line_number, line FROM ls"
        ),
        "detect_model_names": one_rule("hardcoded_model_names"),
        "detect_constants": one_rule("hardcoded_constants"),
        "detect_prompts": one_rule("non_agnostic_prompts"),
        "detect_project_ids": one_rule("leaked_project_ids"),
        "proposals": with_ctes(scan(), f"SELECT {FLAT} FROM found"),
        "rule_overrides": with_ctes(scan(rules=overridden(OVERRIDES)), f"SELECT {FLAT} FROM found"),
        "proposal_ids": with_ctes(
            scan(),
            f"SELECT rule_id, file_path, line_number, {ID} AS id, {FILE_ID} AS file_id FROM hits",
        ),
        "static_findings": with_ctes(
            scan(),
            f"SELECT type AS rule_id, severity, title, description, {evidence} AS evidence, recommendation, confidence FROM found",
        ),
        "custom_rule": with_ctes(
            {"corpus": RAW_CORPUS, "ls": lines_of("corpus"), "h": user_hits}, "SELECT * FROM h"
        ),
        "custom_python_rule": repeated_lines,
        "custom_rule_in_sql": repeated_lines,
        "signals": with_ctes(
            scan(),
            "SELECT type AS rule_id, file_path, line_number, code_snippet, context, severity, confidence, type AS source_detector FROM found",
        ),
        "hypotheses": hypotheses_all,
        "hypotheses_mixed": hypotheses_of(f"({SIGNALS})", "ord", "source_analyzer"),
        "hypothesis_signals": f"""SELECT rule_id, file_path, CAST(floor((place - 1) / 20) AS BIGINT) AS chunk, signal_count,
 CAST(count(*) AS INT) AS n, string_agg(code_snippet, ',' ORDER BY ord) AS snippets FROM (SELECT *,
 row_number() OVER (PARTITION BY rule_id, file_path ORDER BY ord) AS place,
 count(*) OVER (PARTITION BY rule_id, file_path) AS signal_count FROM ({SIGNALS})) GROUP BY 1, 2, 3, 4""",
        "backlog_upsert": UPSERT,
        "backlog_get": with_ctes(PRIOR | RESCAN, f"SELECT {FLAT} FROM prior WHERE id IN (SELECT id FROM found)"),
        "backlog_list": with_ctes(PRIOR, f"SELECT {FLAT} FROM prior WHERE state = 'validated'"),
        "backlog_defaults": DEFAULTS,
        "backlog_corrupt": f"SELECT * FROM ({DEFAULTS}) WHERE id NOT LIKE '%0' AND id NOT LIKE '%1'",
        "scan_summary": with_ctes(
            SCANS, 'SELECT scan_id, max(created_at) AS "timestamp", count(*) AS proposal_count FROM found GROUP BY scan_id'
        ),
        "scan_list": with_ctes(
            SCANS,
            """SELECT scan_id, replace(max(created_at), ' ', 'T') || '.000Z' AS "timestamp", count(*) AS proposal_count
 FROM found GROUP BY scan_id""",
        ),
        "scan_get": with_ctes(SCANS, f"SELECT {FLAT} FROM found WHERE scan_id = (SELECT max(scan_id) FROM found)"),
        "transitions_apply": OUTCOMES,
        "transitions_backlog": MOVED,
        "transition_events": DECISIONS,
        "trace_events": with_ctes(SCANS, f"{HIT_EVENTS} UNION ALL {SCAN_EVENTS}"),
        "parse_direct": parsed_query(DIRECT),
        "parse_noisy": parsed_query(NOISY),
        "findings_scores": FINDINGS_SCORES,
        "retry_resolve": with_ctes(
            RESOLVED, f"SELECT {_KEY}, analyzer_id, attempt, call_ok, timed_out, usable, raw FROM chosen"
        ),
        "merge_analyzers": with_ctes(
            RESULTS, f"SELECT {_KEY}, success, {FINDINGS_TEXT} AS findings, score, raw_output, error FROM results"
        ),
        "redact": f"""SELECT event_id, CASE WHEN COALESCE(secret, '') = '' THEN message ELSE replace(message, secret, '***') END AS message
 FROM ({A.as_sql(A.MESSAGES, 'events')})""",
        "analyze_batch": with_ctes(
            requests,
            f"""SELECT file_path, analysis_type, success, CAST(CASE WHEN success THEN 2 ELSE 0 END AS INT) AS findings,
 CASE WHEN success THEN CAST(size % 100 AS VARCHAR) END AS score, CASE WHEN size % 7 = 0 THEN
 'llm: Chiamata LLM fallita dopo 3 tentativi' WHEN size % 11 = 0 THEN 'llm: {NO_JSON}' END AS error
 FROM (SELECT *, {size} AS size, ({size} % 7 <> 0 AND {size} % 11 <> 0) AS success FROM made)""",
        ),
        "audit_run": with_ctes(
            task_rows(("deep_scan", "code_quality", "no_such_scan")) | scan() | {
                "per_file": "SELECT file_path, count(*) AS n FROM found GROUP BY file_path",
                "sized": f"""SELECT file_path, analysis_type, {size} AS s, length({FULL_PROMPT}) AS n,
 COALESCE(error, CASE WHEN length(content) % 13 = 0 THEN 'cannot read' END) AS failure FROM made""",
                "told": """SELECT *, s % 7 <> 0 AND s % 17 = 0 AS ended, s % 7 <> 0 AND s % 11 <> 0 AS listed FROM sized""",
            },
            """SELECT t.file_path, analysis_type, failure IS NULL AND NOT ended AS success,
 CAST(CASE WHEN failure IS NOT NULL OR ended THEN 0 ELSE CASE WHEN listed THEN 2 ELSE 0 END
   + CASE t.n % 3 WHEN 0 THEN COALESCE(p.n, 0) WHEN 1 THEN 1 + COALESCE(p.n, 0) ELSE 0 END END AS INT) AS findings,
 CASE WHEN failure IS NULL AND NOT ended AND listed THEN CAST(s % 100 AS VARCHAR) END AS score,
 COALESCE(failure, CASE WHEN ended THEN 'list indices must be integers or slices, not str' END) AS error,
 TRUE AS completed FROM told t LEFT JOIN per_file p USING (file_path)""",
        ),
        "linter_status": LINT_ROWS,
        "linter_files": LINT_FILES,
        "report_meta": with_ctes(RESULTS, META),
        "report_results": with_ctes(
            RESULTS,
            f"SELECT {_KEY}, success, execution_time, {FINDINGS_TEXT} AS findings, score, error FROM results",
        ),
        "report_list": with_ctes(
            RESULTS | {"meta": META},
            'SELECT report_file AS filename, "timestamp", project_path, platform, total_files, total_findings, critical_findings FROM meta',
        ),
        "report_get": with_ctes(
            RESULTS | {"meta": META},
            f"""SELECT {_KEY}, success, {FINDINGS_TEXT} AS findings, score, error FROM results
 WHERE run_id = (SELECT run_id FROM meta ORDER BY report_file LIMIT 1)""",
        ),
        "report_documents": with_ctes(
            RESULTS | {"meta": META},
            f"""SELECT report_file AS filename, platform, total_analyses, file_path, analysis_type, success, {FINDINGS_TEXT} AS findings, score, error
 FROM results JOIN meta USING (run_id)""",
        ),
        "checkpoint_rows": logged,
        "findings_view": with_ctes(RESULTS, FINDINGS_VIEW),
        "progress": with_ctes(
            RESULTS,
            f"""SELECT {_KEY}, row_number() OVER (PARTITION BY run_id ORDER BY completed_at, file_path, analysis_type) AS done,
 count(*) OVER (PARTITION BY run_id) AS total FROM results""",
        ),
        "stream_scan": with_ctes(eligible_scan, f"SELECT {FLAT} FROM found"),
        "stream_upsert": UPSERT,
        "stream_hypotheses": hypotheses_last,
        "stream_transitions": OUTCOMES,
        "stream_transitions_late": OUTCOMES,
        "stream_filter_reload": f"""SELECT root, file_path FROM (SELECT doc_id, {A.CORPUS['root']} AS root, {A.FILE_PATH} AS file_path FROM documents)
 WHERE {SOURCE_FILE} AND CASE doc_id % 3 WHEN 0 THEN NOT {EXCLUDED} WHEN 1 THEN NOT {_OUT} ELSE TRUE END""",
        "stream_tree": TREE,
        "stream_checkpoint": logged,
        "stream_trace": with_ctes(scan(), HIT_EVENTS),
    }
