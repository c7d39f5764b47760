"""Inputs of the operators derived from the test tables.

Each adapter is a list of ``name: SQL expression`` over one table. The expressions are plain enough to
mean the same in Spark and in the checking engine, so both sides start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-06-01 00:00:00"
LATER = "2024-07-01 00:00:00"
ROOT = "/srv/proj"
SCAN_ID = "scan-001"

CODE_LINE = """CASE doc_id % 7
 WHEN 0 THEN 'MODELS = ["gpt-4-turbo-' || CAST(doc_id AS STRING) || '", "claude-3-opus", "plain"]'
 WHEN 1 THEN '# tenant_id = "acme-corp"'
 WHEN 2 THEN '  project_id = "proj-' || CAST(doc_id AS STRING) || '"; org_id = "acme"'
 WHEN 3 THEN '    a = "http://localhost:8000/v1"; b = "https://api.acme.io/v2/x"; c = "http://10.0.0.7/q"'
 WHEN 4 THEN 'base = "https://api.example.com/v1/chat"  '
 WHEN 5 THEN 'system_prompt = "You run on gpt-4, be brief"' || chr(10) || '// workspace_id = "w-1234"'
 ELSE 'x = compute(y)' END"""

FILE_PATH = """'/srv/proj/' || source || '/'
 || CASE doc_id % 6 WHEN 4 THEN 'vendor' WHEN 5 THEN 'node_modules' ELSE 'app' END
 || '/f' || CAST(doc_id AS STRING)
 || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.php' WHEN 2 THEN '.js' WHEN 3 THEN '.ts' ELSE '.md' END"""

CORPUS = {
    "root": "'/srv/proj'",
    "file_path": FILE_PATH,
    "content": f"text || chr(10) || {CODE_LINE}",
}

RAW_CORPUS = {"root": "'/srv/proj'", "file_path": FILE_PATH, "content": "text"}

PATHS = {
    "root": "'/srv/web'",
    "file_path": "'/srv/web/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')",
}

_SEVERITY = (
    "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' "
    "WHEN 'view' THEN 'low' ELSE 'Critical' END"
)
_FINDING = (
    """'{"category":"c' || CAST(user_id % 4 AS STRING) || '","description":"d' || CAST(event_id AS STRING)"""
    """ || '","line_number":' || CAST(user_id % 3 AS STRING) || ',"severity":"' || """ + _SEVERITY + """ || '"}'"""
)
_BARE = """'{"category":false,"code_snippet":"0","severity":"","type":"t' || CAST(user_id % 2 AS STRING) || '"}'"""

RAW = f"""CASE event_id % 19
 WHEN 0 THEN '{{"findings":[' || {_FINDING} || ',' || {_BARE} || '],"overall_score":85}}'
 WHEN 1 THEN 'Here you go: {{"issues":[' || {_FINDING} || '],"quality_score":"77"}} thanks'
 WHEN 2 THEN '{{"note":1}} then {{"security_score":true,"vulnerabilities":[' || {_FINDING} || ']}}'
 WHEN 3 THEN '{{"a":{{"b":{{"c":1}}}},"findings":[' || {_FINDING} || '],"overall_score":90}}'
 WHEN 4 THEN '{{"findings":"no","issues":[' || {_FINDING} || '],"overall_score":null}}'
 WHEN 5 THEN '{{"performance_issues":[' || {_FINDING} || ',5,' || {_FINDING} || '],"performance_score":72.9}}'
 WHEN 6 THEN 'no json here'
 WHEN 7 THEN '{{}}'
 WHEN 8 THEN '[1,2]'
 WHEN 9 THEN '"some findings"'
 WHEN 10 THEN '5'
 WHEN 11 THEN 'null'
 WHEN 12 THEN '{{"findings":[],"quality_score":"7x","security_score":3}}'
 WHEN 13 THEN '{{''a'':1}} or {{"b":2'
 WHEN 14 THEN '{{"security_score":-4.6,"vulnerabilities":[' || {_FINDING} || ']}} trailing'
 WHEN 15 THEN '{{"findings":5,"overall_score":60}}'
 WHEN 16 THEN '{{"findings":null,"issues":[' || {_FINDING} || ']}}'
 WHEN 17 THEN '{{"findings":[' || {_FINDING} || '],"overall_score":51}}'
 ELSE '["overall_score"]' END"""
RAW = RAW.replace("{''a'':1}", "{' || chr(39) || 'a' || chr(39) || ':1}")

_TASK = "CAST(floor(event_id / 6) AS BIGINT)"
_FILE_NO = "CAST(floor(event_id / 24) AS BIGINT)"

RESPONSES = {
    "run_id": f"'run' || CAST({_FILE_NO} % 5 AS STRING)",
    "file_path": f"'/srv/proj/app/f' || CAST({_FILE_NO} AS STRING) || '.py'",
    "analysis_type": f"CASE {_TASK} % 4 WHEN 0 THEN 'deep_scan' WHEN 1 THEN 'security_scan' "
    "WHEN 2 THEN 'code_quality' ELSE 'performance' END",
    "analyzer_id": "CASE WHEN event_id % 6 < 3 THEN 'llm' ELSE 'aider' END",
    # the noisy analyzer comes first in every other task
    "analyzer_ord": f"CASE WHEN (event_id % 6 < 3) = ({_TASK} % 2 = 0) THEN 0 ELSE 1 END",
    "mode": "CASE WHEN event_id % 6 < 3 THEN 'direct' ELSE 'noisy' END",
    "attempt": "CAST(event_id % 3 + 1 AS INT)",
    "call_ok": "event_id % 11 <> 0",
    "timed_out": "event_id % 6 >= 3 AND event_id % 13 = 0",
    "raw": RAW,
    "error": "CAST(NULL AS STRING)",
    "completed_at": "ts",
    "execution_time": "value",
}

RAW_OUTPUTS = {"event_id": "event_id", "raw": RAW}

LINT_RUNS = {
    "file_path": "'/srv/proj/app/f' || CAST(event_id AS STRING) || '.py'",
    "linter": "CASE event_id % 3 WHEN 0 THEN 'pylint' WHEN 1 THEN 'flake8' ELSE 'mypy' END",
    "command": "CASE event_id % 3 WHEN 0 THEN 'pylint' WHEN 1 THEN 'flake8' ELSE 'mypy' END",
    "enabled": "event_id % 3 < 2",
    "found": "event_type <> 'signup'",
    "timed_out": "event_type = 'error'",
    "returncode": "CASE WHEN value < 20 THEN 0 ELSE 2 END",
    "stdout": "'  out ' || props || chr(10)",
    "stderr": "CASE WHEN value > 60 THEN chr(9) || 'bad ' || event_type || ' ' ELSE '' END",
    "error": "CASE WHEN event_type = 'view' AND value < 5 THEN 'no permission' END",
}

# signals of several analyzers on few files, hot groups included
SIGNALS = {
    "rule_id": "event_type",
    "file_path": "'/srv/proj/app/u' || CAST(user_id % 40 AS STRING) || '.py'",
    "ord": "event_id",
    "line_number": "CAST(event_id % 300 + 1 AS INT)",
    "code_snippet": "'s' || CAST(event_id AS STRING)",
    "context": "props",
    "severity": "CASE (event_id + user_id) % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' "
    "WHEN 3 THEN 'weird' WHEN 4 THEN 'low' ELSE CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'low' END END",
    "confidence": "CAST(user_id % 10 AS DOUBLE) / 10",
    "source_detector": "event_type",
    "source_analyzer": "CASE WHEN event_id % 2 = 0 THEN 'static' ELSE 'llm' END",
}

# state of the proposals of an earlier scan, by the label of their document
PRIOR_STATE = "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'validated' ELSE 'candidate' END"

# stored proposals that lack some of their fields
STORED = {
    "value": """'{"id":"p' || CAST(doc_id AS STRING) || '","type":"t","title":"x' || CAST(quality AS STRING) || '","description":"d"'
 || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',"severity":"low","confidence":0.25'
 WHEN 2 THEN ',"state":"planned","autofixable":true,"evidence":[{"file_path":"a.py","line_number":3}]'
 ELSE ',"priority":"p0","risk_level":"high","recommendation":"r","scan_id":"s1"' END || '}'""",
}

START_STATES = {
    "id": "'p' || CAST(doc_id AS STRING)",
    "state": "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'detected' WHEN doc_id % 5 = 0 THEN 'odd' "
    "ELSE 'candidate' END",
    "updated_at": "CAST('2023-01-01 00:00:00' AS TIMESTAMP)",
}

TRANSITIONS = {
    "id": "'p' || CAST(user_id % 60 AS STRING)",
    "ts": "ts",
    "seq": "event_id",
    "new_state": "CASE event_type WHEN 'click' THEN 'candidate' WHEN 'view' THEN 'validated' "
    "WHEN 'purchase' THEN 'planned' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'rejected' ELSE 'planned' END "
    "ELSE CASE WHEN event_id % 2 = 0 THEN 'detected' ELSE 'archived' END END",
    "reason": "CASE event_id % 3 WHEN 0 THEN 'r' || CAST(event_id AS STRING) WHEN 1 THEN '' END",
}


MESSAGES = {
    "event_id": "event_id",
    "message": "'key sk-' || CAST(user_id AS STRING) || ' refused: sk-' || CAST(user_id AS STRING) || ' ' || props",
    "secret": "CASE event_id % 3 WHEN 0 THEN 'sk-' || CAST(user_id AS STRING) WHEN 1 THEN '' END",
}

# patterns for the path queries, with wildcards, case and substrings
MATCH_PATTERNS = ("node_modules", "*.min.js", "SRC1*", "*/src1*", "VENDOR", "*.PY", "*.ph[!x]", "f1?.p[hy]*", "app/f2")
INCLUDE = (" src1 ", "app\\f2", "")
EXCLUDE = ("*7.py", "node_modules", "*.ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(df: DataFrame, adapter: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in adapter.items()])


def as_sql(adapter: dict[str, str], source: str, where: str = "") -> str:
    columns = ",\n ".join(f"{expression} AS {name}" for name, expression in adapter.items())
    return f"SELECT {columns}\nFROM {source} {where}".strip()


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream. As a glob the path may be one file as well as a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


# ---- streams: which rows arrive in which of three rounds ------------------------------------------

ROUNDS = 3
ROUND = "CAST(doc_id % 3 AS INT)"
# the code line of the next document: what an edit puts there
EDITED = CORPUS | {"content": f"text || chr(10) || {CODE_LINE.replace('doc_id', '(doc_id + 1)')}"}
STALE = CORPUS | {"content": """'m = "gpt-4-old"'"""}

# file versions as (adapter, condition, round, time of change): edits beside or after the first version, and one that comes late
VERSIONS = (
    (CORPUS, "TRUE", ROUND, 10),
    (EDITED, "doc_id % 5 = 0", "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE CAST(doc_id % 3 AS INT) END", 20),
    (STALE, "doc_id % 7 = 0", "2", 5),
)

# files of a tree on disk, hidden names among them
TREE_NAME = """source || '/' || CASE doc_id % 4 WHEN 0 THEN '_f' WHEN 1 THEN '.f' WHEN 2 THEN '__init__' ELSE 'f' END
 || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.php' WHEN 2 THEN '.js' WHEN 3 THEN '.ts' ELSE '.md' END"""
TREE_EDIT = """text || chr(10) || 'org_id = "edited"'"""
# (condition, content or null where the file is deleted) of each round
TREE_ROUNDS = (
    (("doc_id % 3 <> 2", "text"),),
    (("doc_id % 3 = 2", "text"), ("doc_id % 3 <> 2 AND doc_id % 5 = 0", TREE_EDIT)),
    (("doc_id % 7 = 0", "CAST(NULL AS STRING)"),),
)
