import json
import random

from pyspark.sql import functions as F

from sparkwarden.functions import json_text as J
from sparkwarden.operators import lint, reports
from sparkwarden.operators.responses import RESPONSE_SCHEMA, analyzer_results, audit_results, resolve_attempts


def loads(text):
    try:
        return json.loads(text)
    except ValueError:
        return ...


def same(a, b):
    return type(a) is type(b) and a == b


def test_strict_json_equals_python(spark):
    draw = random.Random(3)
    seeds = ['{"a":1}', '[1,{"b":"x"}]', '"s"', "5.5", "null", "true", '{"a":{"b":[1,2]},"a":2}', " {} ", '{"k":"a\\tb"}', "-3e2"]
    texts = list(seeds) + ["{'a':1}", '{"a":1} x', '{"a":"\t"}', "1,2", "1] [2", "", " ", "{}}", '{"a":1}]{"b":2}', "01", "+1", "1.", ".5"]
    for _ in range(1500):
        text = list(draw.choice(seeds))
        for _ in range(draw.randint(1, 3)):
            place = draw.randrange(len(text) + 1)
            if draw.random() < 0.5 and text:
                del text[min(place, len(text) - 1)]
            else:
                text.insert(place, draw.choice('{}[],:"1 ex\n'))
        texts.append("".join(text))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    rows = frame.select("i", F.to_json(J.strict_json(F.col("t"))).alias("v")).orderBy("i").collect()
    for text, row in zip(texts, rows):
        want = loads(text)
        assert (row.v is None) == (want is ...), repr(text)
        if row.v is not None:
            assert json.loads(row.v) == want, repr(text)


def noisy(raw):
    import re

    for block in re.findall(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", raw):
        if isinstance(loads(block), dict):
            return loads(block)
    whole = loads(raw.strip())
    return whole if isinstance(whole, dict) else ...


def direct(raw):
    import re

    if not raw:
        return ...
    if loads(raw) is not ...:
        return loads(raw)
    match = re.search(r"\{[\s\S]*\}", raw)
    return loads(match.group()) if match else ...


RAWS = [
    '{"findings":[{"a":1}],"overall_score":85}', 'x {"issues":[1],"quality_score":72.9} y', '{"a":1} then {"b":2}',
    '{"a":{"b":{"c":1}},"findings":[]}', '{"findings":"ab","issues":[1],"overall_score":null}', "[1,2]", '"findings x"',
    '"t"', "5", "5.5", "null", "{}", '["findings"]', "none", "true", "{'a':1}", '{"overall_score":true}',
    '{"overall_score":"85.5","security_score":3}', '{"overall_score":" 8_5 "}', '{"security_score":-4.6}', "", "}{", "{",
    '[1] {"a":1}', '{"overall_score":[1]}', '{"a":"\t"} {"b":1}', '{"findings":[],"vulnerabilities":[1]}', "  {\"a\":1}\n",
]


def test_parsers_findings_and_scores(spark):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(RAWS)], "i INT, raw STRING")
    frame = frame.withColumns({"d": J.parse_direct(F.col("raw")), "n": J.parse_noisy(F.col("raw"))})
    d, n = F.col("d"), F.col("n")
    rows = frame.select(
        "i", F.to_json("d").alias("d"), F.to_json("n").alias("n"), F.to_json(J.findings_direct(d)).alias("found"),
        J.score_direct(d).alias("score"), J.usable_direct(d).alias("ok"), J.usable_noisy(n).alias("nok"),
        J.abort_direct(d, F.col("raw")).alias("abort"),
    ).orderBy("i").collect()
    for raw, row in zip(RAWS, rows):
        parsed = direct(raw)
        assert (row.d is None) == (parsed is ...) and (row.d is None or json.loads(row.d) == parsed), raw
        other = noisy(raw)
        assert (row.n is None) == (other is ...) and (row.n is None or json.loads(row.n) == other), raw
        assert row.ok == (parsed is not ... and parsed is not None), raw
        assert row.nok == (other is not ... and bool(other)), raw
        findings, score, broken = [], None, False
        if row.ok:
            try:
                for key in J.FINDING_KEYS:
                    if key in parsed and isinstance(parsed[key], list):
                        findings = parsed[key]
                        break
                for key in J.SCORE_KEYS:
                    if key in parsed:
                        try:
                            score = int(parsed[key])
                        except (TypeError, ValueError):
                            pass
                        break
            except TypeError:
                broken = True
        assert (row.abort is not None) == broken, raw
        if not broken:
            assert json.loads(row.found) == findings and row.score == score, raw


def test_many_sibling_objects(spark):
    raw = "log " + '{"a":{"b":1}} ' * 5000
    row = spark.range(1).select(F.to_json(J.parse_noisy(F.lit(raw))).alias("n")).first()
    assert row.n == '{"a":{"b":1}}'


def responses(spark, rows):
    names = [p.split()[0] for p in RESPONSE_SCHEMA.split(", ")]
    full = []
    for row in rows:
        base = {"run_id": "r", "file_path": "f", "analysis_type": "t", "analyzer_id": "llm", "analyzer_ord": 0,
                "mode": "direct", "attempt": 1, "call_ok": True, "timed_out": False, "execution_time": 1.0} | row
        full.append(tuple(base.get(n) for n in names))
    return spark.createDataFrame(full, RESPONSE_SCHEMA)


def test_attempts(spark):
    good, none = '{"findings":[]}', "none"
    cases = {
        "first good wins": ([none, good, '{"issues":[1]}'], 2),
        "last failure stands": ([none, "x", "y"], 3),
        "beyond the limit": ([none, none, none, good], 3),
    }
    rows = [{"file_path": name, "attempt": i, "raw": raw} for name, (raws, _) in cases.items() for i, raw in enumerate(raws, 1)]
    got = {r.file_path: r.attempt for r in resolve_attempts(responses(spark, rows)).collect()}
    assert got == {name: attempt for name, (_, attempt) in cases.items()}
    slow = [
        {"analyzer_id": "aider", "mode": "noisy", "attempt": 1, "raw": none},
        {"analyzer_id": "aider", "mode": "noisy", "attempt": 2, "raw": None, "call_ok": False, "timed_out": True},
        {"analyzer_id": "aider", "mode": "noisy", "attempt": 3, "raw": good},
    ]
    assert resolve_attempts(responses(spark, slow)).first().attempt == 2
    assert not analyzer_results(resolve_attempts(responses(spark, slow))).first().success


def test_merge(spark):
    two = {"analyzer_id": "aider", "analyzer_ord": 1, "mode": "noisy"}
    rows = [
        {"file_path": "both", "raw": '{"findings":[{"a":1}],"overall_score":5}'},
        {"file_path": "both", "raw": 'log {"issues":[2],"quality_score":7}', **two},
        {"file_path": "one", "raw": "none"},
        {"file_path": "one", "raw": '{"issues":[2]}', **two},
        {"file_path": "failed", "call_ok": False, "attempt": 3},
        {"file_path": "failed", "raw": "none", **two},
        {"file_path": "silent", "raw": "none", **two},
        {"file_path": "abort", "raw": "5"},
        {"file_path": "abort", "raw": '{"issues":[2]}', **two},
    ]
    got = {r.file_path: r for r in audit_results(responses(spark, rows)).withColumn("findings", F.to_json("findings")).collect()}
    assert (got["both"].success, got["both"].findings, got["both"].score, got["both"].error) == (True, '[{"a":1},2]', "7", None)
    assert got["both"].raw_output == '{"findings":[{"a":1}],"overall_score":5}\n\nlog {"issues":[2],"quality_score":7}'
    assert (got["one"].success, got["one"].findings, got["one"].score) == (True, "[2]", None)
    assert got["failed"].error == "llm: Chiamata LLM fallita dopo 3 tentativi"
    assert got["silent"].error == "Analysis failed"
    assert (got["abort"].success, got["abort"].error) == (False, "argument of type 'int' is not iterable")


def test_report_tables(spark):
    raw = '{"findings":[{"severity":"critical","type":"T","line_number":0},{"severity":"Critical"},{"severity":"high","line_number":4},5]}'
    results = audit_results(responses(spark, [{"raw": raw}, {"file_path": "g", "raw": "none"}, {"analysis_type": "u", "raw": "{}"}]))
    meta = reports.report_metadata(results, F.to_timestamp(F.lit("2024-01-02 03:04:05"))).first()
    assert tuple(meta)[2:] == (2, 3, 2, 1, 4, 2)
    view = reports.findings_view(results.filter("file_path = 'f' and analysis_type = 't'")).orderBy("position").collect()
    assert [(r.severity, r.category, r.line_number) for r in view] == [
        ("CRITICAL", "T", None), ("CRITICAL", "General", None), ("HIGH", "General", "4"), ("MEDIUM", "General", None)
    ]
    assert reports.findings_view(results.filter("file_path = 'g'")).first().severity is None
    name = spark.range(1).select(reports.report_name(F.lit("PHP Backend"), F.to_timestamp(F.lit("2024-01-02 03:04:05")))).first()[0]
    assert name == "audit_php_backend_20240102_030405.json"
    done = sorted((r.done, r.total) for r in reports.progress(results).collect())
    assert done == [(1, 3), (2, 3), (3, 3)]


def test_linters(spark):
    schema = "file_path STRING, linter STRING, command STRING, enabled BOOLEAN, found BOOLEAN, timed_out BOOLEAN, returncode INT, stdout STRING, stderr STRING, error STRING"
    rows = [
        ("f", "a", "a", True, False, False, None, None, None, None), ("f", "b", "b", True, True, True, None, None, None, None),
        ("f", "c", "c", True, True, False, 0, " ok\n", "", None), ("f", "d", "d", True, True, False, 2, "out", " bad ", None),
        ("f", "e", "e", True, True, False, None, None, None, "boom"), ("f", "z", "z", False, True, False, 0, "", "", None),
    ]
    out = lint.lint_outcomes(spark.createDataFrame(rows, schema))
    assert {r.linter: (r.available, r.success, r.status, r.detail) for r in out.collect()} == {
        "a": (False, None, "non disponibile", "a not found in PATH"), "b": (True, False, "warning/error", "Linter timed out after 60s"),
        "c": (True, True, "ok", "ok"), "d": (True, False, "warning/error", "bad"), "e": (True, False, "warning/error", "boom"),
    }
    merged = lint.lint_by_file(out, ["c", "d"]).first().linter_results
    assert set(merged) == {"c", "d"} and merged["c"].success
