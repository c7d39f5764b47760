import json

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import plugins, tasks
from sparkwarden.operators import backlog as B
from sparkwarden.plans.audit import audit_run
from sparkwarden.plans.lifecycle import apply_requests
from sparkwarden.plans.scan import proposal_scan
from sparkwarden.sources.config import AuditConfig, default_config
from sparkwarden.sources.tree import list_tree, read_tree

FIRST, SECOND = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
FILES = {
    "src/a.py": 'model_name = "gpt-4"\nproject_id = "acme"\n', "src/b.php": 'u = "http://localhost"', "c.md": 'm = "gpt-4"',
    "node_modules/d.py": 'm = "gpt-4"', "src/clean.py": "x = 1",
}


def config(**changes):
    return AuditConfig(default_config().data | changes)


def test_scan_twice_is_scan_once(spark, corpus):
    nothing = spark.createDataFrame([], B.PROPOSAL_SCHEMA)
    one = proposal_scan(corpus(FILES), nothing, config(), "s1", FIRST, "/srv/p")
    assert one.proposals.count() == 3 and one.backlog.count() == 3 and one.hypotheses.count() == 3
    assert [tuple(r) for r in one.summary.select("scan_id", "proposal_count").collect()] == [("s1", 3)]
    kinds = [r.type for r in one.trace.collect()]
    assert sorted(set(kinds)) == ["proposal.generated", "proposal.scan.end", "proposal.scan.start", "proposal.violation"]
    assert len(kinds) == 8
    stored = one.backlog.cache()
    wanted = stored.filter("type = 'hardcoded_constants'").first().id
    log = spark.createDataFrame([(wanted, 1, 1, "candidate", None), (wanted, 2, 2, "rejected", "no")], "id STRING, ts INT, seq INT, new_state STRING, reason STRING")
    moved = apply_requests(stored.withColumn("updated_at", F.lit(0)), log)
    assert moved.trace.count() == 1 and moved.backlog.filter("state = 'rejected'").count() == 1
    kept = moved.backlog.withColumn("updated_at", F.to_timestamp(F.lit(FIRST)))
    two = proposal_scan(corpus(FILES), kept, config(), "s2", SECOND, "/srv/p")
    assert two.backlog.count() == 3 and two.backlog.filter("state = 'rejected' and scan_id = 's2'").count() == 1


def test_empty_scan_and_explicit_files(spark, corpus):
    nothing = spark.createDataFrame([], B.PROPOSAL_SCHEMA)
    assert proposal_scan(corpus({"a.py": "x"}), nothing, config(), "s", FIRST, "/srv/p").summary.count() == 0
    # a given list bypasses the filter, an empty one is no list
    listed = proposal_scan(corpus(FILES), nothing, config(), "s", FIRST, "/srv/p", wanted=["/srv/p/node_modules/d.py", "/srv/p/c.md"])
    assert listed.proposals.count() == 2
    assert proposal_scan(corpus(FILES), nothing, config(), "s", FIRST, "/srv/p", wanted=[]).proposals.count() == 3


def test_audit_run(spark, corpus):
    def answer(system, user):
        return json.dumps({"findings": [{"severity": "high", "n": len(user)}], "overall_score": 50})

    both = config(analyzers={"note": "text", "llm": {"enabled": True}, "static": {}, "other": {}})
    run = audit_run(corpus(FILES), both, "python", ["deep_scan", "nope"], "r1", FIRST, "/srv/p", {"llm": answer})
    got = {(r.file_path[7:], r.analysis_type): r for r in run.results.withColumn("n", F.size("findings")).collect()}
    assert {k: (r.success, r.n, r.score) for k, r in got.items()} == {
        ("src/a.py", "deep_scan"): (True, 3, "50"), ("src/clean.py", "deep_scan"): (True, 1, "50"),
        ("src/a.py", "nope"): (False, 0, None), ("src/clean.py", "nope"): (False, 0, None),
    }
    assert got["src/a.py", "nope"].error == tasks.UNKNOWN_TYPE
    meta = run.meta.first()
    assert (meta.total_files, meta.total_analyses, meta.successful_analyses, meta.total_findings, meta.critical_findings) == (2, 4, 2, 4, 4)
    assert meta.report_file == "audit_python_backend_20240101_000000.json"
    only = config(analyzers={"static": {"enabled": True}})
    assert audit_run(corpus(FILES), only, "python", ["deep_scan"], "r", FIRST, "/srv/p").meta.first().total_findings == 2
    with pytest.raises(RuntimeError):
        audit_run(corpus(FILES), config(analyzers={"llm": {"enabled": True}}), "python", ["deep_scan"], "r", FIRST, "/srv/p")
    with pytest.raises(ValueError):
        audit_run(corpus(FILES), only, "cobol", ["deep_scan"], "r", FIRST, "/srv/p")


def test_audit_run_with_failures(spark, corpus):
    """Unreadable files, failing calls, unusable answers, timeouts, practices, model and completion times."""
    files = corpus({"src/a.py": "a", "src/b.py": "bb", "src/gone.py": ""}).withColumn(
        "error", F.when(F.col("file_path").endswith("gone.py"), "no such file")
    )
    asked = []

    def llm(system, user):
        asked.append(user)
        if "src/b.py" in user or len(asked) < 2:
            raise RuntimeError("refused")
        return "no json" if len(asked) < 3 else '{"findings":[],"overall_score":7}'

    def aider(system, user):
        assert system == "" and "KEEP" in user and "{" not in user
        if "b.py" in user:
            raise TimeoutError("slow")
        return '{"findings":5} {"findings":[1]}'

    options = {"llm": {"max_retries": 3}, "aider": {"max_retries": 1}}
    chosen = config(analyzers=options, models=[{"id": "m", "name": "M", "type": "chat"}])
    run = audit_run(files.coalesce(1), chosen, "python", ["deep_scan"], "007", FIRST, "/srv/p", {"llm": llm, "aider": aider}, practices="KEEP", model_id="m")
    got = {r.file_path[11:]: r for r in run.results.drop("findings").collect()}
    assert (got["a.py"].success, got["a.py"].score, got["a.py"].error) == (True, "7", None)
    assert (got["b.py"].success, got["b.py"].error) == (False, "llm: Chiamata LLM fallita dopo 4 tentativi")
    assert (got["gone.py"].success, got["gone.py"].error, str(got["gone.py"].completed_at)) == (False, "no such file", FIRST)
    assert got["a.py"].completed_at is not None and got["b.py"].completed_at is not None
    meta = run.meta.first()
    assert meta.model.asDict() == {"id": "m", "name": "M", "type": "chat"} and meta.failed_analyses == 2
    empty = audit_run(files.filter("false"), config(analyzers={}, aider={"enabled": False}), "python", ["deep_scan"], "r", FIRST, "/srv/p")
    assert empty.results.count() == 0
    top = config(analyzers={}, aider={"enabled": True, "max_retries": 0})
    assert top.analyzers({"aider"}) == [("aider", "noisy")] and top.max_retries("aider") == 0


def test_usable_json():
    for raw, direct, noisy in [
        ('{"a":1}', True, True), ("{}", True, False), ("null", False, False), ("5", True, False), ("[1]", True, False),
        ('x {"a":{"b":1}} y', True, True), ("{'a':1}", False, False), ('{"a":NaN}', False, False), ("", False, False), ('{} {"a":1}', False, False),
    ]:
        assert (plugins.has_usable_json("direct", raw), plugins.has_usable_json("noisy", raw)) == (direct, noisy), raw


def test_analyzer_calls_are_repeated(spark, corpus):
    def flaky(system, user):
        raise TimeoutError("slow")

    made = tasks.with_prompts(tasks.audit_tasks(corpus({"a.py": "x"}), ["deep_scan"], default_config().type_dimension(spark, "python")))
    rows = plugins.analyze_batch(made.withColumn("run_id", F.lit("r")), "llm", 0, "direct", flaky, parallel_calls=2, attempts=3).collect()
    assert sorted((r.attempt, r.call_ok, r.timed_out, r.error) for r in rows) == [(i, False, True, "slow") for i in (1, 2, 3)]


def test_python_rule_isolates_failures(spark, corpus):
    def detect(path, content):
        if "boom" in content:
            yield {"line_number": 1}
            raise ValueError("broken")
        yield {"line_number": 2, "context": content, "severity": "low"}

    rows = plugins.python_rule(corpus({"a.py": "boom", "b.py": "fine"}), "mine", detect).collect()
    assert sorted((r.file_path[7:], r.line_number, r.severity, r.error) for r in rows) == [
        ("a.py", None, None, "broken"), ("b.py", 2, "low", None)
    ]


def test_prompts(spark, corpus):
    types = spark.createDataFrame(
        [("t", "T", "Check {file_path} {context}!")], "analysis_type STRING, type_name STRING, prompt_template STRING"
    )
    made = tasks.with_prompts(tasks.audit_tasks(corpus({"src/a.py": "x"}), ["t", "u"], types), "B" * 9000)
    rows = {r.analysis_type: r for r in made.collect()}
    assert rows["u"].prompt_user is None and rows["u"].error == tasks.UNKNOWN_TYPE
    assert rows["t"].prompt_user.startswith("Check src/a.py !\n\n") and rows["t"].prompt_user.endswith("```\nx\n```")
    assert rows["t"].prompt_system.endswith("\n" + "B" * 8000)


def test_config_file(spark, tmp_path):
    data = {"platforms": {"go": {"name": "Go", "file_extensions": [".go"], "linters": {"vet": {"enabled": True}, "x": {"enabled": False}},
                                 "analysis_types": {"a": {"name": "A", "prompt_template": "p"}}}},
            "models": [{"id": "m", "name": "M"}], "file_filtering": {"exclude_patterns": [" ", "dist\\x", 5], "default_behavior": "odd"},
            "proposal_engine": {"detectors": {"hardcoded_constants": {"enabled": False}}}, "analyzers": {}}
    (tmp_path / "c.json").write_text(json.dumps(data, indent=1))
    loaded = AuditConfig.load(spark, str(tmp_path / "c.json"))
    assert loaded.model("m")["name"] == "M" and loaded.model("n") is None and loaded.platform("py") is None
    assert loaded.platform("go").extensions == (".go",) and loaded.enabled_linters("go") == ["vet"]
    assert loaded.path_filter().exclude == ("dist/x",) and loaded.path_filter().mode == "include_all"
    assert len(loaded.rules()) == 3
    assert loaded.type_dimension(spark).count() == 1 and loaded.extension_dimension(spark).first().extension == ".go"
    with pytest.raises(RuntimeError):
        loaded.analyzers({"llm"})
    assert loaded.analyzers(set(), static_fallback=True) == [("static", "structured")]


def test_tree(spark, tmp_path):
    tree = tmp_path / "tree"
    for path, data in {"__init__.py": b"a", ".hid.py": b"b", "_priv/x.py": b"c\r\n", ".git/h.py": b"\xff", "a b#/y.ts": b"", "n.txt": b"", "Z.PY": b""}.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_bytes(data)
    (tree / "link.py").symlink_to(tree / "__init__.py")
    (tree / "loop").symlink_to(tree)
    rows = {r.file_path[len(str(tree)) + 1 :]: r.content for r in read_tree(spark, str(tree)).collect()}
    assert rows == {"__init__.py": "a", ".hid.py": "b", "_priv/x.py": "c\n", ".git/h.py": "�", "a b#/y.ts": ""}
    assert list_tree(spark, str(tree), [".txt"]).count() == 1


def test_stored_scans_and_reports(spark, corpus, tmp_path):
    from sparkwarden.sources import stores
    from sparkwarden.sources.config import best_practices

    nothing = spark.createDataFrame([], B.PROPOSAL_SCHEMA)
    for name in ("s1", "s2"):
        scan = proposal_scan(corpus(FILES), nothing, config(), name, FIRST, "/srv/p")
        stores.write_scans(scan.summary, scan.proposals.drop("ord"), f"{tmp_path}/scans")
    summary, proposals = stores.read_scan(spark, f"{tmp_path}/scans", "s2")
    assert summary.first().proposal_count == 3 == proposals.count()
    assert stores.read_scan(spark, f"{tmp_path}/scans", "no")[0].count() == 0
    static = config(analyzers={"static": {"enabled": True}})
    for day in (1, 2):
        run = audit_run(corpus(FILES), static, "python", ["deep_scan"], f"r{day}", f"2024-01-0{day} 00:00:00", "/srv/p")
        stores.write_report(run.meta, run.report, f"{tmp_path}/reports")
    listed = [r.filename for r in stores.list_reports(spark, f"{tmp_path}/reports").collect()]
    assert listed == ["audit_python_backend_20240102_000000.json", "audit_python_backend_20240101_000000.json"]
    meta, results = stores.read_report(spark, f"{tmp_path}/reports", listed[0])
    assert meta.first().run_id == "r2" and results.count() == 2
    (tmp_path / "p.md").write_text("be good\n")
    assert best_practices(spark, f"{tmp_path}/none.md", f"{tmp_path}/p.md") == "be good\n"
    assert best_practices(spark, f"{tmp_path}/none.md") == ""


def test_scan_events_are_stored_also_of_a_scan_that_fails(spark, corpus, tmp_path):
    nothing = spark.createDataFrame([], B.PROPOSAL_SCHEMA)
    path = f"{tmp_path}/trace"

    def told():
        rows = spark.read.schema("type STRING, payload STRING").json(path).collect()
        return sorted((r.type, json.loads(r.payload).get("status"), json.loads(r.payload).get("proposal_count")) for r in rows if ".scan." in r.type)

    scan = proposal_scan(corpus(FILES), nothing, config(), "s1", FIRST, "/srv/p", trace_path=path)
    assert told() == [("proposal.scan.end", "ok", 3), ("proposal.scan.start", None, None)]
    assert sorted(map(str, spark.read.schema(scan.trace.schema).json(path).collect())) == sorted(map(str, scan.trace.collect()))
    broken = corpus(FILES).withColumn("content", F.raise_error(F.lit("cannot read")).cast("string"))
    with pytest.raises(Exception, match="cannot read"):
        proposal_scan(broken, nothing, config(), "s2", FIRST, "/srv/p", trace_path=path)
    assert told()[:2] == [("proposal.scan.end", "error", 0), ("proposal.scan.end", "ok", 3)] and len(told()) == 4


def test_tasks_without_a_call_have_a_time(spark, corpus):
    only = config(analyzers={"static": {}})
    run = audit_run(corpus(FILES), only, "python", ["deep_scan", "nope"], "r1", FIRST, "/srv/p")
    assert {str(r.completed_at) for r in run.results.collect()} == {FIRST}


def test_backlog_is_stored_for_point_lookups(spark, tmp_path):
    from pyarrow import parquet

    from sparkwarden.sources import stores

    rows = spark.range(20_000).selectExpr("md5(string(id)) AS id", "'t' AS type")
    backlog = B.with_defaults(spark.createDataFrame([], B.PROPOSAL_SCHEMA).unionByName(rows, allowMissingColumns=True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = stores.write_backlog(backlog.repartition(5), f"{tmp_path}/b")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = [parquet.ParquetFile(f).metadata.row_group(0).column(0) for f in sorted((tmp_path / "b").glob("*.parquet"))]
    ranges = sorted((g.statistics.min, g.statistics.max) for g in groups)
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    wanted = stored.first().id
    assert B.get_proposals(stored, wanted).count() == 1 and B.get_proposals(stored, "0" * 31 + "x").count() == 0
    assert sum(a <= wanted <= b for a, b in ranges) == 1


def test_rules_are_table_functions_in_sql(spark, corpus):
    def detect(path, content):
        if "boom" in content:
            raise ValueError("cannot")
        for number, line in enumerate(content.splitlines(), 1):
            yield {"line_number": number, "code_snippet": line, "context": ""}

    plugins.register_rule(spark, "every_line", "mine", detect)
    files = corpus({"a.py": "boom", "b.py": "x\ny", "c.py": "", **{f"d{i}.py": "z" for i in range(50)}}).repartition(5)
    files = files.unionByName(corpus({"n.py": None})).withColumn("rule_id", F.lit("clash"))
    want = sorted(map(str, plugins.python_rule(files, "mine", detect).collect()))
    got = spark.sql("SELECT * FROM every_line(TABLE({files}))", files=files)
    assert sorted(map(str, got.collect())) == want and len(want) == 54
    worst = spark.sql("SELECT count_if(error IS NOT NULL) AS n, count(line_number) AS hits FROM every_line(TABLE({files}))", files=files).first()
    assert (worst.n, worst.hits) == (2, 52)
    assert spark.sql("SELECT * FROM every_line(TABLE({files}))", files=files.limit(0)).count() == 0
    plan = spark.sql("SELECT * FROM every_line(TABLE({files}))", files=corpus({"a.py": "x"}))._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()
