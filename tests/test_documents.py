"""Report documents: nested, replaced as a whole, unharmed by a job that fails."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden.sources import documents, stores

META = (
    "run_id STRING, report_file STRING, timestamp STRING, project_path STRING, platform STRING, total_files BIGINT, "
    "total_findings BIGINT, critical_findings BIGINT, extra INT"
)


def meta_of(spark, *rows):
    return spark.createDataFrame([(run, name, at, "/p", "x", 1, n, 0, 5) for run, name, at, n in rows], META)


def results_of(spark, rows):
    schema = "run_id STRING, file_path STRING, analysis_type STRING, success BOOLEAN, found STRING, error STRING, value STRING"
    df = spark.createDataFrame([(*row, "clash") for row in rows], schema)
    return df.withColumn("findings", F.try_variant_get(F.try_parse_json("found"), "$", "array<variant>"))


def stored(folder):
    return {p.name: json.loads(p.read_text()) for p in folder.iterdir() if p.name.endswith(".json")}


def test_documents_are_nested_ordered_and_replaced(spark, tmp_path):
    folder = tmp_path / "reports"
    rows = [
        ("r1", "b", "t", True, '[{"severity":"high","text":"a\\nb,\\n"}]', None), ("r1", "a", "u", False, "[]", "no\nway"),
        ("r1", "a", "t", True, "[1,2]", ""), (None, "n", "t", True, "[]", None), ("lost", "x", "t", True, "[]", None),
    ] + [("hot", f"f{i:04}", "t", True, "[]", "é" * (i % 50)) for i in range(3000)]
    meta = meta_of(spark, ("r1", "audit_1.json", "t1", 3), (None, "audit_n.json", "t1", 0), ("none", "audit_e.json", "t1", 0), ("hot", "audit_h.json", "t1", 0))
    for _ in range(2):
        documents.write_report_documents(meta, results_of(spark, rows).repartition(7), str(folder))
    got = stored(folder)
    assert sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc")) == sorted(got)
    assert [(r["file_path"], r["analysis_type"]) for r in got["audit_1.json"]["results"]] == [("a", "t"), ("a", "u"), ("b", "t")]
    assert got["audit_1.json"]["results"][2] == {
        "file_path": "b", "analysis_type": "t", "success": True, "findings": [{"severity": "high", "text": "a\nb,\n"}]
    }
    assert got["audit_1.json"]["metadata"] == {
        "timestamp": "t1", "project_path": "/p", "platform": "x", "total_files": 1, "total_findings": 3, "critical_findings": 0
    }
    assert [r["file_path"] for r in got["audit_h.json"]["results"]] == [f"f{i:04}" for i in range(3000)]
    assert got["audit_e.json"]["results"] == [] and [r["file_path"] for r in got["audit_n.json"]["results"]] == ["n"]
    listed = stores.list_report_documents(spark, str(folder)).collect()
    assert [r.filename for r in listed] == ["audit_n.json", "audit_h.json", "audit_e.json", "audit_1.json"]
    read_meta, read_rows = documents.read_report_documents(spark, str(folder))
    assert read_meta.count() == 4 and read_rows.count() == 3004
    one_meta, one_rows = documents.read_report_documents(spark, str(folder), "audit_1.json")
    assert one_meta.first().total_findings == 3
    assert sorted((r.file_path, r.error, r.n) for r in one_rows.select("file_path", "error", F.size("findings").alias("n")).collect()
                  ) == [("a", "", 2), ("a", "no\nway", 0), ("b", None, 1)]


def test_one_name_keeps_the_latest_run_and_a_failing_job_changes_nothing(spark, tmp_path):
    folder = tmp_path / "reports"
    rows = results_of(spark, [("r1", "a", "t", True, "[]", None), ("r2", "b", "t", True, "[]", None)])
    documents.write_report_documents(meta_of(spark, ("r2", "audit_1.json", "t2", 1), ("r1", "audit_1.json", "t1", 2)), rows, str(folder))
    before = stored(folder)
    assert [r["file_path"] for r in before["audit_1.json"]["results"]] == ["b"]
    for bad in ("a/b.json", "", None, "_x.json"):
        with pytest.raises(Exception, match="not a name"):
            documents.write_report_documents(meta_of(spark, ("r1", "audit_1.json", "t3", 9), ("r2", bad, "t", 1)), rows, str(folder))
        assert stored(folder) == before and not [p for p in folder.iterdir() if p.is_dir()]


def test_nothing_to_write(spark, tmp_path):
    documents.write_report_documents(meta_of(spark).limit(0), results_of(spark, []), str(tmp_path / "none"))
    documents.write_report_documents(meta_of(spark, ("r", "audit_r.json", "t", 0)), results_of(spark, []), str(tmp_path / "some"))
    assert stored(tmp_path / "some")["audit_r.json"]["results"] == []


def test_blocks_of_any_size_give_the_same_rows(tmp_path, monkeypatch):
    lines = [f'{{"a":{i}}}' for i in range(40)]
    for number, part in enumerate((lines[:3], [], lines[3:4], lines[4:])):
        (tmp_path / f"part-0000{number}-x.txt").write_text("".join(f"{line}\n" for line in part))
    (tmp_path / "_SUCCESS").write_text("")
    for size in (1, 2, 7, 8, 9, 1000):
        monkeypatch.setattr(documents, "BLOCK", size)
        assert json.loads(b"[" + b"".join(documents.rows_of(str(tmp_path))) + b"]") == [{"a": i} for i in range(40)]
