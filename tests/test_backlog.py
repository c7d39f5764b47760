import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import backlog as B
from sparkwarden.operators.hypotheses import build_hypotheses, signal_chunks
from sparkwarden.operators.proposals import build_proposals
from sparkwarden.operators.skew import number_rows
from sparkwarden.operators.trace import validation_events
from sparkwarden.operators.transitions import ALLOWED_TRANSITIONS, judge_requests, move_states
from sparkwarden.sources import stores

FIRST, SECOND = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
FILES = {"a.py": 'm = "gpt-4", "claude-3"\norg_id = "acme"', "b.py": 'u = "http://localhost"'}


def empty(spark):
    return spark.createDataFrame([], B.PROPOSAL_SCHEMA)


def test_upsert_is_idempotent_and_keeps_state(spark, corpus):
    hits = build_proposals(corpus(FILES), FIRST, "s1")
    once = B.upsert_backlog(empty(spark), hits, FIRST)
    assert hits.count() == 4 and once.count() == 3
    doubled = once.filter("type = 'hardcoded_model_names'").first()
    assert doubled.title.startswith('Hardcoded model name "gpt-4"')
    moved = once.withColumn("state", F.lit("candidate")).withColumn("severity", F.lit("odd"))
    again = build_proposals(corpus({**FILES, "c.py": 'm = "phi-3"', "b.py": "clean"}), SECOND, "s2")
    rows = {r.evidence[0].file_path[-4:] + r.type[:11]: r for r in B.upsert_backlog(moved, again, SECOND).collect()}
    assert len(rows) == 4
    kept = rows["a.pyhardcoded_m"]
    assert (kept.state, kept.severity, kept.scan_id, str(kept.created_at), str(kept.updated_at)) == ("candidate", "odd", "s2", FIRST, SECOND)
    unseen = rows["b.pyhardcoded_c"]
    assert (unseen.scan_id, str(unseen.updated_at)) == ("s1", FIRST)
    assert rows["c.pyhardcoded_m"].state == "detected"
    no_scan = build_proposals(corpus(FILES), SECOND, None)
    assert {r.scan_id for r in B.upsert_backlog(once, no_scan, SECOND).collect()} == {"s1"}


def test_lookup_list_and_summary(spark, corpus):
    hits = build_proposals(corpus(FILES), FIRST, "s1")
    stored = B.upsert_backlog(empty(spark), hits, FIRST)
    some = stored.first().id
    assert B.get_proposals(stored, some).count() == 1 and B.get_proposals(stored, "none").count() == 0
    assert B.list_backlog(stored, "detected").count() == 3 and B.list_backlog(stored, "planned").count() == 0
    with pytest.raises(ValueError):
        B.list_backlog(stored, "nonsense")
    assert [tuple(r) for r in B.scan_summary(hits).select("scan_id", "proposal_count").collect()] == [("s1", 4)]
    assert B.scan_summary(build_proposals(corpus(FILES), FIRST, None)).count() == 0


def test_stores(spark, corpus, tmp_path):
    assert stores.read_backlog(spark, f"{tmp_path}/none").count() == 0
    stored = B.upsert_backlog(empty(spark), build_proposals(corpus(FILES), FIRST, "s1"), FIRST)
    assert stores.write_backlog(stored, f"{tmp_path}/v1").count() == 3
    assert stores.read_backlog(spark, f"{tmp_path}/v1").count() == 3
    (tmp_path / "index.json").write_text('{"proposals": {"x": {"id": "x", "type": "t",\n "title": "T", "description": "D"}}}')
    row = stores.import_json_index(spark, f"{tmp_path}/index.json").first()
    assert (row.id, row.severity, row.priority, row.confidence, row.state, row.evidence) == ("x", "medium", "p2", 0.5, "detected", [])
    (tmp_path / "bad.json").write_text("{nope")
    assert stores.import_json_index(spark, f"{tmp_path}/bad.json").count() == 0
    scans = tmp_path / "scans"
    scans.mkdir()
    (scans / "s1.json").write_text('{"scan_id": "s1",\n "timestamp": "t1", "proposal_count": 4, "proposals": []}')
    (scans / "s2.json").write_text("{}")
    (scans / "s3.json").write_text("{broken")
    listed = stores.list_scan_documents(spark, str(scans)).collect()
    assert [tuple(r) for r in listed] == [("s2", "", 0), ("s1", "t1", 4)]
    folder = tmp_path / "reports"
    folder.mkdir()
    meta = '"timestamp":"t","project_path":"p","platform":"x","total_files":1,"total_findings":2'
    (folder / "audit_a.json").write_text('{"metadata": {%s,"critical_findings":3},\n "results": []}' % meta)
    (folder / "audit_b.json").write_text('{"metadata": {%s}, "results": []}' % meta)
    (folder / "audit_c.json").write_text("nothing")
    assert [r.filename for r in stores.list_report_documents(spark, str(folder)).collect()] == ["audit_a.json"]


def replay(states, log):
    states, out = dict(states), {}
    for key, ts, seq, new, _ in sorted(log, key=lambda r: (r[1], r[2])):
        old = states.get(key)
        fits = new in ALLOWED_TRANSITIONS.get(old, ())
        if new not in ALLOWED_TRANSITIONS:
            refusal = "invalid_state"
        elif key not in states:
            refusal = "not_found"
        else:
            refusal = None if fits else "not_allowed"
        out[seq] = (old, refusal is None, refusal)
        if refusal is None:
            states[key] = new
    return states, out


def test_transitions_equal_a_replay(spark):
    draw = random.Random(9)
    names = list(ALLOWED_TRANSITIONS) + ["archived"]
    states = {f"p{i}": draw.choice(names) for i in range(40)}
    ids = [f"p{i}" for i in range(45)]
    # one id holds a third of the log
    log = [
        ("p0" if draw.random() < 0.33 else draw.choice(ids + [None] * 4), draw.randint(0, 50), n, draw.choice(names + ["planned", "validated"]), None)
        for n in range(900)
    ]
    states["p0"] = "detected"
    backlog = spark.createDataFrame([(k, v, 0) for k, v in states.items()], "id STRING, state STRING, updated_at INT")
    frame = spark.createDataFrame(log, "id STRING, ts INT, seq BIGINT, new_state STRING, reason STRING")
    judged = judge_requests(backlog, frame).cache()
    after, want = replay(states, log)
    assert {r.seq: (r.from_state, r.accepted, r.refusal) for r in judged.collect()} == want
    assert {r.id: r.state for r in move_states(backlog, judged).collect()} == after


def test_one_hot_id_among_many(spark):
    draw = random.Random(12)
    names = ["detected", "candidate", "validated", "planned", "rejected", "odd"]
    ids = ["hot"] + [f"w{i}" for i in range(10_000)]
    states = {k: draw.choice(names[:2]) for k in ids}
    # the hot id holds nine tenths of the log; ties of time and number are settled by what is asked for
    log = [("hot", draw.randint(0, 9), n % 50, draw.choice(names), None) for n in range(90_000)]
    log += [(k, n, n, draw.choice(names), None) for n, k in enumerate(ids[1:])]
    log = sorted({r[:4] for r in log}, key=lambda r: r[1:])
    backlog = spark.createDataFrame([(k, v, 0) for k, v in states.items()], "id STRING, state STRING, updated_at INT")
    frame = spark.createDataFrame([(*r, None) for r in log], "id STRING, ts INT, seq BIGINT, new_state STRING, reason STRING")
    judged = judge_requests(backlog, frame)
    after, want = replay(states, [(k, ts, n, new, None) for n, (k, ts, _, new) in enumerate(log)])
    place = {(k, ts, seq, new): want[n] for n, (k, ts, seq, new) in enumerate(log)}
    assert {(r.id, r.ts, r.seq, r.new_state): (r.from_state, r.accepted, r.refusal) for r in judged.collect()} == place
    assert {r.id: r.state for r in move_states(backlog, judged).collect()} == after


def test_validation_events(spark):
    rows = [("a", 1, 1, "validated", "fine", True), ("b", 1, 2, "rejected", "", True), ("c", 1, 3, "planned", "x", True), ("d", 1, 4, "rejected", "x", False)]
    judged = spark.createDataFrame(rows, "id STRING, ts INT, seq INT, new_state STRING, reason STRING, accepted BOOLEAN")
    events = sorted(r.payload for r in validation_events(judged).collect())
    assert events == ['{"proposal_id":"a","decision":"validated","reason":"fine"}', '{"proposal_id":"b","decision":"rejected"}']


def test_hypotheses(spark):
    rows = [
        ("r", "f", 1, 10, "low", 0.3), ("r", "f", 2, 11, "high", 0.9), ("r", "f", 3, 12, "high", 0.6),
        ("r", "g", 1, None, "weird", 0.5), ("r", "g", 2, 1, "low", 0.5), ("q", "f", 1, 1, "medium", 0.2),
    ]
    frame = spark.createDataFrame(rows, "rule_id STRING, file_path STRING, ord INT, line_number INT, severity STRING, confidence DOUBLE")
    frame = frame.withColumns({"code_snippet": F.lit("s"), "context": F.lit("c"), "source_detector": F.lit("d")})
    got = {(r.rule_id, r.file_path): r for r in build_hypotheses(frame).collect()}
    assert len(got) == 3
    first = got["r", "f"]
    assert (first.severity, round(first.confidence, 9), first.signal_count, first.primary_signal.line_number) == ("high", 0.6, 3, 10)
    # unknown ranks with the lowest, and the earlier one stays
    assert got["r", "g"].severity == "weird"
    chunks = signal_chunks(frame, per_chunk=2).orderBy("rule_id", "file_path", "chunk").collect()
    assert [(c.rule_id, c.file_path, c.chunk, [s.ord for s in c.signals]) for c in chunks] == [
        ("q", "f", 0, [1]), ("r", "f", 0, [1, 2]), ("r", "f", 1, [3]), ("r", "g", 0, [1, 2])
    ]


def test_number_rows(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", (i * 37) % 11, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k STRING, t INT, n INT")
    got = {r.n: (r.at, r.total) for r in number_rows(frame, ["k"], ["t", "n"], "at", "total").collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for place, row in enumerate(ordered, 1):
            assert got[row[2]] == (place, len(ordered))

