"""Streaming jobs over several micro-batches agree with the batch operators."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.paths import PathFilter
from sparkwarden.operators import backlog as B
from sparkwarden.operators.hypotheses import build_hypotheses
from sparkwarden.operators.proposals import build_proposals, signals_of
from sparkwarden.operators.transitions import move_states
from sparkwarden.streaming import jobs

AS_OF = "2024-01-01 00:00:00"
SCHEMA = "root STRING, file_path STRING, content STRING"
FILES = {
    "a.py": 'm = "gpt-4", "claude-3"\norg_id = "acme"', "b.py": 'u = "http://localhost"', "c.js": 'prompt = "claude"',
    "vendor/d.py": 'm = "phi-3"', "e.md": 'm = "phi-3"', "f.ts": "clean",
}


@pytest.fixture
def arriving(spark, tmp_path):
    """Corpus files one by one: a folder of JSON parts read one per micro-batch."""
    source = tmp_path / "source"
    source.mkdir()
    for i, (path, text) in enumerate(FILES.items()):
        (source / f"{i}.json").write_text(json.dumps({"root": "/srv/p", "file_path": f"/srv/p/{path}", "content": text}))
        # files are taken in the order of their modification times
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))


def finish(query):
    query.awaitTermination()
    return query


def rows(df):
    return sorted(map(str, df.collect()))


def test_scan_and_trace(spark, corpus, arriving, tmp_path):
    keep = PathFilter(exclude=("vendor",))
    query = finish(jobs.scan_stream(arriving(), f"{tmp_path}/out", f"{tmp_path}/ck", AS_OF, "s", path_filter=keep))
    assert query.lastProgress["batchId"] >= 3
    got = jobs.read_batches(spark, f"{tmp_path}/out").drop("batch_id")
    wanted = {k: v for k, v in FILES.items() if not k.startswith(("vendor", "e."))}
    assert rows(got) == rows(build_proposals(corpus(wanted), AS_OF, "s").select(got.columns))
    finish(jobs.trace_stream(arriving(), f"{tmp_path}/trace", f"{tmp_path}/ck2", AS_OF, "s"))
    assert spark.read.json(f"{tmp_path}/trace").count() == 2 * build_proposals(corpus(FILES), AS_OF).count()


def test_hypotheses(spark, corpus, arriving, tmp_path):
    finish(jobs.hypothesis_stream(arriving(), f"{tmp_path}/out", f"{tmp_path}/ck", AS_OF))
    got = jobs.latest_hypotheses(spark, f"{tmp_path}/out")
    want = build_hypotheses(signals_of(build_proposals(corpus(FILES), AS_OF)))
    assert rows(got.select(want.columns)) == rows(want)


def test_settings_of_each_batch(spark, arriving, tmp_path):
    """Time, scan id and filter are asked for in every batch."""
    keep = lambda n: PathFilter(exclude=("*.py",)) if n > 1 else PathFilter()
    finish(jobs.scan_stream(arriving(), f"{tmp_path}/out", f"{tmp_path}/ck", lambda n: f"2024-01-0{n + 1} 00:00:00", lambda n: f"s{n}", path_filter=keep))
    got = {(r.evidence[0].file_path[7:], r.scan_id, r.created_at.day) for r in jobs.read_batches(spark, f"{tmp_path}/out").collect()}
    assert got == {("a.py", "s0", 1), ("b.py", "s1", 2), ("c.js", "s2", 3)}


def test_a_file_that_comes_again_replaces_its_hypotheses(spark, corpus, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    versions = [("a.py", FILES["a.py"]), ("b.py", FILES["b.py"]), ("a.py", FILES["a.py"]), ("b.py", "clean")]
    for i, (path, text) in enumerate(versions):
        (source / f"{i}.json").write_text(json.dumps({"root": "/srv/p", "file_path": f"/srv/p/{path}", "content": text}))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    finish(jobs.hypothesis_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", AS_OF))
    want = build_hypotheses(signals_of(build_proposals(corpus({"a.py": FILES["a.py"]}), AS_OF)))
    assert rows(jobs.latest_hypotheses(spark, f"{tmp_path}/out").select(want.columns)) == rows(want)


def test_upsert_over_batches_and_replay(spark, corpus, arriving, tmp_path):
    prior = B.upsert_backlog(spark.createDataFrame([], B.PROPOSAL_SCHEMA), build_proposals(corpus({"a.py": FILES["a.py"]}), AS_OF, "s0"), AS_OF)
    prior = prior.withColumn("state", F.lit("planned")).cache()
    later = "2024-03-01 00:00:00"
    found = build_proposals(arriving(), later, "s1")
    finish(jobs.sighting_stream(found, f"{tmp_path}/out", f"{tmp_path}/ck"))
    want = B.upsert_backlog(prior, build_proposals(corpus(FILES), later, "s1"), later)
    got = B.upsert_backlog(prior, jobs.sightings(spark, f"{tmp_path}/out"))
    assert rows(got) == rows(want)
    # the same batches once more, as after a lost checkpoint
    finish(jobs.sighting_stream(found, f"{tmp_path}/out", f"{tmp_path}/ck-new"))
    assert rows(B.upsert_backlog(prior, jobs.sightings(spark, f"{tmp_path}/out"))) == rows(want)


def test_transitions_over_batches(spark, tmp_path):
    from test_backlog import replay

    draw = random.Random(4)
    states = {f"p{i}": "detected" for i in range(5)}
    log = [(f"p{draw.randint(0, 6)}", n if n % 10 else n - 25, n, draw.choice(["candidate", "validated", "planned", "rejected", "detected"]), None) for n in range(60)]
    source = tmp_path / "log"
    source.mkdir()
    wanted, current = {}, states
    for batch in range(4):
        part = log[batch * 15 : batch * 15 + 15]
        text = "\n".join(json.dumps({"id": k, "ts": t, "seq": s, "new_state": v}) for k, t, s, v, _ in part)
        (source / f"{batch}.json").write_text(text)
        os.utime(source / f"{batch}.json", (1_700_000_000 + batch, 1_700_000_000 + batch))
        current, out = replay(current, part)
        wanted |= out
    backlog = spark.createDataFrame([(k, v, 0) for k, v in states.items()], "id STRING, state STRING, updated_at INT")
    schema = "id STRING, ts INT, seq BIGINT, new_state STRING, reason STRING"
    requests = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    # a table of all states every second batch; the log of earlier batches is out of reach
    finish(jobs.transition_stream(requests, lambda: backlog, f"{tmp_path}/out", f"{tmp_path}/ck", compact_every=2))
    assert sorted(p.name for p in (tmp_path / "out_state" / "all").iterdir()) == ["2"]
    judged = jobs.read_batches(spark, f"{tmp_path}/out")
    assert {r.seq: (r.from_state, r.accepted, r.refusal) for r in judged.collect()} == wanted
    assert {r.id: r.state for r in move_states(backlog, judged).collect()} == current


def test_requests_out_of_order_within_the_delay_are_judged_in_order(spark, tmp_path):
    from test_backlog import replay

    draw = random.Random(7)
    states = {f"p{i}": "detected" for i in range(4)}
    # a third and more of the requests are for one id; two have no time, some are repeated at the same time
    log = [(draw.choice(["p0", "p0", "p1", "p2", "p3", "no"]), n // 2, n, draw.choice(["candidate", "validated", "planned", "rejected"]), None) for n in range(100)]
    arriving = sorted(log, key=lambda r: r[1] + draw.random() * 9)
    source, schema = tmp_path / "log", "id STRING, ts INT, seq BIGINT, new_state STRING, reason STRING"
    source.mkdir()

    def arrive(number, part):
        (source / f"{number}.json").write_text("\n".join(json.dumps({"id": k, "ts": t, "seq": s, "new_state": v}) for k, t, s, v, _ in part))
        os.utime(source / f"{number}.json", (1_700_000_000 + number, 1_700_000_000 + number))

    def run():
        requests = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        finish(jobs.transition_stream(requests, backlog, f"{tmp_path}/out", f"{tmp_path}/ck", compact_every=2, delay=9))

    def judged():
        got = jobs.outcomes(spark, kinds, backlog, f"{tmp_path}/out", 9, compact_every=2).collect()
        return {r.seq: (r.from_state, r.accepted, r.refusal) for r in got}

    backlog = spark.createDataFrame([(k, v, 0) for k, v in states.items()], "id STRING, state STRING, updated_at INT")
    kinds = spark.createDataFrame([], schema).schema
    for batch in range(4):
        arrive(batch, arriving[batch * 20 : batch * 20 + 20])
    run()
    assert judged() == replay(states, arriving[:80])[1]
    # the log alone lacks what still waits
    assert 0 < jobs.read_batches(spark, f"{tmp_path}/out").count() < 80
    # a batch that broke off after it had stored its buffer is not seen, and replaces it when it is run again
    broken = f"{tmp_path}/out_state/pending/batch_id=4"
    spark.createDataFrame([("p0", 99, 999, "candidate", None)], schema).write.parquet(broken)
    assert judged() == replay(states, arriving[:80])[1]
    arrive(4, arriving[80:])
    run()
    assert judged() == replay(states, log)[1]
    # later than the delay: judged on top of what was accepted; without a time: at once
    late = [("p1", 1, 1000, "validated", None), ("p2", None, 1001, "planned", None)]
    arrive(5, late)
    run()
    assert set(judged()) == {r[2] for r in log + late}
    assert {r.seq for r in jobs.read_batches(spark, f"{tmp_path}/out").filter("batch_id = 5").collect()} >= {1000, 1001}


def test_filter_is_read_again_per_batch(spark, arriving, tmp_path):
    asked = []

    def load():
        asked.append(1)
        return PathFilter(exclude=("*.py",)) if len(asked) > 2 else PathFilter()

    finish(jobs.filtered_stream(arriving(), load, f"{tmp_path}/out", f"{tmp_path}/ck"))
    kept = {r.file_path[7:] for r in jobs.read_batches(spark, f"{tmp_path}/out").collect()}
    assert len(asked) == 6 and {"c.js", "f.ts"} <= kept and len(kept) == 4


def test_file_stream(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub dir").mkdir(parents=True)
    (tree / "sub dir" / "a.py").write_bytes(b'm = "gpt-4"\xff\r\n')
    query = jobs.file_stream(spark, str(tree)).writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c")
    finish(query.trigger(availableNow=True).start())
    row = spark.read.parquet(f"{tmp_path}/o").first()
    assert (row.file_path, row.content) == (f"{tree}/sub dir/a.py", 'm = "gpt-4"�\n')
