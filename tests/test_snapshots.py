"""Sightings folded into versioned snapshots; versions of files in any order."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import backlog as B
from sparkwarden.operators.hypotheses import build_hypotheses
from sparkwarden.operators.proposals import build_proposals, signals_of
from sparkwarden.streaming import jobs
from sparkwarden.streaming import snapshots as S

LATER = "2024-03-01 00:00:00"


def rows(df):
    return sorted(map(str, df.select(*B.PROPOSAL_FIELDS).collect()))


def batch(spark, corpus, out, number, files):
    build_proposals(corpus(files), LATER, "s1").write.mode("overwrite").parquet(f"{out}/batch_id={number}")


@pytest.fixture
def history(spark, corpus, tmp_path):
    """A backlog and four stored batches; files come back in later ones."""
    draw = random.Random(3)
    text = lambda: "\n".join(draw.choice(['m = "gpt-4"', 'org_id = "acme"', 'u = "http://localhost"', "clean"]) for _ in range(6))
    empty = spark.createDataFrame([], B.PROPOSAL_SCHEMA)
    prior = B.upsert_backlog(empty, build_proposals(corpus({f"f{i}.py": text() for i in range(6)}), "2024-01-01 00:00:00", "s0"))
    prior = prior.withColumn("state", F.lit("planned"))
    prior.write.parquet(f"{tmp_path}/prior")
    out = f"{tmp_path}/out"
    for number in range(4):
        batch(spark, corpus, out, number, {f"f{draw.randrange(12)}.py": text() for _ in range(5)})
    return spark.read.schema(B.PROPOSAL_SCHEMA).parquet(f"{tmp_path}/prior"), out, f"{tmp_path}/snapshot"


def test_folds_equal_one_upsert(spark, history):
    prior, out, snapshot = history
    want = rows(B.upsert_backlog(prior, jobs.sightings(spark, out)))
    S.create_snapshot(prior, snapshot, buckets=4)
    assert rows(S.current_backlog(spark, snapshot, out)) == want
    for up_to, reached in ((1, 1), (1, 1), (3, 3), (None, 4), (None, 4)):
        assert S.fold(spark, snapshot, out, up_to) == reached
        assert rows(S.current_backlog(spark, snapshot, out)) == want
    assert rows(S.read_snapshot(spark, snapshot)) == want
    # three folds took batches in, the others changed nothing
    assert S._newest(spark, snapshot).version == 4
    some = S.read_snapshot(spark, snapshot).first().id
    assert [r.id for r in S.get_from_snapshot(spark, snapshot, some).collect()] == [some]
    assert S.get_from_snapshot(spark, snapshot, "nobody").count() == 0


def test_fold_that_breaks_off(spark, history, monkeypatch):
    prior, out, snapshot = history
    S.create_snapshot(prior, snapshot, buckets=4)
    before = rows(S.read_snapshot(spark, snapshot))
    want = rows(S.current_backlog(spark, snapshot, out))
    # buckets are written, the manifest is not
    S.fold(spark, snapshot, out, 2)
    shutil.rmtree(f"{snapshot}/manifest/version=2")
    assert rows(S.read_snapshot(spark, snapshot)) == before
    assert rows(S.current_backlog(spark, snapshot, out)) == want
    # another fold takes more batches and writes over what was left
    assert S.fold(spark, snapshot, out) == 4
    assert rows(S.read_snapshot(spark, snapshot)) == want


def test_folded_batches_are_not_read_again(spark, corpus, history):
    prior, out, snapshot = history
    S.create_snapshot(prior, snapshot, buckets=4)
    want = rows(S.current_backlog(spark, snapshot, out))
    S.fold(spark, snapshot, out, 3)
    for number in range(3):
        shutil.rmtree(f"{out}/batch_id={number}")
    assert rows(S.current_backlog(spark, snapshot, out)) == want


def test_few_ids_touch_few_buckets(spark, corpus, history):
    prior, out, snapshot = history
    S.create_snapshot(prior, snapshot, buckets=16)
    S.fold(spark, snapshot, out)
    batch(spark, corpus, out, 4, {"one.py": 'm = "gpt-4"'})
    version = S._newest(spark, snapshot).version
    S.fold(spark, snapshot, out)
    assert S._newest(spark, snapshot).buckets.count(version + 1) == 1


def test_nothing_to_fold(spark, tmp_path):
    assert S.fold(spark, f"{tmp_path}/none", f"{tmp_path}/out") == 0
    assert S.read_snapshot(spark, f"{tmp_path}/none").count() == 0 == S.current_backlog(spark, f"{tmp_path}/none", f"{tmp_path}/out").count()


VERSIONED = "root STRING, file_path STRING, content STRING, modified BIGINT, listing BIGINT, deleted BOOLEAN"


def store_versions(spark, tmp_path, name, batches, compact_every):
    source, out = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}"
    for k, part in enumerate(batches):
        spark.createDataFrame(part, VERSIONED).repartition(3).write.parquet(f"{source}/r{k}")
        stream = spark.readStream.schema(VERSIONED).parquet(f"{source}/r*")
        jobs.hypothesis_stream(stream, out, f"{tmp_path}/{name}-ck", "2024-01-01 00:00:00", compact_every=compact_every).awaitTermination()
    return out


def test_newest_version_counts_in_any_order(spark, corpus, tmp_path):
    draw = random.Random(8)
    lines = ['m = "gpt-4"', 'org_id = "acme"', 'u = "http://localhost"', "clean", 'system_prompt = "claude"']
    versions = []
    for i in range(8):
        for v in range(5):
            gone = draw.random() < 0.15
            text = None if gone else "\n".join(draw.choices(lines, k=4))
            versions.append(("/srv/p", f"/srv/p/f{i}.py", text, v, v // 2, gone))
    last = {v[1]: v for v in versions}
    now = {p[7:]: v[2] for p, v in last.items() if not v[5]}
    draw.shuffle(versions)
    # some come twice, in one batch and in two
    batches = [versions[k * 8 : k * 8 + 8] + versions[:3] + versions[:1] for k in range(5)]
    out = store_versions(spark, tmp_path, "v", batches, 2)
    want = build_hypotheses(signals_of(build_proposals(corpus(now), "2024-01-01 00:00:00")))
    got = jobs.latest_hypotheses(spark, out).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # batches before the last compaction are not read any more
    for part in ("files", "hypotheses"):
        for number in range(4):
            shutil.rmtree(f"{out}/{part}/batch_id={number}")
    got = jobs.latest_hypotheses(spark, out).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_equally_new_versions_are_told_apart_by_content(spark, tmp_path):
    """Two contents of one time in one batch: the same one is chosen on every run."""
    part = [("/r", "/r/a.py", text, 1, 1, False) for text in ('m = "gpt-4"', 'org_id = "acme"')]
    found = {str(jobs.latest_hypotheses(spark, store_versions(spark, tmp_path, f"t{k}", [part[:: 1 - 2 * k]], 9)).collect()) for k in range(2)}
    assert len(found) == 1
