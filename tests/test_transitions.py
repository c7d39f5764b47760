"""State requests as composed functions over ranges of the log."""

import random

import numpy as np
import pytest
from test_backlog import replay

from sparkwarden.operators import transitions as T

SCHEMA = "id STRING, ts INT, seq BIGINT, new_state STRING, reason STRING"
NAMES = [*T.STATES, "archived"]


@pytest.fixture
def many_ranges(spark):
    """Ranges as the planner cuts them, small ones not put together."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, "true")


def test_prefixes_equal_one_after_the_other():
    rng = np.random.default_rng(1)
    table = T._functions()
    codes = rng.integers(0, len(table), 500)
    begins = rng.random(500) < 0.02
    begins[0] = True
    first = np.maximum.accumulate(np.where(begins, np.arange(500), 0))
    got = T.prefixes(table[codes], np.arange(500) - first)
    for i in range(500):
        for state in range(T.WIDTH):
            now = state
            for k in range(first[i], i + 1):
                now = table[codes[k]][now]
            assert got[i][state] == now


def judged(spark, states, log):
    backlog = spark.createDataFrame([(k, v, 0) for k, v in states.items()], "id STRING, state STRING, updated_at INT")
    return T.judge_requests(backlog, spark.createDataFrame(log, SCHEMA).repartition(3))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_ids_over_several_ranges(many_ranges, seed):
    draw = random.Random(seed)
    # long ids, of known and unknown start states and of none, that go on over ranges; most requests change nothing
    states = {"a": "detected", "b": draw.choice(NAMES), "c": "odd", **{f"p{i}": draw.choice(NAMES) for i in range(30)}}
    hot = draw.choice("abcz")
    asked = ["detected", "archived", None] * 30 + NAMES
    log = [(hot if draw.random() < 0.9 else draw.choice([*states, "nobody", None]), n // 7, n, draw.choice(asked), None) for n in range(1500)]
    got = judged(many_ranges, states, log)
    _, want = replay(states, log)
    assert {r.seq: (r.from_state, r.accepted, r.refusal) for r in got.collect()} == want


def test_ranges_split_a_hot_id(many_ranges):
    spark = many_ranges
    log = spark.createDataFrame([("hot" if n % 10 else f"p{n}", n, n, "archived", None) for n in range(4000)], SCHEMA)
    asked = log.repartitionByRange("id", "ts", "seq").selectExpr("id", "spark_partition_id() AS part").filter("id = 'hot'")
    assert asked.select("part").distinct().count() >= 3


def test_repeated_requests_find_the_same_state(many_ranges):
    log = [("a", 1, 1, "candidate", r) for r in "xyz"] * 40 + [("a", 1, 2, "validated", "v"), ("a", None, None, None, None)]
    rows = judged(many_ranges, {"a": "detected"}, log).collect()
    assert {(r.new_state, r.from_state, r.accepted) for r in rows} == {("candidate", "detected", True), ("validated", "candidate", True), (None, "detected", False)}
    assert len(rows) == len(log)


def test_one_range_exchange_and_no_join_of_the_log(spark, capsys):
    backlog = spark.range(100).selectExpr("string(id) AS id", "'detected' AS state", "0 AS updated_at")
    log = spark.range(1000).selectExpr("string(id % 100) AS id", "int(id) AS ts", "id AS seq", "'candidate' AS new_state", "string(null) AS reason")
    judged = T.judge_requests(backlog, log)
    judged.explain("simple")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert judged.filter("accepted").count() == 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    empty = spark.createDataFrame([], "id STRING, state STRING, updated_at INT")
    assert T.judge_requests(empty, none).count() == 0
    assert [tuple(r) for r in judged(spark, {"x": "planned"}, [("y", 1, 1, "rejected", None)]).collect()] == [("y", 1, 1, "rejected", None, None, False, "not_found")]
