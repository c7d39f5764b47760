"""Clusters against plain Lloyd rounds in Python integers, the tree against looking at every centroid."""

import hashlib
import math

import numpy as np
import pytest

from sparkwarden.llm import vantage as V

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance long"


def brute(rows, k, dims, rounds, scale=256, seed=2):
    kept = []
    for i, v in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) or abs(x) >= V.LARGEST / scale for x in v):
            continue
        kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((away(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                centres[j] = [sum(column) // len(own) for column in zip(*own)]
    near = assign()
    by = {j: sum(d for d, c in near if c == j) for j in range(len(centres))}
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((repr((i, c, d, by[c], sum(by.values()), told[c])) for (i, _), (d, c) in zip(kept, near)))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("leaf", [1, 2, 4, 50])
def test_search_equals_every_centroid(leaf):
    rng = np.random.default_rng(leaf)
    for dims, spread, count in ((1, 3, 30), (2, 4, 40), (3, 2, 25), (8, 1000, 33), (64, 1 << 27, 40), (2, 5, 1), (2, 1, 9)):
        centres = rng.integers(-spread, spread, (count, dims))
        vectors = np.concatenate([rng.integers(-spread, spread, (300, dims)), centres])
        number, best = V.search(vectors, centres, V.build(centres, leaf))
        every = ((vectors[:, None, :] - centres[None]) ** 2).sum(-1)
        assert (best == every.min(1)).all() and (number == every.argmin(1)).all()


def test_search_prunes():
    """With separated centroids most are never measured: the tree is entered along one path."""
    centres = np.array([[1000 * i, 0] for i in range(64)])
    tree = V.build(centres, 1)
    looked = []
    plain = V.squared
    V.squared = lambda a, b: looked.append(len(a)) or plain(a, b)
    try:
        V.search(centres, centres, tree)
    finally:
        V.squared = plain
    assert sum(looked) < 64 * 64 / 3


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 4).astype(np.float32).tolist()) for i in range(200)]
    # whole numbers tie often; copies of a vector under other ids, repeated rows, ids without value
    rows += [(i, rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(200, 300)]
    rows += [(300 + i, [0.5] * 4) for i in range(60)] + rows[:5] + [(None, [0.25] * 4), (None, [-3.0, 0.0, 0.0, 1.0])]
    rows += [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0] * 5), (404, [1.0, None, 1.0, 1.0]), (405, [math.nan] * 4), (406, [math.inf, 0.0, 0.0, 0.0]),
             (407, [1e30, 0.0, 0.0, 0.0]), (408, [5e5, 0.0, 0.0, -5e5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    for k, rounds in ((7, 3), (40, 2)):
        settings = V.Settings(clusters=k, dims=4, rounds=rounds, leaf=2)
        assert got(V.clusters(df, settings)) == brute(rows, k, 4, rounds)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(5, [0.5] * 64, "x", 1), (6, [-0.001] * 64, "x", 1)], SCHEMA)
    assert got(V.clusters(df)) == brute([(5, [0.5] * 64), (6, [-0.001] * 64)], 40, 64, 5)
    empty = V.clusters(df.filter("false"))
    assert empty.count() == 0 and empty.columns == V.clusters(df).columns
    # all vectors the same: one centroid of two equal ones gets all, the other stays
    same = spark.createDataFrame([(i, [1.0] * 64, "x", 1) for i in range(50)], SCHEMA)
    assert {(r.cluster, r.distance, r.inertia) for r in V.clusters(same).collect()} == {(0, 0, 0)}
