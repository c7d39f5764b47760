import math

import numpy as np
import pytest

from sparkwarden.llm import multi_index as M
from sparkwarden.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows, ids, most=10):
    """All pairs, one after the other."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append([float(x) for x in v])
    out = []
    for q in sorted(i for i in good if i in ids):
        mine = min(good[q])
        near = sorted((min(math.dist(mine, v) for v in vs), i) for i, vs in good.items() if i != q)
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:most], 1)]
    return out


def test_traverse_takes_cells_in_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.random(7), rng.random(5)
        sizes = rng.integers(0, 4, (7, 5))
        cells = M.traverse(x, y, sizes, 10**9)
        want = sorted(((x[i] + y[j], i, j) for i in range(7) for j in range(5) if sizes[i, j]))
        assert cells == [(i, j) for _, i, j in want]
        some = M.traverse(x, y, sizes, 12)
        assert some == cells[: len(some)] and sum(sizes[c] for c in some) >= min(12, sizes.sum())
        assert sum(sizes[c] for c in some[:-1]) < 12


def test_whole_index_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(300)]
    rows += [(300, [0.0] * 5), (301, None), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [math.nan] * 5), (304, [math.inf, 1.0, 1.0, 1.0, 1.0]), (305, []), (None, [1.0] * 5)]
    rows += [rows[10], (20, [2.0] * 5), (11, rows[12][1])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], SCHEMA)
    every = M.Settings(centroids=6, share=1.0, entry_tile=40, query_tile=7)
    got = sorted(map(tuple, M.nearest(df, df.filter("vec_id % 10 = 0"), settings=every).collect()))
    want = brute(rows, set(range(0, 400, 10)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 0.1), (100, [1.0, 2.0, 3.0], 0.1), (7, [1.0, 2.0], 0.2)], SCHEMA)
    got = sorted(map(tuple, M.nearest(df, df.filter("vec_id % 100 = 0")).collect()))
    assert got == [(0, 1, 100, 0.0), (100, 1, 0, 0.0)]
    assert M.nearest(df.filter("false"), df).count() == 0 == M.nearest(df, df.filter("false")).count()
    one = df.filter("vec_id = 0")
    assert M.nearest(one, one).count() == 0


@pytest.mark.parametrize("count,copies", [(3, 0), (11, 0), (12, 0), (19, 0), (11, 60)])
def test_few_vectors_have_complete_ranks(spark, count, copies):
    """With default settings; ``copies``: further rows of one id."""
    rng = np.random.default_rng(count)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0.0) for i in range(count)]
    df = spark.createDataFrame(rows + rows[:1] * copies, SCHEMA)
    got = sorted(map(tuple, M.nearest(df, df).collect()))
    assert [g[:2] for g in got] == [(i, k + 1) for i in range(count) for k in range(min(10, count - 1))]
    for q, _, i, score in got:
        assert math.isclose(score, math.dist(rows[q][1], rows[i][1]), rel_tol=1e-9)
    if count <= 11:
        for q in range(count):
            want = sorted((i for i in range(count) if i != q), key=lambda i: math.dist(rows[q][1], rows[i][1]))
            assert [g[2] for g in got if g[0] == q] == want


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_recall_of_the_query(spark, sf, least):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = [tuple(r)[:4] for r in QUERIES["op1_multi_index"](spark, path).collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    assert len(got) == len(want) and len({g[:2] for g in got}) == len(got)
    assert len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}) >= least * len(want)
    true = {i: [float(x) for x in v] for i, v in rows}
    for q, _, i, score in got:
        assert math.isclose(score, math.dist(true[q], true[i]), rel_tol=1e-12)
