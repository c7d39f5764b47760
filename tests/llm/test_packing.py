import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import packing as P
from sparkwarden.llm.queries import QUERIES

S = P.Settings()


def plain_pack(lengths, settings, size=None):
    """Best fit by looking at every bin, sizes foreseen by looking at every piece."""
    sizes, bins = sorted(settings.capacities), []
    least = lambda used: next(c for c in sizes if c >= used)
    queue = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for place, i in enumerate(queue):
        need = lengths[i]
        open_bins = [b for b in bins if b["size"] - b["used"] >= need]
        if open_bins:
            chosen = min(open_bins, key=lambda b: (b["size"] - b["used"], -b["last"]))
        else:

            def price(capacity):
                used = need
                for k in queue[place + 1 :]:
                    used += lengths[k] if used + lengths[k] <= capacity else 0
                return settings.cost(least(used)) / used

            fitting = [c for c in sizes if c >= need]
            best = max(size, fitting[0]) if size else min(fitting, key=lambda c: (price(c), -c))
            chosen = {"size": best, "used": 0}
            bins.append(chosen)
        chosen["used"] += need
        chosen["last"] = place
    return sorted((least(b["used"]), b["used"]) for b in bins)


def cost(bins, settings):
    return sum(settings.cost(c) for c, _ in bins)


def mixes():
    for seed in range(6):
        rng = random.Random(seed)
        yield [min(4096, int(rng.lognormvariate(5, 1.5)) + 1) for _ in range(rng.choice([1, 7, 300, 900]))]
    rng = random.Random(9)
    yield [rng.choice([300, 700, 1500, 2500]) for _ in range(400)]
    yield [1300] * 60 + [500] * 200 + [3] * 50
    yield [rng.randint(400, 1100) for _ in range(500)]


@pytest.mark.parametrize("lengths", list(mixes()))
def test_best_fit(lengths):
    told = lambda bins: sorted((c, sum(lengths[i] for i in b)) for c, b in bins)
    made = P.pack(lengths, S)
    assert sorted(i for _, b in made for i in b) == list(range(len(lengths)))
    for capacity, used in told(made):
        assert used <= capacity and all(c < used for c in S.capacities if c < capacity)
    plain = [plain_pack(lengths, S, size) for size in (None, *S.capacities)]
    for size, want in zip((None, *S.capacities), plain):
        assert told(P.best_fit(lengths, S, size)) == want
    assert cost(made, S) == min(cost(p, S) for p in plain)


def test_several_sizes_help():
    """Against the best single size cut down at the end, on mixes where no one size suits all pieces."""
    gains = []
    for lengths in list(mixes())[3:]:
        if len(lengths) < 100:
            continue
        single = min(cost(P.pack(lengths, P.Settings(capacities=(c,))), S) for c in S.capacities if c >= max(lengths))
        one = min(cost(P.best_fit(lengths, S, c), S) for c in S.capacities)
        foreseen = cost(P.best_fit(lengths, S, None), S)
        gains.append((cost(P.pack(lengths, S), S) / single, foreseen / one))
    assert all(a < 1 for a, _ in gains) and min(a for a, _ in gains) < 0.93
    assert min(b for _, b in gains) < 0.98


def test_small_bins_at_the_end():
    assert P.pack([], S) == []
    assert [c for c, _ in P.pack([4096, 4096, 300], S)] == [4096, 4096, 512]
    assert [c for c, _ in P.pack([600], S)] == [1024]


def check(rows, want):
    """Pieces cover every document once and do not overlap in their bins."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append(r)
    assert {k: sum(n for _, n in v) for k, v in docs.items()} == want
    for rs in bins.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end == rs[0].used <= rs[0].capacity in S.capacities and len({(r.capacity, r.used) for r in rs}) == 1
        assert all(c < end for c in S.capacities if c < rs[0].capacity)


def test_defined_results(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "w " * 20_000), (None, "x\ty\x0bz"), (5, " \n ")]
    docs = spark.createDataFrame([(i, t, "?") for i, t in rows], "doc_id long, text string, offset string")
    check(P.packed(docs).collect(), {1: 4, 2: 1, 3: 1, 4: 20_001, None: 4, 5: 1})
    twice = P.packed(docs.union(docs)).collect()
    assert sum(r.length for r in twice if r.doc_id == 1) == 8
    assert P.packed(docs.filter("false")).count() == 0
    none = P.packed(docs, F.when(F.col("doc_id") == 1, 9000).otherwise(0)).collect()
    assert sorted((r.start, r.length) for r in none) == [(0, 4096), (4096, 4096), (8192, 808)]


def test_shards(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 700 AS INT)) AS text")
    few = P.Settings(shard_tokens=100_000)
    rows = P.packed(docs, settings=few).collect()
    check(rows, {i: 2 + i % 700 for i in range(3000)})
    assert len({r.bin_id >> 24 for r in rows}) == 11
    bins = {r.bin_id: (r.capacity, r.used) for r in rows}
    assert sum(u for _, u in bins.values()) / sum(c for c, _ in bins.values()) > 0.97


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op10_packing"](spark, sf).collect()
    check(rows, {d.doc_id: len(re.findall("[^ \t-\r]+", d.text)) + 1 for d in docs})
    bins = {r.bin_id: (r.capacity, r.used) for r in rows}
    assert sum(u for _, u in bins.values()) / sum(c for c, _ in bins.values()) > 0.99
