"""Weights, scores and ranks against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from sparkwarden.llm import resample as R

SCHEMA = "doc_id long, text string, rank string, score double"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=25, least=20, seed=7, longest=2):
    count = lambda texts: Counter(crc32(f.encode()) % 10000 for t in texts for f in features(t, longest)[1])
    s, t = count(x for _, x in docs), count(target)
    every, wanted = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * every / ((s[b] + 1) * wanted))) for b in s}
    rows, drawn = [], []
    for i, text in docs:
        words, found = features(text, longest)
        weight = sum(gain[crc32(f.encode()) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None])
        if len(words) >= least:
            drawn.append(rows[-1])
    drawn.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = rank
    return sorted(map(repr, rows))


def got(df):
    return sorted(repr(list(r)) for r in df.collect())


def texts(seed, count):
    draw = random.Random(seed)
    vocabulary = ["Alpha", "beta", "ÄRGER", "x1", "ſ", "K", "9", "the", "of"] + [f"w{i}" for i in range(300)]
    return [" ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 19, 20, 21, 60]))) + draw.choice(["", ".", "\x00", "\n— "]) for _ in range(count)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_in_pieces(longest):
    long_word = "x" * 50
    for text in [*texts(1, 40), "", " ", "one", f"{long_word} a {long_word}{long_word} B", "a,b;C  d--e"]:
        want = Counter(crc32(f.encode()) for f in features(text, longest)[1])
        for size in (1, 7, 40, 1 << 18):
            found = list(R.feature_hashes(text.encode(), longest, size))
            assert Counter(x for _, h in found for x in h.tolist()) == want
            assert sum(n for n, _ in found) == len(features(text, longest)[0])


def test_resampled_equals_brute_force(spark):
    docs = list(enumerate(texts(2, 300)))
    docs += [(1000, None), (1001, ""), (None, docs[6][1]), (None, " ".join(["b"] * 30)), *docs[:7], (3, "c " * 40)]
    target = [t for t in texts(3, 30)] + [None, ""]
    df = spark.createDataFrame([(i, t, "r", 0.5) for i, t in docs], SCHEMA).repartition(7)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    assert got(R.resampled(df, goal)) == brute(docs, target)
    settings = R.Settings(percent=100, longest=3, least_words=1, seed=3, runs=3)
    assert got(R.resampled(df, goal, settings)) == brute(docs, target, 100, 1, 3, 3)


def test_very_long_text(spark):
    text = "Lorem ipsum 7 dolor " * 200_000
    rows = R.resampled(spark.createDataFrame([(1, text, "", 0.0)], SCHEMA), spark.createDataFrame([("lorem ipsum",)], "text string")).collect()
    assert [r.n_features for r in rows] == [2 * 800_000 - 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a " * 30, "", 0.0)], SCHEMA)
    assert R.resampled(none, none).count() == 0 == R.resampled(none, some).count()
    assert got(R.resampled(some, none)) == brute([(1, "a " * 30)], [])
    assert R.resampled(some, none).dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]


def test_ranks_of_many_runs_and_a_hot_key(spark):
    """Half of the rows share one key; segments stay within twice their share, ranks are exact."""
    rng = np.random.default_rng(5)
    scores = np.where(rng.random(6000) < 0.5, 7, rng.integers(-40, 40, 6000)).tolist()
    ids = [3 if s == 7 else i for i, s in enumerate(scores)]
    rows = spark.createDataFrame([(i, 1, 2, s) for i, s in zip(ids, scores)], "doc_id long, n_features long, weight long, score long").repartition(12)
    runs = R.sorted_runs(rows, 1000)
    lengths = {r.run: r["count"] for r in runs.groupBy("run").count().collect()}
    splitters = R.regular_splitters(runs, lengths)
    assert splitters == sorted(splitters) and len(splitters) == len(lengths) - 1 > 1
    sizes = [r["count"] for r in R.with_segments(runs, splitters).groupBy("segment").count().collect()]
    assert len(sizes) == len(lengths) and max(sizes) <= 2 * 6000 / len(lengths) + len(lengths)
    for percent in (0, 10, 60, 100):
        found = [tuple(r) for r in R.drawn_ranks(rows, percent, 1000).select("rank", "score", "doc_id").collect()]
        want = sorted(zip(scores, ids), key=lambda x: (-x[0], x[1]))[: 6000 * percent // 100]
        assert [(s, i) for _, s, i in sorted(f for f in found if f[0] is not None)] == want
        assert sorted(f[0] for f in found if f[0] is not None) == list(range(1, len(want) + 1)) and len(found) == 6000
