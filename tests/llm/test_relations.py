"""Components of the set-similarity join against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import relations as S
from sparkwarden.llm.common import table

SCHEMA = "doc_id long, text string, n_shingles string, component_id double"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=4):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(UPPER)).split(" ") if w]
    if len(words) < size:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(docs, percent=85):
    sets = [shingle_set(t) for _, t in docs]
    part = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    out = []
    for k, (i, _) in enumerate(docs):
        ids = [d for (d, _), p in zip(docs, part) if p == part[k] and d is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(map(repr, out))


def got(spark, docs, settings=S.Settings(), parts=4):
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], SCHEMA).repartition(parts)
    found = S.similar_documents(df, settings)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(repr(tuple(r)) for r in found.collect())


def edited(draw, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        at = draw.randrange(len(out))
        match draw.randrange(3):
            case 0:
                out[at] = f"e{draw.randrange(10**6)}"
            case 1:
                out.insert(at, f"e{draw.randrange(10**6)}")
            case _ if len(out) > 1:
                del out[at]
    return out


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    line = [word() for _ in range(25)]
    texts = []
    for length in (4, 5, 8, 30, 60, 200):
        base = [word() for _ in range(length)]
        family = [base]
        for _ in range(14):
            # chains of small edits, so that ends of a component are far apart
            family.append(edited(draw, draw.choice(family[-2:] if draw.random() < 0.6 else [base]), draw.choice([0.005, 0.01, 0.02, 0.04])))
        texts += family + [list(base)]
    # a common passage in texts of their own, and texts that are little else
    texts += [[word() for _ in range(draw.randrange(2, 90))] + line + [word() for _ in range(20)] for _ in range(25)]
    texts += [line + [word() for _ in range(draw.randrange(0, 7))] for _ in range(25)]
    texts += [[word()] for _ in range(4)] + [["w1", "w2", "w3"], ["W1", "w2", "w3"], ["w1", "w2", "w3", "w4"]]
    draw.shuffle(texts)
    docs = [(i * 3, draw.choice([" ", "  ", "\n", "\t"]).join(t)) for i, t in enumerate(texts)]
    return docs + [(900, None), (901, ""), (902, " \n"), (900, None), (None, docs[3][1]), (None, None), docs[0], (docs[1][0], docs[2][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    want = brute(docs)
    assert got(spark, docs) == want
    # blocks of a few entries, counters that many shingles share, marks that are all set
    assert got(spark, docs, S.Settings(block=3, sketch=64, marks=512), parts=9) == want


def test_another_similarity(spark):
    docs = corpus(3)
    assert got(spark, docs, S.Settings(percent=60, block=8)) == brute(docs, 60)


def test_star_of_copies_around_a_text(spark):
    """Copies too far from each other link through the text they derive from; all have its shingles in their lists."""
    draw = random.Random(6)
    base = [f"w{i}" for i in range(240)]
    star = [" ".join(edited(draw, base, 0.0175)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate([*star, " ".join(base)], 10)]
    want = brute(docs)
    assert len({w.split(", ")[2] for w in want}) < 10
    assert got(spark, docs) == want


def test_empty_table_and_long_text(spark):
    assert got(spark, []) == []
    long = " ".join(f"w{i % 50_000}" for i in range(400_000))
    docs = [(1, long), (2, long + " end"), (3, "x" * 1_000_000)]
    assert got(spark, docs) == ["(1, 50000, 1)", "(2, 50001, 1)", "(3, 1, 3)"]


def test_shingles_in_pieces():
    text = b"one  two three\tfour five\nsix seven EIGHT nine ten \x00 eleven"
    whole = S.shingles(text, 4, 42)
    for size in (1, 5, 17):
        assert (S.shingles(text, 4, 42, size) == whole).all()
    assert len(whole) == len(shingle_set(text.decode()))


def test_list_pairs_lose_no_link():
    """Skipped blocks and bounded answers leave every pair that links."""
    draw = random.Random(9)
    for _ in range(30):
        universe = list(range(60))
        leader = set(draw.sample(universe, 40))
        sets = [set(draw.sample(universe, draw.randrange(25, 60))) for _ in range(20)] + [set(leader) ^ set(draw.sample(universe, draw.randrange(1, 6))) for _ in range(180)]
        sets = [s | {0} for s in sets]
        order = {t: i for i, t in enumerate(draw.sample(universe, 60))}
        entries = {"rec": [], "n": [], "pos": [], "known": [], "comp": [], **{p: [] for p in S.PARITY}}
        held = {}
        for i, s in enumerate(sets):
            ranked = sorted(s, key=order.get)
            bits = S.parity(np.array(sorted(s), np.uint64))
            held[i] = s
            for k, v in zip(entries, (i, len(s), ranked.index(0), draw.choice([len(s & leader), -1]), i % 17, *bits.tolist())):
                entries[k].append(v)
        side = {k: np.array(v, np.int64) for k, v in entries.items()}
        found = {(a, b): sure for a, b, sure in S.list_pairs(side, side, len(leader), 85)}
        for a in held:
            for b in range(a):
                first = min(held[a] & held[b], key=order.get)
                links = 100 * len(held[a] & held[b]) >= 85 * len(held[a] | held[b])
                if links and a % 17 != b % 17 and first == 0:
                    assert (a, b) in found
                if found.get((a, b)):
                    assert links


def test_wide_parity_keeps_linked_pairs(spark):
    """Large sets on both sides of a power of two: no linked pair is filtered, unlike ones are."""
    draw = random.Random(12)
    texts = []
    for size in (500, 520, 1030, 2040):
        base = [f"v{draw.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(edited(draw, base, share)) for share in (0.002, 0.01, 0.02, 0.03)]
        texts += [" ".join(base[: size * 92 // 100]), " ".join(base[: size // 2] + [f"u{i}" for i in range(size // 2)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.marked(df, S.frequency_classes(df, S.Settings()), S.Settings()).cache()
    names = {r.doc_id: r.rec for r in rows.collect()}
    pairs = spark.createDataFrame([(names[i], names[j]) for i in names for j in names if i > j], "a long, b long")
    kept = {frozenset(r) for r in S.possible(pairs, S.distinct_sets(rows), 85).collect()}
    sets = {names[i]: shingle_set(t) for i, t in enumerate(texts)}
    links = {frozenset((a, b)) for a, b in pairs.collect() if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links and links <= kept and len(kept) < len(texts) * 4


def test_copies_are_not_paired(spark):
    """A group of near copies costs pairs in proportion to its size, not to its square."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(edited(draw, base, 0.003)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    settings = S.Settings()
    rows = S.marked(df, S.frequency_classes(df, settings), settings)
    lists = S.index_lists(rows)
    assert lists.filter("rec <> leader").select("rec", "leader").distinct().count() < 400 * 20
    links = S.set_links(df, rows, S.distinct_sets(rows), settings)
    assert links.count() < 400 * 20
    assert S.roots(links).select("root").distinct().count() == 1


def test_documents_of_the_test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = S.similar_documents(docs.withColumn("n_shingles", F.lit("x")))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)
