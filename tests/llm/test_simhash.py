import numpy as np
import pytest
import xxhash

from sparkwarden.llm import simhash as S
from sparkwarden.llm.components import roots
from sparkwarden.llm.queries import QUERIES


def plain_fingerprint(text):
    words, lowered = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    word = ""
    for c in lowered + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if parts else 0


def plain_components(ids, values):
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(ids))]


TEXTS = ["", "One", "one two", "one two three", "ONE two\tthree four", "é  à ñ o", "a b c " * 2000, "x" * 50_000, "\x0b\x0c"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("members", [2, 3, 64, 65, 300])
def test_close_lanes(members):
    rng = np.random.default_rng(members)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.array([[int(b) ^ sum({1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 4))}) for _ in range(members)] for b in base], np.uint64)
    near = S.close_lanes(values, 2)
    for g in range(3):
        for i in range(members):
            for j in range(members):
                told = bool(int(near[g, i, j // 64]) >> (j % 64) & 1)
                assert told == (i != j and bin(int(values[g, i]) ^ int(values[g, j])).count("1") <= 2)


def test_links_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    values = sorted({base ^ sum({1 << int(x) for x in rng.integers(0, 64, 5)}) for _ in range(400)})
    want = plain_components(list(range(len(values))), values)
    df = spark.createDataFrame([(S.signed(v),) for v in values], "fp long")
    for most in (4, 2048):
        got = {r.node & (1 << 64) - 1: r.root for r in roots(S.near_links(df, group_most=most)).collect()}
        parts = {}
        for v, w in zip(values, want):
            parts.setdefault(w, []).append(v)
        for members in parts.values():
            assert len({got.get(v, "alone") for v in members}) == 1
            assert len(members) > 1 or members[0] not in got


def test_roots(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(map(tuple, roots(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_defined_results(spark):
    rows = [(5, "same text here", "x"), (3, "same text here", "y"), (3, "same text here", "y"), (None, "same text here", "z"),
            (9, None, None), (8, "", "q"), (None, "other words stand here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=str)
    same, other = f"{plain_fingerprint('same text here'):016x}", f"{plain_fingerprint('other words stand here'):016x}"
    assert got == sorted([(5, same, 3), (3, same, 3), (3, same, 3), (None, same, 3), (9, "0" * 16, 8), (8, "0" * 16, 8), (None, other, None)], key=str)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[5], rows[3], rows[6]], key=str)
    assert S.near_duplicates(docs.filter("false")).count() == 0 == S.keep_one(docs.filter("false")).count()


def test_near_copies_in_tiles(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for group in range(3):
        base = rng.choice(words, 150).tolist()
        for _ in range(40):
            text = list(base)
            for at in rng.integers(0, 150, 3):
                text[at] = "x" + str(rng.integers(0, 10**6))
            texts.append((group, " ".join(text)))
    texts += [(3 + k, " ".join(rng.choice(words, 150))) for k in range(30)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    first = {g: min(i for i, (h, _) in enumerate(texts) if h == g) for g, _ in texts}
    got = {r.doc_id: r.component_id for r in S.copies(docs).collect()}
    assert got == {i: first[g] for i, (g, _) in enumerate(texts)}
    prints = [S.wide_fingerprint(t.encode()) for _, t in texts]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "node long, bits array<long>, keys array<long>")
    for most in (7, 2048):
        parts = dict(map(tuple, roots(S.wide_links(df, S.Copies(), group_most=most)).collect()))
        assert parts == {i: first[g] for i, (g, _) in enumerate(texts) if g < 3}


def test_templates_stay_and_copies_go(spark):
    """Similarities of 0.60 to 0.79 are no copies, 0.80 and more are; also in tiles and for small sets."""
    rng = np.random.default_rng(7)
    texts = []
    for words in (8, 30, 120):
        for group in range(12):
            base = [f"b{words}_{group}_{k}" for k in range(words)]
            texts.append(" ".join(base))
            for cut in (1, 2, 3, 5, 9, 14, 20):
                texts.append(" ".join(base[: words - min(cut, words - 5)] + [f"t{k}" for k in rng.integers(0, 10**6, cut // 2)]))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    middle = 0
    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            middle += 0.6 <= s < 0.8
            if s >= 0.8:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    want = [find(i) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert middle > 50 and {r.doc_id for r in S.keep_one(docs).collect()} == set(want)
    marked, least = S._marked(docs, S.Copies())
    names = {r.doc_id: r.node for r in marked.collect()}
    whole = spark.createDataFrame([(n, 0) for n in set(names.values())], "node long, root long")
    for most in (50, 1024):
        parts = dict(map(tuple, roots(S.exact_links(docs, least, whole, S.Copies(), group_most=most)).collect()))
        got = [parts.get(names[i], names[i]) for i in range(len(texts))]
        assert [got.index(g) for g in got] == want


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, values = [d.doc_id for d in docs], [plain_fingerprint(d.text) for d in docs]
    want = {(i, f"{v:016x}", c) for i, v, c in zip(ids, values, plain_components(ids, values))}
    assert {tuple(r) for r in QUERIES["op7_simhash"](spark, sf).collect()} == want


@pytest.mark.parametrize("count", [2, 40, 64, 65, 130])
def test_links_do_not_depend_on_the_size_of_the_group(count):
    """Pairs of equal sets: those within the radius are linked, one bit beyond it they are not."""
    settings = S.Copies()
    rng = np.random.default_rng(count)
    bits = rng.integers(0, 1 << 64, (count, 4), dtype=np.uint64)
    beyond = np.zeros(256, np.uint8)
    beyond[: settings.radius + 1] = 1
    within = beyond.copy()
    within[0] = 0
    pack = lambda flags: np.packbits(flags, bitorder="little").view(np.uint64)
    sets = [np.arange(10) + 100 * k for k in range(count)]
    for flags, linked in ((within, True), (beyond, False)):
        bits[1], sets[1] = bits[0] ^ pack(flags), sets[0]
        left, right = S.similar_links(np.arange(count), bits, np.concatenate(sets), np.full(count, 10), settings)
        assert (left, right) == (([1], [0]) if linked else ([], []))


def test_near_copies_are_found_by_agreeing_bits(spark):
    """No smallest hashes at all: texts that differ in a word of 3,000 are near copies by the bits of their SimHashes alone."""
    rng = np.random.default_rng(9)
    docs = []
    for group in range(3):
        words = [f"g{group}_{k}" for k in rng.integers(0, 10**6, 3000)]
        docs += [(10 * group, " ".join(words)), (10 * group + 1, " ".join([*words[:-1], "other"])), (10 * group + 2, " ".join(["other", *words[1:]]))]
    kept = S.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), S.Copies(keys=0))
    assert {r.doc_id for r in kept.collect()} == {0, 10, 20}


def test_word_links(spark):
    """Every two nodes with a word within two bits are connected, others are not."""
    rng = np.random.default_rng(10)
    bits = rng.integers(0, 1 << 64, (60, 4), dtype=np.uint64)
    for i in range(1, 60):
        at, word = int(rng.integers(0, i)), int(rng.integers(0, 4))
        flips = int(rng.integers(0, 5))
        bits[i, word] = bits[at, word] ^ np.uint64(sum({1 << int(b) for b in rng.choice(64, flips, replace=False)}))
    label = list(range(60))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(60):
        for j in range(i):
            if (np.bitwise_count(bits[i] ^ bits[j]) <= 2).any():
                a, b = sorted((find(i), find(j)))
                label[b] = a
    want = [find(i) for i in range(60)]
    df = spark.createDataFrame([(i, [int(w) for w in row.view(np.int64)]) for i, row in enumerate(bits)], "node long, bits array<long>")
    for most in (2, 2048):
        got = dict(map(tuple, roots(S.word_links(df, S.Copies(), group_most=most)).collect()))
        assert [got.get(i, i) for i in range(60)] == want
    assert 1 < len(set(want)) < 40
    assert S.word_links(df.filter("false"), S.Copies()).count() == 0
