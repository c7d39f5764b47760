import random
from collections import defaultdict

import numpy as np
import pytest

from sparkwarden.llm import chunks as C
from sparkwarden.llm.queries import QUERIES

S = C.Settings()


def plain_gear(data, settings):
    """The rolling form: each byte shifts the hash on; the bits of bytes beyond the window are taken out."""
    gear = np.random.default_rng(settings.seed).integers(0, 1 << 32, 256, dtype=np.uint32).tolist()
    out = []
    for i in range(len(data)):
        value = 0
        for byte in data[max(0, i - settings.window + 1) : i + 1]:
            value = (2 * value + gear[byte]) % (1 << 32)
        out.append(value * 2654435769 % (1 << 32))
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghéß", k=rng.randint(2, 8))) for _ in range(n))


def test_gear_hash():
    data = random.Random(1).randbytes(500)
    assert C.gear_hash(np.frombuffer(data, np.uint8), S).tolist() == plain_gear(data, S)


@pytest.mark.parametrize("text", ["", " ", "one", "\n\n", "a b c", "é" * 3000, "x" * 5000 + " tail of words", "re " * 400])
def test_units_are_sound(text):
    raw = text.encode()
    digests, starts, ends, counts = C.units(raw, S)
    for d, a, b, n in zip(digests, starts, ends, counts):
        piece = text[a:b]
        assert d == C.xxhash.xxh3_64_intdigest(piece.encode()) and piece.strip() and n >= S.unit_words
        if max(map(len, piece.split())) <= 32:
            assert n == len(piece.split())


def test_cuts_resist_insertions():
    rng = random.Random(2)
    passage = words(rng, 400)
    base = set(C.units(passage.encode(), S)[0])
    for front in (words(rng, 3), "x", words(rng, 50) + "\n"):
        moved = C.units(f"{front} {passage}".encode(), S)[0]
        assert len(base & set(moved)) >= 0.9 * len(base)
    at = len(passage) // 2
    middle = C.units(f"{passage[:at]} inserted words {passage[at:]}".encode(), S)[0]
    assert len(base & set(middle)) >= 0.85 * len(base)


def make(spark, rows, schema="doc_id long, text string, n_chars long, start int"):
    return spark.createDataFrame([(i, t, len(t or ""), 7) for i, t in rows], schema)


def test_passages_between_texts(spark):
    rng = random.Random(3)
    shared = [words(rng, 60) for _ in range(12)]
    rows = [(k, words(rng, 30) + "\n" + shared[k % 12] + "\n" + words(rng, 30)) for k in range(48)]
    rows += [(100 + k, words(rng, 300)) for k in range(20)]
    docs = make(spark, rows)
    found = {r.doc_id: r for r in C.repeated_passages(docs).collect()}
    assert set(found) == set(range(48))
    texts = dict(rows)
    for k, r in found.items():
        assert (r.n_dropped > 0) == (k >= 12) and r.first_docs == ([k % 12] if k >= 12 else [])
        for s in r.drop_spans + r.kept_spans:
            assert texts[k][s.start : s.end] in shared[k % 12]
        assert sum(s.end - s.start for s in r.drop_spans or r.kept_spans) > 0.6 * len(shared[k % 12])
    after = {r.doc_id: r for r in C.drop_repeats(docs).collect()}
    for k, text in rows:
        assert after[k].n_chars == len(after[k].text) and after[k].start == 7
        assert (after[k].text == text) == (k < 12 or k >= 100)
        if 12 <= k < 48:
            assert text.startswith(after[k].text[:30]) and text.endswith(after[k].text[-30:])


def test_every_copy_of_a_text_goes_but_the_first(spark):
    text = words(random.Random(4), 200)
    docs = make(spark, [(i, text) for i in (9, 4, 6)])
    left = {r.doc_id: r.text for r in C.drop_repeats(docs).collect()}
    assert left[4] == text and all(len(left[i]) < 0.1 * len(text) for i in (6, 9))


def test_defined_results(spark):
    text = words(random.Random(5), 80)
    rows = [(None, text), (3, text), (3, text), (3, None), (4, ""), (5, "short"), (None, None), (6, "w " * 30_000), (7, "w " * 50)]
    docs = make(spark, rows)
    found = {r.doc_id: r for r in C.repeated_passages(docs).collect()}
    assert found[3].n_dropped == 1 and found[3].first_docs == [] and found[None].n_kept == 1
    left = C.drop_repeats(docs)
    assert left.schema == docs.schema and left.count() == len(rows)
    same = sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id in (4, 5))
    assert same == [(4, ""), (5, "short")]
    assert sum(r.text == text for r in left.collect()) == 1
    assert C.repeated_passages(docs.filter("false")).count() == 0 == C.drop_repeats(docs.filter("false")).count()


def test_many_texts_under_one_id(spark):
    """A third of the rows has no id: groups are single texts, and every passage stays in one place."""
    rng = random.Random(6)
    shared = [words(rng, 60) for _ in range(5)]
    texts = [words(rng, 25) + "\n" + shared[k % 5] + "\n" + words(rng, 25) for k in range(90)]
    rows = [(None if k % 3 == 0 else k, t) for k, t in enumerate(texts)] + [(None, texts[0])] * 30
    docs = make(spark, rows)
    found = C.passages(docs).collect()
    assert len({(r.doc_id, r.tag) for r in found}) == 90
    kept, dropped = defaultdict(int), defaultdict(int)
    tags = {r.tag: r.text for r in docs.select(C._tag().alias("tag"), "text").collect()}
    for r in found:
        piece = tags[r.tag][r.start : r.end]
        owners = [i for i, s in enumerate(shared) if piece in s]
        if owners:
            (dropped if r.drop else kept)[owners[0]] += 1
            assert r.first_doc is None
        else:  # the repeated rows' own text
            assert not r.drop and r.doc_id is None and piece in texts[0]
    # a chunk at a passage's edge may be shared by few texts, and so be kept in another of them
    assert all(dropped[i] >= 17 and kept[i] <= 2 for i in range(5))
    left = C.drop_repeats(docs).collect()
    assert len(left) == len(rows)
    for s in shared:
        mid = s[len(s) // 3 : len(s) // 2]
        assert len({r.text for r in left if mid in r.text}) == 1


def test_query_finds_what_brute_force_finds(spark):
    sf, size = "/root/testdata/sf0.01", 50
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    where = defaultdict(set)
    for i, t in docs.items():
        w = t.split()
        for k in range(len(w) - size + 1):
            where[tuple(w[k : k + size])].add(i)
    repeated = {i for docs_with in where.values() if len(docs_with) > 1 for i in docs_with - {min(docs_with)}}
    rows = {r.doc_id: r for r in QUERIES["op9_chunks"](spark, sf).collect()}
    assert len(repeated) > 20
    assert len(repeated & {i for i, r in rows.items() if r.n_dropped}) >= 0.98 * len(repeated)
    seen = []
    for i, r in rows.items():
        for span in filter(None, r.drop_spans.split(",")):
            a, b = map(int, span.split(":"))
            for k in range(a, b - 40, 40):
                piece = docs[i][k : k + 40]
                seen.append(sum(piece in t for t in docs.values()) > 1 or docs[i].count(piece) > 1)
    # all but the places where two repeated passages touch
    assert len(seen) > 1000 and np.mean(seen) > 0.99
