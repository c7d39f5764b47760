import random

import pytest

from sparkwarden.llm import licenses as L
from sparkwarden.llm.queries import QUERIES

SIZE = L.Settings()


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 0x7F:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain(text, settings=SIZE, templates=L.TEMPLATES):
    """Every block against every template, and every place against every phrase."""
    words = words_of(text)
    places = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    hits = set()
    for start in range(0, len(words), settings.stride):
        block = set(words[start : start + settings.block_words])
        for label, template in templates:
            own = set(words_of(template))
            if len(own & block) >= settings.containment * len(own) - 1e-9:
                hits.add((start, label, len(own & block) / len(own)))
    base = sorted({label for _, label in places})
    return (
        len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), base,
        sorted({*base, *[label for _, label, _ in hits]}), 1.0 if base else max((c for _, _, c in hits), default=0.0), hits,
    )


def told(row):
    return (*[row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")], {tuple(b) for b in row.blocks})


TEXTS = [
    "", None, "...", "cc by", "CC BY cc-by CC.BY cc bye", "xcc by", "The General Public  License! all rights\nreserved; all rights reserved",
    "é cc by ü", "cc by cc by", "İcc by", *[t for _, t in L.TEMPLATES], "Released under the\nMIT\nlicense", "Released under the license",
    "word " * 40 + L.TEMPLATES[3][1] + " word" * 40, "word " * 60 + L.TEMPLATES[2][1].replace("hereby ", ""), "mit " * 5000 + "released under the license",
    " ".join(reversed(L.TEMPLATES[5][1].split())), "the of and to in " * 3000,
]


def make(spark, texts):
    return spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")


def test_equals_brute_force(spark):
    rng = random.Random(6)
    bits = [w for _, t in L.TEMPLATES for w in t.split()] + ["cc by", "some", "other"]
    texts = TEXTS + [" ".join(rng.choices(bits, k=rng.choice([20, 90, 300]))) for _ in range(60)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.07) + " tail" * rng.randint(0, 70) for _, t in L.TEMPLATES for _ in range(6)]
    for settings in (SIZE, L.Settings(containment=0.6, block_words=20, stride=7)):
        rows = L.licences(make(spark, texts), settings).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert told(r) == plain(texts[r.doc_id], settings), texts[r.doc_id]


def test_long_templates(spark):
    """Blocks grow with the templates: exact copies are found whole, wherever they begin, and nothing else is."""
    rng = random.Random(2)
    long = [(f"t{n}", " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(n)}" for _ in range(n))) for n in (100, 1000)]
    templates = (*L.TEMPLATES[:2], *long)
    settings = L.fitting(templates)
    assert settings.block_words - settings.stride + 1 >= 1000 and L.fitting() == L.Settings()
    filler = lambda n: " ".join(f"z{rng.randrange(500)}" for _ in range(n))
    texts = [f"{filler(n)} {t}. {filler(70)}" for _, t in long for n in (0, 1, 63, 999, 1500)]
    texts += [" ".join(t.split()[: len(t.split()) * 8 // 10]) for _, t in long] + [filler(3000), L.TEMPLATES[0][1]]
    for r in L.licences(make(spark, texts), templates=templates).collect():
        assert told(r) == plain(texts[r.doc_id], settings, templates)
        assert r.doc_id >= 10 or f"t{100 if r.doc_id < 5 else 1000}" in r.labels


@pytest.mark.parametrize("containment", [0.5, 0.8, 0.9, 1.0])
def test_orders_and_prefixes(spark, containment):
    docs = make(spark, ["the the license", "the license under", "the"])
    for t in L.ordered_templates(docs, L.Settings(containment=containment)):
        assert set(t.words) in [set(words_of(x)) for _, x in L.TEMPLATES]
        counts = [{"the": 3, "license": 2, "under": 1}.get(w, 0) for w in t.words]
        assert counts == sorted(counts) and len(t.prefix) == len(t.words) - t.need + 1


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, TEXTS[3], "x"), (1, TEXTS[3], "x"), (None, TEXTS[10], None), (2, None, None)], "doc_id long, text string, labels string")
    rows = L.licences(docs).collect()
    assert sorted(((r.doc_id, r.labels) for r in rows), key=str) == sorted([(1, ["cc-by"]), (1, ["cc-by"]), (None, ["apache-2.0"]), (2, [])], key=str)
    assert L.licences(docs.filter("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_licenses"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, places, first, last, base, labels, score, _ = plain(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (n, places, first, last, ",".join(base), ",".join(labels), score)
    assert len({r.labels for r in rows}) > 4
