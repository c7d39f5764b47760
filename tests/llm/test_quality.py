import zlib

import numpy as np

from sparkwarden.llm import quality as Q
from sparkwarden.llm.queries import QUERIES

SMALL = Q.Settings(word_bits=8, gram_bits=9, width=4, epochs=3)


def plain_features(text, settings):
    """Words and grams as byte strings, in the order of ``features``."""
    words = text.split()
    out = [("word", w) for w in words]
    for lag in range(1, settings.lags + 1):
        out += [("again", lag)] * sum(words[i] == words[i - lag] for i in range(lag, len(words)))
    for n in settings.grams:
        for word in words:
            edged = b" " + word + b" "
            out += [(n, edged[i : i + n]) for i in range(len(edged) - n + 1)]
    return out


TEXTS = [b"", b" ", b"a", b"to be or not to be to be", "é à  ñ\nwörter wörter".encode(), b"x" * 5000, b"a b a b a b a b", b"\t\x0b one\r\n"]


def test_features_are_those_of_each_text():
    size = Q.Settings()
    seen = {}
    found = [[] for _ in TEXTS]
    for numbers, owner in Q.features(TEXTS, size):
        for number, i in zip(numbers.tolist(), owner.tolist()):
            found[i].append(number)
    for text, got in zip(TEXTS, found):
        want = plain_features(text, size)
        assert len(got) == len(want)
        # grams come in the order of the text's bytes; equal features must have equal numbers
        alone = np.concatenate([n for n, _ in Q.features([text], size)]).tolist()
        assert sorted(alone) == sorted(got)
        if len(text) < 100:
            for kind in {k for k, _ in want}:
                mine = [w for w in want if w[0] == kind]
                at = [i for i, w in enumerate(want) if w[0] == kind]
                for w, number in zip(mine, [alone[i] for i in at]):
                    assert seen.setdefault(w, number) == number


def test_learns_and_repeats():
    texts = [b"good words here in order"] * 20 + [b"BAD!! BAD!! NOISE!!"] * 20
    model = Q.train(texts, [1] * 20 + [0] * 20, SMALL)
    assert np.array_equal(model.table, Q.train(texts, [1] * 20 + [0] * 20, SMALL).table)
    got = Q.scores([b"good words", b"NOISE!! BAD!!", b""], model)
    assert got[0] > 0.5 > got[1] and 0 <= got[2] <= 1
    assert np.allclose(Q.scores([b"NOISE!! BAD!!"], model), got[1])


def test_defined_results(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 5.0), (2, None, 1.0), (2, "", 1.0), (None, "BAD!! BAD!!", 2.0), (1, "good words here", 5.0)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (1, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.filter("false")):
        model = Q.fit(docs, known, SMALL)
        rows = Q.quality_scores(docs, model).collect()
        assert len(rows) == 5
        for r in rows:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
            assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        kept = Q.keep_good(docs, model)
        assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in rows)
    assert Q.quality_scores(docs.filter("false"), model).count() == 0


def test_disputed_labels_and_held_out_rows_are_not_learned(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "BAD!! BAD!!") for i in range(60)], "doc_id long, text string")
    right = [(i, i % 2) for i in ids]
    wrong = [(i, 1 - i % 2) for i in range(60) if i not in ids] + [(ids[0], 1), (ids[0], 0)]
    a = Q.fit(docs, spark.createDataFrame([r for r in right if r[0] != ids[0]], "doc_id long, quality int"), SMALL)
    b = Q.fit(docs, spark.createDataFrame([r for r in right if r[0] != ids[0]] + wrong, "doc_id long, quality int"), SMALL)
    assert np.array_equal(a.table, b.table) and a.bias == b.bias


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op2_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 1000 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert scored.count() == 10_000
