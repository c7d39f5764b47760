import dataclasses
import random

import pytest

from sparkwarden.llm import nbest as N
from sparkwarden.llm.queries import QUERIES

S = N.default_settings()
WORDS = N.Vocabulary(S.model)


def every(text):
    """All segmentations with their scores, by recursion over the whole text."""
    spelt = [("b", c) if c == N.MARK else ("c", N.MARK if c == " " else c) for c in " " + text]

    def go(i):
        if i == len(spelt):
            yield 0, ()
            return
        for end in range(i + 1, min(len(spelt), i + 16) + 1):
            part = spelt[i:end]
            piece = "".join(c for _, c in part)
            if all(k == "c" for k, _ in part) and piece in WORDS.pieces:
                number, score = WORDS.pieces[piece]
                for s, ids in go(end):
                    yield score + s, (number, *ids)
            elif end == i + 1:
                raw = piece.encode()
                for s, ids in go(end):
                    yield WORDS.byte_score * len(raw) + s, (*[WORDS.byte_ids[b] for b in raw], *ids)

    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("best", [1, 2, 5, 40])
@pytest.mark.parametrize("text", ["", " ", "a", "the cat", "  two  gaps", "a\nb", "é😀", f"x{N.MARK}y", "reread it", "aaaaaa", "\n\n"])
def test_equals_all_segmentations(text, best):
    encoder = N.Encoder(dataclasses.replace(S, best=best))
    ids, scores, swaps = encoder.encode(text)
    want = every(text)[:best]
    assert len(scores) == len(want) == len(swaps)
    assert all(a * N.UNITS == b for a, (b, _) in zip(scores, want))
    made = [tuple(N.swapped(ids, s)) for s in swaps]
    told = dict((x, s) for s, x in every(text))
    assert len(set(made)) == len(made) and all(told[m] == s * N.UNITS for m, s in zip(made, scores))
    assert all(WORDS.decode(list(m)) == text for m in made)


def test_long_texts():
    rng = random.Random(1)
    texts = ["x" * 20_000, " " * 3000, "日本語 " * 2000, "".join(rng.choices("abc é\n▁ 😀<0x0A>", k=5000)), "<unk> </s> <0x41>"]
    encoder = N.Encoder(dataclasses.replace(S, remembered=50))
    for text in texts:
        ids, scores, swaps = encoder.encode(text)
        assert scores == sorted(scores, reverse=True) and (len(scores) == 4 or "日" in text) and len(scores) == len({tuple(N.swapped(ids, s)) for s in swaps})
        assert all(WORDS.decode(N.swapped(ids, s)) == text for s in swaps)
    assert len(encoder.known) <= 50


def test_units_solved_together():
    rng = random.Random(3)
    units = {" ", "é😀", "日本", " x" * 20, "the", " cat", "\x00", "  gaps", "reread", "aaaaaa"}
    units |= {"".join(rng.choices("abcthe é日😀.,'", k=rng.randint(1, 40))) for _ in range(2000)}
    units = sorted(units)
    scores, losses, sizes, flat = WORDS.solve_all(units)
    ends = sizes.cumsum()
    for u, score, loss, a, b in zip(units, scores, losses, ends - sizes, ends):
        assert (tuple(flat[a:b].tolist()), score, loss) == WORDS.solve(u)
    assert [len(x) for x in WORDS.solve_all([])] == [0, 0, 0, 0]


@pytest.mark.parametrize("part", [1, 7, 60, 1 << 20])
def test_parts_of_texts(part):
    rng = random.Random(4)
    texts = ["", "the cat  sat", " " * 50 + "x" * 30 + "   ", "\n \n", *("".join(rng.choices("ab é\n.▁ ", k=rng.randint(0, 200))) for _ in range(60))]
    for text in texts:
        assert "".join(N.parts(" " + text, part)) == " " + text
        whole = WORDS.unit.findall(" " + text)
        assert [u for p in N.parts(" " + text, part) for u in WORDS.unit.findall(p)] == whole
    small = N.Encoder(dataclasses.replace(S, part=part, remembered=30, together=5))
    usual = N.Encoder(S)
    for text, (ids, scores, swaps, good) in zip(texts, small.encode_all(texts)):
        want = usual.encode(text)
        assert good and ids.tolist() == want[0] and scores == want[1] and len(swaps) == len(scores)


def test_defined_results(spark):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (2, None, "y"), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = N.segmentations(docs, S)
    assert all(r.round_trip for r in got.collect())
    assert sorted(((r.doc_id, r.text) for r in N.decoded(got, S).collect()), key=str) == sorted([(1, "the cat"), (1, "the cat"), (2, ""), (None, "")], key=str)
    assert N.segmentations(docs.filter("false"), S).count() == 0 == N.decoded(got.filter("false"), S).count()


def test_query(spark):
    rows = QUERIES["op6_nbest"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.round_trip and r.n_pieces > 0 for r in rows)
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in rows)
