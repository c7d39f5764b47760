import hashlib
import re

import pytest

from sparkwarden.llm import pii
from sparkwarden.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [
        (kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(kind, m.group())
    ]


TRICKY = [
    "", None, "no data", "a@b.c", "a@b.c_d@e.f", "x@y..z@w.org", "a@b a@b.c.d. @x.y", "é@ü.de ab@cd.ef😀 z@z.zz",
    "1.2.3.4.5.6.7.8", "999.1.2.3.4", "256.1.1.1 255.255.255.255 0001.02.3.4", "1.2.3 1.2.3.4.", "00000000000000000000000000.1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111", "41111111111111112", "4111  1111 1111 1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (988) 555-2485 x", "++49 30 1234567", "+1", "+1 2", "+12 345 678 901 1.2.3.4", "+1 (((( 5", "+123456789012345678",
    "a" * 60_000, "a@" + "b." * 40_000, "1" * 50_000, "1 " * 30_000, "+1" + " " * 50_000, "@" * 50_000, "a@b.c " * 3000,
    "mail bob@x.com, call +1 (222) 333-4444 from 10.20.30.40; card 4111 1111 1111 1111\nend",
]


def make(spark, rows):
    return spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, n_chars long, kind string")


def base_of(row):
    return [(s.kind, s.start, s.end) for s in row.spans if s.kind in PLAIN]


def test_base_spans(spark):
    docs = make(spark, list(enumerate(TRICKY)) + [(None, TRICKY[-1]), (0, ""), (3, "a@b.c")])
    rows = pii.personal_spans(docs).collect()
    assert len(rows) == len(TRICKY) + 3
    for row in rows:
        want = plain_spans(TRICKY[row.doc_id if row.doc_id is not None else -1])
        assert base_of(row) == want, row.doc_id
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
    assert pii.personal_spans(docs.filter("false")).count() == 0


def test_method_adds_spans(spark):
    lines = [
        ("written_email", "contact jane.doe (at) example (dot) com today"), ("local_phone", "call 415-555-2671 now"),
        ("ssn", "social security 123-45-6789."), ("iban", "bank account DE89 3704 0044 0532 0130 00."), ("person", "Dear Mr John Smith, hello"),
    ]
    wrong = ["version 123-45-6789x", "iban DE89 3704 0044 0532 0130 01", "order 415-555-2671abc", "ssn 000-45-6789"]
    rows = list(enumerate([t for _, t in lines] + wrong + ["mail a@b.com", "at 300.1.1.1", "card 4111111111111112"] * 5))
    docs = make(spark, rows)
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_spans(docs).collect()}
    assert [found[i] for i in range(len(lines))] == [[kind] for kind, _ in lines]
    assert [found[i] for i in range(len(lines), len(lines) + len(wrong))] == [[]] * len(wrong)
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts[0] == "contact [WRITTEN_EMAIL] today" and texts[4] == "Dear [PERSON], hello" and texts[5] == wrong[0]


def test_redact(spark):
    docs = make(spark, list(enumerate(TRICKY)) + [(None, None)])
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(TRICKY) + 1
    for r in out.collect():
        before = TRICKY[r.doc_id] if r.doc_id is not None else None
        spans = plain_spans(before)
        assert (r.text == before) == (not spans) or r.text is None is before
        assert not any(before[a:b] in r.text for k, a, b in spans)
        assert r.n_chars == (3 if r.text is None or len(r.text) == len(before) else len(r.text)) and r.kind == "k"
    assert out.filter(f"doc_id = {len(TRICKY) - 1}").first().text == "mail [EMAIL], call [PHONE] from [IP]; card [CARD]\nend"


def test_estimate_finds_the_reliable_labeler():
    # the second labeler says the same of everything, the first and third agree
    patterns = [("email", (1, 1, 1, 0), 800), ("email", (-1, 1, 0, -1), 700), ("ip", (1, 1, 0, 0), 300), ("ip", (-1, 1, 0, -1), 500)]
    trust, prior = pii.estimate(patterns)
    assert trust["regex"][1][1] > 0.9 > 0.1 > trust["regex"][0][1]
    assert abs(trust["gazetteer"][1][1] - trust["gazetteer"][0][1]) < 0.1
    assert 0.45 < prior["email"] < 0.6 and pii.posterior("ip", (-1, 1, 0, -1), trust, prior) < 0.05


@pytest.mark.parametrize("number,ok", [("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False)])
def test_iban(spark, number, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.well_formed(F.lit("iban"), F.lit(number))).first()[0] == ok


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_open_names_and_mixed_brackets(spark):
    """A name of any length is one candidate, and a written sign is seen whichever brackets stand around it."""
    name = "Dr. W" + "olfeschlegelsteinhausenbergerdorff" * 2
    texts = [f"{name} was here", "contact jo (at] example [dot] org", "contact jo [at) example (dot) org"]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(r.doc_id, r.kind, r.match) for r in rows if r.kind in ("person", "written_email")}
    assert found == {(0, "person", name), (1, "written_email", "jo (at] example [dot] org"), (2, "written_email", "jo [at) example (dot) org")}
