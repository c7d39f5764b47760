import hashlib
import random

import pytest
import xxhash

from sparkwarden.llm import merkle as M
from sparkwarden.llm.queries import QUERIES

TEXTS = ["", "\n", "a", "One. Two, three.\nFour!\n\n# Head\nfive", "x" * 1000, "é😀 ñ: ü|\n\n\n\nz", "---\na\n===\nb", "...", "a.b\na.b"]


def plain_root(text):
    """The tree by hand: clauses, lines, sections."""
    tree, lines = [], text.split("\n")
    for line in lines:
        head = line.startswith(tuple("#" * n + " " for n in range(1, 7)))
        rule = len(line) > 2 and set(line) in ({"-"}, {"="})
        if not tree or (tree[-1] and tree[-1][-1].strip() and (not line.strip() or head or rule)):
            tree.append([])
        tree[-1].append(line)
    node = lambda kind, parts: hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()
    tops = []
    for section in tree:
        nodes = []
        for line in section:
            leaves, raw = [], line.encode()
            while raw:
                n = 0
                while n < min(160, len(raw)) and raw[n] not in b".,;:!?|":
                    n += 1
                while n < len(raw) and raw[n] in b".,;:!?|":
                    n += 1
                leaves.append(hashlib.blake2b(raw[:n], digest_size=16).digest())
                raw = raw[n:]
            nodes.append(node(b"paragraph", leaves))
        tops.append(node(b"section", nodes))
    return node(b"root", tops).hex()


@pytest.mark.parametrize("text", TEXTS)
def test_root(text):
    assert M.fingerprint(text.encode()).split("|")[0] == plain_root(text)


def test_roots_and_edits():
    marks = [M.fingerprint(t.encode()) for t in TEXTS]
    assert len({m.split("|")[0] for m in marks}) == len(TEXTS)
    text = "One two. Three, four.\nFive six. Seven.\n\nEight nine.\nTen. Eleven."
    mark = M.fingerprint(text.encode())
    assert M.differences(mark, mark) == [] and M.likeness(mark, mark) == 1
    assert M.differences(mark, M.fingerprint(text.replace("Seven", "7").encode())) == [(0, 1, 1)]
    assert M.differences(mark, M.fingerprint(text.replace("Ten.", "Ten;").encode())) == [(1, 2, 0)]
    assert M.differences(mark, M.fingerprint((text + "\nmore").encode())) == [(1, 3, 0)]
    assert 0.8 < M.likeness(mark, M.fingerprint(text.replace("Seven", "7").encode())) < 1
    assert M.likeness(M.fingerprint(b""), M.fingerprint(b"other")) == 0


def test_edits_of_whole_branches():
    body = "\n".join(f"# Part {n}\nLine {n} one, two {n}. Three {n}!\nSame old line.\nLast {n}." for n in range(12))
    extra = "# New\nA line, of its own.\nSame old line.\n"
    assert M.tree(body.encode()).digest.hex() == M.fingerprint(body.encode()).split("|")[0]
    told = lambda a, b: M.edits(a.encode(), b.encode())
    assert told(body, body) == []
    assert told(body, extra + body) == [("inserted", "section", None, (0,))]
    assert told(extra + body, body) == [("deleted", "section", (0,), None)]
    middle = body.replace("# Part 6", extra + "# Part 6")
    assert told(body, middle) == [("inserted", "section", None, (6,))]
    assert told(body, middle.replace("Three 9", "Drei 9")) == [("inserted", "section", None, (6,)), ("changed", "clause", (9, 1, 2), (10, 1, 2))]
    assert told(body, body.replace("Last 3.", "Last 3.\nAn added line.")) == [("inserted", "paragraph", None, (3, 4))]
    assert told("a. b. c.", "a. x. b. c.") == [("inserted", "clause", None, (0, 0, 1))]
    assert told("x. s. y. s.", "z. s. w. s.") == [("changed", "clause", (0, 0, 0), (0, 0, 0)), ("changed", "clause", (0, 0, 2), (0, 0, 2))]
    # a section that gets a blank line above it is still compared with itself
    assert told("One. Two.", "New, here.\n\nOne. Two.") == [("inserted", "section", None, (0,)), ("inserted", "paragraph", None, (1, 0))]


def flat(text):
    """(section, paragraph, clause) -> bytes by the tree's own cuts."""
    return {(s, p, c): piece for s, lines in enumerate(M.sections(text)) for p, line in enumerate(lines) for c, piece in enumerate(M.CLAUSE.findall(line))}


@pytest.mark.parametrize("seed", range(60))
def test_edits_account_for_every_clause(seed):
    """What no edit covers on either side is the same clauses in the same order."""
    rng = random.Random(seed)
    lines = [rng.choice(["# h", "", "a. b.", "c, d; e.", f"u{n}. v{n}.", "same."]) for n in range(rng.randint(0, 25))]
    other = list(lines)
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(other))
        other[at : at + rng.randint(0, 3)] = [rng.choice(["# n", "", "a. b.", "w. x. y.", f"z{rng.random()}."]) for _ in range(rng.randint(0, 3))]
    old, new = ("\n".join(x).encode() for x in (lines, other))
    found = M.edits(old, new)
    assert (found == []) == (old == new)
    rest = []
    for side, text in ((2, old), (3, new)):
        gone = {e[side] for e in found if e[side] is not None}
        rest.append([piece for place, piece in flat(text).items() if not any(place[:n] in gone for n in (1, 2, 3))])
    assert rest[0] == rest[1]
    assert len({(e[2], e[3]) for e in found}) == len(found)
    assert all(flat(old)[e[2]] != flat(new)[e[3]] for e in found if e[0] == "changed")


def test_located(spark):
    rows = [(1, "a. b.", "a. c.", "x"), (1, "a. b.", "a. c.", "x"), (None, None, "", "x"), (2, None, "new", "x"), (3, "é, " * 200_000, "é, " * 200_000 + "!", "x")]
    pairs = spark.createDataFrame(rows, "doc_id long, text string, edited string, edits string").repartition(3)
    got = sorted(((r.doc_id or 0, [tuple(e) for e in r.edits]) for r in M.located(pairs).collect()), key=repr)
    changed = [("changed", "clause", [0, 0, 1], [0, 0, 1])]
    assert got[:4] == [(0, []), (1, changed), (1, changed), (2, [("inserted", "clause", None, [0, 0, 0])])]
    assert got[4][0] == 3 and len(got[4][1]) == 1
    assert M.located(pairs.limit(0)).count() == 0


def check(rows, docs):
    """``docs``: (doc_id, text) in their order."""
    assert len(rows) == len(docs)
    left = [tuple(r) for r in rows]
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        mark, edited = M.fingerprint(text.encode()), M.fingerprint(changed.encode())
        want = (
            doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, edited,
            M.likeness(mark, edited), M.likeness(mark, M.fingerprint(following.encode())),
        )
        left.remove(want)
    assert left == []


@pytest.mark.parametrize("slices", ["1", "3", "40"])
def test_next_document(spark, slices):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab .\né😀", k=rng.randint(0, 60))), "r") for i in rng.sample(range(1000), 50)]
    rows += [(None, "lost", "r"), (5000, None, "r"), (5001, "same", "r"), (5001, "same", "r"), (5001, "other. words", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string")
    digest = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    ordered = sorted([(i, t or "") for i, t, _ in rows], key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", slices)
        check(M.compared(docs).collect(), ordered)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_rows(spark):
    docs = spark.createDataFrame([(1, "one two three. four")], "doc_id long, text string")
    check(M.compared(docs).collect(), [(1, "one two three. four")])
    assert M.compared(docs.filter("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = QUERIES["op3_merkle"](spark, sf).collect()
    check(rows, docs)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
