"""Merkle fingerprints of documents over sections, paragraphs and clauses."""

from __future__ import annotations

import re
from base64 import urlsafe_b64encode
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, whole_text
from sparkwarden.session import scratch_path

#: A clause ends after its punctuation; one without any is cut every 160 bytes.
CLAUSE = re.compile(rb"[^.,;:!?|]{1,160}[.,;:!?|]*|[.,;:!?|]+")
HEADING = re.compile(rb"#{1,6} |={3,}$|-{3,}$")
LEAF = 3
LETTERS = 4  # of a leaf in a fingerprint


# ---- the tree -------------------------------------------------------------------------------------


def _digest(kind: bytes, children: bytes) -> bytes:
    return blake2b(children, digest_size=16, person=kind).digest()


def sections(text: bytes) -> list[list[bytes]]:
    """Paragraphs (lines) by section; an empty line or a heading begins a section, and belongs to it."""
    out: list[list[bytes]] = [[]]
    for line in text.split(b"\n"):
        if out[-1] and (not line.strip() or HEADING.match(line)) and out[-1][-1].strip():
            out.append([])
        out[-1].append(line)
    return out


def fingerprint(text: bytes) -> str:
    """``root|section/section`` with a section's paragraphs between dots, each the short digests of its clauses.

    A clause's digest covers its bytes, a paragraph's those of its clauses, a section's those of its paragraphs
    and the root those of its sections, so equal roots mean equal texts. The string keeps the root in whole
    and the leaves in short form, in the shape of the tree: ``differences`` walks it down to what was edited.
    """
    tops, shown = [], []
    for section in sections(text):
        nodes, parts = [], []
        for paragraph in section:
            leaves = [blake2b(c, digest_size=16).digest() for c in CLAUSE.findall(paragraph)]
            nodes.append(_digest(b"paragraph", b"".join(leaves)))
            parts.append(urlsafe_b64encode(b"".join([d[:LEAF] for d in leaves])).decode())
        tops.append(_digest(b"section", b"".join(nodes)))
        shown.append(".".join(parts))
    return _digest(b"root", b"".join(tops)).hex() + "|" + "/".join(shown)


def leaves(mark: str) -> Counter:
    """The clauses of a fingerprint and how often each occurs."""
    flat = mark.partition("|")[2].replace("/", "").replace(".", "")
    return Counter(flat[i : i + LETTERS] for i in range(0, len(flat), LETTERS))


def likeness(one: str, other: str) -> float:
    """Shared clauses of two fingerprints: twice their number over the number of both; 1 for equal roots."""
    if one.partition("|")[0] == other.partition("|")[0]:
        return 1.0
    a, b = leaves(one), leaves(other)
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def differences(one: str, other: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, clause) places of ``one`` whose clause differs from that at the same place in ``other``.

    Branches that are equal are not entered. A place that only one of the two has differs. Only short leaves and the
    root are at hand here: what moves shifts all places after it. :func:`edits` has the texts, keeps all digests and aligns branches.
    """
    if one.partition("|")[0] == other.partition("|")[0]:
        return []
    out = []
    for s, (a, b) in enumerate(_paired(one.partition("|")[2].split("/"), other.partition("|")[2].split("/"))):
        if a == b:
            continue
        for p, (c, d) in enumerate(_paired(*[[] if x is None else x.split(".") for x in (a, b)])):
            if c == d:
                continue
            cut = [[] if x is None else [x[i : i + LETTERS] for i in range(0, len(x), LETTERS)] for x in (c, d)]
            changed = [(s, p, k) for k, (e, f) in enumerate(_paired(*cut)) if e != f]
            out += changed or [(s, p, 0)]
    return out


def _paired(a: list, b: list) -> list[tuple]:
    longest = max(len(a), len(b))
    return list(zip(a + [None] * (longest - len(a)), b + [None] * (longest - len(b))))


# ---- edits located by the whole tree ----------------------------------------------------------------

LEVELS = ("section", "paragraph", "clause")
EDIT_FIELDS = "kind string, level string, old array<int>, new array<int>"


class Node(NamedTuple):
    """A digest of 16 bytes and the children it covers; a clause has none."""

    digest: bytes
    children: list[Node]


def tree(text: bytes) -> Node:
    """The whole tree, every inner digest kept; its root is that of ``fingerprint``."""
    tops = []
    for section in sections(text):
        nodes = []
        for paragraph in section:
            leaves = [Node(blake2b(c, digest_size=16).digest(), []) for c in CLAUSE.findall(paragraph)]
            nodes.append(_node(b"paragraph", leaves))
        tops.append(_node(b"section", nodes))
    return _node(b"root", tops)


def _node(kind: bytes, children: list[Node]) -> Node:
    return Node(_digest(kind, b"".join([c.digest for c in children])), children)


def edits(old: bytes, new: bytes) -> list[tuple[str, str, tuple[int, ...] | None, tuple[int, ...] | None]]:
    """(kind, level, place in old, place in new) of what was ``inserted``, ``deleted`` or ``changed``; none for equal texts.

    Branches of equal digest are not entered. The children of two branches that differ are aligned before they are entered:
    by digests that occur once on both sides, then by what they share below. A branch without a counterpart is one edit,
    however much it holds; places are (section, paragraph, clause), cut at the level. Digests have 128 bits, so no edit is hidden.
    """
    out: list[tuple] = []
    todo = [(tree(old), tree(new), (), ())]
    while todo:
        a, b, at_a, at_b = todo.pop()
        if a.digest == b.digest:
            continue
        level = LEVELS[len(at_a)]
        for i, j in aligned(a.children, b.children):
            place = (None if i is None else (*at_a, i), None if j is None else (*at_b, j))
            if i is None or j is None:
                out.append(("inserted" if i is None else "deleted", level, *place))
            elif level != "clause":
                todo.append((a.children[i], b.children[j], *place))
            elif a.children[i].digest != b.children[j].digest:
                out.append(("changed", level, *place))
    return sorted(out, key=lambda e: (e[3] or e[2], e))


def aligned(a: list[Node], b: list[Node]) -> list[tuple[int | None, int | None]]:
    """The children that differ: pairs to compare, and single ones of either side."""
    out = []
    for i0, i1, j0, j1 in _between(_same(a, b), len(a), len(b)):
        while i0 < i1 and j0 < j1 and a[i0].digest == b[j0].digest:
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1].digest == b[j1 - 1].digest:
            i1, j1 = i1 - 1, j1 - 1
        kin = _rising(_kin(a[i0:i1], b[j0:j1]))
        for k0, k1, m0, m1 in _between(kin, i1 - i0, j1 - j0):
            both = min(k1 - k0, m1 - m0)
            out += [(i0 + k0 + n, j0 + m0 + n) for n in range(both)]
            out += [(i0 + k, None) for k in range(k0 + both, k1)] + [(None, j0 + m) for m in range(m0 + both, m1)]
        out += [(i0 + k, j0 + m) for k, m in kin]
    return out


def _same(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places of the digests that both sides have once, in the order of both."""
    often = Counter(n.digest for n in a), Counter(n.digest for n in b)
    place = {n.digest: j for j, n in enumerate(b)}
    return _rising([(i, place[n.digest]) for i, n in enumerate(a) if often[0][n.digest] == 1 == often[1][n.digest]])


def _kin(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """For each child the one of the other side that shares most of the clauses known there, the first of equals."""
    first: dict[bytes, int] = {}
    for j, node in enumerate(b):
        for digest in _clauses(node):
            first.setdefault(digest, j)
    votes = [Counter(first[d] for d in _clauses(node) if d in first) for node in a]
    return [(i, min(found, key=lambda j: (-found[j], j))) for i, found in enumerate(votes) if found]


def _clauses(node: Node) -> Iterator[bytes]:
    for child in node.children:
        if child.children:
            yield from _clauses(child)
        elif child.digest != EMPTY:
            yield child.digest


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises on both sides."""
    ends: list[int] = []
    tails: list[int] = []
    before: list[int | None] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k:k + 1], tails[k:k + 1] = [j], [n]
        before.append(tails[k - 1] if k else None)
    run, n = [], tails[-1] if tails else None
    while n is not None:
        run.append(pairs[n])
        n = before[n]
    return run[::-1]


def _between(anchors: list[tuple[int, int]], m: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """The stretches of both sides before, between and after anchors."""
    i = j = 0
    for x, y in [*anchors, (m, n)]:
        yield i, x, j, y
        i, j = x + 1, y + 1


EMPTY = _digest(b"paragraph", b"")


def located(pairs: DataFrame, old: str = "text", new: str = "edited") -> DataFrame:
    """(doc_id, edits) for each row of two versions of a text: see :func:`edits`; an empty list for equal ones.

    A null text counts as empty, a null doc_id stays null, repeated rows give a row each, an empty table none; other
    columns are not read. Rows stay where they are, a task holds the trees of one row, some 100 bytes a clause.
    """
    rows = pairs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c), F.lit("")).cast("binary") for c in (old, new)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.string()), ("old", pa.list_(pa.int32())), ("new", pa.list_(pa.int32()))]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("kind", "level", "old", "new"), e)) for e in edits(a.as_py(), b.as_py())]
                for a, b in zip(batch.column(1), batch.column(2))
            ]
            yield batch_of([("doc_id", batch.column(0).to_pylist(), pa.int64()), ("edits", found, kind)])

    return rows.mapInArrow(walk, f"doc_id long, edits array<struct<{EDIT_FIELDS.replace(' ', ':').replace(',:', ',')}>>")


# ---- documents and their edited texts -------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first characters of the following text, or all it has."""
    size = len(text) // 4
    return text[: len(text) - size] + following[:size]


#: What a task makes of a document. Of the edited text's fingerprint the root and what follows the leaves shared
#: with the original one, as the first three quarters of both are the same.
FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_root string, shared int, edited_tail string, "
    "near_edited double, near_next double"
)


def _row(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following).encode()
    edited_mark = fingerprint(changed)
    root, _, body = edited_mark.partition("|")
    shared = len(commonprefix([mark.partition("|")[2], body]))
    return (
        doc_id, len(text), sha256(changed).hexdigest(), mark, root, shared, body[shared:],
        likeness(mark, edited_mark), likeness(mark, next_mark),
    )


def _whole() -> list[Column]:
    """The results of ``FIELDS`` with the edited text's fingerprint put together again."""
    body = F.substring_index("fingerprint", "|", -1)
    made = F.concat("edited_root", F.lit("|"), F.left(body, F.col("shared")), "edited_tail")
    return [*map(F.col, ("doc_id", "n_chars", "edited_sha256", "fingerprint")), made.alias("edited_fingerprint"), F.col("near_edited"), F.col("near_next")]


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    Its edited text ends as the next document, by ascending doc_id, begins; ``near_edited`` and ``near_next``
    are the likeness of its fingerprint to the edited text's and to the next document's. After the last
    comes the first. A null text counts as empty; rows of equal doc_id follow each other by the hashes of their texts
    (XXH64, seed 42, signed), rows without id come first. Repeated rows give a row each, a single row is its own next one, an empty table gives an
    empty result; other columns are not read.

    Texts move once, into ranges of doc_id, where each document but the last of a range meets the next one.
    Only the first and last document of each range, stored with the results, are matched in a second step.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("string").alias("text"))
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash, not the text, takes part in the choice of ranges, for which the driver gets a sample of the keys
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(slices, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in FIELDS.split(", ")]

    def table_of(made: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        """Results, then the range's first and last document with their texts (role, range)."""
        columns = [list(c) for c in zip(*made)] if made else [[] for _ in names]
        columns[0] += [doc_id for _, _, doc_id, _, _ in edges]
        columns[3] += [mark for _, _, _, _, mark in edges]
        for i in (1, 2, *range(4, len(names))):
            columns[i] += [None] * len(edges)
        extra = [[None] * len(made) + [e[i] for e in edges] for i in (0, 1, 3)]
        return batch_of(
            [*zip(names, columns, types), ("role", extra[0], pa.string()), ("range", extra[1], pa.int64()), ("text", extra[2], pa.string())]
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held = TaskContext.get().partitionId(), None
        for batch in batches:
            made, edges = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = fingerprint(text.encode())
                if held is None:
                    edges.append(("first", place, doc_id, text, mark))
                else:
                    made.append(_row(*held, text, mark))
                held = (doc_id, text, mark)
            yield table_of(made, edges)
        if held is not None:
            yield table_of([], [("last", place, *held)])

    path = scratch_path(docs.sparkSession, "merkle")
    made = ordered.mapInArrow(walk, f"{FIELDS}, role string, range long, text string")
    made.write.option("compression", "zstd").parquet(path)  # digests only shrink by their letters' entropy
    stored = docs.sparkSession.read.parquet(path)
    inner = stored.filter("role IS NULL").select(*names)
    edges = stored.filter("role IS NOT NULL").select("role", "range", "doc_id", "text", F.col("fingerprint").alias("mark"))
    # one row for each range of the shuffle, without texts
    order = Window.orderBy("range")
    places = edges.filter("role = 'first'").select("range")
    next_range = places.select("range", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())).alias("then"))
    firsts = edges.filter("role = 'first'").select(F.col("range").alias("then"), F.col("text").alias("next_text"), F.col("mark").alias("next_mark"))
    meet = edges.filter("role = 'last'").join(next_range, "range").join(firsts, "then")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_row(*values) for values in zip(*[c.to_pylist() for c in batch.columns])]
            columns = [list(c) for c in zip(*made)] if made else [[] for _ in names]
            yield batch_of(zip(names, columns, types))

    closed = meet.select("doc_id", "text", "mark", "next_text", "next_mark").mapInArrow(close, FIELDS)
    return inner.union(closed).select(*_whole())
