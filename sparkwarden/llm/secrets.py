"""Secrets by pattern, and weak parts of credentials where complementary parts stand together."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, text_list

# ---- fixed values: the base patterns --------------------------------------------------------------

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs: a shorter run holds no longer one
BASE_KINDS = ("assign", "access", "hex")

# ---- weak parts -----------------------------------------------------------------------------------

#: What an identifier, a secret and an endpoint may look like when nothing else says so; of any length, so a span ends where its value does.
IDENTIFIER = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9._@-]{3,}"
    r"|(?:AKIA|ASIA|AROA)[A-Z0-9]{4,})",
    re.ASCII,
)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
PASSED = re.compile(r"""(?<![A-Za-z0-9_])(?:pass(?:word|wd|phrase)?|pwd|secret(?:_?key)?)["']?\x20?[:=]\x20?["']?[^\s"']{4,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp|ssh)://[A-Za-z0-9._~:/@%?&=+-]{4,}"
    r"|(?:host(?:name)?|server|endpoint)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9.-]{4,})",
    re.ASCII,
)
NAMED = {"identifier": IDENTIFIER, "passphrase": PASSED, "endpoint": ENDPOINT}
WEAK_KINDS = ("identifier", "passphrase", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS


@dataclass(frozen=True)
class Settings:
    """Parts belong together within ``reach`` code points in the same scope; a weak secret has that many bits a sign."""

    reach: int = 240
    entropy: float = 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, failing matches dropped; by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scopes(text: str) -> list[int]:
    """Where scopes begin: the start of the text and what follows an empty line."""
    return [0] + [m.end() for m in re.finditer(r"\n[ \t]*\n", text)]


def _random_looking(text: str, least: float) -> bool:
    if not (re.search("[0-9]", text) and re.search("[a-z]", text) and re.search("[A-Z]", text)):
        return False
    counts = Counter(text)
    return -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values()) >= least


def weak_parts(text: str, base: list[tuple[int, int, str]], settings: Settings) -> list[tuple[int, int, str]]:
    """Candidates that alone mean nothing, but for what lies in a base span.

    A named part that a base span begins within, such as a long URL with a token, is cut off there.
    """
    found = [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    found += [(m.start(), m.end(), "passphrase") for m in PASSED.finditer(text)]
    found += [(m.start(), m.end(), "passphrase") for m in SECRET.finditer(text) if _random_looking(m.group(), settings.entropy)]
    found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    starts, reached = [s for s, _, _ in base], []
    for _, end, _ in base:
        reached.append(max(end, reached[-1] if reached else 0))
    free = []
    for start, end, kind in sorted(set(found)):
        before = bisect_left(starts, end)  # base spans that begin before this one ends
        if not before or reached[before - 1] <= start:
            free.append((start, end, kind))
            continue
        after = bisect_right(starts, start)
        if after < before and (not after or reached[after - 1] <= start) and NAMED[kind].fullmatch(text, start, starts[after]):
            free.append((start, starts[after], kind))
    return free


def linked_spans(text: str, settings: Settings = Settings()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, weak spans): a weak part counts where parts of other roles stand within reach in its scope.

    Base spans are parts as well: ``access`` identifies, ``assign`` and ``hex`` are secrets. An interval join
    of the parts, each widened by ``reach`` and cut off at its scope, links those of different roles. A
    weak secret needs an identifier or an endpoint, a weak identifier a secret, and a weak endpoint
    both. The join looks up the nearest part of each role on both sides in sorted lists, so its work grows with
    the parts and not with their pairs.
    """
    base = base_spans(text)
    weak = weak_parts(text, base, settings)
    if not weak:
        return base, []
    role = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "passphrase": "secret", "endpoint": "place"}
    parts: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "place": []}
    for start, end, kind in sorted(base + weak):
        parts[role[kind]].append((start, end))
    begins = {r: [s for s, _ in spans] for r, spans in parts.items()}
    ends = {r: sorted(e for _, e in spans) for r, spans in parts.items()}
    fences = scopes(text)

    def near(other: str, start: int, end: int) -> bool:
        at = bisect_right(fences, start)
        low = max(fences[at - 1], start - settings.reach)
        high = min(fences[at] if at < len(fences) else len(text), end + settings.reach)
        # a part overlaps [low, high) unless it ends by low or begins at high or later
        return bisect_left(begins[other], high) > bisect_right(ends[other], low)

    kept = []
    for start, end, kind in weak:
        held = {r for r in parts if r != role[kind] and near(r, start, end)}
        if {"identifier": "secret" in held, "passphrase": bool(held), "endpoint": {"id", "secret"} <= held}[kind]:
            kept.append((start, end, kind))
    return base, kept


def secrets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, base, weak), one row for each row of ``docs(doc_id, text)``: arrays of (start, end, kind).

    Code points, end exclusive, by start, then kind as listed. All parts of a credential stand in one text,
    so texts stay where they are. A null text counts as empty, without spans. Repeated rows give repeated rows, a null
    doc_id stays null, an empty table gives an empty result; other columns are not read.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linked_spans(t, settings) for t in text_list(batch.column(1))]
            sides = [[[dict(zip(("start", "end", "kind"), s)) for s in f[k]] for f in found] for k in (0, 1)]
            yield batch_of([("doc_id", batch.column(0), None), ("base", sides[0], spans), ("weak", sides[1], spans)])

    kind = "array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, base {kind}, weak {kind}"
    )
