"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Regex, gazetteer and context labelers vote on each of them; expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is, and a logistic span classifier is trained
on the resulting soft labels. Both fits see tables of distinct patterns, whose size is bounded by the number of
possible votes and features, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import free_name, whole_text
from sparkwarden.session import cut_lineage

BASE_KINDS = ("email", "ip", "card", "phone")

#: Linear forms of the base patterns: a match can only begin where a run of its characters does, or right after
#: the match before (``\\G``); repetitions give nothing back, as what follows them cannot match inside them.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "written_email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
}
KINDS = tuple(PATTERNS)
#: Plain strings of which a text must hold one for a pattern to be tried.
NEEDS = {
    "email": ["@"], "phone": ["+"], "written_email": ["(at", "[at"], "ssn": ["-"],
    "person": ["Mr", "Ms", "Dr", "Herr", "Frau", "Madame", "Monsieur", "Señor"],
}
#: Words next to a span that speak for it, and words that speak against it.
CUES = {
    "email": "mail|contact|write to|reach", "written_email": "mail|contact|write to|reach", "ip": r"\bip\b|address|host|server|client",
    "card": "card|visa|master|credit|payment", "phone": "phone|tel|call|mobile|fax|contact", "local_phone": "phone|tel|call|mobile|fax|contact",
    "ssn": "ssn|social|security", "iban": "iban|account|bank|transfer", "person": "name|contact|dear|signed|regards|by",
}
FOILS = "version|isbn|issn|invoice|order|part no|serial|build|chapter|figure"
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "it", "uk", "eu", "nl", "ch", "at", "us", "ca")
GIVEN_NAMES = (
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Maria",
    "Anna", "Peter", "Thomas", "Laura", "Hans", "Klaus", "Jean", "Marie", "Pierre", "Luis", "Carmen", "Jose", "Paul", "Julia",
)
LEFT, RIGHT = 48, 24
LABELERS = ("regex", "gazetteer", "cue", "foil")
CANDIDATE = "array<struct<kind:string,pos:int,gap:int,size:int,match:string,before:string,after:string>>"


# ---- candidates -----------------------------------------------------------------------------------


def _hits(text: Column, kind: str) -> Column:
    """All matches of one kind with their place among them, the length of the gap before, and what stands around."""

    def zipped(gaps: Column) -> Column:
        rows = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("match"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
        made = F.transform(
            rows,
            lambda r, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("pos"), F.length(r["gap"]).alias("gap"), F.length(r["match"]).alias("size"),
                r["match"].alias("match"), F.right(r["gap"], F.lit(LEFT)).alias("before"), F.left(r["next"], F.lit(RIGHT)).alias("after"),
            ),
        )
        return F.filter(made, lambda c: c["match"].isNotNull())

    # the split is bound to a name by a transform of one element, so that it is made once
    return F.transform(F.array(F.split(text, PATTERNS[kind], -1)), zipped)[0]


def _tried(text: Column, kind: str) -> Column:
    needs = NEEDS.get(kind)
    if not needs:
        return text.rlike("[0-9]")
    out = F.contains(text, F.lit(needs[0]))
    for need in needs[1:]:
        out = out | F.contains(text, F.lit(need))
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, pos, start, end, match, before, after), at least one row for each row of ``docs``.

    ``row`` numbers the rows of ``docs``; a row without a candidate has one row with null kind. The table
    is stored before positions are summed up, so that numbers stay as they are. Code points, end exclusive.
    """
    text = F.col("text")
    found = F.array(*[F.when(_tried(text, kind), _hits(text, kind)).cast(CANDIDATE) for kind in KINDS])
    stored = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("string").alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.explode_outer(F.flatten(F.filter(found, lambda a: a.isNotNull()))).alias("c"))
        .select("row", "doc_id", "c.*")
    )
    upto = Window.partitionBy("row", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return stored.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


# ---- labelers -------------------------------------------------------------------------------------


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets(match: Column) -> Column:
    """Whether all parts are at most 255; leading zeros do not count."""
    return F.forall(
        F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    )


def well_formed(kind: Column, match: Column) -> Column:
    """The checks of each kind beyond its pattern; for the base kinds these decide alone."""
    count = F.length(_digits(match))
    plain = F.regexp_replace(match, " ", "")
    # the remainder by 97 of the moved and spelt-out number, digit group by digit group
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    spelt = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    rest = F.aggregate(F.split(spelt, ""), F.lit(0), lambda a, d: (a * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97)
    return (
        F.when(kind == "ip", _octets(match))
        .when(kind == "card", F.when(count.between(13, 19), _luhn(_digits(match))).otherwise(False))
        .when(kind == "phone", count.between(9, 15))
        .when(kind == "ssn", ~match.rlike("^(000|666|9..)-|-00-|-0000$"))
        .when(kind == "iban", rest == 1)
        .otherwise(True)
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: Column, match: Column, before: Column, after: Column) -> dict[str, Column]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing."""
    good = well_formed(kind, match)
    top = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    mail = kind.isin("email", "written_email")
    known = (
        F.when(mail, _vote(top.isin(*TOP_DOMAINS), top.rlike("^[0-9]")))
        .when(kind == "ip", _vote(~match.rlike(r"^(0|127|255)\.|\.0\.0$|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), match.rlike(r"^(0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$")))
        .when(kind == "card", _vote(match.rlike("^[3-6]"), match.rlike("^[0-9]{1,8}$|^[0127-9]")))
        .when(kind == "person", _vote(match.rlike(r"\b(" + "|".join(GIVEN_NAMES) + r")\b"), F.lit(False)))
        .when(kind.isin("phone", "local_phone"), _vote(match.rlike(r"^\(?\+?[0-9]{1,3}[\x20().-]"), _digits(match).rlike(r"^(.)\1+$")))
        .otherwise(0)
    )
    near = F.lower(before)
    cue = F.lit(False)
    for name, words in CUES.items():
        cue = cue | ((kind == name) & near.rlike(words))
    return {
        "regex": _vote(good, ~good),
        "gazetteer": known,
        "cue": _vote(cue, F.lit(False)),
        "foil": _vote(F.lit(False), near.rlike(FOILS) | after.rlike("^[A-Za-z0-9_]")),
    }


def traits(match: Column) -> dict[str, Column]:
    """Further features of the classifier, each with few values."""
    size = F.length(match)
    share = F.length(_digits(match)) / F.greatest(size, F.lit(1))
    return {
        "length": F.when(size < 10, 0).when(size < 16, 1).when(size < 24, 2).otherwise(3),
        "digits": F.when(share < 0.1, 0).when(share < 0.7, 1).otherwise(2),
    }


# ---- fits on the driver, over tables of distinct patterns -----------------------------------------


@dataclass(frozen=True)
class Model:
    """``reliability[labeler][truth][vote]``, ``prior[kind]`` and the classifier's weight of each (feature, value)."""

    reliability: dict[str, dict[int, dict[int, float]]]
    prior: dict[str, float]
    weights: dict[tuple[str, object], float]
    bias: float


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict, dict]:
    """Expectation-maximisation for labelers that are independent given the truth.

    ``patterns``: kind, votes and how often they occur. Starts from labelers that are right more often than
    not; counts are smoothed by that belief, so a kind or vote never seen keeps it.
    """
    belief = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.15, 0: 0.35, -1: 0.5}}
    trust = {name: {t: dict(belief[t]) for t in belief} for name in LABELERS}
    prior = {kind: 0.5 for kind in KINDS}
    for _ in range(rounds):
        seen = {name: {t: {v: 20 * p for v, p in belief[t].items()} for t in belief} for name in LABELERS}
        true, total = {k: 2.0 for k in KINDS}, {k: 4.0 for k in KINDS}
        for kind, said, count in patterns:
            p = posterior(kind, said, trust, prior)
            true[kind] += p * count
            total[kind] += count
            for name, vote in zip(LABELERS, said):
                seen[name][1][vote] += p * count
                seen[name][0][vote] += (1 - p) * count
        prior = {k: true[k] / total[k] for k in KINDS}
        trust = {n: {t: {v: c / sum(by.values()) for v, c in by.items()} for t, by in seen[n].items()} for n in LABELERS}
    return trust, prior


def posterior(kind: str, said: tuple[int, ...], trust: dict, prior: dict) -> float:
    odds = math.log(prior[kind] / (1 - prior[kind]))
    for name, vote in zip(LABELERS, said):
        odds += math.log(trust[name][1][vote] / trust[name][0][vote])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(rows: list[tuple[dict, float, float]], steps: int = 300, rate: float = 0.5) -> tuple[dict, float]:
    """A logistic regression by gradient steps: feature values, soft label and weight of each distinct pattern."""
    weights: dict[tuple[str, object], float] = {}
    bias, total = 0.0, sum(w for _, _, w in rows) or 1.0
    keys = [[(n, v) for n, v in sorted(values.items())] for values, _, _ in rows]
    for _ in range(steps):
        change: dict[tuple[str, object], float] = {}
        drift = 0.0
        for mine, (_, label, weight) in zip(keys, rows):
            z = bias + sum(weights.get(k, 0.0) for k in mine)
            wrong = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label) * weight / total
            drift += wrong
            for k in mine:
                change[k] = change.get(k, 0.0) + wrong
        bias -= rate * drift
        for k, g in change.items():
            weights[k] = weights.get(k, 0.0) - rate * (g + 1e-4 * weights.get(k, 0.0))
    return weights, bias


def fit(found: DataFrame) -> Model:
    """Fit on all candidates: one aggregate over votes and features, then both fits over its few rows.

    To the candidates seen, one of each kind and vote pattern is added with a small weight and the label
    that the votes give, so that kinds that never occur are judged by their votes.
    """
    said = votes(F.col("kind"), F.col("match"), F.col("before"), F.col("after"))
    columns = [F.col("kind"), *[c.alias(n) for n, c in said.items()], *[c.alias(n) for n, c in traits(F.col("match")).items()]]
    table = found.filter("kind IS NOT NULL").select(*columns)
    rows = table.groupBy(*table.columns).count().collect()  # bounded: kinds x votes x features
    trust, prior = estimate([(r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in rows])
    names = [*LABELERS, *traits(F.lit(""))]
    sample = []
    for r in rows:
        p = posterior(r["kind"], tuple(r[n] for n in LABELERS), trust, prior)
        # the square root keeps frequent kinds from drowning the others
        sample.append(({"kind": r["kind"]} | {n: r[n] for n in names}, p, math.sqrt(r["count"])))
    heft = 0.01 * (sum(w for _, _, w in sample) or 1.0) / len(KINDS)
    for kind, vote in product(KINDS, product((-1, 0, 1), (-1, 0, 1), (0, 1), (-1, 0))):
        sample.append(({"kind": kind} | dict(zip(LABELERS, vote)), posterior(kind, vote, trust, prior), heft))
    weights, bias = train(sample)
    return Model(trust, prior, weights, bias)


def probability(model: Model, kind: Column, match: Column, before: Column, after: Column) -> Column:
    """The classifier as an expression: a weight for each feature's value, added up."""
    features = {"kind": kind} | votes(kind, match, before, after) | traits(match)
    logit = F.lit(model.bias)
    for name, value in features.items():
        chosen = None
        for (n, v), w in sorted(model.weights.items(), key=str):
            if n == name:
                chosen = F.when(value == v, F.lit(w)) if chosen is None else chosen.when(value == v, F.lit(w))
        if chosen is not None:
            logit = logit + chosen.otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def accepted(model: Model, kind: Column, match: Column, before: Column, after: Column, least: float = 0.5) -> Column:
    """Base kinds by their own checks alone; the others by the trained classifier."""
    return F.when(kind.isin(*BASE_KINDS), well_formed(kind, match)).otherwise(
        probability(model, kind, match, before, after) >= least
    )


# ---- results --------------------------------------------------------------------------------------


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, spans), one row for each row of ``docs(doc_id, text)``.

    ``spans``: array of (kind_no, kind, start, end) by kind as listed, then start. A null text counts as
    empty, without spans. Repeated rows give repeated rows, a null doc_id stays null, an empty table gives an
    empty result; other columns are not read.
    """
    found = candidates(docs)
    model = fit(found)
    ok = accepted(model, F.col("kind"), F.col("match"), F.col("before"), F.col("after"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    told = found.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return told.groupBy("row", "doc_id").agg(
        *[F.count_if(F.col("ok") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE_KINDS],
        F.sort_array(
            F.collect_list(F.when(F.col("ok"), F.struct(number.alias("kind_no"), "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
        ).alias("spans"),
    ).drop("row")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of all kinds replaced by ``[KIND]``; other columns, rows and places stay.

    Kinds are replaced one after the other, so of overlapping spans the kind named first is taken whole and
    what is left of the others is looked at again. ``n_chars``, where there is such a column, follows the
    new text of the rows that change. A null text stays null.
    """
    model = fit(candidates(docs))
    held = free_name(docs, "held_length")
    out = docs.withColumn("text", F.col("text").cast("string")).withColumn(held, F.length("text"))
    for kind in ("email", "phone", "card", "ip", *KINDS[len(BASE_KINDS) :]):
        out = out.withColumn("text", _replaced(F.col("text"), kind, model))
    size = next((f for f in docs.schema.fields if f.name.lower() == "n_chars"), None)
    if size:
        new = F.when(F.length("text") != F.col(held), F.length("text")).otherwise(F.col(size.name))
        out = out.withColumn(size.name, new.cast(size.dataType))
    return out.select(*docs.columns)


def _replaced(text: Column, kind: str, model: Model) -> Column:
    def rebuilt(t: Column) -> Column:
        parts = F.transform(
            _hits(t, kind),
            lambda c: F.when(
                accepted(model, F.lit(kind), c["match"], c["before"], c["after"]), F.lit(f"[{kind.upper()}]")
            ).otherwise(c["match"]),
        )
        gaps = F.split(t, PATTERNS[kind], -1)
        return F.array_join(F.zip_with(gaps, parts, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")

    return F.transform(F.array(text), lambda t: F.when(_tried(t, kind), rebuilt(t)).otherwise(t))[0]
