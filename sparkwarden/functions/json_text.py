"""Extracting JSON objects, findings and scores from model output."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys that may hold findings and scores, first one wins.
FINDING_KEYS = ("findings", "vulnerabilities", "issues", "performance_issues")
SCORE_KEYS = ("overall_score", "security_score", "quality_score", "performance_score")

# Brace blocks with at most one inner level. Possessive: no backtracking stack on long outputs.
BRACE_BLOCK = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
# A whole number in JSON text, bare or quoted; quoted ones may have blanks and single underscores.
INTEGER_TEXT = r'\A"?(?:\s|\\[tnrf])*([+-]?\d+(?:_\d+)*)(?:\s|\\[tnrf])*"?\z'

# Messages for a parsed value that cannot be asked for keys.
ABORT_MESSAGES = {
    "list": "list indices must be integers or slices, not str",
    "string": "string indices must be integers, not 'str'",
    "int": "argument of type 'int' is not iterable",
    "float": "argument of type 'float' is not iterable",
    "bool": "argument of type 'bool' is not iterable",
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with a costly ``value`` computed a single time however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_json(text: Column) -> Column:
    """The text as VARIANT if, as a whole, it is exactly one JSON value; else NULL.

    The parser alone ignores anything after the first value, so the text has to survive being
    wrapped both as an array element and as an object member.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return _once(
        listed, lambda v: F.when(v.isNotNull() & keyed.isNotNull(), F.try_variant_get(v, "$[0]", "variant"))
    )


def brace_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty if there is no such span."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parse_direct(raw: Column) -> Column:
    """Whole text, else its outermost brace span. May be a list, scalar or JSON null."""
    inner = _once(brace_span(raw), lambda span: F.when((span != "") & (span != raw), strict_json(span)))
    return F.when(raw != "", F.coalesce(strict_json(raw), inner))


def parse_noisy(raw: Column) -> Column:
    """First brace block that is an object, else the whole text if that is one."""
    from sparkwarden.functions.text import strip

    blocks = F.transform(F.regexp_extract_all(raw, F.lit(BRACE_BLOCK), F.lit(0)), strict_json)
    whole = strict_json(strip(raw))
    return F.coalesce(
        F.get(F.filter(blocks, lambda v: v.isNotNull()), F.lit(0)),
        F.when(_first_char(raw) == "{", whole),
    )


def _first_char(text: Column) -> Column:
    return F.regexp_extract(text, r"[^ \t\r\n]", 0)


def kind(value: Column) -> Column:
    """object, list, string, bool, null, int or float; NULL for no value."""
    text = F.to_json(value)
    starts = {"{": "object", "[": "list", '"': "string", "t": "bool", "f": "bool", "n": "null"}
    names = F.create_map(*[F.lit(part) for pair in starts.items() for part in pair])
    number = F.when(text.rlike(r"\A-?\d+\z"), "int").otherwise("float")
    return F.when(
        value.isNotNull(), F.coalesce(F.try_element_at(names, F.substring(text, 1, 1)), number)
    )


def _first_key(value: Column, keys: tuple[str, ...], as_type: str) -> Column:
    return F.coalesce(*[F.try_variant_get(value, f"$.{k}", as_type) for k in keys])


def usable_direct(value: Column) -> Column:
    """Anything but no value and JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def usable_noisy(value: Column) -> Column:
    """A non-empty object (the parser returns nothing but objects)."""
    members = F.try_variant_get(value, "$", "map<string,variant>")
    return F.coalesce(F.size(members) > 0, F.lit(False))


def abort_direct(value: Column, raw: Column) -> Column:
    """Error text if looking up keys in the value parsed from ``raw`` breaks the task, else NULL.

    Objects are fine, numbers and booleans never; a list or a string breaks only when one of the
    key names occurs in it. A text that starts with a brace can only have given an object.
    """
    keys = FINDING_KEYS + SCORE_KEYS
    what = kind(value)
    named = F.exists(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda m: F.to_json(m).isin(*[f'"{k}"' for k in keys]),
    )
    text = F.try_variant_get(value, "$", "string")
    mentioned = reduce(lambda a, b: a | b, [text.contains(k) for k in keys])
    scalar = {k: m for k, m in ABORT_MESSAGES.items() if k not in ("list", "string")}
    messages = F.create_map(*[F.lit(part) for pair in scalar.items() for part in pair])
    return F.when(
        _first_char(raw) != "{",
        F.when(what == "list", F.when(F.coalesce(named, F.lit(False)), ABORT_MESSAGES["list"]))
        .when(what == "string", F.when(mentioned, ABORT_MESSAGES["string"]))
        .otherwise(F.try_element_at(messages, what)),
    )


def findings_direct(value: Column) -> Column:
    """The first findings key that holds a list."""
    found = _first_key(value, FINDING_KEYS, "array<variant>")
    return F.coalesce(found, F.array().cast("array<variant>"))


def findings_noisy(value: Column) -> Column:
    """The value of the first findings key present, as list items.

    A string counts as its characters and an object as its keys; a scalar gives NULL, which callers
    treat as a failing task.
    """
    found = _first_key(value, FINDING_KEYS, "variant")
    what = kind(found)
    text = F.try_variant_get(found, "$", "string")
    parts = F.when(what == "string", F.filter(F.split(text, ""), lambda c: c != "")).when(
        what == "object", F.json_object_keys(F.to_json(found))
    )
    as_values = F.transform(
        parts, lambda p: F.try_variant_get(F.to_variant_object(F.array(p)), "$[0]", "variant")
    )
    empty = F.array().cast("array<variant>")
    return F.coalesce(
        F.try_variant_get(found, "$", "array<variant>"), F.when(found.isNull(), empty), as_values
    )


def score_direct(value: Column) -> Column:
    """The first score key present as a whole number; a value that is none ends the search."""
    text = F.to_json(_first_key(value, SCORE_KEYS, "variant"))
    digits = F.replace(F.regexp_extract(text, INTEGER_TEXT, 1), F.lit("_"), F.lit(""))
    return (
        F.when(digits != "", digits.try_cast("bigint"))
        .when(text.isin("true", "false"), (text == "true").cast("bigint"))
        .when(text.rlike(r"\A-?\d"), text.try_cast("double").try_cast("bigint"))
    )


def score_noisy(value: Column) -> Column:
    """The first score key present, unchanged, as JSON text; JSON null counts as no score."""
    return F.nullif(F.to_json(_first_key(value, SCORE_KEYS, "variant")), F.lit("null"))
