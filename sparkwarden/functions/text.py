"""Text column helpers that agree with Python's string methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of str.splitlines and the whitespace of str.strip.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WHITESPACE = r"\s\x1C-\x1F\x{85}\p{Z}"

# Fixed value: the namespace below which proposal ids are derived.
PROPOSAL_NAMESPACE = "7ba4b810-9dad-11d1-80b4-00c04fd430c8"


def strip(text: Column) -> Column:
    """``str.strip()``; the possessive tail keeps long inner blanks linear."""
    return F.regexp_replace(
        text, rf"\A[{WHITESPACE}]++|(?<![{WHITESPACE}])[{WHITESPACE}]++\z", ""
    )


def raw_lines(text: Column) -> Column:
    """The text cut at every line boundary; a final line break leaves one empty element more.

    Nearly all text only has ``\\n``, which splits without a regular expression; other boundaries are
    mapped to it first.
    """
    rare = reduce(lambda a, b: a | b, [text.contains(c) for c in RARE_BREAKS])
    unified = F.translate(
        F.replace(text, F.lit("\r\n"), F.lit("\n")), RARE_BREAKS, "\n" * len(RARE_BREAKS)
    )
    return F.when(rare, F.split(unified, "\n", -1)).otherwise(F.split(text, "\n", -1))


def split_lines(text: Column) -> Column:
    """``str.splitlines()`` as an array, for non-empty text: nothing after a final line break."""
    ends = reduce(lambda a, b: a | b, [text.endswith(c) for c in RARE_BREAKS], text.endswith("\n"))
    extra = F.when(text.endswith("\r\n"), 2).otherwise(1)
    return raw_lines(F.when(ends, F.substr(text, F.lit(1), F.length(text) - extra)).otherwise(text))


def read_text(data: Column) -> Column:
    """Bytes to text: bad UTF-8 becomes U+FFFD and every newline form becomes ``\\n``."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "\r\n?", "\n")


def uuid5(key: Column, namespace: str = PROPOSAL_NAMESPACE) -> Column:
    """RFC 4122 name-based (SHA-1) id, computed with built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def proposal_id(rule_id: Column, file_path: Column, line_number: Column) -> Column:
    """Same rule, file and line give the same id; a missing line counts as empty."""
    line = F.coalesce(line_number.cast("string"), F.lit(""))
    return uuid5(F.concat(rule_id, F.lit(":"), file_path, F.lit(":"), line))


def slug(name: Column) -> Column:
    """Lower-case name with runs of other characters as ``_``; ``platform`` if nothing is left."""
    joined = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit("")), F.lit("platform"))


def redact(message: Column, secret: Column) -> Column:
    """Replace a secret inside a message; an empty or missing secret changes nothing."""
    return F.when(F.coalesce(secret, F.lit("")) == "", message).otherwise(
        F.replace(message, secret, F.lit("***"))
    )


def template(text: str, **values: Column) -> Column:
    """Concatenate a ``{name}`` template with columns."""
    import string

    parts: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if field:
            parts.append(values[field].cast("string"))
    return F.concat(*parts) if parts else F.lit("")
