"""Path predicates: extensions, wildcard, substring and include/exclude modes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions the rule scan looks at, and the filter modes.
SCAN_EXTENSIONS = (".py", ".php", ".js", ".ts")
FILTER_MODES = ("include_all", "include_only", "exclude_only")


def relative_path(path: Column, root: Column) -> Column:
    """The path below its root (the root carries no trailing slash)."""
    return F.substr(path, F.length(root) + F.lit(2))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    """Case-sensitive suffix test; plain ``endswith`` so that it reaches a Parquet scan."""
    return reduce(lambda a, b: a | b, [path.endswith(e) for e in extensions], F.lit(False))


def normalise_patterns(values: Iterable[object] | None) -> list[str]:
    """Keep non-blank strings, trimmed and with forward slashes, in order and without repeats."""
    cleaned = (v.strip().replace("\\", "/") for v in values or () if isinstance(v, str))
    return list(dict.fromkeys(p for p in cleaned if p))


def _char_class(body: str, negated: bool) -> str:
    ranges, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            i += 3
        else:
            low = high = body[i]
            i += 1
        if low <= high:
            ranges.append(rf"\x{{{ord(low):x}}}-\x{{{ord(high):x}}}")
    if not ranges:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(ranges)}]"


def _literal(text: str) -> str:
    """The text as a regex without special characters."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in text)


def glob_regex(pattern: str) -> str:
    """A shell wildcard as an anchored Java regex; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            out.append(".*" if not out or out[-1] != ".*" else "")
        elif char == "?":
            out.append(".")
        elif char == "[":
            negated = pattern[i : i + 1] == "!"
            start = i + negated
            # the closing bracket may not be the first member
            end = pattern.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
            else:
                out.append(_char_class(pattern[start:end], negated))
                i = end + 1
        else:
            out.append(_literal(char))
    return rf"\A(?s:{''.join(out)})\z"


def part_equals(path: Column, root: Column, pattern: str) -> Column:
    """The lower-cased pattern is one whole component of the relative path."""
    return F.array_contains(F.split(F.lower(relative_path(path, root)), "/"), pattern.lower())


def glob_matches(path: Column, root: Column, pattern: str) -> Column:
    """Wildcard test on the relative path, file name and absolute path, as is and lower-cased."""
    regex = glob_regex(pattern)
    relative, base = relative_path(path, root), base_name(path)
    candidates = [c for p in (relative, base, path) for c in (p, F.lower(p))]
    return reduce(lambda a, b: a | b, [c.rlike(regex) for c in candidates])


def contains_text(path: Column, pattern: str) -> Column:
    """The lower-cased pattern occurs, wildcard characters taken literally, in the absolute path."""
    return F.lower(path).contains(pattern.lower())


def matches_any(path: Column, root: Column, patterns: Iterable[str]) -> Column:
    """True if one pattern matches by component, wildcard or substring; no patterns: false.

    A matching component and a pattern without wildcards are also substrings of the absolute path, so
    all patterns share one substring search and only real wildcards need an expression of their own.
    """
    patterns = normalise_patterns(patterns)
    if not patterns:
        return F.lit(False)
    texts = "|".join(_literal(p.lower()) for p in patterns)
    globs = [glob_matches(path, root, p) for p in patterns if any(c in p for c in "*?[")]
    return reduce(lambda a, b: a | b, globs, F.lower(path).rlike(texts))


@dataclass(frozen=True)
class PathFilter:
    """Include and exclude patterns with one of the three modes."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    mode: str = "include_all"

    @classmethod
    def from_config(cls, config: dict | None) -> PathFilter:
        config = config or {}
        mode = config.get("default_behavior", "include_all")
        return cls(
            tuple(normalise_patterns(config.get("include_patterns"))),
            tuple(normalise_patterns(config.get("exclude_patterns"))),
            mode if mode in FILTER_MODES else "include_all",
        )

    def keep(self, path: Column, root: Column) -> Column:
        kept = ~matches_any(path, root, self.exclude)
        if self.mode == "include_only":
            return matches_any(path, root, self.include) & kept
        return kept
