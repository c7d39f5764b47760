"""String and path helpers against Python's own."""

import fnmatch
import random
import re
import uuid

from pyspark.sql import functions as F

from sparkwarden.functions import paths as P
from sparkwarden.functions import text as T

ALPHABET = list("ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  \xa0　é") + ["\r\n"]


def strings(n, alphabet, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def apply(spark, values, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


def test_split_lines_and_strip_equal_python(spark):
    values = strings(800, ALPHABET, 12, 1)
    got = apply(spark, values, T.split_lines(F.col("v")), T.strip(F.col("v")))
    for value, (lines, stripped) in zip(values, got):
        if value:
            assert lines == value.splitlines(), repr(value)
        assert stripped == value.strip(), repr(value)


def test_raw_lines_only_add_a_last_empty_line(spark):
    values = [v for v in strings(300, ALPHABET, 10, 2) if v]
    for value, (lines,) in zip(values, apply(spark, values, T.raw_lines(F.col("v")))):
        assert lines in (value.splitlines(), value.splitlines() + [""])


def test_proposal_id_is_uuid5(spark):
    values = strings(200, list("aé:/.  \U0001f600"), 10, 3)
    ids = apply(spark, values, T.proposal_id(F.lit("r"), F.col("v"), F.lit(7)), T.proposal_id(F.lit("r"), F.col("v"), F.lit(None)))
    space = uuid.UUID(T.PROPOSAL_NAMESPACE)
    for value, (numbered, bare) in zip(values, ids):
        assert numbered == str(uuid.uuid5(space, f"r:{value}:7"))
        assert bare == str(uuid.uuid5(space, f"r:{value}:"))


def test_read_text_replaces_bad_bytes_and_newlines(spark):
    data = [b"a\xffb", b"\xe2\x82", b"\xed\xa0\x80", b"x\r\ny\rz\n", b"", "é ".encode()]
    frame = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i INT, d BINARY")
    got = [r[0] for r in frame.orderBy("i").select(T.read_text(F.col("d"))).collect()]
    assert got == [re.sub("\r\n?", "\n", d.decode("utf-8", "replace")) for d in data]


def test_slug_and_redact(spark):
    got = apply(spark, ["Python Backend", "--", "C++ / Go", ""], T.slug(F.col("v")))
    assert [g[0] for g in got] == ["python_backend", "platform", "c_go", "platform"]
    keyed = apply(spark, ["no sk-1 and sk-1"], T.redact(F.col("v"), F.lit("sk-1")), T.redact(F.col("v"), F.lit("")))
    assert keyed == [("no *** and ***", "no sk-1 and sk-1")]


PATTERNS = [
    "*.py", "*.PY", "a?c", "[ab]*", "[!ab]*", "[a-c]x*", "[]]*", "[!]x]*", "[", "[a", "x[z-a]y", "*[[]*", "a\\b",
    "**/x", "src/*/t?st_[0-9].py", "[a-c-e]*", "[-a]*", "[^a]*", "", "*", "?",
]


def test_glob_equals_fnmatch(spark):
    values = strings(300, list("abcxyz-]^[/.\\\n0Ppy") + ["src/", "test_1.py"], 8, 4)
    columns = [F.col("v").rlike(P.glob_regex(p)) for p in PATTERNS]
    for value, row in zip(values, apply(spark, values, *columns)):
        for pattern, got in zip(PATTERNS, row):
            assert got == fnmatch.fnmatchcase(value, pattern), (value, pattern)


def plain_match(path, root, patterns):
    relative = path[len(root) + 1 :]
    base = relative.rsplit("/", 1)[-1]
    forms = [f for c in (relative, base, path) for f in (c, c.lower())]
    for pattern in (p.strip().replace("\\", "/") for p in patterns):
        if not pattern:
            continue
        if pattern.lower() in relative.lower().split("/"):
            return True
        if any(fnmatch.fnmatchcase(f, pattern) or pattern.lower() in f.lower() for f in forms):
            return True
    return False


def test_filter_modes(spark):
    root = "/home/build/Proj"
    paths = [f"{root}/{p}" for p in ("src/a.py", "Vendor/b.min.js", "node_modules/x.ts", "A.PY", "pkg.egg-info/c.py", "distance.py", ".github/w.py")]
    frame = spark.createDataFrame([(root, p) for p in paths], "root STRING, file_path STRING")
    lists = ([], ["vendor"], ["*.min.js"], ["*.PY"], ["*.egg-info"], ["dist"], [".git"], ["build"], [" src\\a ", "", 5], ["*.py"])
    for include in lists:
        for exclude in lists:
            for mode in ("include_all", "include_only", "exclude_only", "else"):
                config = {"include_patterns": include, "exclude_patterns": exclude, "default_behavior": mode}
                keep = P.PathFilter.from_config(config).keep(F.col("file_path"), F.col("root"))
                if random.Random(f"{config}").random() > 0.1:
                    continue
                got = {r[0] for r in frame.filter(keep).select("file_path").collect()}
                text = lambda values: [v for v in values if isinstance(v, str)]
                out = {p for p in paths if plain_match(p, root, text(exclude))}
                want = set(paths) - out
                if mode == "include_only":
                    want = {p for p in want if plain_match(p, root, text(include))}
                assert got == want, config


def test_extensions_are_case_sensitive(spark):
    got = apply(spark, ["a.py", "a.PY", ".py", "a.pyc", "b.blade.php"], P.has_extension(F.col("v"), [".py", ".php"]))
    assert [g[0] for g in got] == [True, False, True, False, True]
