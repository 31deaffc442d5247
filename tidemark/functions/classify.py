"""Classification ladders and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

# Extensions by language, and the names of the kind ladder.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust"}
VENDOR = ["node_modules", "vendor", "third_party", "thirdparty", "dist", "build", "target", ".venv", "venv", "site-packages", "__pycache__", ".git"]
TESTS = ["test", "tests", "__tests__", "e2e", "spec", "specs", "testing", "testutils", "test_utils", "testutil", "test_util", "testsupport", "test_support"]
DATA = ["fixtures", "fixture", "snapshots", "__snapshots__", "testdata"]
GENERATED = ["migrations", "generated", "__generated__", "gen"]
FIX_WORDS = [
    "fix", "fixes", "fixed", "fixing", "bugfix", "bugfixes", "hotfix", "hotfixes", "bug", "bugs", "buggy", "regression", "regressions", "regress", "regressed", "broke",
    "broken", "crash", "crashes", "crashed", "crashing", "repair", "repairs", "repaired", "correct", "corrects", "corrected", "correction", "patch", "patched", "wrong", "incorrect", "flake", "flaky", "flakey",
]
BOTS = ["[bot]", "dependabot", "renovate", "pre-commit-ci"]
MARKERS = ["@generated", "code generated", "do not edit", "auto-generated", "autogenerated"]
TEST_SUFFIXES = ["_test", ".test", ".spec", ".snapshots", "Probes"]


def language(path) -> F.Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def has_marker(content, lines: int = 8) -> F.Column:
    """A generated marker in the first lines, any case."""
    head = F.lower(F.array_join(F.slice(F.split(content, "\n"), 1, lines), "\n"))
    found = F.lit(False)
    for m in MARKERS:
        found = found | F.contains(head, F.lit(m))
    return found


def logic_density(content) -> F.Column:
    """Lines with control flow over lines that are neither blank nor comments."""
    code = F.filter(F.split(content, "\n"), lambda x: F.rlike(x, F.lit(r"\S")) & ~F.rlike(x, F.lit(r"^\s*(#|//|/\*|\*)")))
    logic = F.filter(code, lambda x: F.rlike(x, F.lit(r"\b(if|for|while|return|def|fn|function|class|match|switch|try|elif|else|yield|await|impl)\b|=>")))
    return F.when(F.size(code) > 0, F.size(logic) / F.size(code)).otherwise(F.lit(0.0))


def kind(path, content, lines, min_lines: int = 150, max_density: float = 0.04) -> F.Column:
    """vendored, generated, test, data or source: the first rule that matches."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    some = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    base = F.substring_index(path, "/", -1)
    st = F.regexp_replace(base, r"\.[^.]*$", "")
    testy = F.startswith(st, F.lit("test_")) | (st == "conftest")
    for s in TEST_SUFFIXES:
        testy = testy | F.endswith(st, F.lit(s))
    return (
        F.when(some(VENDOR) | F.endswith(path, F.lit(".min.js")), "vendored")
        .when(some(GENERATED) | F.endswith(path, F.lit(".d.ts")) | has_marker(content), "generated")
        .when(some(TESTS) | testy, "test")
        .when(some(DATA) | F.contains(st, F.lit("fixture")), "data")
        .when((lines >= min_lines) & (logic_density(content) < max_density), "data")
        .otherwise("source")
    )


def is_fix(subject, words: list[str]) -> F.Column:
    """A fix word stands in the subject as a whole word."""
    return F.arrays_overlap(F.split(F.lower(subject), "[^a-z0-9]+"), F.array(*map(F.lit, words)))


def is_bot(author, patterns: list[str]) -> F.Column:
    found = F.lit(False)
    for p in patterns:
        if p:
            found = found | F.contains(F.lower(author), F.lit(p.lower()))
    return found


def first_class(c, patterns: list[tuple[str, str]]) -> F.Column:
    """The name of the first pattern that matches."""
    out = F.lit(None).cast("string")
    for name, rx in reversed(patterns):
        out = F.when(F.rlike(c, F.lit(rx)), name).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** crosses directories, * and ? do not."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{":
            j = glob.find("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : j].split(","))) + ")", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"
