"""Manifest files as rows: declared dependencies, features, and the comments above them."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPS = "manifest string, name string, ident string, package string, section string, line int, optional boolean, dev boolean, workspace boolean"
FEATURES = "manifest string, name string, line int, element string"
SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")


def key_lines(text: str) -> dict[tuple[str, str], int]:
    """Line of each key in its table, from 1."""
    out, table = {}, ""
    for i, line in enumerate(text.splitlines(), 1):
        s = line.strip()
        if s.startswith("[") and s.endswith("]"):
            table = s.strip("[]").replace('"', "").strip()
            head, _, last = table.rpartition(".")
            out.setdefault((head, last), i)
        elif "=" in s and not s.startswith("#"):
            out.setdefault((table, s.split("=", 1)[0].strip().strip('"').split(".")[0]), i)
    return out


def comment_above(text: str, line: int) -> str:
    """The block of comment lines right above a line, without marks."""
    lines, out = text.splitlines(), []
    i = line - 2
    while i >= 0 and lines[i].strip().startswith("#"):
        out.insert(0, lines[i].strip().lstrip("#").strip())
        i -= 1
    return " ".join(out)


def cargo_deps(path: str, text: str):
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    at = key_lines(text)
    places = [("", doc)] + [(f"target.{k}.", v) for k, v in doc.get("target", {}).items() if isinstance(v, dict)]
    for prefix, tables in places:
        for section in SECTIONS:
            for name, spec in tables.get(section, {}).items():
                spec = spec if isinstance(spec, dict) else {}
                yield path, name, name.replace("-", "_"), spec.get("package", name), prefix + section, at.get((prefix + section, name)), bool(spec.get("optional")), section == "dev-dependencies", bool(spec.get("workspace"))


def cargo_features(path: str, text: str):
    try:
        features = tomllib.loads(text).get("features", {})
    except tomllib.TOMLDecodeError:
        return
    at = key_lines(text)
    for name, elements in features.items():
        for e in elements or [None]:
            yield path, name, at.get(("features", name)), e


def _table(f, schema):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.content) for r in f(p, t or "")], columns=names)

    return run


def deps(files: DataFrame) -> DataFrame:
    """Dependencies of all Cargo manifests among files (path, content)."""
    return files.where(F.rlike("path", F.lit("(^|/)Cargo[.]toml$"))).select("path", "content").mapInPandas(_table(cargo_deps, DEPS), DEPS)


def features(files: DataFrame) -> DataFrame:
    return files.where(F.rlike("path", F.lit("(^|/)Cargo[.]toml$"))).select("path", "content").mapInPandas(_table(cargo_features, FEATURES), FEATURES)
