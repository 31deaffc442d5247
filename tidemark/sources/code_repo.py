"""A checkout as a table: path, lang, lines, bytes, content (register, then ``spark.read.format("code_repo")``)."""

from __future__ import annotations

import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.classify import LANGUAGES, glob_regex

SCHEMA = "path string, lang string, lines int, bytes long, content string"


def ignore_rules(text: str, base: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern on the path, negated, directories only) of a .gitignore in directory base."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        neg, line = line.startswith("!"), line.removeprefix("!")
        only_dir, line = line.endswith("/"), line.rstrip("/")
        glob = line.removeprefix("/") if "/" in line else f"**/{line}"
        out.append((re.compile(glob_regex(f"{base}/{glob}" if base else glob)), neg, only_dir))
    return out


def walk(root: str, exclude: list[str] = ()) -> list[str]:
    """Relative paths of known languages, sorted; hidden and ignored ones are left out."""
    drop = [re.compile(glob_regex(g)) for g in exclude]
    found: list[str] = []

    def visit(rel: str, rules: list) -> None:
        at = os.path.join(root, rel)
        mark = os.path.join(at, ".gitignore")
        if os.path.isfile(mark):
            with open(mark, errors="replace") as f:
                rules = rules + ignore_rules(f.read(), rel)
        for name in sorted(os.listdir(at)):
            path = f"{rel}/{name}" if rel else name
            full = os.path.join(at, name)
            is_dir = os.path.isdir(full) and not os.path.islink(full)
            if name.startswith("."):
                continue
            ignored = False
            for rx, neg, only_dir in rules:
                if (is_dir or not only_dir) and rx.match(path):
                    ignored = not neg
            if ignored:
                continue
            if is_dir:
                visit(path, rules)
            elif name.rpartition(".")[2].lower() in LANGUAGES and "." in name and os.path.isfile(full) and not any(rx.match(path) for rx in drop):
                found.append(path)

    visit("", [])
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.exclude = [g for g in options.get("exclude", "").split(",") if g]
        self.per = int(options.get("filesPerPartition", "200"))

    def partitions(self):
        paths = walk(self.root, self.exclude)
        return [_Files(paths[i : i + self.per]) for i in range(0, len(paths), self.per)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                raw = f.read()
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            yield path, LANGUAGES[path.rpartition(".")[2].lower()], len(text.splitlines()), len(raw), text


class CodeRepo(DataSource):
    @classmethod
    def name(cls):
        return "code_repo"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
