"""A commit log as tables: one row per (commit, path), read by one git process, and a parser of log text."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

# The log's format. \x01 begins a commit, \x02 parts its fields, paths follow line by line.
FORMAT = "%x01%H%x02%an%x02%ct%x02%s"
SCHEMA = "hash string, author string, ts long, subject string, paths array<string>"


def command(root: str, since: str) -> list[str]:
    return ["git", "-C", root, "-c", "core.quotePath=off", "log", "--no-merges", "--no-renames", "--name-only", f"--format={FORMAT}", f"--since={since}"]


def parse_chunk(chunk: str):
    head, _, rest = chunk.partition("\n")
    f = (head.split("\x02", 3) + ["", "", "", ""])[:4]
    return f[0], f[1], int(f[2]) if f[2].lstrip("-").isdigit() else 0, f[3], [p.strip() for p in rest.split("\n") if p.strip()]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.since = options["path"], options.get("since", "6 months ago")

    def read(self, partition):
        out = subprocess.run(command(self.root, self.since), capture_output=True, check=True).stdout.decode(errors="replace")
        for chunk in out.split("\x01")[1:]:
            yield parse_chunk(chunk)


class GitLog(DataSource):
    """``spark.read.format("git_log").option("path", root).option("since", "1 year ago")``"""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def parse(log: DataFrame) -> DataFrame:
    """Commits from log text: ``value`` holds one chunk (``spark.read.text(path, lineSep='\\x01')`` gives them)."""
    v = log.where(F.length(F.trim("value")) > 0)
    f = F.split(F.substring_index("value", "\n", 1), "\u0002", 4)
    body = F.slice(F.split("value", "\n"), 2, F.size(F.split("value", "\n")))
    return v.select(f[0].alias("hash"), f[1].alias("author"), F.coalesce(f[2].try_cast("long"), F.lit(0)).alias("ts"), f[3].alias("subject"), F.filter(F.transform(body, F.trim), lambda x: x != "").alias("paths"))


def facts(commits: DataFrame, tracked: DataFrame, prefix: str = "", fix_words: list[str] | None = None, bots: list[str] | None = None):
    """(commits, touches, all_touches) for ``operators.history``: only paths under the prefix that are
    tracked (column path) are touched, but a commit's size is judged on all of them."""
    from tidemark.functions import classify

    c = commits.select(F.col("hash").alias("commit"), "author", "ts", classify.is_fix(F.col("subject"), fix_words or classify.FIX_WORDS).alias("is_fix"), classify.is_bot(F.col("author"), classify.BOTS if bots is None else bots).alias("is_bot"))
    every = commits.select(F.col("hash").alias("commit"), F.explode("paths").alias("entity"))
    mine = every.where(F.startswith("entity", F.lit(prefix))).withColumn("entity", F.expr(f"substring(entity, {len(prefix) + 1})")) if prefix else every
    touches = mine.join(tracked.select(F.col("path").alias("entity")).distinct(), "entity", "left_semi").select("commit", "entity").distinct()
    return c, touches, every
