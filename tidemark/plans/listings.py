"""The report's listings: each a total order over an operator's rows, cut to its first rows.

``orderBy`` with ``limit`` keeps each task's first rows only, so no listing sorts its whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(df: DataFrame, order: list, top: int | None) -> DataFrame:
    out = df.orderBy(*order)
    return out if top is None else out.limit(top)


def cochange(pairs: DataFrame, top: int | None = 20) -> DataFrame:
    """Pairs by non-sweep commits, strength and lift, the highest first, then by name."""
    return _first(pairs, [F.desc("together_nonsweep"), F.desc("strength"), F.desc("lift"), "a", "b"], top)


def clone_pairs(runs: DataFrame, top: int | None = 20) -> DataFrame:
    """Runs by class (logic first), tokens, and both places. runs: kind, length, file_a, start_a, file_b, start_b."""
    return _first(runs, [F.desc(F.col("kind") == "logic"), F.desc("length"), "file_a", "start_a", "file_b", "start_b"], top)


def helper_families(families: DataFrame, top: int | None = 20) -> DataFrame:
    """Families by files times Jaccard. families: files, jaccard, first_file, name."""
    return _first(families, [F.desc(F.col("files") * F.col("jaccard")), "first_file", "name"], top)


def inlined(hits: DataFrame, top: int | None = 20) -> DataFrame:
    """Helpers by places that repeat their body. hits: hits, file, line."""
    return _first(hits, [F.desc("hits"), "file", "line"], top)


def literal_families(families: DataFrame, top: int | None = 20, files: str = "files", text: str = "text", role: str | None = "role") -> DataFrame:
    return _first(families, [F.desc(files), F.desc("occurrences"), text, *([role] if role else [])], top)


def near_pairs(pairs: DataFrame, top: int | None = 20, a: str = "a", b: str = "b") -> DataFrame:
    return _first(pairs, [F.desc("jaccard"), a, b], top)


def clumps(groups: DataFrame, top: int | None = 20, names: str = "names") -> DataFrame:
    return _first(groups, [F.desc("members"), F.desc("files"), names], top)


def dead(found: DataFrame, top: int | None = 20) -> DataFrame:
    """Dead before test-only, the longest first, then by place. found: category, start, end, file, name."""
    rank = F.when(F.col("category") == "dead", 0).when(F.col("category") == "test_only", 1)
    return _first(found.where(F.col("category").isin("dead", "test_only")), [rank, F.desc(F.col("end") - F.col("start")), "start", "file", "name"], top)


def orphans(rows: DataFrame, top: int | None = 20) -> DataFrame:
    """Unused declarations by commits since their last use. rows: commits_since, manifest, line."""
    return _first(rows, [F.desc("commits_since"), "manifest", "line"], top)


def seams(rows: DataFrame, top: int | None = 20) -> DataFrame:
    return _first(rows, [F.desc("test_mentions"), "name"], top)


def clone_families(members: DataFrame, top: int | None = 20) -> DataFrame:
    """(component, size, tokens, first) of families by their longest run. members: component, node, tokens."""
    g = members.groupBy("component").agg(F.count("*").alias("size"), F.max("tokens").alias("tokens"), F.min("node").alias("first"))
    return _first(g, [F.desc("tokens"), "first"], top)


def longest_locals(spans: DataFrame, unit: str, top: int = 3) -> DataFrame:
    """The names of each unit with the widest span between first and last use. spans: unit, name, first, last."""
    from tidemark.operators.rank import top_per_group

    return top_per_group(spans.withColumn("span", F.col("last") - F.col("first")), unit, [F.desc("span"), "first", "name"], top)


def capped(reasons: DataFrame, key: str, reason: str, order: str, most: int = 3) -> DataFrame:
    """(key, shown, more): the first reasons of each key as one text, and how many are not shown.

    Rows are ranked and counted before any are gathered, so a key's list never holds more than ``most``.
    """
    from pyspark.sql import Window

    r = reasons.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), reason)))
    n = reasons.groupBy(key).agg(F.count("*").alias("n"))
    top = r.where(F.col("rank") <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(reason).cast("string").alias("text")))), lambda x: x["text"]).alias("shown"))
    text = F.concat(F.array_join("shown", ", "), F.when(F.col("n") > most, F.concat(F.lit(" +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return n.join(top, key).select(key, text.alias("text"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def report(sections: dict[str, DataFrame], width: int = 28) -> str:
    """Fixed-width text of named listings, each already cut to its first rows."""
    out = []
    for title, df in sections.items():
        rows = df.collect()  # at most a listing's top
        out.append(f"{title} ({len(rows)})")
        out += ["  " + "".join(f"{str(v)[: width - 1]:<{width}}" for v in r).rstrip() for r in rows] or ["  none"]
        out.append("")
    return "\n".join(out)
