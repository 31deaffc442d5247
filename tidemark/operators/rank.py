"""Percentiles, the score fold, rollups and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.cut import cut

# Weights with and without history.
WITH_HISTORY = {"hotspot": 0.45, "fixes": 0.15, "complexity": 0.15, "coupling": 0.10, "clones": 0.10, "size": 0.05, "dead": 0.05, "strings": 0.0}
WITHOUT_HISTORY = {"hotspot": 0.0, "fixes": 0.0, "complexity": 0.55, "coupling": 0.15, "clones": 0.15, "size": 0.15, "dead": 0.05, "strings": 0.0}
SIGNALS = ["hotspot", "fixes", "complexity", "coupling", "clones", "size", "dead", "helpers", "strings", "clumps", "declared", "naming"]


def percentile(df: DataFrame, key: str, columns: list[str], within: list[str] | None = None) -> DataFrame:
    """(key, p_<column>...): the index of the first equal value over n - 1, 0 for a single row.

    All columns are ranked in one pass: values are counted per signal, the counts are
    range-partitioned by value, and a running total within each range is shifted by the totals of
    the ranges before it, so no task holds a whole signal. Null values are equal and come first.
    key is unique (within its group).
    """
    group = within or []
    least = F.lit(float("-inf"))
    signal = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(F.col(c).cast("double"), least).alias("v")) for i, c in enumerate(columns)])
    long = df.select(key, *group, F.explode(signal).alias("x")).select(key, *group, "x.i", "x.v")
    counts = long.groupBy(*group, "i", "v").agg(F.count("*").alias("k"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(counts.repartitionByRange(n, *group, "i", "v").withColumn("part", F.spark_partition_id()))
    own = laid.groupBy(*group, "i", "part").agg(F.sum("k").alias("own"))
    parts = Window.partitionBy(*group, "i")
    before = own.select(*group, "i", "part", F.coalesce(F.sum("own").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("own").over(parts).alias("n"))
    inside = F.coalesce(F.sum("k").over(Window.partitionBy(*group, "i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    both = laid.withColumn("inside", inside).alias("l").join(before.alias("r"), [*same, F.col("l.i") == F.col("r.i"), F.col("l.part") == F.col("r.part")])
    ranked = both.select(*[F.col(f"l.{c}") for c in group], F.col("l.i"), F.col("l.v"), F.when(F.col("n") < 2, 0.0).otherwise((F.col("inside") + F.col("before")) / (F.col("n") - 1)).alias("p"))
    got = long.alias("l").join(ranked.alias("r"), [*same, F.col("l.i") == F.col("r.i"), F.col("l.v").eqNullSafe(F.col("r.v"))]).select(*[F.col(f"l.{c}") for c in [key, *group]], F.col("l.i"), "p")
    return got.groupBy(key, *group).agg(*[F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"p_{c}") for i, c in enumerate(columns)])


def guarded(raw: str) -> F.Column:
    """A signal's percentile, 0 where the raw value is 0."""
    return F.when(F.col(raw) == 0, F.lit(0.0)).otherwise(F.col(f"p_{raw}"))


def contributions(signals: DataFrame, key: str, weights: dict[str, float] = WITH_HISTORY, extra: dict[str, float] | None = None, complexity_max_share: float = 0.6, cycle_coupling: float = 0.6) -> DataFrame:
    """(key, signal, value, weight, points), twelve rows per entity.

    signals: key, commits, fix_commits, max_cognitive, total_cognitive, fan_in, in_runtime_cycle, clone_lines,
    lines, dead_lines, dead_ratio, helper_sites, family_literals, clump_members, declared_sites, short_share.
    """
    cols = ["commits", "fix_commits", "max_cognitive", "total_cognitive", "fan_in", "clone_lines", "lines", "dead_ratio", "helper_sites", "family_literals", "clump_members", "declared_sites", "short_share"]
    s = signals.join(percentile(signals, key, cols), key)
    cx = F.when(F.col("max_cognitive") == 0, 0.0).otherwise(F.lit(complexity_max_share) * F.col("p_max_cognitive") + F.lit(1 - complexity_max_share) * F.col("p_total_cognitive"))
    value = {
        "hotspot": F.sqrt(guarded("commits") * cx), "fixes": guarded("fix_commits"), "complexity": cx,
        "coupling": F.greatest(guarded("fan_in"), F.when(F.col("in_runtime_cycle"), F.lit(cycle_coupling)).otherwise(0.0)),
        "clones": guarded("clone_lines"), "size": F.col("p_lines"), "dead": F.when(F.col("dead_lines") == 0, 0.0).otherwise(F.col("p_dead_ratio")),
        "helpers": guarded("helper_sites"), "strings": guarded("family_literals"), "clumps": guarded("clump_members"), "declared": guarded("declared_sites"), "naming": guarded("short_share"),
    }
    weigh = {k: 0.0 for k in SIGNALS} | weights | (extra or {})
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("signal"), value[n].cast("double").alias("value"), F.lit(float(weigh[n])).alias("weight")) for i, n in enumerate(SIGNALS)])
    return s.select(key, F.explode(rows).alias("c")).select(key, "c.*").withColumn("points", F.lit(100.0) * F.col("value") * F.col("weight"))


def scores(contribution: DataFrame, tests: DataFrame, key: str, no_tests: float = 1.15) -> DataFrame:
    """(key, subtotal, test_multiplier, score); tests: key, test_units."""
    s = contribution.groupBy(key).agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("ord", "points"))), lambda x: x["points"]), F.lit(0.0), lambda a, x: a + x).alias("subtotal"))
    m = F.when(F.col("test_units") > 0, 1.0).otherwise(F.lit(no_tests))
    return s.join(tests.select(key, "test_units"), key).withColumn("test_multiplier", m).select(key, "subtotal", "test_multiplier", (F.col("subtotal") * F.col("test_multiplier")).alias("score"))


def rollup(df: DataFrame, group: str, key: str, measure: str, sums: list[str]) -> DataFrame:
    """Sums per group and the member with the largest measure, the first by key on ties."""
    return df.groupBy(group).agg(F.count("*").alias("members"), *[F.sum(c).alias(c) for c in sums], F.max_by(key, F.struct(F.col(measure), -F.col(key))).alias("largest"), F.max(measure).alias("largest_value"))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The k first rows of each group in a total order (Spark prunes each task's rows to k first)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
