"""Interval unions, gaps and sections as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: str, start: str, end: str, touch: int = 1) -> DataFrame:
    """(group, start, end): maximal runs of intervals that overlap or lie at most ``touch`` apart."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0)).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(group, "__i").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__i")


def union_length(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, covered): how many whole positions the closed intervals cover."""
    return islands(df, group, start, end).groupBy(group).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def disjoint_cover(df: DataFrame, group: str, position: str, priority: str, kinds: list[str]) -> DataFrame:
    """(group, <kind>...): positions counted once, for the first of ``kinds`` that covers them."""
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col(priority))
    best = df.where(order > 0).groupBy(group, position).agg(F.min(order).alias("__p"))
    return best.groupBy(group).agg(*[F.sum((F.col("__p") == i + 1).cast("long")).alias(k) for i, k in enumerate(kinds)])


def max_gap(df: DataFrame, group: str, at: str, tie: str) -> DataFrame:
    """(group, max_gap, gap_from, gap_to): the largest step between consecutive rows, the first on ties."""
    w = Window.partitionBy(group).orderBy(at, tie)
    d = df.withColumn("__prev", F.lag(at).over(w)).where("__prev is not null").withColumn("__gap", F.col(at) - F.col("__prev"))
    first = F.max_by(F.struct(F.col("__prev").alias("gap_from"), F.col(at).alias("gap_to")), F.struct("__gap", -F.col("__prev"), -F.col(at)))
    return d.groupBy(group).agg(F.max("__gap").alias("max_gap"), first.alias("__g")).select(group, "max_gap", "__g.gap_from", "__g.gap_to")


def sections(lines: DataFrame, group: str, line: str, is_boundary: str, pair_gap: int = 2) -> DataFrame:
    """(group, first, last, size): from a boundary to before the next, boundaries at most ``pair_gap`` lines apart merged."""
    b = lines.where(F.col(is_boundary)).select(group, F.col(line).alias("l"))
    w = Window.partitionBy(group).orderBy("l")
    b = b.withColumn("new", (F.lag("l").over(w).isNull() | (F.col("l") - F.lag("l").over(w) > pair_gap)).cast("int")).where("new = 1")
    eof = lines.groupBy(group).agg(F.max(line).alias("eof"))
    s = b.withColumn("next", F.lead("l").over(w)).join(eof, group)
    return s.select(group, F.col("l").alias("first"), F.coalesce(F.col("next") - 1, "eof").alias("last")).withColumn("size", F.col("last") - F.col("first") + 1)


def drop_contained(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Rows whose interval does not lie inside an earlier one that stays (earlier starts first, longer first on ties)."""
    w = Window.partitionBy(group).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__reach", F.max(end).over(w)).where(F.col("__reach").isNull() | (F.col(end) > F.col("__reach"))).drop("__reach")


def longest_stretch(df: DataFrame, group: str, order: list[str], kind: str) -> DataFrame:
    """(group, kind, length): the longest run of consecutive rows of one kind, the first on ties."""
    w = Window.partitionBy(group).orderBy(*order)
    d = df.withColumn("__n", F.row_number().over(w)).withColumn("__new", (F.lag(kind).over(w).isNull() | ~F.lag(kind).over(w).eqNullSafe(F.col(kind))).cast("int"))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = d.groupBy(group, "__run").agg(F.first(kind).alias(kind), F.count("*").alias("length"))
    return r.groupBy(group).agg(F.max_by(F.struct(kind, "length"), F.struct("length", -F.col("__run"))).alias("__b")).select(group, f"__b.{kind}", "__b.length")


def elide_repeats(df: DataFrame, group: str, order: list[str], path: str) -> DataFrame:
    """path set to null where it equals the row before it."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(path, F.when(F.lag(path).over(w).eqNullSafe(F.col(path)), None).otherwise(F.col(path)))


def best_overlap(sides: DataFrame, units: DataFrame, key: str, side: str, share: float = 0.5) -> DataFrame:
    """(key, side, unit): the unit that holds a side (start, end) whole, the smallest first, else the one with
    more than ``share`` of it. units: key, unit, u_start, u_end; both sides closed intervals, joined on key."""
    j = sides.join(units, key).where((F.col("u_start") <= F.col("end")) & (F.col("u_end") >= F.col("start")))
    inner = F.least("end", "u_end") - F.greatest("start", "u_start") + 1
    whole = (F.col("u_start") <= F.col("start")) & (F.col("u_end") >= F.col("end"))
    j = j.withColumn("__o", inner).where(whole | (F.col("__o") > F.lit(share) * (F.col("end") - F.col("start") + 1)))
    best = F.max_by("unit", F.struct(whole.cast("int"), "__o", -(F.col("u_end") - F.col("u_start")), -F.col("u_start")))
    return j.groupBy(key, side).agg(best.alias("unit"))
