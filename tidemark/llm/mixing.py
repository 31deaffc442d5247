"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh ``weights`` in turn and share
``share`` of all sizes; a target stops at ``cap`` times its source's size and the
excess is shared again by weight among the others. Within a source each document
has target / source_size expected copies; documents are ordered by (size, doc_id)
so that the stride passes evenly through short and long ones, the expected
copies are prefix-summed, one random offset per source is added, and a document
is emitted once for each integer boundary its interval crosses.

The prefix sum is distributed: a range partitioning by (source, size, doc_id)
places the order over many tasks whatever the largest source holds, each task
counts its rows per source, and only those counts (tasks x sources) are summed.

Defined cases: null or blank text has size 0; a source whose size is 0 takes
nothing; null is a source of its own; rows sharing a doc_id are documents of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)


def word_count(col) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, null: 0."""
    x = F.btrim(col, F.lit(" \t\n\x0b\f\r"))
    return F.coalesce(F.when(F.length(x) > 0, F.size(F.split(x, r"[\x20\x09-\x0D]+"))).otherwise(0), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, ord, target, offset): one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("ord", F.row_number().over(by_name) - 1).withColumn("weight", w)
    ratio = F.lit(cap) * F.col("source_size") / F.col("weight")
    up = Window.orderBy("ratio", "ord")
    everything = Window.partitionBy()
    s = s.withColumn("ratio", ratio).withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("sized", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("weighed", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level at which all sources before this one are full; the first that stays under its cap sets it for the rest
    level = (F.lit(share) * F.col("total") - F.lit(cap) * F.col("sized")) / (F.col("all_weight") - F.col("weighed"))
    s = s.withColumn("level", level)
    final = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "ord", "level"))).over(everything)["level"]
    full = F.lit(cap) * F.col("source_size")
    target = F.when(final.isNull(), full).otherwise(F.least(full, final * F.col("weight")))
    seed = F.concat(F.lit("mix:"), F.coalesce(F.col("source"), F.lit("")), F.when(F.col("source").isNull(), "0").otherwise("1"))
    offset = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return s.select("source", "source_size", "ord", target.cast("double").alias("target"), offset.alias("offset"))


def copies(docs: DataFrame, carry: bool = False, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies; with ``carry`` also the whole input row as ``row``."""
    more = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *more)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: tasks run again must see the same partitions, and so the same ranks
    laid = materialize(slim.repartitionByRange(n, F.col("source").isNull(), "source", "size", "doc_id").sortWithinPartitions(F.col("source").isNull(), "source", "size", "doc_id").withColumn("at", F.monotonically_increasing_id()), "mix")
    laid = laid.withColumn("part", F.shiftright("at", 33))
    counts = laid.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = materialize(counts, "mix-counts")
    plan = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = ranked.alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select("c.source", "part", "first", "before", "source_size", "target", "offset")
    got = laid.alias("d").join(base.alias("b"), (F.col("d.part") == F.col("b.part")) & F.col("d.source").eqNullSafe(F.col("b.source")))
    rank = F.col("at") - F.col("first") + F.col("before")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((rank + 1) * each + F.col("offset")) - F.floor(rank * each + F.col("offset"))
    return got.select(F.col("d.doc_id"), F.col("d.source"), F.col("d.size"), "source_size", "target", crossed.cast("long").alias("copies"), *(["d.row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, each document as many times as it is taken."""
    got = copies(docs, carry=True, **options).where("copies > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
