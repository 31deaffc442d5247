"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, tag: str = "cc", broadcast_rows: int = 500_000) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (map-side
    combined, so a node with very many neighbours is no single group) and then the
    label of that label; each round is written to the shared folder. Labels of up
    to ``broadcast_rows`` nodes (16 bytes each) are broadcast, more are joined by shuffle.
    """
    e = links.select("a", "b").where("a <> b")
    both = materialize(e.unionAll(e.select(F.col("b"), F.col("a"))).toDF("node", "near").distinct(), f"{tag}-edges")
    label = materialize(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("component")), f"{tag}-0")
    n = label.count()
    small = n <= broadcast_rows
    side = F.broadcast if small else (lambda d: d)
    i = 0
    while True:  # labels only fall, so it settles
        i += 1
        seen = both.join(side(label.toDF("near", "c")), "near").groupBy("node").agg(F.min("c").alias("c"))
        low = seen.join(side(label), "node").select("node", F.least("component", "c").alias("low"), F.col("component").alias("old"))
        new = low.join(side(label.toDF("low", "c")), "low", "left").select("node", F.least("low", "c").alias("component"), "old")
        new = materialize(new.coalesce(4) if small else new, f"{tag}-{i}")
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label
