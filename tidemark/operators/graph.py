"""Graph operators over edge tables (x, y)."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.cut import cut


def fan(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability): distinct neighbours; instability is out / (in + out), 0 without any."""
    e = edges.select("x", "y").where("x <> y").distinct()
    i, o = e.groupBy(F.col("y").alias("node")).agg(F.count("*").alias("fan_in")), e.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("fan_out"))
    d = nodes.select("node").distinct().join(i, "node", "left").join(o, "node", "left").fillna(0, ["fan_in", "fan_out"])
    t = F.col("fan_in") + F.col("fan_out")
    return d.withColumn("instability", F.when(t > 0, F.col("fan_out") / t).otherwise(0.0))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over undirected edges, by minimum labels and pointer jumping."""
    both = cut(edges.select("x", "y").unionAll(edges.select("y", "x")).toDF("node", "near").distinct())
    label = cut(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(rounds):
        seen = both.join(label.toDF("near", "c"), "near").groupBy("node").agg(F.min("c").alias("c"))
        low = label.join(seen, "node").select("node", F.least("component", "c").alias("low"), F.col("component").alias("old"))
        new = cut(low.join(label.toDF("low", "c"), "low", "left").select("node", F.least("low", "c").alias("component"), "old"))
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def reachable(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(x, y): pairs with a path of one or more edges. For small graphs: the result is quadratic in a component."""
    e = cut(edges.select("x", "y").distinct())
    all_, new = e, e
    for _ in range(rounds):
        step = new.toDF("x", "m").join(e.toDF("m", "y"), "m").select("x", "y").distinct()
        new = cut(step.join(all_.toDF("ax", "ay"), F.expr("x = ax and y = ay"), "left_anti"))
        if new.isEmpty():
            return all_
        all_ = cut(all_.unionAll(new))
    raise RuntimeError("closure did not settle")


def _spread(edges: DataFrame, label: DataFrame, rounds: int) -> DataFrame:
    """Largest label among the nodes that reach each node (labels move along edges)."""
    for _ in range(rounds):
        got = edges.join(label.toDF("x", "c"), "x").groupBy(F.col("y").alias("node")).agg(F.max("c").alias("c"))
        new = cut(label.join(got, "node", "left").select("node", F.greatest("label", F.coalesce("c", "label")).alias("label"), F.col("label").alias("old")))
        label = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return label
    raise RuntimeError("labels did not settle")


def strong_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): strongly connected components, by repeated colouring.

    Colours (the largest node that reaches a node) split the graph; inside a colour the
    nodes that reach back to its root are one component and leave. Nothing quadratic is made.
    """
    e = cut(edges.select("x", "y").where("x <> y").distinct())
    done = None
    nodes = cut(edges.select(F.col("x").alias("node")).unionAll(edges.select("y")).distinct())
    for _ in range(rounds):
        color = _spread(e, nodes.select("node", F.col("node").alias("label")), rounds)
        same = cut(e.join(color.toDF("x", "cx"), "x").join(color.toDF("y", "cy"), "y").where("cx = cy").select("x", "y"))
        # inside a colour, whatever reaches the root belongs to it
        back = color.select("node", F.when(F.col("node") == F.col("label"), 1).otherwise(0).alias("label"))
        back = _spread(same.select(F.col("y").alias("x"), F.col("x").alias("y")), back, rounds)
        found = color.join(back.where("label = 1").select("node"), "node").select("node", F.col("label").alias("component"))
        done = cut(found if done is None else done.unionAll(found))
        nodes = cut(nodes.join(done, "node", "left_anti"))
        if nodes.isEmpty():
            break
        e = cut(e.join(nodes.toDF("x"), "x", "left_semi").join(nodes.toDF("y"), "y", "left_semi"))
    low = done.groupBy("component").agg(F.min("node").alias("low"))
    return done.join(low, "component").select("node", F.col("low").alias("component"))


def cycle_cuts(edges: DataFrame, scc: DataFrame, min_size: int = 4, max_edges: int = 400, max_cut: int = 6) -> DataFrame:
    """(component, size, largest_after, x, y, cost, cut_size): per cyclic component of at least min_size nodes the
    cheapest single edge by what remains strongly connected, and the size of a greedy cut set (null if none dissolves it).

    A component is one group: cyclic parts of an import graph are small; trials stop at max_edges as the operator defines.
    """
    e = edges.groupBy("x", "y").agg(F.sum("cost").alias("cost"))
    c = scc.select("node", "component")
    inside = e.join(c.toDF("x", "component"), "x").join(c.toDF("y", "cy"), "y").where("component = cy").drop("cy")

    def largest(pairs: set[tuple]) -> int:
        out: dict = {}
        back: dict = {}
        for x, y in pairs:
            out.setdefault(x, []).append(y)
            back.setdefault(y, []).append(x)

        def reach(s, g):
            seen, todo = {s}, deque([s])
            while todo:
                for v in g.get(todo.popleft(), ()):
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            return seen

        left, best = set(out) | set(back), 0
        while left:
            s = next(iter(left))
            comp = reach(s, out) & reach(s, back)
            best, left = max(best, len(comp)), left - comp
        return best if best > 1 else 0

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf.cost, pdf.x, pdf.y))[:max_edges]
        pairs = set(zip(pdf.x, pdf.y))
        size = len(set(pdf.x) | set(pdf.y))
        if size < min_size:
            return pd.DataFrame([], columns=["component", "size", "largest_after", "x", "y", "cost", "cut_size"])
        after, cost, x, y = min((largest(pairs - {(x, y)}), c, x, y) for c, x, y in rows)
        left, n = set(pairs), 0
        while largest(left) and n < max_cut:
            _, _, a, b = min((largest(left - {(p, q)}), c, p, q) for c, p, q in rows if (p, q) in left)
            left.discard((a, b))
            n += 1
        return pd.DataFrame([[pdf.component.iloc[0], size, after, x, y, cost, float(n) if not largest(left) else None]], columns=["component", "size", "largest_after", "x", "y", "cost", "cut_size"])

    return inside.groupBy("component").applyInPandas(cuts, "component long, size long, largest_after long, x long, y long, cost long, cut_size double")


def liveness(elements: DataFrame, seeds: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, state): alive is the least set with the seeds and whatever has an alive element; noop has no
    element; dead is the greatest set of the others whose elements are all dead; what is left is alive.

    elements: node, element (null for a node without any); seeds: node.
    """
    el = cut(elements.select("node", "element").distinct())
    nodes = cut(el.select("node").distinct())
    alive = cut(nodes.join(seeds.select("node").distinct(), "node", "left_semi"))
    for _ in range(rounds):
        more = cut(el.join(alive.toDF("element"), "element", "left_semi").select("node").distinct().join(alive, "node", "left_anti"))
        if more.isEmpty():
            break
        alive = cut(alive.unionAll(more))
    noop = cut(el.groupBy("node").agg(F.count("element").alias("n")).where("n = 0").select("node").join(alive, "node", "left_anti"))
    dead = cut(nodes.join(alive, "node", "left_anti").join(noop, "node", "left_anti"))
    for _ in range(rounds):
        held = el.where("element is not null").join(dead, "node", "left_semi")
        drop = cut(held.join(dead.toDF("element"), "element", "left_anti").select("node").distinct())
        if drop.isEmpty():
            break
        dead = cut(dead.join(drop, "node", "left_anti"))
    state = dead.withColumn("state", F.lit("dead")).unionAll(noop.withColumn("state", F.lit("noop")))
    return nodes.join(state, "node", "left").withColumn("state", F.coalesce("state", F.lit("alive")))
