"""Refactor steps for one file, as a DataFrame and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = ["fold_test_clones", "canonicalise_clone", "extract", "cut_cycle_edge"]


def _side(p: str, path) -> F.Column:
    """symbol (from-to), with the file in front if it is another."""
    where = F.when(F.col(f"{p}_file") == path, "").otherwise(F.concat(F.col(f"{p}_file"), F.lit(" ")))
    return F.concat(where, F.col(f"{p}_symbol"), F.lit(" ("), F.col(f"{p}_start"), F.lit("-"), F.col(f"{p}_end"), F.lit(")"))


def steps(path: str, pairs: DataFrame, regions: DataFrame, units: DataFrame, cuts: DataFrame, hard: int = 15, max_steps: int = 6, priority: list[str] = PRIORITY) -> DataFrame:
    """(n, kind, text, total) in priority order.

    pairs: kind, tokens, a_file, a_start, a_end, a_symbol, b_...; regions (the file's test regions): what, start,
    end; units: name, start, end, cognitive, max_nesting; cuts: x, y, names, line, largest_after.
    """
    me = F.lit(path)
    logic = pairs.where("kind = 'logic'")
    swap = [c.replace("a_", "*_").replace("b_", "a_").replace("*_", "b_") for c in logic.columns]
    both = logic.withColumn("turn", F.lit(0)).unionByName(logic.toDF(*swap).withColumn("turn", F.lit(1))).where(F.col("a_file") == me)
    r = F.broadcast(regions.withColumn("ord", F.row_number().over(Window.orderBy("start"))))  # the regions of one file
    side = both.join(r, (F.col("a_start") >= F.col("start")) & (F.col("a_start") <= F.col("end")), "left")
    inside = side.where("ord is not null").groupBy("what", "start", "end", "ord").agg(F.count("*").alias("runs"))
    fold = inside.agg(F.sum("runs").alias("all"), F.max_by(F.struct("what", "start", "end", "runs"), F.struct("runs", -F.col("ord"))).alias("top")).where("all > 0")
    n_runs = F.concat(F.col("top.runs"), F.when(F.col("top.runs") == 1, " clone run").otherwise(" clone runs"))
    more = F.when(F.col("all") > F.col("top.runs"), F.concat(F.lit(", +"), F.col("all") - F.col("top.runs"), F.lit(" in other test regions"))).otherwise("")
    fold = fold.select(F.lit(priority.index("fold_test_clones")).alias("p"), F.lit(0).alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.concat(F.lit("fold "), n_runs, F.lit(" in "), F.col("top.what"), F.lit(" at "), F.col("top.start"), F.lit("-"), F.col("top.end"), F.lit(" into shared test helpers"), more).alias("text"))
    # a pair inside the file counts once, from its earlier side outside test code
    out = side.where("ord is null")
    key = [F.when(F.col("turn") == 0, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")) for a, b in (("a", "b"), ("b", "a")) for c in ("file", "start")]
    out = out.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("turn"))).where("rn = 1")
    text = F.concat(_side("a", me), F.lit(" shares logic with "), _side("b", me), F.lit(", "), F.col("tokens"), F.lit(" tokens; compare differences before extracting a helper"))
    first, second = (F.when(F.col("turn") == 0, F.col(f"{a}_start")).otherwise(F.col(f"{b}_start")) for a, b in (("a", "b"), ("b", "a")))
    canon = out.select(F.lit(priority.index("canonicalise_clone")).alias("p"), (-F.col("tokens")).alias("k1"), first.alias("k2"), second.alias("k3"), text.alias("text"))
    ext = units.where(F.col("cognitive") > hard).select(F.lit(priority.index("extract")).alias("p"), (-F.col("cognitive")).alias("k1"), F.col("start").alias("k2"), F.lit(0).alias("k3"), F.concat(F.lit("extract from "), F.col("name"), F.lit(" (cognitive "), F.col("cognitive"), F.lit(", lines "), F.col("start"), F.lit("-"), F.col("end"), F.lit(", nesting "), F.col("max_nesting"), F.lit(")")).alias("text"))
    symbols = F.concat(F.size("names"), F.when(F.size("names") == 1, " symbol").otherwise(" symbols"))
    cut_ = cuts.where(F.col("x") == me).select(F.lit(priority.index("cut_cycle_edge")).alias("p"), F.lit(0).alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.concat(F.lit("cut the import "), F.col("x"), F.lit(" -> "), F.col("y"), F.lit(": "), symbols, F.lit(" ("), F.array_join("names", ", "), F.lit(", line "), F.col("line"), F.lit(") -> largest remaining cycle "), F.col("largest_after")).alias("text"))
    all_ = fold.unionByName(canon).unionByName(ext).unionByName(cut_)
    kinds = F.array(*map(F.lit, priority))
    w = Window.orderBy("p", "k1", "k2", "k3", "text")  # the steps of one file
    return all_.withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy())).where(F.col("n") <= max_steps).select("n", F.element_at(kinds, F.col("p") + 1).alias("kind"), "text", "total")


def render(path: str, plan: DataFrame) -> str:
    rows = plan.orderBy("n").collect()  # at most max_steps rows
    if not rows:
        return "no plan\n"
    more = rows[0]["total"] - len(rows)
    return f"plan for {path}:\n" + "".join(f"  {r['n']}) {r['text']}\n" for r in rows) + (f"  (+{more} more)\n" if more else "")
