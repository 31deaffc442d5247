"""The ranked report: signals to scores, and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rank


def hotspots(signals: DataFrame, key: str = "entity", top: int = 20, have_history: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score, test_multiplier, top signals) of the highest scores, ties by key."""
    w = weights or (rank.WITH_HISTORY if have_history else rank.WITHOUT_HISTORY)
    c = rank.contributions(signals, key, w)
    s = rank.scores(c, signals, key)
    why = c.where("points > 0").groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("neg"), "signal", "points"))), 1, 3).alias("w"))
    return s.join(why, key, "left").select(key, "score", "test_multiplier", F.transform("w", lambda x: F.concat(x["signal"], F.lit(" "), F.format_number(x["points"], 1))).alias("reasons")).orderBy(F.desc("score"), key).limit(top)


def render(ranked: DataFrame, key: str = "entity") -> str:
    """Fixed-width lines of the ranking (already limited)."""
    rows = ranked.collect()
    return "".join(f"{i:>3}  {r['score']:>7.1f}  {r[key]}  {', '.join(r['reasons'] or [])}\n" for i, r in enumerate(rows, 1)) or "nothing to rank\n"
