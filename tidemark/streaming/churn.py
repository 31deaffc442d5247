"""Incremental churn over a stream of touches: an extension, the reference is batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_churn(touches: DataFrame, at: str, entity: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, entity, touches) with a watermark, so state is bounded by the lateness allowed."""
    return touches.withWatermark(at, late).groupBy(F.window(at, window), entity).agg(F.count("*").alias("touches")).select(F.col("window.start").alias("start"), entity, "touches")


def sessions(touches: DataFrame, at: str, entity: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, entity, touches): activity sessions parted by gaps."""
    s = touches.withWatermark(at, late).groupBy(F.session_window(at, gap), entity).agg(F.count("*").alias("touches"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), entity, "touches")
