"""Windowed aggregates over a stream with late rows, by Spark's own watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(df: DataFrame, at: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows a key and window (tumbling, or sliding with `slide`); rows later than `late` behind the newest are left out of a stream."""
    w = F.window(F.col(at), width, slide) if slide else F.window(F.col(at), width)
    return df.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Rows a key and session, which ends after a gap without rows."""
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
