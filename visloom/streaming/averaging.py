"""Averaging of a stream of visibilities: an event-time window per antenna pair, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def averaged_stream(vis: DataFrame, window: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Rows (ts, ant1, ant2, ch, re, im, nw, flagged) -> weighted mean visibility per window, pair and channel."""
    w = F.col("nw") * F.col("nw")
    kept = vis.where("NOT flagged").withWatermark("ts", late)
    out = kept.groupBy(F.window("ts", window), "ant1", "ant2", "ch").agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col("re")) / F.sum(w)).alias("re"), (F.sum(w * F.col("im")) / F.sum(w)).alias("im"), F.sqrt(F.sum(w)).alias("nw"))
    return out.select(F.col("window.start").alias("start"), "ant1", "ant2", "ch", "n", "re", "im", "nw")
