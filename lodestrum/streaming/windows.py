"""Windows, sessions and repeats over a stream, with state that expires by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(d: DataFrame, size: str, slide: str | None, *keys: str, late: str = "1 day") -> DataFrame:
    """Count and loudest of each key in windows of size, slide apart (none: side by side), once no row can reach a window any more."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = d.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.max("value").alias("loudest"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "loudest")


def sessions(d: DataFrame, gap: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Count and sum of each key's runs of rows less than gap apart, once they are over."""
    g = d.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_ones(d: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """One row for rows alike in keys within the watermark; what is remembered of a key expires with it."""
    return d.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def singles(d: DataFrame, threshold: float, *keys: str, size: str = "1 minute", late: str = "1 day") -> DataFrame:
    """The loudest row above a threshold of each key and window, as a candidate of one detector."""
    g = d.where(F.col("value") > threshold).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *keys)
    return g.agg(F.max(F.struct("value", (-F.col("event_id")).alias("i"))).alias("x")).select(*keys, F.col("w.start").alias("start"), (-F.col("x.i")).alias("event_id"), F.col("x.value").alias("value"))
