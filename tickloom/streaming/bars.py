"""Bars on an unbounded tick stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bars import minutes_of


def _bars(ticks: DataFrame, window: Column, keys: Sequence[str]) -> DataFrame:
    at = F.struct("time", "seq") if "seq" in ticks.columns else F.col("time")
    out = ticks.groupBy(*keys, window.alias("_w")).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"),
        F.count("mid").alias("tick_volume"), F.sum(F.col("bid_volume") + F.col("ask_volume")).alias("real_volume"), F.avg("spread").alias("spread_mean"))
    return out.select(*keys, F.col("_w.start").alias("time"), F.col("_w.end").alias("end_time"), "open", "high", "low", "close", "tick_volume", "real_volume", "spread_mean")


def on_clock(ticks: DataFrame, lateness: str) -> DataFrame:
    """Event time with zone (a watermark needs one) and the bound on late quotes."""
    return ticks.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", lateness)


def streaming_bars(ticks: DataFrame, timeframe: str, lateness: str = "2 minutes", keys: Sequence[str] = ("symbol",), single: bool = True) -> DataFrame:
    """Tumbling bars; a late quote within `lateness` still counts, a later one is dropped.

    As in `canonical_ticks`, of quotes that a key has at one moment only the latest by `seq`
    counts; without that column the first to arrive.  With `single` False all of them count, as in
    `ticks_to_bars` alone, and `seq`, if there, orders those of one moment.
    """
    clocked = on_clock(ticks, lateness)
    if not single:
        counted = clocked
    elif "seq" in ticks.columns:
        rest = [n for n in ticks.columns if n not in (*keys, "time", "seq")]
        counted = clocked.groupBy(*keys, "time").agg(*[F.max_by(n, "seq").alias(n) for n in rest])
    else:
        counted = clocked.dropDuplicatesWithinWatermark([*keys, "time"])
    return _bars(counted, F.window("time", f"{minutes_of(timeframe)} minutes"), keys)


def sliding_bars(ticks: DataFrame, length: str, slide: str, lateness: str = "2 minutes", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _bars(on_clock(ticks, lateness), F.window("time", length, slide), keys)


def session_gap_bars(ticks: DataFrame, gap: str, lateness: str = "2 minutes", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One bar per burst of quotes: a pause of `gap` ends it."""
    return _bars(on_clock(ticks, lateness), F.session_window("time", gap), keys)
