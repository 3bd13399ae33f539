"""Time bucketing: ticks to bars, bars to coarser bars, daily P&L, session blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import session_id
from tickloom.operators.scan import CHUNK, carry_last, epoch_seconds, over_chunks, running
from tickloom.schema import require_columns
from tickloom.session import spread

# Minutes per timeframe name.
TIMEFRAME_MINUTES = {
    "m1": 1, "m2": 2, "m3": 3, "m4": 4, "m5": 5, "m10": 10, "m15": 15, "m20": 20, "m30": 30,
    "h1": 60, "h2": 120, "h4": 240, "h6": 360, "h8": 480, "h12": 720, "d1": 1440,
}


def minutes_of(timeframe: str) -> int:
    try:
        return TIMEFRAME_MINUTES[timeframe.lower()]
    except KeyError:
        raise ValueError(f"unsupported timeframe: {timeframe}") from None


def canonical_ticks(ticks: DataFrame, order: str = "seq", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One quote per (key, time): the one latest in file order; adds mid and spread."""
    require_columns(ticks, [*keys, "time", "bid", "ask", order], "ticks")
    rest = [c for c in ticks.columns if c not in (*keys, "time", order, "mid", "spread")]
    return (
        ticks.groupBy(*keys, "time")
        .agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
        .withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
        .withColumn("spread", F.col("ask") - F.col("bid"))
    )


def ticks_to_bars(ticks: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Left-closed, left-labelled bid/ask/mid bars; empty buckets do not appear.

    Input is canonical: one tick per (key, time).  All aggregate states are fixed-width,
    so each map task hashes its ticks down to bars before anything is shuffled.
    """
    require_columns(ticks, [*keys, "time", "mid", "bid", "ask", "spread", "bid_volume", "ask_volume"], "ticks")

    def ohlc(value: str, prefix: str = "") -> list[Column]:
        return [
            F.min_by(value, "time").alias(f"{prefix}open"), F.max(value).alias(f"{prefix}high"),
            F.min(value).alias(f"{prefix}low"), F.max_by(value, "time").alias(f"{prefix}close"),
        ]

    return (
        ticks.filter(F.col("mid").isNotNull())
        .groupBy(*keys, F.window("time", f"{minutes_of(timeframe)} minutes").alias("_w"))
        .agg(
            *ohlc("mid"), *ohlc("bid", "bid_"), *ohlc("ask", "ask_"),
            F.count("mid").alias("tick_volume"),
            F.sum(F.col("bid_volume") + F.col("ask_volume")).alias("real_volume"),
            F.min_by("spread", "time").alias("spread_open"),
            F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"),
        )
        .withColumn("timeframe", F.lit(timeframe.lower())).withColumn("time", F.col("_w.start")).drop("_w")
    )


def roll_up(bars: DataFrame, timeframes: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars to several coarser timeframes in one pass.

    Each input bar is copied once per timeframe and re-aggregated; the copies are merged
    map-side, so the shuffle carries output bars.  Spread mean is weighted by tick count.
    """
    spans = F.array(*[
        F.struct(F.lit(name.lower()).alias("tf"), F.lit(minutes_of(name) * 60).alias("s")) for name in timeframes])
    has = set(bars.columns)
    prefixes = [p for p in ("", "bid_", "ask_") if f"{p}open" in has]
    aggregates: list[Column] = []
    for p in prefixes:
        aggregates += [
            F.min_by(f"{p}open", "time").alias(f"{p}open"), F.max(f"{p}high").alias(f"{p}high"),
            F.min(f"{p}low").alias(f"{p}low"), F.max_by(f"{p}close", "time").alias(f"{p}close"),
        ]
    aggregates += [F.sum(c).alias(c) for c in ("volume", "tick_volume", "real_volume") if c in has]
    if "spread_mean" in has:
        aggregates += [
            F.min_by("spread_open", "time").alias("spread_open"),
            (F.sum(F.col("spread_mean") * F.col("tick_volume")) / F.sum("tick_volume")).alias("spread_mean"),
            F.max("spread_max").alias("spread_max"),
        ]
    kind = bars.schema["time"].dataType.simpleString()
    start = F.timestamp_seconds(F.floor(epoch_seconds("time") / F.col("_span.s")) * F.col("_span.s")).cast(kind)
    return (
        bars.withColumn("_span", F.explode(spans)).withColumn("_start", start)
        .groupBy(*keys, F.col("_span.tf").alias("timeframe"), "_start").agg(*aggregates)
        .withColumnRenamed("_start", "time")
    )


def multi_timeframe_bars(ticks: DataFrame, timeframes: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Ticks to several timeframes: ticks are read and shuffled once, as bars of the finest."""
    minutes = sorted(minutes_of(name) for name in timeframes)
    names = {minutes_of(name): name for name in timeframes}
    finest = names[minutes[0]]
    if any(m % minutes[0] for m in minutes):
        finest = "m1"
    return roll_up(ticks_to_bars(ticks, finest, keys), timeframes, keys)


def flat_bars(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The six-column research form: time without zone, one volume column."""
    volume = "volume" if "volume" in bars.columns else "tick_volume"
    extra = [c for c in ("timeframe",) if c in bars.columns]
    return bars.select(
        *keys, *extra, F.col("time").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close",
        F.col(volume).cast("double").alias("volume"))


def mid_as_bid_ask(bars: DataFrame) -> DataFrame:
    """Bid/ask bars from mid-only bars: both sides equal the mid, spread zero."""
    prices = {f"{side}_{p}": F.col(p) for side in ("bid", "ask") for p in ("open", "high", "low", "close")}
    return bars.withColumns({
        **prices, "tick_volume": F.col("volume").cast("long"), "real_volume": F.lit(0.0),
        "spread_open": F.lit(0.0), "spread_mean": F.lit(0.0), "spread_max": F.lit(0.0)})


def strided(bars: DataFrame, max_bars: int, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx") -> DataFrame:
    """Every k-th bar per key, k = max(1, rows // max_bars)."""
    sizes = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_bars))
    return bars.join(sizes, list(keys)).filter(F.col(idx) % step == 0).drop("_n")


def session_starts(
    bars: DataFrame, offset: int = 0, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Add session, and `block_idx` / `block_start`: where its maximal run of equal session began."""
    tagged = bars.withColumn("session", session_id(F.col("time"), offset))
    opens = lambda w: {"_opens": F.coalesce(F.lag("session").over(w), F.lit(-1)) != F.col("session")}
    opened = over_chunks(tagged, opens, before=1, keys=keys, idx=idx, chunk=chunk, keep_chunk=True)
    start = F.when(F.col("_opens"), F.struct(F.col(idx).alias("i"), F.col("time").alias("t")))
    carried = carry_last(opened, {"_start": start}, keys, idx, chunk)
    return carried.withColumns({"block_idx": F.col("_start.i"), "block_start": F.col("_start.t")}).drop("_opens", "_start")


def session_blocks(
    bars: DataFrame, offset: int = 0, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """`session_starts` plus a running `block_id` per key."""
    started = session_starts(bars, offset, keys, idx, chunk)
    opened = (F.col(idx) == F.col("block_idx")).cast("long")
    numbered = running(started, {"block_id": ("sum", opened)}, keys, [idx], F.floor(F.col(idx) / chunk))
    return numbered.withColumn("block_id", F.col("block_id").cast("long") - 1).drop("block_idx")


def daily_pnl(
    trades: DataFrame, time: str = "exit_time", pnl: str = "net_pnl", keys: Sequence[str] = ("strategy_id",),
) -> DataFrame:
    return trades.groupBy(*keys, F.to_date(time).alias("day")).agg(F.sum(pnl).alias("pnl"))


def dense_daily_pnl(
    trades: DataFrame,
    keys: Sequence[str] = ("strategy_id",),
    close_time: str = "exit_time",
    open_time: str = "entry_time",
    pnl: str = "net_pnl",
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """A P&L row for every calendar day of each key, zero where nothing closed.

    `opened` tells whether a position was opened that day, which is not the same as
    having closed one.  `period` replaces the first and last close day.
    """
    closed = daily_pnl(trades, close_time, pnl, keys)
    if period is None:
        span = closed.groupBy(*keys).agg(F.min("day").alias("_from"), F.max("day").alias("_to"))
    else:
        span = closed.select(*keys).distinct().select(
            *keys, F.lit(period[0]).cast("date").alias("_from"), F.lit(period[1]).cast("date").alias("_to"))
    days = spread(span, *keys).select(*keys, F.explode(F.sequence("_from", "_to")).alias("day"))
    opened = trades.select(*keys, F.to_date(open_time).alias("day")).distinct().withColumn("_opened", F.lit(True))
    on = [*keys, "day"]
    return (
        days.join(closed, on, "left").join(opened, on, "left")
        .select(*on, F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.coalesce("_opened", F.lit(False)).alias("opened"))
    )


def period_keys(time: Column) -> dict[str, Column]:
    """Month, quarter, year and ISO day labels of a timestamp."""
    return {
        "month": F.date_format(time, "yyyy-MM"),
        "quarter": F.concat(F.year(time).cast("string"), F.lit("Q"), F.quarter(time).cast("string")),
        "year": F.year(time).cast("string"),
        "day": F.date_format(time, "yyyy-MM-dd"),
    }
