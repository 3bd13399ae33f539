"""Alignment of timeframes, symbols and published series without looking ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import minutes_of
from tickloom.operators.scan import CHUNK, asof_join, carry_last, over_chunks, range_join


def _minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(n)), F.lit(0))


def join_previous_completed(
    primary: DataFrame, signal: DataFrame, columns: Sequence[str], prefix: str,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK, bucket_seconds: int = 86_400,
) -> DataFrame:
    """As-of on open time to the bar before the containing one, which has completed."""
    shifted = over_chunks(
        signal.select(*keys, idx, "time", *columns),
        lambda w: {f"_p_{name}": F.lag(name).over(w) for name in columns}, before=1, keys=keys, idx=idx, chunk=chunk,
    ).select(*keys, "time", *[F.col(f"_p_{name}").alias(name) for name in columns])
    return asof_join(primary, shifted, columns, keys, prefix=f"{prefix}_", bucket_seconds=bucket_seconds)


def join_by_close_time(
    primary: DataFrame, signal: DataFrame, columns: Sequence[str], prefix: str, timeframe: str,
    keys: Sequence[str] = ("symbol",), bucket_seconds: int = 86_400,
) -> DataFrame:
    """As-of on the moment a signal bar closes (open time plus its timeframe)."""
    available = signal.select(*keys, (F.col("time") + _minutes(minutes_of(timeframe))).alias("time"), *columns)
    return asof_join(primary, available, columns, keys, prefix=f"{prefix}_", bucket_seconds=bucket_seconds)


def first_quote_after(
    decisions: DataFrame, ticks: DataFrame, timeframe: str, columns: Sequence[str] = ("time", "bid", "ask"),
    keys: Sequence[str] = ("symbol",), prefix: str = "fill_", bucket_seconds: int = 3_600,
) -> DataFrame:
    """The first quote at or after each decision bar's close."""
    timed = decisions.withColumn("decision_time", F.col("time") + _minutes(minutes_of(timeframe)))
    return asof_join(timed, ticks, columns, keys, left_time="decision_time", direction="forward",
                     prefix=prefix, bucket_seconds=bucket_seconds)


def join_exact_then_fill(
    primary: DataFrame, other: DataFrame, columns: Sequence[str], prefix: str,
    keys: Sequence[str] = ("symbol",), on: Sequence[str] = ("time",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Match equal times only, then carry forward; times missing from the primary are lost."""
    names = [f"{prefix}_{name}" for name in columns]
    right = other.select(*on, *[F.col(n).alias(f"_x_{p}") for n, p in zip(columns, names)])
    joined = primary.join(right, list(on), "left")
    return carry_last(joined, {p: F.col(f"_x_{p}") for p in names}, keys, idx, chunk).drop(*[f"_x_{p}" for p in names])


def attach_signals(bars: DataFrame, signals: DataFrame, columns: Sequence[str], on: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """Bars with their signals; bars without one get zero."""
    joined = bars.join(signals.select(*on, *columns), list(on), "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in columns})


def daily_levels(
    bars: DataFrame, extra: dict[str, Column] | None = None, keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """One row per key and day: the previous present day's high and low, plus `extra` aggregates."""
    daily = bars.groupBy(*keys, F.to_date("time").alias("_date")).agg(
        F.max("high").alias("_day_high"), F.min("low").alias("_day_low"),
        *[value.alias(name) for name, value in (extra or {}).items()])
    by_day = Window.partitionBy(*keys).orderBy("_date")
    return daily.withColumns({
        "prev_day_high": F.lag("_day_high").over(by_day), "prev_day_low": F.lag("_day_low").over(by_day),
    }).drop("_day_high", "_day_low")


def with_daily_levels(
    bars: DataFrame, extra: dict[str, Column] | None = None, keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    levels = daily_levels(bars, extra, keys)
    return bars.withColumn("_date", F.to_date("time")).join(levels, [*keys, "_date"]).drop("_date")


def session_range(price: str, start_hour: int, end_hour: int) -> Column:
    """Aggregate for `daily_levels`: the extreme of `price` ("high" or "low") inside a UTC window."""
    inside = F.when((F.hour("time") >= start_hour) & (F.hour("time") < end_hour), F.col(price))
    return F.max(inside) if price == "high" else F.min(inside)


def windows_of(
    rows: DataFrame, starts: DataFrame, time: str, days: int, keys: Sequence[str] = (), start: str = "start_day",
) -> DataFrame:
    """Pair each row with every rolling window [start, start + days) that holds it."""
    spans = starts.withColumn("_lo", F.datediff(F.col(start), F.lit("1970-01-01").cast("date")).cast("double")).withColumn(
        "_hi", F.col("_lo") + days)
    points = rows.withColumn("_x", F.unix_micros(F.col(time).cast("timestamp")) / 86_400e6)
    return range_join(points, spans, "_x", "_lo", "_hi", float(days), keys).drop("_lo", "_hi", "_x")
