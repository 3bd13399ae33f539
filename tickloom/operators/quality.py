"""Audits of ticks, bars and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import market_closed
from tickloom.operators.bars import minutes_of
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.scan import CHUNK, epoch_seconds, over_chunks, with_position
from tickloom.schema import require_columns
from tickloom.session import cut_lineage, spread

c = F.col


def tick_quality(ticks: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key and day: rows, repeated times, crossed and non-positive quotes.

    Counted on ticks as delivered, before `canonical_ticks` removes repeats.
    """
    per_time = ticks.groupBy(*keys, "time").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(c("ask") < c("bid")).alias("_crossed"),
        F.count_if((c("bid") <= 0) | (c("ask") <= 0)).alias("_bad"))
    return per_time.groupBy(*keys, F.to_date("time").alias("day")).agg(
        F.sum("_n").alias("tick_rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_tick_times"),
        F.sum("_crossed").alias("crossed_quotes"), F.sum("_bad").alias("nonpositive_quotes"))


def quality_verdict(
    daily: DataFrame, requested: DataFrame | None = None, missing_hours: DataFrame | None = None,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Roll daily counts up per key; any defect, or no rows at all, fails."""
    keys = list(keys)
    counts = ["tick_rows", "duplicate_tick_times", "crossed_quotes", "nonpositive_quotes"]
    out = daily.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in counts], F.count(F.lit(1)).alias("days"))
    if requested is not None:
        out = requested.select(*keys).distinct().join(out, keys, "left")
    if missing_hours is not None:
        gaps = missing_hours.groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_hours"))
        out = out.join(gaps, keys, "left")
    filled = [name for name in out.columns if name not in keys]
    out = out.fillna(0, subset=filled)
    defects = sum((c(name) for name in filled if name not in ("tick_rows", "days")), F.lit(0))
    return out.withColumn("passed", (c("tick_rows") > 0) & (defects == 0))


def expected_open(hour: Column) -> Column:
    """Monday to Thursday all day, Friday until 21:00, Sunday from 22:00 (UTC)."""
    day = F.weekday(hour)
    return (day < 4) | ((day == 4) & (F.hour(hour) < 21)) | ((day == 6) & (F.hour(hour) >= 22))


def missing_open_hours(ticks: DataFrame, keys: Sequence[str] = ("symbol",), span: DataFrame | None = None) -> DataFrame:
    """Hours of the span in which the market is open but no tick arrived."""
    keys = list(keys)
    present = ticks.groupBy(*keys, F.window("time", "1 hour").alias("_w")).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, c("_w.start").alias("hour"))
    if span is None:
        span = present.groupBy(*keys).agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    hours = spread(span, *keys).select(*keys, F.explode(F.sequence("first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return hours.filter(expected_open(c("hour"))).join(present, [*keys, "hour"], "left_anti")


def market_calendar(bars: DataFrame) -> DataFrame:
    """One row per calendar day of the table's span: open or not, and how many open days came before.

    Its size is the number of days, whatever the number of bars.  It is written down
    because the optimizer would otherwise infer the holiday test for every joined row.
    """
    span = bars.agg(F.min(F.to_date("time")).alias("_a"), F.max(F.to_date("time")).alias("_b"))
    days = span.select(F.explode(F.sequence("_a", "_b")).alias("day")).withColumn("is_open", ~market_closed(c("day")))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(days.withColumn("open_before", F.coalesce(F.sum(c("is_open").cast("int")).over(before), F.lit(0))))


def missing_trading_days(bars: DataFrame, keys: Sequence[str] = ("symbol",), calendar: DataFrame | None = None) -> DataFrame:
    """Calendar days the market was open between the first and last bar, without any bar."""
    keys = list(keys)
    present = bars.select(*keys, F.to_date("time").alias("day")).distinct()
    span = present.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = spread(span, *keys).select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    open_days = (market_calendar(bars) if calendar is None else calendar).filter("is_open").select("day")
    return days.join(open_days, "day").join(present, [*keys, "day"], "left_anti")


def missing_day_counts(bars: DataFrame, keys: Sequence[str] = ("symbol",), calendar: DataFrame | None = None) -> DataFrame:
    """How many rows `missing_trading_days` has per key, from counts of open days alone: no row per day that could be missing."""
    present = bars.select(*keys, F.to_date("time").alias("day")).distinct().join(market_calendar(bars) if calendar is None else calendar, "day")
    open_day = c("is_open").cast("int")
    spanned = F.max_by(c("open_before") + open_day, "day") - F.min_by("open_before", "day")
    return present.groupBy(*keys).agg((spanned - F.count_if("is_open")).alias("missing_trading_days"))


def suspicious_gaps(
    bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Steps longer than 18 bars (at least 90 minutes) that do more than span closed days."""
    limit = max(minutes_of(timeframe) * 60 * 18, 90 * 60)
    stepped = over_chunks(
        bars.select(*keys, idx, "time"), lambda w: {"next_time": F.lead("time").over(w)}, after=1, keys=keys, idx=idx, chunk=chunk)
    long = stepped.withColumn("gap_seconds", epoch_seconds("next_time") - epoch_seconds("time")).filter(c("gap_seconds") > limit)
    calendar = market_calendar(bars) if calendar is None else calendar
    side = lambda tag: calendar.select(c("day").alias(f"_{tag}"), c("is_open").alias(f"_{tag}_open"), c("open_before").alias(f"_{tag}_before"))
    placed = long.withColumns({"_a": F.to_date("time"), "_b": F.to_date("next_time")}).join(side("a"), "_a").join(side("b"), "_b")
    open_between = c("_b_before") - c("_a_before") - c("_a_open").cast("int")
    only_closed = (c("_a") != c("_b")) & (open_between == 0) & (~c("_a_open") | ~c("_b_open") | (F.weekday("_a") == 4))
    return placed.filter(~only_closed).select(*keys, "time", "next_time", (c("gap_seconds") / 60).alias("minutes"))


def bar_audit(
    bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), bucket_seconds: int = 86_400 * 30,
) -> DataFrame:
    """One row per key with every bar defect count and the list of issues."""
    keys = list(keys)
    require_columns(bars, [*keys, "time", "open", "high", "low", "close"], "bars")
    prices = [c(name).cast("double") for name in ("open", "high", "low", "close")]
    o, h, l, x = prices
    unknown = o.isNull() | h.isNull() | l.isNull() | x.isNull()
    invalid = (h < F.greatest(o, x, l)) | (l > F.least(o, x, h)) | (o <= 0) | (h <= 0) | (l <= 0) | (x <= 0)
    per_time = cut_lineage(bars.groupBy(*keys, "time").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(unknown).alias("_null"), F.count_if(invalid).alias("_bad")))
    base = per_time.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_timestamps"),
        F.sum("_null").alias("null_ohlc_rows"), F.sum("_bad").alias("invalid_ohlc_rows"))
    calendar = market_calendar(per_time)
    days = missing_day_counts(per_time, keys, calendar)
    placed = with_position(per_time, ["time"], keys, bucket_seconds=bucket_seconds)
    gaps = suspicious_gaps(placed, timeframe, keys, calendar=calendar).groupBy(*keys).agg(F.count(F.lit(1)).alias("large_gaps"))
    out = base.join(days, keys, "left").join(gaps, keys, "left").fillna(0, subset=["missing_trading_days", "large_gaps"])
    texts = {
        "duplicate_timestamps": "duplicate timestamps", "null_ohlc_rows": "rows with null OHLC",
        "invalid_ohlc_rows": "rows with invalid OHLC", "missing_trading_days": "missing trading days",
        "large_gaps": "suspicious large gaps"}
    found = F.array_compact(F.array(*[
        F.when(c(name) > 0, F.concat(c(name).cast("string"), F.lit(f" {text}"))) for name, text in texts.items()]))
    return out.withColumn("issues", F.array_join(found, ", ")).withColumn("passed", F.size(found) == 0)


def audit_warnings(audits: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Advisory summary over all audits: how many have issues, and one line per key, sorted."""
    line = F.concat(F.concat_ws(" ", *keys, F.lit(timeframe.upper())), F.lit(": "), c("issues"))
    return audits.agg(
        F.count(F.lit(1)).alias("audits"), F.count_if(~c("passed")).alias("warning_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(~c("passed"), line))), " | ").alias("warnings"))


def feature_parity(
    left: DataFrame, right: DataFrame, columns: Sequence[str], on: Sequence[str] = ("symbol", "time"),
    absolute: float = 1e-3, relative: float = 1e-2, share: float = 0.98,
) -> DataFrame:
    """Compare two feature tables column by column on equal keys."""
    a = left.select(*on, *[c(n).cast("double").alias(f"a_{n}") for n in columns])
    b = right.select(*on, *[c(n).cast("double").alias(f"b_{n}") for n in columns])
    stacked = ", ".join(f"'{n}', a_{n}, b_{n}" for n in columns)
    long = a.join(b, list(on)).select(F.expr(f"stack({len(columns)}, {stacked}) AS (column, a, b)")).filter("a IS NOT NULL AND b IS NOT NULL")
    gap = F.abs(c("a") - c("b"))
    close = (gap <= absolute) | (gap <= relative * F.abs("a"))
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs_diff"), F.avg(gap).alias("mean_abs_diff"),
        F.avg(close.cast("int")).alias("within_share"),
        F.min("a").alias("min_a"), F.max("a").alias("max_a"), F.min("b").alias("min_b"), F.max("b").alias("max_b"),
    ).join(exact_quantiles(long.withColumn("_gap", gap), ["column"], {"p99_abs_diff": ("_gap", 0.99)}), "column").withColumn("passed", c("within_share") >= share)


def ledger_difference(
    first: DataFrame, second: DataFrame, numbers: Sequence[str], texts: Sequence[str],
    on: Sequence[str] = ("strategy_id", "trade_no"), tolerance: float = 1e-6,
) -> DataFrame:
    """Trades of two runs, paired by `on`: rows on one side only and differing values per column."""
    names = [*numbers, *texts]
    a = first.select(*on, *[c(n).alias(f"a_{n}") for n in names], F.lit(1).alias("_a"))
    b = second.select(*on, *[c(n).alias(f"b_{n}") for n in names], F.lit(1).alias("_b"))
    both = a.join(b, list(on), "full")
    paired = c("_a").isNotNull() & c("_b").isNotNull()
    differs = {
        **{n: ~((F.abs(c(f"a_{n}") - c(f"b_{n}")) <= tolerance) | (c(f"a_{n}").isNull() & c(f"b_{n}").isNull())) for n in numbers},
        **{n: ~c(f"a_{n}").eqNullSafe(c(f"b_{n}")) for n in texts}}
    return both.agg(
        F.count("_a").alias("rows_first"), F.count("_b").alias("rows_second"),
        F.count_if(c("_b").isNull()).alias("only_first"), F.count_if(c("_a").isNull()).alias("only_second"),
        *[F.count_if(paired & F.coalesce(cond, F.lit(True))).alias(f"diff_{n}") for n, cond in differs.items()])


def source_parity(
    local: DataFrame, other: DataFrame, keys: Sequence[str] = ("strategy_id",), pnl: str = "net_pnl",
    max_trade_delta: float = 5.0, max_net_delta: float = 10.0,
) -> DataFrame:
    """Trade count and net profit of two sources of the same strategies, in percent."""
    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_trades"), F.sum(pnl).alias(f"{name}_net"))
    out = totals(local, "local").join(totals(other, "other"), list(keys), "full").fillna(0)
    out = out.withColumns({
        "trade_delta_pct": 100 * F.abs(c("local_trades") - c("other_trades")) / F.greatest(c("other_trades"), F.lit(1)),
        "net_delta_pct": 100 * F.abs(c("local_net") - c("other_net")) / F.greatest(F.abs("other_net"), F.lit(1.0))})
    ok = (c("trade_delta_pct") <= max_trade_delta) & (c("net_delta_pct") <= max_net_delta)
    return out.withColumn("decision", F.when(ok, "pass").otherwise("block"))
