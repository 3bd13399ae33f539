"""Queries for audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import quality as C
from tickloom.operators.bars import canonical_ticks
from tickloom.operators.features import base_features
from tickloom.plans import sql, standins as S
from tickloom.plans.registry import query, r, rounded


def _dirty_ticks(spark, folder):
    """Quotes at whole seconds per user group, so that times repeat and some quotes cross."""
    t = F.col("ts")
    return S.table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", t).cast("timestamp_ntz").alias("time"), F.col("event_id").alias("seq"),
        (F.col("value") - 1).alias("bid"), (F.col("value") + F.when(F.col("event_id") % 17 == 0, -2).otherwise(1)).alias("ask"),
        F.lit(1.0).alias("bid_volume"), F.lit(1.0).alias("ask_volume"))


_DIRTY = """dirty AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, event_id AS seq, value - 1 AS bid,
  value + CASE WHEN event_id % 17 = 0 THEN -2 ELSE 1 END AS ask FROM events)"""


@query("a5_canonical_ticks", f"""
WITH {_DIRTY} SELECT symbol, time, max(seq) AS seq, round(arg_max(bid, seq), 6) AS bid, round(arg_max(ask, seq), 6) AS ask,
  round((arg_max(bid, seq) + arg_max(ask, seq)) / 2, 6) AS mid, round(arg_max(ask, seq) - arg_max(bid, seq), 6) AS spread FROM dirty GROUP BY 1, 2""")
def canonical(spark, folder):
    return rounded(canonical_ticks(_dirty_ticks(spark, folder)).select("symbol", "time", "seq", "bid", "ask", "mid", "spread"))


_TQ = """tq AS (SELECT symbol, CAST(time AS DATE) AS day, count(*) AS tick_rows, count(*) - count(DISTINCT time) AS duplicate_tick_times,
  count(*) FILTER (ask < bid) AS crossed_quotes, count(*) FILTER (bid <= 0 OR ask <= 0) AS nonpositive_quotes FROM dirty GROUP BY 1, 2)"""


@query("c1_tick_quality", f"WITH {_DIRTY}, {_TQ} SELECT * FROM tq")
def tick_quality(spark, folder):
    return C.tick_quality(_dirty_ticks(spark, folder))


_OPEN = "(isodow(h) <= 4 OR (isodow(h) = 5 AND hour(h) < 21) OR (isodow(h) = 7 AND hour(h) >= 22))"
_MISSING = f"""p AS (SELECT DISTINCT symbol, date_trunc('hour', time) AS h FROM ticks),
sp AS (SELECT symbol, min(h) AS a, max(h) AS b FROM p GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM sp),
missing AS (SELECT symbol, h AS hour FROM g WHERE {_OPEN} AND NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = g.symbol AND p.h = g.h))"""


@query("c3_missing_open_hours", f"WITH {sql.TICKS}, {_MISSING} SELECT symbol, hour FROM missing")
def missing_hours(spark, folder):
    return C.missing_open_hours(S.ticks(spark, folder))


@query("c2_quality_verdict", f"""
WITH {_DIRTY}, {_TQ}, {sql.TICKS}, {_MISSING}, q AS (SELECT symbol, CAST(sum(tick_rows) AS BIGINT) AS tick_rows, CAST(sum(duplicate_tick_times) AS BIGINT) AS duplicate_tick_times,
  CAST(sum(crossed_quotes) AS BIGINT) AS crossed_quotes, CAST(sum(nonpositive_quotes) AS BIGINT) AS nonpositive_quotes, count(*) AS days FROM tq GROUP BY 1),
m AS (SELECT symbol, count(*) AS missing_hours FROM missing GROUP BY 1)
SELECT q.*, coalesce(missing_hours, 0) AS missing_hours, duplicate_tick_times + crossed_quotes + nonpositive_quotes + coalesce(missing_hours, 0) = 0 AND tick_rows > 0 AS passed
FROM q LEFT JOIN m USING (symbol)""")
def verdict(spark, folder):
    return C.quality_verdict(C.tick_quality(_dirty_ticks(spark, folder)), missing_hours=C.missing_open_hours(S.ticks(spark, folder)))


def _broken_bars(spark, folder):
    """Supplier bars with some highs moved below the close and some closes removed."""
    bars = S.daily_bars(spark, folder, "l_suppkey")
    return bars.withColumns({
        "high": F.when(F.col("bar_idx") % 97 == 5, F.col("close") - 1).otherwise(F.col("high")),
        "close": F.when(F.col("bar_idx") % 101 == 7, F.lit(None)).otherwise(F.col("close"))})


_EASTER = """easter AS (SELECT y, make_date(CAST(y AS BIGINT), CAST((h + l - 7 * m + 114) // 31 AS BIGINT), CAST((h + l - 7 * m + 114) % 31 + 1 AS BIGINT)) AS d FROM (
  SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
  SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM (
  SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(1990, 2030) t(y))))))"""
_CLOSED = """closed AS (SELECT CAST(d AS DATE) AS d FROM generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2025-01-01', INTERVAL 1 DAY) t(d)
  WHERE isodow(d) >= 6 OR (month(d) = 1 AND day(d) = 1) OR (month(d) = 12 AND day(d) = 25) OR CAST(d AS DATE) IN (SELECT e.d - 2 FROM easter e))"""
_DAYS = f"""{_EASTER}, {_CLOSED}, pr AS (SELECT DISTINCT symbol, CAST(time AS DATE) AS day FROM bars), sp AS (SELECT symbol, min(day) AS a, max(day) AS b FROM pr GROUP BY 1),
missing AS (SELECT symbol, CAST(day AS DATE) AS day FROM (SELECT symbol, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM sp)
  WHERE CAST(day AS DATE) NOT IN (SELECT d FROM closed) AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.symbol = sp.symbol AND pr.day = CAST(day AS DATE)))"""
_DAYS = _DAYS.replace("FROM (SELECT symbol, unnest", "FROM (SELECT symbol, unnest").replace("FROM sp)\n", "FROM sp) g\n").replace("pr.symbol = sp.symbol AND pr.day = CAST(day AS DATE)", "pr.symbol = g.symbol AND pr.day = CAST(g.day AS DATE)")


@query("c5_missing_trading_days", f"WITH {sql.daily_bars()}, {_DAYS} SELECT symbol, day FROM missing")
def missing_days(spark, folder):
    return C.missing_trading_days(S.daily_bars(spark, folder))


_GAPS = """st AS (SELECT symbol, time, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS nt FROM bars),
gaps AS (SELECT symbol, time, nt AS next_time, epoch(nt - time) / 60 AS minutes FROM st WHERE epoch(nt - time) > 18 * 86400 AND NOT (
  NOT EXISTS (SELECT 1 FROM generate_series(CAST(CAST(time AS DATE) + 1 AS TIMESTAMP), CAST(CAST(nt AS DATE) - 1 AS TIMESTAMP), INTERVAL 1 DAY) t(x) WHERE CAST(x AS DATE) NOT IN (SELECT d FROM closed))
  AND (CAST(time AS DATE) IN (SELECT d FROM closed) OR CAST(nt AS DATE) IN (SELECT d FROM closed) OR isodow(time) = 5)))"""


@query("c6_suspicious_gaps", f"WITH {sql.SUPPLIERS}, {_EASTER}, {_CLOSED}, {_GAPS} SELECT symbol, time, next_time, round(minutes, 6) AS minutes FROM gaps")
def gaps(spark, folder):
    return rounded(C.suspicious_gaps(S.daily_bars(spark, folder, "l_suppkey"), "d1"))


_AUDIT = f"""{sql.daily_bars('l_suppkey', 'good')}, bars AS (SELECT * REPLACE (CASE WHEN bar_idx % 97 = 5 THEN close - 1 ELSE high END AS high,
  CASE WHEN bar_idx % 101 = 7 THEN NULL ELSE close END AS close) FROM good), {_DAYS}, {_GAPS},
audit AS (SELECT symbol, count(*) AS rows, min(time) AS first_time, max(time) AS last_time, count(*) - count(DISTINCT time) AS duplicate_timestamps,
  count(*) FILTER (close IS NULL OR high IS NULL) AS null_ohlc_rows, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close) <= 0) AS invalid_ohlc_rows FROM bars GROUP BY 1),
full_audit AS (SELECT a.*, coalesce(md.n, 0) AS missing_trading_days, coalesce(g.n, 0) AS large_gaps FROM audit a LEFT JOIN (SELECT symbol, count(*) AS n FROM missing GROUP BY 1) md USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) AS n FROM gaps GROUP BY 1) g USING (symbol))"""
_COUNTS = ["duplicate_timestamps", "null_ohlc_rows", "invalid_ohlc_rows", "missing_trading_days", "large_gaps"]


@query("c4_c6_bar_audit", f"WITH {_AUDIT} SELECT symbol, rows, first_time, last_time, {', '.join(_COUNTS)}, {' + '.join(_COUNTS)} = 0 AS passed FROM full_audit")
def bar_audit(spark, folder):
    return C.bar_audit(_broken_bars(spark, folder), "d1").drop("issues")


@query("c7_audit_warnings", f"WITH {_AUDIT} SELECT count(*) AS audits, count(*) FILTER ({' + '.join(_COUNTS)} > 0) AS warning_count FROM full_audit")
def audit_warnings(spark, folder):
    return C.audit_warnings(C.bar_audit(_broken_bars(spark, folder), "d1"), "d1").select("audits", "warning_count")


@query("c8_feature_parity", f"""
{sql.smoothed()}, j AS (SELECT unnest(['ema20', 'ema50', 'atr14']) AS "column", unnest([ema20, ema50, atr14]) AS a, unnest([ema20 * (1 + bar_idx * 0.00001), ema50 + 0.0001, atr14 * 1.02]) AS b FROM frame)
SELECT "column", count(*) AS n, round(max(abs(a - b)), 6) AS max_abs_diff, round(avg(abs(a - b)), 6) AS mean_abs_diff, round(quantile_cont(abs(a - b), 0.99), 6) AS p99_abs_diff,
  round(avg(CAST(abs(a - b) <= 1e-3 OR abs(a - b) <= 1e-2 * abs(a) AS INTEGER)), 6) AS within_share, round(min(a), 6) AS min_a, round(max(a), 6) AS max_a,
  round(min(b), 6) AS min_b, round(max(b), 6) AS max_b, avg(CAST(abs(a - b) <= 1e-3 OR abs(a - b) <= 1e-2 * abs(a) AS INTEGER)) >= 0.98 AS passed FROM j GROUP BY 1""")
def feature_parity(spark, folder):
    one = base_features(S.quote_bars(spark, folder))
    two = one.withColumns({"ema20": F.col("ema20") * (1 + F.col("bar_idx") * 0.00001), "ema50": F.col("ema50") + 0.0001, "atr14": F.col("atr14") * 1.02})
    return rounded(C.feature_parity(one, two, ["ema20", "ema50", "atr14"]))


_RUNS = f"""{sql.LEDGER}, a AS (SELECT strategy_id, trade_id AS trade_no, net_pnl, direction FROM ledger WHERE trade_id % 50 <> 1),
b AS (SELECT strategy_id, trade_id AS trade_no, net_pnl + CASE WHEN trade_id % 10 = 0 THEN 0.01 ELSE 0 END AS net_pnl,
  CASE WHEN trade_id % 25 = 3 THEN 'X' ELSE direction END AS direction FROM ledger WHERE trade_id % 40 <> 2)"""


@query("c9_ledger_difference", f"""
WITH {_RUNS} SELECT count(a.trade_no) AS rows_first, count(b.trade_no) AS rows_second, count(*) FILTER (b.trade_no IS NULL) AS only_first, count(*) FILTER (a.trade_no IS NULL) AS only_second,
  count(*) FILTER (abs(a.net_pnl - b.net_pnl) > 1e-6) AS diff_net_pnl, count(*) FILTER (a.direction <> b.direction) AS diff_direction
FROM a FULL JOIN b ON a.strategy_id = b.strategy_id AND a.trade_no = b.trade_no""")
def ledger_difference(spark, folder):
    base = S.ledger(spark, folder).withColumnRenamed("trade_id", "trade_no")
    k = F.col("trade_no")
    first = base.filter(k % 50 != 1)
    second = base.filter(k % 40 != 2).withColumns({
        "net_pnl": F.col("net_pnl") + F.when(k % 10 == 0, 0.01).otherwise(0.0), "direction": F.when(k % 25 == 3, "X").otherwise(F.col("direction"))})
    return C.ledger_difference(first, second, ["net_pnl"], ["direction"])


@query("c10_source_parity", f"""
WITH {sql.LEDGER}, a AS (SELECT strategy_id, count(*) AS local_trades, sum(net_pnl) AS local_net FROM ledger WHERE trade_id % 50 <> 1 GROUP BY 1),
b AS (SELECT strategy_id, count(*) AS other_trades, sum(net_pnl) AS other_net FROM ledger GROUP BY 1),
p AS (SELECT *, 100 * abs(local_trades - other_trades) / greatest(other_trades, 1) AS td, 100 * abs(local_net - other_net) / greatest(abs(other_net), 1) AS nd FROM a JOIN b USING (strategy_id))
SELECT strategy_id, local_trades, round(local_net, 4) AS local_net, other_trades, round(other_net, 4) AS other_net, round(td, 4) AS trade_delta_pct, round(nd, 4) AS net_delta_pct,
  CASE WHEN td <= 5 AND nd <= 10 THEN 'pass' ELSE 'block' END AS decision FROM p""")
def source_parity(spark, folder):
    base = S.ledger(spark, folder)
    return rounded(C.source_parity(base.filter(F.col("trade_id") % 50 != 1), base), 4)
