"""Queries over ticks, bars and their trailing columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import features as D
from tickloom.operators.labels import forward_return
from tickloom.operators.scan import over_chunks
from tickloom.plans import sql, standins as S
from tickloom.plans.registry import query, r, rounded

PRICES = ["open", "high", "low", "close"]
QUOTE_COLUMNS = [p + c for p in ("", "bid_", "ask_") for c in PRICES]


@query("m0_band_breakout_forward_return", f"""
WITH {sql.QUOTES}, b AS (
  SELECT symbol, bar_idx, close, avg(close) OVER w + 2 * stddev_pop(close) OVER w AS up, avg(close) OVER w - 2 * stddev_pop(close) OVER w AS lo,
         lead(close, 4) OVER (PARTITION BY symbol ORDER BY time) / close - 1 AS fwd
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING))
SELECT symbol, CASE WHEN close > up THEN 'above' ELSE 'below' END AS side, count(*) AS signals, count(fwd) AS resolved,
       round(avg(fwd), 6) AS mean_fwd, round(avg(CAST(fwd > 0 AS INTEGER)), 6) AS up_share
FROM b WHERE bar_idx >= 19 AND (close > up OR close < lo) GROUP BY 1, 2""")
def band_breakout(spark, folder):
    """When an hourly bar closes outside its 20-bar band, what is the next-4-bar return?"""
    bars = S.quote_bars(spark, folder)
    frame = over_chunks(
        bars, lambda w: {**D.bands(w), **forward_return(w, 4)}, before=19, after=4,
        keep=(F.col("close") > F.col("bb_up")) | (F.col("close") < F.col("bb_lo")))
    return rounded(
        frame.groupBy("symbol", F.when(F.col("close") > F.col("bb_up"), "above").otherwise("below").alias("side"))
        .agg(F.count(F.lit(1)).alias("signals"), F.count("fwd_ret_4").alias("resolved"), F.avg("fwd_ret_4").alias("mean_fwd"),
             F.avg((F.col("fwd_ret_4") > 0).cast("int")).alias("up_share")))


_BAR_SQL = f"symbol, time, {r(*QUOTE_COLUMNS)}, tick_volume, {r('real_volume', 'spread_open', 'spread_mean', 'spread_max')}"


@query("b1_ticks_to_bars_m5", f"WITH {sql.TICKS}, {sql.quote_bars('5 minutes')} SELECT 'm5' AS timeframe, {_BAR_SQL} FROM bars")
def ticks_to_bars(spark, folder):
    return rounded(B.ticks_to_bars(S.ticks(spark, folder), "m5"))


_SEVERAL = ["m5", "m15", "h1", "h4", "d1"]


@query("b2_multi_timeframe_bars", f"WITH {sql.TICKS}, " + ", ".join(
    sql.quote_bars(i, n) for n, i in zip(_SEVERAL, ["5 minutes", "15 minutes", "1 hour", "4 hours", "1 day"])) + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS timeframe, {_BAR_SQL} FROM {n}" for n in _SEVERAL))
def multi_timeframe(spark, folder):
    return rounded(B.multi_timeframe_bars(S.ticks(spark, folder), _SEVERAL))


@query("b3_roll_up_bars", f"""
WITH {sql.QUOTES} SELECT symbol, tf AS timeframe, time_bucket(CASE tf WHEN 'h4' THEN INTERVAL '4 hours' ELSE INTERVAL '12 hours' END, time) AS time,
  round(arg_min(open, time), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, time), 6) AS close,
  round(sum(volume), 6) AS volume FROM bars, (VALUES ('h4'), ('h12')) v(tf) GROUP BY 1, 2, 3""")
def roll_up(spark, folder):
    bars = S.quote_bars(spark, folder).select("symbol", "time", *PRICES, "volume")
    return rounded(B.roll_up(bars, ["h4", "h12"]))


@query("b6_dense_daily_pnl", f"""
WITH {sql.LEDGER}, d AS (SELECT strategy_id, CAST(exit_time AS DATE) AS day, sum(net_pnl) AS pnl FROM ledger GROUP BY 1, 2),
s AS (SELECT strategy_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
g AS (SELECT strategy_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s),
e AS (SELECT DISTINCT strategy_id, CAST(entry_time AS DATE) AS day, TRUE AS o FROM ledger)
SELECT strategy_id, day, round(coalesce(pnl, 0), 6) AS pnl, coalesce(o, FALSE) AS opened
FROM g LEFT JOIN d USING (strategy_id, day) LEFT JOIN e USING (strategy_id, day)""")
def dense_pnl(spark, folder):
    return rounded(B.dense_daily_pnl(S.ledger(spark, folder)))


@query("b5_daily_pnl", f"WITH {sql.LEDGER} SELECT strategy_id, CAST(exit_time AS DATE) AS day, round(sum(net_pnl), 6) AS pnl FROM ledger GROUP BY 1, 2")
def daily(spark, folder):
    return rounded(B.daily_pnl(S.ledger(spark, folder)))


@query("b7_period_pnl", f"""
WITH {sql.LEDGER} SELECT strategy_id, strftime(exit_time, '%Y-%m') AS month, year(exit_time) || 'Q' || quarter(exit_time) AS quarter,
  CAST(year(exit_time) AS VARCHAR) AS year, count(*) AS trades, round(sum(net_pnl), 6) AS pnl FROM ledger GROUP BY 1, 2, 3, 4""")
def period_pnl(spark, folder):
    keys = B.period_keys(F.col("exit_time"))
    return rounded(S.ledger(spark, folder).groupBy("strategy_id", *[keys[k].alias(k) for k in ("month", "quarter", "year")])
                   .agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("pnl")))


@query("b8_strided_bars", f"""
WITH {sql.QUOTES} SELECT symbol, time, bar_idx, round(close, 6) AS close FROM bars JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) USING (symbol)
WHERE bar_idx % greatest(1, n // 100) = 0""")
def strided(spark, folder):
    return rounded(B.strided(S.quote_bars(spark, folder), 100).select("symbol", "time", "bar_idx", "close"))


_SESSION = """CASE WHEN hour(time) BETWEEN 2 AND 6 THEN 0 WHEN hour(time) BETWEEN 7 AND 11 THEN 1
  WHEN hour(time) BETWEEN 12 AND 16 THEN 2 WHEN hour(time) BETWEEN 17 AND 20 THEN 3 ELSE 4 END"""
_BLOCKS = f"""sess AS (SELECT *, {_SESSION} AS session FROM bars),
flagged AS (SELECT *, CAST(session <> coalesce(lag(session) OVER (PARTITION BY symbol ORDER BY time), -1) AS INTEGER) AS opens FROM sess),
blocks AS (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY time) - 1 AS block_id FROM flagged)"""


@query("b10_session_blocks", f"""
WITH {sql.QUOTES}, {_BLOCKS} SELECT symbol, time, CAST(session AS BIGINT) AS session, CAST(block_id AS BIGINT) AS block_id,
  min(time) OVER (PARTITION BY symbol, block_id) AS block_start FROM blocks""")
def session_blocks(spark, folder):
    return rounded(B.session_blocks(S.quote_bars(spark, folder)).select("symbol", "time", "session", "block_id", "block_start"))


_BASE = ["ema20", "ema50", "ema200", "rsi14", "atr14", "macd_hist", "rng", "body", "uwk", "lwk", "body_pct", "uwk_pct", "lwk_pct",
         "rng_atr", "atr_pct", "macd_norm"]


@query("d1_d8_base_features", f"""
{sql.smoothed()} SELECT symbol, time, {r(*_BASE)}, CAST(trend AS BIGINT) AS trend, CAST(bull AS BIGINT) AS bull, CAST(session AS BIGINT) AS session FROM frame""")
def base_features(spark, folder):
    frame = D.base_features(S.quote_bars(spark, folder))
    return rounded(frame.select("symbol", "time", *_BASE, "trend", "bull", "session"))


@query("d1_d3_smoothers_many_symbols", f"""
{sql.smoothed(sql.SUPPLIERS)} SELECT symbol, time, {r('ema20', 'ema50', 'ema200', 'rsi14', 'atr14', 'macd_hist', digits=4)}, CAST(trend AS BIGINT) AS trend FROM frame""")
def smoothers_many(spark, folder):
    frame = D.base_features(S.daily_bars(spark, folder, "l_suppkey"))
    return rounded(frame.select("symbol", "time", "ema20", "ema50", "ema200", "rsi14", "atr14", "macd_hist", "trend"), 4)


_FRAMES = ["bb_up", "bb_mid", "bb_lo", "bb_width", "vol_ratio", "vol_body_conf", "vol_price_div", "bb_expanding", "stoch_k", "stoch_d",
           "pin_bar", "inside_bar", "outside_bar", "rolling_sharpe", "sd_zone", "vwap_dist"]


@query("d4_d21_frame_features", f"{sql.featured()} SELECT symbol, time, {r(*_FRAMES)}, CAST(regime AS BIGINT) AS regime FROM feats")
def frame_features(spark, folder):
    frame = D.add_frames(D.base_features(S.quote_bars(spark, folder)))
    return rounded(frame.select("symbol", "time", *_FRAMES, "regime"))


@query("d21_regime_counts_many_symbols", f"""
{sql.featured(sql.SUPPLIERS)} SELECT symbol, CAST(regime AS BIGINT) AS regime, count(*) AS bars, round(avg(bb_width), 6) AS bb_width,
  round(avg(rolling_sharpe), 6) AS rolling_sharpe FROM feats GROUP BY 1, 2""")
def regime_counts(spark, folder):
    frame = D.add_frames(D.base_features(S.daily_bars(spark, folder, "l_suppkey")))
    return rounded(frame.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.avg("bb_width").alias("bb_width"), F.avg("rolling_sharpe").alias("rolling_sharpe")))


@query("d12_point_of_control", f"""
WITH {sql.QUOTES}, due AS (SELECT symbol, bar_idx FROM bars WHERE bar_idx >= 100 AND bar_idx % 5 = 0),
past AS (SELECT d.symbol, d.bar_idx, b.close, coalesce(nullif(b.volume, 0), 1) AS v, max(b.high) OVER p AS top, min(b.low) OVER p AS bottom
  FROM due d JOIN bars b ON b.symbol = d.symbol AND b.bar_idx BETWEEN d.bar_idx - 100 AND d.bar_idx - 1 WINDOW p AS (PARTITION BY d.symbol, d.bar_idx)),
cells AS (SELECT symbol, bar_idx, top, bottom, least(floor((close - bottom) / (top - bottom) * 20), 19) AS cell, sum(v) AS v FROM past WHERE top > bottom GROUP BY ALL),
best AS (SELECT symbol, bar_idx, bottom + (cell + 0.5) * (top - bottom) / 20 AS poc FROM cells
  QUALIFY row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY v DESC, cell) = 1),
carried AS (SELECT b.*, last_value(poc IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time) AS last_poc FROM bars b LEFT JOIN best USING (symbol, bar_idx))
SELECT symbol, time, round(CASE WHEN last_poc > 0 THEN (close - last_poc) / (close + 1e-9) ELSE 0 END, 6) AS poc_dist FROM carried""")
def point_of_control(spark, folder):
    return rounded(D.point_of_control(S.quote_bars(spark, folder)).select("symbol", "time", "poc_dist"))


@query("d13_previous_session_bias", f"""
WITH {sql.QUOTES}, {_BLOCKS}, moves AS (SELECT symbol, block_id, sign(arg_max(close, time) - arg_min(close, time)) AS bias FROM blocks GROUP BY 1, 2)
SELECT b.symbol, b.time, CAST(coalesce(m.bias, 0) AS DOUBLE) AS prev_sess_bias FROM blocks b LEFT JOIN moves m ON m.symbol = b.symbol AND m.block_id = b.block_id - 1""")
def session_bias(spark, folder):
    return rounded(D.previous_session_bias(S.quote_bars(spark, folder)).select("symbol", "time", "prev_sess_bias"))


@query("d23_d24_split_and_warm_up", f"""
WITH {sql.SUPPLIERS}, s AS (SELECT symbol, bar_idx, close, CASE WHEN bar_idx < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split,
  CASE WHEN bar_idx < floor(n * 0.75) THEN bar_idx ELSE bar_idx - CAST(floor(n * 0.75) AS BIGINT) END AS split_idx FROM bars JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) USING (symbol))
SELECT symbol, split, count(*) AS bars, min(bar_idx) AS first_idx, max(bar_idx) AS last_idx, round(avg(close), 6) AS mean_close FROM s WHERE split_idx >= 50 GROUP BY 1, 2""")
def split_and_warm_up(spark, folder):
    split = D.chronological_split(S.daily_bars(spark, folder, "l_suppkey"))
    return rounded(D.drop_warm_up(split, 50, "split_idx").groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("bars"), F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx"), F.avg("close").alias("mean_close")))
