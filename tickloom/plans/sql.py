"""SQL fragments shared by the oracle queries: the stand-in tables as CTEs."""

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts AS time, event_id AS seq, value - 0.05 AS bid, value + 0.05 AS ask,
         CAST(user_id AS DOUBLE) AS bid_volume, 1.0::DOUBLE AS ask_volume, value AS mid, 0.1::DOUBLE AS spread
  FROM events)"""


def quote_bars(interval: str = "1 hour", name: str = "bars", source: str = "ticks") -> str:
    return f"""{name}_raw AS (
  SELECT symbol, time_bucket(INTERVAL '{interval}', time) AS t,
         arg_min(mid, time) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, time) AS close,
         arg_min(bid, time) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, arg_max(bid, time) AS bid_close,
         arg_min(ask, time) AS ask_open, max(ask) AS ask_high, min(ask) AS ask_low, arg_max(ask, time) AS ask_close,
         count(*) AS tick_volume, sum(bid_volume + ask_volume) AS real_volume, arg_min(spread, time) AS spread_open,
         avg(spread) AS spread_mean, max(spread) AS spread_max, CAST(count(*) AS DOUBLE) AS volume
  FROM {source} GROUP BY 1, 2),
{name} AS (
  SELECT * EXCLUDE (t), t AS time, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_idx FROM {name}_raw)"""


QUOTES = f"{TICKS}, {quote_bars()}"


def daily_bars(symbol: str = "l_returnflag", name: str = "bars") -> str:
    line = "(l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey"
    return f"""{name}_raw AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, l_shipdate AS t,
         arg_min(l_extendedprice / l_quantity, {line}) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {line}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2),
{name} AS (
  SELECT * EXCLUDE (t), t AS time, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_idx FROM {name}_raw)"""


SUPPLIERS = daily_bars("l_suppkey")

LEDGER = """ledger AS (
  SELECT o_orderpriority AS strategy_id, o_orderkey AS trade_id, o_orderdate AS entry_time,
         o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS exit_time, o_orderstatus AS direction,
         (o_totalprice - 250000) / 1000 + 2.5 AS gross_pnl, (o_totalprice - 250000) / 1000 AS net_pnl,
         2.0::DOUBLE AS commission, 0.5::DOUBLE AS swap, CAST(50 + o_custkey % 50 AS DOUBLE) AS initial_risk,
         CASE WHEN (o_totalprice - 250000) / 1000 > 100 THEN 'take_profit'
              WHEN (o_totalprice - 250000) / 1000 < -100 THEN 'stop_loss' ELSE 'max_hold' END AS exit_reason,
         CAST(o_custkey % 4 AS INTEGER) AS session, CAST(o_custkey % 5 AS INTEGER) AS regime
  FROM orders)"""

# The recursive smoothers, one row per step; `x` columns hold the current state.
SMOOTHED = """moves AS (
  SELECT *, greatest(close - lag(close) OVER s, 0) AS gain, greatest(lag(close) OVER s - close, 0) AS loss,
         greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr,
         close / lag(close) OVER s - 1 AS ret
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY time)),
steps AS (
  SELECT symbol, bar_idx, close AS e20, close AS e50, close AS e200, close AS e12, close AS e26,
         NULL::DOUBLE AS up, NULL::DOUBLE AS down, high - low AS atr, 0.0::DOUBLE AS sig
  FROM moves WHERE bar_idx = 0
  UNION ALL
  SELECT m.symbol, m.bar_idx, p.e20 + (m.close - p.e20) * 2 / 21, p.e50 + (m.close - p.e50) * 2 / 51,
         p.e200 + (m.close - p.e200) * 2 / 201, p.e12 + (m.close - p.e12) * 2 / 13, p.e26 + (m.close - p.e26) * 2 / 27,
         CASE WHEN m.bar_idx = 1 THEN m.gain ELSE p.up + (m.gain - p.up) / 14 END,
         CASE WHEN m.bar_idx = 1 THEN m.loss ELSE p.down + (m.loss - p.down) / 14 END,
         p.atr + (m.tr - p.atr) / 14,
         p.sig + (p.e12 + (m.close - p.e12) * 2 / 13 - p.e26 - (m.close - p.e26) * 2 / 27 - p.sig) * 2 / 10
  FROM steps p JOIN moves m ON m.symbol = p.symbol AND m.bar_idx = p.bar_idx + 1),
frame AS (
  SELECT m.* EXCLUDE (gain, loss, tr), e20 AS ema20, e50 AS ema50, e200 AS ema200,
         100 - 100 / (1 + up / nullif(down, 0)) AS rsi14, atr AS atr14, e12 - e26 - sig AS macd_hist,
         CASE WHEN e20 > e50 AND e50 > e200 THEN 1 WHEN e20 < e50 AND e50 < e200 THEN -1 ELSE 0 END AS trend,
         high - low AS rng, abs(close - open) AS body, high - greatest(open, close) AS uwk, least(open, close) - low AS lwk,
         CAST(close >= open AS INTEGER) AS bull, abs(close - open) / nullif(high - low, 0) AS body_pct,
         (high - greatest(open, close)) / nullif(high - low, 0) AS uwk_pct,
         (least(open, close) - low) / nullif(high - low, 0) AS lwk_pct,
         (high - low) / nullif(atr, 0) AS rng_atr, atr / close AS atr_pct, (e12 - e26 - sig) / nullif(atr, 0) AS macd_norm,
         CASE WHEN hour(time) BETWEEN 2 AND 6 THEN 0 WHEN hour(time) BETWEEN 7 AND 11 THEN 1
              WHEN hour(time) BETWEEN 12 AND 16 THEN 2 WHEN hour(time) BETWEEN 17 AND 20 THEN 3 ELSE 4 END AS session
  FROM moves m JOIN steps USING (symbol, bar_idx))"""

FRAMED = """banded AS (
  SELECT *,
    CASE WHEN bar_idx >= 19 THEN avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20 END AS bb_up,
    CASE WHEN bar_idx >= 19 THEN avg(close) OVER w20 END AS bb_mid,
    CASE WHEN bar_idx >= 19 THEN avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20 END AS bb_lo,
    CASE WHEN bar_idx >= 19 THEN 4 * stddev_pop(close) OVER w20 / avg(close) OVER w20 END AS bb_width,
    least(coalesce(nullif(volume, 0), 1) / avg(coalesce(nullif(volume, 0), 1)) OVER w20, 5) AS vol_ratio,
    least(greatest(100 * (close - min(low) OVER w14) / (max(high) OVER w14 - min(low) OVER w14 + 1e-9), 0), 100) AS stoch_k,
    coalesce(greatest(uwk, lwk) / nullif(rng, 0), 0) AS pin_bar,
    CASE WHEN high < lag(high) OVER o AND low > lag(low) OVER o THEN 1.0 ELSE 0.0 END::DOUBLE AS inside_bar,
    CASE WHEN high > lag(high) OVER o AND low < lag(low) OVER o THEN 1.0 ELSE 0.0 END::DOUBLE AS outside_bar,
    CASE WHEN bar_idx >= 4 AND (max(high) OVER w25 - close) / (nullif(atr14, 0) + 1e-9) < 1 THEN -1.0
         WHEN bar_idx >= 4 AND (close - min(low) OVER w25) / (nullif(atr14, 0) + 1e-9) < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS sd_zone,
    sum((high + low + close) / 3 * coalesce(nullif(volume, 0), 1)) OVER w96 / sum(coalesce(nullif(volume, 0), 1)) OVER w96 AS vwap,
    CASE WHEN count(ret) OVER w20 >= 5 THEN avg(ret) OVER w20 / nullif(stddev_samp(ret) OVER w20, 0) END AS raw_sharpe,
    rsi14 - lag(rsi14, 5) OVER o AS rsi_slope5
  FROM frame
  WINDOW o AS (PARTITION BY symbol ORDER BY time),
    w14 AS (PARTITION BY symbol ORDER BY time ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING),
    w25 AS (PARTITION BY symbol ORDER BY time ROWS 24 PRECEDING), w96 AS (PARTITION BY symbol ORDER BY time ROWS 95 PRECEDING)),
feats AS (
  SELECT *,
    CASE WHEN raw_sharpe IS NULL THEN 0 ELSE least(greatest(raw_sharpe, -3), 3) END AS rolling_sharpe,
    CASE WHEN vol_ratio * body_pct > 5 THEN 5 ELSE vol_ratio * body_pct END AS vol_body_conf,
    CASE WHEN close < open AND vol_ratio > 1.2 THEN 1.0 WHEN close > open AND NOT vol_ratio > 1.2 THEN -1.0 ELSE 0.0 END::DOUBLE AS vol_price_div,
    CASE WHEN bb_width > lag(bb_width, 3) OVER o THEN 1.0 ELSE 0.0 END::DOUBLE AS bb_expanding,
    avg(stoch_k) OVER w3 AS stoch_d,
    coalesce(least(greatest((close - vwap) / vwap * 100, -5), 5), 0) AS vwap_dist,
    CASE WHEN trend = 1 AND atr_pct > 1.1 * q_atr THEN 0 WHEN trend = -1 AND atr_pct > 1.1 * q_atr THEN 1
         WHEN trend = 0 AND bb_width > q_hi THEN 3 WHEN bb_width < q_lo AND atr_pct < 0.9 * q_atr THEN 2 ELSE 4 END AS regime
  FROM (SELECT *,
      CASE WHEN count(atr_pct) OVER w200 >= 50 THEN quantile_cont(atr_pct, 0.5) OVER w200 END AS q_atr,
      CASE WHEN count(bb_width) OVER w100 >= 20 THEN quantile_cont(bb_width, 0.25) OVER w100 END AS q_lo,
      CASE WHEN count(bb_width) OVER w100 >= 20 THEN quantile_cont(bb_width, 0.75) OVER w100 END AS q_hi
    FROM banded
    WINDOW w200 AS (PARTITION BY symbol ORDER BY time ROWS 199 PRECEDING), w100 AS (PARTITION BY symbol ORDER BY time ROWS 99 PRECEDING))
  WINDOW o AS (PARTITION BY symbol ORDER BY time), w3 AS (PARTITION BY symbol ORDER BY time ROWS 2 PRECEDING))"""


def smoothed(bars: str = QUOTES) -> str:
    """WITH clause up to `frame`."""
    return f"WITH RECURSIVE {bars}, {SMOOTHED}"


def featured(bars: str = QUOTES) -> str:
    """WITH clause up to `feats`."""
    return f"WITH RECURSIVE {bars}, {SMOOTHED}, {FRAMED}"
