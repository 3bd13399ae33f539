"""Queries for signal blocks, signal families and their combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import blocks as H
from tickloom.operators import features as D
from tickloom.operators import signals as G
from tickloom.operators.align import join_previous_completed
from tickloom.operators.scan import over_chunks
from tickloom.plans import sql, standins as S
from tickloom.plans.registry import query, r, rounded
from tickloom.session import cut_lineage

c = F.col


def signal_frame(spark, folder):
    """Hourly bars with base features, two contexts and the columns the families read."""
    slow = S.quote_bars(spark, folder, "h4").withColumn("trend", F.signum(c("close") - c("open")).cast("int"))
    slow = slow.withColumns({"ema50": c("close"), "ema200": c("open"), "atr14": c("high") - c("low"), "atr_pct": (c("high") - c("low")) / c("close")})
    frame = D.base_features(S.quote_bars(spark, folder)).withColumn("h1_trend", c("trend"))
    frame = over_chunks(frame, lambda w: {**D.bands(w), **D.volume_ratio(w), **D.candle_patterns(w), **D.returns(w)},
                        lambda w: D.rolling_sharpe(w), before=40).drop("_ret")
    frame = join_previous_completed(frame, slow, ["trend", "ema50", "ema200", "atr14", "atr_pct"], "h4")
    frame = frame.withColumns({"h1_ema50": c("h4_ema50"), "h1_ema200": c("h4_ema200"), "h1_atr14": c("h4_atr14"), "regime": (c("bar_idx") % 5).cast("int"), "prev_sess_bias": F.lit(0.0)})
    return cut_lineage(D.fill_zero(frame))


_FR = f"""{sql.smoothed(f"{sql.TICKS}, {sql.quote_bars()}, {sql.quote_bars('4 hours', 'slow')}")}, {sql.FRAMED.split("feats AS (")[0].rstrip().rstrip(",")},
slag AS (SELECT symbol, time, lag(sign(close - open)) OVER o AS t, lag(close) OVER o AS e50, lag(open) OVER o AS e200, lag(high - low) OVER o AS at FROM slow WINDOW o AS (PARTITION BY symbol ORDER BY time)),
fr AS (SELECT f.* REPLACE (coalesce(rsi14, 0) AS rsi14, coalesce(rng_atr, 0) AS rng_atr, coalesce(body_pct, 0) AS body_pct, coalesce(uwk_pct, 0) AS uwk_pct, coalesce(lwk_pct, 0) AS lwk_pct, coalesce(bb_width, 0) AS bb_width),
  coalesce(s.t, 0) AS h4_trend, trend AS h1_trend, coalesce(s.e50, 0) AS e50, coalesce(s.e200, 0) AS e200, coalesce(s.at, 0) AS at, nullif(rng, 0) AS reach, CAST(f.time AS DATE) AS d,
  CASE WHEN raw_sharpe IS NULL THEN 0 ELSE least(greatest(raw_sharpe, -3), 3) END AS sharpe
  FROM banded f ASOF LEFT JOIN slag s ON s.symbol = f.symbol AND f.time >= s.time),
days AS (SELECT symbol, d, max(high) AS dh, min(low) AS dl, max(CASE WHEN hour(time) < 6 THEN high END) AS r6h, min(CASE WHEN hour(time) < 6 THEN low END) AS r6l,
  max(CASE WHEN hour(time) < 1 THEN high END) AS r1h, min(CASE WHEN hour(time) < 1 THEN low END) AS r1l, arg_min(open, time) AS dopen FROM fr GROUP BY 1, 2),
pdays AS (SELECT *, lag(dh) OVER (PARTITION BY symbol ORDER BY d) AS pdh, lag(dl) OVER (PARTITION BY symbol ORDER BY d) AS pdl FROM days),
b0 AS (SELECT fr.*, pdh, pdl, r6h, r6l, r1h, r1l, dopen, lag(close) OVER o AS c1, lag(high, 2) OVER o AS h2, lag(low, 2) OVER o AS l2, lag(rsi14) OVER o AS rsi1, lag(inside_bar) OVER o AS in1, lag(bb_width) OVER o AS bw1, lag(h1_trend) OVER o AS t1,
  CASE WHEN bar_idx >= 24 THEN max(high) OVER p END AS ph, CASE WHEN bar_idx >= 24 THEN min(low) OVER p END AS pl, CASE WHEN bar_idx >= 24 THEN max(low) OVER p END AS pml, CASE WHEN bar_idx >= 24 THEN min(high) OVER p END AS pmh,
  CASE WHEN bar_idx >= 4 AND lag(high, 2) OVER o = max(high) OVER s4 THEN lag(high, 2) OVER o END AS sh22, CASE WHEN bar_idx >= 4 AND lag(low, 2) OVER o = min(low) OVER s4 THEN lag(low, 2) OVER o END AS sl22,
  CASE WHEN bar_idx >= 7 AND lag(high, 3) OVER o = max(high) OVER s7 THEN lag(high, 3) OVER o END AS sh43, CASE WHEN bar_idx >= 7 AND lag(low, 3) OVER o = min(low) OVER s7 THEN lag(low, 3) OVER o END AS sl43,
  lag(open, 1) OVER o AS o1, lag(open, 2) OVER o AS o2, lag(open, 3) OVER o AS o3, lag(close, 2) OVER o AS c2, lag(close, 3) OVER o AS c3, lag(low, 1) OVER o AS l1, lag(low, 3) OVER o AS l3, lag(high, 1) OVER o AS h1, lag(high, 3) OVER o AS h3,
  CASE WHEN count(bb_width) OVER w200 >= 50 THEN quantile_cont(bb_width, 0.25) OVER w200 END AS q25
  FROM fr JOIN pdays USING (symbol, d) WINDOW o AS (PARTITION BY symbol ORDER BY time), p AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
  s4 AS (PARTITION BY symbol ORDER BY time ROWS 4 PRECEDING), s7 AS (PARTITION BY symbol ORDER BY time ROWS 7 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY time ROWS 199 PRECEDING)),
b AS (SELECT *, last_value(sh22 IGNORE NULLS) OVER o AS lsh, last_value(sl22 IGNORE NULLS) OVER o AS lsl, last_value(sh43 IGNORE NULLS) OVER o AS esh, last_value(sl43 IGNORE NULLS) OVER o AS esl,
  last_value(CASE WHEN low > h2 THEN h2 END IGNORE NULLS) OVER o AS gll, last_value(CASE WHEN low > h2 THEN low END IGNORE NULLS) OVER o AS glu,
  last_value(CASE WHEN high < l2 THEN high END IGNORE NULLS) OVER o AS gsl, last_value(CASE WHEN high < l2 THEN l2 END IGNORE NULLS) OVER o AS gsu,
  max(CAST(coalesce(low > h2, FALSE) AS INTEGER)) OVER n12 AS rgl, max(CAST(coalesce(high < l2, FALSE) AS INTEGER)) OVER n12 AS rgs,
  last_value(CASE WHEN rng_atr >= 1 AND body_pct >= 0.55 AND close > open THEN CASE WHEN c3 < o3 THEN l3 WHEN c2 < o2 THEN l2 WHEN c1 < o1 THEN l1 END END IGNORE NULLS) OVER o AS zl,
  last_value(CASE WHEN rng_atr >= 1 AND body_pct >= 0.55 AND close > open THEN CASE WHEN c3 < o3 THEN h3 WHEN c2 < o2 THEN h2 WHEN c1 < o1 THEN h1 END END IGNORE NULLS) OVER o AS zh,
  last_value(CASE WHEN rng_atr >= 1 AND body_pct >= 0.55 AND close < open THEN CASE WHEN c3 > o3 THEN l3 WHEN c2 > o2 THEN l2 WHEN c1 > o1 THEN l1 END END IGNORE NULLS) OVER o AS szl,
  last_value(CASE WHEN rng_atr >= 1 AND body_pct >= 0.55 AND close < open THEN CASE WHEN c3 > o3 THEN h3 WHEN c2 > o2 THEN h2 WHEN c1 > o1 THEN h1 END END IGNORE NULLS) OVER o AS szh
  FROM b0 WINDOW o AS (PARTITION BY symbol ORDER BY time), n12 AS (PARTITION BY symbol ORDER BY time ROWS 11 PRECEDING)),
k AS (SELECT *, max(CAST(coalesce(close > szh, FALSE) AS INTEGER)) OVER n AS brk, max(CAST(coalesce(close < zl, FALSE) AS INTEGER)) OVER n AS sbrk FROM b WINDOW n AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""

_CHECKED = [
    ({"name": "market_structure_shift", "buffer_atr": 0.1}, "close > lsh + 0.1 * atr14 AND c1 <= lsh + 0.1 * atr14", "close < lsl - 0.1 * atr14 AND c1 >= lsl - 0.1 * atr14"),
    ({"name": "break_of_structure"}, "close > lsh AND c1 <= lsh AND NOT h4_trend < 0", "close < lsl AND c1 >= lsl AND NOT h4_trend > 0"),
    ({"name": "change_of_character"}, "close > lsh AND c1 <= lsh AND t1 < 0", "close < lsl AND c1 >= lsl AND t1 > 0"),
    ({"name": "external_structure_break"}, "close > esh AND c1 <= esh", "close < esl AND c1 >= esl"),
    ({"name": "higher_timeframe_bias", "mode": "h1_turn_with_h4"}, "h1_trend > 0 AND NOT h4_trend < 0", "h1_trend < 0 AND NOT h4_trend > 0"),
    ({"name": "prior_day_liquidity", "buffer_atr": 0.05}, "low < pdl - 0.05 * atr14 AND close > pdl + 0.05 * atr14", "high > pdh + 0.05 * atr14 AND close < pdh - 0.05 * atr14"),
    ({"name": "asian_range_liquidity"}, "hour(time) >= 6 AND low < r6l AND close > r6l", "hour(time) >= 6 AND high > r6h AND close < r6h"),
    ({"name": "equal_high_low_liquidity", "tolerance_atr": 3.0}, "pml - pl <= 3 * atr14 AND low < pl AND close > pl", "ph - pmh <= 3 * atr14 AND high > ph AND close < ph"),
    ({"name": "stop_run_reclaim", "wick_min": 0.1, "close_location_min": 0.2}, "low < pl - 0.05 * atr14 AND close > pl AND lwk_pct >= 0.1 AND (close - low) / reach >= 0.2",
     "high > ph + 0.05 * atr14 AND close < ph AND uwk_pct >= 0.1 AND (high - close) / reach >= 0.2"),
    ({"name": "liquidity_pool_distance"}, "abs(close - pl) <= 0.8 * atr14", "abs(ph - close) <= 0.8 * atr14"),
    ({"name": "fvg", "mode": "new"}, "low > h2", "high < l2"),
    ({"name": "fair_value_gap"}, "low <= glu AND close >= gll", "high >= gsl AND close <= gsu"),
    ({"name": "ifvg"}, "close > gsu AND c1 <= gsu", "close < gll AND c1 >= gll"),
    ({"name": "balanced_price_range"}, "rgl > 0 AND rgs > 0", "rgl > 0 AND rgs > 0"),
    ({"name": "displacement_candle", "range_atr": 1.0}, "rng_atr >= 1 AND body_pct >= 0.55 AND close > open", "rng_atr >= 1 AND body_pct >= 0.55 AND close < open"),
    ({"name": "fvg_mitigation"}, "low <= glu AND close > gll AND close > open", "high >= gsl AND close < gsu AND close < open"),
    ({"name": "order_block", "ob_lookback": 3, "displacement_atr": 1.0}, "low <= zh AND close >= zl", "high >= szl AND close <= szh"),
    ({"name": "rejection_block", "ob_lookback": 3, "displacement_atr": 1.0}, "low <= zh AND close >= zl AND close > open", "high >= szl AND close <= szh AND close < open"),
    ({"name": "breaker_block", "ob_lookback": 3, "displacement_atr": 1.0}, "brk = 1 AND low <= szh", "sbrk = 1 AND high >= zl"),
    ({"name": "smt", "proxy": "dxy"}, "FALSE", "FALSE"),
    ({"name": "opening_range_break"}, "hour(time) >= 1 AND close > r1h AND c1 <= r1h", "hour(time) >= 1 AND close < r1l AND c1 >= r1l"),
    ({"name": "opening_range_reversal"}, "hour(time) >= 1 AND low < r1l AND close > r1l", "hour(time) >= 1 AND high > r1h AND close < r1h"),
    ({"name": "volatility_regime", "mode": "compression"}, "bb_width <= q25", "bb_width <= q25"),
    ({"name": "trend_day"}, "h1_trend > 0 AND h4_trend > 0 AND close > dopen + 0.35 * atr14", "h1_trend < 0 AND h4_trend < 0 AND close < dopen - 0.35 * atr14"),
    ({"name": "day_time_filter", "weekdays": "1,3", "session_start_utc": 6}, "isodow(time) IN (2, 4) AND hour(time) >= 6", "isodow(time) IN (2, 4) AND hour(time) >= 6"),
    ({"name": "trend_pullback"}, "low <= ema20 + 0.5 * atr14 AND close > ema20 AND rsi14 > 50", "high >= ema20 - 0.5 * atr14 AND close < ema20 AND rsi14 < 50"),
    ({"name": "inside_bar_expansion"}, "in1 > 0 AND close > h2", "in1 > 0 AND close < l2"),
    ({"name": "failed_breakout_reversal"}, "low < pl AND close > pl AND close > open", "high > ph AND close < ph AND close < open"),
    ({"name": "volatility_spike_reversal", "spike_range_atr": 1.0, "rsi_extreme": 45.0}, "rng_atr >= 1 AND rsi14 <= 45 AND (close > open OR lwk_pct >= 0.45)", "rng_atr >= 1 AND rsi14 >= 55 AND (close < open OR uwk_pct >= 0.45)"),
]
_flag = lambda cond: f"CAST(coalesce({cond}, FALSE) AS BIGINT)"
_FLAGS = ", ".join(f"{_flag(long)} AS b{i}_long, {_flag(short)} AS b{i}_short" for i, (_, long, short) in enumerate(_CHECKED))


@query("h1_h25_signal_blocks", f"{_FR} SELECT symbol, time, {_FLAGS} FROM k")
def signal_blocks(spark, folder):
    frame = signal_frame(spark, folder)
    out = H.evaluate_blocks(frame, [block for block, _, _ in _CHECKED])
    return rounded(out.select("symbol", "time", *[f"b{i}_{s}" for i in range(len(_CHECKED)) for s in ("long", "short")]))


_OTHER = [{"name": "internal_structure_break"}, {"name": "premium_discount"}, {"name": "london_sweep"}, {"name": "ny_sweep"}, {"name": "session_liquidity", "range_end_utc": 4},
          {"name": "mitigation_block"}, {"name": "volatility_regime", "mode": "high_vol_kill"}, {"name": "volatility_regime"}, {"name": "smt_divergence", "proxy": "gold"}]


@query("h4_h21_further_blocks")
def further_blocks(spark, folder):
    frame = signal_frame(spark, folder)
    proxy = S.quote_bars(spark, folder).filter("symbol = 'click'").select("time", c("high").alias("smt_gold_high"), c("low").alias("smt_gold_low"))
    out = H.evaluate_blocks(frame.join(proxy, "time", "left"), _OTHER)
    return out.groupBy("symbol").agg(*[F.sum(f"b{i}_{s}").alias(f"{b['name']}_{i}_{s}") for i, b in enumerate(_OTHER) for s in ("long", "short")])


_STEPS = "last_value({} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx)"
_MORE_SQL = f"""w AS (SELECT *, CASE WHEN bar_idx >= 2 AND lag(high, 1) OVER o = max(high) OVER s2 THEN lag(high, 1) OVER o END AS sh11, CASE WHEN bar_idx >= 2 AND lag(low, 1) OVER o = min(low) OVER s2 THEN lag(low, 1) OVER o END AS sl11,
  CASE WHEN bar_idx >= 5 AND lag(high, 2) OVER o = max(high) OVER s5 THEN lag(high, 2) OVER o END AS sh32, CASE WHEN bar_idx >= 5 AND lag(low, 2) OVER o = min(low) OVER s5 THEN lag(low, 2) OVER o END AS sl32,
  {", ".join(f"max(CASE WHEN hour(time) >= {a} AND hour(time) < {b} THEN high END) OVER dd AS h{a}_{b}, min(CASE WHEN hour(time) >= {a} AND hour(time) < {b} THEN low END) OVER dd AS l{a}_{b}" for a, b in ((6, 10), (12, 15), (0, 4)))}
  FROM k WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx), s2 AS (PARTITION BY symbol ORDER BY bar_idx ROWS 2 PRECEDING), s5 AS (PARTITION BY symbol ORDER BY bar_idx ROWS 5 PRECEDING), dd AS (PARTITION BY symbol, d)),
u AS (SELECT *, {_STEPS.format("sh11")} AS ih, {_STEPS.format("sl11")} AS il, {_STEPS.format("sh32")} AS mh, {_STEPS.format("sl32")} AS ml FROM w)"""
_sweep = lambda a, b: (f"hour(time) >= {b} AND low < l{a}_{b} AND close > l{a}_{b}", f"hour(time) >= {b} AND high > h{a}_{b} AND close < h{a}_{b}")
_MORE = [
    ({"name": "internal_structure_break"}, "close > ih AND c1 <= ih", "close < il AND c1 >= il"), ({"name": "premium_discount"}, "close <= (mh + ml) / 2", "close >= (mh + ml) / 2"),
    ({"name": "london_sweep"}, *_sweep(6, 10)), ({"name": "ny_sweep"}, *_sweep(12, 15)), ({"name": "session_liquidity", "range_end_utc": 4}, *_sweep(0, 4)),
    ({"name": "volatility_regime", "mode": "high_vol_kill", "max_rng_atr": 1.2}, "rng_atr <= 1.2", "rng_atr <= 1.2"), ({"name": "volatility_regime"}, "rng_atr >= 1", "rng_atr >= 1")]


@query("h4_h6_h8_h21_blocks", f"""{_FR}, {_MORE_SQL} SELECT symbol, time, {", ".join(f"{_flag(long)} AS b{i}_long, {_flag(short)} AS b{i}_short" for i, (_, long, short) in enumerate(_MORE))} FROM u""")
def more_blocks(spark, folder):
    out = H.evaluate_blocks(signal_frame(spark, folder), [block for block, _, _ in _MORE])
    return rounded(out.select("symbol", "time", *[f"b{i}_{s}" for i in range(len(_MORE)) for s in ("long", "short")]))


@query("h26_h28_block_combination", f"""
{_FR}, kk AS (SELECT * REPLACE (coalesce(last_value(nullif(atr14, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx), 1.0) AS atr14) FROM k), v AS (SELECT *, {_flag('close > lsh AND c1 <= lsh')} + {_flag('rsi14 > 50 AND low <= ema20 + 0.5 * atr14 AND close > ema20')} + {_flag('low > h2')} AS lv, {_flag('close < lsl AND c1 >= lsl')} + {_flag('high >= ema20 - 0.5 * atr14 AND close < ema20 AND rsi14 < 50')} + {_flag('high < l2')} AS sv FROM kk),
g AS (SELECT *, CASE WHEN sv >= 1 THEN -1 WHEN lv >= 1 THEN 1 ELSE 0 END AS dir, least(greatest(CASE WHEN sv >= 1 THEN abs(lsh - close) WHEN lv >= 1 THEN abs(close - lsl) END, atr14 * 0.5), 3 * atr14) AS st FROM v)
SELECT symbol, time, CAST(dir AS BIGINT) AS signal_direction, round(CASE WHEN dir = 0 THEN 1.5 * atr14 WHEN CASE WHEN dir < 0 THEN lsh ELSE lsl END IS NOT NULL THEN st END, 6) AS stop_distance FROM g""")
def combination(spark, folder):
    spec = {"rule_blocks": [{"name": "market_structure_shift"}, {"name": "trend_pullback"}, {"name": "fvg", "mode": "new"}], "block_logic": "vote", "min_block_votes": 1,
            "stop_mode": "structure", "atr_stop": 1.5, "reward_risk": 2.0}
    out = H.grammar_signals(signal_frame(spark, folder), spec)
    return rounded(out.select("symbol", "time", "signal_direction", "stop_distance"))


_R = {"reward_risk": 1.5, "max_hold_bars": 24, "atr_stop": 1.0}
_FAMILIES = {
    "time_series_breakout": ({"channel_bars": 24, "atr_stop": 1.0, "atr_trail": 2.0, "max_hold_bars": 48}, "close > ph AND h1_trend > 0 AND h4_trend > 0", "close < pl AND h1_trend < 0 AND h4_trend < 0", None),
    "trend_pullback": ({**_R, "ema_length": 20, "pullback_atr": 1.0, "rsi_trigger": 50}, "low <= ema20 + atr14 AND close > ema20 AND rsi1 <= 50 AND rsi14 > 50 AND h1_trend > 0 AND h4_trend > 0",
                       "high >= ema20 - atr14 AND close < ema20 AND rsi1 >= 50 AND rsi14 < 50 AND h1_trend < 0 AND h4_trend < 0", None),
    "liquidity_sweep_reclaim": ({**_R, "sweep_lookback": 24, "penetration_atr": 0.05, "reclaim_buffer_atr": 0.0, "wick_reject_min": 0.1, "close_location_min": 0.2, "context_filter": "none"},
                                "low < pl - 0.05 * atr14 AND close > pl AND lwk_pct >= 0.1 AND (close - low) / reach >= 0.2", "high > ph + 0.05 * atr14 AND close < ph AND uwk_pct >= 0.1 AND (high - close) / reach >= 0.2", None),
    "failed_breakout_reversal": ({**_R, "channel_bars": 24, "break_atr": 0.0, "close_back_atr": 0.0}, "low < pl AND close > pl AND close > open", "high > ph AND close < ph AND open > close", None),
    "prior_day_level_continuation": ({**_R, "break_buffer_atr": 0.1, "context_filter": "none"}, "close > pdh + 0.1 * atr14 AND c1 <= pdh + 0.1 * atr14", "close < pdl - 0.1 * atr14 AND c1 >= pdl - 0.1 * atr14", "side"),
    "volatility_spike_reversal": ({**_R, "spike_range_atr": 1.0, "body_min": 0.3, "rsi_extreme": 50}, "rng_atr >= 1 AND body_pct >= 0.3 AND close < open AND rsi14 <= 50", "rng_atr >= 1 AND body_pct >= 0.3 AND close > open AND rsi14 >= 50", None),
    "opening_range_continuation_reversal": ({**_R, "range_start_utc": 0, "range_end_utc": 6, "session_start_utc": 6, "session_end_utc": 22, "break_buffer_atr": 0.0, "opening_range_mode": "continuation", "context_filter": "none"},
                                            "hour(time) BETWEEN 6 AND 21 AND close > r6h AND c1 <= r6h", "hour(time) BETWEEN 6 AND 21 AND close < r6l AND c1 >= r6l", "either"),
    "session_range_breakout": ({"range_start_utc": 0, "range_end_utc": 6, "session_start_utc": 6, "session_end_utc": 22, "atr_stop": 1.0, "atr_trail": 1.0, "max_hold_bars": 24},
                               "hour(time) BETWEEN 6 AND 21 AND close > r6h AND c1 <= r6h AND h1_trend > 0 AND h4_trend > 0", "FALSE", "side"),
    "trend_day_pullback": ({**_R, "ema_length": 20, "trend_open_atr": 0.1, "pullback_atr": 1.0, "rsi_trigger": 50}, "h1_trend > 0 AND h4_trend > 0 AND close > dopen + 0.1 * atr14 AND low <= ema20 + atr14 AND close > ema20 AND rsi1 <= 50 AND rsi14 > 50 AND sharpe >= -999",
                           "h1_trend < 0 AND h4_trend < 0 AND close < dopen - 0.1 * atr14 AND high >= ema20 - atr14 AND close < ema20 AND rsi1 >= 50 AND rsi14 < 50", None),
    "day_time_regime_filter": ({**_R, "weekdays": "0,2,4", "regime_mode": "trend", "momentum_bars": 2, "momentum_atr": 0.2, "signal_mode": "momentum", "context_filter": "avoid_h4_opposite"},
                               "isodow(time) IN (1, 3, 5) AND bar_idx % 5 IN (0, 1) AND close > c2 + 0.2 * atr14 AND NOT h4_trend < 0", "isodow(time) IN (1, 3, 5) AND bar_idx % 5 IN (0, 1) AND close < c2 - 0.2 * atr14 AND NOT h4_trend > 0", None),
    "inside_bar_expansion": ({**_R, "break_buffer_atr": 0.0, "volume_ratio": 0.5, "context_filter": "none"}, "in1 > 0 AND vol_ratio >= 0.5 AND close > h2", "in1 > 0 AND vol_ratio >= 0.5 AND close < l2", None),
}


def _family_sql(name: str, long: str, short: str, once: str | None) -> str:
    l, s = f"coalesce({long}, FALSE)", f"coalesce({short}, FALSE)"
    if once == "side":
        l, s = [f"{x} AND sum(CAST({x} AS INTEGER)) OVER (PARTITION BY symbol, d ORDER BY time) = 1" for x in (l, s)]
    elif once == "either":
        first = f"sum(CAST({l} OR {s} AS INTEGER)) OVER (PARTITION BY symbol, d ORDER BY time) = 1"
        l, s = f"{l} AND {first}", f"{s} AND {first}"
    return f"SELECT '{name}' AS strategy_id, symbol, time, hour(time) AS hr, body_pct, atr14, CASE WHEN {s} THEN -1 WHEN {l} THEN 1 ELSE 0 END AS dir FROM k"


@query("h30_h42_signal_families", f"{_FR} SELECT strategy_id, symbol, time, CAST(dir AS BIGINT) AS signal_direction, round(atr14, 6) AS stop_distance FROM (" + " UNION ALL ".join(
    _family_sql(n, l, s, o) for n, (_, l, s, o) in _FAMILIES.items()) + ") WHERE dir <> 0 AND (strategy_id NOT IN ('opening_range_continuation_reversal', 'session_range_breakout') OR hr BETWEEN 6 AND 21)")
def families(spark, folder):
    out = G.signals(signal_frame(spark, folder), [(n, n, p) for n, (p, _, _, _) in _FAMILIES.items()])
    return rounded(out.select("strategy_id", "symbol", "time", "signal_direction", "stop_distance"))


@query("h43_common_signal_filters", f"{_FR} SELECT symbol, time, CAST(1 AS BIGINT) AS signal_direction FROM k WHERE low < pl AND close > pl AND close > open AND hour(time) BETWEEN 8 AND 19 AND body_pct >= 0.3 AND (close - low) / reach >= 0.5")
def common_filters(spark, folder):
    p = {**_R, "channel_bars": 24, "break_atr": 0.0, "close_back_atr": 0.0, "direction_mode": "long_only", "session_start_utc": 8, "session_end_utc": 20, "breakout_body_min": 0.3, "breakout_close_location_min": 0.5}
    return rounded(G.signals(signal_frame(spark, folder), [("x", "failed_breakout_reversal", p)]).select("symbol", "time", "signal_direction"))


@query("h33_h34_h43_quantile_families")
def quantile_families(spark, folder):
    """Squeeze breakout, mean reversion, and the four-hour volatility filter."""
    frame = signal_frame(spark, folder)
    slow = S.quote_bars(spark, folder, "h4").withColumn("atr_pct", (c("high") - c("low")) / c("close"))
    frame = join_previous_completed(frame, G.h4_volatility_median(slow, 96, 32, 4), ["h4_atr_median"], "m").withColumnRenamed("m_h4_atr_median", "h4_atr_median")
    out = G.signals(frame, [
        ("squeeze", "volatility_expansion", {**_R, "lookback": 10, "squeeze_quantile": 0.5, "volume_ratio": 0.5, "volatility_filter": "h4_above_60d_median"}),
        ("revert", "regime_mean_reversion", {**_R, "z_length": 20, "z_entry": 1.0, "rsi_extreme": 50.0})])
    return rounded(out.select("strategy_id", "symbol", "time", "signal_direction", "stop_distance", "signal_target_price"))


@query("h43_volatility_on_execution_bars", f"""WITH {sql.QUOTES}, {sql.quote_bars('4 hours', 'slow')}, p AS (SELECT symbol, time, lag((high - low) / close) OVER (PARTITION BY symbol ORDER BY time) AS a FROM slow),
j AS (SELECT b.symbol, b.time, b.bar_idx, b.close, b.open, p.a FROM bars b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.time >= p.time),
m AS (SELECT *, CASE WHEN count(a) OVER w >= 480 THEN quantile_cont(a, 0.5) OVER w END AS med FROM j WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 1439 PRECEDING))
SELECT symbol, time, round(med, 6) AS h4_atr_median, coalesce(a > med, FALSE) AS open_for_signals FROM m""")
def volatility_on_execution_bars(spark, folder):
    """The four-hour filter with its median over sixty days of the hourly bars that carry the signals."""
    slow = S.quote_bars(spark, folder, "h4").withColumn("atr_pct", (c("high") - c("low")) / c("close"))
    frame = join_previous_completed(S.quote_bars(spark, folder), slow, ["atr_pct"], "h4")
    out = G.volatility_median(frame, per_day=24)
    return rounded(out.select("symbol", "time", "h4_atr_median", F.coalesce(c("h4_atr_pct") > c("h4_atr_median"), F.lit(False)).alias("open_for_signals")))


@query("h44_h45_box_signal_and_side", f"""{_FR} SELECT symbol, time, CAST(CASE WHEN rsi14 >= 50 THEN 1 ELSE -1 END AS BIGINT) AS side FROM k
  WHERE session IN (1, 2) AND rsi14 BETWEEN 30 AND 70 AND body_pct BETWEEN 0.2 AND 1""")
def box_signal(spark, folder):
    frame = signal_frame(spark, folder)
    hit = frame.filter(G.box_signal({"rsi14": (30.0, 70.0), "body_pct": (0.2, 1.0)}, [1, 2]))
    return rounded(hit.select("symbol", "time", G.discriminated_side("rsi14", 50.0).alias("side")))
