"""Queries for alignment, market structure, calendar and context columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import align as A
from tickloom.operators import bars as B
from tickloom.operators import features as D
from tickloom.operators import structure as E
from tickloom.operators.scan import ema, exp_smooth, with_position
from tickloom.plans import sql, standins as S
from tickloom.plans.outcome_queries import CANDLES, candles
from tickloom.plans.registry import query, r, rounded

c = F.col

_H1_H4 = f"{sql.TICKS}, {sql.quote_bars()}, {sql.quote_bars('4 hours', 'slow')}"


@query("g1_previous_completed_bar", f"""
WITH {_H1_H4}, shifted AS (SELECT symbol, time, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS pc, lag(high) OVER (PARTITION BY symbol ORDER BY time) AS ph FROM slow)
SELECT b.symbol, b.time, round(pc, 6) AS h4_close, round(ph, 6) AS h4_high FROM bars b ASOF LEFT JOIN shifted s ON b.symbol = s.symbol AND b.time >= s.time""")
def previous_completed(spark, folder):
    out = A.join_previous_completed(S.quote_bars(spark, folder), S.quote_bars(spark, folder, "h4"), ["close", "high"], "h4")
    return rounded(out.select("symbol", "time", "h4_close", "h4_high"))


@query("g2_by_close_time", f"""
WITH {_H1_H4}, av AS (SELECT symbol, time + INTERVAL 4 HOUR AS time, close, low FROM slow)
SELECT b.symbol, b.time, round(s.close, 6) AS h4_close, round(s.low, 6) AS h4_low FROM bars b ASOF LEFT JOIN av s ON b.symbol = s.symbol AND b.time >= s.time""")
def by_close_time(spark, folder):
    out = A.join_by_close_time(S.quote_bars(spark, folder), S.quote_bars(spark, folder, "h4"), ["close", "low"], "h4", "h4")
    return rounded(out.select("symbol", "time", "h4_close", "h4_low"))


@query("g3_first_quote_after_close", f"""
WITH {sql.QUOTES}, d AS (SELECT symbol, time, time + INTERVAL 1 HOUR AS decision_time FROM bars)
SELECT d.symbol, d.time, t.time AS fill_time, round(t.bid, 6) AS fill_bid, round(t.ask, 6) AS fill_ask
FROM d ASOF LEFT JOIN ticks t ON d.symbol = t.symbol AND d.decision_time <= t.time""")
def first_quote(spark, folder):
    out = A.first_quote_after(S.quote_bars(spark, folder), S.ticks(spark, folder), "h1")
    return rounded(out.select("symbol", "time", "fill_time", "fill_bid", "fill_ask"))


@query("g4_exact_then_fill", f"""
WITH {sql.QUOTES}, other AS (SELECT time, close FROM bars WHERE symbol = 'click'),
j AS (SELECT b.symbol, b.time, o.close AS x FROM bars b LEFT JOIN other o USING (time))
SELECT symbol, time, round(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time), 6) AS click_close FROM j""")
def exact_fill(spark, folder):
    bars = S.quote_bars(spark, folder)
    out = A.join_exact_then_fill(bars, bars.filter("symbol = 'click'"), ["close"], "click")
    return rounded(out.select("symbol", "time", "click_close"))


@query("g6_equal_time_join", f"""
WITH {sql.QUOTES} SELECT a.time, round(a.close, 6) AS view_close, round(b.close, 6) AS click_close FROM bars a JOIN bars b USING (time)
WHERE a.symbol = 'view' AND b.symbol = 'click'""")
def equal_time(spark, folder):
    bars = S.quote_bars(spark, folder)
    left = bars.filter("symbol = 'view'").select("time", F.col("close").alias("view_close"))
    right = bars.filter("symbol = 'click'").select("time", F.col("close").alias("click_close"))
    return rounded(left.join(right, "time"))


@query("g7_signals_on_bars", f"""
WITH {sql.QUOTES}, s AS (SELECT symbol, time, CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM bars WHERE high - low > 20)
SELECT b.symbol, b.time, CAST(coalesce(s.side, 0) AS BIGINT) AS signal_direction FROM bars b LEFT JOIN s USING (symbol, time)""")
def signals_on_bars(spark, folder):
    bars = S.quote_bars(spark, folder)
    signals = bars.filter("high - low > 20").withColumn("signal_direction", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))
    return rounded(A.attach_signals(bars, signals, ["signal_direction"]).select("symbol", "time", "signal_direction"))


@query("g8_daily_levels", f"""
WITH {sql.QUOTES}, d AS (SELECT symbol, CAST(time AS DATE) AS d, max(high) AS h, min(low) AS l, max(CASE WHEN hour(time) < 6 THEN high END) AS rh,
  min(CASE WHEN hour(time) < 6 THEN low END) AS rl, arg_min(open, time) AS o FROM bars GROUP BY 1, 2),
p AS (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY d) AS ph, lag(l) OVER (PARTITION BY symbol ORDER BY d) AS pl FROM d)
SELECT b.symbol, b.time, round(ph, 6) AS prev_day_high, round(pl, 6) AS prev_day_low, round(rh, 6) AS range_high, round(rl, 6) AS range_low, round(o, 6) AS day_open
FROM bars b JOIN p ON p.symbol = b.symbol AND p.d = CAST(b.time AS DATE)""")
def daily_levels(spark, folder):
    out = A.with_daily_levels(S.quote_bars(spark, folder), {
        "range_high": A.session_range("high", 0, 6), "range_low": A.session_range("low", 0, 6), "day_open": F.min_by("open", "time")})
    return rounded(out.select("symbol", "time", "prev_day_high", "prev_day_low", "range_high", "range_low", "day_open"))


@query("g10_trades_in_rolling_windows", f"""
WITH {sql.LEDGER}, s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-06-01', INTERVAL 7 DAY)) AS DATE) AS start_day)
SELECT s.start_day, l.strategy_id, count(*) AS trades, round(sum(net_pnl), 2) AS net FROM s JOIN ledger l
  ON l.entry_time >= s.start_day AND l.entry_time < s.start_day + INTERVAL 30 DAY GROUP BY 1, 2""")
def rolling_windows(spark, folder):
    starts = spark.sql("SELECT explode(sequence(DATE'1996-01-01', DATE'2001-06-01', INTERVAL 7 DAYS)) AS start_day")
    paired = A.windows_of(S.ledger(spark, folder), starts, "entry_time", 30)
    return rounded(paired.groupBy("start_day", "strategy_id").agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net")), 2)


@query("g12_sessions_semi_join", f"""
WITH {sql.QUOTES} SELECT symbol, count(*) AS bars, round(avg(close), 6) AS mean_close FROM bars WHERE hour(time) BETWEEN 7 AND 16 GROUP BY 1""")
def sessions_semi(spark, folder):
    allowed = spark.createDataFrame([(1,), (2,)], "session int")
    tagged = S.quote_bars(spark, folder).withColumn("session", D.session_id(F.col("time")))
    return rounded(tagged.join(allowed, "session", "left_semi").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.avg("close").alias("mean_close")))


_SWING = """sw AS (SELECT *, CASE WHEN bar_idx >= 10 AND lag(high, 5) OVER o >= max(high) OVER f THEN lag(high, 5) OVER o END AS sh,
  CASE WHEN bar_idx >= 10 AND lag(low, 5) OVER o <= min(low) OVER f THEN lag(low, 5) OVER o END AS sl,
  lag(high) OVER o AS h1, lead(low) OVER o AS nl, lag(low) OVER o AS l1, lead(high) OVER o AS nh, lag(close) OVER o AS c1,
  min(low) OVER p AS fl, max(high) OVER p AS ce
  FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY time), f AS (PARTITION BY symbol ORDER BY time ROWS 10 PRECEDING),
  p AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, last_value(sh IGNORE NULLS) OVER o AS swing_high_level, last_value(sl IGNORE NULLS) OVER o AS swing_low_level
  FROM sw WINDOW o AS (PARTITION BY symbol ORDER BY time))"""
_STRUCT_COLUMNS = ["swing_high_level", "swing_low_level", "dist_to_swing_high", "dist_to_swing_low", "bos_up", "bos_down", "fvg_up", "fvg_down",
                   "fvg_size", "wick_rejection", "liquidity_sweep", "swing_high_flag", "swing_low_flag"]
_b = lambda cond: f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END::DOUBLE"


@query("e1_e5_market_structure", f"""
WITH {sql.QUOTES}, {_SWING}
SELECT symbol, time, round(swing_high_level, 6) AS swing_high_level, round(swing_low_level, 6) AS swing_low_level,
  round((swing_high_level - close) / (close + 1e-9), 6) AS dist_to_swing_high, round((close - swing_low_level) / (close + 1e-9), 6) AS dist_to_swing_low,
  {_b('close > swing_high_level AND c1 <= lag(swing_high_level) OVER o')} AS bos_up, {_b('close < swing_low_level AND c1 >= lag(swing_low_level) OVER o')} AS bos_down,
  {_b('nl > h1')} AS fvg_up, {_b('nh < l1')} AS fvg_down,
  round(CASE WHEN nl > h1 THEN nl - h1 WHEN nh < l1 THEN nh - l1 ELSE 0 END / (close + 1e-9), 6) AS fvg_size,
  CASE WHEN least(open, close) - low >= 2 * (abs(close - open) + 1e-9) AND NOT high - greatest(open, close) >= 2 * (abs(close - open) + 1e-9) THEN 1.0
       WHEN high - greatest(open, close) >= 2 * (abs(close - open) + 1e-9) AND NOT least(open, close) - low >= 2 * (abs(close - open) + 1e-9) THEN -1.0 ELSE 0.0 END::DOUBLE AS wick_rejection,
  CASE WHEN low < fl AND close > fl THEN 1.0 WHEN high > ce AND close < ce THEN -1.0 ELSE 0.0 END::DOUBLE AS liquidity_sweep,
  {_b('sh IS NOT NULL')} AS swing_high_flag, {_b('sl IS NOT NULL')} AS swing_low_flag
FROM lv WINDOW o AS (PARTITION BY symbol ORDER BY time)""")
def market_structure(spark, folder):
    return rounded(E.market_structure(S.quote_bars(spark, folder)).select("symbol", "time", *_STRUCT_COLUMNS))


_SHIFT = "((hour(time) + 2) % 24)"
_SESS2 = f"CASE WHEN {_SHIFT} BETWEEN 2 AND 6 THEN 0 WHEN {_SHIFT} BETWEEN 7 AND 11 THEN 1 WHEN {_SHIFT} BETWEEN 12 AND 16 THEN 2 WHEN {_SHIFT} BETWEEN 17 AND 20 THEN 3 ELSE 4 END"


@query("e6_calendar_features", f"""
WITH {sql.QUOTES}, s AS (SELECT *, {_SESS2} AS session FROM bars),
f AS (SELECT *, CAST(session <> coalesce(lag(session) OVER (PARTITION BY symbol ORDER BY time), -1) AS INTEGER) AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY time) AS blk FROM f)
SELECT symbol, time, CAST({_SHIFT} AS BIGINT) AS hour_of_day, CAST(isodow(time) - 1 AS BIGINT) AS day_of_week, CAST(session AS BIGINT) AS session,
  {_b('session = 0')} AS sess_asian, {_b('session = 3')} AS sess_overlap,
  round(epoch(time - min(time) OVER (PARTITION BY symbol, blk)) / 60, 6) AS minutes_since_session_open,
  round(sin(2 * pi() * {_SHIFT} / 24), 6) AS hour_sin, round(cos(2 * pi() * (isodow(time) - 1) / 7), 6) AS dow_cos FROM g""")
def calendar(spark, folder):
    return rounded(E.calendar_features(S.quote_bars(spark, folder)).select(
        "symbol", "time", "hour_of_day", "day_of_week", "session", "sess_asian", "sess_overlap", "minutes_since_session_open", "hour_sin", "dow_cos"))


@query("e7_e8_rolling_normalise", f"""
WITH {sql.SUPPLIERS}, w AS (SELECT *, count(*) OVER f AS n, avg(close) OVER f AS m, stddev_pop(close) OVER f AS s, list(volume) OVER f AS vs
  FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS 99 PRECEDING))
SELECT symbol, time, CASE WHEN n >= 50 THEN round((close - m) / (s + 1e-9), 6) END AS close_z,
  CASE WHEN n >= 50 THEN round((2 * len(list_filter(vs, lambda x: x < volume)) + len(list_filter(vs, lambda x: x = volume))) / n - 1, 6) END AS volume_rank FROM w""")
def normalise(spark, folder):
    bars = S.daily_bars(spark, folder, "l_suppkey")
    from tickloom.operators.scan import over_chunks
    out = over_chunks(bars.select("symbol", "bar_idx", "time", "close", "volume"), before=99, quantiles={**E.rolling_zscore(["close"]), **E.rolling_rank(["volume"])})
    return rounded(out.select("symbol", "time", "close_z", "volume_rank"))


_XA = """steps AS (SELECT symbol, external, time, close, price, close / lag(close) OVER o - 1 AS r0, price / lag(price) OVER o - 1 AS ret1,
    price / lag(price, 4) OVER o - 1 AS ret4, price / lag(price, 12) OVER o - 1 AS mom, close / (price + 1e-9) AS ratio
  FROM al WINDOW o AS (PARTITION BY symbol, external ORDER BY time))
SELECT symbol, external, time, round(ret1, 6) AS ret1, round(ret4, 6) AS ret4, round(r0 - ret1, 6) AS rel_ret1,
  CASE WHEN count(mom) OVER a >= 25 THEN round((mom - avg(mom) OVER a) / (stddev_pop(mom) OVER a + 1e-9), 4) END AS mom_z,
  CASE WHEN count(ratio) OVER b >= 50 THEN round((ratio - avg(ratio) OVER b) / (stddev_pop(ratio) OVER b + 1e-9), 4) END AS ratio_z
FROM steps WINDOW a AS (PARTITION BY symbol, external ORDER BY time ROWS 99 PRECEDING), b AS (PARTITION BY symbol, external ORDER BY time ROWS 199 PRECEDING)"""


@query("e9_cross_asset_as_of", f"""
WITH {sql.QUOTES}, base AS (SELECT b.*, s.symbol AS external FROM bars b, (SELECT DISTINCT symbol FROM bars) s WHERE s.symbol <> b.symbol),
al AS (SELECT b.symbol, b.external, b.time, b.close, e.close AS price FROM base b ASOF LEFT JOIN bars e ON e.symbol = b.external AND b.time >= e.time), {_XA}""")
def cross_asset(spark, folder):
    bars = S.quote_bars(spark, folder)
    out = E.cross_asset(bars, bars).withColumns({n: F.round(n, 4) for n in ("mom_z", "ratio_z")})
    return rounded(out.select("symbol", "external", "time", "ret1", "ret4", "rel_ret1", "mom_z", "ratio_z"))


@query("e9_cross_asset_exact", f"""
WITH {sql.QUOTES}, al AS (SELECT b.symbol, 'click' AS external, b.time, b.close, last_value(e.close IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.time) AS price
  FROM bars b LEFT JOIN bars e ON e.symbol = 'click' AND e.time = b.time WHERE b.symbol <> 'click'), {_XA}""")
def cross_asset_exact(spark, folder):
    bars = S.quote_bars(spark, folder)
    pairs = bars.filter("symbol <> 'click'").select("symbol").distinct().withColumn("external", F.lit("click"))
    out = E.cross_asset(bars, bars, pairs, exact=True).withColumns({n: F.round(n, 4) for n in ("mom_z", "ratio_z")})
    return rounded(out.select("symbol", "external", "time", "ret1", "ret4", "rel_ret1", "mom_z", "ratio_z"))


@query("e10_extended_feature_blocks")
def extended(spark, folder):
    frame = D.build_features(S.quote_bars(spark, folder))
    out = E.extended_features(frame, ["time", "structure", "normalize"])
    return rounded(out.select("symbol", "time", "session", "minutes_since_session_open", "bos_up", "bos_down", *[f"{n}_z" for n in E.NORMALIZED_COLUMNS]))


def _series(spark, folder):
    """Orders as four published series per status: index, positioning and gamma values."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("vix", "gvz", "cot", "gamma")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    base = S.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("symbol"), kind.alias("kind"), F.col("o_orderkey").alias("k"),
        (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS 20 HOURS 30 MINUTES") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 3600)).alias("release_time"),
        (F.col("o_totalprice") / 10_000).alias("value"), (F.col("o_totalprice") - 250_000).alias("spec_net"), (F.col("o_totalprice") - 250_000).alias("net_gamma"))
    one = base.groupBy("symbol", "kind", "release_time").agg(*[F.max_by(n, "k").alias(n) for n in ("value", "spec_net", "net_gamma")])
    return with_position(one, ["release_time"], ["symbol", "kind"], "release_time", 86_400 * 365, "ext_idx")


@query("e11_g5_external_context", """
WITH raw AS (SELECT o_orderstatus AS symbol, (['vix', 'gvz', 'cot', 'gamma'])[CAST(o_orderkey % 4 + 1 AS INTEGER)] AS kind,
  o_orderdate + INTERVAL '3 days 20 hours 30 minutes' + to_seconds(o_orderkey % 3600) AS release_time, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1, 2, 3),
s AS (SELECT symbol, kind, release_time, p / 10000 AS value, p - 250000 AS net, row_number() OVER o - 1 AS i,
  p / 10000 - first_value(p / 10000) OVER (PARTITION BY symbol, kind ORDER BY release_time ROWS 19 PRECEDING) AS slope,
  list(p) OVER (PARTITION BY symbol, kind ORDER BY release_time ROWS 155 PRECEDING) AS past, p FROM raw WINDOW o AS (PARTITION BY symbol, kind ORDER BY release_time)),
k AS (SELECT *, CASE WHEN i >= 51 THEN len(list_filter(past, lambda x: x <= p)) / len(past) END AS rank FROM s),
pts AS (SELECT DISTINCT o_orderstatus AS symbol, CAST(o_orderdate AS TIMESTAMP) AS time FROM orders)
SELECT p.symbol, p.time, round(v.value, 6) AS vix_value, CASE WHEN v.value >= 25 THEN 'stress' WHEN v.slope > 0 THEN 'expanding' WHEN v.value IS NOT NULL THEN 'calm' END AS vix_regime,
  round(c.net, 6) AS cot_spec_net, round(c.rank, 6) AS cot_rank, CASE WHEN c.rank >= 0.85 THEN 'crowded_long' WHEN c.rank <= 0.15 THEN 'crowded_short' WHEN c.rank IS NOT NULL THEN 'neutral' END AS cot_regime,
  CASE WHEN g.net > 0 THEN 'positive' WHEN g.net IS NOT NULL THEN 'negative' END AS gamma_regime
FROM pts p ASOF LEFT JOIN (SELECT * FROM k WHERE kind = 'vix') v ON v.symbol = p.symbol AND p.time >= v.release_time
ASOF LEFT JOIN (SELECT * FROM k WHERE kind = 'cot') c ON c.symbol = p.symbol AND p.time >= c.release_time
ASOF LEFT JOIN (SELECT * FROM k WHERE kind = 'gamma') g ON g.symbol = p.symbol AND p.time >= g.release_time""")
def external_context(spark, folder):
    points = S.table(spark, folder, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("time")).distinct()
    out = E.external_context(points, _series(spark, folder))
    return rounded(out.select("symbol", "time", "vix_value", "vix_regime", "cot_spec_net", "cot_rank", "cot_regime", "gamma_regime"))


@query("b4_daily_bars_with_ema", f"""
WITH RECURSIVE {sql.daily_bars()}, e AS (SELECT symbol, bar_idx, close AS a, close AS b FROM bars WHERE bar_idx = 0 UNION ALL
  SELECT m.symbol, m.bar_idx, e.a + (m.close - e.a) * 2 / 51, e.b + (m.close - e.b) * 2 / 201 FROM e JOIN bars m ON m.symbol = e.symbol AND m.bar_idx = e.bar_idx + 1)
SELECT symbol, time, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY time) - 1, 6) AS ret, round((high - low) / close, 6) AS range_pct,
  round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_wick_pct, round(a, 4) AS ema50, round(b, 4) AS ema200 FROM bars JOIN e USING (symbol, bar_idx)""")
def daily_with_ema(spark, folder):
    return rounded(daily_frame(spark, folder).select("symbol", "time", "ret", "range_pct", "upper_wick_pct", F.round("ema50", 4).alias("ema50"), F.round("ema200", 4).alias("ema200")))


def daily_frame(spark, folder):
    from tickloom.operators.scan import over_chunks
    c = F.col
    bars = exp_smooth(S.daily_bars(spark, folder), {"ema50": ema("close", 50), "ema200": ema("close", 200)})
    reach = F.when(c("high") != c("low"), c("high") - c("low"))
    return over_chunks(bars, lambda w: {"ret": c("close") / F.lag("close").over(w) - 1}, before=1).withColumns({
        "range_pct": (c("high") - c("low")) / c("close"), "upper_wick_pct": (c("high") - F.greatest("open", "close")) / reach})


@query("e12_long_regime_summary", f"""
WITH RECURSIVE {sql.daily_bars()}, e AS (SELECT symbol, bar_idx, close AS a, close AS b FROM bars WHERE bar_idx = 0 UNION ALL
  SELECT m.symbol, m.bar_idx, e.a + (m.close - e.a) * 2 / 51, e.b + (m.close - e.b) * 2 / 201 FROM e JOIN bars m ON m.symbol = e.symbol AND m.bar_idx = e.bar_idx + 1),
d AS (SELECT *, (high - low) / close AS rg, lag(high) OVER o AS h1, lag(low) OVER o AS l1, coalesce(close / lag(close) OVER o - 1, 0) AS ret, lead(close) OVER o / close - 1 AS nxt,
  max(bar_idx) OVER (PARTITION BY symbol) - bar_idx AS age FROM bars JOIN e USING (symbol, bar_idx) WINDOW o AS (PARTITION BY symbol ORDER BY time)),
q AS (SELECT *, CASE WHEN count(rg) OVER w >= 30 THEN quantile_cont(rg, 0.8) OVER w END AS big FROM d WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 119 PRECEDING)),
n AS (SELECT symbol, quantile_cont(rg, 0.5) AS now FROM q WHERE age < 20 GROUP BY 1)
SELECT symbol, count(*) AS history_days, round(arg_max(close, bar_idx) / arg_min(close, bar_idx) FILTER (age < 260) - 1, 6) AS trend_return_1y,
  round(arg_max(a - b, bar_idx) / arg_max(close, bar_idx), 6) AS ema50_ema200_gap, round(avg(CAST(rg <= now AS INTEGER)) FILTER (age < 1260), 6) AS volatility_percentile,
  round(avg(CAST((high > h1 AND close > h1) OR (low < l1 AND close < l1) AS INTEGER)) FILTER (age < 260), 6) AS breakout_followthrough_rate,
  round(avg(CAST((high > h1 AND close < h1) OR (low < l1 AND close > l1) AS INTEGER)) FILTER (age < 260), 6) AS failed_breakout_rate,
  round(avg(CAST(coalesce(rg > big AND sign(nxt) = -sign(ret), FALSE) AS INTEGER)) FILTER (age < 260), 6) AS spike_reversal_rate
FROM q JOIN n USING (symbol) GROUP BY 1""")
def regime_summary(spark, folder):
    out = E.long_regime_summary(daily_frame(spark, folder), S.daily_bars(spark, folder))
    return rounded(out.select("symbol", "history_days", "trend_return_1y", "ema50_ema200_gap", "volatility_percentile", "breakout_followthrough_rate",
                              "failed_breakout_rate", "spike_reversal_rate"))


@query("d22_trend_score", f"""
{sql.smoothed(_H1_H4)}, s AS (SELECT symbol, time, lag(CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY time) AS t FROM slow)
SELECT f.symbol, f.time, CAST(trend = 1 AS BIGINT) + coalesce(CAST(s.t = 1 AS BIGINT), 0) AS mtf_bull_score, CAST(trend = -1 AS BIGINT) + coalesce(CAST(s.t = -1 AS BIGINT), 0) AS mtf_bear_score
FROM frame f ASOF LEFT JOIN s ON s.symbol = f.symbol AND f.time >= s.time""")
def trend_score(spark, folder):
    slow = S.quote_bars(spark, folder, "h4").withColumn("trend", F.signum(F.col("close") - F.col("open")).cast("int"))
    frame = A.join_previous_completed(D.base_features(S.quote_bars(spark, folder)), slow, ["trend"], "h4")
    return rounded(D.trend_score(frame, ["h4"]).select("symbol", "time", "mtf_bull_score", "mtf_bear_score"))


@query("d17_htf_divergence", f"""
{sql.smoothed(_H1_H4)}, s AS (SELECT symbol, time, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS x FROM slow),
j AS (SELECT f.symbol, f.time, rsi14, s.x FROM frame f ASOF LEFT JOIN s ON s.symbol = f.symbol AND f.time >= s.time),
d AS (SELECT *, rsi14 - lag(rsi14, 5) OVER o AS a, coalesce(x - lag(x, 3) OVER o, 0) AS b FROM j WINDOW o AS (PARTITION BY symbol ORDER BY time))
SELECT symbol, time, CASE WHEN a > 2 AND b < -1 THEN 1.0 WHEN a < -2 AND b > 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS htf_div FROM d""")
def htf_divergence(spark, folder):
    from tickloom.operators.scan import over_chunks
    frame = A.join_previous_completed(D.base_features(S.quote_bars(spark, folder)), S.quote_bars(spark, folder, "h4"), ["close"], "h4")
    return rounded(over_chunks(frame, D.htf_divergence("h4_close"), before=5).select("symbol", "time", "htf_div"))


@query("d25_window_vectors")
def window_vectors(spark, folder):
    frame = D.trend_score(D.build_features(S.quote_bars(spark, folder)), [])
    out = D.encode_windows(frame)
    return out.select("symbol", "time", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_PAST = lambda name, k: f"lag({name}, {k}) OVER o"
_WINDOW_PARTS = [
    *[f"({_PAST('close', k)} - {_PAST('close', 5)}) / nullif({_PAST('close', 5)}, 0) * 100" for k in range(5, 0, -1)],
    *[f"coalesce({_PAST(n, k)}, 0)" for k in range(5, 0, -1) for n in ("body_pct", "uwk_pct", "lwk_pct")], *[_PAST("bull", k) for k in range(5, 0, -1)],
    "(" + " + ".join(f"{_PAST('rsi14', 5 - k)} * {(k - 2) / 10}" for k in range(5)) + ") / 100", "(" + " + ".join(f"{_PAST('atr14', 5 - k)} * {(k - 2) / 10}" for k in range(5)) + ") / (atr14 + 1e-9)",
    f"({_PAST('rsi14', 1)} - {_PAST('rsi14', 5)}) / 100", "bull", "rsi14 / 100", "(close - open) / (atr14 + 1e-9)", "atr14 / close", "sign(close - open)", "grp / 3",
    f"(close - {_PAST('close', 5)}) / nullif({_PAST('close', 5)} * 5, 0) * 100", "volume / 10", "body_pct", "grp / 4", "1 - bull", "uwk_pct"]


@query("d25_window_vectors_of_candles", f"""WITH {CANDLES}, f AS (SELECT *, CAST(volume % 100 AS DOUBLE) AS rsi14, high - low AS atr14 FROM bars), v AS (SELECT symbol, time, atr14, {" + ".join(_WINDOW_PARTS)} AS total FROM f WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx))
SELECT symbol, time, {len(_WINDOW_PARTS)}::BIGINT AS dims, round(total, 6) AS total FROM v WHERE atr14 <> 0 AND total IS NOT NULL""")
def candle_vectors(spark, folder):
    """Window vectors over candle columns that stand in for the indicators: size and sum of each vector."""
    frame = candles(spark, folder).withColumns({
        "rsi14": (c("volume") % 100).cast("double"), "atr14": c("high") - c("low"), "bb_expanding": c("bull"), "macd_hist": c("close") - c("open"), "bb_width": (c("high") - c("low")) / c("close"),
        "trend": F.signum(c("close") - c("open")), "mtf_bull_score": c("grp"), "vol_ratio": c("volume") / 10, "vol_body_conf": c("body_pct"), "regime": c("grp"), "vol_price_div": 1 - c("bull"), "prev_sess_bias": c("uwk_pct")})
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rounded(D.encode_windows(frame).select("symbol", "time", F.size("vector").alias("dims"), total.alias("total")))
