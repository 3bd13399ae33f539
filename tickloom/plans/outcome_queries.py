"""Queries for labels, rule boxes and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import labels as L
from tickloom.operators import outcomes as J
from tickloom.operators import rules as I
from tickloom.operators.metrics import rule_scores
from tickloom.operators.scan import asof_join, over_chunks
from tickloom.plans import sql, standins as S
from tickloom.plans.registry import query, r, rounded

c = F.col


def candles(spark, folder):
    """Supplier day bars with candle shares, the cheap feature table of the rule queries."""
    reach = F.when(c("high") != c("low"), c("high") - c("low"))
    return S.daily_bars(spark, folder, "l_suppkey").withColumns({
        "body_pct": F.abs(c("close") - c("open")) / reach, "uwk_pct": (c("high") - F.greatest("open", "close")) / reach,
        "lwk_pct": (F.least("open", "close") - c("low")) / reach, "bull": (c("close") >= c("open")).cast("int"), "grp": (c("bar_idx") % 7).cast("int")})


CANDLES = f"""{sql.daily_bars('l_suppkey', 'raw_bars')}, bars AS (SELECT *, abs(close - open) / nullif(high - low, 0) AS body_pct, (high - greatest(open, close)) / nullif(high - low, 0) AS uwk_pct,
  (least(open, close) - low) / nullif(high - low, 0) AS lwk_pct, CAST(close >= open AS INTEGER) AS bull, CAST(bar_idx % 7 AS INTEGER) AS grp FROM raw_bars)"""

RULES = [
    ("r1", "body_pct", 0.6, 1.0), ("r1", "bull", 1.0, 1.0), ("r2", "uwk_pct", 0.3, 1.0), ("r2", "volume", 20.0, 45.0),
    ("r3", "lwk_pct", 0.25, 0.9), ("r3", "body_pct", 0.1, 0.7), ("r3", "volume", 10.0, 90.0), ("r4", "volume", 1.0, 500.0), ("r5", "bull", 0.0, 0.0), ("r5", "uwk_pct", 0.0, 0.2)]
PARAMETERS = [("r1", "LONG", 0.3, 0.4), ("r2", "SHORT", 0.25, 0.3), ("r3", "LONG", 0.4, 0.6), ("r4", "SHORT", 0.5, 0.5), ("r5", "LONG", 0.2, 0.8)]
_RULE_SQL = """hits AS (SELECT 'r1' AS rule_id, * FROM bars WHERE body_pct BETWEEN 0.6 AND 1 AND bull = 1 UNION ALL SELECT 'r2', * FROM bars WHERE uwk_pct BETWEEN 0.3 AND 1 AND volume BETWEEN 20 AND 45
  UNION ALL SELECT 'r3', * FROM bars WHERE lwk_pct BETWEEN 0.25 AND 0.9 AND body_pct BETWEEN 0.1 AND 0.7 AND volume BETWEEN 10 AND 90 UNION ALL SELECT 'r4', * FROM bars WHERE volume BETWEEN 1 AND 500
  UNION ALL SELECT 'r5', * FROM bars WHERE bull = 0 AND uwk_pct BETWEEN 0 AND 0.2)"""
_PARAM_SQL = "params AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {x}::DOUBLE, {y}::DOUBLE)" for a, b, x, y in PARAMETERS) + ") v(rule_id, direction, sl, tp))"


def rule_tables(spark):
    return (spark.createDataFrame(RULES, "rule_id string, column string, lo double, hi double"),
            spark.createDataFrame(PARAMETERS, "rule_id string, direction string, sl_pct double, tp_pct double"))


# ---- labels ----

_O = "(PARTITION BY symbol ORDER BY time)"


@query("f1_f3_forward_returns", f"""
WITH {sql.SUPPLIERS}, x AS (SELECT *, close / lag(close) OVER {_O} - 1 AS one, 1 AS z FROM bars)
SELECT symbol, time, round(lead(close, 5) OVER {_O} / close - 1, 6) AS fwd_ret_5, round(lead(close, 5) OVER {_O} / close - 1 - 0.5 * (lead(volume, 5) OVER {_O} / volume - 1), 6) AS fwd_excess_5,
  round(lead(close, 5) OVER {_O} / close - 1 - 5 * CASE WHEN count(one) OVER p >= 20 THEN avg(one) OVER p END, 6) AS fwd_detrended_5
FROM x WINDOW p AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""")
def forward_returns(spark, folder):
    out = over_chunks(S.daily_bars(spark, folder, "l_suppkey"), L.one_bar_return, lambda w: {
        **L.forward_return(w, 5), **L.excess_over_benchmark(w, 5, "volume", 0.5), **L.excess_over_drift(w, 5, 100, 20)}, before=101, after=5)
    return rounded(out.select("symbol", "time", "fwd_ret_5", "fwd_excess_5", "fwd_detrended_5"))


def _barrier_sql(hold: int) -> str:
    return f"""t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {_O}), abs(low - lag(close) OVER {_O})) AS tr FROM bars),
a AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY time ROWS 13 PRECEDING) AS atr FROM t),
p AS (SELECT a.symbol, a.bar_idx, a.time, a.close AS e, a.atr, f.bar_idx - a.bar_idx AS k, f.close AS fc, CASE WHEN f.low <= a.close - 0.7 * a.atr THEN 1 END AS s, CASE WHEN f.high >= a.close + 1.0 * a.atr THEN 1 END AS g
  FROM a JOIN bars f ON f.symbol = a.symbol AND f.bar_idx BETWEEN a.bar_idx + 1 AND a.bar_idx + {hold}),
h AS (SELECT symbol, bar_idx, min(k) FILTER (s = 1) AS ks, min(k) FILTER (g = 1) AS kg, max(k) AS n, arg_max(fc, k) AS last FROM p GROUP BY 1, 2),
o AS (SELECT a.symbol, a.time, a.close AS e, a.atr, CASE WHEN ks IS NOT NULL AND ks <= coalesce(kg, 999999) THEN -1 WHEN kg IS NOT NULL THEN 1 ELSE 0 END AS label, ks, kg, coalesce(n, 0) AS n, coalesce(last, a.close) AS last
  FROM a LEFT JOIN h USING (symbol, bar_idx) WHERE a.atr > 0)"""


@query("f4_triple_barrier", f"""
WITH {sql.SUPPLIERS}, {_barrier_sql(6)}
SELECT symbol, time, CAST(label AS BIGINT) AS label, CASE label WHEN -1 THEN ks WHEN 1 THEN kg ELSE n END AS bars_to_hit,
  round(CASE label WHEN -1 THEN e - 0.7 * atr WHEN 1 THEN e + atr ELSE last END / e - 1, 6) AS ret, round(CASE label WHEN -1 THEN -1 WHEN 1 THEN 1 / 0.7 ELSE (last - e) / (0.7 * atr) END, 6) AS ret_r,
  label = 0 AND n < 6 AS truncated FROM o""")
def triple_barrier(spark, folder):
    out = L.triple_barrier(S.daily_bars(spark, folder, "l_suppkey"), 1.0, 0.7, 6).filter(c("ret_r").isNotNull())
    return rounded(out.select("symbol", "time", "label", "bars_to_hit", "ret", "ret_r", "truncated"))


_EXC = f"""x AS (SELECT b.*, lead(open) OVER {_O} AS en, max(high) OVER t AS h3, min(low) OVER t AS l3, max(high) OVER f AS hi, min(low) OVER f AS lo FROM (SELECT *, high - low AS atr14 FROM bars) b
  WINDOW t AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), f AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
m AS (SELECT *, CAST(h3 - en > en - l3 AS INTEGER) AS lg, CASE WHEN h3 - en > en - l3 THEN (hi - en) / en ELSE (en - lo) / en END AS mfe, CASE WHEN h3 - en > en - l3 THEN (en - lo) / en ELSE (hi - en) / en END AS mae
  FROM x WHERE en IS NOT NULL AND atr14 <> 0)"""


def _with_range(bars):
    return bars.withColumn("atr14", c("high") - c("low"))


@query("f5_f6_excursions", f"""
WITH {CANDLES}, {_EXC} SELECT symbol, time, CAST(lg AS BIGINT) AS fwd_long, round(mfe, 6) AS fwd_mfe, round(mae, 6) AS fwd_mae,
  round(CASE WHEN hi / close - 1 >= 1 - lo / close THEN hi / close - 1 ELSE -(1 - lo / close) END, 6) AS best_move FROM m""")
def excursions(spark, folder):
    bars = over_chunks(_with_range(candles(spark, folder)), lambda w: L.best_move(w, 10), after=10)
    out = L.excursions(bars, 10)
    return rounded(out.select("symbol", "time", "fwd_long", "fwd_mfe", "fwd_mae", c("fwd_best_move_10").alias("best_move")))


@query("f8_stop_target_sizes", f"""
WITH {CANDLES}, {_EXC} SELECT CAST(grp AS BIGINT) AS grp, count(*) AS n_samples, round(greatest(quantile_cont(mae, 0.7), 0.0002), 6) AS sl_pct, round(greatest(quantile_cont(mfe, 0.6), 0.0002), 6) AS tp_pct,
  round(avg(lg), 6) AS long_share, CASE WHEN avg(lg) >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS direction FROM m GROUP BY 1""")
def sizes(spark, folder):
    out = L.stop_target_sizes(L.excursions(_with_range(candles(spark, folder)), 10), "grp")
    return rounded(out.select("grp", "n_samples", "sl_pct", "tp_pct", "long_share", "direction"))


_RUNS = ", ".join(f"""x{h} AS (SELECT b.*, lead(open) OVER {_O} AS en, max(high) OVER t AS h3, min(low) OVER t AS l3, max(high) OVER f AS hi, min(low) OVER f AS lo, list({{'h': high, 'l': low}}) OVER f AS ah FROM (SELECT *, high - low AS atr14 FROM bars) b
  WINDOW t AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), f AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)),
y{h} AS (SELECT *, h3 - en > en - l3 AS lg FROM x{h} WHERE en IS NOT NULL AND en <> 0 AND atr14 <> 0),
z{h} AS (SELECT grp, CASE WHEN lg THEN (hi - en) / en ELSE (en - lo) / en END * close / (atr14 + 1e-9) >= 0.6 AND contains(array_to_string(list_transform(ah, lambda q: CASE WHEN CASE WHEN lg THEN q.h - en ELSE en - q.l END / (close + 1e-9) >= 0.3 * atr14 / close THEN '1' ELSE '0' END), ''), '1111') AS ok FROM y{h})""" for h in (5, 10, 20))


@query("f7_f9_horizon_scores", f"""WITH {CANDLES}, {_RUNS}, s AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, grp, count(*) AS n, avg(CAST(ok AS INTEGER)) AS share FROM z{h} GROUP BY 2" for h in (5, 10, 20))}),
v AS (SELECT horizon, sum(share * n) / sum(n) * 100 AS score FROM s WHERE n >= 10 GROUP BY 1)
SELECT CAST(horizon AS BIGINT) AS horizon, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 3) DESC, horizon) = 1 AS best FROM v""")
def horizons(spark, folder):
    return rounded(L.horizon_scores(_with_range(candles(spark, folder)), "grp", [5, 10, 20], exact_threshold=False))


# ---- rules ----

@query("g9_i4_match_rules", f"WITH {CANDLES}, {_RULE_SQL} SELECT rule_id, symbol, bar_idx, round(close, 8) AS close FROM hits")
def match(spark, folder):
    rules, _ = rule_tables(spark)
    return rounded(I.match_rules(candles(spark, folder), rules).select("rule_id", "symbol", "bar_idx", "close"), 8)


@query("g9_match_rules_by_cells", f"WITH {CANDLES}, {_RULE_SQL} SELECT rule_id, symbol, bar_idx, round(close, 8) AS close FROM hits")
def match_by_cells(spark, folder):
    rules, _ = rule_tables(spark)
    return rounded(I.match_rules(candles(spark, folder), rules, compile_limit=0).select("rule_id", "symbol", "bar_idx", "close"), 8)


def _many(n: int) -> str:
    """SQL of `n` boxes of three conditions, made from their number alone."""
    return f"""many AS (SELECT i, CAST(i AS VARCHAR) AS rule_id, (i * 37 % 100) / 100.0 AS b0, (i * 53 % 90) / 100.0 AS u0, i * 17 % 60 AS w0 FROM range({n}) t(i)),
hits AS (SELECT rule_id, symbol, bar_idx, close FROM bars JOIN many ON body_pct BETWEEN b0 AND b0 + 0.15 AND uwk_pct BETWEEN u0 AND u0 + 0.25 AND volume BETWEEN w0 AND w0 + 25)"""


def many_rules(spark, n):
    i = c("id")
    share = lambda step, size: (i * step % size) / 100.0
    sides = F.array(*[F.struct(F.lit(name).alias("column"), lo.cast("double").alias("lo"), (lo + width).cast("double").alias("hi")) for name, lo, width in (
        ("body_pct", share(37, 100), 0.15), ("uwk_pct", share(53, 90), 0.25), ("volume", i * 17 % 60, 25.0))])
    return spark.range(n).select(i.cast("string").alias("rule_id"), F.explode(sides).alias("s")).select("rule_id", "s.*")


for _n in (2000, 20_000):
    @query(f"g9_match_{_n}_rules", f"WITH {CANDLES}, {_many(_n)} SELECT rule_id, count(*) AS matched, CAST(sum(bar_idx) AS BIGINT) AS places, count(DISTINCT symbol) AS symbols FROM hits GROUP BY 1")
    def match_many(spark, folder, n=_n):
        """Thousands of boxes in one pass over the bars."""
        return I.match_rules(candles(spark, folder).select("symbol", "bar_idx", "close", "body_pct", "uwk_pct", "volume"), many_rules(spark, n)).groupBy("rule_id").agg(
            F.count(F.lit(1)).alias("matched"), F.sum("bar_idx").alias("places"), F.countDistinct("symbol").alias("symbols"))


@query("i1_column_ranges", f"""
WITH {CANDLES}, s AS (SELECT grp, unnest(['body_pct', 'uwk_pct', 'lwk_pct']) AS "column", unnest([body_pct, uwk_pct, lwk_pct]) AS v FROM bars)
SELECT CAST(grp AS BIGINT) AS grp, "column", round(quantile_cont(v, 0.05), 6) AS lo, round(quantile_cont(v, 0.95), 6) AS hi FROM s WHERE v IS NOT NULL GROUP BY 1, 2""")
def ranges(spark, folder):
    return rounded(I.column_ranges(candles(spark, folder), ["body_pct", "uwk_pct", "lwk_pct"], "grp"))


@query("i2_enumerated_boxes")
def boxes(spark, folder):
    found = I.column_ranges(candles(spark, folder), ["body_pct", "uwk_pct", "lwk_pct", "volume", "bull"])
    return rounded(I.enumerate_boxes(found, 200, least=2, most=4))


@query("i5_match_guard", f"""
WITH {CANDLES}, {_RULE_SQL}, n AS (SELECT count(*) AS n FROM bars), k AS (SELECT rule_id, count(*) AS matched FROM hits GROUP BY 1)
SELECT rule_id, matched, round(matched / n, 6) AS match_share FROM k, n WHERE matched / n <= 0.25""")
def guard(spark, folder):
    rules, _ = rule_tables(spark)
    return rounded(I.guard(I.match_counts(candles(spark, folder), rules)))


@query("i6_inflation", f"""
WITH {CANDLES}, {_RULE_SQL} SELECT rule_id, count(*) AS fires, count(*) FILTER (grp = 2) AS gated_fires, round(count(*) / nullif(count(*) FILTER (grp = 2), 0), 6) AS inflation FROM hits GROUP BY 1""")
def inflation(spark, folder):
    rules, _ = rule_tables(spark)
    frame = candles(spark, folder)
    return rounded(I.inflation(I.match_counts(frame, rules), I.match_counts(frame.filter("grp = 2"), rules)))


@query("i7_h46_snapped_and_mirrored_rules", f"""
WITH {CANDLES}, q AS (SELECT "column", quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM (SELECT unnest(['body_pct', 'bull', 'volume']) AS "column", unnest([body_pct, bull, volume]) AS v FROM bars) WHERE v IS NOT NULL GROUP BY 1)
SELECT 'box' AS rule_id, "column", round(CASE "column" WHEN 'bull' THEN 1 - floor(hi) WHEN 'volume' THEN ceil(lo) ELSE lo END, 6) AS lo, round(CASE "column" WHEN 'bull' THEN 1 - ceil(lo) WHEN 'volume' THEN floor(hi) ELSE hi END, 6) AS hi FROM q""")
def snapped(spark, folder):
    box = I.column_ranges(candles(spark, folder), ["body_pct", "bull", "volume"]).withColumn("rule_id", F.lit("box"))
    return rounded(I.mirror_rules(I.snap_bounds(box, ["bull", "volume"])).select("rule_id", "column", "lo", "hi"))


_TRADES = f"""pth AS (SELECT h.rule_id, h.symbol, h.bar_idx, h.grp, h.time, p.direction, p.sl, p.tp, CASE direction WHEN 'LONG' THEN 1 ELSE -1 END AS sd, n.open + CASE direction WHEN 'LONG' THEN 0.3 ELSE -0.3 END AS en
  FROM hits h JOIN params p USING (rule_id) JOIN bars n ON n.symbol = h.symbol AND n.bar_idx = h.bar_idx + 1),
lv AS (SELECT *, en * (1 - sd * sl) - sd * 0.3 AS st, en * (1 + sd * tp) - sd * 0.3 AS tg FROM pth),
stp AS (SELECT l.*, f.bar_idx - l.bar_idx AS k, f.close AS fc, CASE WHEN sd = 1 THEN f.low <= st ELSE f.high >= st END AS s, CASE WHEN sd = 1 THEN f.high >= tg ELSE f.low <= tg END AS g
  FROM lv l JOIN bars f ON f.symbol = l.symbol AND f.bar_idx BETWEEN l.bar_idx + 1 AND l.bar_idx + 8),
res AS (SELECT rule_id, symbol, bar_idx, any_value(grp) AS grp, any_value(time) AS time, any_value(sl) AS sl, any_value(tp) AS tp, any_value(sd) AS sd, any_value(en) AS en, min(k) FILTER (s) AS ks, min(k) FILTER (g) AS kg, max(k) AS n, arg_max(fc, k) AS last FROM stp GROUP BY 1, 2, 3),
bk AS (SELECT *, CASE WHEN ks IS NOT NULL AND ks <= coalesce(kg, 999) THEN 'stop' WHEN kg IS NOT NULL THEN 'target' ELSE 'timeout' END AS outcome FROM res),
tr AS (SELECT *, CASE outcome WHEN 'stop' THEN ks WHEN 'target' THEN kg ELSE n END AS held, CASE outcome WHEN 'stop' THEN -1 WHEN 'target' THEN tp / sl ELSE sd * (last - sd * 0.3 - en) / (en * sl) END AS gross FROM bk),
al AS (SELECT *, bar_idx + 1 AS entry_idx, FREE AS free_at, gross - 0.02 - 0.001 * held AS booked FROM tr),
nx AS (SELECT a.*, b.entry_idx AS nxt FROM al a ASOF LEFT JOIN al b ON a.rule_id = b.rule_id AND a.symbol = b.symbol AND a.free_at <= b.entry_idx),
sel AS (SELECT rule_id, symbol, min(entry_idx) AS entry_idx FROM nx GROUP BY 1, 2 UNION ALL SELECT s.rule_id, s.symbol, n.nxt FROM sel s JOIN nx n USING (rule_id, symbol, entry_idx) WHERE n.nxt IS NOT NULL),
trades AS (SELECT al.* FROM al JOIN sel USING (rule_id, symbol, entry_idx))"""
_COOL = _TRADES.replace("FREE", "greatest(bar_idx + held + 1, bar_idx + held + CASE outcome WHEN 'timeout' THEN 1 ELSE 0 END + 4)")
TRADES_SQL = f"WITH RECURSIVE {CANDLES}, {_RULE_SQL}, {_PARAM_SQL}, {_COOL}"
_CROSS_SQL = f"WITH RECURSIVE {CANDLES}, {_RULE_SQL}, {_PARAM_SQL}, " + _TRADES.replace("FREE", "bar_idx + held + 5")


def rule_trades(spark, folder, acceptance="exit", frame=None):
    """The trades of the fixed rules; `frame` holds the candles of a query that needs them besides."""
    rules, parameters = rule_tables(spark)
    return I.rule_trades(candles(spark, folder) if frame is None else frame, rules, parameters, max_hold=8, commission_r=0.02, swap_r=0.001, snapshot=["grp"], acceptance=acceptance)


@query("j1_j6_j9_rule_trades", f"""{TRADES_SQL} SELECT rule_id, symbol, entry_idx, outcome, CAST(held AS BIGINT) AS bars_held, CAST(grp AS BIGINT) AS grp, round(en, 8) AS entry_price,
  round(booked, 8) AS booked_r, CASE WHEN booked > 0 THEN 'WIN' ELSE 'LOSS' END AS result FROM trades""")
def trades(spark, folder):
    return rounded(rule_trades(spark, folder).select("rule_id", "symbol", "entry_idx", "outcome", "bars_held", "grp", "entry_price", "booked_r", "result"), 8)


@query("i4_rule_scores", f"""{TRADES_SQL} SELECT rule_id, count(*) AS trades, count(*) FILTER (booked > 0) AS wins, round(avg(CAST(booked > 0 AS INTEGER)), 6) AS win_rate,
  round(sum(booked) FILTER (booked > 0) / nullif(-sum(booked) FILTER (booked <= 0), 0), 4) AS profit_factor, round(avg(booked) FILTER (booked > 0), 4) AS avg_rr, round(avg(booked), 4) AS expectancy_r FROM trades GROUP BY 1""")
def scores(spark, folder):
    out = rule_scores(rule_trades(spark, folder))
    return out.select("rule_id", "trades", "wins", F.round("win_rate", 6).alias("win_rate"), *[F.round(n, 4).alias(n) for n in ("profit_factor", "avg_rr", "expectancy_r")])


HOLDS = {"r1": 5, "r2": 60, "r3": 700, "r4": 5000, "r5": 50_000}
_HOLD = "CASE l.rule_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in HOLDS.items()) + " END"


@query("j3_rule_trades_mixed_holds", f"""WITH RECURSIVE {CANDLES}, {_RULE_SQL}, {_PARAM_SQL}, {_COOL.replace("l.bar_idx + 8)", f"l.bar_idx + {_HOLD})").replace("coalesce(kg, 999)", "coalesce(kg, 999999)")}
SELECT rule_id, symbol, entry_idx, outcome, CAST(held AS BIGINT) AS bars_held, round(booked, 8) AS booked_r FROM trades""")
def mixed_hold_trades(spark, folder):
    """Every rule with a hold of its own, from 5 to 50,000 bars."""
    rules, parameters = rule_tables(spark)
    holds = F.create_map(*[x for k, v in HOLDS.items() for x in (F.lit(k), F.lit(v))])
    out = I.rule_trades(candles(spark, folder), rules, parameters.withColumn("max_hold", holds[c("rule_id")]), commission_r=0.02, swap_r=0.001)
    return rounded(out.select("rule_id", "symbol", "entry_idx", "outcome", "bars_held", "booked_r"), 8)


@query("j11_rules_across_symbols", f"""{_CROSS_SQL} SELECT rule_id, symbol, count(*) AS trades, round(avg(booked), 8) AS expectancy_r, round(sum(booked), 8) AS total_r FROM trades GROUP BY 1, 2""")
def across_symbols(spark, folder):
    out = rule_trades(spark, folder, "signal").groupBy("rule_id", "symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("booked_r").alias("expectancy_r"), F.sum("booked_r").alias("total_r"))
    return rounded(out, 8)


_SIDES = f"""pp AS (SELECT b.symbol, b.bar_idx, b.grp, n.open AS en FROM bars b JOIN bars n ON n.symbol = b.symbol AND n.bar_idx = b.bar_idx + 1),
sp AS (SELECT p.*, f.bar_idx - p.bar_idx AS k, f.high >= en * 1.3 AS lt, f.low <= en * 0.75 AS ls, f.low <= en * 0.7 AS stg, f.high >= en * 1.25 AS ss FROM pp p JOIN bars f ON f.symbol = p.symbol AND f.bar_idx BETWEEN p.bar_idx + 1 AND p.bar_idx + 8),
rs AS (SELECT symbol, bar_idx, any_value(grp) AS grp, min(k) FILTER (lt) AS lt, min(k) FILTER (ls) AS ls, min(k) FILTER (stg) AS stg, min(k) FILTER (ss) AS ss FROM sp GROUP BY 1, 2),
oc AS (SELECT symbol, bar_idx, grp, CASE WHEN lt IS NOT NULL AND lt <= coalesce(ls, 999) THEN 'target' WHEN ls IS NOT NULL THEN 'stop' ELSE 'timeout' END AS lo,
  CASE WHEN stg IS NOT NULL AND stg <= coalesce(ss, 999) THEN 'target' WHEN ss IS NOT NULL THEN 'stop' ELSE 'timeout' END AS so FROM rs)"""


def resolved_sides(spark, folder):
    frame = candles(spark, folder)
    sizes = frame.select("grp").distinct().withColumns({"sl_pct": F.lit(0.25), "tp_pct": F.lit(0.3)})
    return frame, I.both_sides(frame, "grp", sizes, 8)


@query("i10_side_modes", f"""
WITH {CANDLES}, {_SIDES}, w AS (SELECT grp, count(*) FILTER (lo <> 'timeout') AS lt, count(*) FILTER (so <> 'timeout') AS st, round(count(*) FILTER (lo = 'target') / nullif(count(*) FILTER (lo <> 'timeout'), 0) * 100, 1) AS lw,
  round(count(*) FILTER (so = 'target') / nullif(count(*) FILTER (so <> 'timeout'), 0) * 100, 1) AS sw FROM oc GROUP BY 1)
SELECT CAST(grp AS BIGINT) AS grp, lt AS long_trades, st AS short_trades, lw AS long_wr, sw AS short_wr, CASE WHEN lw >= 52 AND sw >= 52 THEN 'BIDIRECTIONAL' WHEN lw >= 52 THEN 'LONG_ONLY' WHEN sw >= 52 THEN 'SHORT_ONLY' WHEN lw >= sw THEN 'LONG_ONLY' ELSE 'SHORT_ONLY' END AS mode FROM w""")
def modes(spark, folder):
    return rounded(I.side_modes(resolved_sides(spark, folder)[1], "grp"))


@query("i8_direction_discriminator", f"""
WITH {CANDLES}, {_SIDES}, d AS (SELECT o.grp, CAST(lo = 'target' AS INTEGER) AS y, unnest(['body_pct', 'uwk_pct', 'lwk_pct']) AS col, unnest([body_pct, uwk_pct, lwk_pct]) AS v, unnest([0, 1, 2]) AS ci FROM oc o JOIN bars USING (symbol, bar_idx)
  WHERE (lo = 'target' AND so = 'stop') OR (lo = 'stop' AND so = 'target')),
q AS (SELECT grp, col, ci, count(*) AS n, unnest(range(13)) AS i, unnest(quantile_cont(v, [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8])) AS t FROM d WHERE v IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT q.grp, q.col, q.ci, q.i, any_value(n) AS n, any_value(t) AS t, avg(CAST(CAST(d.v >= q.t AS INTEGER) = y AS INTEGER)) AS acc FROM q JOIN d ON d.grp = q.grp AND d.col = q.col AND d.v IS NOT NULL GROUP BY 1, 2, 3, 4),
e AS (SELECT grp, col, ci, i, n, t, 'above' AS dir, 1 AS up, acc FROM s UNION ALL SELECT grp, col, ci, i, n, t, 'below', 0, 1 - acc FROM s)
SELECT CAST(grp AS BIGINT) AS grp, col AS "column", round(t, 6) AS thresh, dir, round(acc, 6) AS accuracy, n AS n_bars FROM e WHERE acc > 0.5
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(acc, 12) DESC, ci, i, up DESC) = 1""")
def discriminator(spark, folder):
    frame, resolved = resolved_sides(spark, folder)
    return rounded(I.fit_discriminator(resolved, frame, "grp", ["body_pct", "uwk_pct", "lwk_pct"], min_accuracy=0.5))


@query("i9_tree_discriminator")
def tree_discriminator(spark, folder):
    frame, resolved = resolved_sides(spark, folder)
    columns = ["body_pct", "uwk_pct", "lwk_pct"]
    model = I.fit_tree_discriminator(resolved.drop("grp"), frame, columns)
    from pyspark.ml.feature import VectorAssembler
    scored = model.transform(VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(frame))
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("bars"))


_CUTS = "[" + ", ".join(str(i / 16) for i in range(1, 16)) + "]"


def _level(k: int) -> str:
    """One level of the trees from `d{k}` (grp, node, y, columns): its best splits `b{k}` and the rows after them, `d{k + 1}`."""
    cols = "['body_pct', 'uwk_pct', 'lwk_pct']"
    return f"""v{k} AS (SELECT grp, node, y, unnest({cols}) AS col, unnest([body_pct, uwk_pct, lwk_pct]) AS v, unnest([0, 1, 2]) AS ci FROM d{k}),
c{k} AS (SELECT grp, node, col, any_value(ci) AS ci, i, any_value(t) AS t, count(*) FILTER (v <= t) AS nl, count(*) FILTER (v <= t AND y = 1) AS pl, count(*) AS n, count(*) FILTER (y = 1) AS p FROM v{k} JOIN cuts USING (grp, col) GROUP BY 1, 2, 3, 5),
b{k} AS (SELECT grp, node, col, t FROM c{k} WHERE nl >= 5 AND n - nl >= 5 AND p > 0 AND p < n QUALIFY row_number() OVER (PARTITION BY grp, node ORDER BY round(2 * pl * (nl - pl) / nl + 2 * (p - pl) * (n - nl - p + pl) / (n - nl), 9), ci, i) = 1),
d{k + 1} AS (SELECT d.* EXCLUDE (node), CASE WHEN b.col IS NULL THEN d.node WHEN CASE b.col WHEN 'body_pct' THEN body_pct WHEN 'uwk_pct' THEN uwk_pct ELSE lwk_pct END <= b.t THEN 2 * d.node + 1 ELSE 2 * d.node + 2 END AS node FROM d{k} d LEFT JOIN b{k} b USING (grp, node))"""


@query("i9_group_trees", f"""
WITH {CANDLES}, {_SIDES}, a AS (SELECT o.grp, CAST(lo = 'target' AS INTEGER) AS y, 0 AS node, body_pct, uwk_pct, lwk_pct FROM oc o JOIN bars USING (symbol, bar_idx)
  WHERE ((lo = 'target' AND so = 'stop') OR (lo = 'stop' AND so = 'target')) AND body_pct IS NOT NULL AND uwk_pct IS NOT NULL AND lwk_pct IS NOT NULL),
d0 AS (SELECT * FROM a WHERE grp IN (SELECT grp FROM a GROUP BY 1 HAVING count(*) >= 30)),
cuts AS (SELECT grp, col, unnest(range(15)) AS i, unnest(quantile_cont(v, {_CUTS})) AS t FROM (SELECT grp, unnest(['body_pct', 'uwk_pct', 'lwk_pct']) AS col, unnest([body_pct, uwk_pct, lwk_pct]) AS v FROM d0) GROUP BY 1, 2),
{_level(0)}, {_level(1)},
lf AS (SELECT grp, node, count(*) AS n, count(*) FILTER (y = 1) AS p FROM d2 GROUP BY 1, 2),
ac AS (SELECT grp, CAST(sum(n) AS BIGINT) AS n_bars, sum(greatest(p, n - p)) / sum(n) AS accuracy, string_agg(node || ':' || (2 * p > n) || ':' || n, ' ' ORDER BY node) AS leaves FROM lf GROUP BY 1),
trees AS (SELECT grp, string_agg(node || ':' || col || ':' || printf('%.6f', t), ' ' ORDER BY node) AS splits FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1) GROUP BY 1)
SELECT CAST(grp AS BIGINT) AS grp, n_bars, round(accuracy, 6) AS accuracy, splits, leaves FROM ac JOIN trees USING (grp) WHERE accuracy >= 0.5""")
def group_trees(spark, folder):
    """One tree of depth two per group; the splits are recomputed in SQL."""
    frame, resolved = resolved_sides(spark, folder)
    out = I.fit_group_trees(resolved, frame, "grp", ["body_pct", "uwk_pct", "lwk_pct"], min_accuracy=0.5)
    text = lambda name, item: F.array_join(F.transform(name, item), " ").alias(name)
    return rounded(out.select(
        "grp", "n_bars", "accuracy", text("splits", lambda x: F.concat_ws(":", x["node"].cast("string"), x["column"], F.format_string("%.6f", x["thresh"]))),
        text("leaves", lambda x: F.concat_ws(":", x["node"].cast("string"), x["long"].cast("string"), x["n_bars"].cast("string")))))


@query("i3_parameter_grid", """
WITH sy AS (SELECT DISTINCT event_type AS symbol FROM events), g AS (SELECT '{"atr_stop":' || s || ',"atr_trail":' || t || ',"channel_bars":' || b || ',"max_hold_bars":' || h || '}' AS parameters
  FROM (SELECT unnest(['1.0', '2.0']) AS s), (SELECT unnest(['0.0', '3.0']) AS t), (SELECT unnest(['20', '55', '96']) AS b), (SELECT unnest(['48', '96']) AS h))
SELECT symbol, 'time_series_breakout_' || substr(sha1('{"lineage":"time_series_breakout","parameters":' || parameters || '}'), 1, 12) AS strategy_id, direction_mode, volatility_filter, session_name, parameters
FROM sy, g, (SELECT unnest(['both', 'long_only', 'short_only']) AS direction_mode), (SELECT unnest(['none', 'h4_above_60d_median']) AS volatility_filter), (SELECT unnest(['all_day', 'asia_europe']) AS session_name)""")
def grid(spark, folder):
    """Signal families crossed with common filters, then with every quoted symbol."""
    symbols = S.ticks(spark, folder).select("symbol").distinct()
    base = I.expand_grid(symbols, "time_series_breakout", {"channel_bars": [20, 55, 96], "atr_stop": [1.0, 2.0], "atr_trail": [0.0, 3.0], "max_hold_bars": [48, 96]})
    full = I.with_common_filters(base, ["both", "long_only", "short_only"], [("all_day", 0, 24), ("asia_europe", 0, 12)], ["none", "h4_above_60d_median"])
    return full.select("symbol", "strategy_id", "direction_mode", "volatility_filter", "session_name", "parameters")


def _quote_signals(spark, folder):
    bars = S.quote_bars(spark, folder).withColumn("atr14", c("high") - c("low"))
    side = F.when(c("close") > c("open") + 5, 1).when(c("close") < c("open") - 5, -1).otherwise(0)
    signals = bars.select(
        F.lit("demo").alias("strategy_id"), "symbol", "bar_idx", side.alias("signal_direction"), F.lit(20.0).alias("stop_distance"),
        F.lit(30.0).alias("target_distance"), F.lit(0.0).alias("signal_target_price"), F.lit(0.0).alias("trail_atr"), F.lit(6).alias("max_hold_bars"))
    return bars, signals


_REPLAY = f"""WITH RECURSIVE {sql.QUOTES}, sg AS (SELECT *, CASE WHEN close > open + 5 THEN 1 WHEN close < open - 5 THEN -1 END AS sd FROM bars),
en AS (SELECT s.symbol, s.bar_idx, s.time AS signal_time, n.time AS entry_time, sd, CASE sd WHEN 1 THEN n.ask_open ELSE n.bid_open END AS en FROM sg s JOIN bars n ON n.symbol = s.symbol AND n.bar_idx = s.bar_idx + 1 WHERE sd IS NOT NULL),
ck AS (SELECT e.*, f.bar_idx - e.bar_idx AS k, f.time AS ft, CASE sd WHEN 1 THEN f.bid_close ELSE f.ask_close END AS fc, CASE sd WHEN 1 THEN f.bid_low <= en - 20 ELSE f.ask_high >= en + 20 END AS s, CASE sd WHEN 1 THEN f.bid_high >= en + 30 ELSE f.ask_low <= en - 30 END AS g
  FROM en e JOIN bars f ON f.symbol = e.symbol AND f.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + 7),
rs AS (SELECT symbol, bar_idx, any_value(signal_time) AS signal_time, any_value(entry_time) AS entry_time, any_value(sd) AS sd, any_value(en) AS en, min(k) FILTER (s) AS ks, min(k) FILTER (g) AS kg, max(k) AS n, arg_max(fc, k) AS last FROM ck GROUP BY 1, 2),
oc AS (SELECT *, CASE WHEN ks IS NOT NULL AND ks <= coalesce(kg, 99) THEN 'stop_loss' WHEN kg IS NOT NULL THEN 'take_profit' WHEN n = 7 THEN 'max_hold' ELSE 'end_of_data' END AS exit_reason, bar_idx + 1 AS entry_idx FROM rs),
tr AS (SELECT *, CASE exit_reason WHEN 'stop_loss' THEN ks WHEN 'take_profit' THEN kg ELSE n END AS held, CASE exit_reason WHEN 'stop_loss' THEN en - sd * 20 WHEN 'take_profit' THEN en + sd * 30 ELSE last END AS exit_price FROM oc),
nx AS (SELECT a.*, b.entry_idx AS nxt FROM tr a ASOF LEFT JOIN tr b ON a.symbol = b.symbol AND a.bar_idx + a.held + 1 <= b.entry_idx),
sel AS (SELECT symbol, min(entry_idx) AS entry_idx FROM nx GROUP BY 1 UNION ALL SELECT s.symbol, n.nxt FROM sel s JOIN nx n USING (symbol, entry_idx) WHERE n.nxt IS NOT NULL)
SELECT symbol, signal_time, entry_time, exit_reason, CAST(held - 1 AS BIGINT) AS hold_bars, round(en, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(sd * (exit_price - en) * 10 - 0.7, 4) AS net_pnl FROM tr JOIN sel USING (symbol, entry_idx)"""


@query("j2_j7_bar_replay", _REPLAY)
def replay(spark, folder):
    bars, signals = _quote_signals(spark, folder)
    out = J.bar_replay(bars, signals, commission_per_lot=7.0)
    return out.select("symbol", "signal_time", "entry_time", "exit_reason", c("hold_bars").cast("long").alias("hold_bars"), F.round("entry_price", 6).alias("entry_price"),
                      F.round("exit_price", 6).alias("exit_price"), F.round("net_pnl", 4).alias("net_pnl"))


_LONG = _REPLAY.replace("BETWEEN e.bar_idx + 1 AND e.bar_idx + 7)", "BETWEEN e.bar_idx + 1 AND e.bar_idx + mh + 1)").replace("WHEN n = 7 THEN", "WHEN n = mh + 1 THEN").replace(
    "en AS (SELECT s.symbol, s.bar_idx,", "en AS (SELECT s.symbol, s.bar_idx, CASE s.bar_idx % 4 WHEN 0 THEN 5 WHEN 1 THEN 60 WHEN 2 THEN 200 ELSE 500 END AS mh,").replace(
    "any_value(sd) AS sd,", "any_value(sd) AS sd, any_value(mh) AS mh,").replace("<= en - 20", "<= en - 150").replace(">= en + 20", ">= en + 150").replace(">= en + 30", ">= en + 250").replace("<= en - 30", "<= en - 250").replace(
    "en - sd * 20", "en - sd * 150").replace("en + sd * 30", "en + sd * 250").replace("coalesce(kg, 99)", "coalesce(kg, 9999)")


@query("j2_long_hold_replay", _LONG)
def long_replay(spark, folder):
    """Holds from 5 to 500 bars side by side, with levels that are seldom reached."""
    bars, signals = _quote_signals(spark, folder)
    turn = c("bar_idx") % 4
    signals = signals.withColumns({
        "max_hold_bars": F.when(turn == 0, 5).when(turn == 1, 60).when(turn == 2, 200).otherwise(500), "stop_distance": F.lit(150.0), "target_distance": F.lit(250.0)})
    out = J.bar_replay(bars, signals, commission_per_lot=7.0)
    return out.select("symbol", "signal_time", "entry_time", "exit_reason", c("hold_bars").cast("long").alias("hold_bars"), F.round("entry_price", 6).alias("entry_price"),
                      F.round("exit_price", 6).alias("exit_price"), F.round("net_pnl", 4).alias("net_pnl"))


_DEEP = _LONG.replace("WHEN 1 THEN 60 WHEN 2 THEN 200 ELSE 500 END AS mh", "WHEN 1 THEN 500 WHEN 2 THEN 5000 ELSE 50000 END AS mh").replace("coalesce(kg, 9999)", "coalesce(kg, 999999)")


@query("j2_mixed_hold_replay", _DEEP)
def mixed_replay(spark, folder):
    """Holds of 5 and of 50,000 bars side by side: a row carries one cell of extremes whatever its hold."""
    bars, signals = _quote_signals(spark, folder)
    turn = c("bar_idx") % 4
    signals = signals.withColumns({
        "max_hold_bars": F.when(turn == 0, 5).when(turn == 1, 500).when(turn == 2, 5000).otherwise(50_000), "stop_distance": F.lit(150.0), "target_distance": F.lit(250.0)})
    out = J.bar_replay(bars, signals, commission_per_lot=7.0)
    return out.select("symbol", "signal_time", "entry_time", "exit_reason", c("hold_bars").cast("long").alias("hold_bars"), F.round("entry_price", 6).alias("entry_price"),
                      F.round("exit_price", 6).alias("exit_price"), F.round("net_pnl", 4).alias("net_pnl"))


_TRAIL = f"""WITH RECURSIVE {sql.QUOTES}, sg AS (SELECT *, CASE WHEN close > open + 5 THEN 1 WHEN close < open - 5 THEN -1 END AS sd FROM bars),
en AS (SELECT s.symbol, s.bar_idx, n.time AS entry_time, sd, CASE sd WHEN 1 THEN n.ask_open ELSE n.bid_open END AS en FROM sg s JOIN bars n ON n.symbol = s.symbol AND n.bar_idx = s.bar_idx + 1 WHERE sd IS NOT NULL),
st AS (SELECT symbol, bar_idx, entry_time, sd, en, 0 AS k, en - sd * 20 AS stop, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS px, entry_time AS xt FROM en
  UNION ALL SELECT symbol, bar_idx, entry_time, sd, en, k + 1, CASE WHEN reason IS NULL THEN moved ELSE stop END, reason, CASE reason WHEN 'stop_loss' THEN stop WHEN 'take_profit' THEN en + sd * 30 ELSE fc END, ft
  FROM (SELECT s.symbol, s.bar_idx, s.entry_time, s.sd, s.en, s.k, s.stop, f.time AS ft, CASE s.sd WHEN 1 THEN f.bid_close ELSE f.ask_close END AS fc,
    CASE s.sd WHEN 1 THEN greatest(s.stop, f.bid_high - 0.5 * (f.high - f.low)) ELSE least(s.stop, f.ask_low + 0.5 * (f.high - f.low)) END AS moved,
    CASE WHEN CASE s.sd WHEN 1 THEN f.bid_low <= s.stop ELSE f.ask_high >= s.stop END THEN 'stop_loss' WHEN CASE s.sd WHEN 1 THEN f.bid_high >= s.en + 30 ELSE f.ask_low <= s.en - 30 END THEN 'take_profit' WHEN s.k >= 6 THEN 'max_hold' END AS reason
    FROM st s JOIN bars f ON f.symbol = s.symbol AND f.bar_idx = s.bar_idx + s.k + 1 WHERE s.reason IS NULL)),
tr AS (SELECT symbol, bar_idx, any_value(entry_time) AS entry_time, any_value(sd) AS sd, any_value(en) AS en, max(k) AS held, arg_max(px, k) AS px, coalesce(max(reason), 'end_of_data') AS exit_reason, arg_max(xt, k) AS exit_time, bar_idx + 1 AS entry_idx FROM st GROUP BY symbol, bar_idx),
nx AS (SELECT a.*, b.entry_idx AS nxt FROM tr a ASOF LEFT JOIN tr b ON a.symbol = b.symbol AND a.bar_idx + a.held + 1 <= b.entry_idx),
sel AS (SELECT symbol, min(entry_idx) AS entry_idx FROM nx GROUP BY 1 UNION ALL SELECT s.symbol, n.nxt FROM sel s JOIN nx n USING (symbol, entry_idx) WHERE n.nxt IS NOT NULL)
SELECT symbol, entry_time, exit_time, exit_reason, CAST(held - 1 AS BIGINT) AS hold_bars, round(sd * (px - en) * 10, 4) AS net_pnl FROM tr JOIN sel USING (symbol, entry_idx)"""


@query("j4_trailing_stop_replay", _TRAIL)
def trailing(spark, folder):
    bars, signals = _quote_signals(spark, folder)
    out = J.bar_replay(bars, signals.withColumn("trail_atr", F.lit(0.5)))
    return rounded(out.select("symbol", "entry_time", "exit_time", "exit_reason", "hold_bars", "net_pnl"), 4)


_TOUCH = f"""
WITH {sql.QUOTES}, en AS (SELECT b.symbol, b.bar_idx + 1 AS entry_idx, n.time AS t0, t.time AS entry_time, CASE WHEN b.close > b.open THEN 1 ELSE -1 END AS sd, t.bid, t.ask FROM bars b JOIN bars n ON n.symbol = b.symbol AND n.bar_idx = b.bar_idx + 1
  ASOF JOIN ticks t ON t.symbol = n.symbol AND n.time <= t.time),
lv AS (SELECT *, CASE sd WHEN 1 THEN ask - REACH ELSE bid + REACH END AS st, CASE sd WHEN 1 THEN ask + REACH ELSE bid - REACH END AS tg, DEADLINE AS dl FROM en),
hit AS (SELECT l.symbol, l.entry_idx, k.time, CASE sd WHEN 1 THEN k.bid ELSE k.ask END AS px, CASE WHEN k.time >= dl THEN 'max_hold' WHEN CASE sd WHEN 1 THEN k.bid <= st ELSE k.ask >= st END THEN 'stop_loss' WHEN CASE sd WHEN 1 THEN k.bid >= tg ELSE k.ask <= tg END THEN 'take_profit' END AS reason
  FROM lv l JOIN ticks k ON k.symbol = l.symbol AND k.time > l.entry_time),
f AS (SELECT symbol, entry_idx, min(time) AS exit_time, arg_min(px, time) AS px, arg_min(reason, time) AS reason FROM hit WHERE reason IS NOT NULL GROUP BY 1, 2),
z AS (SELECT symbol, max(time) AS zt, arg_max(bid, time) AS zb, arg_max(ask, time) AS za FROM ticks GROUP BY 1)
SELECT l.symbol, l.entry_idx, l.entry_time, CASE WHEN reason IS NULL AND zt > l.entry_time THEN zt ELSE f.exit_time END AS exit_time, round(CASE WHEN reason IS NULL AND zt > l.entry_time THEN CASE sd WHEN 1 THEN zb ELSE za END ELSE px END, 6) AS exit_price,
  CASE WHEN reason IS NULL AND zt > l.entry_time THEN 'end_of_data' ELSE coalesce(reason, 'open') END AS exit_reason FROM lv l LEFT JOIN f USING (symbol, entry_idx) LEFT JOIN z ON z.symbol = l.symbol"""


@query("j8_tick_first_touch", _TOUCH.replace("DEADLINE", "entry_time + INTERVAL 20 HOUR").replace("REACH", "25"))
def tick_touch(spark, folder):
    return _touched(spark, folder, 25, F.expr("INTERVAL 20 HOURS"))


@query("j8_tick_exit_to_end", _TOUCH.replace("DEADLINE", "CAST(NULL AS TIMESTAMP)").replace("REACH", "200"))
def tick_exit_to_end(spark, folder):
    """Wide levels and no deadline: many entries end with the data."""
    return _touched(spark, folder, 200, None)


def _touched(spark, folder, reach, limit):
    bars, ticks = S.quote_bars(spark, folder), S.ticks(spark, folder)
    led = over_chunks(bars, lambda w: {"_next": F.lead("time").over(w)}, after=1).filter("_next IS NOT NULL")
    filled = asof_join(led, ticks, ["time", "bid", "ask"], left_time="_next", direction="forward", prefix="fill_", bucket_seconds=3600)
    side = F.when(c("close") > c("open"), 1.0).otherwise(-1.0)
    price = F.when(side > 0, c("fill_ask")).otherwise(c("fill_bid"))
    entries = filled.select(
        "symbol", (c("bar_idx") + 1).alias("entry_idx"), (c("bar_idx") + 1).alias("entry_id"), c("fill_time").alias("entry_time"), side.alias("side"),
        price.alias("entry_price"), (price - side * reach).alias("stop_price"), (price + side * reach).alias("target_price"),
        (F.lit(None).cast("timestamp_ntz") if limit is None else c("fill_time") + limit).alias("deadline"))
    out = J.tick_first_touch(entries, ticks, bars, 3600)
    return rounded(out.select("symbol", "entry_idx", "entry_time", "exit_time", "exit_price", "exit_reason"))


@query("j10_pnl_points", f"""{TRADES_SQL} SELECT rule_id, count(*) AS trades, round(sum(gross * en * sl), 2) AS points FROM trades GROUP BY 1""")
def points(spark, folder):
    trades = rule_trades(spark, folder).withColumns({"r_multiple": c("gross_r"), "sl_pts": c("risk")})
    return trades.withColumn("pts", J.pnl_points(trades)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("pts"), 2).alias("points"))


@query("j12_unused_holdouts", """
SELECT o_orderpriority AS strategy_id, count(*) AS runs FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = o.o_custkey AND u.o_orderstatus = 'F') GROUP BY 1""")
def unused_holdouts(spark, folder):
    orders = S.table(spark, folder, "orders")
    used = orders.filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    return orders.join(used, "o_custkey", "left_anti").groupBy(c("o_orderpriority").alias("strategy_id")).agg(F.count(F.lit(1)).alias("runs"))
