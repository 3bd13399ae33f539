"""Queries over trade ledgers: metrics, gates, validation, resampling, similarity, grouping."""

from __future__ import annotations

from datetime import date

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tickloom.operators import grouping as O
from tickloom.operators import metrics as K
from tickloom.operators import resample as M
from tickloom.operators import rules as I
from tickloom.operators import similar as N
from tickloom.operators import validate as L
from tickloom.operators.bars import dense_daily_pnl
from tickloom.operators.correlate import correlated_pairs
from tickloom.operators.labels import best_move
from tickloom.operators.scan import over_chunks
from tickloom.plans import sql, standins as S
from tickloom.plans.outcome_queries import CANDLES, RULES, TRADES_SQL, _RULE_SQL, candles, many_rules, rule_tables, rule_trades
from tickloom.plans.registry import query, r, rounded

c = F.col
LED = f"WITH {sql.LEDGER}"
_PF = "sum(CASE WHEN net_pnl > 0 THEN net_pnl ELSE 0 END) / nullif(sum(CASE WHEN net_pnl < 0 THEN -net_pnl ELSE 0 END), 0)"

# ---- K ----


@query("k1_k3_headline", f"""{LED} SELECT strategy_id, count(*) AS trades, count(*) FILTER (net_pnl > 0) AS wins, count(*) FILTER (net_pnl < 0) AS losses, round(100 * count(*) FILTER (net_pnl > 0) / count(*), 6) AS win_rate_pct,
  round(sum(net_pnl), 6) AS net_profit, round(sum(CASE WHEN net_pnl > 0 THEN net_pnl ELSE 0 END), 6) AS gross_profit, round({_PF}, 6) AS profit_factor, round(avg(net_pnl), 6) AS expected_payoff,
  round(avg(net_pnl) / stddev_samp(net_pnl) * sqrt(count(*)), 6) AS trade_sharpe, count(DISTINCT CAST(exit_time AS DATE)) AS trading_days FROM ledger GROUP BY 1""")
def headline(spark, folder):
    out = K.headline(S.ledger(spark, folder)).drop("gross_loss", "trades_per_active_day")
    return rounded(out.withColumns({n: F.round(n, 6) for n in ("net_profit", "gross_profit")}))


_EQ = """eq AS (SELECT *, 100000 + sum(net_pnl) OVER w AS equity FROM ledger WINDOW w AS (PARTITION BY strategy_id ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)),
pk AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"""


@query("k2_equity_curve", f"{LED}, {_EQ} SELECT strategy_id, trade_id, round(equity, 6) AS equity, round(peak, 6) AS peak, round(peak - equity, 6) AS drawdown FROM pk")
def equity(spark, folder):
    return rounded(K.equity_curve(S.ledger(spark, folder), 100_000.0).select("strategy_id", "trade_id", "equity", "peak", "drawdown"))


@query("k2_drawdowns", f"{LED}, {_EQ} SELECT strategy_id, round(max(peak - equity), 4) AS max_drawdown, round(max((peak - equity) / peak * 100), 6) AS max_drawdown_pct FROM pk GROUP BY 1")
def drawdowns(spark, folder):
    return K.drawdowns(S.ledger(spark, folder), 100_000.0).select("strategy_id", F.round("max_drawdown", 4).alias("max_drawdown"), F.round("max_drawdown_pct", 6).alias("max_drawdown_pct"))


@query("k3_k12_annualised_and_concentration", f"""{LED}, m AS (SELECT strategy_id, strftime(exit_time, '%Y-%m') AS m, sum(net_pnl) AS p FROM ledger GROUP BY 1, 2), mm AS (SELECT strategy_id, max(abs(p)) AS top FROM m GROUP BY 1)
SELECT strategy_id, round(avg(net_pnl) / stddev_samp(net_pnl) * sqrt(252), 6) AS sharpe, round(avg(net_pnl) / stddev_samp(CASE WHEN net_pnl < 0 THEN net_pnl END) * sqrt(252), 6) AS sortino, round(sum(net_pnl) / 100000 * 100, 6) AS return_pct,
  round(count(*) / (epoch(max(exit_time) - min(exit_time)) / 86400 / 7), 6) AS trades_per_week, round(max(abs(net_pnl)) * 100 / sum(abs(net_pnl)), 6) AS largest_trade_concentration_pct,
  round(any_value(top) * 100 / abs(sum(net_pnl)), 6) AS largest_month_concentration_pct FROM ledger JOIN mm USING (strategy_id) GROUP BY 1""")
def annualised(spark, folder):
    led = S.ledger(spark, folder)
    return rounded(K.annualised(led, 100_000.0).join(K.concentration(led), "strategy_id"))


@query("k4_period_stability", f"""{LED}, m AS (SELECT strategy_id, strftime(exit_time, '%Y-%m') AS k, sum(net_pnl) AS p FROM ledger GROUP BY 1, 2), q AS (SELECT strategy_id, year(exit_time) * 10 + quarter(exit_time) AS k, sum(net_pnl) AS p FROM ledger GROUP BY 1, 2),
y AS (SELECT strategy_id, year(exit_time) AS k, sum(net_pnl) AS p FROM ledger GROUP BY 1, 2), f AS (SELECT strategy_id, avg(CAST(p > 0 AS INTEGER)) AS v, count(*) FILTER (p > 0) AS n FROM m GROUP BY 1),
g AS (SELECT strategy_id, avg(CAST(p > 0 AS INTEGER)) AS v, count(*) FILTER (p > 0) AS n FROM q GROUP BY 1), h AS (SELECT strategy_id, avg(CAST(p > 0 AS INTEGER)) AS v, count(*) FILTER (p > 0) AS n FROM y GROUP BY 1)
SELECT strategy_id, round(f.v, 6) AS positive_month_fraction, f.n AS positive_months, round(g.v, 6) AS positive_quarter_fraction, round(h.v, 6) AS positive_year_fraction, h.n AS positive_years FROM f JOIN g USING (strategy_id) JOIN h USING (strategy_id)""")
def stability(spark, folder):
    out = K.period_stability(S.ledger(spark, folder))
    return rounded(out.select("strategy_id", "positive_month_fraction", "positive_months", "positive_quarter_fraction", "positive_year_fraction", "positive_years"))


_STREAK = """ord AS (SELECT *, sum(CASE WHEN net_pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS w FROM ledger),
st AS (SELECT strategy_id, max(n) AS n FROM (SELECT strategy_id, w, count(*) AS n FROM ord WHERE net_pnl <= 0 GROUP BY 1, 2) GROUP BY 1)"""


@query("k5_worst_streak", f"{LED}, {_STREAK} SELECT strategy_id, n AS max_consecutive_losses FROM st")
def streak(spark, folder):
    led = S.ledger(spark, folder)
    return rounded(K.worst_streak(led, ["strategy_id"], ["exit_time", "trade_id"], c("net_pnl") <= 0, F.datediff(F.to_date("exit_time"), F.lit("1970-01-01").cast("date"))))


def _wil(z: float, sign: str, w: str = "w", n: str = "n") -> str:
    return f"(({w} / {n} + {z * z} / (2 * {n})) {sign} {z} * sqrt({w} / {n} * (1 - {w} / {n}) / {n} + {z * z} / (4 * {n} * {n}))) / (1 + {z * z} / {n})"


@query("k6_wilson_bounds", f"{LED}, x AS (SELECT strategy_id, CAST(count(*) FILTER (net_pnl > 0) AS DOUBLE) AS w, CAST(count(*) AS DOUBLE) AS n FROM ledger GROUP BY 1) SELECT strategy_id, round({_wil(K.two_sided_z(0.85), '-')}, 6) AS lower85, round({_wil(1.96, '-')}, 6) AS lower, round({_wil(1.96, '+')}, 6) AS upper FROM x")
def wilson(spark, folder):
    base = S.ledger(spark, folder).groupBy("strategy_id").agg(F.count_if(c("net_pnl") > 0).cast("double").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    lower, upper = K.wilson_interval(c("w"), c("n"))
    return rounded(base.select("strategy_id", K.wilson_lower(c("w"), c("n"), K.two_sided_z(0.85)).alias("lower85"), lower.alias("lower"), upper.alias("upper")))


_K78 = """yy AS (SELECT strategy_id, year(exit_time) AS y, count(*) AS n, avg(CAST(net_pnl > 0 AS INTEGER)) AS w FROM ledger GROUP BY 1, 2), qq AS (SELECT strategy_id, year(exit_time) AS y, quarter(exit_time) AS q, count(*) AS n FROM ledger GROUP BY 1, 2, 3),
tc AS (SELECT strategy_id, CASE WHEN count(*) < 2 THEN 0.6 ELSE avg(CAST(n >= 5 AND w >= 0.5 AS INTEGER)) END AS time_consistency FROM yy GROUP BY 1),
td AS (SELECT strategy_id, CASE WHEN count(*) < 2 THEN 0.5 ELSE least(greatest(1 - stddev_samp(n) / greatest(avg(n), 1) / 3, 0), 1) END AS trade_distribution FROM qq GROUP BY 1)"""


@query("k7_k8_consistency", f"{LED}, {_K78} SELECT strategy_id, round(time_consistency, 6) AS time_consistency, round(trade_distribution, 6) AS trade_distribution FROM tc JOIN td USING (strategy_id)")
def consistency(spark, folder):
    led = S.ledger(spark, folder)
    return rounded(K.time_consistency(led).join(K.trade_distribution(led), "strategy_id"))


def _ts(value: str, target: float, weight: float) -> str:
    return f"CASE WHEN {value} >= {target} THEN {weight} * (1 + 0.1 * ln(1 + {value} - {target})) ELSE {weight} * ({value} / {target}) * ({value} / {target}) END"


@query("k9_composite_score", f"""{LED}, {_K78}, x AS (SELECT strategy_id, CAST(count(*) FILTER (net_pnl > 0) AS DOUBLE) AS w, CAST(count(*) FILTER (net_pnl <= 0) AS DOUBLE) AS l, avg(net_pnl / initial_risk) FILTER (net_pnl > 0) AS rr, CAST(count(DISTINCT CAST(exit_time AS DATE)) AS DOUBLE) AS days FROM ledger GROUP BY 1),
v AS (SELECT *, w / (w + l) * 100 AS wr, w * rr / l AS pf, rr / greatest(l / w, 0.01) AS rrx, time_consistency * trade_distribution AS stab, (w + l) / days AS tpd FROM x JOIN tc USING (strategy_id) JOIN td USING (strategy_id))
SELECT strategy_id, round(CASE WHEN rr >= l / w THEN {_ts('wr', 55.0, 0.3)} + {_ts('pf', 1.5, 0.3)} + {_ts('rrx', 1.3, 0.25)} + {_ts('stab', 0.75, 0.25)} + {_ts('tpd', 1.0, 0.15)} ELSE 0 END, 6) AS composite_score FROM v""")
def composite(spark, folder):
    led = S.ledger(spark, folder)
    base = led.groupBy("strategy_id").agg(
        F.count_if(c("net_pnl") > 0).alias("wins"), F.count_if(c("net_pnl") <= 0).alias("losses"), F.avg(F.when(c("net_pnl") > 0, c("net_pnl") / c("initial_risk"))).alias("avg_rr"),
        F.countDistinct(F.to_date("exit_time")).alias("train_days"))
    base = base.join(K.time_consistency(led), "strategy_id").join(K.trade_distribution(led), "strategy_id").withColumn("stability", c("time_consistency") * c("trade_distribution"))
    return rounded(K.composite_score(base).select("strategy_id", "composite_score"))


@query("k5_r_metrics", f"""{TRADES_SQL}, o AS (SELECT rule_id, symbol, entry_idx, booked, sum(booked) OVER w AS e, sum(CASE WHEN booked > 0 THEN 1 ELSE 0 END) OVER w AS wn FROM trades WINDOW w AS (PARTITION BY rule_id, symbol ORDER BY entry_idx ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY rule_id, symbol ORDER BY entry_idx ROWS UNBOUNDED PRECEDING)) AS pk FROM o), s AS (SELECT rule_id, symbol, max(n) AS n FROM (SELECT rule_id, symbol, wn, count(*) AS n FROM o WHERE booked <= 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
dd AS (SELECT symbol, count(DISTINCT CAST(time AS DATE)) AS d FROM bars GROUP BY 1),
m AS (SELECT rule_id, symbol, count(*) AS trades, avg(booked) FILTER (booked > 0) AS w, avg(-booked) FILTER (booked < 0) AS l, max(pk - e) AS dd, CAST(count(*) FILTER (booked > 0) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1, 2)
SELECT rule_id, symbol, trades, round(dd, 6) AS max_drawdown_r, coalesce(s.n, 0) AS max_consecutive_losses, round(trades / d, 6) AS per_day, round(coalesce(w / l, 0), 6) AS payoff_ratio,
  round(CASE WHEN w / l > 0 THEN 100 / (1 + w / l) ELSE 100 END, 6) AS breakeven_wr, round(100 * greatest({_wil(K.two_sided_z(0.85), '-', 'k', 'm.n')}, 0), 6) AS wilson_wr FROM m LEFT JOIN s USING (rule_id, symbol) JOIN dd USING (symbol)""")
def r_metrics(spark, folder):
    frame = candles(spark, folder)
    days = frame.groupBy("symbol").agg(F.countDistinct(F.to_date("time")).alias("trading_days"))
    out = K.r_metrics(rule_trades(spark, folder, frame=frame), days, ["rule_id", "symbol"])
    return rounded(out.select("rule_id", "symbol", "trades", "max_drawdown_r", "max_consecutive_losses", "per_day", "payoff_ratio", "breakeven_wr", "wilson_wr"))


@query("k10_recent_degradation", f"""{LED}, p AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id) - 1 AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM ledger)
SELECT strategy_id, round(avg(CAST(net_pnl > 0 AS INTEGER)) * 100, 1) AS overall_wr, round(avg(CAST(net_pnl > 0 AS INTEGER)) FILTER (i >= n - least(200, floor(n / 3))) * 100, 1) AS recent_wr FROM p GROUP BY 1""")
def degradation(spark, folder):
    return K.recent_degradation(L.positioned_trades(S.ledger(spark, folder)), recent_rows=200)


@query("k11_breakdown", f"""{LED}, t AS (SELECT *, CASE WHEN hour(entry_time) < 7 THEN 'asia' WHEN hour(entry_time) < 12 THEN 'london' WHEN hour(entry_time) < 17 THEN 'ny_overlap' WHEN hour(entry_time) < 22 THEN 'ny_late' ELSE 'rollover' END AS sess FROM ledger),
l AS (SELECT strategy_id, unnest(['session', 'weekday', 'direction', 'exit_reason', 'regime', 'month']) AS segment, unnest([sess, dayname(entry_time), direction, exit_reason, CAST(regime AS VARCHAR), strftime(entry_time, '%Y-%m')]) AS bucket, net_pnl FROM t)
SELECT strategy_id, segment, bucket, count(*) AS trades, count(*) FILTER (net_pnl > 0) AS wins, round(100 * count(*) FILTER (net_pnl > 0) / count(*), 6) AS win_rate_pct, round(sum(net_pnl), 6) AS net_profit, round({_PF}, 6) AS profit_factor FROM l GROUP BY 1, 2, 3""")
def breakdown(spark, folder):
    t = c("entry_time")
    out = K.breakdown(S.ledger(spark, folder), {
        "session": K.report_session(t), "weekday": F.date_format(t, "EEEE"), "direction": c("direction"), "exit_reason": c("exit_reason"), "regime": c("regime"), "month": F.date_format(t, "yyyy-MM")})
    return rounded(out.drop("average_profit").withColumn("net_profit", F.round("net_profit", 6)))


@query("k13_gates", f"""{LED}, {_EQ}, d AS (SELECT strategy_id, max((peak - equity) / peak * 100) AS dd FROM pk GROUP BY 1), m AS (SELECT strategy_id, avg(CAST(p > 0 AS INTEGER)) AS v FROM (SELECT strategy_id, strftime(exit_time, '%Y-%m') AS k, sum(net_pnl) AS p FROM ledger GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT strategy_id, count(*) AS n, {_PF} AS pf, avg(net_pnl) AS ep FROM ledger GROUP BY 1),
f AS (SELECT strategy_id, concat_ws(',', CASE WHEN n < 30 THEN 'minimum_trades' END, CASE WHEN coalesce(pf, 0) < 1.2 THEN 'profit_factor' END, CASE WHEN ep <= 0 THEN 'positive_expectancy' END, CASE WHEN dd > 12 THEN 'drawdown' END, CASE WHEN v < 0.5 THEN 'chronological_stability' END) AS failed FROM h JOIN d USING (strategy_id) JOIN m USING (strategy_id))
SELECT strategy_id, failed, CASE WHEN failed = '' THEN 'promote' ELSE 'reject' END AS decision FROM f""")
def gates(spark, folder):
    led = S.ledger(spark, folder)
    metrics = K.headline(led).join(K.drawdowns(led, 100_000.0), "strategy_id").join(K.period_stability(led), "strategy_id")
    return K.gate(metrics, K.role_checks("validation")).select("strategy_id", "failed", "decision")


@query("k13_report_policy", f"""{LED}, {_EQ}, d AS (SELECT strategy_id, max((peak - equity) / peak * 100) AS dd FROM pk GROUP BY 1), h AS (SELECT strategy_id, count(*) AS n, {_PF} AS pf, avg(net_pnl) AS ep, sum(net_pnl) AS net FROM ledger GROUP BY 1),
f AS (SELECT strategy_id, concat_ws(',', CASE WHEN n < 100 THEN 'trades' END, CASE WHEN coalesce(pf, 0) < 1.15 THEN 'profit_factor' END, CASE WHEN ep <= 0 THEN 'expected_payoff' END, CASE WHEN net <= 0 THEN 'net_profit' END, CASE WHEN NOT coalesce(dd <= 20, FALSE) THEN 'equity_drawdown' END) AS failed FROM h JOIN d USING (strategy_id))
SELECT strategy_id, failed, CASE WHEN failed = '' THEN 'promote' ELSE 'reject' END AS decision FROM f""")
def report_policy(spark, folder):
    led = S.ledger(spark, folder)
    return K.gate(K.headline(led).join(K.drawdowns(led, 100_000.0), "strategy_id"), K.report_checks()).select("strategy_id", "failed", "decision")


_CAND = """cand AS (SELECT CAST(o_custkey AS VARCHAR) AS candidate, count(*) AS trades, avg(o_totalprice) / 3000 AS win_rate_pct, avg(o_totalprice) / 3300 AS wilson_wr, avg(o_totalprice) / 120000 AS profit_factor, max(o_totalprice) / 25000 AS max_drawdown_r,
  CAST(min(o_orderkey) % 12 AS DOUBLE) AS max_consecutive_losses, count(*) / 25.0 AS per_day, CAST(count(*) * 8 AS DOUBLE) AS test_trades, CAST(count(*) * 4 AS DOUBLE) AS gated_test_trades, min(o_totalprice) / 9000 AS box_test_profit_factor,
  CASE WHEN min(o_orderkey) % 7 > 0 THEN CAST(min(o_orderkey) % 7 AS DOUBLE) / 20 END AS box_test_expectancy_r, CAST(min(o_orderkey) % 5 AS DOUBLE) - 1 AS box_test_wilson_edge, CAST(min(o_orderkey) % 10 AS DOUBLE) / 10 AS time_consistency,
  CAST(max(o_orderkey) % 9 AS DOUBLE) / 10 AS implied_rr, CAST(max(o_orderkey) % 8 AS DOUBLE) / 10 AS composite_score FROM orders GROUP BY 1)"""
_LIMITS = [("win_rate_pct", ">= 48"), ("wilson_wr", f">= {48 * 0.9}"), ("profit_factor", ">= 1.1"), ("test_trades", ">= 60"), *((n, f"{'>=' if kind == 'min' else '<='} {x}") for n, (x, kind) in K.DISCOVERY_BOUNDS.items())]
_fails = lambda hard: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({n} {test}, FALSE) THEN '{n}' END" for n, test in _LIMITS if (n in K.HARD_FILTERS) == hard) + ")"


@query("k13_discovery_filters", f"""WITH {_CAND}, f AS (SELECT candidate, {_fails(True)} AS hard_failed, {_fails(False)} AS soft_failed FROM cand)
SELECT candidate, hard_failed, soft_failed, CASE WHEN hard_failed <> '' OR len(string_split(soft_failed, ',')) > 3 THEN 'drop' WHEN soft_failed <> '' THEN 'marginal' ELSE 'pass' END AS decision FROM f""")
def discovery(spark, folder):
    """Candidates with figures from the orders of each customer, through all hard and soft filters."""
    price, key = c("o_totalprice"), c("o_orderkey")
    mod = lambda value, n: (value % n).cast("double")
    cand = S.table(spark, folder, "orders").groupBy(c("o_custkey").cast("string").alias("candidate")).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(price).alias("avg"), F.max(price).alias("top"), F.min(price).alias("low"), F.min(key).alias("a"), F.max(key).alias("b")).withColumns({
            "win_rate_pct": c("avg") / 3000, "wilson_wr": c("avg") / 3300, "profit_factor": c("avg") / 120000, "max_drawdown_r": c("top") / 25000, "max_consecutive_losses": mod(c("a"), 12), "per_day": c("trades") / 25.0,
            "test_trades": c("trades") * 8.0, "gated_test_trades": c("trades") * 4.0, "box_test_profit_factor": c("low") / 9000, "box_test_expectancy_r": F.when(c("a") % 7 > 0, mod(c("a"), 7) / 20), "box_test_wilson_edge": mod(c("a"), 5) - 1,
            "time_consistency": mod(c("a"), 10) / 10, "implied_rr": mod(c("b"), 9) / 10, "composite_score": mod(c("b"), 8) / 10})
    return K.discovery_filters(cand, 48.0, 1.1, 60.0).select("candidate", "hard_failed", "soft_failed", "decision")


@query("k14_ranking", f"""{LED}, {_EQ}, d AS (SELECT strategy_id, max((peak - equity) / peak * 100) AS dd FROM pk GROUP BY 1), m AS (SELECT strategy_id, avg(CAST(p > 0 AS INTEGER)) AS v FROM (SELECT strategy_id, strftime(exit_time, '%Y-%m') AS k, sum(net_pnl) AS p FROM ledger GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT strategy_id, count(*) AS n, 100 * count(*) FILTER (net_pnl > 0) / count(*) AS wr, {_PF} AS pf, avg(net_pnl) AS ep, avg(net_pnl) / stddev_samp(net_pnl) * sqrt(count(*)) AS sh FROM ledger GROUP BY 1)
SELECT strategy_id, round(40 * greatest(coalesce(pf, 0) - 1, 0) + 12 * coalesce(sh, 0) + 20 * greatest(wr / 100 - 0.45, 0) + 0.04 * ep + 4 * least(n / 250, 1) + 10 * v - 1.2 * dd, 4) AS quant_score, round(pf, 4) AS profit_factor, round(sh, 4) AS trade_sharpe FROM h JOIN d USING (strategy_id) JOIN m USING (strategy_id)""")
def ranking(spark, folder):
    return rounded(K.rank_parents(K.summarize(S.ledger(spark, folder), 100_000.0)).select("strategy_id", "quant_score", "profit_factor", "trade_sharpe"), 4)


@query("k15_required_trades", f"WITH {sql.QUOTES} SELECT symbol, count(DISTINCT CAST(time AS DATE)) AS trading_days, CAST(greatest(1, round_even(count(DISTINCT CAST(time AS DATE)) / 5.0 * 3 * 0.45, 0)) AS BIGINT) AS required_trades FROM bars GROUP BY 1")
def required(spark, folder):
    return K.required_trades(S.quote_bars(spark, folder), 3.0, 0.45)


@query("k16_overview", f"""{LED}, h AS (SELECT strategy_id, count(*) AS n, 100 * count(*) FILTER (net_pnl > 0) / count(*) AS wr, {_PF} AS pf, sum(net_pnl) AS net FROM ledger GROUP BY 1)
SELECT count(*) AS strategies, CAST(sum(n) AS BIGINT) AS trades, round(avg(wr), 6) AS avg_win_rate_pct, round(avg(pf), 6) AS avg_profit_factor, round(max(pf), 6) AS best_profit_factor, round(sum(net), 6) AS net_profit FROM h""")
def overview(spark, folder):
    return rounded(K.overview(K.headline(S.ledger(spark, folder))).withColumn("net_profit", F.round("net_profit", 6)))


@query("k17_group_profile", f"""WITH {CANDLES}, md AS (SELECT grp, bull, count(*) AS n FROM bars GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, bull) = 1)
SELECT CAST(grp AS BIGINT) AS grp, count(*) AS bars, round(quantile_cont(body_pct, 0.5), 6) AS body_pct_median, round(quantile_cont(volume, 0.5), 6) AS volume_median, CAST(any_value(md.bull) AS BIGINT) AS bull_mode FROM bars JOIN md USING (grp) GROUP BY 1""")
def profile(spark, folder):
    return rounded(K.group_profile(candles(spark, folder), "grp", ["body_pct", "volume"], ["bull"]))


# ---- L ----

_N = f"{sql.SUPPLIERS}, nb AS (SELECT symbol, bar_idx, close, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


@query("l1_walk_forward_folds", f"""WITH {_N}, f AS (SELECT *, unnest(range(5)) AS k FROM nb), w AS (SELECT *, k * (n // 5) AS a, CASE WHEN k = 4 THEN n ELSE (k + 1) * (n // 5) END AS b FROM f),
x AS (SELECT *, a - 3 AS te, greatest(0, a - 3 - CAST(round_even((b - a) * (0.7 / 0.3), 0) AS BIGINT)) AS ts FROM w), y AS (SELECT *, CASE WHEN bar_idx >= a AND bar_idx < b THEN 'test' WHEN bar_idx >= ts AND bar_idx < te THEN 'train' END AS role FROM x WHERE te > ts)
SELECT symbol, CAST(k + 1 AS BIGINT) AS fold, role, count(*) AS rows, min(bar_idx) AS first_idx, max(bar_idx) AS last_idx FROM y WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def walk_forward(spark, folder):
    out = L.walk_forward(S.daily_bars(spark, folder, "l_suppkey"), 5, 0.7, 3)
    return rounded(out.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx")))


@query("l2_purged_kfold", f"""WITH {_N}, f AS (SELECT *, unnest(range(4)) AS k FROM nb), w AS (SELECT *, k * (n // 4) + least(k, n % 4) AS a FROM f), x AS (SELECT *, a + n // 4 + CASE WHEN k < n % 4 THEN 1 ELSE 0 END AS b FROM w),
y AS (SELECT *, CASE WHEN bar_idx >= a AND bar_idx < b THEN 'test' WHEN NOT (bar_idx >= b AND bar_idx < b + 5) THEN 'train' END AS role FROM x)
SELECT symbol, CAST(k + 1 AS BIGINT) AS fold, role, count(*) AS rows, round(sum(close), 2) AS total FROM y WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def purged(spark, folder):
    out = L.purged_kfold(S.daily_bars(spark, folder, "l_suppkey"), 4, 5)
    return rounded(out.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("close"), 2).alias("total")))


_BY_FOLD = "PARTITION BY fold, role, strategy_id ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING"
_FOLD_CHECKS = (("minimum_trades", "x.trades >= 10"), ("net_profit_positive", "x.net > 0"), ("profit_factor", "x.pf >= 1.2"), ("sharpe", "x.sh >= 0.5"), ("drawdown", "x.dd <= 15"),
                ("positive_months", "x.pm >= 0.5"), ("concentration", "x.cm <= 65"))


@query("l3_calendar_walk_forward", f"""{LED}, f AS (SELECT k + 1 AS fold, DATE '1995-01-01' + to_months(6 * k) AS a, DATE '1995-01-01' + to_months(6 * k + 24) AS b, DATE '1995-01-01' + to_months(6 * k + 30) AS e FROM (SELECT CAST(unnest(range(100)) AS INTEGER) AS k)
  WHERE DATE '1995-01-01' + to_months(6 * k + 30) <= DATE '2001-08-01'),
pl AS (SELECT fold, CASE WHEN d < b THEN 'train' ELSE 'test' END AS role, l.* FROM (SELECT *, CAST(exit_time AS DATE) AS d FROM ledger) l JOIN f ON d >= a AND d < e), eq AS (SELECT *, 100000 + sum(net_pnl) OVER ({_BY_FOLD}) AS equity FROM pl),
pk AS (SELECT *, greatest(100000, max(equity) OVER ({_BY_FOLD})) AS peak FROM eq), d AS (SELECT fold, role, strategy_id, max((peak - equity) / peak * 100) AS dd, count(*) AS trades, sum(net_pnl) AS net, {_PF} AS pf, avg(net_pnl) / stddev_samp(net_pnl) * sqrt(252) AS sh FROM pk GROUP BY 1, 2, 3),
m AS (SELECT fold, role, strategy_id, avg(CAST(p > 0 AS INTEGER)) AS pm, coalesce(max(abs(p)) * 100 / nullif(abs(sum(p)), 0), 0) AS cm FROM (SELECT fold, role, strategy_id, strftime(exit_time, '%Y-%m') AS k, sum(net_pnl) AS p FROM pl GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
s AS (SELECT *, coalesce(pf, 0) * 1000 + net - dd * 10 AS score FROM d JOIN m USING (fold, role, strategy_id)), best AS (SELECT fold, strategy_id, score FROM s WHERE role = 'train' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, strategy_id DESC) = 1),
g AS (SELECT fold, strategy_id, best.score, x.trades, x.net, concat_ws(',', {", ".join(f"CASE WHEN NOT coalesce({test}, FALSE) THEN '{name}' END" for name, test in _FOLD_CHECKS)}) AS failed FROM best LEFT JOIN (SELECT * FROM s WHERE role = 'test') x USING (fold, strategy_id))
SELECT CAST(fold AS BIGINT) AS fold, strategy_id, round(score, 4) AS train_score, trades, round(net, 4) AS net_profit, failed, CASE WHEN failed = '' THEN 'pass' ELSE 'reject' END AS decision FROM g""")
def calendar_walk_forward(spark, folder):
    folds = L.calendar_folds(date(1995, 1, 1), date(2001, 8, 1))
    out = L.calendar_walk_forward(S.ledger(spark, folder), folds, 100_000.0)
    return rounded(out.select("fold", "strategy_id", "train_score", "trades", "net_profit", "failed", "decision"), 4)


@query("l4_in_out_of_sample", f"""{LED}, s AS (SELECT min(exit_time) AS a, max(exit_time) AS b FROM ledger) SELECT strategy_id, CASE WHEN epoch_us(exit_time) < epoch_us(a) + (epoch_us(b) - epoch_us(a)) * 0.7 THEN 'is' ELSE 'oos' END AS sample,
  count(*) AS trades, round(sum(net_pnl), 4) AS net FROM ledger, s GROUP BY 1, 2""")
def in_out(spark, folder):
    out = L.in_out_of_sample(S.ledger(spark, folder))
    return rounded(out.groupBy("strategy_id", "sample").agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net")), 4)


@query("l5_stability_pass_rate", f"""{LED}, q AS (SELECT strategy_id, regime, count(*) AS n, {_PF} AS pf FROM ledger GROUP BY 1, 2) SELECT strategy_id, count(*) AS samples, count(*) FILTER (pf >= 1.02) AS pass_count, round(avg(CAST(pf >= 1.02 AS INTEGER)), 6) AS pass_rate,
  CASE WHEN avg(CAST(pf >= 1.02 AS INTEGER)) >= 0.4 THEN 'pass' ELSE 'reject' END AS decision FROM q GROUP BY 1""")
def stability_rate(spark, folder):
    variants = K.gate(K.headline(S.ledger(spark, folder), ["strategy_id", "regime"]), {"profit_factor": c("profit_factor") >= 1.02}, accept="pass")
    return rounded(L.pass_rate(variants, 0.4, ["strategy_id"]))


@query("l6_deflated_sharpe", f"""{LED}, s AS (SELECT strategy_id, CAST(count(*) AS DOUBLE) AS t, avg(net_pnl) AS m, stddev_samp(net_pnl) AS sd FROM ledger GROUP BY 1),
d AS (SELECT strategy_id, any_value(t) AS t, any_value(m / sd) AS sr, avg(pow(net_pnl - m, 3)) / pow(avg(pow(net_pnl - m, 2)), 1.5) AS g1, avg(pow(net_pnl - m, 4)) / pow(avg(pow(net_pnl - m, 2)), 2) - 3 AS g2 FROM ledger JOIN s USING (strategy_id) GROUP BY 1),
x AS (SELECT strategy_id, t, sr, sqrt(t * (t - 1)) / (t - 2) * g1 AS sk, (t - 1) / ((t - 2) * (t - 3)) * ((t + 1) * g2 + 6) AS ku, sqrt(1 / t) * {L.expected_max_normal(100)} AS sr0 FROM d)
SELECT strategy_id, CAST(t AS BIGINT) AS n_obs, round(sr, 6) AS observed_sr, round(sk, 6) AS skew, round(ku, 6) AS kurtosis, round(sr0, 6) AS benchmark_sr, round((sr - sr0) * sqrt(t - 1) / sqrt(1 - sk * sr + (ku + 2) / 4 * sr * sr), 6) AS z FROM x""")
def deflated(spark, folder):
    return rounded(L.deflated_sharpe(S.ledger(spark, folder), "net_pnl", 100).drop("deflated_sr"))


@query("l6_deflated_probability")
def deflated_probability(spark, folder):
    return rounded(L.deflated_sharpe(S.ledger(spark, folder), "net_pnl", 100).select("strategy_id", "z", "deflated_sr"))


def _monthly(spark, folder):
    led = S.ledger(spark, folder)
    months = (F.year("exit_time") - 1995) * 12 + F.month("exit_time") - 1
    return led.withColumn("config_id", F.concat_ws("/", "strategy_id", "regime")).groupBy("config_id", months.alias("t_idx")).agg(F.sum("net_pnl").alias("perf"))


_PBO = f"""{LED}, p AS (SELECT strategy_id || '/' || regime AS cfg, (year(exit_time) - 1995) * 12 + month(exit_time) - 1 AS t, sum(net_pnl) AS v FROM ledger GROUP BY 1, 2), nn AS (SELECT max(t) + 1 AS n FROM p),
b AS (SELECT cfg, CASE WHEN t < (n % 6) * (n // 6 + 1) THEN t // (n // 6 + 1) ELSE n % 6 + (t - (n % 6) * (n // 6 + 1)) // (n // 6) END AS part, v FROM p, nn), s AS (SELECT cfg, part, sum(v) AS s, count(*) AS k FROM b GROUP BY 1, 2),
m AS (SELECT mask FROM range(64) t(mask) WHERE bit_count(CAST(mask AS INTEGER)) = 3),
x AS (SELECT mask, cfg, sum(s) FILTER ((mask >> part) & 1 = 1) / sum(k) FILTER ((mask >> part) & 1 = 1) AS i, sum(s) FILTER ((mask >> part) & 1 = 0) / sum(k) FILTER ((mask >> part) & 1 = 0) AS o FROM s, m GROUP BY 1, 2),
ch AS (SELECT mask, arg_max(cfg, i) AS cfg, arg_max(o, i) AS o FROM x GROUP BY 1), rk AS (SELECT x.mask, any_value(ch.cfg) AS champion, (count(*) FILTER (x.o < ch.o) + (count(*) FILTER (x.o = ch.o) + 1) / 2) / (count(*) + 1) AS w FROM x JOIN ch USING (mask) GROUP BY 1)"""


@query("l7_overfitting_logits", f"{_PBO} SELECT mask, champion, round(ln(w / (1 - w)), 6) AS logit FROM rk")
def logits(spark, folder):
    return rounded(L.overfitting_logits(_monthly(spark, folder), 6))


@query("l7_overfitting_probability", f"{_PBO} SELECT count(*) AS combinations, round(avg(CAST(w <= 0.5 AS INTEGER)), 6) AS pbo FROM rk")
def pbo(spark, folder):
    return rounded(L.overfitting_probability(L.overfitting_logits(_monthly(spark, folder), 6)))


@query("l8_sign_permutation", f"""{LED}, p AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id) - 1 AS i FROM ledger), b AS (SELECT strategy_id, i // 5 AS b, sum(gross_pnl) AS g FROM p GROUP BY 1, 2),
t AS (SELECT strategy_id, count(*) AS n, sum(net_pnl) AS obs, sum(commission + swap) AS c FROM ledger GROUP BY 1),
d AS (SELECT strategy_id, k, sum(g * CASE WHEN ((k * 7919 + b * 104729 + k * b * 31 + 42) % 1009) % 2 = 0 THEN -1 ELSE 1 END) AS v FROM b, range(200) r(k) GROUP BY 1, 2), x AS (SELECT d.strategy_id, n, obs, v - c AS v FROM d JOIN t USING (strategy_id))
SELECT strategy_id, n AS trades, round(obs, 2) AS observed_net_profit, round(avg(v), 2) AS null_mean, round(stddev_samp(v), 2) AS null_std, round(quantile_cont(v, 0.95), 2) AS null_p95, round((count(*) FILTER (v >= obs) + 1) / (count(*) + 1), 6) AS p_value FROM x GROUP BY 1, 2, 3""")
def permutation(spark, folder):
    out = L.sign_permutation(L.positioned_trades(S.ledger(spark, folder)), 200, signs="arithmetic")
    return out.select("strategy_id", "trades", *[F.round(n, 2).alias(n) for n in ("observed_net_profit", "null_mean", "null_std", "null_p95")], F.round("p_value", 6).alias("p_value"))


@query("l9_fold_report", f"""{LED}, p AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id) AS i FROM ledger), q AS (SELECT *, ntile(5) OVER (PARTITION BY strategy_id ORDER BY i) AS fold FROM p)
SELECT strategy_id, CAST(fold AS BIGINT) AS fold, min(exit_time) AS first_exit, max(exit_time) AS last_exit, count(*) AS trades, round(sum(net_pnl), 6) AS net_profit, round({_PF}, 6) AS profit_factor, round(100 * avg(CAST(net_pnl > 0 AS INTEGER)), 6) AS win_rate_pct FROM q GROUP BY 1, 2""")
def fold_report(spark, folder):
    report, _ = L.robustness(L.positioned_trades(S.ledger(spark, folder)), permutations=100)
    out = report.drop("permutation_p_value").withColumn("net_profit", F.round("net_profit", 6))
    return rounded(out.withColumn("fold", c("fold").cast("long")))


@query("l9_robustness_verdict")
def robustness_verdict(spark, folder):
    _, verdict = L.robustness(L.positioned_trades(S.ledger(spark, folder)), permutations=200)
    return rounded(verdict.select("strategy_id", "p_value", "positive_folds", "significant_folds", "failed", "decision"))


@query("l10_rule_transfer", f"""{TRADES_SQL}, ps AS (SELECT rule_id, symbol, count(*) AS n, avg(booked) AS e FROM trades GROUP BY 1, 2), ok AS (SELECT * FROM ps WHERE n >= 5 AND e > 0), ns AS (SELECT count(DISTINCT symbol) AS n FROM bars)
SELECT rule_id, count(*) AS symbols_passed, round(count(*) / any_value(ns.n) * least(avg(e), 1) * CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_pop(e) / avg(e)) ELSE 1 END, 4) AS generalization_score FROM ok, ns GROUP BY 1 HAVING count(*) >= 2""")
def transfer(spark, folder):
    trades = rule_trades(spark, folder)
    per = trades.groupBy("rule_id", "symbol").agg(F.count(F.lit(1)).alias("trades"), F.avg("booked_r").alias("expectancy_r"))
    symbols = S.table(spark, folder, "lineitem").agg(F.countDistinct("l_suppkey")).first()[0]
    return L.transfer(per, symbols)


_SC = f"{LED}, s AS (SELECT strategy_id, (trade_id % 97) / 100 AS p_win, net_pnl / initial_risk AS rr FROM ledger)"


@query("l11_threshold_choice", f"""{_SC}, g AS (SELECT strategy_id, t.t AS threshold, count(*) FILTER (p_win >= t.t) AS kept, count(*) AS n, sum(CASE WHEN p_win >= t.t AND rr > 0 THEN rr ELSE 0 END) / nullif(sum(CASE WHEN p_win >= t.t AND rr <= 0 THEN -rr ELSE 0 END), 0) AS pf FROM s, (SELECT unnest({L.THRESHOLDS}::DOUBLE[]) AS t) t GROUP BY 1, 2)
SELECT strategy_id, threshold, round(pf, 6) AS train_profit_factor FROM g WHERE kept >= greatest(40, n * 0.3) QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY pf DESC, threshold) = 1""")
def threshold(spark, folder):
    scored = S.ledger(spark, folder).select("strategy_id", ((c("trade_id") % 97) / 100).alias("p_win"), (c("net_pnl") / c("initial_risk")).alias("rr"))
    return rounded(L.choose_threshold(L.threshold_metrics(scored, keys=["strategy_id"]), keys=["strategy_id"]))


# ---- M and the rolling-start race ----

_DENSE = f"""{LED}, d AS (SELECT strategy_id, CAST(exit_time AS DATE) AS day, sum(net_pnl) AS pnl FROM ledger GROUP BY 1, 2), sp AS (SELECT strategy_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
gg AS (SELECT strategy_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sp), op AS (SELECT DISTINCT strategy_id, CAST(entry_time AS DATE) AS day, 1 AS o FROM ledger),
dn AS (SELECT strategy_id, day, coalesce(pnl, 0) AS pnl, coalesce(o, 0) AS o, row_number() OVER (PARTITION BY strategy_id ORDER BY day) - 1 AS i FROM gg LEFT JOIN d USING (strategy_id, day) LEFT JOIN op USING (strategy_id, day)), nn AS (SELECT strategy_id, count(*) AS n FROM dn GROUP BY 1)"""
_PATHS = f"""{_DENSE}, ix AS (SELECT strategy_id, p, s, (p * 7919 + (s // 5) * 104729 + p * (s // 5) * 17 + 42 * 31) % (n - 5 + 1) + s % 5 AS i FROM nn, range(100) t(p), range(40) u(s)),
pt AS (SELECT ix.strategy_id, p, s, dn.pnl, dn.o FROM ix JOIN dn USING (strategy_id, i))"""


def _paths(spark, folder, **options):
    packed = M.packed_series(dense_daily_pnl(S.ledger(spark, folder)))
    return M.bootstrap_paths(packed, 100, 40, 5, draw="arithmetic", **options)


@query("m1_bootstrap_paths", f"{_PATHS} SELECT strategy_id, p AS path_id, CAST(s AS BIGINT) AS step, round(pnl, 6) AS pnl, o = 1 AS opened FROM pt")
def bootstrap(spark, folder):
    return rounded(M.path_steps(_paths(spark, folder)).drop("scale"))


@query("m2_long_run_paths", f"""{_PATHS}, e AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY strategy_id, p ORDER BY s) AS raw FROM pt), ru AS (SELECT strategy_id, p, min(s) FILTER (raw <= 9000) AS r FROM e GROUP BY 1, 2),
f AS (SELECT e.*, r, CASE WHEN r IS NOT NULL AND s >= r THEN 9000 ELSE raw END AS eq, raw - pnl AS prev FROM e JOIN ru USING (strategy_id, p)), g AS (SELECT *, greatest(10000, max(eq) OVER (PARTITION BY strategy_id, p ORDER BY s)) AS pk FROM f)
SELECT strategy_id, p AS path_id, round(arg_max(eq, s), 6) AS final_equity, round(greatest(max((pk - eq) / pk), 0), 6) AS max_drawdown, any_value(r) + 1 AS ruin_step,
  round(CASE WHEN count(*) FILTER (r IS NULL OR s < r) > 1 THEN avg(pnl / prev) FILTER (r IS NULL OR s < r) / stddev_pop(pnl / prev) FILTER (r IS NULL OR s < r) * sqrt(252) ELSE 0 END, 4) AS sharpe FROM g GROUP BY 1, 2""")
def long_run(spark, folder):
    out = M.long_run(_paths(spark, folder), 10_000.0, 0.1)
    return out.select("strategy_id", "path_id", F.round("final_equity", 6).alias("final_equity"), F.round("max_drawdown", 6).alias("max_drawdown"), c("ruin_step").cast("long").alias("ruin_step"), F.round("sharpe", 4).alias("sharpe"))


_RACE = f"""{_PATHS}, e AS (SELECT *, sum(pnl) OVER w AS cum, sum(o) OVER w AS tr FROM pt WINDOW w AS (PARTITION BY strategy_id, p ORDER BY s)),
ev AS (SELECT strategy_id, p, min(s) FILTER (pnl < -250 OR 10000 + cum < 9000) AS br, min(s) FILTER (cum >= 500 AND tr >= 4) AS ps, min(s) FILTER (pnl < -250) AS dl FROM e GROUP BY 1, 2),
rc AS (SELECT strategy_id, p, CASE WHEN ps IS NOT NULL AND ps < coalesce(br, 999) THEN 'pass' WHEN br IS NOT NULL THEN CASE WHEN dl = br THEN 'daily_dd' ELSE 'total_dd' END ELSE 'profit_shortfall' END AS outcome,
  CASE WHEN ps IS NOT NULL AND ps < coalesce(br, 999) THEN ps + 1 WHEN br IS NOT NULL THEN br + 1 ELSE 40 END AS days FROM ev)"""


def _race(spark, folder, **options):
    return M.target_race(_paths(spark, folder, **options), 10_000.0, 0.05, 0.025, 0.1, 4)


@query("m3_target_race", f"{_RACE} SELECT strategy_id, p AS path_id, outcome, days FROM rc")
def race(spark, folder):
    return rounded(_race(spark, folder).select("strategy_id", "path_id", "outcome", "days"))


@query("m4_race_summary", f"""{_RACE} SELECT strategy_id, count(*) AS paths, count(*) FILTER (outcome = 'pass') AS passed, round(count(*) FILTER (outcome = 'pass') / count(*) * 100, 6) AS pass_rate,
  round(count(*) FILTER (outcome = 'daily_dd') / nullif(count(*) FILTER (outcome <> 'pass'), 0) * 100, 6) AS daily_dd_pct, round(avg(days) FILTER (outcome = 'pass'), 6) AS avg_days,
  round(quantile_cont(days, 0.1) FILTER (outcome = 'pass'), 6) AS days_p10, round(quantile_cont(days, 0.5) FILTER (outcome = 'pass'), 6) AS days_p50, round(quantile_cont(days, 0.9) FILTER (outcome = 'pass'), 6) AS days_p90 FROM rc GROUP BY 1""")
def race_summary(spark, folder):
    return rounded(M.race_summary(_race(spark, folder)).select("strategy_id", "paths", "passed", "pass_rate", "daily_dd_pct", "avg_days", "days_p10", "days_p50", "days_p90"))


@query("m3_trailing_race_with_concentration")
def trailing_race(spark, folder):
    out = M.target_race(_paths(spark, folder), 10_000.0, 0.05, 0.025, 0.1, 4, trailing=True, largest_day_share=0.5)
    return rounded(out.select("strategy_id", "path_id", "outcome", "days", "trading_days", "final_equity"), 4)


@query("m5_equity_fan", f"""{_PATHS}, e AS (SELECT strategy_id, p, s, 10000 + sum(pnl) OVER (PARTITION BY strategy_id, p ORDER BY s) AS eq FROM pt)
SELECT strategy_id, CAST(s AS BIGINT) AS step, {', '.join(f'round(quantile_cont(eq, {q / 100}), 8) AS p{q}' for q in (5, 25, 50, 75, 95))} FROM e GROUP BY 1, 2""")
def fan(spark, folder):
    return rounded(M.equity_fan(_paths(spark, folder), 10_000.0), 8)


@query("m6_ruin_by_horizon", f"""{_PATHS}, e AS (SELECT strategy_id, p, s, 10000 + sum(pnl) OVER (PARTITION BY strategy_id, p ORDER BY s) AS eq FROM pt), ru AS (SELECT strategy_id, p, min(s) FILTER (eq <= 9500) + 1 AS r FROM e GROUP BY 1, 2)
SELECT strategy_id, CAST(h AS BIGINT) AS horizon_days, round(avg(CAST(coalesce(r <= h, FALSE) AS INTEGER)), 6) AS ruin_probability FROM ru, (SELECT unnest([5, 10, 20, 40]) AS h) GROUP BY 1, 2""")
def ruin(spark, folder):
    return rounded(M.ruin_by_horizon(M.long_run(_paths(spark, folder), 10_000.0, 0.05), [5, 10, 20, 40]))


_SWEEP = _RACE.replace("pt AS (SELECT ix.strategy_id, p, s, dn.pnl, dn.o FROM ix", "pt AS (SELECT ix.strategy_id || '@' || sc.sc AS strategy_id, ix.strategy_id AS sid, sc.sc AS scale, p, s, dn.pnl * sc.sc AS pnl, dn.o FROM ix CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0, 2.0]::DOUBLE[]) AS sc) sc").replace("JOIN dn USING (strategy_id, i)", "JOIN dn ON dn.strategy_id = ix.strategy_id AND dn.i = ix.i")


@query("m7_size_sweep", f"""{_SWEEP} SELECT split_part(strategy_id, '@', 1) AS strategy_id, CAST(split_part(strategy_id, '@', 2) AS DOUBLE) AS scale, count(*) AS paths, count(*) FILTER (outcome = 'pass') AS passed,
  round(count(*) FILTER (outcome = 'pass') / count(*) * 100, 4) AS pass_rate, round(coalesce(avg(days) FILTER (outcome = 'pass'), 0), 4) AS avg_days, round(quantile_cont(days, 0.5) FILTER (outcome = 'pass'), 4) AS days_p50 FROM rc GROUP BY 1, 2""")
def size_sweep(spark, folder):
    out = M.race_summary(_race(spark, folder, scales=[0.25, 0.5, 1.0, 2.0]))
    return rounded(out.select("strategy_id", "scale", "paths", "passed", "pass_rate", "avg_days", "days_p50"), 4)


@query("m8_kelly", f"{_DENSE} SELECT strategy_id, round(avg(pnl) / var_pop(pnl), 9) AS kelly, round(avg(pnl) * avg(pnl) / (2 * var_pop(pnl)), 9) AS expected_growth FROM dn GROUP BY 1")
def kelly(spark, folder):
    return rounded(M.kelly(dense_daily_pnl(S.ledger(spark, folder))).select("strategy_id", "kelly", "expected_growth"), 9)


@query("m9_worst_streaks", f"""{_PATHS}, e AS (SELECT strategy_id, p, s, sum(pnl) OVER (PARTITION BY strategy_id, p ORDER BY s) AS eq FROM pt), t AS (SELECT *, max(eq) OVER (PARTITION BY strategy_id, p ORDER BY s) AS top FROM e), lo AS (SELECT strategy_id, p, min(eq - top) AS l FROM t GROUP BY 1, 2)
SELECT strategy_id, round(quantile_cont(l, 0.05), 4) AS p95_streak, quantile_cont(l, 0.05) < -500 AS would_breach FROM lo GROUP BY 1""")
def worst(spark, folder):
    return rounded(M.worst_streaks(_paths(spark, folder), 500.0), 4)


_GRID = "g AS (SELECT DISTINCT strategy_id, a.a AS from_state, b.b AS to_state FROM ledger, range(5) a(a), range(5) b(b))"
_MAT = """SELECT strategy_id, from_state, to_state, coalesce(n, 0) AS n, round(CASE WHEN sum(coalesce(n, 0)) OVER w > 0 THEN coalesce(n, 0) / sum(coalesce(n, 0)) OVER w ELSE 0.2 END, 6) AS probability
FROM g LEFT JOIN k USING (strategy_id, from_state, to_state) WINDOW w AS (PARTITION BY strategy_id, from_state)"""


@query("m10_regime_transitions", f"""{LED}, {_GRID}, dm AS (SELECT strategy_id, CAST(exit_time AS DATE) AS d, regime FROM ledger GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY strategy_id, CAST(exit_time AS DATE) ORDER BY count(*) DESC, regime) = 1),
l AS (SELECT strategy_id, CAST(regime AS BIGINT) AS from_state, CAST(lead(regime) OVER (PARTITION BY strategy_id ORDER BY d) AS BIGINT) AS to_state FROM dm), k AS (SELECT *, count(*) AS n FROM l WHERE to_state IS NOT NULL GROUP BY ALL) {_MAT}""")
def transitions(spark, folder):
    return rounded(M.regime_transitions(S.ledger(spark, folder)))


@query("m11_trade_transitions", f"""{LED}, {_GRID}, l AS (SELECT strategy_id, CAST(regime AS BIGINT) AS from_state, CAST(lead(regime) OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id) AS BIGINT) AS to_state FROM ledger),
k AS (SELECT *, count(*) AS n FROM l WHERE to_state IS NOT NULL GROUP BY ALL) {_MAT}""")
def trade_transitions(spark, folder):
    return rounded(M.trade_transitions(L.positioned_trades(S.ledger(spark, folder))))


@query("m11_regime_shares_and_pools", f"""{LED}, dm AS (SELECT strategy_id, CAST(exit_time AS DATE) AS day, regime FROM ledger GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY strategy_id, CAST(exit_time AS DATE) ORDER BY count(*) DESC, regime) = 1),
p AS (SELECT strategy_id, CAST(exit_time AS DATE) AS day, sum(net_pnl) AS pnl FROM ledger GROUP BY 1, 2) SELECT strategy_id, CAST(regime AS BIGINT) AS regime, count(*) AS days, round(avg(pnl), 4) AS mean_pnl, round(min(pnl), 4) AS worst FROM dm JOIN p USING (strategy_id, day) GROUP BY 1, 2""")
def pools(spark, folder):
    out = M.regime_pools(S.ledger(spark, folder)).groupBy("strategy_id", "regime").agg(F.count(F.lit(1)).alias("days"), F.avg("pnl").alias("mean_pnl"), F.min("pnl").alias("worst"))
    return rounded(out, 4)


@query("m11_empirical_shares", f"{LED} SELECT strategy_id, CAST(regime AS BIGINT) AS regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY strategy_id), 6) AS share FROM ledger GROUP BY 1, 2")
def shares(spark, folder):
    return rounded(M.empirical_shares(S.ledger(spark, folder)))


@query("m12_stationary_shares")
def stationary(spark, folder):
    """Long-run regime shares of each strategy's transition matrix, five rows per strategy."""
    rows = M.regime_transitions(S.ledger(spark, folder)).orderBy("strategy_id", "from_state", "to_state").collect()
    out = []
    for name in sorted({row["strategy_id"] for row in rows}):
        cells = [row["probability"] for row in rows if row["strategy_id"] == name]
        out += [(name, i, round(x, 6)) for i, x in enumerate(M.stationary([cells[i:i + 5] for i in range(0, 25, 5)]))]
    return spark.createDataFrame(out, "strategy_id string, regime int, share double")


@query("m13_histogram", f"{LED} SELECT strategy_id, CAST(CASE WHEN net_pnl < -250 THEN 0 WHEN net_pnl >= 250 THEN 21 ELSE floor((net_pnl + 250) / 25) + 1 END AS BIGINT) AS bin, count(*) AS n FROM ledger GROUP BY 1, 2")
def histogram(spark, folder):
    return rounded(M.histogram(S.ledger(spark, folder), "net_pnl", -250, 250, 20))


@query("j13_rolling_start_race")
def rolling_race(spark, folder):
    out = M.rolling_start_race(S.ledger(spark, folder), [0.005, 0.01], [2.0, 4.0], [1, 3], every_days=7)
    return rounded(out.select("strategy_id", "start_day", "risk", "daily_stop_pct", "max_trades_per_day", "status", "trades_taken", "ending_equity", "days_to_target"), 4)


_ONE = f"""WITH RECURSIVE {sql.LEDGER}, cl AS (SELECT strategy_id, CAST(entry_time AS DATE) AS d, entry_time, trade_id, net_pnl / initial_risk AS r FROM ledger), fk AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY strategy_id, d ORDER BY entry_time, trade_id) = 1),
sp AS (SELECT strategy_id, min(d) AS a, max(d) AS b FROM cl GROUP BY 1), ss AS (SELECT strategy_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(greatest(b - 30, a) AS TIMESTAMP), INTERVAL 14 DAY)) AS DATE) AS s FROM sp),
w AS (SELECT ss.strategy_id, s, fk.d, r, row_number() OVER (PARTITION BY ss.strategy_id, s ORDER BY d) AS k FROM ss JOIN fk ON fk.strategy_id = ss.strategy_id AND d >= s AND d < s + 30),
st AS (SELECT strategy_id, s, 0 AS k, 100000.0::DOUBLE AS eq, 100000.0::DOUBLE AS pk, 0.0::DOUBLE AS dd, NULL::VARCHAR AS e, 0 AS taken, NULL::DATE AS hd FROM ss UNION ALL
  SELECT q.strategy_id, q.s, q.k + 1, q.eq * (1 + 0.01 * w.r), greatest(q.pk, q.eq * (1 + 0.01 * w.r)), greatest(q.dd, (greatest(q.pk, q.eq * (1 + 0.01 * w.r)) - q.eq * (1 + 0.01 * w.r)) / greatest(q.pk, q.eq * (1 + 0.01 * w.r)) * 100),
    CASE WHEN q.eq * (1 + 0.01 * w.r) >= 110000 THEN 'pass' WHEN q.eq * (1 + 0.01 * w.r) <= 90000 THEN 'max_loss' WHEN q.eq - q.eq * (1 + 0.01 * w.r) >= 5000 THEN 'daily_loss' END, q.taken + 1, w.d
  FROM st q JOIN w ON w.strategy_id = q.strategy_id AND w.s = q.s AND w.k = q.k + 1 WHERE q.e IS NULL),
en AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, s ORDER BY k DESC) AS z FROM st),
atts AS (SELECT strategy_id, s, CASE WHEN k = 0 THEN 'no_trades' ELSE coalesce(e, 'timeout') END AS status, eq, dd, taken, CASE WHEN e = 'pass' THEN CAST(hd - s AS DOUBLE) END AS days FROM en WHERE z = 1)"""


def _attempts(spark, folder):
    return M.rolling_start_race(S.ledger(spark, folder), [0.01], [50.0], [1], every_days=14)


@query("j13_race_attempts", f"{_ONE} SELECT strategy_id, s AS start_day, status, CAST(taken AS BIGINT) AS trades_taken, round(eq, 4) AS ending_equity, round(dd, 6) AS max_drawdown_pct, days AS days_to_target FROM atts")
def race_attempts(spark, folder):
    out = _attempts(spark, folder)
    return rounded(out.select("strategy_id", "start_day", "status", "trades_taken", F.round("ending_equity", 4).alias("ending_equity"), "max_drawdown_pct", "days_to_target"))


@query("j14_race_attempt_summary", f"""{_ONE}, mo AS (SELECT strategy_id, max(n) / sum(n) AS best FROM (SELECT strategy_id, strftime(s, '%Y-%m') AS m, count(*) AS n FROM atts WHERE status = 'pass' GROUP BY 1, 2) GROUP BY 1)
SELECT strategy_id, count(*) AS start_windows, count(*) FILTER (status <> 'no_trades') AS active_starts, count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status IN ('max_loss', 'daily_loss')) AS fail_count, count(*) FILTER (status = 'timeout') AS timeout_count,
  round(quantile_cont(days, 0.5), 6) AS median_days_to_target, round(quantile_cont(taken, 0.5) FILTER (status = 'pass'), 6) AS median_trades_to_target, round(avg(dd), 6) AS mean_max_drawdown_pct, round(any_value(best), 6) AS best_month_pass_share FROM atts LEFT JOIN mo USING (strategy_id) GROUP BY 1""")
def attempt_summary(spark, folder):
    out = M.attempt_summary(_attempts(spark, folder), ["strategy_id"])
    return rounded(out.select("strategy_id", "start_windows", "active_starts", "pass_count", "fail_count", "timeout_count", "median_days_to_target", "median_trades_to_target", "mean_max_drawdown_pct", "best_month_pass_share"))


# ---- N ----

_SUP_RULES = """rl AS (SELECT 's' || l_suppkey AS rule_id, unnest(['quantity', 'discount', 'tax']) AS "column", unnest([min(l_quantity) + l_suppkey % 5, min(l_discount) + l_suppkey % 3 * 0.01, min(l_tax)]) AS lo, unnest([max(l_quantity) - l_suppkey % 7, max(l_discount), max(l_tax) - l_suppkey % 4 * 0.01]) AS hi FROM lineitem GROUP BY l_suppkey),
rules AS (SELECT * FROM rl WHERE NOT ("column" = 'tax' AND CAST(substr(rule_id, 2) AS BIGINT) % 2 = 0) AND NOT ("column" = 'discount' AND CAST(substr(rule_id, 2) AS BIGINT) % 3 = 0))"""


def _supplier_rules(spark, folder):
    """One box per supplier from the ranges of its line items; every second or third lacks a column."""
    k = c("l_suppkey")
    base = S.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        *[f(n).alias(f"{p}_{n}") for n in ("l_quantity", "l_discount", "l_tax") for f, p in ((F.min, "a"), (F.max, "b"))])
    item = lambda name, lo, hi: F.struct(F.lit(name).alias("column"), lo.alias("lo"), hi.alias("hi"))
    boxes = F.array(item("quantity", c("a_l_quantity") + k % 5, c("b_l_quantity") - k % 7), item("discount", c("a_l_discount") + k % 3 * 0.01, c("b_l_discount")),
                    item("tax", c("a_l_tax"), c("b_l_tax") - k % 4 * 0.01))
    out = base.select(F.concat(F.lit("s"), k.cast("string")).alias("rule_id"), "l_suppkey", F.explode(boxes).alias("_x")).select("rule_id", "l_suppkey", "_x.*")
    return out.filter(~((c("column") == "tax") & (k % 2 == 0)) & ~((c("column") == "discount") & (k % 3 == 0))).drop("l_suppkey")


@query("n1_rule_similarity", f"""WITH {_SUP_RULES}, sz AS (SELECT rule_id, count(*) AS k FROM rules GROUP BY 1), pr AS (SELECT a.rule_id AS a_rule_id, b.rule_id AS b_rule_id, count(*) AS shared,
  avg(CASE WHEN greatest(a.hi, b.hi) - least(a.lo, b.lo) > 0 THEN greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) ELSE 1 END) AS iou FROM rules a JOIN rules b ON a."column" = b."column" AND a.rule_id < b.rule_id GROUP BY 1, 2)
SELECT a_rule_id, b_rule_id, shared, round(iou, 6) AS avg_iou, round(shared / (x.k + y.k - shared), 6) AS jaccard, round(shared / (x.k + y.k - shared) * (0.5 + 0.5 * iou), 6) AS score FROM pr JOIN sz x ON x.rule_id = a_rule_id JOIN sz y ON y.rule_id = b_rule_id""")
def rule_similarity(spark, folder):
    return N.rule_similarity(_supplier_rules(spark, folder), 6)


_MANY = """m AS (SELECT i, CAST(i AS VARCHAR) AS rule_id, (i * 37 % 100) / 100.0 AS b0, (i * 53 % 90) / 100.0 AS u0, CAST(i * 17 % 60 AS DOUBLE) AS w0 FROM range(2000) t(i)),
rules AS (SELECT rule_id, unnest(['body_pct', 'uwk_pct', 'volume']) AS "column", unnest([b0, u0, w0]) AS lo, unnest([b0 + 0.15, u0 + 0.25, w0 + 25]) AS hi FROM m)"""


@query("n1_similar_rules", f"""WITH {_MANY}, pr AS (SELECT a.rule_id AS a_rule_id, b.rule_id AS b_rule_id, count(*) AS shared,
  avg(CASE WHEN greatest(a.hi, b.hi) - least(a.lo, b.lo) > 0 THEN greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) ELSE 1 END) AS iou FROM rules a JOIN rules b ON a."column" = b."column" AND a.rule_id < b.rule_id GROUP BY 1, 2)
SELECT a_rule_id, b_rule_id, shared, round(iou, 6) AS avg_iou, round(0.5 + 0.5 * iou, 6) AS score FROM pr WHERE 0.5 + 0.5 * iou >= 0.8 - 1e-12""")
def similar_rules(spark, folder):
    """Two thousand boxes over the same columns: those that overlap enough, without meeting all pairs."""
    return rounded(N.similar_rules(many_rules(spark, 2000), 0.8).select("a_rule_id", "b_rule_id", "shared", "avg_iou", "score"))


@query("n2_similar_trade_months", """WITH m AS (SELECT DISTINCT o_custkey AS id, strftime(o_orderdate, '%Y-%m') AS token FROM orders), s AS (SELECT id, string_agg(token, ',' ORDER BY token) AS k, count(*) AS n FROM m GROUP BY 1),
r AS (SELECT min(id) AS id, any_value(n) AS n FROM s GROUP BY k), sh AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM m a JOIN m b ON a.token = b.token AND a.id < b.id WHERE a.id IN (SELECT id FROM r) AND b.id IN (SELECT id FROM r) GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS score FROM sh JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE shared / (x.n + y.n - shared) >= 0.3 - 1e-12""")
def similar_months(spark, folder):
    """Customers that trade in the same months, Jaccard of 0.3 and more; customers with equal months stand as one."""
    members = S.table(spark, folder, "orders").select(c("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("token"))
    return rounded(N.similar_sets(members, 0.3).select("a", "b", "shared", "score"))


_TS = f"""{LED}, t AS (SELECT DISTINCT strategy_id, entry_time FROM ledger), n AS (SELECT strategy_id, count(*) AS n FROM t GROUP BY 1), sh AS (SELECT a.strategy_id AS a, b.strategy_id AS b, count(*) AS shared FROM t a JOIN t b ON a.entry_time = b.entry_time AND a.strategy_id < b.strategy_id GROUP BY 1, 2),
ts AS (SELECT a, b, shared, x.n AS trades_a, y.n AS trades_b, shared / (x.n + y.n - shared) AS score FROM sh JOIN n x ON x.strategy_id = a JOIN n y ON y.strategy_id = b)"""


@query("n2_trade_similarity", f"{_TS} SELECT a, b, shared, trades_a, trades_b, round(score, 6) AS score FROM ts")
def trade_similarity(spark, folder):
    return rounded(N.trade_similarity(S.ledger(spark, folder)))


@query("n3_best_match", f"{_TS}, d AS (SELECT a AS id, b AS other, score FROM ts UNION ALL SELECT b, a, score FROM ts) SELECT id, other, round(score, 6) AS score FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) = 1")
def best_match(spark, folder):
    return rounded(N.best_match(N.trade_similarity(S.ledger(spark, folder))))


_OV = f"WITH {CANDLES}, {_RULE_SQL}, n AS (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1), sh AS (SELECT a.rule_id AS a, b.rule_id AS b, count(*) AS shared FROM hits a JOIN hits b USING (symbol, bar_idx) WHERE a.rule_id <> b.rule_id GROUP BY 1, 2), ov AS (SELECT a, b, shared, shared / n AS overlap, n FROM sh JOIN n ON rule_id = a)"


@query("n4_group_overlap", f"{_OV} SELECT a, b, shared, round(overlap, 6) AS overlap FROM ov")
def overlap(spark, folder):
    return rounded(N.group_overlap(I.match_rules(candles(spark, folder), rule_tables(spark)[0])))


@query("n4_overlapping_groups_to_drop", f"{_OV} SELECT DISTINCT CASE WHEN o.n < m.n OR (o.n = m.n AND a > b) THEN a ELSE b END AS rule_id FROM ov o JOIN n m ON m.rule_id = b WHERE overlap > 0.7")
def drop_overlap(spark, folder):
    members = I.match_rules(candles(spark, folder), rule_tables(spark)[0]).select("rule_id", "symbol", "bar_idx")
    ranks = members.groupBy("rule_id").agg(F.count(F.lit(1)).alias("score"))
    return N.drop_overlapping(N.group_overlap(members), ranks)


@query("n5_deduplicated_rules", f"""WITH {_SUP_RULES}, st AS (SELECT rule_id, list_sort(list(DISTINCT "column")) AS cs, sum(hi - lo) AS rank_key FROM rules GROUP BY 1), hd AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY cs ORDER BY rank_key DESC, rule_id DESC) = 1)
SELECT rule_id, 'LONG' AS direction, round(rank_key, 6) AS rank_key FROM hd h WHERE NOT EXISTS (SELECT 1 FROM hd k WHERE (k.rank_key > h.rank_key OR (k.rank_key = h.rank_key AND k.rule_id > h.rule_id)) AND len(list_intersect(k.cs, h.cs)) / len(list_distinct(list_concat(k.cs, h.cs))) >= 0.9)""")
def deduplicated(spark, folder):
    rules = _supplier_rules(spark, folder)
    ranks = rules.groupBy("rule_id").agg(F.lit("LONG").alias("direction"), F.sum(c("hi") - c("lo")).alias("rank_key"))
    return rounded(N.deduplicate_rules(rules, ranks, 0.9))


_PORT = f"{_DENSE}, ab AS (SELECT max(a) AS f, min(b) AS t, count(*) AS k FROM sp), cb AS (SELECT day, sum(pnl / k) AS pnl FROM dn, ab WHERE day BETWEEN f AND t GROUP BY 1)"


@query("n6_portfolio", f"""{_PORT}, e AS (SELECT *, sum(pnl) OVER (ORDER BY day) AS cum FROM cb), q AS (SELECT *, max(cum) OVER (ORDER BY day) AS top FROM e) SELECT count(*) AS days, round(avg(pnl) / stddev_pop(pnl) * sqrt(252), 6) AS sharpe,
  round(avg(pnl) / stddev_pop(CASE WHEN pnl < 0 THEN pnl END) * sqrt(252), 6) AS sortino, round(max((top - cum) / (100000 + top)), 6) AS max_dd_pct FROM q""")
def portfolio(spark, folder):
    return rounded(N.portfolio_metrics(N.portfolio_daily(dense_daily_pnl(S.ledger(spark, folder))), 100_000.0))


@query("n6_correlations", f"{_DENSE} SELECT a.strategy_id AS a, b.strategy_id AS b, count(*) AS days, round(corr(a.pnl, b.pnl), 6) AS correlation FROM dn a JOIN dn b ON a.day = b.day AND a.strategy_id < b.strategy_id GROUP BY 1, 2")
def correlations(spark, folder):
    return rounded(N.correlations(dense_daily_pnl(S.ledger(spark, folder))))


_MONTHLY = """s AS (SELECT o_custkey AS k, year(o_orderdate) * 12 + month(o_orderdate) AS mo, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2), t AS (SELECT max(mo) - min(mo) + 1 AS n FROM s)"""


@query("n6_correlated_pairs", f"""WITH {_MONTHLY}, m AS (SELECT k, sum(x) AS sx, sqrt(sum(x * x) - sum(x) * sum(x) / n) AS nn FROM s, t GROUP BY k, n),
p AS (SELECT a.k AS a, b.k AS b, sum(a.x * b.x) AS d FROM s a JOIN s b ON a.mo = b.mo AND a.k < b.k GROUP BY 1, 2), r AS (SELECT a, b, (d - x.sx * y.sx / n) / (x.nn * y.nn) AS c FROM p JOIN m x ON x.k = a JOIN m y ON y.k = b, t)
SELECT a, b, round(c, 6) AS correlation FROM r WHERE c >= 0.6 - 1e-9""")
def correlated_months(spark, folder):
    """Customers whose monthly order values move together (0.6 and more), met by their leading Fourier coefficients."""
    monthly = S.table(spark, folder, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("at"), "o_totalprice")
    return rounded(correlated_pairs(monthly, 0.6, key="o_custkey", pnl="o_totalprice", copies=True))


@query("n7_n8_union_and_distinct", f"{LED}, u AS (SELECT 'train' AS split, strategy_id, regime FROM ledger WHERE year(exit_time) < 2000 UNION ALL SELECT 'test', strategy_id, regime FROM ledger WHERE year(exit_time) >= 1999) SELECT DISTINCT split, strategy_id, CAST(regime AS BIGINT) AS regime FROM u")
def union_distinct(spark, folder):
    led = S.ledger(spark, folder).select("strategy_id", "regime", "exit_time")
    both = N.union_tagged({"train": led.filter(F.year("exit_time") < 2000), "test": led.filter(F.year("exit_time") >= 1999)})
    return rounded(both.dropDuplicates(["split", "strategy_id", "regime"]).drop("exit_time"))


# ---- O ----

def _shapes(spark, folder):
    frame = candles(spark, folder).filter("body_pct IS NOT NULL")
    return frame.withColumn("vector", F.array(*[c(n).cast("double") for n in ("body_pct", "uwk_pct", "lwk_pct", "volume")])).withColumn("regime", c("bar_idx") % 5)


def _placement(model, rows):
    """Rows, and rows that sit further from their own centroid than from another one."""
    centres = [[float(x) for x in centre] for centre in model.stages[-1].clusterCenters()]
    ready = model.transform(rows.withColumn("_features", array_to_vector(c("vector")))).withColumn("_at", vector_to_array("_scaled"))
    far = lambda centre: F.aggregate(F.zip_with("_at", F.array(*[F.lit(x) for x in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    away = F.array(*[far(centre) for centre in centres])
    return ready.withColumn("_away", away).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.get("_away", c("group_id")) > F.array_min("_away") + 1e-9).alias("misplaced"), (F.countDistinct("group_id") == len(centres)).alias("all_used"))


@query("o1_kmeans_groups", f"WITH {CANDLES} SELECT count(*) AS rows, 0::BIGINT AS misplaced, TRUE AS all_used FROM bars WHERE body_pct IS NOT NULL")
def kmeans(spark, folder):
    rows = _shapes(spark, folder)
    return _placement(O.fit_groups(rows, 8), rows)


@query("o1_kmeans_embeddings", "SELECT count(*) AS rows, 0::BIGINT AS misplaced, TRUE AS all_used FROM embeddings")
def kmeans_embeddings(spark, folder):
    rows = S.table(spark, folder, "embeddings").withColumn("vector", c("embedding").cast("array<double>"))
    return _placement(O.fit_groups(rows, 10), rows)


@query("o2_kmeans_per_regime")
def kmeans_per_regime(spark, folder):
    return O.fit_groups_per_regime(_shapes(spark, folder), 4).groupBy("regime", "group_id").agg(F.count(F.lit(1)).alias("bars"))


@query("o3_o5_tree_leaf_rules", "SELECT 0::BIGINT AS differing_leaves, TRUE AS every_row_in_one_box")
def tree_leaves(spark, folder):
    """Leaf boxes, how many rows the tree sends to each, and how many their boxes match: the same."""
    columns = ["body_pct", "uwk_pct", "lwk_pct", "volume"]
    rows = over_chunks(candles(spark, folder), lambda w: best_move(w, 10), after=10).na.drop(subset=[*columns, "fwd_best_move_10"])
    model = O.fit_leaves(rows, columns, "fwd_best_move_10", 3)
    boxes = O.leaf_rules(model, columns, spark)
    boxed = I.match_rules(rows, boxes.select("rule_id", "column", "lo", "hi")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matched"))
    means = boxes.groupBy("rule_id").agg(F.first("leaf_mean").alias("leaf_mean"))
    placed = O.assign_leaves(model, rows).groupBy("leaf_mean").agg(F.count(F.lit(1)).alias("assigned"))
    both = boxed.join(means, "rule_id").groupBy("leaf_mean").agg(F.sum("matched").alias("matched")).join(placed, "leaf_mean", "full")
    return both.agg(F.count_if(~c("matched").eqNullSafe(c("assigned"))).alias("differing_leaves"), (F.sum("matched") == F.sum("assigned")).alias("every_row_in_one_box"))


_LAGS = ", ".join(f"(lag(close, {5 - i}) OVER o - lag(close, 5) OVER o) / nullif(lag(close, 5) OVER o, 0) * 100 AS s{i}" for i in range(5))
_DOT = lambda x, y: "(" + " + ".join(f"{x}{i} * {y}{i}" for i in range(5)) + ")"
_SUM = lambda x: "(" + " + ".join(f"{x}{i}" for i in range(5)) + ")"


@query("o6_shape_refinement", f"""WITH {CANDLES}, l AS (SELECT symbol, bar_idx, grp, {_LAGS} FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx)), sh AS (SELECT * FROM l WHERE s0 IS NOT NULL),
m AS (SELECT grp AS g, {", ".join(f"avg(s{i}) AS m{i}" for i in range(5))} FROM sh GROUP BY 1), v AS (SELECT *, (5 * {_DOT("s", "s")} - {_SUM("s")} * {_SUM("s")}) * (5 * {_DOT("m", "m")} - {_SUM("m")} * {_SUM("m")}) AS under FROM sh, m),
r AS (SELECT *, CASE WHEN under > 0 THEN (5 * {_DOT("s", "m")} - {_SUM("s")} * {_SUM("m")}) / sqrt(under) ELSE -2 END AS r FROM v), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY r DESC, g) = 1)
SELECT CAST(grp AS BIGINT) AS group_id, CAST(CASE WHEN r >= 0.75 THEN g ELSE grp END AS BIGINT) AS refined_group, count(*) AS bars FROM b GROUP BY 1, 2""")
def shape_refinement(spark, folder):
    rows = candles(spark, folder).withColumn("group_id", c("grp"))
    return rounded(O.refine_by_shape(rows).groupBy("group_id", "refined_group").agg(F.count(F.lit(1)).alias("bars")))


@query("o7_win_filter")
def win_filter(spark, folder):
    led = S.ledger(spark, folder).withColumns({"won": (c("net_pnl") > 0).cast("double"), "f1": (c("trade_id") % 11).cast("double"), "f2": c("regime").cast("double"), "f3": c("initial_risk")})
    train = led.filter(F.year("exit_time") < 2000)
    model = O.fit_win_filter(train, ["f1", "f2", "f3"])
    scored = O.win_probability(model, led).withColumn("rr", c("net_pnl") / c("initial_risk"))
    return rounded(L.threshold_metrics(scored, keys=["strategy_id"]), 4)
