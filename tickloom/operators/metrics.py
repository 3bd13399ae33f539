"""Ledger aggregates, scores, gates and rankings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, two_sided_z, wilson_lower, wilson_upper
from tickloom.operators.bars import period_keys
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.scan import running

c = F.col


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def profit_factor(pnl: Column) -> Column:
    """Gross profit over gross loss; NULL when nothing was lost."""
    return ratio(F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)))


def headline(ledger: DataFrame, keys: Sequence[str] = ("strategy_id",), pnl: str = "net_pnl", time: str = "exit_time") -> DataFrame:
    """Counts, win rate, profits, factor, payoff and trade Sharpe per strategy."""
    x = c(pnl)
    n, sigma = F.count(pnl), F.stddev_samp(pnl)
    return ledger.groupBy(*keys).agg(
        n.alias("trades"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"),
        (100 * F.count_if(x > 0) / n).alias("win_rate_pct"), F.sum(pnl).alias("net_profit"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("gross_loss"),
        profit_factor(x).alias("profit_factor"), F.avg(pnl).alias("expected_payoff"),
        F.when(sigma > 0, F.avg(pnl) / sigma * F.sqrt(n)).alias("trade_sharpe"),
        F.countDistinct(F.to_date(time)).alias("trading_days"),
        (n / F.countDistinct(F.to_date(time))).alias("trades_per_active_day"))


def equity_curve(
    ledger: DataFrame, initial_balance: float, keys: Sequence[str] = ("strategy_id",), pnl: str = "net_pnl",
    order: Sequence[str] = ("exit_time", "trade_id"), bucket: Column | None = None,
) -> DataFrame:
    """Equity after each trade, the peak before it (initial balance included) and the drawdown.

    Folds one (strategy, bucket of the order) at a time, day by day unless told otherwise: sum
    and highest partial sum of a bucket are all that later buckets need of it.
    """
    keys = list(keys)
    bucket = F.datediff(F.to_date(order[0]), F.lit("1970-01-01").cast("date")) if bucket is None else bucket
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = ledger.withColumn("_bucket", bucket).repartition(*keys, "_bucket").withColumn("_sum", F.coalesce(F.sum(pnl).over(inside), F.lit(0.0)))
    base = base.withColumn("_top", F.max("_sum").over(inside))
    summary = base.groupBy(*keys, "_bucket").agg(F.sum(F.coalesce(c(pnl), F.lit(0.0))).alias("_total"), F.max("_sum").alias("_high"))
    summary = summary.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    summary = summary.withColumn("_past", F.max(c("_carry") + c("_high")).over(before)).select(*keys, "_bucket", "_carry", "_past")
    curve = base.join(summary, [*keys, "_bucket"])
    # The peak before a trade: if the trade itself made the top, it has no drawdown anyway.
    equity = F.lit(float(initial_balance)) + c("_carry") + c("_sum")
    peak = F.lit(float(initial_balance)) + F.greatest(F.lit(0.0), c("_past"), c("_carry") + c("_top"))
    curve = curve.withColumns({"equity": equity, "peak": peak}).withColumn("drawdown", c("peak") - c("equity"))
    return curve.withColumn("drawdown_pct", F.when(c("peak") > 0, c("drawdown") / c("peak") * 100).otherwise(0.0)).drop("_bucket", "_sum", "_top", "_carry", "_past")


def drawdowns(ledger: DataFrame, initial_balance: float, keys: Sequence[str] = ("strategy_id",), **options) -> DataFrame:
    curve = equity_curve(ledger, initial_balance, keys, **options)
    return curve.groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), F.max("drawdown_pct").alias("max_drawdown_pct"))


def annualised(ledger: DataFrame, initial_balance: float, keys: Sequence[str] = ("strategy_id",), pnl: str = "net_pnl") -> DataFrame:
    """Sharpe and Sortino scaled by the root of 252, return in percent."""
    mean, sigma, down = F.avg(pnl), F.stddev_samp(pnl), F.stddev_samp(F.when(c(pnl) < 0, c(pnl)))
    scale = math.sqrt(252.0)
    return ledger.groupBy(*keys).agg(
        F.when(sigma > 0, mean / sigma * scale).alias("sharpe"), F.when(down > 0, mean / down * scale).alias("sortino"),
        (F.sum(pnl) / initial_balance * 100).alias("return_pct"))


def concentration(ledger: DataFrame, keys: Sequence[str] = ("strategy_id",), pnl: str = "net_pnl", time: str = "exit_time") -> DataFrame:
    """Share of the largest trade and the largest month; trades per week."""
    by_month = ledger.groupBy(*keys, period_keys(c(time))["month"].alias("_m")).agg(
        F.sum(pnl).alias("_net"), F.sum(F.abs(pnl)).alias("_abs"), F.max(F.abs(pnl)).alias("_top"), F.count(F.lit(1)).alias("_n"),
        F.min(time).alias("_a"), F.max(time).alias("_b"))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    days = F.greatest((micros(F.max("_b")) - micros(F.min("_a"))) / 86_400e6, F.lit(1.0))
    return by_month.groupBy(*keys).agg(
        (F.sum("_n") / (days / 7)).alias("trades_per_week"),
        F.coalesce(ratio(F.max("_top") * 100, F.sum("_abs")), F.lit(0.0)).alias("largest_trade_concentration_pct"),
        F.coalesce(ratio(F.max(F.abs("_net")) * 100, F.abs(F.sum("_net"))), F.lit(0.0)).alias("largest_month_concentration_pct"))


def period_stability(ledger: DataFrame, keys: Sequence[str] = ("strategy_id",), pnl: str = "net_pnl", time: str = "exit_time") -> DataFrame:
    """Share of profitable months, quarters and years, and the P&L map of each period kind."""
    parts = {k: v for k, v in period_keys(c(time)).items() if k in ("month", "quarter", "year")}
    monthly = ledger.groupBy(*keys, *[v.alias(k) for k, v in parts.items()]).agg(F.sum(pnl).alias("_p"))
    out = None
    for kind in parts:
        totals = monthly.groupBy(*keys, kind).agg(F.sum("_p").alias("_p"))
        part = totals.groupBy(*keys).agg(
            F.avg((c("_p") > 0).cast("int")).alias(f"positive_{kind}_fraction"), F.count_if(c("_p") > 0).alias(f"positive_{kind}s"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(c(kind).alias("k"), c("_p").alias("v"))))).alias(f"{kind}_net_profit"))
        out = part if out is None else out.join(part, list(keys))
    return out


def summarize(ledger: DataFrame, initial_balance: float, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Headline, drawdown, stability, annualised and concentration metrics in one row per strategy."""
    keys = list(keys)
    out = headline(ledger, keys)
    for part in (drawdowns(ledger, initial_balance, keys), period_stability(ledger, keys), annualised(ledger, initial_balance, keys), concentration(ledger, keys)):
        out = out.join(part, keys)
    return out


def rule_scores(trades: DataFrame, keys: Sequence[str] = ("rule_id",), r: str = "booked_r") -> DataFrame:
    """R metrics that need no order: counts, factor, averages, expectancy, payoff, breakeven, Wilson bound."""
    x = c(r)
    win, loss = F.avg(F.when(x > 0, x)), F.avg(F.when(x < 0, -x))
    out = trades.groupBy(*keys).agg(
        F.count(r).alias("trades"), F.count_if(x > 0).alias("wins"), F.count_if(x <= 0).alias("losses"),
        F.avg((x > 0).cast("int")).alias("win_rate"),
        ratio(F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x <= 0, -x).otherwise(0.0))).alias("profit_factor"),
        F.coalesce(win, F.lit(0.0)).alias("avg_rr"), F.coalesce(loss, F.lit(0.0)).alias("avg_loss_r"), F.avg(r).alias("expectancy_r"),
        F.sum(r).alias("total_r"), F.coalesce(ratio(win, loss), F.lit(0.0)).alias("payoff_ratio"))
    return out.withColumns({
        "breakeven_wr": F.when(c("payoff_ratio") > 0, 100 / (1 + c("payoff_ratio"))).otherwise(100.0),
        "wilson_wr": 100 * F.greatest(wilson_lower(c("wins"), c("trades"), two_sided_z(0.85)), F.lit(0.0))})


def worst_streak(trades: DataFrame, keys: Sequence[str], order: Sequence[str], lost: Column, bucket: Column) -> DataFrame:
    """Longest run of losing trades: a run has as many losses as trades share its count of wins."""
    counted = running(trades, {"_wins": ("sum", F.when(lost, 0).otherwise(1))}, keys, order, bucket)
    runs = counted.filter(lost).groupBy(*keys, "_wins").agg(F.count(F.lit(1)).alias("_run"))
    longest = runs.groupBy(*keys).agg(F.max("_run").alias("max_consecutive_losses"))
    return trades.select(*keys).distinct().join(longest, list(keys), "left").fillna(0, subset=["max_consecutive_losses"])


def r_metrics(
    trades: DataFrame, days: DataFrame, keys: Sequence[str] = ("rule_id",), r: str = "booked_r", order: Sequence[str] = ("entry_idx",),
    bucket: Column | None = None,
) -> DataFrame:
    """All metrics in units of risk: those of `rule_scores`, largest drawdown, longest losing run, trades per day.

    `days` has `trading_days` per key (or one row for all, without the keys).  The drawdown is measured from
    the running peak of summed R, which starts at 0.
    """
    keys = list(keys)
    bucket = F.floor(c(order[0]) / 4096) if bucket is None else bucket
    out = rule_scores(trades, keys, r)
    fallen = drawdowns(trades, 0.0, keys, pnl=r, order=order, bucket=bucket).select(*keys, c("max_drawdown").alias("max_drawdown_r"))
    out = out.join(fallen, keys).join(worst_streak(trades, keys, order, c(r) <= 0, bucket), keys)
    shared = [k for k in keys if k in days.columns]
    out = out.join(days.select(*shared, "trading_days"), shared) if shared else out.crossJoin(F.broadcast(days.select("trading_days").limit(1)))
    return out.withColumn("per_day", c("trades") / F.greatest(c("trading_days"), F.lit(1)))


def wilson_interval(wins: Column, trades: Column, z: float = 1.96) -> tuple[Column, Column]:
    return F.greatest(wilson_lower(wins, trades, z), F.lit(0.0)), F.least(wilson_upper(wins, trades, z), F.lit(1.0))


def time_consistency(trades: DataFrame, keys: Sequence[str] = ("strategy_id",), won: Column | None = None, time: str = "exit_time") -> DataFrame:
    """Share of years with at least five trades and half of them won; 0.6 with under two years."""
    won = c("net_pnl") > 0 if won is None else won
    years = trades.groupBy(*keys, F.year(time).alias("_y")).agg(F.count(F.lit(1)).alias("_n"), F.avg(won.cast("int")).alias("_w"))
    good = F.avg(((c("_n") >= 5) & (c("_w") >= 0.5)).cast("int"))
    return years.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 2, 0.6).otherwise(good).alias("time_consistency"))


def trade_distribution(trades: DataFrame, keys: Sequence[str] = ("strategy_id",), time: str = "exit_time") -> DataFrame:
    """1 - CV/3 of the trade counts per quarter with trades, clipped; 0.5 with under two quarters."""
    quarters = trades.groupBy(*keys, F.year(time).alias("_y"), F.quarter(time).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    score = clip(1 - F.stddev_samp("_n") / F.greatest(F.avg("_n"), F.lit(1.0)) / 3, 0, 1)
    return quarters.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 2, 0.5).otherwise(score).alias("trade_distribution"))


# Weights and targets of the composite score.
SCORE_WEIGHTS = {"wr": 0.30, "pf": 0.30, "rr": 0.25, "stability": 0.25, "per_day": 0.15}
SCORE_TARGETS = {"wr": 55.0, "pf": 1.5, "rr": 1.3, "stability": 0.75, "per_day": 1.0}


def target_score(actual: Column, target: float, weight: float, excess: float = 0.1) -> Column:
    """Quadratic below the target, full weight plus a slow logarithm above it."""
    if target <= 0:
        return weight * F.least(actual / 0.01, F.lit(2.0))
    above = weight * (1 + excess * F.log1p(F.greatest(actual - target, F.lit(0.0))))
    return F.when(actual >= target, above).otherwise(weight * (actual / target) * (actual / target))


def composite_score(
    scores: DataFrame, mode: str = "target", targets: Mapping[str, float] = SCORE_TARGETS, weights: Mapping[str, float] = SCORE_WEIGHTS,
) -> DataFrame:
    """Score from trades, wins, losses, avg_rr, stability and train_days; 0 if under five trades or breakeven."""
    wins, losses, total = c("wins"), c("losses"), c("wins") + c("losses")
    wr = wins / total
    breakeven = F.when(wins > 0, losses / wins).otherwise(999.0)
    pf = F.when(losses > 0, wins * F.greatest("avg_rr", F.lit(0.0)) / losses).otherwise(2.0)
    rr = c("avg_rr") / F.greatest(breakeven, F.lit(0.01))
    if mode == "target":
        parts = {"wr": wr * 100, "pf": pf, "rr": rr, "stability": c("stability"), "per_day": total / F.greatest(c("train_days"), F.lit(1))}
        score = sum((target_score(v, targets[k], weights[k]) for k, v in parts.items()), F.lit(0.0))
    elif mode == "weighted":
        bound = F.greatest(wilson_lower(wins, total, two_sided_z(0.85)), F.lit(0.0))
        score = weights["wr"] * bound + weights["pf"] * F.least(pf, F.lit(4.0)) / 4 + weights["rr"] * F.least(rr, F.lit(2.0)) / 2 + weights["stability"] * c("stability")
    else:
        raise ValueError(f"unknown score mode: {mode}")
    return scores.withColumn("composite_score", F.when((total >= 5) & (c("avg_rr") >= breakeven), score).otherwise(0.0))


def recent_degradation(
    trades: DataFrame, keys: Sequence[str] = ("strategy_id",), won: Column | None = None, recent_rows: int = 8000,
    position: str = "trade_idx", least: int = 10,
) -> DataFrame:
    """Win rate overall and over the most recent third, at most `recent_rows` trades; needs positions.

    Under `least` trades both are 0; where no trade counts as recent, the overall rate stands in.
    """
    won = c("net_pnl") > 0 if won is None else won
    sizes = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    aged = trades.join(sizes, list(keys))
    late = c(position) >= c("_n") - F.least(F.lit(recent_rows), F.floor(c("_n") / 3))
    overall, recent = F.avg(won.cast("int")), F.avg(F.when(late, won.cast("int")))
    few = F.max("_n") < least
    return aged.groupBy(*keys).agg(
        F.when(few, 0.0).otherwise(F.round(overall * 100, 1)).alias("overall_wr"), F.when(few, 0.0).otherwise(F.round(F.coalesce(recent, overall) * 100, 1)).alias("recent_wr"))


# End hour (exclusive) and name of the report's entry-hour sessions.
REPORT_SESSIONS = [(7, "asia"), (12, "london"), (17, "ny_overlap"), (22, "ny_late"), (24, "rollover")]


def report_session(time: Column) -> Column:
    hour = F.hour(time)
    out = F.lit(REPORT_SESSIONS[-1][1])
    for end, name in reversed(REPORT_SESSIONS[:-1]):
        out = F.when(hour < end, name).otherwise(out)
    return out


def breakdown(ledger: DataFrame, segments: Mapping[str, Column], keys: Sequence[str] = ("strategy_id",), pnl: str = "net_pnl") -> DataFrame:
    """Headline metrics by each segment alone, as grouping sets over one pre-aggregation.

    Trades are first reduced to one row per combination of segment values, so the copies
    made for the sets are few.
    """
    x = c(pnl)
    tagged = ledger.select(*keys, *[F.coalesce(v.cast("string"), F.lit("unknown")).alias(k) for k, v in segments.items()], x.alias("_x"))
    small = tagged.groupBy(*keys, *segments).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(c("_x") > 0).alias("_w"), F.sum("_x").alias("_s"),
        F.sum(F.when(c("_x") > 0, c("_x")).otherwise(0.0)).alias("_p"), F.sum(F.when(c("_x") < 0, -c("_x")).otherwise(0.0)).alias("_l"))
    pairs = ", ".join(f"'{name}', {name}" for name in segments)
    long = small.select(*keys, F.expr(f"stack({len(segments)}, {pairs}) AS (segment, bucket)"), "_n", "_w", "_s", "_p", "_l")
    return long.groupBy(*keys, "segment", "bucket").agg(
        F.sum("_n").alias("trades"), F.sum("_w").alias("wins"), (100 * F.sum("_w") / F.sum("_n")).alias("win_rate_pct"),
        F.sum("_s").alias("net_profit"), ratio(F.sum("_p"), F.sum("_l")).alias("profit_factor"), (F.sum("_s") / F.sum("_n")).alias("average_profit"))


# ---- gates and rankings ----

def gate(metrics: DataFrame, checks: Mapping[str, Column], hard: Sequence[str] | None = None, accept: str = "promote", reject: str = "reject") -> DataFrame:
    """Named conditions to a decision plus the names that failed; NULL counts as failed.

    With `hard` given, only those decide and the others are reported as `soft_failed`.
    """
    failed = lambda names: F.array_compact(F.array(*[F.when(~F.coalesce(checks[n], F.lit(False)), F.lit(n)) for n in names]))
    deciding = list(checks) if hard is None else list(hard)
    out = metrics.withColumn("failed", F.array_join(failed(deciding), ","))
    if hard is not None:
        out = out.withColumn("soft_failed", F.array_join(failed([n for n in checks if n not in hard]), ","))
    return out.withColumn("decision", F.when(c("failed") == "", accept).otherwise(reject))


# Least trades, least profit factor and largest drawdown in percent by role.
ROLE_POLICIES = {
    "fit": (100, 1.05, 20.0), "internal_oos": (60, 1.15, 12.0), "development": (80, 1.10, 15.0), "validation": (30, 1.20, 12.0),
    "variant_retest": (30, 1.20, 12.0), "lockbox": (30, 1.15, 12.0), "five_year_confirmation": (100, 1.15, 15.0),
}


def role_checks(role: str, min_positive: float = 0.5, min_positive_years: int = 3) -> dict[str, Column]:
    trades, factor, drawdown = ROLE_POLICIES[role]
    kind = "quarter" if role in ("fit", "internal_oos") else "month"
    checks = {
        "minimum_trades": c("trades") >= trades, "profit_factor": c("profit_factor") >= factor, "positive_expectancy": c("expected_payoff") > 0,
        "drawdown": c("max_drawdown_pct") <= drawdown, "chronological_stability": c(f"positive_{kind}_fraction") >= min_positive}
    if role == "development":
        checks["minimum_positive_years"] = c("positive_years") >= min_positive_years
    return checks


def report_checks(
    min_trades: int = 100, min_factor: float = 1.15, min_payoff: float = 0.0, min_net: float = 0.0, max_drawdown_pct: float = 20.0,
) -> dict[str, Column]:
    """Promotion policy of a tester report: a missing figure counts as 0, a missing drawdown as failed."""
    known = lambda name: F.coalesce(c(name), F.lit(0.0))
    return {
        "trades": known("trades") >= min_trades, "profit_factor": known("profit_factor") >= min_factor, "expected_payoff": known("expected_payoff") > min_payoff,
        "net_profit": known("net_profit") > min_net, "equity_drawdown": c("max_drawdown_pct") <= max_drawdown_pct}


# Bounds of the discovery filters, and which of them alone rule a candidate out.
DISCOVERY_BOUNDS = {
    "implied_rr": (0.30, "min"), "composite_score": (0.25, "min"), "max_drawdown_r": (12.0, "max"), "max_consecutive_losses": (8, "max"), "per_day": (0.3, "min"),
    "gated_test_trades": (50, "min"), "box_test_profit_factor": (1.20, "min"), "box_test_expectancy_r": (0.05, "min"), "box_test_wilson_edge": (0.0, "min"), "time_consistency": (0.35, "min")}
HARD_FILTERS = ("profit_factor", "per_day", "test_trades", "gated_test_trades", "box_test_profit_factor", "box_test_expectancy_r", "box_test_wilson_edge")


def discovery_filters(
    candidates: DataFrame, min_win_rate: float, min_factor: float, min_test_trades: float, hard: Sequence[str] = HARD_FILTERS, max_soft: int = 3,
    bounds: Mapping[str, tuple[float, str]] = DISCOVERY_BOUNDS,
) -> DataFrame:
    """Add `hard_failed`, `soft_failed` and `decision`: drop, marginal or pass.

    A failed hard filter drops a candidate, and so do more than `max_soft` failed soft ones; with fewer it
    is marginal.  A missing figure fails.
    """
    limits = {
        "win_rate_pct": (min_win_rate, "min"), "wilson_wr": (min_win_rate * 0.9, "min"), "profit_factor": (min_factor, "min"), "test_trades": (min_test_trades, "min"), **bounds}
    held = {name: c(name) >= bound if kind == "min" else c(name) <= bound for name, (bound, kind) in limits.items()}
    failed = lambda names: F.array_compact(F.array(*[F.when(~F.coalesce(held[n], F.lit(False)), F.lit(n)) for n in names]))
    out = candidates.withColumns({"_hard": failed([n for n in limits if n in hard]), "_soft": failed([n for n in limits if n not in hard])})
    decision = F.when((F.size("_hard") > 0) | (F.size("_soft") > max_soft), "drop").when(F.size("_soft") > 0, "marginal").otherwise("pass")
    return out.withColumns({"hard_failed": F.array_join("_hard", ","), "soft_failed": F.array_join("_soft", ","), "decision": decision}).drop("_hard", "_soft")


def validation_checks(min_trades: int, min_factor: float, min_sharpe: float, max_drawdown_pct: float, lower_trades: bool = False) -> dict[str, Column]:
    required = max(1, int(min_trades * (0.35 if lower_trades else 1.0)))
    return {
        "minimum_trades": c("trades") >= required, "net_profit_positive": c("net_profit") > 0, "profit_factor": c("profit_factor") >= min_factor,
        "sharpe": c("sharpe") >= min_sharpe, "drawdown": c("max_drawdown_pct") <= max_drawdown_pct,
        "positive_months": c("positive_month_fraction") >= 0.5, "concentration": c("largest_month_concentration_pct") <= 65.0}


def quant_score() -> Column:
    z = lambda name: F.coalesce(c(name), F.lit(0.0))
    return (
        40 * F.greatest(z("profit_factor") - 1, F.lit(0.0)) + 12 * z("trade_sharpe") + 20 * F.greatest(z("win_rate_pct") / 100 - 0.45, F.lit(0.0))
        + 0.04 * z("expected_payoff") + 4 * F.least(z("trades") / 250, F.lit(1.0)) + 10 * z("positive_month_fraction") - 1.2 * z("max_drawdown_pct"))


def rank_parents(metrics: DataFrame, top: int | None = None) -> DataFrame:
    """Order by quant score, then factor, Sharpe, net profit and smaller drawdown."""
    scored = metrics.withColumn("quant_score", quant_score())
    out = scored.orderBy(*[F.desc_nulls_last(n) for n in ("quant_score", "profit_factor", "trade_sharpe", "net_profit")], "max_drawdown_pct")
    return out if top is None else out.limit(top)


def out_of_sample_rank(box: str = "ea_test", gated: str = "test", train: str = "composite_score") -> Column:
    """Sort key that prefers box-only out-of-sample results, then gated ones, then the train score."""
    cap = lambda name: F.when(c(name).isNull() | F.isnan(c(name)), 0.0).otherwise(F.least(c(name), F.lit(99.0)))
    by_box = (cap(f"{box}_pf") > 0) & (F.coalesce(c(f"{box}_trades"), F.lit(0)) > 0)
    return F.when(by_box, F.struct(F.lit(2).alias("tier"), cap(f"{box}_pf").alias("a"), cap(f"{box}_wr").alias("b"))).when(
        cap(f"{gated}_pf") > 0, F.struct(F.lit(1).alias("tier"), cap(f"{gated}_pf").alias("a"), cap(f"{gated}_wr").alias("b"))).otherwise(
        F.struct(F.lit(0).alias("tier"), cap(train).alias("a"), F.lit(0.0).alias("b")))


def required_trades(bars: DataFrame, per_week: float, multiplier: float = 1.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Least trades asked of a strategy: trading days / 5 x rate x density multiplier, at least 1."""
    days = bars.groupBy(*keys).agg(F.countDistinct(F.to_date("time")).alias("trading_days"))
    return days.withColumn("required_trades", F.greatest(F.lit(1), F.bround(c("trading_days") / 5.0 * per_week * multiplier)).cast("long"))


def overview(metrics: DataFrame) -> DataFrame:
    """Averages and totals over all surviving rules."""
    return metrics.agg(
        F.count(F.lit(1)).alias("strategies"), F.sum("trades").alias("trades"), F.avg("win_rate_pct").alias("avg_win_rate_pct"),
        F.avg("profit_factor").alias("avg_profit_factor"), F.max("profit_factor").alias("best_profit_factor"), F.sum("net_profit").alias("net_profit"))


def group_profile(frame: DataFrame, group: str, medians: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """Typical bar of each group: medians of numbers, most frequent value (smallest on a tie) of codes."""
    middle = exact_quantiles(frame, [group], {f"{n}_median": (n, 0.5) for n in medians})
    base = frame.groupBy(group).agg(F.count(F.lit(1)).alias("bars")).join(middle, group)
    for name in modes:
        counts = frame.groupBy(group, name).agg(F.count(F.lit(1)).alias("_n"))
        top = counts.groupBy(group).agg(F.min(F.struct((-c("_n")).alias("n"), c(name).alias("v"))).alias("_t")).select(group, c("_t.v").alias(f"{name}_mode"))
        base = base.join(top, group)
    return base
