"""Bootstrap paths of daily P&L and what happens along them.

A strategy's daily series is bounded by the calendar, so it travels as one packed array;
paths are spread over tasks in batches and each is folded where it was drawn.  Draws
depend on (seed, strategy, path, block) only, never on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.align import windows_of
from tickloom.session import spread

c = F.col
BATCHES, PER_BATCH = 64, 256


def packed_series(daily: DataFrame, keys: Sequence[str] = ("strategy_id",), day: str = "day", pnl: str = "pnl", opened: str = "opened") -> DataFrame:
    """One row per key: the dense daily P&L and opened-a-trade flags in day order."""
    item = F.struct(day, c(pnl).alias("p"), c(opened).alias("o"))
    rows = F.array_sort(F.collect_list(item))
    return daily.groupBy(*keys).agg(rows.alias("_r")).select(
        *keys, F.transform("_r", lambda x: x["p"]).alias("series"), F.transform("_r", lambda x: x["o"]).alias("opens"))


def _draw(kind: str, seed: int, keys: Sequence[str], path: Column, block: Column, size: Column) -> Column:
    if kind == "hash":
        return F.pmod(F.xxhash64(F.lit(seed), *[c(k) for k in keys], path, block), size)
    if kind != "arithmetic":
        raise ValueError(f"unknown draw: {kind}")
    return (path * 7919 + block * 104729 + path * block * 17 + F.lit(seed * 31)) % size


def bootstrap_paths(
    packed: DataFrame, paths: int, steps: int, block: int = 1, seed: int = 42, draw: str = "hash",
    keys: Sequence[str] = ("strategy_id",), scales: Sequence[float] = (1.0,),
) -> DataFrame:
    """One row per (key, scale, path): `pnl` and `opened` arrays of `steps` drawn days.

    `block` > 1 draws runs of consecutive days.  `scales` multiplies the P&L, as another
    position size would.
    """
    per_batch = max(1, min(PER_BATCH, -(-paths // BATCHES)))
    spread = packed.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(-(-paths // per_batch) - 1)))).repartition(*keys, "_batch")
    ids = F.sequence(c("_batch") * per_batch, F.least((c("_batch") + 1) * per_batch, F.lit(paths)) - 1)
    rows = spread.filter(c("_batch") * per_batch < paths).withColumn("path_id", F.explode(ids.cast("array<bigint>"))).drop("_batch")
    n = F.size("series").cast("long")
    width = F.when(n > block, F.lit(block)).otherwise(1).cast("long")
    place = lambda s: _draw(draw, seed, keys, c("path_id"), F.floor(s / width), n - width + 1) + s % width
    index = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: place(s.cast("long")).cast("int"))
    drawn = rows.withColumn("_index", index).withColumn("scale", F.explode(F.array(*[F.lit(float(x)) for x in scales])))
    return drawn.select(
        *keys, "scale", "path_id", F.transform("_index", lambda i: F.get("series", i) * c("scale")).alias("pnl"),
        F.transform("_index", lambda i: F.get("opens", i)).alias("opened"))


def path_steps(paths: DataFrame, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Long form of the drawn paths: one row per step."""
    pairs = F.arrays_zip("pnl", "opened")
    return paths.select(*keys, "scale", "path_id", F.posexplode(pairs).alias("step", "_x")).select(*keys, "scale", "path_id", "step", "_x.pnl", "_x.opened")


def long_run(paths: DataFrame, balance: float, ruin_drawdown: float) -> DataFrame:
    """Final equity, largest drawdown, Sharpe and ruin of each path; ruin freezes equity at the floor."""
    floor = balance * (1 - ruin_drawdown)
    zero = lambda name, v=0.0: F.lit(v).alias(name)
    start = F.struct(zero("eq", float(balance)), zero("raw", float(balance)), zero("peak", float(balance)), zero("dd"), zero("s"), zero("q"),
                     F.lit(0).alias("n"), F.lit(None).cast("int").alias("ruin"), F.lit(0).alias("day"))

    def step(a: Column, x: Column) -> Column:
        raw = a["raw"] + x
        live = a["ruin"].isNull()
        broke = live & (raw <= floor)
        eq = F.when(~live | broke, F.lit(floor)).otherwise(raw)
        peak = F.greatest(a["peak"], eq)
        counted = live & ~broke
        ret = x / F.when(a["eq"] > 0, a["eq"]).otherwise(1.0)
        return F.struct(
            eq.alias("eq"), raw.alias("raw"), peak.alias("peak"),
            F.greatest(a["dd"], (peak - eq) / F.when(peak > 0, peak).otherwise(1.0)).alias("dd"),
            (a["s"] + F.when(counted, ret).otherwise(0.0)).alias("s"), (a["q"] + F.when(counted, ret * ret).otherwise(0.0)).alias("q"),
            (a["n"] + counted.cast("int")).alias("n"), F.when(broke, a["day"] + 1).otherwise(a["ruin"]).alias("ruin"), (a["day"] + 1).alias("day"))

    out = paths.withColumn("_z", F.aggregate("pnl", start, step)).drop("pnl", "opened")
    n, s, q = F.greatest(c("_z.n"), F.lit(1)), c("_z.s"), c("_z.q")
    var = F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
    return out.withColumns({
        "final_equity": c("_z.eq"), "max_drawdown": c("_z.dd"), "ruin_step": c("_z.ruin"),
        "sharpe": F.when((c("_z.n") > 1) & (var > 1e-18), s / n / F.sqrt(var) * (252.0 ** 0.5)).otherwise(0.0)}).drop("_z")


def target_race(
    paths: DataFrame, balance: float, target_pct: float, daily_loss_pct: float, total_loss_pct: float, min_days: int = 0,
    trailing: bool = False, largest_day_share: float | None = None, intraday_factor: float = 1.0,
) -> DataFrame:
    """Which comes first on each path: the target, a daily loss, a total loss, or the end.

    A breach on the day of the target counts as the breach.  `largest_day_share` fails a
    pass whose best day makes up more than that share of all winning days.
    """
    daily = balance * daily_loss_pct * intraday_factor
    total = total_loss_pct * intraday_factor
    base = balance * (1 - total)
    goal = balance * target_pct
    start = F.struct(F.lit(float(balance)).alias("eq"), F.lit(float(base)).alias("floor"), F.lit(0).alias("day"), F.lit(0).alias("traded"),
                     F.lit(None).cast("string").alias("end"), F.lit(0.0).alias("won"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        live = a["end"].isNull()
        floor = F.greatest(a["floor"], a["eq"] * (1 - total)) if trailing else a["floor"]
        eq, traded = a["eq"] + x["pnl"], a["traded"] + x["opened"].cast("int")
        end = F.when(x["pnl"] < -daily, "daily_dd").when(eq < floor, "total_dd").when((eq - balance >= goal) & (traded >= min_days), "pass")
        new = {"eq": eq, "floor": floor, "day": a["day"] + 1, "traded": traded, "end": end,
               "won": a["won"] + F.greatest(x["pnl"], F.lit(0.0)), "best": F.greatest(a["best"], x["pnl"])}
        return F.struct(*[F.when(live, v).otherwise(a[k]).alias(k) for k, v in new.items()])

    out = paths.withColumn("_z", F.aggregate(F.arrays_zip("pnl", "opened"), start, step)).drop("pnl", "opened")
    end = F.coalesce(c("_z.end"), F.lit("profit_shortfall"))
    if largest_day_share is not None:
        end = F.when((end == "pass") & (c("_z.won") > 0) & (c("_z.best") > c("_z.won") * largest_day_share), "consistency_violation").otherwise(end)
    return out.withColumns({
        "outcome": end, "days": c("_z.day"), "trading_days": c("_z.traded"), "final_equity": c("_z.eq")}).drop("_z")


def race_summary(races: DataFrame, keys: Sequence[str] = ("strategy_id", "scale")) -> DataFrame:
    """Pass rate, shares of the failures, and how long passing took."""
    passed = c("outcome") == "pass"
    failures = F.count_if(~passed)
    share = lambda reason: F.when(failures > 0, F.count_if(c("outcome") == reason) / failures * 100).otherwise(0.0)
    days = F.when(passed, c("days"))
    out = races.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paths"), F.count_if(passed).alias("passed"), (F.count_if(passed) / F.count(F.lit(1)) * 100).alias("pass_rate"),
        *[share(reason).alias(f"{reason}_pct") for reason in ("daily_dd", "total_dd", "profit_shortfall", "consistency_violation")],
        F.coalesce(F.avg(days), F.lit(0.0)).alias("avg_days"), F.percentile(days, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"), F.max(days).alias("days_worst"))
    return out.withColumns({f"days_p{p}": c("_q")[i] for i, p in enumerate((10, 50, 90))}).drop("_q")


def equity_fan(paths: DataFrame, balance: float, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Percentiles of equity over all paths at each step."""
    so_far = Window.partitionBy(*keys, "scale", "path_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = path_steps(paths, keys).select(*keys, "step", (F.sum("pnl").over(so_far) + float(balance)).alias("_eq"))
    levels = [5, 25, 50, 75, 95]
    out = steps.groupBy(*keys, "step").agg(F.percentile("_eq", F.array(*[F.lit(p / 100) for p in levels])).alias("_q"))
    return out.select(*keys, "step", *[c("_q")[i].alias(f"p{p}") for i, p in enumerate(levels)])


def ruin_by_horizon(stats: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Share of paths ruined within each horizon, from `long_run`."""
    shares = F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.avg((F.coalesce(c("ruin_step") <= h, F.lit(False))).cast("int")).alias("ruin_probability")) for h in horizons])
    return stats.groupBy(*keys).agg(shares.alias("_h")).select(*keys, F.explode("_h").alias("_x")).select(*keys, "_x.*")


def kelly(daily: DataFrame, keys: Sequence[str] = ("strategy_id",), pnl: str = "pnl") -> DataFrame:
    mean, var = F.avg(pnl), F.var_pop(pnl)
    full = F.when(var > 0, mean / var).otherwise(0.0)
    return daily.groupBy(*keys).agg(full.alias("kelly"), (full / 2).alias("half_kelly"), (full / 4).alias("quarter_kelly"),
                                    F.when(var > 0, mean * mean / (2 * var)).otherwise(0.0).alias("expected_growth"))


def worst_streaks(paths: DataFrame, limit: float, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Deepest fall from a running high within the drawn days: its 5th percentile against a limit."""
    start = F.struct(F.lit(0.0).alias("eq"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("low"))

    def step(a: Column, x: Column) -> Column:
        eq = a["eq"] + x
        top = F.greatest(a["top"], eq)
        return F.struct(eq.alias("eq"), top.alias("top"), F.least(a["low"], eq - top).alias("low"))

    lows = paths.select(*keys, F.aggregate("pnl", start, step)["low"].alias("_low"))
    out = lows.groupBy(*keys).agg(F.percentile("_low", F.lit(0.05)).alias("p95_streak"))
    return out.withColumn("would_breach", c("p95_streak") < -limit)


STATES = 5


def _matrix(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of (from, to) as a dense row-normalised 5x5 table; an empty row becomes 0.2."""
    counts = pairs.groupBy(*keys, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    grid = pairs.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(STATES - 1))).alias("from_state")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(STATES - 1))).alias("to_state"))
    joined = grid.join(counts, [*keys, "from_state", "to_state"], "left").fillna(0, subset=["n"])
    total = F.sum("n").over(Window.partitionBy(*keys, "from_state"))
    return joined.withColumn("probability", F.when(total > 0, c("n") / total).otherwise(1.0 / STATES))


def regime_transitions(trades: DataFrame, keys: Sequence[str] = ("strategy_id",), time: str = "exit_time") -> DataFrame:
    """Day-to-day transition matrix of each day's most frequent regime (smallest on a tie)."""
    per_day = trades.groupBy(*keys, F.to_date(time).alias("day"), "regime").agg(F.count(F.lit(1)).alias("n"))
    dominant = per_day.groupBy(*keys, "day").agg(F.min(F.struct((-c("n")).alias("n"), "regime"))["regime"].alias("from_state"))
    by_day = Window.partitionBy(*keys).orderBy("day")
    pairs = dominant.withColumn("to_state", F.lead("from_state").over(by_day)).filter("to_state IS NOT NULL")
    return _matrix(pairs, keys)


def regime_pools(trades: DataFrame, keys: Sequence[str] = ("strategy_id",), time: str = "exit_time", pnl: str = "net_pnl") -> DataFrame:
    """Daily P&L with the day's dominant regime: the pools a regime-aware draw takes from."""
    per_day = trades.groupBy(*keys, F.to_date(time).alias("day"), "regime").agg(F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("p"))
    return per_day.groupBy(*keys, "day").agg(F.min(F.struct((-c("n")).alias("n"), "regime"))["regime"].alias("regime"), F.sum("p").alias("pnl"))


def trade_transitions(positioned: DataFrame, keys: Sequence[str] = ("strategy_id",), idx: str = "trade_idx") -> DataFrame:
    """Trade-to-trade transition matrix in exit order; the next trade is joined by position."""
    state = F.least(F.greatest(F.coalesce(c("regime").cast("int"), F.lit(4)), F.lit(0)), F.lit(4))
    now = positioned.select(*keys, idx, state.alias("from_state"))
    following = now.select(*keys, (c(idx) - 1).alias(idx), c("from_state").alias("to_state"))
    return _matrix(now.join(following, [*keys, idx]), keys)


def empirical_shares(trades: DataFrame, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    counts = trades.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy(*keys)))


def stationary(matrix: Sequence[Sequence[float]]) -> list[float]:
    """Long-run shares of a 5x5 transition matrix (an aggregate, small enough for the driver)."""
    values, vectors = np.linalg.eig(np.asarray(matrix, dtype=float).T)
    vector = np.abs(np.real(vectors[:, int(np.argmin(np.abs(values - 1)))]))
    return [float(x) for x in vector / vector.sum()]


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Counts per equal-width bin; bin 0 lies below and bin `bins` + 1 above the range."""
    return rows.groupBy(*keys, F.width_bucket(c(value), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---- rolling-start race over a real ledger ----

def rolling_start_race(
    ledger: DataFrame, risks: Sequence[float], daily_stops_pct: Sequence[float], max_trades: Sequence[int], days: int = 30,
    balance: float = 100_000.0, target_pct: float = 10.0, max_loss_pct: float = 10.0, daily_loss_pct: float = 5.0,
    every_days: int = 1, keys: Sequence[str] = ("strategy_id",), tie: str = "trade_id",
) -> DataFrame:
    """One attempt per (start day, setting): trades sized by a share of equity until pass, loss or timeout.

    Trades book at entry time.  At most `max(max_trades)` trades of a day can ever be
    taken, so later ones of the day are dropped first and a window's list stays bounded.
    """
    keys = list(keys)
    r = c("net_pnl") / c("initial_risk")
    clean = ledger.filter((c("initial_risk") > 0) & c("net_pnl").isNotNull()).select(*keys, "entry_time", tie, r.alias("r")).withColumn("_day", F.to_date("entry_time"))
    in_day = Window.partitionBy(*keys, "_day").orderBy("entry_time", tie)
    taken = clean.withColumn("_k", F.row_number().over(in_day)).filter(c("_k") <= max(max_trades))
    span = clean.groupBy(*keys).agg(F.min("_day").alias("_a"), F.max("_day").alias("_b"))
    last = F.greatest(F.date_sub("_b", days), c("_a"))
    starts = spread(span, *keys).select(*keys, F.explode(F.sequence(c("_a"), last, F.expr(f"INTERVAL {int(every_days)} DAYS"))).alias("start_day"))
    held = windows_of(taken, starts, "entry_time", days, keys)
    lists = held.groupBy(*keys, "start_day").agg(F.array_sort(F.collect_list(F.struct("entry_time", c(tie).alias("i"), "r", "_day", "_k"))).alias("_trades"))
    attempts = starts.join(lists, [*keys, "start_day"], "left").withColumn("_trades", F.coalesce("_trades", F.array().cast(lists.schema["_trades"].dataType)))
    grid = attempts
    for name, values in {"risk": risks, "daily_stop_pct": daily_stops_pct, "max_trades_per_day": max_trades}.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    goal, floor, limit = balance * (1 + target_pct / 100), balance * (1 - max_loss_pct / 100), balance * daily_loss_pct / 100
    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(
        F.lit(float(balance)).alias("eq"), F.lit(float(balance)).alias("peak"), F.lit(0.0).alias("dd"), none("date").alias("day"), F.lit(float(balance)).alias("open"),
        F.lit(0).alias("today"), F.lit(False).alias("halted"), F.lit(0).alias("taken"), none("string").alias("end"), none(ledger.schema["entry_time"].dataType).alias("at"))

    def step(a: Column, x: Column) -> Column:
        fresh = a["day"].isNull() | (a["day"] != x["_day"])
        opened, today = F.when(fresh, a["eq"]).otherwise(a["open"]), F.when(fresh, 0).otherwise(a["today"])
        halted = F.when(fresh, F.lit(False)).otherwise(a["halted"])
        live = a["end"].isNull()
        trade = live & ~halted & (today < c("max_trades_per_day"))
        eq = F.when(trade, a["eq"] * (1 + c("risk") * x["r"])).otherwise(a["eq"])
        peak = F.greatest(a["peak"], eq)
        lost = opened - eq
        end = F.when(trade, F.when(eq >= goal, "pass").when(eq <= floor, "max_loss").when(lost >= limit, "daily_loss"))
        new = {
            "eq": eq, "peak": peak, "dd": F.greatest(a["dd"], (peak - eq) / F.when(peak > 0, peak).otherwise(1.0) * 100), "day": x["_day"], "open": opened, "today": today + trade.cast("int"),
            "halted": halted | (trade & (lost >= balance * c("daily_stop_pct") / 100)), "taken": a["taken"] + trade.cast("int"), "end": end, "at": x["entry_time"]}
        return F.struct(*[F.when(live, v).otherwise(a[k]).alias(k) for k, v in new.items()])

    done = grid.withColumn("_z", F.aggregate("_trades", start, step))
    end = F.when(F.size("_trades") == 0, "no_trades").otherwise(F.coalesce(c("_z.end"), F.lit("timeout")))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return done.withColumns({
        "status": end, "trades_taken": c("_z.taken"), "ending_equity": c("_z.eq"), "max_drawdown_pct": c("_z.dd"),
        "days_to_target": F.when(end == "pass", (micros(c("_z.at")) - micros(c("start_day"))) / 86_400e6)}).drop("_trades", "_z")


def attempt_summary(attempts: DataFrame, keys: Sequence[str] = ("strategy_id", "risk", "daily_stop_pct", "max_trades_per_day")) -> DataFrame:
    """Rates, medians, best-month share and the ranking score of each setting."""
    keys = list(keys)
    passed = c("status") == "pass"
    failed = c("status").isin("max_loss", "daily_loss")
    total, active = F.count(F.lit(1)), F.count_if(c("status") != "no_trades")
    base = attempts.groupBy(*keys).agg(
        total.alias("start_windows"), active.alias("active_starts"), F.count_if(passed).alias("pass_count"), F.count_if(failed).alias("fail_count"),
        F.count_if(c("status") == "timeout").alias("timeout_count"), (F.count_if(passed) / total).alias("pass_rate"),
        F.when(active > 0, F.count_if(passed) / active).otherwise(0.0).alias("active_pass_rate"), (F.count_if(failed) / total).alias("fail_rate"),
        F.percentile("days_to_target", F.lit(0.5)).alias("median_days_to_target"), F.percentile(F.when(passed, c("trades_taken")), F.lit(0.5)).alias("median_trades_to_target"),
        F.avg("max_drawdown_pct").alias("mean_max_drawdown_pct"))
    months = attempts.filter(passed).groupBy(*keys, F.date_format("start_day", "yyyy-MM").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    best = months.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("best_month_pass_share"))
    out = base.join(best, keys, "left")
    score = (120 * c("active_pass_rate") + 60 * c("pass_rate") - 250 * c("fail_rate") - 4 * F.coalesce(c("median_days_to_target"), F.lit(30.0))
             - 1.5 * c("mean_max_drawdown_pct") - 20 * F.greatest(F.coalesce(c("best_month_pass_share"), F.lit(1.0)) - 0.4, F.lit(0.0)))
    return out.withColumn("score", score)
