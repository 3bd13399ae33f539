"""Labels that look forward; every column starts with `fwd_` or is a label by name.

Forward columns must never be joined into a feature table under a feature's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import full, non_zero
from tickloom.operators.outcomes import forward_path, touch
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.scan import CHUNK, over_chunks

c = F.col


def forward_return(w: WindowSpec, bars: int, price: str = "close", log: bool = False) -> dict[str, Column]:
    """Return over the next `bars` bars; NULL on the last ones."""
    ratio = F.lead(price, bars).over(w) / non_zero(c(price))
    return {f"fwd_ret_{bars}": F.log(ratio) if log else ratio - 1}


def excess_over_benchmark(w: WindowSpec, bars: int, benchmark: str, beta: float = 1.0) -> dict[str, Column]:
    """Forward return minus beta times the benchmark's, both columns of the same row."""
    own = F.lead("close", bars).over(w) / non_zero(c("close")) - 1
    market = F.lead(benchmark, bars).over(w) / non_zero(c(benchmark)) - 1
    return {f"fwd_excess_{bars}": own - beta * market}


def one_bar_return(w: WindowSpec) -> dict[str, Column]:
    return {"_one": c("close") / non_zero(F.lag("close").over(w)) - 1}


def excess_over_drift(w: WindowSpec, bars: int, rows: int = 500, minimum: int | None = None) -> dict[str, Column]:
    """Forward return minus the drift of the bars before; needs `one_bar_return` as an earlier stage."""
    minimum = max(2, rows // 5) if minimum is None else minimum
    f = w.rowsBetween(-rows, -1)
    drift = full(F.avg("_one").over(f), F.count("_one").over(f), minimum)
    return {f"fwd_detrended_{bars}": F.lead("close", bars).over(w) / non_zero(c("close")) - 1 - drift * bars}


def simple_atr(w: WindowSpec, length: int = 14) -> dict[str, Column]:
    """Plain mean of the true range (not Wilder's), from the first bar on; needs `true_range`."""
    return {"simple_atr": F.avg("_tr").over(w.rowsBetween(-length + 1, 0))}


def true_range(w: WindowSpec) -> dict[str, Column]:
    before = F.lag("close").over(w)
    return {"_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))}


def triple_barrier(
    bars: DataFrame, target_atr: float, stop_atr: float, max_hold: int, atr_length: int = 14, side: int = 1,
    entry: str = "close", keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Which of target, stop or timeout comes first; the stop wins on the same bar."""
    if target_atr <= 0 or stop_atr <= 0 or max_hold < 1 or side not in (1, -1):
        raise ValueError("multipliers must be positive, max_hold at least 1, side +1 or -1")
    framed = over_chunks(
        bars, true_range, lambda w: {**simple_atr(w, atr_length), "_path": forward_path(w, max_hold)},
        before=atr_length, after=max_hold, keys=keys, idx=idx, chunk=chunk)
    price, atr = c(entry), c("simple_atr")
    stop, target = price - side * stop_atr * atr, price + side * target_atr * atr
    hit = touch(c("_path"), stop, target, F.lit(side), max_hold)
    sized = (atr > 0) & price.isNotNull()
    return framed.withColumn("_hit", F.when(sized, hit)).withColumns({
        "label": F.when(c("_hit.outcome") == "target", 1).when(c("_hit.outcome") == "stop", -1).otherwise(0),
        "bars_to_hit": F.coalesce(c("_hit.held"), F.lit(max_hold)),
        "exit_price": F.coalesce(c("_hit.exit_price"), F.when(sized, c("close"))),
        "truncated": F.coalesce(c("_hit.truncated"), F.lit(True)),
    }).withColumns({
        "ret": side * (c("exit_price") / non_zero(price) - 1),
        "ret_r": F.when(c("label") == 1, F.lit(target_atr / stop_atr)).when(c("label") == -1, F.lit(-1.0))
        .otherwise(side * (c("exit_price") - price) / non_zero(stop_atr * atr)),
    }).drop("_path", "_hit", "_tr", "simple_atr")


def best_move(w: WindowSpec, bars: int) -> dict[str, Column]:
    """The larger of the up and down excursion over the next `bars` bars, signed."""
    f = w.rowsBetween(1, bars)
    base = non_zero(c("close"))
    up, down = F.max("high").over(f) / base - 1, 1 - F.min("low").over(f) / base
    return {f"fwd_best_move_{bars}": F.when(up >= down, up).otherwise(-down)}


def excursions(
    bars: DataFrame, horizon: int, threshold_atr: float = 0.6, sustain_bars: int = 4, exact_threshold: bool = True,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Best and worst excursion from the next open, the side of the first three bars, and
    whether the move was large and held.

    `exact_threshold=True` compares the bare price fraction with half of `threshold_atr`
    as a number, which holds for hardly any bar; False measures in ATR units.
    """
    def frames(w: WindowSpec) -> dict[str, Column]:
        three, ahead = w.rowsBetween(1, 3), w.rowsBetween(1, horizon)
        return {
            "_entry": F.lead("open").over(w), "_hi3": F.max("high").over(three), "_lo3": F.min("low").over(three),
            "_hi": F.max("high").over(ahead), "_lo": F.min("low").over(ahead),
            "_ahead": F.collect_list(F.struct(c("high").alias("h"), c("low").alias("l"))).over(ahead)}

    out = over_chunks(bars, frames, after=horizon, keys=keys, idx=idx, chunk=chunk)
    out = out.filter((c("_entry") != 0) & (c("atr14") != 0))
    long = (c("_hi3") - c("_entry")) > (c("_entry") - c("_lo3"))
    up, down = (c("_hi") - c("_entry")) / c("_entry"), (c("_entry") - c("_lo")) / c("_entry")
    gain = lambda x: F.when(long, x["h"] - c("_entry")).otherwise(c("_entry") - x["l"]) / (c("close") + 1e-9)
    limit = F.lit(threshold_atr * 0.5) * (F.lit(1.0) if exact_threshold else c("atr14") / non_zero(c("close")))
    run = F.aggregate(
        "_ahead", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, x: F.struct(
            F.when(gain(x) >= limit, s["now"] + 1).otherwise(0).alias("now"),
            F.greatest(s["best"], F.when(gain(x) >= limit, s["now"] + 1).otherwise(0)).alias("best")),
        lambda s: s["best"])
    return out.withColumns({
        "fwd_long": long.cast("int"), "fwd_mfe": F.when(long, up).otherwise(down), "fwd_mae": F.when(long, down).otherwise(up),
        "fwd_run": run,
    }).withColumn(
        "fwd_sustained",
        ((c("fwd_mfe") * c("close") / (c("atr14") + 1e-9) >= threshold_atr) & (c("fwd_run") >= sustain_bars)).cast("int"),
    ).drop("_entry", "_hi3", "_lo3", "_hi", "_lo", "_ahead")


def stop_target_sizes(
    moves: DataFrame, group: str, stop_quantile: float = 0.7, target_quantile: float = 0.6, minimum: int = 10,
    barrier_moves: DataFrame | None = None, excess: str | None = None,
) -> DataFrame:
    """Stop and target per group from the excursion quantiles, floor 0.0002, and the side.

    `barrier_moves(group, stop_dist, target_dist)` replaces the sizes by barrier medians
    where a group has three of each; `excess` names a column whose mean sign gives the side.
    """
    floor = lambda x: F.greatest(x, F.lit(0.0002))
    aggregates = [
        F.count(F.lit(1)).alias("n_samples"), F.avg("fwd_long").alias("long_share"), F.avg("fwd_sustained").alias("sustained_share")]
    if excess:
        aggregates.append(F.avg(excess).alias("_excess"))
    sizes = exact_quantiles(moves, [group], {"_sl": ("fwd_mae", stop_quantile), "_tp": ("fwd_mfe", target_quantile)})
    out = moves.groupBy(group).agg(*aggregates).filter(c("n_samples") >= minimum).join(sizes, group)
    out = out.select(group, "n_samples", floor(c("_sl")).alias("sl_pct"), floor(c("_tp")).alias("tp_pct"), *[n for n in out.columns if n not in (group, "n_samples", "_sl", "_tp")])
    side = (c("_excess") >= 0) if excess else (c("long_share") >= 0.5)
    out = out.withColumn("direction", F.when(side, "LONG").otherwise("SHORT"))
    if barrier_moves is not None:
        medians = exact_quantiles(barrier_moves, [group], {"_s": ("stop_dist", 0.5), "_t": ("target_dist", 0.5)})
        sized = barrier_moves.groupBy(group).agg(F.count("stop_dist").alias("_ns"), F.count("target_dist").alias("_nt")).join(medians, group)
        sized = sized.withColumns({"_s": floor(c("_s")), "_t": floor(c("_t"))})
        enough = (c("_ns") >= 3) & (c("_nt") >= 3)
        out = out.join(sized, group, "left").withColumns({
            "sl_pct": F.when(enough, c("_s")).otherwise(c("sl_pct")), "tp_pct": F.when(enough, c("_t")).otherwise(c("tp_pct")),
        }).drop("_ns", "_nt", "_s", "_t")
    return out.withColumn("implied_rr", c("tp_pct") / c("sl_pct")).drop("_excess")


def horizon_scores(
    bars: DataFrame, group: str, horizons: Sequence[int], exact_threshold: bool = True, minimum: int = 10,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Size-weighted sustained share of each horizon; `best` marks the winner, shorter on a tie."""
    parts = [
        excursions(bars, h, exact_threshold=exact_threshold, keys=keys, idx=idx, chunk=chunk)
        .groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_sustained").alias("share"))
        .filter(c("n") >= minimum).withColumn("horizon", F.lit(h)) for h in horizons]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    scored = stacked.groupBy("horizon").agg((F.sum(c("share") * c("n")) / F.sum("n") * 100).alias("score"))
    best = scored.agg(F.max_by("horizon", F.struct(F.round("score", 3), -c("horizon"))).alias("_best"))
    return scored.join(F.broadcast(best)).withColumn("best", c("horizon") == c("_best")).drop("_best")
