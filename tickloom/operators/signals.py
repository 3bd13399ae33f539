"""Named signal families: parameters to direction, stop, target, hold and trail columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import full, hours_between, non_zero, truth
from tickloom.operators.blocks import Need, context, crossed_down, crossed_up, day_open, grammar_columns, prior_high, prior_low, session_levels, swept, weekdays
from tickloom.operators.scan import CHUNK, RollingQuantile, over_chunks

c = F.col
Params = Mapping[str, object]
# A family returns (long, short, extras); extras may hold target, target_price, trail, hold
# and first_of_day = "side" (each side once a day) or "either" (the first of both).
Family = Callable[[Need, Params], tuple[Column, Column, dict]]
FAMILIES: dict[str, Family] = {}


def register_family(function: Family) -> Family:
    FAMILIES[function.__name__] = function
    return function


def _by_context(need: Need, p: Params, default: str) -> tuple[Column, Column]:
    mode = str(p.get("context_filter", default))
    if mode not in ("trend_aligned", "avoid_h1_h4_opposite", "avoid_h4_opposite", "h1_turn_with_h4", "none"):
        raise ValueError(f"unsupported context filter: {mode}")
    return context(need, "long", mode), context(need, "short", mode)


def _rewarded(p: Params, hold: int | None = None) -> dict:
    return {"reward": float(p["reward_risk"]), "hold": int(p["max_hold_bars"]) if hold is None else hold}


def _hours(p: Params, a: str, b: str) -> tuple[int, int]:
    start, end = int(p[a]), int(p[b])
    if not 0 <= start < end <= 24:
        raise ValueError(f"{a}/{b} must define a window that does not wrap midnight")
    return start, end


def _rsi_cross(need: Need, p: Params) -> tuple[Column, Column]:
    level = float(p["rsi_trigger"])
    before, now = need.lag("rsi14"), c("rsi14")
    return (before <= level) & (now > level), (before >= 100 - level) & (now < 100 - level)


@register_family
def time_series_breakout(need: Need, p: Params):
    rows = int(p["channel_bars"])
    long, short = (context(need, s, "trend_aligned") for s in ("long", "short"))
    return (c("close") > prior_high(need, rows)) & long, (c("close") < prior_low(need, rows)) & short, {
        "trail": float(p["atr_trail"]), "hold": int(p["max_hold_bars"])}


@register_family
def session_range_breakout(need: Need, p: Params):
    start, end = _hours(p, "range_start_utc", "range_end_utc")
    high, _ = session_levels(need, start, end)
    trade = hours_between(c("time"), int(p["session_start_utc"]), int(p["session_end_utc"]))
    once = "side" if bool(p.get("first_breakout_per_day", True)) else None
    return crossed_up(need, high) & trade & context(need, "long", "trend_aligned"), F.lit(False), {
        "trail": float(p["atr_trail"]), "hold": int(p["max_hold_bars"]), "first_of_day": once}


@register_family
def trend_pullback(need: Need, p: Params):
    ema, near = c(f"ema{int(p['ema_length'])}"), c("atr14") * float(p["pullback_atr"])
    up, down = _rsi_cross(need, p)
    long = (c("low") <= ema + near) & (c("close") > ema) & up & context(need, "long", "trend_aligned")
    short = (c("high") >= ema - near) & (c("close") < ema) & down & context(need, "short", "trend_aligned")
    return long, short, _rewarded(p, 96)


@register_family
def volatility_expansion(need: Need, p: Params):
    rows, q = int(p["lookback"]), float(p["squeeze_quantile"])
    threshold = need.quantile(f"_squeeze_{q!r}".replace(".", "d"), RollingQuantile("bb_width", 200, q, 100, shift=1))
    ready = (need.lag("bb_width") <= threshold) & (c("vol_ratio") >= float(p["volume_ratio"]))
    opposed = lambda side: ~truth(c("h1_trend") < 0) if side == "long" else ~truth(c("h1_trend") > 0)
    return ready & (c("close") > prior_high(need, rows)) & opposed("long"), ready & (c("close") < prior_low(need, rows)) & opposed("short"), \
        _rewarded(p, max(32, rows * 2))


def _rolling_mean(need: Need, rows: int) -> Column:
    f = lambda w: w.rowsBetween(-rows + 1, 0)
    return need.frame(f"_mean_{rows}", rows, lambda w: full(F.avg("close").over(f(w)), F.count("close").over(f(w)), rows))


@register_family
def regime_mean_reversion(need: Need, p: Params):
    rows, extreme, entry = int(p["z_length"]), float(p["rsi_extreme"]), float(p["z_entry"])
    f = lambda w: w.rowsBetween(-rows + 1, 0)
    mean = _rolling_mean(need, rows)
    sigma = need.frame(f"_sigma_{rows}", rows, lambda w: full(F.stddev_pop("close").over(f(w)), F.count("close").over(f(w)), rows))
    z = (c("close") - mean) / non_zero(sigma)
    flat = F.abs(c("h1_ema50") - c("h1_ema200")) / non_zero(c("h1_atr14")) < 0.75
    return (z <= -entry) & (c("rsi14") <= extreme) & flat, (z >= entry) & (c("rsi14") >= 100 - extreme) & flat, {
        "target_price": mean, "hold": int(p["max_hold_bars"])}


@register_family
def liquidity_sweep_reclaim(need: Need, p: Params):
    rows = int(p["sweep_lookback"])
    pierce, back = c("atr14") * float(p["penetration_atr"]), c("atr14") * float(p["reclaim_buffer_atr"])
    wick, place, reach = float(p["wick_reject_min"]), float(p.get("close_location_min", 0.45)), non_zero(c("rng"))
    long, short = _by_context(need, p, "avoid_h4_opposite")
    long = swept("low", prior_low(need, rows), pierce, back) & (c("lwk_pct") >= wick) & ((c("close") - c("low")) / reach >= place) & long
    short = swept("high", prior_high(need, rows), pierce, back) & (c("uwk_pct") >= wick) & ((c("high") - c("close")) / reach >= place) & short
    return long, short, {**_rewarded(p), "first_of_day": "side" if bool(p.get("first_signal_per_day", False)) else None}


@register_family
def failed_breakout_reversal(need: Need, p: Params):
    rows = int(p["channel_bars"])
    pierce, back = c("atr14") * float(p["break_atr"]), c("atr14") * float(p["close_back_atr"])
    long, short = _by_context(need, p, "none")
    return (swept("low", prior_low(need, rows), pierce, back) & (c("close") > c("open")) & long,
            swept("high", prior_high(need, rows), pierce, back) & (c("open") > c("close")) & short, _rewarded(p))


@register_family
def prior_day_level_continuation(need: Need, p: Params):
    buffer = c("atr14") * float(p["break_buffer_atr"])
    long, short = _by_context(need, p, "avoid_h4_opposite")
    return (crossed_up(need, need.previous_day("high") + buffer) & long, crossed_down(need, need.previous_day("low") - buffer) & short,
            {**_rewarded(p), "first_of_day": "side" if bool(p.get("first_signal_per_day", True)) else None})


@register_family
def volatility_spike_reversal(need: Need, p: Params):
    style, extreme = str(p.get("spike_style", "capitulation")), float(p["rsi_extreme"])
    wide = c("rng_atr") >= float(p["spike_range_atr"])
    long, short = _by_context(need, p, "none")
    low, high = c("rsi14") <= extreme, c("rsi14") >= 100 - extreme
    if style == "wick_reject":
        place = (c("close") - c("low")) / non_zero(c("rng"))
        wick, least = float(p["wick_min"]), float(p["close_location_min"])
        return wide & (c("lwk_pct") >= wick) & (place >= least) & low & long, wide & (c("uwk_pct") >= wick) & (place <= 1 - least) & high & short, _rewarded(p)
    if style != "capitulation":
        raise ValueError(f"unsupported spike style: {style}")
    wide = wide & (c("body_pct") >= float(p["body_min"]))
    return wide & (c("close") < c("open")) & low & long, wide & (c("close") > c("open")) & high & short, _rewarded(p)


@register_family
def opening_range_continuation_reversal(need: Need, p: Params):
    start, end = _hours(p, "range_start_utc", "range_end_utc")
    high, low = session_levels(need, start, end)
    buffer = c("atr14") * float(p["break_buffer_atr"])
    long, short = _by_context(need, p, "avoid_h4_opposite")
    trade = hours_between(c("time"), int(p["session_start_utc"]), int(p["session_end_utc"]))
    mode = str(p["opening_range_mode"])
    if mode == "continuation":
        up, down = crossed_up(need, high + buffer), crossed_down(need, low - buffer)
    elif mode == "reversal":
        sweep = c("atr14") * float(p["sweep_atr"])
        up, down = swept("low", low, sweep, buffer), swept("high", high, sweep, buffer)
    else:
        raise ValueError(f"unsupported opening range mode: {mode}")
    return up & trade & long, down & trade & short, {
        **_rewarded(p), "first_of_day": "either" if bool(p.get("first_signal_per_day", True)) else None}


@register_family
def trend_day_pullback(need: Need, p: Params):
    ema, margin, near = c(f"ema{int(p['ema_length'])}"), c("atr14") * float(p["trend_open_atr"]), c("atr14") * float(p["pullback_atr"])
    least = float(p.get("rolling_sharpe_min", -999.0))
    up, down = _rsi_cross(need, p)
    opened = day_open(need)
    long = context(need, "long", "trend_aligned") & (c("close") > opened + margin) & (c("low") <= ema + near) & (c("close") > ema) & up & (c("rolling_sharpe") >= least)
    short = context(need, "short", "trend_aligned") & (c("close") < opened - margin) & (c("high") >= ema - near) & (c("close") < ema) & down & (c("rolling_sharpe") <= -least)
    return long, short, _rewarded(p)


# Regimes that each regime mode admits.
REGIME_MODES = {"any": None, "trend": [0, 1], "compression": [2], "range_or_transition": [3, 4]}


@register_family
def day_time_regime_filter(need: Need, p: Params):
    mode = str(p.get("regime_mode", "any"))
    if mode not in REGIME_MODES:
        raise ValueError(f"unsupported regime mode: {mode}")
    allowed = F.weekday("time").isin(*weekdays(str(p["weekdays"])))
    if REGIME_MODES[mode] is not None:
        allowed = allowed & need.value("regime", 4).isin(*REGIME_MODES[mode])
    rows, margin = int(p["momentum_bars"]), c("atr14") * float(p["momentum_atr"])
    long, short = _by_context(need, p, "avoid_h4_opposite")
    kind = str(p["signal_mode"])
    if kind == "momentum":
        before = need.lag("close", rows)
        up, down = c("close") > before + margin, c("close") < before - margin
    elif kind == "reversal":
        mean, extreme = _rolling_mean(need, rows), float(p["rsi_extreme"])
        up, down = (c("close") < mean - margin) & (c("rsi14") <= extreme), (c("close") > mean + margin) & (c("rsi14") >= 100 - extreme)
    else:
        raise ValueError(f"unsupported signal mode: {kind}")
    return up & long & allowed, down & short & allowed, _rewarded(p)


@register_family
def inside_bar_expansion(need: Need, p: Params):
    buffer = c("atr14") * float(p["break_buffer_atr"])
    ready = (need.lag("inside_bar") > 0) & (c("vol_ratio") >= float(p["volume_ratio"]))
    long, short = _by_context(need, p, "avoid_h4_opposite")
    return ready & (c("close") > need.lag("high", 2) + buffer) & long, ready & (c("close") < need.lag("low", 2) - buffer) & short, _rewarded(p)


# ---- filters common to all families ----

LONG_MINIMUMS = {"breakout_body_min": "body_pct", "breakout_range_atr_min": "rng_atr", "rsi_min_long": "rsi14",
                 "macd_norm_min_long": "macd_norm", "previous_session_bias_min": "prev_sess_bias"}


def _common_filters(direction: Column, p: Params) -> Column:
    mode = str(p.get("direction_mode", "both"))
    if mode not in ("both", "long_only", "short_only"):
        raise ValueError(f"unsupported direction mode: {mode}")
    keep = {"both": F.lit(True), "long_only": direction > 0, "short_only": direction < 0}[mode]
    start, end = int(p.get("session_start_utc", 0)), int(p.get("session_end_utc", 24))
    if not (0 <= start <= 23 and 1 <= end <= 24 and start < end):
        raise ValueError("session_start_utc/session_end_utc must define a window that does not wrap midnight")
    keep = keep & hours_between(c("time"), start, end)
    volatility = str(p.get("volatility_filter", "none"))
    if volatility == "h4_above_60d_median":
        keep = keep & truth(c("h4_atr_pct") > c("h4_atr_median"))
    elif volatility != "none":
        raise ValueError(f"unsupported volatility filter: {volatility}")
    weak = F.lit(False)
    for name, column in LONG_MINIMUMS.items():
        if name in p:
            weak = weak | truth(c(column) < float(p[name]))
    if "breakout_close_location_min" in p:
        weak = weak | truth((c("close") - c("low")) / non_zero(c("rng")) < float(p["breakout_close_location_min"]))
    return F.when(keep & ~((direction > 0) & weak), direction).otherwise(0)


def _once_a_day(frame: DataFrame, flags: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """Keep the first true row per key and day of each named flag; `either` names pair both sides."""
    day = Window.partitionBy(*keys, F.to_date("time")).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({target: F.sum(c(source).cast("int")).over(day) == 1 for target, source in flags.items()})


def signals(
    frame: DataFrame, strategies: Sequence[tuple[str, str, Params]], keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Evaluate many `(strategy_id, family, parameters)` in one pass over the feature table.

    Returns one row per (strategy, bar) that signals, with side, stop, target, hold and
    trail.  Helper columns are shared; batches of some hundred strategies keep the plan
    within what code generation takes, so split longer lists.
    """
    need = Need(frame.columns, idx)
    masks: dict[str, Column] = {}
    firsts: dict[str, str] = {}
    built = []
    for i, (name, family, p) in enumerate(strategies):
        if family == "strategy_grammar":
            columns = grammar_columns(need, p)
            raw = columns["signal_direction"]
            extras = {}
        else:
            if family not in FAMILIES:
                raise ValueError(f"unsupported signal family: {family}")
            long, short, extras = FAMILIES[family](need, p)
            masks[f"_l{i}"], masks[f"_s{i}"] = truth(long), truth(short)
            once = extras.get("first_of_day")
            long_ok, short_ok = c(f"_l{i}"), c(f"_s{i}")
            if once == "side":
                firsts |= {f"_fl{i}": f"_l{i}", f"_fs{i}": f"_s{i}"}
                long_ok, short_ok = long_ok & c(f"_fl{i}"), short_ok & c(f"_fs{i}")
            elif once == "either":
                masks[f"_e{i}"] = truth(long) | truth(short)
                firsts[f"_fe{i}"] = f"_e{i}"
                long_ok, short_ok = long_ok & c(f"_fe{i}"), short_ok & c(f"_fe{i}")
            raw = F.when(short_ok, -1).when(long_ok, 1).otherwise(0)
            stop = c("atr14") * float(p["atr_stop"])
            columns = {
                "stop_distance": stop, "target_distance": stop * extras["reward"] if "reward" in extras else F.lit(0.0),
                "signal_target_price": extras.get("target_price", F.lit(0.0)), "trail_atr": F.lit(float(extras.get("trail", 0.0))),
                "max_hold_bars": F.lit(int(extras["hold"]))}
        sized = {k: F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in columns.items() if k != "signal_direction"}
        built.append(F.struct(F.lit(name).alias("strategy_id"), F.lit(family).alias("lineage"), _common_filters(raw, p).alias("signal_direction"), *sized.values()))
    out = need.apply(frame, keys, chunk).withColumns(masks) if masks else need.apply(frame, keys, chunk)
    if firsts:
        out = _once_a_day(out, firsts, keys)
    fired = F.filter(F.array(*built), lambda x: x["signal_direction"] != 0)
    return out.withColumn("_fired", F.explode(fired)).select(*keys, idx, "time", "_fired.*")


def volatility_median(
    frame: DataFrame, column: str = "h4_atr_pct", name: str = "h4_atr_median", per_day: int = 96, days: int = 60, least_days: int = 20,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
) -> DataFrame:
    """Add the rolling median of a slow timeframe's column over the execution bars of `days` days.

    Counts execution bars (`per_day` of them a day: 96 of a quarter of an hour make windows of 5,760 with
    1,920 at least).  Only key, position and value go through the rolling pass, in lots of four windows,
    each with one window of earlier rows before it.
    """
    rows = days * per_day
    spec = RollingQuantile(column, rows, 0.5, least_days * per_day)
    slim = over_chunks(frame.select(*keys, idx, column), lambda w: {}, before=rows, keys=keys, idx=idx, chunk=4 * rows, quantiles={name: spec})
    return frame.join(slim.select(*keys, idx, name), [*keys, idx])


def h4_volatility_median(slow: DataFrame, rows: int = 5760, minimum: int = 1920, per_bar: int = 16, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK) -> DataFrame:
    """A cheaper stand-in for `volatility_median`: the median over the slow timeframe's own bars.

    Each slow bar stands for `per_bar` execution bars, so the window shrinks by that factor.
    """
    spec = RollingQuantile("atr_pct", max(1, rows // per_bar), 0.5, max(1, minimum // per_bar))
    return over_chunks(slow, lambda w: {}, before=spec.rows, keys=keys, idx=idx, chunk=chunk, quantiles={"h4_atr_median": spec})


# ---- box signals of a saved strategy ----

def box_signal(bounds: Mapping[str, tuple[float, float]], sessions: Sequence[int], max_spread: float | None = None) -> Column:
    """All bounds hold, the session is switched on, and the spread is within its cap."""
    ok = c("session").isin(*sessions) if sessions else F.lit(False)
    for name, (lo, hi) in bounds.items():
        ok = ok & F.coalesce(c(name), F.lit(0)).between(lo, hi)
    return ok & (c("spread") <= max_spread) if max_spread else ok


def discriminated_side(column: str, threshold: float, above_is_long: bool = True) -> Column:
    side = 1 if above_is_long else -1
    return F.when(F.coalesce(c(column), F.lit(0)) >= threshold, side).otherwise(-side)
