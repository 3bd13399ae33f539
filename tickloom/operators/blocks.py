"""Named signal blocks: conditions on the closed bar, one per side.

A block is a function `(need, params, side) -> Column`.  It asks `need` for the helper
columns it uses; helpers are shared between blocks and computed together in at most
four passes (day aggregates, bounded frames, rolling quantiles, forward fills), however
many blocks or parameter sets are evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import full, hours_between, non_zero, truth
from tickloom.operators.align import session_range, with_daily_levels
from tickloom.operators.scan import CHUNK, RollingQuantile, carry_last, over_chunks

c = F.col
Params = Mapping[str, object]
Block = Callable[["Need", Params, str], Column]
BLOCKS: dict[str, Block] = {}


def register_block(*names: str) -> Callable[[Block], Block]:
    """Add a block under its names; users extend the grammar with this."""
    def add(function: Block) -> Block:
        for name in names:
            BLOCKS[name] = function
        return function
    return add


class Need:
    """Collects helper columns and computes them in shared passes."""

    def __init__(self, columns: Sequence[str], idx: str = "bar_idx") -> None:
        self.columns, self.idx = set(columns), idx
        self.daily: dict[str, Column] = {}
        self.frames: dict[str, Callable[[WindowSpec], Column]] = {}
        self.late: dict[str, Callable[[WindowSpec], Column]] = {}
        self.quantiles: dict[str, RollingQuantile] = {}
        self.carries: dict[str, Column] = {}
        self.marks: dict[str, Column] = {}
        self.meanings: dict[str, object] = {}
        self.levels = False
        self.before = 0

    def _once(self, name: str, meaning: object) -> None:
        """One helper name must always mean one thing."""
        if self.meanings.setdefault(name, meaning) != meaning:
            raise ValueError(f"helper column {name} is registered with two meanings")

    def day(self, name: str, value: Column) -> Column:
        self._once(name, str(value))
        self.daily[name] = value
        return c(name)

    def previous_day(self, price: str) -> Column:
        self.levels = True
        return c(f"prev_day_{price}")

    def frame(self, name: str, reach: int, value: Callable[[WindowSpec], Column]) -> Column:
        self.frames[name] = value
        self.before = max(self.before, reach)
        return c(name)

    def after_frames(self, name: str, reach: int, value: Callable[[WindowSpec], Column]) -> Column:
        """A frame over a condition that itself needs frames; the reaches add up."""
        self.late[name] = value
        self.before = max(self.before, reach)
        return c(name)

    def quantile(self, name: str, spec: RollingQuantile) -> Column:
        self._once(name, spec)
        self.quantiles[name] = spec
        self.before = max(self.before, spec.rows + spec.shift)
        return c(name)

    def carry(self, name: str, value: Column) -> Column:
        self._once(name, str(value))
        self.carries[name] = value
        return c(name)

    def recently(self, name: str, condition: Column, rows: int) -> Column:
        """Whether a condition on carried columns held on one of the `rows` bars before this one."""
        self._once(name, str(condition))
        self.marks[name] = condition
        return c(self.idx) - c(name) <= rows

    def lag(self, column: str, rows: int = 1) -> Column:
        return self.frame(f"_{column}_lag{rows}", rows, lambda w: F.lag(column, rows).over(w))

    def value(self, column: str, default: float = 0.0) -> Column:
        return c(column) if column in self.columns else F.lit(default)

    def apply(self, frame: DataFrame, keys: Sequence[str] = ("symbol",), chunk: int = CHUNK) -> DataFrame:
        out = frame
        if self.daily or self.levels:
            out = with_daily_levels(out, self.daily, keys)
        stages = [lambda w: {n: f(w) for n, f in self.frames.items()}]
        if self.late:
            stages.append(lambda w: {n: f(w) for n, f in self.late.items()})
        if self.frames or self.late or self.quantiles:
            out = over_chunks(out, *stages, before=self.before + (2 if self.late else 0), keys=keys, idx=self.idx, chunk=chunk,
                              quantiles=self.quantiles or None, keep_chunk=bool(self.carries))
        if self.carries:
            out = carry_last(out, self.carries, keys, self.idx, chunk)
        if self.marks:
            # The carried position of the last bar that held, as seen from the bar before.
            when = {f"{name}_now": F.when(condition, c(self.idx)) for name, condition in self.marks.items()}
            out = carry_last(out, when, keys, self.idx, chunk, lagged={name: f"{name}_now" for name in self.marks})
        return out


# ---- shared helpers ----

def _f(params: Params, name: str, default: float) -> float:
    return float(params.get(name, default))


def _i(params: Params, name: str, default: int) -> int:
    return int(params.get(name, default))


def atr(need: Need) -> Column:
    return F.coalesce(need.carry("_atr", non_zero(need.value("atr14", 1.0))), F.lit(1.0))


def prior_high(need: Need, rows: int, price: str = "high") -> Column:
    frame = lambda w: w.rowsBetween(-rows, -1)
    return need.frame(f"_max_{price}_{rows}", rows, lambda w: full(F.max(price).over(frame(w)), F.count(price).over(frame(w)), rows))


def prior_low(need: Need, rows: int, price: str = "low") -> Column:
    frame = lambda w: w.rowsBetween(-rows, -1)
    return need.frame(f"_min_{price}_{rows}", rows, lambda w: full(F.min(price).over(frame(w)), F.count(price).over(frame(w)), rows))


def swings(need: Need, left: int, right: int) -> tuple[Column, Column]:
    span = left + right
    known = c(need.idx) >= span

    def confirmed(price: str, extreme: Callable[[str], Column]) -> Callable[[WindowSpec], Column]:
        def build(w: WindowSpec) -> Column:
            centre = F.lag(price, right).over(w)
            return F.when(known & (centre == extreme(price).over(w.rowsBetween(-span, 0))), centre)
        return build

    need.frame(f"_sh_{left}_{right}", span, confirmed("high", F.max))
    need.frame(f"_sl_{left}_{right}", span, confirmed("low", F.min))
    return (need.carry(f"_swing_high_{left}_{right}", c(f"_sh_{left}_{right}")),
            need.carry(f"_swing_low_{left}_{right}", c(f"_sl_{left}_{right}")))


def crossed_up(need: Need, level: Column) -> Column:
    return (c("close") > level) & (need.lag("close") <= level)


def crossed_down(need: Need, level: Column) -> Column:
    return (c("close") < level) & (need.lag("close") >= level)


def gap(need: Need, side: str) -> tuple[Column, Column, Column]:
    """Bounds of the latest three-bar gap of a side, and whether this bar made a new one."""
    high2, low2 = need.lag("high", 2), need.lag("low", 2)
    if side == "long":
        new = c("low") > high2
        lower, upper = F.when(new, high2), F.when(new, c("low"))
    else:
        new = c("high") < low2
        lower, upper = F.when(new, c("high")), F.when(new, low2)
    return need.carry(f"_gap_lower_{side}", lower), need.carry(f"_gap_upper_{side}", upper), truth(new)


def displaced(need: Need, side: str, range_atr: float, body: float) -> Column:
    directed = c("close") > c("open") if side == "long" else c("close") < c("open")
    return (need.value("rng_atr") >= range_atr) & (need.value("body_pct") >= body) & directed


def order_zone(need: Need, side: str, rows: int, range_atr: float) -> tuple[Column, Column]:
    """Range of the furthest opposite candle within `rows` bars before a displacement, carried."""
    moved = displaced(need, side, range_atr, 0.55)
    tag = f"{side}_{rows}_{str(range_atr).replace('.', '_')}"
    opposite = lambda k, w: F.lag("close", k).over(w) < F.lag("open", k).over(w) if side == "long" else F.lag("close", k).over(w) > F.lag("open", k).over(w)
    pick = lambda price: lambda w: F.when(moved, F.coalesce(*[F.when(opposite(k, w), F.lag(price, k).over(w)) for k in range(rows, 0, -1)]))
    need.frame(f"_zl_{tag}", rows, pick("low"))
    need.frame(f"_zh_{tag}", rows, pick("high"))
    return need.carry(f"_zone_low_{tag}", c(f"_zl_{tag}")), need.carry(f"_zone_high_{tag}", c(f"_zh_{tag}"))


def context(need: Need, side: str, mode: str) -> Column:
    """Agreement with the one-hour and four-hour trend; an unknown trend opposes nothing."""
    h1, h4 = need.value("h1_trend"), need.value("h4_trend")
    up1, down1, up4, down4 = truth(h1 > 0), truth(h1 < 0), truth(h4 > 0), truth(h4 < 0)
    if side == "short":
        up1, down1, up4, down4 = down1, up1, down4, up4
    modes = {"trend_aligned": up1 & up4, "avoid_h1_h4_opposite": ~down1 & ~down4, "avoid_h4_opposite": ~down4, "h1_turn_with_h4": up1 & ~down4}
    return modes.get(mode, F.lit(True))


def session_levels(need: Need, start: int, end: int) -> tuple[Column, Column]:
    return (need.day(f"_range_high_{start}_{end}", session_range("high", start, end)),
            need.day(f"_range_low_{start}_{end}", session_range("low", start, end)))


def swept(low_or_high: str, level: Column, buffer: Column, back: Column | None = None) -> Column:
    """The bar pierced `level` by `buffer` and closed back beyond it by `back`."""
    back = buffer if back is None else back
    if low_or_high == "low":
        return (c("low") < level - buffer) & (c("close") > level + back)
    return (c("high") > level + buffer) & (c("close") < level - back)


ZERO = F.lit  # a literal reads better at the call sites: ZERO(0.0)


# ---- structure ----

def _shift(need: Need, p: Params, side: str, left: int, right: int) -> Column:
    high, low = swings(need, left, right)
    buffer = atr(need) * _f(p, "buffer_atr", 0.0)
    return crossed_up(need, high + buffer) if side == "long" else crossed_down(need, low - buffer)


@register_block("market_structure_shift")
def market_structure_shift(need: Need, p: Params, side: str) -> Column:
    return _shift(need, p, side, _i(p, "swing_left", 2), _i(p, "swing_right", 2))


@register_block("break_of_structure")
def break_of_structure(need: Need, p: Params, side: str) -> Column:
    return market_structure_shift(need, p, side) & context(need, side, str(p.get("context", "avoid_h4_opposite")))


@register_block("change_of_character")
def change_of_character(need: Need, p: Params, side: str) -> Column:
    before = need.lag("h1_trend") if "h1_trend" in need.columns else F.lit(0.0)
    return market_structure_shift(need, p, side) & (before < 0 if side == "long" else before > 0)


@register_block("internal_structure_break")
def internal_structure_break(need: Need, p: Params, side: str) -> Column:
    return _shift(need, p, side, 1, 1)


@register_block("external_structure_break")
def external_structure_break(need: Need, p: Params, side: str) -> Column:
    return _shift(need, p, side, 4, 3)


@register_block("higher_timeframe_bias")
def higher_timeframe_bias(need: Need, p: Params, side: str) -> Column:
    return context(need, side, str(p.get("mode", "avoid_h4_opposite")))


@register_block("premium_discount")
def premium_discount(need: Need, p: Params, side: str) -> Column:
    high, low = swings(need, 3, 2)
    middle = (high + low) / 2
    return c("close") <= middle if side == "long" else c("close") >= middle


# ---- liquidity ----

@register_block("prior_day_liquidity", "prior_day_high_low")
def prior_day_liquidity(need: Need, p: Params, side: str) -> Column:
    buffer = atr(need) * _f(p, "buffer_atr", 0.0)
    price = "low" if side == "long" else "high"
    return swept(price, need.previous_day(price), buffer)


# Range hours (UTC) of the named session sweeps.
SWEEP_HOURS = {"asian_range_liquidity": (0, 6), "london_sweep": (6, 10), "ny_sweep": (12, 15)}


@register_block("session_liquidity", *SWEEP_HOURS)
def session_liquidity(need: Need, p: Params, side: str) -> Column:
    start, end = SWEEP_HOURS.get(str(p.get("name")), (_i(p, "range_start_utc", 0), _i(p, "range_end_utc", 6)))
    high, low = session_levels(need, start, end)
    buffer = atr(need) * _f(p, "buffer_atr", 0.0)
    trade = hours_between(c("time"), _i(p, "session_start_utc", end), _i(p, "session_end_utc", 24))
    return trade & (swept("low", low, buffer) if side == "long" else swept("high", high, buffer))


@register_block("equal_high_low_liquidity")
def equal_high_low_liquidity(need: Need, p: Params, side: str) -> Column:
    rows = _i(p, "lookback", 24)
    buffer, tolerance = atr(need) * _f(p, "buffer_atr", 0.0), atr(need) * _f(p, "tolerance_atr", 0.15)
    price = "low" if side == "long" else "high"
    top, bottom = prior_high(need, rows, price), prior_low(need, rows, price)
    level = bottom if side == "long" else top
    return (top - bottom <= tolerance) & swept(price, level, buffer, ZERO(0.0))


@register_block("stop_run_reclaim", "liquidity_sweep_reclaim")
def stop_run_reclaim(need: Need, p: Params, side: str) -> Column:
    rows = _i(p, "lookback", 24)
    pierce, back = atr(need) * _f(p, "penetration_atr", 0.05), atr(need) * _f(p, "reclaim_buffer_atr", 0.0)
    reach = non_zero(need.value("rng", 1.0))
    wick, place = _f(p, "wick_min", 0.35), _f(p, "close_location_min", 0.45)
    if side == "long":
        return swept("low", prior_low(need, rows), pierce, back) & (need.value("lwk_pct") >= wick) & ((c("close") - c("low")) / reach >= place)
    return swept("high", prior_high(need, rows), pierce, back) & (need.value("uwk_pct") >= wick) & ((c("high") - c("close")) / reach >= place)


@register_block("liquidity_pool_distance")
def liquidity_pool_distance(need: Need, p: Params, side: str) -> Column:
    rows = _i(p, "lookback", 24)
    distance = F.abs(c("close") - prior_low(need, rows)) if side == "long" else F.abs(prior_high(need, rows) - c("close"))
    return distance <= atr(need) * _f(p, "max_distance_atr", 0.8)


# ---- gaps and zones ----

@register_block("fair_value_gap", "fvg")
def fair_value_gap(need: Need, p: Params, side: str) -> Column:
    lower, upper, new = gap(need, side)
    if str(p.get("mode", "new_or_retrace")) == "new":
        return new
    return (c("low") <= upper) & (c("close") >= lower) if side == "long" else (c("high") >= lower) & (c("close") <= upper)


@register_block("inverse_fair_value_gap", "ifvg")
def inverse_fair_value_gap(need: Need, p: Params, side: str) -> Column:
    buffer = atr(need) * _f(p, "buffer_atr", 0.0)
    if side == "long":
        return crossed_up(need, gap(need, "short")[1] + buffer)
    return crossed_down(need, gap(need, "long")[0] - buffer)


@register_block("balanced_price_range")
def balanced_price_range(need: Need, p: Params, side: str) -> Column:
    rows = _i(p, "lookback", 12)

    def recent(kind: str) -> Column:
        new = gap(need, kind)[2]
        return need.after_frames(f"_recent_gap_{kind}_{rows}", rows + 2, lambda w: F.max(new.cast("int")).over(w.rowsBetween(-rows + 1, 0)))

    return (recent("long") > 0) & (recent("short") > 0)


@register_block("displacement_candle")
def displacement_candle(need: Need, p: Params, side: str) -> Column:
    return displaced(need, side, _f(p, "range_atr", 1.4), _f(p, "body_min", 0.55))


@register_block("fvg_fill", "fvg_mitigation", "fvg_mitigation_rejection")
def fvg_fill(need: Need, p: Params, side: str) -> Column:
    lower, upper, _ = gap(need, side)
    if side == "long":
        return (c("low") <= upper) & (c("close") > lower) & (c("close") > c("open"))
    return (c("high") >= lower) & (c("close") < upper) & (c("close") < c("open"))


@register_block("order_block", "mitigation_block", "rejection_block")
def order_block(need: Need, p: Params, side: str) -> Column:
    low, high = order_zone(need, side, _i(p, "ob_lookback", 5), _f(p, "displacement_atr", 1.4))
    touched = (c("low") <= high) & (c("close") >= low) if side == "long" else (c("high") >= low) & (c("close") <= high)
    if p.get("name") != "rejection_block":
        return touched
    return touched & (c("close") > c("open") if side == "long" else c("close") < c("open"))


@register_block("breaker_block")
def breaker_block(need: Need, p: Params, side: str) -> Column:
    """The opposite zone was broken within `retest_bars` before and is touched again.

    Zones are carried without bound, so "broken" is remembered as the last bar that broke one.
    """
    rows = _i(p, "retest_bars", 8)
    low, high = order_zone(need, "short" if side == "long" else "long", _i(p, "ob_lookback", 5), _f(p, "displacement_atr", 1.4))
    broken = c("close") > high if side == "long" else c("close") < low
    name = f"_broken_{side}_{rows}_{_i(p, 'ob_lookback', 5)}_{_f(p, 'displacement_atr', 1.4)!r}".replace(".", "d")
    retest = c("low") <= high if side == "long" else c("high") >= low
    return need.recently(name, broken, rows) & retest


@register_block("smt_divergence", "smt")
def smt_divergence(need: Need, p: Params, side: str) -> Column:
    proxy, rows = f"smt_{str(p.get('proxy', 'dxy')).lower()}", _i(p, "lookback", 24)
    if not {f"{proxy}_high", f"{proxy}_low"} <= need.columns:
        return F.lit(False)
    if side == "long":
        return (c("low") < prior_low(need, rows)) & ~truth(c(f"{proxy}_low") < prior_low(need, rows, f"{proxy}_low"))
    return (c("high") > prior_high(need, rows)) & ~truth(c(f"{proxy}_high") > prior_high(need, rows, f"{proxy}_high"))


# ---- sessions, volatility, candles ----

@register_block("opening_range_break", "opening_range_reversal")
def opening_range(need: Need, p: Params, side: str) -> Column:
    high, low = session_levels(need, _i(p, "range_start_utc", 0), _i(p, "range_end_utc", 1))
    buffer = atr(need) * _f(p, "buffer_atr", 0.0)
    trade = hours_between(c("time"), _i(p, "session_start_utc", 1), _i(p, "session_end_utc", 24))
    if p.get("name") == "opening_range_reversal":
        return trade & (swept("low", low, buffer, ZERO(0.0)) if side == "long" else swept("high", high, buffer, ZERO(0.0)))
    return trade & (crossed_up(need, high + buffer) if side == "long" else crossed_down(need, low - buffer))


@register_block("volatility_regime")
def volatility_regime(need: Need, p: Params, side: str) -> Column:
    mode = str(p.get("mode", "expansion"))
    if mode == "compression":
        q = _f(p, "quantile", 0.25)
        return c("bb_width") <= need.quantile(f"_width_q{q!r}_50".replace(".", "d"), RollingQuantile("bb_width", 200, q, 50))
    if mode == "high_vol_kill":
        return need.value("rng_atr") <= _f(p, "max_rng_atr", 3.0)
    return need.value("rng_atr") >= _f(p, "min_rng_atr", 1.0)


def day_open(need: Need) -> Column:
    return need.day("_day_open", F.min_by("open", "time"))


@register_block("trend_day")
def trend_day(need: Need, p: Params, side: str) -> Column:
    margin = atr(need) * _f(p, "trend_open_atr", 0.35)
    moved = c("close") > day_open(need) + margin if side == "long" else c("close") < day_open(need) - margin
    return context(need, side, "trend_aligned") & moved


def weekdays(text: str) -> list[int]:
    values = [int(item) for item in text.split(",") if item.strip()]
    if any(not 0 <= v <= 6 for v in values):
        raise ValueError("weekdays run from 0 (Monday) to 6 (Sunday)")
    return values or [0, 1, 2, 3, 4]


@register_block("day_time_filter")
def day_time_filter(need: Need, p: Params, side: str) -> Column:
    return F.weekday("time").isin(*weekdays(str(p.get("weekdays", "0,1,2,3,4")))) & hours_between(
        c("time"), _i(p, "session_start_utc", 0), _i(p, "session_end_utc", 24))


@register_block("trend_pullback")
def trend_pullback(need: Need, p: Params, side: str) -> Column:
    ema, near = c(f"ema{_i(p, 'ema_length', 20)}"), atr(need) * _f(p, "pullback_atr", 0.5)
    trigger = _f(p, "rsi_trigger", 50)
    if side == "long":
        return (c("low") <= ema + near) & (c("close") > ema) & (need.value("rsi14") > trigger)
    return (c("high") >= ema - near) & (c("close") < ema) & (need.value("rsi14") < 100 - trigger)


@register_block("inside_bar_expansion")
def inside_bar_expansion(need: Need, p: Params, side: str) -> Column:
    buffer = atr(need) * _f(p, "buffer_atr", 0.0)
    out = c("close") > need.lag("high", 2) + buffer if side == "long" else c("close") < need.lag("low", 2) - buffer
    return (need.lag("inside_bar") > 0) & out


@register_block("failed_breakout_reversal")
def failed_breakout_reversal(need: Need, p: Params, side: str) -> Column:
    rows, buffer = _i(p, "lookback", 24), atr(need) * _f(p, "buffer_atr", 0.0)
    if side == "long":
        return swept("low", prior_low(need, rows), buffer, ZERO(0.0)) & (c("close") > c("open"))
    return swept("high", prior_high(need, rows), buffer, ZERO(0.0)) & (c("close") < c("open"))


@register_block("volatility_spike_reversal")
def volatility_spike_reversal(need: Need, p: Params, side: str) -> Column:
    extreme, wick = _f(p, "rsi_extreme", 30.0), _f(p, "wick_min", 0.45)
    wide = need.value("rng_atr") >= _f(p, "spike_range_atr", 1.8)
    if side == "long":
        return wide & (need.value("rsi14") <= extreme) & ((c("close") > c("open")) | (need.value("lwk_pct") >= wick))
    return wide & (need.value("rsi14") >= 100 - extreme) & ((c("close") < c("open")) | (need.value("uwk_pct") >= wick))


# ---- combination ----

def block_condition(need: Need, block: Params, side: str) -> Column:
    name = str(block.get("name", ""))
    if name not in BLOCKS:
        raise ValueError(f"unsupported signal block: {name}")
    return truth(BLOCKS[name](need, block, side))


def evaluate_blocks(
    frame: DataFrame, blocks: Sequence[Params], keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """One row per bar with an int column `b<i>_long` and `b<i>_short` per block."""
    need = Need(frame.columns, idx)
    flags = {f"b{i}_{side}": block_condition(need, block, side).cast("int") for i, block in enumerate(blocks) for side in ("long", "short")}
    return need.apply(frame, keys, chunk).withColumns(flags).select(*frame.columns, *flags)


def grammar_signals(
    frame: DataFrame, spec: Params, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Combine a spec's `rule_blocks` by all, any or vote, and size stop, target, hold and trail.

    The short side is evaluated after the long one and wins where both hold.
    """
    need = Need(frame.columns, idx)
    columns = grammar_columns(need, spec)
    return need.apply(frame, keys, chunk).withColumns(columns).select(*frame.columns, *columns)


def grammar_columns(need: Need, spec: Params) -> dict[str, Column]:
    blocks = list(spec.get("rule_blocks") or [])
    if not blocks:
        return {"signal_direction": F.lit(0), "stop_distance": F.lit(0.0), "target_distance": F.lit(0.0),
                "signal_target_price": F.lit(0.0), "trail_atr": F.lit(0.0), "max_hold_bars": F.lit(0)}
    mode = str(spec.get("block_logic", "all"))
    votes = int(spec.get("min_block_votes", max(1, math.ceil(len(blocks) * 0.7))))

    def fires(side: str) -> Column:
        flags = [block_condition(need, block, side) for block in blocks]
        count = sum((flag.cast("int") for flag in flags), F.lit(0))
        least = {"vote": votes, "any": 1}.get(mode, len(blocks))
        return count >= least

    direction = F.when(fires("short"), -1).when(fires("long"), 1).otherwise(0)
    unit = atr(need)
    stop = unit * _f(spec, "atr_stop", 1.0)
    if str(spec.get("stop_mode", "atr")) == "structure":
        high, low = swings(need, 2, 2)
        bound = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, unit * 0.5), stop * 2.0))
        side_stop = F.when(direction > 0, bound(F.abs(c("close") - low))).when(direction < 0, bound(F.abs(high - c("close"))))
        stop = F.when(direction == 0, stop).otherwise(side_stop)
    return {
        "signal_direction": direction, "stop_distance": stop, "target_distance": stop * _f(spec, "reward_risk", 1.25),
        "signal_target_price": F.lit(0.0), "trail_atr": F.lit(_f(spec, "atr_trail", 0.0)), "max_hold_bars": F.lit(_i(spec, "max_hold_bars", 8))}
