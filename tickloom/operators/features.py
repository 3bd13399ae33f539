"""Trailing indicator columns on bars.

`base_features` needs the recursive smoothers and costs one shuffle; `add_frames` adds
every bounded-frame column and costs a second one.  Both work per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, flag, full, non_zero, session_id
from tickloom.operators.scan import CHUNK, RollingQuantile, carry_last, ema, exp_smooth, over_chunks, wilder
from tickloom.operators.bars import session_starts
from tickloom.schema import require_columns
from tickloom.session import cut_lineage

c = F.col


def macd_signal(fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """The smoothed MACD line as a combination of EMAs of the close.

    Two smoothers in a row answer like the difference of both taken alone (partial
    fractions), so the signal line needs no second scan.  The weights sum to zero.
    """
    alpha = {n: 2.0 / (n + 1) for n in (fast, slow, signal)}
    keep = {n: 1 - alpha[n] for n in (fast, slow, signal)}

    def cascade(n: int) -> Column:
        gap = keep[signal] - keep[n]
        return (c(f"_ema{signal}") * alpha[n] * keep[signal] - c(f"_ema{n}") * alpha[signal] * keep[n]) / gap

    return cascade(fast) - cascade(slow)


def base_features(
    bars: DataFrame, session_offset: int = 0, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """EMA 20/50/200, RSI, ATR, MACD, trend, candle anatomy and session."""
    require_columns(bars, [*keys, idx, "time", "open", "high", "low", "close"], "bars")

    def previous(w: WindowSpec) -> dict[str, Column]:
        before = F.lag("close").over(w)
        return {
            "_gain": F.greatest(c("close") - before, F.lit(0.0)),
            "_loss": F.greatest(before - c("close"), F.lit(0.0)),
            "_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)),
        }

    out = over_chunks(bars, previous, before=1, keys=keys, idx=idx, chunk=chunk, keep_chunk=True)
    out = out.withColumns({
        name: F.when(c(idx) > 0, c(name)) for name in ("_gain", "_loss")})
    out = exp_smooth(out, {
        "ema20": ema("close", 20), "ema50": ema("close", 50), "ema200": ema("close", 200),
        "_ema9": ema("close", 9), "_ema12": ema("close", 12), "_ema26": ema("close", 26),
        "_up": wilder("_gain", 14, start=1), "_down": wilder("_loss", 14, start=1), "atr14": wilder("_tr", 14),
    }, keys, idx, chunk)
    histogram = c("_ema12") - c("_ema26") - macd_signal()
    rising = (c("ema20") > c("ema50")) & (c("ema50") > c("ema200"))
    falling = (c("ema20") < c("ema50")) & (c("ema50") < c("ema200"))
    atr = non_zero(c("atr14"))
    body_top, body_bottom = F.greatest("open", "close"), F.least("open", "close")
    reach = non_zero(c("high") - c("low"))
    return out.withColumns({
        "rsi14": 100 - 100 / (1 + c("_up") / non_zero(c("_down"))),
        "macd_hist": histogram,
        "trend": F.when(rising, 1).when(falling, -1).otherwise(0),
        "rng": c("high") - c("low"),
        "body": F.abs(c("close") - c("open")),
        "uwk": c("high") - body_top,
        "lwk": body_bottom - c("low"),
        "bull": (c("close") >= c("open")).cast("int"),
        "body_pct": F.abs(c("close") - c("open")) / reach,
        "uwk_pct": (c("high") - body_top) / reach,
        "lwk_pct": (body_bottom - c("low")) / reach,
        "rng_atr": (c("high") - c("low")) / atr,
        "atr_pct": c("atr14") / non_zero(c("close")),
        "macd_norm": histogram / atr,
        "session": session_id(c("time"), session_offset),
    }).drop("_gain", "_loss", "_tr", "_up", "_down", "_ema9", "_ema12", "_ema26")


# ---- bounded frames; each function maps the chunk window to columns ----

def bands(w: WindowSpec) -> dict[str, Column]:
    f = w.rowsBetween(-19, 0)
    n = F.count("close").over(f)
    mid = full(F.avg("close").over(f), n, 20)
    sigma = full(F.stddev_pop("close").over(f), n, 20)
    return {"bb_up": mid + 2 * sigma, "bb_mid": mid, "bb_lo": mid - 2 * sigma, "bb_width": (mid + 2 * sigma - (mid - 2 * sigma)) / non_zero(mid)}


def _volume() -> Column:
    return F.coalesce(non_zero(c("volume").cast("double")), F.lit(1.0))


def volume_ratio(w: WindowSpec) -> dict[str, Column]:
    return {"vol_ratio": clip(_volume() / F.avg(_volume()).over(w.rowsBetween(-19, 0)), 0, 5)}


def volume_confirmation(w: WindowSpec) -> dict[str, Column]:
    loud = c("vol_ratio") > 1.2
    return {
        "vol_body_conf": clip(c("vol_ratio") * c("body_pct"), 0, 5),
        "vol_price_div": F.when((c("close") < c("open")) & loud, 1.0)
        .when((c("close") > c("open")) & ~loud, -1.0).otherwise(0.0),
        "bb_expanding": flag(c("bb_width") > F.lag("bb_width", 3).over(w)),
    }


def stochastic(w: WindowSpec) -> dict[str, Column]:
    f = w.rowsBetween(-13, 0)
    lo, hi = F.min("low").over(f), F.max("high").over(f)
    return {"stoch_k": clip(100 * (c("close") - lo) / (hi - lo + 1e-9), 0, 100)}


def stochastic_signal(w: WindowSpec) -> dict[str, Column]:
    return {"stoch_d": F.avg("stoch_k").over(w.rowsBetween(-2, 0))}


def candle_patterns(w: WindowSpec) -> dict[str, Column]:
    high, low = F.lag("high").over(w), F.lag("low").over(w)
    return {
        "pin_bar": F.coalesce(clip(F.greatest("uwk", "lwk") / non_zero(c("rng")), 0, 1), F.lit(0.0)),
        "inside_bar": flag((c("high") < high) & (c("low") > low)),
        "outside_bar": flag((c("high") > high) & (c("low") < low)),
    }


def returns(w: WindowSpec) -> dict[str, Column]:
    return {"_ret": c("close") / non_zero(F.lag("close").over(w)) - 1}


def rolling_sharpe(w: WindowSpec) -> dict[str, Column]:
    f = w.rowsBetween(-19, 0)
    n = F.count("_ret").over(f)
    ratio = full(F.avg("_ret").over(f), n, 5) / non_zero(full(F.stddev_samp("_ret").over(f), n, 5))
    return {"rolling_sharpe": F.coalesce(clip(ratio, -3, 3), F.lit(0.0))}


def supply_demand(w: WindowSpec) -> dict[str, Column]:
    f = w.rowsBetween(-24, 0)
    n = F.count("high").over(f)
    atr = non_zero(c("atr14")) + 1e-9
    top, bottom = full(F.max("high").over(f), n, 5), full(F.min("low").over(f), n, 5)
    return {"sd_zone": F.when((top - c("close")) / atr < 1, -1.0).when((c("close") - bottom) / atr < 1, 1.0).otherwise(0.0)}


def volume_totals(w: WindowSpec) -> dict[str, Column]:
    """Running totals of the chunk: a long sum frame is then one subtraction per row."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    typical = (c("high") + c("low") + c("close")) / 3
    return {"_pv": F.sum(typical * _volume()).over(upto), "_vv": F.sum(_volume()).over(upto)}


def vwap_distance(w: WindowSpec, rows: int = 96) -> dict[str, Column]:
    """Distance of the close from the 96-bar VWAP in percent; needs `volume_totals`."""
    window = lambda name: c(name) - F.coalesce(F.lag(name, rows).over(w), F.lit(0.0))
    vwap = window("_pv") / non_zero(window("_vv"))
    return {"vwap_dist": F.coalesce(clip((c("close") - vwap) / non_zero(vwap) * 100, -5, 5), F.lit(0.0))}


REGIME_QUANTILES = {
    "_atr_median": RollingQuantile("atr_pct", 200, 0.5, 50),
    "_width_low": RollingQuantile("bb_width", 100, 0.25, 20),
    "_width_high": RollingQuantile("bb_width", 100, 0.75, 20),
}


def regime() -> Column:
    """0 up and volatile, 1 down and volatile, 2 squeeze and quiet, 3 flat and wide, 4 other."""
    loud, quiet = c("atr_pct") > c("_atr_median") * 1.1, c("atr_pct") < c("_atr_median") * 0.9
    return (
        F.when((c("trend") == 1) & loud, 0).when((c("trend") == -1) & loud, 1)
        .when((c("trend") == 0) & (c("bb_width") > c("_width_high")), 3)
        .when((c("bb_width") < c("_width_low")) & quiet, 2).otherwise(4)).cast("int")


def htf_divergence(htf_rsi: str | None) -> Callable:
    def build(w: WindowSpec) -> dict[str, Column]:
        own = c("rsi14") - F.lag("rsi14", 5).over(w)
        other = F.lit(0.0) if htf_rsi is None else F.coalesce(c(htf_rsi) - F.lag(htf_rsi, 3).over(w), F.lit(0.0))
        return {"htf_div": F.when((own > 2) & (other < -1), 1.0).when((own < -2) & (other > 1), -1.0).otherwise(0.0)}
    return build


def add_frames(
    frame: DataFrame, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
    htf_rsi: str | None = None,
) -> DataFrame:
    """Every bounded-frame column in one pass (reach 222 rows)."""
    first = lambda w: {**bands(w), **volume_ratio(w), **stochastic(w), **candle_patterns(w), **returns(w),
                       **supply_demand(w), **volume_totals(w), **htf_divergence(htf_rsi)(w)}
    second = lambda w: {**volume_confirmation(w), **stochastic_signal(w), **rolling_sharpe(w), **vwap_distance(w)}
    out = over_chunks(
        frame, first, second, before=222, keys=keys, idx=idx, chunk=chunk, quantiles=REGIME_QUANTILES)
    return out.withColumn("regime", regime()).drop("_ret", "_pv", "_vv", *REGIME_QUANTILES)


def point_of_control(
    frame: DataFrame, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
    lookback: int = 100, bins: int = 20, step: int = 5,
) -> DataFrame:
    """`poc_dist`: relative distance of the close from the latest volume-profile peak.

    On every `step`-th bar the prior `lookback` closes are spread over `bins` equal price
    cells between their lowest low and highest high; the cell with most volume wins, the
    lowest one on a tie, and its middle is carried to the following bars.
    """
    def reach(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-lookback, -1)
        return {
            "_top": F.max("high").over(f), "_bottom": F.min("low").over(f),
            "_past": F.collect_list(F.struct(c("close").alias("p"), _volume().alias("v"))).over(f),
        }

    due = (c(idx) >= lookback) & (c(idx) % step == 0)
    slim = frame.select(*keys, idx, "high", "low", "close", "volume")
    past = over_chunks(slim, reach, before=lookback, keys=keys, idx=idx, chunk=chunk, keep=due, keep_chunk=True)
    group = [*keys, "_chunk", idx]
    width = c("_top") - c("_bottom")
    cells = (
        past.filter(width > 0)
        .select(*group, "_top", "_bottom", F.explode("_past").alias("_x"))
        .withColumn("_cell", F.least(F.floor((c("_x.p") - c("_bottom")) / width * bins), F.lit(bins - 1)))
        .groupBy(*group, "_top", "_bottom", "_cell").agg(F.sum("_x.v").alias("_volume"))
    )
    peaks = (
        cells.groupBy(*group, "_top", "_bottom").agg(F.max(F.struct("_volume", (-c("_cell")).alias("_low"))).alias("_best"))
        .select(*keys, idx, (c("_bottom") + (0.5 - c("_best._low")) * width / bins).alias("_poc"))
    )
    carried = carry_last(frame.join(peaks, [*keys, idx], "left"), {"_last_poc": c("_poc")}, keys, idx, chunk)
    distance = F.when(c("_last_poc") > 0, (c("close") - c("_last_poc")) / (c("close") + 1e-9)).otherwise(0.0)
    return carried.withColumn("poc_dist", distance).drop("_poc", "_last_poc")


def previous_session_bias(
    frame: DataFrame, offset: int = 0, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """`prev_sess_bias`: sign of the last minus the first close of the session block before this one."""
    blocks = session_starts(frame, offset, keys, idx, chunk)
    moves = blocks.groupBy(*keys, "block_idx").agg((F.max_by("close", idx) - F.min_by("close", idx)).alias("_move"))
    by_block = Window.partitionBy(*keys).orderBy("block_idx")
    bias = moves.select(*keys, "block_idx", F.coalesce(F.signum(F.lag("_move").over(by_block)), F.lit(0.0)).alias("prev_sess_bias"))
    return blocks.join(bias, [*keys, "block_idx"]).drop("block_idx", "block_start")


def build_features(
    bars: DataFrame, session_offset: int = 0, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
    chunk: int = CHUNK, htf_rsi: str | None = None,
) -> DataFrame:
    """All trailing columns of a bar table that carries `bar_idx`.

    The wide table is written twice on the way: every later pass reads it more than once.
    """
    if "volume" not in bars.columns:
        bars = bars.withColumn("volume", c("tick_volume").cast("double") if "tick_volume" in bars.columns else F.lit(1.0))
    frame = cut_lineage(add_frames(base_features(bars, session_offset, keys, idx, chunk), keys, idx, chunk, htf_rsi))
    frame = cut_lineage(point_of_control(frame, keys, idx, chunk))
    return previous_session_bias(frame, session_offset, keys, idx, chunk)


def fill_zero(frame: DataFrame) -> DataFrame:
    """NULL and NaN numbers to zero, as a last step."""
    numeric = [f.name for f in frame.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    return frame.fillna(0, subset=numeric)


def trend_score(frame: DataFrame, signal_prefixes: Sequence[str], mode: str = "additive") -> DataFrame:
    """Counts of rising and falling trends over the primary and the signal timeframes.

    "overwrite" counts the primary and the last signal timeframe only.
    """
    if mode not in ("additive", "overwrite"):
        raise ValueError(f"unknown score mode: {mode}")
    used = list(signal_prefixes) if mode == "additive" else list(signal_prefixes)[-1:]
    columns = ["trend", *[f"{p}_trend" for p in used]]

    def count(sign: int) -> Column:
        return sum((F.coalesce((c(name) == sign).cast("int"), F.lit(0)) for name in columns), F.lit(0)).cast("int")

    return frame.withColumns({"mtf_bull_score": count(1), "mtf_bear_score": count(-1)})


def drop_warm_up(frame: DataFrame, rows: int = 250, idx: str = "bar_idx") -> DataFrame:
    return frame.filter(c(idx) >= rows)


def chronological_split(
    bars: DataFrame, fraction: float = 0.75, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
) -> DataFrame:
    """Label the first `fraction` of each key's rows "train", the rest "test"; adds `split_idx`.

    Frames that must not cross the split use keys (*keys, "split") and `split_idx`.
    """
    sizes = bars.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * fraction).alias("_cut"))
    return (
        bars.join(sizes, list(keys))
        .withColumn("split", F.when(c(idx) < c("_cut"), "train").otherwise("test"))
        .withColumn("split_idx", F.when(c(idx) < c("_cut"), c(idx)).otherwise(c(idx) - c("_cut")))
        .drop("_cut")
    )


def encode_windows(
    frame: DataFrame, width: int = 5, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
    extra: Sequence[str] = (),
) -> DataFrame:
    """`vector`: the last `width` bars and the current context as one array; incomplete rows drop out."""
    offsets = list(range(width, 0, -1))
    centre = (width - 1) / 2
    spread = sum((k - centre) ** 2 for k in range(width))

    def build(w: WindowSpec) -> dict[str, Column]:
        past = lambda name, k: F.lag(name, k).over(w)
        base = past("close", width)
        atr = c("atr14") + 1e-9
        slope = lambda name: sum((past(name, width - k) * ((k - centre) / spread) for k in range(width)), F.lit(0.0))
        parts = [(past("close", k) - base) / non_zero(base) * 100 for k in offsets]
        for k in offsets:
            parts += [F.coalesce(past(p, k), F.lit(0.0)) for p in ("body_pct", "uwk_pct", "lwk_pct")]
            parts.append(past("bull", k).cast("double"))
        parts += [
            slope("rsi14") / 100, slope("atr14") / atr, (past("rsi14", 1) - past("rsi14", width)) / 100,
            c("bb_expanding"), c("rsi14") / 100, c("macd_hist") / atr, c("bb_width"), c("trend").cast("double"),
            c("mtf_bull_score") / 3, (c("close") - base) / non_zero(base * width) * 100, c("vol_ratio"),
            c("vol_body_conf"), c("regime") / 4, c("vol_price_div"), c("prev_sess_bias"),
        ]
        parts += [F.coalesce(F.nanvl(c(name).cast("double"), F.lit(0.0)), F.lit(0.0)) for name in extra]
        return {"vector": F.array(*[p.cast("double") for p in parts])}

    out = over_chunks(frame, build, before=width, keys=keys, idx=idx, chunk=chunk)
    return out.filter((c("atr14") != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
