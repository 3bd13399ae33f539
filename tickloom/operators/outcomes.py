"""From signals to trades: forward paths, first touch, acceptance, booking, races."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tickloom.functions.columns import truth
from tickloom.operators.extremes import FAN, Levels, bar_at, build_levels, either, first_hit
from tickloom.operators.scan import CHUNK, over_chunks, running
from tickloom.session import cut_lineage

c = F.col


def forward_path(w: WindowSpec, bars: int, prefix: str = "") -> Column:
    """High, low and close of the next `bars` bars, shorter at the end of the data."""
    names = {"h": "high", "l": "low", "c": "close"}
    return F.collect_list(F.struct(*[c(prefix + name).alias(k) for k, name in names.items()])).over(w.rowsBetween(1, bars))


def touch(path: Column, stop: Column, target: Column, side: Column, horizon: int, tie: str = "stop") -> Column:
    """Struct(outcome, held, exit_price, truncated) of the first level reached along `path`.

    `tie` says which level counts when one bar spans both.
    """
    if tie not in ("stop", "target"):
        raise ValueError(f"unknown tie rule: {tie}")
    long = side > 0
    at = lambda reached: F.array_position(F.transform(path, reached), True)
    stop_at = at(lambda x: F.when(long, x["l"] <= stop).otherwise(x["h"] >= stop))
    target_at = at(lambda x: F.when(long, x["h"] >= target).otherwise(x["l"] <= target))
    on_tie = stop_at <= target_at if tie == "stop" else stop_at < target_at
    stopped = (stop_at > 0) & ((target_at == 0) | on_tie)
    reached = (target_at > 0) & ~stopped
    size = F.size(path)
    return F.struct(
        F.when(stopped, "stop").when(reached, "target").otherwise("timeout").alias("outcome"),
        F.when(stopped, stop_at).when(reached, target_at).otherwise(size).cast("int").alias("held"),
        F.when(stopped, stop).when(reached, target).otherwise(F.get(path, size - 1)["c"]).alias("exit_price"),
        (~stopped & ~reached & (size < horizon)).alias("truncated"))


def priced_entries(
    signals: DataFrame, spread: float, sl_pct: Column, tp_pct: Column, long: Column, next_open: str = "next_open",
) -> DataFrame:
    """Entry at the next open plus spread; levels as fractions of it, exits pay the spread too."""
    sign = F.when(long, 1.0).otherwise(-1.0)
    entry = c(next_open) + sign * spread
    out = signals.withColumns({"side": sign, "entry_price": entry})
    return out.withColumns({
        "stop_price": c("entry_price") * (1 - c("side") * sl_pct), "target_price": c("entry_price") * (1 + c("side") * tp_pct),
    }).withColumns({
        "risk": F.abs(c("entry_price") - c("stop_price")), "reward": F.abs(c("target_price") - c("entry_price")),
        "stop_level": c("stop_price") - c("side") * spread, "target_level": c("target_price") - c("side") * spread,
    }).filter((c(next_open) != 0) & (c("risk") > 0))


def r_outcomes(
    signals: DataFrame, spread: float, sl_pct: Column, tp_pct: Column, long: Column, max_hold: int,
    commission_r: float = 0.0, swap_r: float = 0.0, path: str = "path", idx: str = "bar_idx",
) -> DataFrame:
    """Resolve and book each signal in units of its risk; costs come off before WIN is decided."""
    priced = priced_entries(signals.filter(F.size(path) > 0), spread, sl_pct, tp_pct, long)
    hit = touch(c(path), c("stop_level"), c("target_level"), c("side"), max_hold)
    return book_r(priced.withColumn("_hit", hit).drop(path), spread, commission_r, swap_r, idx)


def book_r(resolved: DataFrame, spread: float, commission_r: float = 0.0, swap_r: float = 0.0, idx: str = "bar_idx") -> DataFrame:
    """Priced entries with their `_hit` (outcome, held, exit_price, truncated), booked in units of risk."""
    timeout_r = c("side") * (c("_hit.exit_price") - c("side") * spread - c("entry_price")) / c("risk")
    booked = F.when(c("_hit.outcome") == "target", c("reward") / c("risk")).when(
        c("_hit.outcome") == "stop", F.lit(-1.0)).otherwise(timeout_r)
    return resolved.withColumns({
        "outcome": c("_hit.outcome"), "bars_held": c("_hit.held"), "truncated": c("_hit.truncated"),
        "gross_r": booked, "booked_r": booked - (commission_r + swap_r * c("_hit.held")),
        "entry_idx": c(idx) + 1, "exit_idx": c(idx) + c("_hit.held"),
    }).withColumn("result", F.when(c("booked_r") > 0, "WIN").otherwise("LOSS")).drop("_hit", "stop_level", "target_level")


# When may the next trade enter?  Each preset gives the first entry position allowed.

def free_after_cooldown(cooldown: int) -> Column:
    """Bars counted from the exit bar; a timeout closes one bar later."""
    late = F.when(c("outcome") == "timeout", 1).otherwise(0)
    return F.greatest(c("exit_idx") + 1, c("exit_idx") + late + cooldown).cast("long")


def free_after_signal_cooldown(cooldown: int) -> Column:
    """Cross-symbol evaluation: the signal bar, not the entry bar, must clear the cooldown."""
    return (c("exit_idx") + cooldown + 1).cast("long")


def free_after_exit() -> Column:
    """Bar replay: the bar after the exit may enter."""
    return (c("exit_idx") + 1).cast("long")


def _reduce_chunk(starts: np.ndarray, frees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    following = np.searchsorted(starts, frees, side="left")
    last = np.empty(len(starts), dtype=np.int64)
    for i in range(len(starts) - 1, -1, -1):
        last[i] = frees[i] if following[i] >= len(starts) else last[following[i]]
    ends = np.flatnonzero(np.append(last[1:] != last[:-1], True))
    return starts[ends], last[ends]


def non_overlapping(
    trades: DataFrame, keys: Sequence[str], free_at: Column, start: str = "entry_idx", chunk: int = 4096,
) -> DataFrame:
    """Accept trades in order, each only once the one accepted before it has let go.

    The choice is sequential per key, but a key may hold a third of all signals.  What a
    chunk does to the running "free at" position is a step function with few steps,
    because greedy choices from different starts soon meet.  Chunks are reduced to that
    function in parallel, the functions are chained per key, and each chunk is then
    replayed from its known start.  Only positions take part in that; the accepted rows are
    then picked by their number.  Needs `free_at > start`.

    Keys are dealt into lots, a few per shuffle partition, so that many small keys share an
    Arrow batch; a lot's chunk never exceeds what one shuffle partition holds.
    """
    keys = list(keys)
    lots = 4 * int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = cut_lineage(trades.withColumns({
        "_free": free_at.cast("long"), "_chunk": F.floor(c(start) / chunk).cast("long"),
        "_lot": F.pmod(F.xxhash64(*keys), F.lit(lots)).cast("int"), "_row": F.monotonically_increasing_id()}))
    fields = {f.name: f for f in chunked.schema}
    key_fields = [fields[k] for k in keys]

    def ordered(batch: pa.Table, then: str) -> tuple[pa.Table, np.ndarray]:
        """Rows by key and `then`, and where each key begins (with the end as last entry)."""
        batch = batch.sort_by([(name, "ascending") for name in [*keys, then]])
        new = np.zeros(max(len(batch) - 1, 0), dtype=bool)
        for name in keys:
            values = batch[name].to_numpy(zero_copy_only=False)
            new |= values[1:] != values[:-1]
        return batch, np.r_[0, np.flatnonzero(new) + 1, len(batch)]

    summary_schema = StructType([*key_fields, fields["_lot"], fields["_chunk"], StructField("limits", ArrayType(LongType())), StructField("outs", ArrayType(LongType()))])
    summary_arrow = to_arrow_schema(summary_schema)

    def reduce(batch: pa.Table) -> pa.Table:
        batch, begins = ordered(batch, start)
        starts, frees = batch[start].to_numpy().astype(np.int64), batch["_free"].to_numpy()
        pairs = [_reduce_chunk(starts[a:b], frees[a:b]) for a, b in zip(begins[:-1], begins[1:])]
        out = batch.select([*keys, "_lot", "_chunk"]).take(pa.array(begins[:-1]))
        for name, side in (("limits", 0), ("outs", 1)):
            out = out.append_column(name, pa.array([pair[side].tolist() for pair in pairs], pa.list_(pa.int64())))
        return out.cast(summary_arrow)

    # Both passes read one exchange of these columns; the others travel once, to the accepted rows, as far as they are read.
    slim = chunked.select(*keys, "_lot", "_chunk", start, "_free", "_row")
    summary = slim.groupBy("_lot", "_chunk").applyInArrow(reduce, summary_schema)

    carry_schema = StructType([*key_fields, fields["_lot"], fields["_chunk"], StructField("_carry", LongType())])
    carry_arrow = to_arrow_schema(carry_schema)

    def chain(batch: pa.Table) -> pa.Table:
        batch, begins = ordered(batch, "_chunk")
        first, carried = set(begins.tolist()), []
        for i, (limits, outs) in enumerate(zip(batch["limits"].to_pylist(), batch["outs"].to_pylist())):
            free = np.iinfo(np.int64).min if i in first else free
            carried.append(free)
            at = int(np.searchsorted(limits, free, side="left"))
            if at < len(outs):
                free = outs[at]
        return batch.select([*keys, "_lot", "_chunk"]).append_column("_carry", pa.array(carried, pa.int64())).cast(carry_arrow)

    carry = summary.groupBy("_lot").applyInArrow(chain, carry_schema)

    def replay(batch: pa.Table, carries: pa.Table) -> pa.Table:
        batch, begins = ordered(batch, start)
        starts, frees = (batch[name].to_numpy().astype(np.int64) for name in (start, "_free"))
        # Both sides hold the same keys, in the same order.
        carried = ordered(carries, "_chunk")[0]["_carry"].to_pylist()
        taken: list[int] = []
        for a, b, free in zip(begins[:-1], begins[1:], carried):
            following = np.searchsorted(starts[a:b], frees[a:b], side="left")
            at = int(np.searchsorted(starts[a:b], free, side="left"))
            while at < b - a:
                taken.append(a + at)
                at = int(following[at])
        return batch.select(["_row"]).take(pa.array(taken, pa.int64()))

    accepted = slim.groupBy("_lot", "_chunk").cogroup(carry.groupBy("_lot", "_chunk")).applyInArrow(replay, "_row long")
    return chunked.drop("_lot", "_chunk", "_free").join(accepted, "_row", "left_semi").drop("_row")


def bar_replay(
    bars: DataFrame, signals: DataFrame, lots: float = 0.1, contract: float = 100.0,
    commission_per_lot: float = 0.0, slippage: float = 0.0,
    keys: Sequence[str] = ("strategy_id", "symbol"), idx: str = "bar_idx", chunk: int = CHUNK, fan: int = FAN,
) -> DataFrame:
    """Closed trades of bid/ask bars: next-bar entry, stop first, target, trailing stop, max hold.

    `signals` has one row per (strategy, bar) with `signal_direction`, `stop_distance`,
    `target_distance`, `signal_target_price`, `trail_atr` and `max_hold_bars`; `bars` carries
    `atr14`.  Long trades exit on the bid, short ones on the ask.  Exits are found through cells of
    extremes, so a hold of any length costs a row the same memory; a bar's fields travel only
    with the signals that read it.
    """
    symbol = [k for k in keys if k in bars.columns]
    longest = signals.agg(F.max("max_hold_bars"), F.max("trail_atr")).first()
    reach, trails = max(1, int(longest[0] or 1)) + 1, (longest[1] or 0) > 0
    sides = [f"{s}_{p}" for s in ("bid", "ask") for p in ("high", "low", "close")]
    flat = bars.select(*symbol, idx, "time", F.coalesce("atr14", F.lit(0.0)).alias("atr"), *sides)
    levels = build_levels(
        flat, {"bl": c("bid_low"), "al": c("ask_low")}, {"bh": c("bid_high"), "ah": c("ask_high")}, ["time", "bid_close", "ask_close"], symbol, idx, fan)
    asked = signals.filter((c("signal_direction") != 0) & (c("stop_distance") > 0)).select(
        *keys, idx, "signal_direction", "stop_distance", "target_distance", "signal_target_price", "trail_atr", "max_hold_bars")
    opens = over_chunks(
        bars.select(*symbol, idx, "time", "bid_open", "ask_open"), lambda w: {"entry_time": F.lead("time").over(w), "_bid": F.lead("bid_open").over(w), "_ask": F.lead("ask_open").over(w)},
        after=1, keys=symbol, idx=idx, chunk=chunk, keep=c("entry_time").isNotNull())
    rows = asked.join(opens.select(*symbol, idx, c("time").alias("signal_time"), "entry_time", "_bid", "_ask"), [*symbol, idx])
    side = c("signal_direction").cast("double")
    long = side > 0
    rows = rows.withColumn("entry_price", F.when(long, c("_ask")).otherwise(c("_bid")) + side * slippage).drop("_bid", "_ask")
    rows = rows.withColumn("target_price", F.when(c("signal_target_price") > 0, c("signal_target_price")).when(
        c("target_distance") > 0, c("entry_price") + side * c("target_distance")))
    rows = rows.filter(c("target_price").isNull() | (side * (c("target_price") - c("entry_price")) > 0))
    rows = rows.withColumn("stop_price", c("entry_price") - side * c("stop_distance"))
    hold = F.greatest(c("max_hold_bars").cast("long"), F.lit(1))
    rows = rows.join(levels.ends, symbol).withColumn("_until", F.least(c(idx) + hold + 1, c("_end")))
    rows = first_hit(rows, levels, either(long, "bl", "bh", "ah", "al", c("stop_price"), c("target_price")), idx, "_until", "_touch", reach, "_out")
    rows = rows.withColumn("_out", F.when(c("_touch").isNull(), c("_out")).otherwise(F.struct([c(f"_touch.{f}") for f in levels.tables[0].schema["_kids"].dataType.elementType.names])))
    rows = _trail_exits(rows, flat, levels, symbol, idx, chunk, reach) if trails else rows.withColumn("_trail", F.lit(None).cast("struct<at:bigint,stop:double>"))
    # A trailing exit on the bar of the fixed one comes first: the ratcheted stop is the nearer.
    at, trail_at = c("_touch.at"), F.when(c("_trail.at") <= c("_until"), c("_trail.at"))
    trailed = F.coalesce(trail_at <= F.coalesce(at, c("_until")), F.lit(False))
    moved = F.when(long, F.greatest(c("stop_price"), c("_trail.stop"))).otherwise(F.least(c("stop_price"), c("_trail.stop")))
    rows = rows.withColumn("_at", F.when(trailed, trail_at).otherwise(F.coalesce(at, c("_until"))))
    if trails:
        rows = bar_at(rows, levels, F.when(trailed, c("_at")), "_left").withColumn("_out", F.coalesce("_left", "_out")).drop("_left")
    stopped = truth(F.when(long, c("_touch.bl") <= c("stop_price")).otherwise(c("_touch.ah") >= c("stop_price")))
    late = c("_at") - c(idx) > hold
    price = F.when(trailed, moved).when(at.isNotNull() & stopped, c("stop_price")).when(at.isNotNull(), c("target_price")).otherwise(
        F.when(long, c("_out.bid_close")).otherwise(c("_out.ask_close")))
    commission = commission_per_lot * lots
    gross = side * (c("exit_price") - c("entry_price")) * lots * contract
    rows = rows.withColumns({
        "exit_time": c("_out.time"), "exit_price": price - side * slippage,
        "exit_reason": F.when(trailed | (at.isNotNull() & stopped), "stop_loss").when(at.isNotNull(), "take_profit").when(late, "max_hold").otherwise("end_of_data"),
        "hold_bars": (c("_at") - c(idx) - 1).cast("int"), "entry_idx": c(idx) + 1, "exit_idx": c("_at"),
        "initial_risk": c("stop_distance") * lots * contract + commission,
    }).withColumns({"gross_pnl": gross, "net_pnl": gross - commission}).drop("_touch", "_trail", "_out", "_at", "_until", "_end")
    return non_overlapping(rows, keys, free_after_exit())


def _trail_exits(rows: DataFrame, bars: DataFrame, levels: Levels, symbol: list[str], idx: str, chunk: int, reach: int) -> DataFrame:
    """Add `_trail` (at, stop): where the ratcheting stop alone would take each trade out, and its level there.

    After each bar that the trade survives the stop may move to that bar's high less `trail_atr` ATR (a short
    trade's to its low plus as much).  Every bar thus sets a stop of its own, and the first bar beyond
    it is a plain search.  A trade leaves at the earliest of these among its bars, at the
    nearest of the stops that end there: a running minimum of (end, -stop) from the last bar back.
    The searches run once per bar, side and distance in use, not per trade.
    """
    kinds = rows.filter("trail_atr > 0").select(*symbol, "signal_direction", "trail_atr").distinct()
    kinds = cut_lineage(kinds.withColumn("_sign", F.signum(c("signal_direction").cast("double"))).drop("signal_direction").distinct())  # few rows for many bars
    long, distance = c("_sign") > 0, c("trail_atr") * c("atr")
    each = bars.join(kinds, symbol).select(
        *symbol, idx, "trail_atr", "_sign", F.when(long, c("bid_high") - distance).otherwise(c("ask_low") + distance).alias("_stop"))
    each = each.withColumn("_limit", c(idx) + reach)  # no trade looks further
    ends = first_hit(each, levels, lambda x: F.when(long, x["bl"] <= c("_stop")).otherwise(x["ah"] >= c("_stop")), idx, "_limit", "_end", reach)
    pair = F.when(c("_end").isNotNull(), F.struct(c("_end.at").alias("at"), (-c("_sign") * c("_stop")).alias("rank")))
    back = ends.select(*symbol, idx, "trail_atr", "_sign", pair.alias("_pair"), (-c(idx)).alias("_back"))
    folded = running(back, {"_first": ("min", c("_pair"))}, [*symbol, "trail_atr", "_sign"], ["_back"], F.floor(c("_back") / chunk).cast("long"))
    stops = folded.select(*symbol, (c(idx) - 1).alias(idx), "trail_atr", "_sign", F.struct(c("_first.at").alias("at"), (-c("_sign") * c("_first.rank")).alias("stop")).alias("_trail"))
    placed = rows.withColumn("_sign", F.signum(c("signal_direction").cast("double")))
    return placed.join(stops, [*symbol, idx, "trail_atr", "_sign"], "left").drop("_sign")


def pnl_points(trades: DataFrame) -> Column:
    """P&L in points by the first of: pnl_pts; r_multiple and sl_pts; outcome with sl/tp_pts; else 0."""
    names = set(trades.columns)
    if "pnl_pts" in names:
        return c("pnl_pts").cast("double")
    if {"r_multiple", "sl_pts"} <= names:
        return c("r_multiple").cast("double") * F.abs(c("sl_pts").cast("double"))
    if {"sl_pts", "tp_pts", "outcome"} <= names:
        kind = F.lower("outcome")
        return F.when(kind == "tp", F.abs(c("tp_pts").cast("double"))).when(kind == "sl", -F.abs(c("sl_pts").cast("double"))).otherwise(0.0)
    return F.lit(0.0)


def tick_first_touch(
    entries: DataFrame, ticks: DataFrame, bars: DataFrame, bar_seconds: int,
    keys: Sequence[str] = ("symbol",), slippage: float = 0.0, idx: str = "bar_idx", fan: int = FAN,
) -> DataFrame:
    """Exit of each entry on the exact tick: bid less slippage for long, ask plus slippage for short.

    `entries` has `entry_id`, `entry_idx` (the bar holding the entry), `entry_time`, `side`,
    `entry_price`, `stop_price`, `target_price` and `deadline` (NULL for none).  A bar whose
    extremes stay inside the levels and that ends before the deadline cannot hold the exit,
    so ticks are read for the entry bar, for the first later bar that can, and for the bar
    after one that holds the deadline, and for no other.
    An entry without an exit leaves at the last tick ("end_of_data"), or is "open" if no tick follows it.
    """
    keys = list(keys)
    start = lambda name: F.unix_micros(c(name).cast("timestamp"))
    flat = over_chunks(
        bars.select(*keys, idx, start("time").alias("t"), "bid_high", "bid_low", "ask_high", "ask_low"), lambda w: {"next_t": F.lead("t").over(w)}, after=1, keys=keys, idx=idx)
    levels = build_levels(
        flat, {"bl": c("bid_low") - slippage, "al": c("ask_low") + slippage}, {"bh": c("bid_high") - slippage, "ah": c("ask_high") + slippage, "t": c("t")}, ["next_t"], keys, idx, fan)
    side, length = c("side"), bar_seconds * 1_000_000
    placed = entries.select(*keys, "entry_id", "entry_idx", "entry_time", "side", "stop_price", "target_price", "deadline", start("deadline").alias("_due"))
    overdue = lambda x: truth(x["t"] + length > c("_due"))
    touched = either(side > 0, "bl", "bh", "ah", "al", c("stop_price"), c("target_price"))
    # The bar around the deadline may have no tick after it: then the bar that follows has.
    found = first_hit(bar_at(placed, levels, c("entry_idx"), "_now"), levels, lambda x: touched(x) | overdue(x), "entry_idx", name="_first")
    here = F.when(overdue(c("_now")), c("_now.next_t"))
    there = F.when(overdue(c("_first")), c("_first.next_t"))
    starts = F.array_distinct(F.array_compact(F.array(c("_now.t"), here, c("_first.t"), there)))
    searched = found.withColumn("_bar", F.explode(starts)).drop("_now", "_first", "_due")
    micros = F.unix_micros(c("time").cast("timestamp"))
    quotes = ticks.select(*keys, c("time").alias("tick_time"), "bid", "ask", (micros - F.pmod(micros, F.lit(bar_seconds * 1_000_000))).alias("_bar"))
    met = searched.join(quotes, [*keys, "_bar"]).filter(c("tick_time") > c("entry_time"))
    price = F.when(side > 0, c("bid") - slippage).otherwise(c("ask") + slippage)
    stopped = F.when(side > 0, price <= c("stop_price")).otherwise(price >= c("stop_price"))
    reached = F.when(side > 0, price >= c("target_price")).otherwise(price <= c("target_price"))
    late = truth(c("tick_time") >= c("deadline"))
    reason = F.when(late, "max_hold").when(stopped, "stop_loss").when(reached, "take_profit")
    hits = met.withColumns({"exit_reason": reason, "exit_price": price}).filter(c("exit_reason").isNotNull())
    found = hits.groupBy(*keys, "entry_id").agg(
        F.min("tick_time").alias("exit_time"), F.min_by("exit_price", "tick_time").alias("exit_price"), F.min_by("exit_reason", "tick_time").alias("exit_reason"))
    ends = ticks.groupBy(*keys).agg(F.max("time").alias("_end"), F.max_by("bid", "time").alias("_bid"), F.max_by("ask", "time").alias("_ask"))
    out = entries.join(found, [*keys, "entry_id"], "left").join(ends, keys, "left")
    closed = c("exit_reason").isNull() & (c("_end") > c("entry_time"))
    last = F.when(side > 0, c("_bid") - slippage).otherwise(c("_ask") + slippage)
    return out.withColumns({
        "exit_time": F.when(closed, c("_end")).otherwise(c("exit_time")), "exit_price": F.when(closed, last).otherwise(c("exit_price")),
        "exit_reason": F.when(closed, "end_of_data").otherwise(F.coalesce("exit_reason", F.lit("open")))}).drop("_end", "_bid", "_ask")
