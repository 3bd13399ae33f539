import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import outcomes as J
from tickloom.operators import resample as M
from tickloom.operators import rules as I
from tickloom.operators.extremes import resolve as search
from tickloom.operators.similar import deduplicate_rules

PARAMS = ("r", "LONG", 0.004, 0.006)


def simulate(g, member, long, sl, tp, hold, spread, cooldown):
    """Bar by bar, one trade at a time."""
    o, h, l, x = (g[n].to_numpy() for n in ("open", "high", "low", "close"))
    sign, out, last, anchor = (1 if long else -1), [], -cooldown - 2, -cooldown - 2
    for i in member:
        if i + 1 >= len(g) or i + 1 <= last or i + 1 - anchor < cooldown:
            continue
        entry = o[i + 1] + sign * spread
        stop, goal = entry * (1 - sign * sl), entry * (1 + sign * tp)
        held, r, late = 0, None, True
        for j in range(i + 1, min(i + hold + 1, len(g))):
            held += 1
            if sign * (l[j] if long else h[j]) <= sign * (stop - sign * spread):
                r, late = -1.0, False
                break
            if sign * (h[j] if long else l[j]) >= sign * (goal - sign * spread):
                r, late = tp / sl, False
                break
        if late:
            r = sign * (x[min(i + hold, len(g) - 1)] - sign * spread - entry) / (entry * sl)
        last, anchor = i + held, i + held + late
        out.append((i, held, round(r, 8)))
    return out


@pytest.mark.parametrize("long", [True, False])
@pytest.mark.parametrize("cooldown", [0, 4])
def test_rule_trades_equal_simulation(spark, bars, bars_pdf, long, cooldown):
    rules = spark.createDataFrame([("r", "volume", 100.0, 400.0)], "rule_id string, column string, lo double, hi double")
    params = spark.createDataFrame([("r", "LONG" if long else "SHORT", 0.004, 0.006)], "rule_id string, direction string, sl_pct double, tp_pct double")
    got = I.rule_trades(bars, rules, params, max_hold=12, spread=0.02, cooldown=cooldown, chunk=128).toPandas()
    for symbol, g in bars_pdf.groupby("symbol"):
        g = g.reset_index(drop=True)
        want = simulate(g, np.flatnonzero(g.volume.between(100, 400)), long, 0.004, 0.006, 12, 0.02, cooldown)
        mine = got[got.symbol == symbol].sort_values("bar_idx")
        assert [(int(a), int(b), round(c, 8)) for a, b, c in zip(mine.bar_idx, mine.bars_held, mine.booked_r)] == want


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_acceptance_is_the_same_for_any_chunk(spark, chunk):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "cold"], 800), "entry_idx": rng.integers(0, 900, 800)})
    pdf = pdf.drop_duplicates().sort_values(["k", "entry_idx"]).reset_index(drop=True)
    pdf["free"] = pdf.entry_idx + rng.integers(1, 40, len(pdf))
    want = []
    for k, g in pdf.groupby("k"):
        free = -1
        for start, nxt in zip(g.entry_idx, g.free):
            if start >= free:
                want.append((k, start))
                free = nxt
    got = J.non_overlapping(spark.createDataFrame(pdf), ["k"], F.col("free"), chunk=chunk).select("k", "entry_idx").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_acceptance_moves_only_positions(spark):
    """Columns that no one reads afterwards take no part, and all positions share one exchange."""
    pdf = pd.DataFrame({"k": ["a"] * 50, "entry_idx": np.arange(50), "free": np.arange(50) + 3, "wide": np.arange(50) * 1.5})
    got = J.non_overlapping(spark.createDataFrame(pdf), ["k"], F.col("free"))
    assert got.columns == list(pdf.columns) and sorted(got.select("wide").toPandas().wide) == [i * 1.5 for i in range(0, 50, 3)]
    plan = got.select("entry_idx")._jdf.queryExecution().optimizedPlan().toString()
    assert "wide" not in plan.split("Relation")[0] and "CoGroupsInArrow" in plan


def test_signals_are_not_dealt_by_rule(spark, bars, monkeypatch):
    """A table without statistics must not send all signals to as many tasks as there are rules; the search carries no prices made from others."""
    seen = []
    monkeypatch.setattr(I, "resolve", lambda sought, *a, **k: seen.append(sought) or search(sought, *a, **k))
    monkeypatch.setattr(I, "non_overlapping", lambda trades, *a: trades)
    rules = spark.createDataFrame([("r", "volume", 100.0, 400.0)], "rule_id string, column string, lo double, hi double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = I.rule_trades(bars, rules, spark.createDataFrame([PARAMS], "rule_id string, direction string, sl_pct double, tp_pct double"), max_hold=12)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(rule_id" not in plan and not {"entry_price", "stop_price", "risk", "reward"} & set(seen[0].columns)


def test_stop_wins_a_tie_unless_told_otherwise(spark):
    row = spark.createDataFrame([([(110.0, 90.0, 100.0)],)], "p array<struct<h:double,l:double,c:double>>")
    pick = lambda tie: row.select(J.touch(F.col("p"), F.lit(95.0), F.lit(105.0), F.lit(1), 1, tie).alias("t")).first().t.outcome
    assert (pick("stop"), pick("target")) == ("stop", "target")


def replay_one(g, signal, hold, trail):
    """The bar replay as a plain loop over one symbol."""
    out, position = [], None
    for i in range(len(g)):
        row = g.iloc[i]
        if position is None and i and signal[i - 1]:
            side = signal[i - 1]
            entry = row.ask_open if side == 1 else row.bid_open
            position = [side, i, entry, entry - side * 1.0, entry + side * 1.5]
        if position:
            side, start, entry, stop, goal = position
            hit = row.bid_low <= stop if side == 1 else row.ask_high >= stop
            won = row.bid_high >= goal if side == 1 else row.ask_low <= goal
            reason = "stop_loss" if hit else "take_profit" if won else "max_hold" if i - start >= hold else None
            if reason:
                price = {"stop_loss": stop, "take_profit": goal, "max_hold": row.bid_close if side == 1 else row.ask_close}[reason]
                out.append((start, i - start, reason, round(price, 8)))
                position = None
            elif trail:
                position[3] = max(stop, row.bid_high - trail * row.atr14) if side == 1 else min(stop, row.ask_low + trail * row.atr14)
    if position:
        row = g.iloc[-1]
        out.append((position[1], len(g) - 1 - position[1], "end_of_data", round(row.bid_close if position[0] == 1 else row.ask_close, 8)))
    return out


@pytest.mark.parametrize("trail", [0.0, 1.0])
def test_bar_replay_equals_loop(spark, bars_pdf, trail):
    pdf = bars_pdf.copy()
    for n in ("open", "high", "low", "close"):
        pdf[f"bid_{n}"], pdf[f"ask_{n}"] = pdf[n] - 0.01, pdf[n] + 0.01
    pdf["atr14"] = pdf.high - pdf.low
    pdf["signal_direction"] = np.where(pdf.volume > 350, 1, np.where(pdf.volume < 120, -1, 0))
    table = spark.createDataFrame(pdf)
    signals = table.select("symbol", "bar_idx", "signal_direction", F.lit("s").alias("strategy_id"), F.lit(1.0).alias("stop_distance"), F.lit(1.5).alias("target_distance"),
                           F.lit(0.0).alias("signal_target_price"), F.lit(trail).alias("trail_atr"), F.lit(9).alias("max_hold_bars"))
    got = J.bar_replay(table, signals, chunk=100).toPandas()
    for symbol, g in pdf.groupby("symbol"):
        want = replay_one(g.reset_index(drop=True), g.signal_direction.to_numpy(), 9, trail)
        mine = got[got.symbol == symbol].sort_values("entry_idx")
        assert list(zip(mine.entry_idx, mine.hold_bars, mine.exit_reason, mine.exit_price.round(8))) == want


def test_cells_match_like_compiled_rules(spark, bars):
    frame = bars.withColumn("up", (F.col("close") > F.col("open")).cast("int"))
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        lo = float(rng.uniform(0, 400))
        rows += [(f"r{i}", "volume", lo, lo + 60.0), (f"r{i}", "up", float(i % 2), 1.0)]
    rules = spark.createDataFrame(rows, "rule_id string, column string, lo double, hi double")
    pick = lambda limit: sorted(map(tuple, I.match_rules(frame, rules, compile_limit=limit).select("rule_id", "symbol", "bar_idx").collect()))
    assert pick(0) == pick(256)


def test_greedy_deduplication_equals_full_walk(spark):
    rng = np.random.default_rng(4)
    columns = list("abcdefg")
    rules, ranks = [], []
    for i in range(120):
        own = rng.choice(columns, rng.integers(1, 5), replace=False)
        rules += [(f"r{i:03}", c, 0.0, 1.0) for c in own]
        ranks.append((f"r{i:03}", rng.choice(["LONG", "SHORT"]), float(rng.integers(0, 50))))
    sets = {}
    for rule, column, _, _ in rules:
        sets.setdefault(rule, set()).add(column)
    kept = []
    for rule, direction, _ in sorted(ranks, key=lambda x: (x[2], x[0]), reverse=True):
        if all(d != direction or len(sets[rule] & sets[k]) / len(sets[rule] | sets[k]) < 0.6 for k, d in kept):
            kept.append((rule, direction))
    got = deduplicate_rules(spark.createDataFrame(rules, "rule_id string, column string, lo double, hi double"), spark.createDataFrame(ranks, "rule_id string, direction string, rank_key double"))
    assert sorted(r.rule_id for r in got.collect()) == sorted(k for k, _ in kept)


def test_draws_do_not_depend_on_partitioning(spark):
    daily = spark.createDataFrame([("s", d, float(d % 7 - 3), True) for d in range(200)], "strategy_id string, day int, pnl double, opened boolean")
    one = M.bootstrap_paths(M.packed_series(daily), 50, 30, 5)
    two = M.bootstrap_paths(M.packed_series(daily.repartition(7)), 50, 30, 5)
    pick = lambda df: sorted((r.path_id, tuple(r.pnl)) for r in df.collect())
    assert pick(one) == pick(two)
