"""Bitmap rule index, trees per group, gates and R metrics on small cases worked out by hand or by loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import grouping as O
from tickloom.operators import metrics as K
from tickloom.operators import rules as I
from tickloom.operators import outcomes, rule_index
from tickloom.operators.rule_index import match_by_bitmaps

c = F.col
RULES = "rule_id string, column string, lo double, hi double"


@pytest.mark.parametrize("most", [4_000_000, 20])
def test_bitmaps_equal_plain_tests(spark, most):
    """Missing and NaN values, bounds on cell borders, a column named twice, empty and missing bounds, rules on one column only; one pass and several."""
    rng = np.random.default_rng(7)
    rows = [(k, None if k % 11 == 0 else float(rng.integers(0, 20)), float("nan") if k % 13 == 0 else float(rng.normal()), int(rng.integers(0, 2))) for k in range(400)]
    frame = spark.createDataFrame(rows, "n int, a double, b double, up int")
    rules = [(f"r{k}", "a", float(k % 20), float(k % 20 + k % 4)) for k in range(60)] + [(f"r{k}", "b", -1.0, float(k) / 20) for k in range(0, 60, 2)] + [(f"r{k}", "up", 1.0, 1.0) for k in range(0, 60, 5)]
    rules += [("twice", "a", 2.0, 9.0), ("twice", "a", 7.0, 30.0), ("empty", "a", 9.0, 2.0), ("open", "a", None, 5.0), ("all", "up", 0.0, 1.0)]
    got = sorted((r.rule_id, r.n) for r in match_by_bitmaps(frame, spark.createDataFrame(rules, RULES), cells=5, most=most).collect())
    value = {"a": 1, "b": 2, "up": 3}
    names = {}
    for rule in rules:
        names.setdefault(rule[0], []).append(rule)
    holds = lambda row, x: row[value[x[1]]] is not None and x[2] is not None and x[2] <= row[value[x[1]]] <= x[3]
    assert got == sorted((name, row[0]) for name, conditions in names.items() for row in rows if all(holds(row, x) for x in conditions))
    assert {r for r, _ in got} >= {"twice", "all"} and not {r for r, _ in got} & {"empty", "open"}


def test_only_words_with_a_candidate_are_unpacked(monkeypatch):
    """Candidates are those of plain bits, in order of row and rule, and empty words and padding are never unpacked."""
    rng, unpacked, unpack = np.random.default_rng(3), [], np.unpackbits
    rules = 1000
    may = [rng.random((6, rules)) < share for share in (0.02, 0.5)]
    may[0][5], may[1][2] = False, True
    padded = [np.packbits(np.pad(m, ((0, 0), (0, 24))), axis=1, bitorder="little").view(np.uint64) for m in may]
    cells = [rng.integers(0, 6, 300) for _ in may]
    cells[0][:200] = 5
    monkeypatch.setattr(np, "unpackbits", lambda a, **more: unpacked.append(a.size) or unpack(a, **more))
    row, rule = rule_index.candidates(padded, cells)
    want = np.nonzero(may[0][cells[0]] & may[1][cells[1]])
    assert (row == want[0]).all() and (rule == want[1]).all() and len(row)
    assert sum(unpacked) < 100 * 16 * 8


def test_no_rules_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 2.0)], "n int, a double")
    one = spark.createDataFrame([("r", "a", 0.0, 9.0)], RULES)
    assert match_by_bitmaps(frame, one.limit(0)).count() == 0 and match_by_bitmaps(frame.limit(0), one).count() == 0
    assert match_by_bitmaps(frame, one).collect()[0].rule_id == "r"


def test_trees_have_their_guards(spark):
    """A group that needs two columns to be told apart, one that is noise, one with too few rows."""
    rng = np.random.default_rng(1)
    rows = []
    for g, size in (("square", 400), ("noise", 400), ("small", 25)):
        for k in range(size):
            x, y = rng.uniform(), rng.uniform()
            up = (x > 0.5 and y > 0.5) if g != "noise" else rng.uniform() < 0.5
            rows.append((f"{g}{k}", 0, g, float(x), float(y), "target" if up else "stop", "stop" if up else "target"))
    rows.append(("odd", 0, "square", None, 0.5, "target", "stop"))
    df = spark.createDataFrame(rows, "symbol string, bar_idx int, grp string, x double, y double, long_outcome string, short_outcome string")
    found = I.fit_group_trees(df.select("symbol", "bar_idx", "grp", "long_outcome", "short_outcome"), df.select("symbol", "bar_idx", "x", "y"), "grp", ["x", "y"], min_accuracy=0.9).collect()
    assert [r.grp for r in found] == ["square"] and found[0].n_bars == 400 and found[0].accuracy > 0.93
    assert {s.column for s in found[0].splits} == {"x", "y"} and all(abs(s.thresh - 0.5) < 0.08 for s in found[0].splits)
    assert sum(leaf.n_bars for leaf in found[0].leaves) == 400 and [leaf.long for leaf in found[0].leaves].count(True) == 1
    with pytest.raises(ValueError):
        I.fit_group_trees(df, df, "grp", ["x"])


def test_win_filter_refuses_what_it_cannot_learn(spark):
    few = spark.createDataFrame([(float(k), float(k % 2)) for k in range(40)], "f double, won double")
    with pytest.raises(ValueError, match="40 trades"):
        O.fit_win_filter(few, ["f"])
    with pytest.raises(ValueError, match="alike"):
        O.fit_win_filter(few.withColumn("won", F.lit(1.0)), ["f"], least=10)


def test_degradation_of_few_trades(spark):
    rows = [("few", k, 1.0) for k in range(9)] + [("many", k, 1.0 if k < 20 else -1.0) for k in range(30)]
    got = {r.strategy_id: (r.overall_wr, r.recent_wr) for r in K.recent_degradation(spark.createDataFrame(rows, "strategy_id string, trade_idx int, net_pnl double")).collect()}
    assert got == {"few": (0.0, 0.0), "many": (66.7, 0.0)}
    none = K.recent_degradation(spark.createDataFrame(rows, "strategy_id string, trade_idx int, net_pnl double"), recent_rows=0)
    assert {r.strategy_id: r.recent_wr for r in none.collect()} == {"few": 0.0, "many": 66.7}


def test_r_metrics_by_loop(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"rule_id": rng.choice(["a", "a", "b"], 300), "entry_idx": np.arange(300) * 97, "booked_r": rng.choice([-1.0, -0.3, 1.5, 0.0], 300)})
    days = spark.createDataFrame([("a", 40), ("b", 0)], "rule_id string, trading_days int")
    got = {r.rule_id: (round(r.max_drawdown_r, 9), r.max_consecutive_losses, r.per_day) for r in K.r_metrics(spark.createDataFrame(pdf), days).collect()}
    for rule, g in pdf.groupby("rule_id"):
        equity, peak, worst, run, longest = 0.0, 0.0, 0.0, 0, 0
        for r in g.booked_r:
            equity += r
            peak = max(peak, equity)
            worst = max(worst, peak - equity)
            run = run + 1 if r <= 0 else 0
            longest = max(longest, run)
        assert got[rule] == (round(worst, 9), longest, len(g) / max(40 if rule == "a" else 0, 1))


def test_filters_drop_mark_and_pass(spark):
    good = {"win_rate_pct": 55.0, "wilson_wr": 50.0, "profit_factor": 1.4, "test_trades": 90.0, "implied_rr": 0.5, "composite_score": 0.4, "max_drawdown_r": 5.0, "max_consecutive_losses": 3.0, "per_day": 0.5,
            "gated_test_trades": 60.0, "box_test_profit_factor": 1.3, "box_test_expectancy_r": 0.1, "box_test_wilson_edge": 0.0, "time_consistency": 0.5}
    cases = {"pass": {}, "marginal": {"max_drawdown_r": 13.0, "implied_rr": None}, "hard": {"per_day": 0.1}, "missing": {"box_test_expectancy_r": None}, "soft": {"max_drawdown_r": 13.0, "implied_rr": 0.1, "wilson_wr": 1.0, "time_consistency": 0.1}}
    rows = [(name, *[{**good, **change}[n] for n in good]) for name, change in cases.items()]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{n} double" for n in good))
    got = {r.name: (r.hard_failed, r.soft_failed, r.decision) for r in K.discovery_filters(df, 50.0, 1.2, 80.0).collect()}
    assert got == {
        "pass": ("", "", "pass"), "marginal": ("", "implied_rr,max_drawdown_r", "marginal"), "hard": ("per_day", "", "drop"), "missing": ("box_test_expectancy_r", "", "drop"),
        "soft": ("", "wilson_wr,implied_rr,max_drawdown_r,time_consistency", "drop")}
    report = K.report_checks()
    metrics = spark.createDataFrame([("a", 120, 1.2, 3.0, 9.0, 10.0), ("b", 120, None, 3.0, 9.0, None)], "name string, trades int, profit_factor double, expected_payoff double, net_profit double, max_drawdown_pct double")
    assert {r.name: r.failed for r in K.gate(metrics, report).collect()} == {"a": "", "b": "profit_factor,equity_drawdown"}


def test_decided_bars_are_resolved_once(spark, monkeypatch):
    """What both discriminators read several times is written first, so neither side is resolved again."""
    frame = spark.range(400).select(F.lit("A").alias("symbol"), c("id").alias("bar_idx"), F.lit(1).alias("grp"), (c("id") % 37 / 37.0).alias("x"), (c("id") % 5 / 5.0).alias("y"))
    up = c("x") > 0.5
    side = lambda good: F.when(good, "target").otherwise("stop")
    resolved = frame.select("symbol", "bar_idx", "grp", side(up).alias("long_outcome"), side(~up).alias("short_outcome"))
    found = I.fit_discriminator(resolved, frame, "grp", ["x", "y"])
    row = found.first()
    assert (row["column"], row.dir, row.n_bars) == ("x", "above", 400) and row.accuracy > 0.95
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    written, cut = [], I.cut_lineage
    monkeypatch.setattr(I, "cut_lineage", lambda df, *more: written.append(sorted(df.columns)) or cut(df, *more))
    assert I.fit_tree_discriminator(resolved.drop("grp"), frame, ["x", "y"]).numClasses == 2
    assert written == [["label", "x", "y"]]


def test_trades_are_booked_after_the_choice(spark, monkeypatch):
    """The table that the choice writes holds nothing that follows from the parameters."""
    n = 60
    bars = spark.createDataFrame([("a", i, 100.0 + i % 7, 103.0 + i % 7, 98.0 + i % 7, 101.0 + i % 5, float(i % 4)) for i in range(n)], "symbol string, bar_idx long, open double, high double, low double, close double, x double")
    bars = bars.withColumn("time", F.col("bar_idx"))
    rules = spark.createDataFrame([("r", "x", 1.0, 2.0)], "rule_id string, column string, lo double, hi double")
    parameters = spark.createDataFrame([("r", "LONG", 0.03, 0.02)], "rule_id string, direction string, sl_pct double, tp_pct double")
    written, plain = [], outcomes.cut_lineage
    monkeypatch.setattr(outcomes, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    got = I.rule_trades(bars, rules, parameters, max_hold=5, commission_r=0.1).orderBy("entry_idx").collect()
    assert got and not {"entry_price", "stop_price", "target_price", "risk", "reward", "booked_r", "sl_pct"} & set(written[0])
    free = -1
    for row in got:
        assert row.entry_idx >= free and row.entry_price == 100.0 + row.entry_idx % 7 + 0.3
        assert row.booked_r == pytest.approx(row.gross_r - 0.1) and row.exit_idx == row.entry_idx - 1 + row.bars_held
        free = max(row.exit_idx + 1, row.exit_idx + (row.outcome == "timeout") + 4)
