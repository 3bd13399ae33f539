"""Correlated pairs against all pairs; one pass of the portfolio."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tickloom.operators import correlate, tiles
from tickloom.operators.correlate import _series, _sketched, correlated_pairs, near_points, series_classes
from tickloom.operators.similar import portfolio_metrics


def noisy_series(length=90, seed=3):
    """Slow waves, trends and noise, copies, multiples, opposites, sparse and constant series."""
    rng, t, out = np.random.default_rng(seed), np.arange(length), {}
    for k in range(60):
        wave = np.sin(2 * np.pi * (rng.integers(1, 6) * t / length + rng.random())) * rng.uniform(0.5, 3)
        out[f"s{k:03}"] = wave + rng.normal(0, rng.choice([0.05, 0.5, 2.0]), length) + rng.normal()
    out["x-copy"], out["x-copy2"], out["x-double"], out["x-minus"] = out["s003"].copy(), out["s003"].copy(), out["s003"] * 2, -out["s003"]
    out["zero"], out["flat"] = np.zeros(length), np.full(length, 5.0)
    early, late = np.zeros(length), np.zeros(length)
    early[:40], late[45:] = -1.0, 1.0
    out["early"], out["late"] = early, late
    return out


def rows_of(spark, series):
    pdf = pd.DataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v) if x != 0 or i in (0, len(v) - 1)], columns=["strategy_id", "at", "pnl"])
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("at_least", [0.2, 0.6, 0.9, 1.0])
def test_pairs_equal_all_pairs(spark, at_least):
    series = noisy_series()
    varied = {k: v for k, v in series.items() if k not in ("zero", "flat")}
    heads = sorted(k for k in varied if k not in ("x-copy", "x-copy2"))
    r = np.corrcoef([varied[k] for k in heads])
    want = {(a, b): r[i, j] for i, a in enumerate(heads) for j, b in enumerate(heads) if i < j and r[i, j] >= at_least - 1e-9}
    got = {(x.a, x.b): x.correlation for x in correlated_pairs(rows_of(spark, series), at_least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert ("s003", "x-double") in want and (at_least > 0.8 or ("early", "late") in want)


def test_sketch_rules_pairs_out(spark):
    points, length, width = _sketched(_series(rows_of(spark, noisy_series()), "strategy_id", "at", "pnl"), "strategy_id", 4)
    assert (length, width) == (90, 8)
    n = points.count()
    assert near_points(points, width, 0.45, "strategy_id").count() < n * (n - 1) / 2 / 3


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_short_calendars(spark, length):
    rng = np.random.default_rng(length)
    series = {f"s{k}": rng.integers(-2, 3, length).astype(float) for k in range(12)}
    got = {(x.a, x.b) for x in correlated_pairs(rows_of(spark, series), 0.7).collect()}
    first = {}
    heads = [k for k, v in series.items() if v.std() > 0 and first.setdefault(tuple(v), k) == k]
    heads.sort()
    assert got == {(a, b) for a in heads for b in heads if a < b and np.corrcoef(series[a], series[b])[0, 1] >= 0.7 - 1e-9}


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "strategy_id string, at long, pnl double")
    assert correlated_pairs(empty, 0.5).collect() == [] and series_classes(empty).collect() == []
    rows = [("a", 0, 1.0), ("a", 0, 1.0), ("a", 1, None), ("b", 0, 4.0), (None, 0, 1.0), ("c", 2, 1.0), ("d", 0, 2.0), ("b", None, 3.0)]
    df = spark.createDataFrame(rows, "strategy_id string, at long, pnl double")
    assert {(r.a, r.b, round(r.correlation, 9)) for r in correlated_pairs(df, 0.9).collect()} == {("a", "b", 1.0)}
    assert {r.strategy_id: r["class"] for r in series_classes(df).collect()} == {"a": "a", "b": "b", "c": "c", "d": "a"}
    with pytest.raises(ValueError):
        correlated_pairs(df, 0.0)


def test_portfolio_reads_once(spark):
    """Equal to a running fold, and no exchange of all rows to one task."""
    x = np.random.default_rng(5).normal(1, 50, 1500)
    pdf = pd.DataFrame({"day": pd.date_range("2020-01-01", periods=len(x)).date, "pnl": x})
    df = spark.createDataFrame(pdf)
    got = portfolio_metrics(df, 1000.0).first()
    total = np.cumsum(x)
    top = np.maximum.accumulate(total)
    assert got.days == 1500 and abs(got.max_dd_pct - ((top - total) / (1000 + top)).max()) < 1e-9
    assert abs(got.sharpe - x.mean() / x.std() * 252 ** 0.5) < 1e-9 and abs(got.sortino - x.mean() / x[x < 0].std() * 252 ** 0.5) < 1e-9
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = portfolio_metrics(spark.range(900).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.sin("id").alias("pnl")), 1000.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "NestedLoop" not in plan and plan.count("Range (") == 1 and "ReusedExchange" in plan and len(re.findall("Exchange SinglePartition", plan)) <= 2


@pytest.mark.parametrize("series_per_block", [1, 7, 2048])
def test_blocks_of_any_size_give_all_pairs(spark, monkeypatch, series_per_block):
    """Blocks change nothing, far ones do not meet, and no step holds a row per pair and moment."""
    monkeypatch.setattr(correlate, "BLOCK_SERIES", series_per_block)
    series = {k: v for k, v in noisy_series().items() if k[0] == "s"}
    rows, names = rows_of(spark, series), sorted(series)
    r = np.corrcoef([series[k] for k in names])
    want = {(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and r[i, j] >= 0.8 - 1e-9}
    found = correlated_pairs(rows, 0.8)
    got = found.collect()
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Aggregate" not in plan


@pytest.mark.parametrize("series_per_block,tile,wide", [(1 << 17, 2048, 2048), (1 << 17, 16, 32), (25, 8, 2048)])
def test_copies_pair_up_in_tiles_of_any_size(spark, monkeypatch, series_per_block, tile, wide):
    """With `copies` every pair of all pairs is there, those of equal series too; columns are filled in chunks; a month without a row counts."""
    monkeypatch.setattr(correlate, "BLOCK_SERIES", series_per_block)
    series = noisy_series(length=80)
    one = {k: v for k, v in series.items() if k not in ("zero", "flat")}
    for v in one.values():
        v[20:30] = 0.0
    names, r = sorted(one), np.corrcoef([one[k] for k in sorted(one)])
    want = {(a, b): r[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if i < j and r[i, j] >= 0.5 - 1e-9}
    with_tiles = (tiles.TILE, tiles.WIDE, correlate.TILE)
    points, length, width = _sketched(_series(rows_of(spark, one), "strategy_id", "at", "pnl"), "strategy_id", 4)
    moves = {k: np.flatnonzero(one[k]) for k in names}
    rows = [(p.strategy_id, p._s, p._norm, p._f, moves[p.strategy_id].tolist(), one[p.strategy_id][moves[p.strategy_id]].tolist()) for p in points.collect()]
    columns = [pa.array(x) for x in zip(*rows)]
    block = pa.table(columns, names=["_key", "_s", "_norm", "_f", "_at", "_x"]).combine_chunks()
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "WIDE", wide)
    monkeypatch.setattr(correlate, "TILE", tile)
    reach = float(np.sqrt(2 * 0.5)) + 1e-7
    found = [tuple(sorted((x, y))) + (v,) for part in correlate._correlator(0.5, length, reach)(block, block, True) for x, y, v in zip(*[n.to_pylist() for n in part.columns])]
    assert len(found) == len(want) and {(a, b) for a, b, _ in found} == set(want) and all(abs(v - want[a, b]) < 1e-9 for a, b, v in found)
    half = len(rows) // 2
    met = [tuple(sorted((x, y))) for part in correlate._correlator(0.5, length, reach)(block.slice(0, half).combine_chunks(), block.slice(half).combine_chunks(), False) for x, y in zip(*[n.to_pylist() for n in part.columns[:2]])]
    first = set(block["_key"].slice(0, half).to_pylist())
    assert sorted(met) == sorted((a, b) for a, b in want if (a in first) != (b in first))
    monkeypatch.undo()
    assert with_tiles == (tiles.TILE, tiles.WIDE, correlate.TILE)
    monkeypatch.setattr(correlate, "BLOCK_SERIES", series_per_block)
    got = correlated_pairs(rows_of(spark, one), 0.5, copies=True).collect()
    assert {(x.a, x.b) for x in got} == set(want) and len(got) == len(want)
    assert {("s003", "x-copy"), ("s003", "x-copy2"), ("x-copy", "x-copy2")} <= set(want)


def test_a_block_travels_as_one_row(spark):
    """No row per series and pair of blocks is moved."""
    df = rows_of(spark, {k: v for k, v in noisy_series().items() if k[0] == "s"})
    plan = correlated_pairs(df, 0.8, copies=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "_rows#" in plan and "_x#" not in plan and "_at#" not in plan
