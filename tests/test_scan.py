import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.scan import RollingQuantile, asof_join, carry_last, ema, exp_smooth, over_chunks, range_join, running, wilder, with_position


@pytest.mark.parametrize("chunk", [64, 500, 100_000 // 50])
def test_smoothers_equal_pandas_for_any_chunk(bars, bars_pdf, chunk):
    out = exp_smooth(bars, {"e20": ema("close", 20), "e200": ema("close", 200), "w": wilder("close", 14, start=1)}, chunk=chunk).toPandas()
    for symbol, g in bars_pdf.groupby("symbol"):
        got = out[out.symbol == symbol].sort_values("bar_idx")
        np.testing.assert_allclose(got.e20, g.close.ewm(span=20, adjust=False).mean(), rtol=1e-10)
        np.testing.assert_allclose(got.e200, g.close.ewm(span=200, adjust=False).mean(), rtol=1e-10)
        np.testing.assert_allclose(got.w[1:], g.close[1:].ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-10)


@pytest.mark.parametrize("chunk", [100, 5000])
def test_short_spans_beside_long_ones(bars, bars_pdf, chunk):
    spans = {f"e{n}": ema("close", n) for n in (1, 2, 3, 5, 6, 50)}
    out = exp_smooth(bars, spans, chunk=chunk)
    assert set(out.columns) == {*bars.columns, *spans}
    out = out.toPandas()
    for symbol, g in bars_pdf.groupby("symbol"):
        got = out[out.symbol == symbol].sort_values("bar_idx")
        for n in (1, 2, 3, 5, 6, 50):
            np.testing.assert_allclose(got[f"e{n}"], g.close.ewm(span=n, adjust=False).mean(), rtol=1e-10)


@pytest.mark.parametrize("chunk", [32, 10_000])
def test_frames_and_quantiles_do_not_feel_chunk_borders(bars, bars_pdf, chunk):
    out = over_chunks(
        bars, lambda w: {"m": F.avg("close").over(w.rowsBetween(-49, 0)), "nxt": F.lead("close", 3).over(w)}, before=60, after=3, chunk=chunk,
        quantiles={"q": RollingQuantile("close", 60, 0.25, 20)}).toPandas()
    assert len(out) == len(bars_pdf)
    for symbol, g in bars_pdf.groupby("symbol"):
        got = out[out.symbol == symbol].sort_values("bar_idx")
        np.testing.assert_allclose(got.m, g.close.rolling(50, min_periods=1).mean(), rtol=1e-12)
        np.testing.assert_allclose(got.nxt, g.close.shift(-3), rtol=0)
        np.testing.assert_allclose(got.q, g.close.rolling(60, min_periods=20).quantile(0.25), rtol=1e-12)


@pytest.mark.parametrize("chunk", [16, 1000])
def test_forward_fill_and_its_lag(bars, bars_pdf, chunk):
    mark = F.when(F.col("volume") > 480, F.col("close"))
    out = carry_last(bars, {"v": mark}, chunk=chunk, lagged={"v1": "v"}).toPandas()
    for symbol, g in bars_pdf.groupby("symbol"):
        got = out[out.symbol == symbol].sort_values("bar_idx")
        want = g.close.where(g.volume > 480).ffill()
        np.testing.assert_allclose(got.v, want)
        np.testing.assert_allclose(got.v1, want.shift())


def test_running_folds(bars, bars_pdf):
    out = running(bars, {"s": ("sum", F.col("volume")), "top": ("max", F.col("high"))}, ["symbol"], ["bar_idx"], F.floor(F.col("bar_idx") / 37)).toPandas()
    for symbol, g in bars_pdf.groupby("symbol"):
        got = out[out.symbol == symbol].sort_values("bar_idx")
        np.testing.assert_allclose(got.s, g.volume.cumsum())
        np.testing.assert_allclose(got.top, g.high.cummax())


def test_positions_across_buckets(bars):
    out = with_position(bars.drop("bar_idx").withColumn("want", F.col("close")), ["time"], bucket_seconds=86_400).join(
        bars.select("symbol", "time", F.col("bar_idx").alias("true_idx")), ["symbol", "time"])
    assert out.filter("bar_idx <> true_idx").count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_equals_pandas(spark, bars, bars_pdf, direction):
    rng = np.random.default_rng(3)
    right = pd.DataFrame({"symbol": rng.choice(["A", "B"], 80), "time": pd.Timestamp("2024-01-02") + pd.to_timedelta(rng.integers(0, 600 * 60, 80), unit="min")})
    right = right.drop_duplicates().reset_index(drop=True)
    right["x"] = np.arange(len(right), dtype=float)
    out = asof_join(bars, spark.createDataFrame(right), ["x"], direction=direction, bucket_seconds=36_000).toPandas().sort_values(["time", "symbol"])
    want = pd.merge_asof(bars_pdf.sort_values(["time", "symbol"]), right.sort_values("time").astype({"time": bars_pdf.time.dtype}), on="time", by="symbol", direction=direction)
    np.testing.assert_allclose(out.x.to_numpy(), want.x.to_numpy())


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    points = pd.DataFrame({"p": rng.uniform(0, 100, 200)})
    spans = pd.DataFrame({"lo": rng.uniform(0, 90, 30)})
    spans["hi"] = spans.lo + rng.uniform(0, 25, 30)
    got = range_join(spark.createDataFrame(points), spark.createDataFrame(spans), "p", "lo", "hi", 10.0).count()
    want = sum(((points.p >= lo) & (points.p < hi)).sum() for lo, hi in spans.values)
    assert got == want


def test_asof_reads_each_side_once(spark, bars, tmp_path):
    """The plan has one scan per side and deals the stacked rows once."""
    bars.write.parquet(str(tmp_path / "l"))
    bars.select("symbol", "time", F.col("close").alias("x")).write.parquet(str(tmp_path / "r"))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in "lr")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for direction in ("backward", "forward"):
            plan = asof_join(left, right, ["x"], direction=direction)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 2 and "ReusedExchange" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_asof_ties_take_the_order_asked_for(spark):
    """Several right rows at one moment: the last by `right_order` looking back, the first looking ahead."""
    left = spark.createDataFrame([("A", "2024-01-01 10:00:00", 1), ("A", "2024-01-03 00:00:00", 2), (None, "2024-01-01 10:00:00", 3)], "symbol string, at string, n int").withColumn("time", F.col("at").cast("timestamp")).drop("at")
    right = spark.createDataFrame([("A", "2024-01-01 10:00:00", k, float(k)) for k in (3, 1, 2)] + [("A", "2024-01-05 00:00:00", k, 10.0 + k) for k in (2, 1)], "symbol string, at string, seq int, x double")
    right = right.withColumn("time", F.col("at").cast("timestamp"))
    pick = lambda direction: sorted((r.n, r.x) for r in asof_join(left, right, ["x"], direction=direction, right_order=["seq"], bucket_seconds=3600).collect())
    assert pick("backward") == [(1, 3.0), (2, 3.0)] and pick("forward") == [(1, 1.0), (2, 11.0)]
