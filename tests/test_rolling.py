import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import session
from tickloom.operators.scan import over_chunks
from tickloom.operators.structure import cross_asset, normalized, rolling_rank, rolling_zscore
from tickloom.plans import standins

VALUES = [3.0, 1.0, None, 3.0, 2.0, float("nan"), 0.0, -0.0, 5.0, None, 5.0, 5.0, 5.0, 1e9, 1e9 + 1]


def _expected(values, rows, least):
    out = []
    for i, x in enumerate(values):
        frame = [v for v in values[max(0, i - rows + 1): i + 1] if v is not None]
        if x is None or len(frame) < least:
            out.append((None, None))
            continue
        order = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
        twice = sum(2 * (order(v) < order(x)) + (order(v) == order(x)) for v in frame)
        mean = sum(frame) / len(frame)
        spread = math.sqrt(sum((v - mean) ** 2 for v in frame) / len(frame))
        out.append((twice / len(frame) - 1, (x - mean) / (spread + 1e-9)))
    return out


@pytest.mark.parametrize("chunk", [4, 7, 100])
def test_rank_and_zscore_equal_brute_force(spark, chunk):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(VALUES)], "symbol string, bar_idx long, v double")
    found = over_chunks(df, before=3, chunk=chunk, quantiles={**rolling_rank(["v"], 4, 2), **rolling_zscore(["v"], 4, 2)}).orderBy("bar_idx").collect()
    for row, (rank, score) in zip(found, _expected(VALUES, 4, 2), strict=True):
        assert row["v_rank"] == (None if rank is None else pytest.approx(rank))
        assert row["v_z"] == (None if score is None else pytest.approx(score, nan_ok=True, abs=1e-9))


def test_normalising_runs_no_sliding_frame_in_the_plan(spark):
    """A sliding JVM frame adds up all its rows again for every row."""
    df = spark.range(300).select(F.lit("a").alias("symbol"), F.col("id").alias("bar_idx"), (F.col("id") % 17).cast("double").alias("v"))
    for method in ("zscore", "rank"):
        out = normalized(df, ["v", "absent"], 100, method)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 300


def test_tasks_do_not_grow_with_the_input(spark):
    kept = {key: spark.conf.get(key, None) for key in (*session.SIZE_CONF, session.PARTITIONS_CONF)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        session.configure(spark)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") in ("8388608", "8388608b")
        assert session._bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == 4 << 20
        assert int(spark.conf.get(session.PARTITIONS_CONF)) >= session.PARTITIONS
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_daily_bars_read_the_prices_once(spark, tmp_path, monkeypatch):
    rows = [(k, 1, k % 3, k % 2, f"2024-01-{1 + k % 5:02d} 00:00:00", 10.0 * (k + 1), 2.0) for k in range(40)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, d string, l_extendedprice double, l_quantity double")
    lines.withColumn("l_shipdate", F.to_timestamp_ntz("d")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans = []
    monkeypatch.setattr(standins, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    bars = standins.daily_bars(spark, str(tmp_path), "l_suppkey").orderBy("symbol", "time").collect()
    assert plans[0].count("Relation [") == 1
    assert [row["bar_idx"] for row in bars if row["symbol"] == "0"] == list(range(5))
    assert len({(row["symbol"], row["bar_idx"]) for row in bars}) == len(bars) == 10


@pytest.mark.parametrize("exact", [False, True])
def test_cross_asset_scores_equal_pandas(spark, exact):
    """Momentum and ratio scores of both forms against sliding frames, over chunk borders, with bars the other symbol lacks."""
    n = np.arange(400)
    close = {"a": 100 + np.sin(n / 7) * 5 + n * 0.01, "b": 50 + np.cos(n / 11) * 3 + (n % 13) * 0.1}
    times = pd.date_range("2024-01-01", periods=400, freq="h")
    bars = pd.concat([pd.DataFrame({"symbol": s, "time": times, "close": close[s]}) for s in close])
    bars = bars[(bars.symbol == "a") | (bars.time.dt.hour % 5 > 0)]
    bars["bar_idx"] = bars.groupby("symbol").cumcount()
    pairs = spark.createDataFrame([("a", "b")], "symbol string, external string")
    df = spark.createDataFrame(bars)
    got = cross_asset(df, df, pairs, exact=exact, chunk=64).toPandas().sort_values("bar_idx")
    price = bars[bars.symbol == "b"].set_index("time").close.reindex(times).ffill()
    mom, ratio = price / price.shift(12) - 1, pd.Series(close["a"], index=times) / (price + 1e-9)
    score = lambda x, rows, least: (x - x.rolling(rows, min_periods=least).mean()) / (x.rolling(rows, min_periods=least).std(ddof=0) + 1e-9)
    assert len(got) == 400 and not {"_mom", "_ratio"} & set(got.columns)
    np.testing.assert_allclose(got.mom_z, score(mom, 100, 25), rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(got.ratio_z, score(ratio, 200, 50), rtol=1e-6, atol=1e-6)


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They would stay until the driver collects its garbage; the setting is as before afterwards."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name and name.endswith(".data")}

    before, kept = files(), spark.conf.get(session.CLEANUP_CONF)
    df = spark.range(5000).groupBy((F.col("id") % 900).alias("k")).agg(F.sum("id").alias("v"))
    table = session.cut_lineage(df)
    assert not files() - before and spark.conf.get(session.CLEANUP_CONF) == kept
    assert sorted(table.collect()) == sorted(df.collect())
