import numpy as np
import pandas as pd

from tickloom.operators.quantiles import exact_quantiles


def test_equal_to_numpy_with_ties_and_narrow_brackets(spark):
    draw = np.random.default_rng(4)
    parts = {"many": draw.normal(size=5000), "ties": draw.integers(0, 4, 3000).astype(float), "few": np.array([3.0, 1.0]), "one": np.array([7.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()] + [pd.DataFrame({"k": ["none"], "v": [None]})], ignore_index=True)
    wanted = {"a": ("v", 0.05), "b": ("v", 0.5), "z": ("v", 0.999)}
    for accuracy in (10_000, 100):  # the second one brackets the large groups
        got = {r.k: r for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], wanted, accuracy).collect()}
        assert got["none"].b is None
        for k, v in parts.items():
            assert np.allclose([got[k].a, got[k].b, got[k].z], np.quantile(v, [0.05, 0.5, 0.999]))


def test_one_deal_of_rows_for_curves(spark):
    """Plans without adaptive rewriting: the shuffled rows serve the summary and the folds."""
    import re

    from pyspark.sql import functions as F

    from tickloom.operators.metrics import drawdowns

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        ledger = spark.range(100).select(F.lit("s").alias("strategy_id"), F.col("id").alias("trade_id"), F.timestamp_seconds(F.col("id") * 90_000).alias("exit_time"), F.sin("id").alias("net_pnl"))
        text = plan(drawdowns(ledger, 1000.0))
        assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", text)) <= 4 and text.count("Range (") == 1 and "ReusedExchange" in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_values_are_not_broadcast(spark, tmp_path):
    """Stacked values look as small as the file they come from; the brackets are what may be broadcast."""
    path = str(tmp_path / "values")
    spark.range(3000).selectExpr("CAST(id % 7 AS INT) AS k", "CAST(id AS DOUBLE) AS v").coalesce(1).write.parquet(path)
    out = exact_quantiles(spark.read.parquet(path), ["k"], {f"q{i}": ("v", i / 16) for i in range(1, 16)})
    plan = out._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_name" in line]
    assert joins and not any("BuildLeft" in line for line in joins)
    assert out.count() == 7
