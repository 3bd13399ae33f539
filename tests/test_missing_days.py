"""Missing trading days counted without a row per possible day."""

import numpy as np
import pandas as pd

from tickloom.operators.quality import bar_audit, missing_day_counts, missing_trading_days


def bars_of(spark):
    """Sparse days of several symbols, weekends and holidays among them, two bars on a day, one symbol of a single day."""
    rng = np.random.default_rng(8)
    days = pd.date_range("2023-11-20", "2024-04-10")
    parts = [pd.DataFrame({"symbol": f"S{k}", "time": np.sort(rng.choice(days, 5 + 12 * k, replace=False))}) for k in range(6)]
    parts += [pd.DataFrame({"symbol": "one", "time": [pd.Timestamp("2024-03-29 10:00")]}), pd.DataFrame({"symbol": "S3", "time": pd.to_datetime(["2024-02-01 03:00", "2024-02-01 04:00"])})]
    pdf = pd.concat(parts, ignore_index=True).drop_duplicates()
    return spark.createDataFrame(pdf.assign(open=1.0, high=1.0, low=1.0, close=1.0))


def test_counts_equal_the_listed_days(spark):
    bars = bars_of(spark)
    want = {r.symbol: r["count"] for r in missing_trading_days(bars).groupBy("symbol").count().collect()}
    got = {r.symbol: r.missing_trading_days for r in missing_day_counts(bars).collect()}
    assert {k: n for k, n in got.items() if n} == want and set(got) == {"one", *[f"S{k}" for k in range(6)]} and len(want) > 3
    assert {r.symbol: r.missing_trading_days for r in bar_audit(bars, "d1").collect()} == got
    assert missing_day_counts(bars.limit(0)).collect() == []


def test_audit_lists_no_day_that_could_be_missing(spark):
    plan = bar_audit(bars_of(spark), "d1")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(_a" not in plan and "LeftAnti" not in plan
