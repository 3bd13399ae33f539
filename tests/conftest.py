import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, memory="4g")


def walk(rows: int = 600, seed: int = 42, symbol: str = "A") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, rows)))
    opened = np.r_[100, close[:-1]]
    high = np.maximum(opened, close) * (1 + rng.uniform(0, 0.003, rows))
    low = np.minimum(opened, close) * (1 - rng.uniform(0, 0.003, rows))
    return pd.DataFrame({
        "symbol": symbol, "time": pd.date_range("2024-01-02", periods=rows, freq="h"), "bar_idx": np.arange(rows), "open": opened, "high": high, "low": low,
        "close": close, "volume": rng.integers(0, 500, rows).astype(float)})


@pytest.fixture(scope="session")
def bars_pdf():
    """One symbol holds most of the rows."""
    return pd.concat([walk(600, 42, "A"), walk(150, 7, "B")], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return spark.createDataFrame(bars_pdf).cache()
