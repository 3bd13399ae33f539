import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import easter, normal_cdf
from tickloom.operators import features as D
from tickloom.operators.structure import extended_features


def expected(g: pd.DataFrame) -> pd.DataFrame:
    g = g.reset_index(drop=True)
    ewm = lambda s, n: s.ewm(span=n, adjust=False).mean()
    delta = g.close.diff()
    up, down = delta.clip(lower=0).ewm(com=13, adjust=False).mean(), (-delta.clip(upper=0)).ewm(com=13, adjust=False).mean()
    tr = pd.concat([g.high - g.low, (g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()], axis=1).max(axis=1)
    macd = ewm(g.close, 12) - ewm(g.close, 26)
    out = pd.DataFrame({"rsi14": 100 - 100 / (1 + up / down.replace(0, np.nan)), "atr14": tr.ewm(com=13, adjust=False).mean(), "macd_hist": macd - ewm(macd, 9)})
    mid, sd = g.close.rolling(20).mean(), g.close.rolling(20).std(ddof=0)
    out["bb_width"] = 4 * sd / mid
    poc, last = np.zeros(len(g)), 0.0
    volume = g.volume.replace(0, 1.0)
    for i in range(100, len(g)):
        if i % 5 == 0:
            part = slice(i - 100, i)
            lo, hi = g.low[part].min(), g.high[part].max()
            counts, edges = np.histogram(g.close[part], bins=20, range=(lo, hi), weights=volume[part])
            last = edges[np.argmax(counts)] + (edges[1] - edges[0]) / 2
        if last > 0:
            poc[i] = (g.close[i] - last) / (g.close[i] + 1e-9)
    out["poc_dist"] = poc
    return out


@pytest.mark.parametrize("chunk", [300, 2048])
def test_features_equal_pandas(bars, bars_pdf, chunk):
    out = D.build_features(bars, chunk=chunk).toPandas()
    for symbol, g in bars_pdf.groupby("symbol"):
        got, want = out[out.symbol == symbol].sort_values("bar_idx"), expected(g)
        for name in want:
            np.testing.assert_allclose(got[name], want[name], rtol=1e-8, atol=1e-9, err_msg=name)
        assert got.regime.between(0, 4).all() and got.session.between(0, 4).all()


def test_features_do_not_look_ahead(spark, bars_pdf):
    names = ["rsi14", "macd_norm", "bb_width", "regime", "poc_dist", "prev_sess_bias", "rolling_sharpe", "sd_zone", "vwap_dist"]
    one = bars_pdf[bars_pdf.symbol == "A"]
    full = D.build_features(spark.createDataFrame(one), chunk=300).filter("bar_idx < 400").toPandas().sort_values("bar_idx")
    cut = D.build_features(spark.createDataFrame(one[one.bar_idx < 400]), chunk=300).toPandas().sort_values("bar_idx")
    for name in names:
        np.testing.assert_allclose(full[name].astype(float), cut[name].astype(float), rtol=1e-9, err_msg=name)


def test_window_vectors_have_no_gaps(bars):
    frame = D.trend_score(D.build_features(bars), [])
    rows = D.encode_windows(frame).select("vector").limit(50).collect()
    assert all(len(row.vector) == 40 and np.isfinite(row.vector).all() for row in rows)


def test_unknown_block_is_refused(bars):
    with pytest.raises(ValueError, match="unknown feature blocks"):
        extended_features(bars, ["time", "nope"])


def test_easter_and_normal(spark):
    days = [str(r[0]) for r in spark.createDataFrame([(1961,), (2000,), (2024,), (2025,), (2038,)], "y int").select(easter(F.col("y"))).collect()]
    assert days == ["1961-04-02", "2000-04-23", "2024-03-31", "2025-04-20", "2038-04-25"]
    from statistics import NormalDist
    xs = [-8.0, -3.5, -1.0, 0.0, 0.3, 2.9, 3.1, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().cdf(x) for x in xs], rtol=1e-9, atol=1e-15)
