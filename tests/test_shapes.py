"""Shape refinement against a comparison with every group."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tickloom.operators.grouping import mean_shapes, refine_by_shape, relative_shape, shapes_in_reach
from tickloom.operators.scan import over_chunks


def rows_of(spark, groups=250, rows=1500, seed=6):
    """Walks with level stretches; groups of bars that look alike, and one of bars in a level stretch."""
    rng = np.random.default_rng(seed)
    parts = []
    for symbol, n in (("A", rows), ("B", rows // 5)):
        step = rng.normal(0, 1, n)
        step[100:130] = 0.0
        close = 100 + np.cumsum(step)
        group = rng.integers(0, groups, n)
        group[115:128] = groups
        parts.append(pd.DataFrame({"symbol": symbol, "bar_idx": np.arange(n), "close": close, "group_id": group}))
    return pd.concat(parts, ignore_index=True)


def brute(pdf, least, width=5):
    shapes, keys, own = [], [], []
    for symbol, part in pdf.groupby("symbol"):
        close = part.close.to_numpy()
        for i in range(width, len(part)):
            shapes.append((close[i - width: i] - close[i - width]) / close[i - width] * 100)
            keys.append((symbol, i))
            own.append(int(part.group_id.iloc[i]))
    shapes, own = np.array(shapes), np.array(own)
    ids = np.unique(own)
    means = np.array([shapes[own == g].mean(axis=0) for g in ids])
    centred = lambda x: x - x.mean(axis=1, keepdims=True)
    a, b = centred(shapes), centred(means)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(a @ b.T / (na[:, None] * nb[None, :]), nan=-2.0, posinf=-2.0, neginf=-2.0)
    best = r.argmax(axis=1)
    return {k: (int(ids[j]) if r[i, j] >= least else int(own[i]), r[i]) for i, (k, j) in enumerate(zip(keys, best))}, ids


@pytest.mark.parametrize("least, block", [(0.75, 500), (0.9, 7), (0.999, 500)])
def test_equal_to_every_group(spark, least, block):
    pdf = rows_of(spark)
    want, ids = brute(pdf, least)
    place = {g: j for j, g in enumerate(ids)}
    got = refine_by_shape(spark.createDataFrame(pdf), least=least, block=block).collect()
    assert len(got) == len(want)
    for row in got:
        group, r = want[(row.symbol, row.bar_idx)]
        assert row.refined_group == group or abs(r[place[row.refined_group]] - r.max()) < 1e-9


def test_few_groups_are_compared(spark):
    shaped = over_chunks(spark.createDataFrame(rows_of(spark)), relative_shape(5), before=5)
    usable = shaped.filter(~F.exists("shape", lambda x: x.isNull()))
    means = mean_shapes(usable, "group_id", 5)
    met, _ = shapes_in_reach(usable, means, 5, 0.95, 500)
    compared = met.agg(F.sum(F.coalesce(F.size("_means"), F.lit(0)))).first()[0]
    assert 0 < compared < usable.count() * means.count() / 4


def test_odd_input(spark):
    empty = spark.createDataFrame([], "symbol string, bar_idx long, close double, group_id int")
    assert refine_by_shape(empty).collect() == []
    level = spark.createDataFrame([("A", i, 5.0, 3) for i in range(9)], "symbol string, bar_idx long, close double, group_id int")
    assert {r.refined_group for r in refine_by_shape(level).collect()} == {3}
    with pytest.raises(ValueError):
        refine_by_shape(level, least=0.0)


def test_shapes_are_compared_by_compiled_arithmetic(spark):
    """No fold over an array per row and group, and a group whose shapes cancel out never wins."""
    pdf = rows_of(spark, groups=7)
    found = refine_by_shape(spark.createDataFrame(pdf))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan
    rng = np.random.default_rng(1)
    level = pd.DataFrame({"symbol": "A", "bar_idx": range(40), "close": 0.1 + 0.2, "group_id": 1})
    moving = pd.DataFrame({"symbol": "B", "bar_idx": range(40), "close": 5 + rng.normal(0, 0.1, 40), "group_id": 2})
    got = refine_by_shape(spark.createDataFrame(pd.concat([level, moving], ignore_index=True))).collect()
    assert {r.refined_group for r in got if r.symbol == "A"} == {1} and {r.refined_group for r in got if r.symbol == "B"} == {2}
