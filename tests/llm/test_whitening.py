"""Whitening against plain NumPy, exact integers and eigenproblems with known answers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import whitening
from tickloom.llm.queries import op11_embedding_whitening

FOLDER = "/root/testdata/sf0.001"


def by_definition(vectors):
    x = np.floor(np.array(vectors, dtype=float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    white = (x - s / n) @ axes / np.sqrt(values)
    return n, [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x], white, values / np.trace(cov)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, away, white, explained = by_definition([r.embedding for r in rows])
    found = op11_embedding_whitening(spark, FOLDER).toPandas()
    assert len(found) == 4 * len(rows) and set(found.n) == {n} and found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-9
    place = {r.vec_id: k for k, r in enumerate(rows)}
    for component, part in found.groupby("component"):
        at = part.vec_id.map(place).to_numpy()
        want, got = white[at, component - 1], part.whitened.to_numpy()
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-8
        assert part.deviation.tolist() == [away[k] for k in at]
        assert np.abs(part.explained / explained[component - 1] - 1).max() < 1e-12


@pytest.mark.parametrize("values", [
    np.linspace(1, 100, 40), np.exp(-0.7 * np.arange(40)), [5.0] * 8 + [3.0] * 8 + list(range(1, 9)), [1 + 1e-7 * k for k in range(20)], [1 + 1e-12 * k for k in range(8)] + [0.0] * 4,
    [1e-9 * k for k in range(12)] + [7.0], [2.0], [1.0] * 5])
def test_eigenvectors(values):
    """Spread, decaying, repeated and clustered eigenvalues: orthogonal, diagonal, and with the right values."""
    size, wide, rng = len(values), np.longdouble, np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(size, size)))[0].astype(wide)
    for _ in range(3):
        q = q @ (1.5 * np.eye(size, dtype=wide) - 0.5 * (q.T @ q))
    a = (q * np.array(values, dtype=wide)) @ q.T
    w, x = whitening.eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-17 and np.abs((a + a.T) / 2 @ x - x * w).max() < 1e-17 * max(values)
    assert np.abs(w - np.sort(np.array(values, dtype=wide))[::-1]).max() < 1e-17 * max(values)


def test_clusters_need_their_own_solve(monkeypatch):
    """Without the solve inside a cluster the float32 start leaves its vectors mixed."""
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(12, dtype=np.longdouble) - 0.5 * (q.T @ q))
    a = (q * np.array([1 + 1e-9 * k for k in range(12)], dtype=np.longdouble)) @ q.T
    wrong = {}
    for name, solve in (("with", whitening._solve_cluster), ("without", lambda a, x, columns: x)):
        monkeypatch.setattr(whitening, "_solve_cluster", solve)
        w, x = whitening.eigenvectors(a, rounds=12)
        wrong[name] = float(np.abs((a @ x - x * w)).max())
    assert wrong["with"] < 1e-17 < 1e-12 < wrong["without"]


def test_exact_integers():
    rng = np.random.default_rng(1)
    y = rng.integers(-2**40, 2**40, (5000, 4))
    assert (whitening.exact_products(y) == y.astype(object).T @ y.astype(object)).all()
    for most, n in ((100, 1000), (2**30, 10**6), (2**40, 2**35)):
        x = rng.integers(-most, most, (40, 6))
        sums = [int(v) * 7 for v in x.sum(axis=0)]
        assert whitening.deviations(x, n, sums) == [sum((n * int(v) - t) ** 2 for v, t in zip(r, sums)) for r in x]
    a, b = 3**70 + 1, 7**50
    assert abs(Fraction(*whitening._ratio(a, b).as_integer_ratio()) / Fraction(a, b) - 1) < Fraction(1, 2**60)


def test_repeats_count_once_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 5)).round(3).tolist()
    rows = [(k, v) for k, v in enumerate(base + [base[0]] * 200)]
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        found.append(whitening.whiten(df).orderBy("vec_id", "component").collect())
    assert [r[:6] for r in found[0]] == [r[:6] for r in found[1]]  # bit by bit
    n, away, _, _ = by_definition([v for _, v in rows])
    assert {r.n for r in found[0]} == {n} and [r.deviation for r in found[0]] == [a for a in away for _ in range(4)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.1, None, 0.3]), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, [1e30, 0.0, 0.0]), (6, [0.5, 0.5]), (7, []), (None, [0.5, -0.0, 0.25]), (8, [0.1, 0.2, 0.25]), (8, [0.1, 0.2, 0.25]), (9, [-0.4, 0.6, 0.25])]
    df = spark.createDataFrame([(i, v, "a", 1, 2.0, "d") for i, v in rows], "vec_id long, embedding array<double>, id string, component int, x double, n string")
    found = whitening.whiten(df).toPandas()
    assert sorted(found.vec_id.fillna(-1).tolist()) == sorted([-1.0, 8.0, 8.0, 9.0] * 3) and set(found.n) == {3}  # three dimensions, three distinct vectors
    flat = found[found.component == 3]
    assert flat.whitened.isna().all() and found[found.component < 3].whitened.notna().all()  # three points span two dimensions
    one = whitening.whiten(df.where("vec_id = 8")).toPandas()
    assert len(one) == 6 and one.whitened.isna().all() and one.explained.isna().all() and one.identity_error.isna().all() and (one.deviation == 0).all()
    for empty in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 7")):
        assert whitening.whiten(empty).count() == 0
    assert math.isclose(found.identity_error.iloc[0], 0, abs_tol=1e-9)
