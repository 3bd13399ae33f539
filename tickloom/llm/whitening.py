"""Whitening of embeddings: exact distributed covariance, mixed-precision eigenvectors.

Entries become integers on a grid of 1/256.  The fit list holds each distinct integer vector once.
Spark sums its vectors and the products of the centred vectors as exact integers, so the covariance
is the same whatever the partitioning.  Eigenvectors start in float32 and are corrected by
Ogita-Aishima iterations, which are matrix products in a wider type; eigenvalues that lie too close
together for the correction get a solve of their own inside the space they span.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import store

SCALE = 256
#: Entries of this size and more do not fit the exact arithmetic; their rows are dropped.
LARGEST = float(1 << 40)
_LIMB = 20
#: Rows per exact matrix product: two limbs of 20 bits and 2**12 rows stay within 53 bits.
_BLOCK = 1 << 12
WIDE = np.longdouble
#: Eigenvalues this close, relative to the largest, count as equal: any basis of their space will do.
EQUAL = 1e-13


def eigenvectors(matrix: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), falling, of a symmetric matrix in a wide type.

    Starts from the float32 solution and repeats X <- X + X E.  With R = I - X'X and S = X'AX the
    eigenvalues are S_ii / (1 - R_ii), and E_ij = (S_ij + w_j R_ij) / (w_j - w_i) where the two
    eigenvalues are further apart than the error bound d = 2 (|S - diag w| + |A| |R|), else
    R_ij / 2, which only makes the columns orthogonal.  Columns whose eigenvalues are linked by
    gaps under d are a cluster: the matrix is projected on their space, shifted by their mean
    eigenvalue and solved there, where the gaps are no longer small beside the entries.
    """
    size = len(matrix)
    matrix = (matrix + matrix.T) / 2
    scale = np.abs(matrix).max() if size else WIDE(0)
    if not scale:
        return np.zeros(size, dtype=WIDE), np.eye(size, dtype=WIDE)
    a = matrix / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    eye, norm = np.eye(size, dtype=WIDE), np.linalg.norm(a.astype(float), 2)
    best = None
    for _ in range(rounds):
        r, off, w = _residuals(a, x, eye)
        wrong = float(np.abs(off).max() + np.abs(r).max())
        if best is not None and wrong >= best[0] / 2 and best[0] < 1e-15:
            break  # as orthogonal and as diagonal as the wide type allows
        if best is None or wrong < best[0]:
            best = (wrong, x)
        bound = 2 * (np.linalg.norm(off.astype(float), 2) + norm * np.linalg.norm(r.astype(float), 2))
        clusters = _clusters(w, bound)
        for columns in clusters:
            x = _solve_cluster(a, x, columns)
        if clusters:
            r, off, w = _residuals(a, x, eye)
        apart = w[None, :] - w[:, None]
        far = np.abs(apart) > EQUAL * norm
        e = np.where(far, (off + w[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ np.where(np.abs(e) > 0.1, r / 2, e)  # a larger step is beyond first order: left to the cluster
    x = best[1]
    for _ in range(2):
        x = x @ (1.5 * eye - 0.5 * (x.T @ x))
    w = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-w, kind="stable")
    x = x[:, order]
    head = np.take_along_axis(x, np.abs(x).argmax(axis=0)[None, :], axis=0)
    return w[order] * scale, x * np.where(head < 0, -1, 1)


def _residuals(a: np.ndarray, x: np.ndarray, eye: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(I - X'X, X'AX without its diagonal, eigenvalues)."""
    r, s = eye - x.T @ x, x.T @ (a @ x)
    return r, s - np.diag(np.diag(s)), np.diag(s) / (1 - np.diag(r))


def _clusters(w: np.ndarray, bound: float) -> list[np.ndarray]:
    """Columns whose eigenvalues are linked by gaps of at most `bound`."""
    order = np.argsort(-w, kind="stable")
    wide = np.flatnonzero(-np.diff(w[order]) > bound) + 1
    return [c for c in np.split(order, wide) if len(c) > 1]


def _solve_cluster(a: np.ndarray, x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Turn the columns of one cluster inside their own space so that they are eigenvectors there."""
    own = x[:, columns]
    for _ in range(2):  # orthonormal to the wide type, by the Newton step for X'X = I
        own = own @ (1.5 * np.eye(len(columns), dtype=WIDE) - 0.5 * (own.T @ own))
    mean = np.einsum("ij,ij->", own, a @ own) / len(columns)
    inner = own.T @ (a @ own - mean * own)
    inner = (inner + inner.T) / 2
    size = np.abs(inner).max()
    if size > 64 * len(a) * np.finfo(WIDE).eps:
        turn = np.linalg.eigh((inner / size).astype(float))[1].astype(WIDE)
        turn = turn @ (1.5 * np.eye(len(columns), dtype=WIDE) - 0.5 * (turn.T @ turn))
        own = own @ turn
    x = x.copy()
    x[:, columns] = own
    return x


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of integers under 2**41 as exact Python integers.

    Entries are split into limbs of 20 bits; each product of limbs over a block of rows is exact in float64.
    """
    size = y.shape[1]
    total = np.zeros((size, size), dtype=object)
    for begin in range(0, len(y), _BLOCK):
        rest, limbs = y[begin: begin + _BLOCK], []
        while True:
            low = ((rest + (1 << (_LIMB - 1))) & ((1 << _LIMB) - 1)) - (1 << (_LIMB - 1))
            limbs.append(low.astype(float))
            rest = (rest - low) >> _LIMB
            if not rest.any():
                break
        for i, left in enumerate(limbs):
            for j, right in enumerate(limbs):
                total += (left.T @ right).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return total


def _sums(size: int):
    """Per task: the sum of each dimension, and the number of rows as i = -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(size, dtype=object)
        for batch in batches:
            count += batch.num_rows
            for begin in range(0, batch.num_rows, _BLOCK):
                total += _matrix(batch.column(0).slice(begin, _BLOCK), size).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(v) for v in [count, *total]])], names=["i", "value"])
    return run


def _products(size: int, centre: np.ndarray):
    """Per task: the upper triangle of y'y as (i, j, value), y being the rows minus `centre`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), dtype=object)
        for batch in batches:
            if batch.num_rows:
                total += exact_products(_matrix(batch.column(0), size) - centre)
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in total[i, j]])], names=["i", "j", "value"])
    return run


def _moments(size: int, mean: np.ndarray, turn: np.ndarray):
    """Per task: count, sums and products of the whitened rows of the fit list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first, second = 0, np.zeros(turn.shape[1]), np.zeros((turn.shape[1], turn.shape[1]))
        for batch in batches:
            if batch.num_rows:
                white = (_matrix(batch.column(0), size) - mean) @ turn
                count, first, second = count + len(white), first + white.sum(axis=0), second + white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([first.tolist()]), pa.array([second.ravel().tolist()])], names=["count", "first", "second"])
    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)**2 as exact integers."""
    reach = n * (int(np.abs(x).max(initial=0))) + max((abs(s) for s in sums), default=0)
    if reach * reach * x.shape[1] < 1 << 62:
        away = n * x - np.array(sums, dtype=np.int64)
        return (away * away).sum(axis=1).tolist()
    if reach < 1 << 62:  # two limbs of 31 bits: each partial sum fits, the total may not
        away = n * x - np.array(sums, dtype=np.int64)
        low, high = away & ((1 << 31) - 1), away >> 31
        parts = [[(p >> 31).sum(axis=1).tolist(), (p & ((1 << 31) - 1)).sum(axis=1).tolist()] for p in (high * high, high * low, low * low)]
        whole = [[(a << 31) + b for a, b in zip(*p, strict=True)] for p in parts]
        return [(h << 62) + (m << 32) + s for h, m, s in zip(*whole, strict=True)]
    away = n * x.astype(object) - np.array(sums, dtype=object)
    return (away * away).sum(axis=1).tolist()


def _whiten(size: int, n: int, sums: list[int], turn: np.ndarray, explained: list[float | None], error: float | None):
    mean, parts = np.array([s / n for s in sums]), turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                x = _matrix(batch.column("x"), size)
                white = ((x - mean) @ turn).ravel()
                away = pa.array([v if v < 1 << 63 else None for v in deviations(x, n, sums)], pa.int64())
                rows = np.repeat(np.arange(len(x)), parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, parts + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), n), pa.int64()), away.take(pa.array(rows)),
                     pa.array(white, mask=np.isnan(white)), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(rows), pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4) -> DataFrame:
    """One row per remaining row of `vectors` and component: the row's whitened coordinate.

    Rows whose vector is null, holds a null or non-finite entry, or an entry that reaches 2**40 in
    grid steps are dropped, and so are those whose length is not the commonest one (of ties, the
    larger); rows with a null id and repeated rows stay.  There are as many components as
    dimensions, at most `components`.  `whitened` is NULL for a component without variance (a
    single distinct vector, a dependent dimension), `explained` and `identity_error` where there
    is no variance at all, `deviation` where the exact value exceeds a long.  Of equal eigenvalues
    any basis may come; it is the same for all rows.  An empty table gives no rows.  Other columns
    are ignored, whatever their names.

    One pass counts lengths, one makes the fit list (a grouped distinct, combined before the
    shuffle), two sum over it and one checks it; tasks hand on d*(d+3)/2 numbers each, the driver
    gets d*(d+3)/2 in all.
    """
    spark = vectors.sparkSession
    raw = F.col(vector_column)
    fine = raw.isNotNull() & F.forall(raw, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < LARGEST), F.lit(False)))
    on_grid = F.transform(raw, lambda v: F.floor(v.cast("double") * SCALE))
    rows = vectors.where(fine).select(F.col(id_column).alias("id"), on_grid.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None or sizes["size"] == 0:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    size = sizes["size"]
    rows = rows.where(F.size("x") == size)
    fit = store(rows.select("x").distinct(), "fit")
    value = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    heads = {r.i: int(r.value) for r in fit.mapInArrow(_sums(size), "i int, value string").groupBy("i").agg(value).collect()}
    n, sums = heads[-1], [heads[k] for k in range(size)]
    centre = [round(s / n) for s in sums]
    found = fit.mapInArrow(_products(size, np.array(centre, dtype=np.int64)), "i int, j int, value string").groupBy("i", "j").agg(value).collect()
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    cov = np.zeros((size, size), dtype=WIDE)
    for r in found:
        cov[r.i, r.j] = cov[r.j, r.i] = _ratio(n * int(r.value) - left[r.i] * left[r.j], n * n)
    values, axes = eigenvectors(cov)
    keep = min(components, size)
    trace = np.trace(cov)
    small = trace * size * WIDE(np.finfo(float).eps)
    lengths = [math.sqrt(v) if v > small else math.nan for v in values[:keep]]
    turn = (axes[:, :keep] / np.array(lengths, dtype=WIDE)).astype(float)
    explained = [float(v / trace) if trace > 0 else None for v in values[:keep]]
    error = _identity_error(fit, size, np.array([s / n for s in sums]), turn[:, ~np.isnan(lengths)])
    out = rows.mapInArrow(_whiten(size, n, sums, turn, explained, error), schema)
    return out.withColumnRenamed("id", id_column)


def _ratio(a: int, b: int) -> WIDE:
    """a / b in the wide type: the rounded quotient and the quotient of what it leaves."""
    if a == 0:
        return WIDE(0)
    high = a / b
    top, bottom = high.as_integer_ratio()
    return WIDE(high) + WIDE((a * bottom - top * b) / (b * bottom))


def _identity_error(fit: DataFrame, size: int, mean: np.ndarray, turn: np.ndarray) -> float | None:
    """Largest absolute entry of the measured covariance of the whitened fit list minus the identity."""
    width = turn.shape[1]
    if width == 0:
        return None
    parts = fit.mapInArrow(_moments(size, mean, turn), "count long, first array<double>, second array<double>")
    sums = parts.agg(F.sum("count").alias("n"), *[F.sum(F.col("first")[k]).alias(f"a{k}") for k in range(width)], *[F.sum(F.col("second")[k]).alias(f"b{k}") for k in range(width * width)]).first()
    middle = np.array([sums[f"a{k}"] for k in range(width)]) / sums["n"]
    cov = np.array([sums[f"b{k}"] for k in range(width * width)]).reshape(width, width) / sums["n"] - np.outer(middle, middle)
    return float(np.abs(cov - np.eye(width)).max())
