"""Pairs of series whose P&L moves together, without meeting all pairs.

A series is one value per whole-numbered moment (day, month) of a common calendar; moments without a row
count as 0.  Centred and scaled to length one, two series with correlation r lie sqrt(2 - 2 r) apart, and no
nearer in any orthonormal coordinates.  The leading Fourier coefficients are such coordinates and plain sums
over a series' rows, so one aggregation gives the sketch of every series whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.tiles import TILE, Meet, Rows, least_blocks, met_blocks, packed, places
from tickloom.session import cut_lineage

c = F.col
#: Series and rows of a block at most, about.
BLOCK_SERIES, BLOCK_MOVES = 1 << 17, 1 << 21
#: Slack of the final comparison.
SLACK = 1e-9


def _sketched(series: DataFrame, key: str, leading: int) -> tuple[DataFrame, int, int]:
    """(key, _name, _s, _norm, _f) per series that varies, the length of the calendar and of `_f`."""
    span = series.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    length = 1 if span.a is None else span.b - span.a + 1
    waves = range(1, min(leading, (length - 1) // 2) + 1)
    turn = lambda k: (c("at") - F.lit(span.a)) * F.lit(2 * math.pi * k / length)
    parts = [F.sum(c("x") * wave(turn(k))) for k in waves for wave in (F.cos, F.sin)]
    sums = series.groupBy(key).agg(
        F.sum("x").alias("_s"), F.sum(c("x") * c("x")).alias("_q"), F.array(*parts).cast("array<double>").alias("_f"),
        F.struct(F.count_if(c("x") != 0).alias("n"), F.sum(F.when(c("x") != 0, F.xxhash64("at", "x")).cast("decimal(38,0)")).alias("h")).alias("_name"))
    left = c("_q") - c("_s") * c("_s") / length
    moving = sums.filter(left > c("_q") * 1e-12).withColumn("_norm", F.sqrt(left))
    scaled = F.transform("_f", lambda v: v * F.lit(math.sqrt(2 / length)) / c("_norm"))
    return moving.select(key, "_name", "_s", "_norm", scaled.alias("_f")), length, 2 * len(waves)


def _series(daily: DataFrame, key: str, at: str, pnl: str) -> DataFrame:
    rows = daily.select(key, c(at).cast("long").alias("at"), c(pnl).cast("double").alias("x")).dropna()
    return rows.groupBy(key, "at").agg((F.sum("x") + 0.0).alias("x"))


def series_classes(daily: DataFrame, key: str = "strategy_id", at: str = "at", pnl: str = "pnl") -> DataFrame:
    """(key, class): the least key with the same values at the same moments; series that never vary are left out."""
    points, _, _ = _sketched(cut_lineage(_series(daily, key, at, pnl)), key, 0)
    heads = points.groupBy("_name").agg(F.min(key).alias("class"))
    return points.join(heads, "_name").select(key, "class")


def _widest(points: DataFrame, width: int, axes: int) -> list[int]:
    """The coordinates of `_f` that spread most."""
    if not width:
        return []
    wide = points.agg(*[F.coalesce(F.stddev_pop(c("_f")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(width)]).first()
    return sorted(range(width), key=lambda i: (-wide[i], i))[:axes]


def near_points(points: DataFrame, width: int, reach: float, key: str, axes: int = 3) -> DataFrame:
    """Pairs a < b of points (`_f`, of `width` coordinates) no further apart than `reach`, with both rows' columns.

    Points meet in cells of size `reach` along the `axes` coordinates that spread most; one side also looks
    into the neighbouring cells, so each pair meets once.
    """
    chosen = _widest(points, width, axes)
    cell: list[Column] = [F.floor(c("_f")[i] / reach).cast("long") for i in chosen]
    steps = [F.array(*[place + step for place, step in zip(cell, shift)]) if chosen else F.array(F.lit(0).cast("long")) for shift in product((-1, 0, 1), repeat=len(chosen))]
    rest = [n for n in points.columns if n != key]
    side = lambda df, tag: df.select("_cell", c(key).alias(tag), *[c(n).alias(f"{n}_{tag}") for n in rest])
    homes = side(points.withColumn("_cell", F.array(*cell) if chosen else F.array(F.lit(0).cast("long"))), "a")
    around = side(points.withColumn("_cell", F.explode(F.array(*steps))), "b")
    apart = F.aggregate(F.zip_with("_f_a", "_f_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return homes.join(around, "_cell").filter((c("a") < c("b")) & (apart <= reach * reach)).drop("_cell")


def _blocks(points: DataFrame, width: int, key: str, axes: int = 3) -> tuple[DataFrame, DataFrame]:
    """`points` as packed blocks of bounded size, and the boxes of their sketches: cut at quantiles along the widest axes, then by hash."""
    totals = points.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_at")).alias("moves")).first()
    wanted = max(totals.n / BLOCK_SERIES, (totals.moves or 0) / BLOCK_MOVES, least_blocks(points.sparkSession, totals.n), 1)
    chosen = _widest(points, width, max(1, min(axes, int(math.log2(wanted)))))
    cuts = int(wanted ** (1 / max(1, len(chosen))) + 1e-9)
    cell = F.lit(0).cast("long")
    if chosen and cuts > 1:
        inner = points.select(*[c("_f")[i].alias(f"f{i}") for i in chosen]).approxQuantile([f"f{i}" for i in chosen], [k / cuts for k in range(1, cuts)], 0.01)
        for i, limits in zip(chosen, inner):
            cell = cell * cuts + F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x <= c("_f")[i]))
    placed = points.withColumn("_cell", cell)
    held = placed.groupBy("_cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SERIES), F.ceil(F.sum(F.size("_at")) / BLOCK_MOVES)).alias("_parts"))
    part = F.struct("_cell", F.pmod(F.xxhash64(key), "_parts").alias("part"))
    blocks = cut_lineage(placed.join(held, "_cell").withColumn("_block", part).drop("_cell", "_parts"))
    bound = lambda f, tag: F.array(*[f(c("_f")[i]) for i in range(width)]).cast("array<double>").alias(tag)
    return packed(blocks.withColumn("_f", c("_f").cast("array<float>")), "_block"), cut_lineage(blocks.groupBy("_block").agg(bound(F.min, "_lo"), bound(F.max, "_hi")))


def _block_pairs(boxes: DataFrame, reach: float) -> DataFrame:
    """(_i, _j) of the blocks whose boxes of sketches lie no further apart than `reach`; one row per block meets here."""
    side = lambda tag: boxes.select(c("_block").alias(f"_{tag}"), c("_lo").alias(f"_lo_{tag}"), c("_hi").alias(f"_hi_{tag}"))
    gaps = F.zip_with(F.zip_with("_lo_i", "_hi_j", lambda p, q: p - q), F.zip_with("_lo_j", "_hi_i", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)
    return cut_lineage(side("i").join(side("j"), (c("_i") <= c("_j")) & (apart <= reach * reach)).select("_i", "_j"))


def _alike_order(sketch: np.ndarray) -> np.ndarray:
    """Rows in an order that keeps alike ones in a tile: halves along the axis that spreads most, down to a tile."""
    todo, done = [np.arange(len(sketch))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= TILE or not sketch.shape[1]:
            done.append(rows)
            continue
        half = -(-len(rows) // (2 * TILE)) * TILE  # whole tiles
        rows = rows[np.argpartition(sketch[rows, sketch[rows].std(axis=0).argmax()], half - 1)]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(done)


class _Side:
    """The series of a block in tiles: their rows, sums, and the box around the sketches of each tile."""

    def __init__(self, block: pa.Table, sketch: np.ndarray, moments: np.ndarray, length: int):
        order, at = _alike_order(sketch), block["_at"].chunk(0)
        code = np.searchsorted(moments, at.flatten().to_numpy())
        offsets, x = at.offsets.to_numpy() - at.offsets[0].as_py(), block["_x"].chunk(0).flatten().to_numpy()
        self.key, (self.sum, self.norm) = block["_key"].take(pa.array(order)), (block[n].to_numpy()[order] for n in ("_s", "_norm"))
        self.rows = Rows(offsets, code, x, order, len(moments))
        mean = self.sum / length
        # Centred and of length one; the moments without a row on either side are one more column.
        self.unit = Rows(offsets, code, (x - np.repeat((block["_s"].to_numpy() / length), np.diff(offsets))) / np.repeat(block["_norm"].to_numpy(), np.diff(offsets)), order, len(moments),
                         (-mean / self.norm))
        self.rest = (mean / self.norm * math.sqrt(max(length - len(moments), 0))).astype(np.float32)
        ends = list(self.rows.starts())
        self.low, self.high = (f.reduceat(sketch[order], ends, axis=0) if sketch.shape[1] else np.zeros((len(ends), 0)) for f in (np.minimum, np.maximum))


def _correlator(at_least: float, length: int, reach: float) -> Meet:
    """Correlated pairs of two blocks: tiles with near sketches meet in products of single precision, whose finds are then computed in double."""
    def correlate(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        moments = np.unique(np.concatenate([b["_at"].chunk(0).flatten().to_numpy() for b in ((left,) if same else (left, right))]))
        read = lambda b: _Side(b, np.asarray(b["_f"].to_pylist(), dtype=np.float64).reshape(b.num_rows, -1), moments, length)
        one = read(left)
        two = one if same else read(right)
        limit = np.float32(at_least - 1e-4 - 1.2e-7 * (len(moments) + 1))  # sums of unit vectors err by less
        for p, i in enumerate(one.rows.starts()):
            for q, j in enumerate(two.rows.starts()):
                gap = np.maximum(np.maximum(one.low[p] - two.high[q], two.low[q] - one.high[p]), 0)
                if (same and j < i) or gap @ gap > reach * reach + 1e-5:  # sketches travel in single precision
                    continue
                m, n = min(TILE, one.rows.count - i), min(TILE, two.rows.count - j)
                r = reduce(np.add, (one.unit.tile(i, k) @ two.unit.tile(j, k).T for k in one.unit.chunks()))
                if length > len(moments):
                    r[:m, :n] += one.rest[i:i + m, None] * two.rest[None, j:j + n]
                a, b = places(r >= limit)
                a, b = (v[(a < m) & (b < n) & ((a < b) | (not same or i != j))] for v in (a, b))
                if len(a):
                    yield from _exact(one, two, i + a, j + b, i, j, at_least, length)

    return correlate


def _exact(one: _Side, two: _Side, a: np.ndarray, b: np.ndarray, i: int, j: int, at_least: float, length: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of the tiles at (i, j) that reach the bound, from sums in double precision."""
    dots = np.zeros(len(a))
    for k in one.rows.chunks():
        x, y = one.rows.tile(i, k, np.float64), two.rows.tile(j, k, np.float64)
        if len(a) * 16 > len(x) * len(y):
            dots += (x @ y.T)[a - i, b - j]
            continue
        for part in range(0, len(a), 1 << 14):
            here = slice(part, part + (1 << 14))
            dots[here] += np.einsum("ij,ij->i", x[a[here] - i], y[b[here] - j])
    r = (dots - one.sum[a] * two.sum[b] / length) / (one.norm[a] * two.norm[b])
    sure = np.flatnonzero(r >= at_least - SLACK)
    for part in range(0, len(sure), 1 << 16):
        here = sure[part:part + (1 << 16)]
        yield pa.RecordBatch.from_arrays([one.key.take(pa.array(a[here])).combine_chunks(), two.key.take(pa.array(b[here])).combine_chunks(), pa.array(r[here])], ["x", "y", "correlation"])


def correlated_pairs(daily: DataFrame, at_least: float, key: str = "strategy_id", at: str = "at", pnl: str = "pnl", leading: int = 4, copies: bool = False) -> DataFrame:
    """Pairs of different series whose correlation over the whole calendar is `at_least` so much: (a, b, correlation).

    The calendar runs from the least to the greatest moment of the table.  With `copies` every series makes pairs of
    its own; without, equal series are one class, named by its least key (see `series_classes`).  Sketches
    (`leading` waves) that lie too far apart rule a pair out: series are cut into few blocks of alike sketches, which
    travel packed, blocks whose boxes lie too far apart never meet, nor do such tiles of two that do; the others
    are products of two matrices.  Rows of one key and moment are added up, rows with a NULL are left out, and a
    series that never varies has no correlation.  Noise without slow movement has small leading coefficients:
    there nearly all tiles meet, work grows with the square of the series, and the result stays exact.
    """
    if not 0 < at_least <= 1:
        raise ValueError("the bound must be above 0 and at most 1")
    series = cut_lineage(_series(daily, key, at, pnl))
    points, length, width = _sketched(series, key, leading)
    if not copies:
        points = points.groupBy("_name").agg(F.min_by(F.struct(c(key).alias("k"), "_s", "_norm", "_f"), key).alias("_h")).select(c("_h.k").alias(key), "_h._s", "_h._norm", "_h._f")
    heads = cut_lineage(points.select(key, "_s", "_norm", "_f"))
    reach = math.sqrt(2 * (1 - at_least) + 2 * SLACK) + 1e-7
    moves = series.filter("x <> 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("_m"))
    whole = heads.join(moves, key).select(c(key).alias("_key"), "_s", "_norm", "_f", c("_m.at").alias("_at"), c("_m.x").alias("_x"))
    blocks, boxes = _blocks(cut_lineage(whole.filter(c("_norm") < float("inf"))), width, "_key")
    pairs = _block_pairs(boxes, reach)
    sides = [blocks.join(F.broadcast(met.withColumn("_block", c(n))), "_block") for met, n in ((pairs, "_i"), (pairs.filter("_i <> _j"), "_j"))]
    kind = whole.schema["_key"].dataType.simpleString()
    met = met_blocks(*sides, _correlator(at_least, length, reach), f"x {kind}, y {kind}, correlation double", pairs.count())
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "correlation")
