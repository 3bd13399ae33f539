"""Ordered scans that do not put one long series into one task.

A market series is addressed by row position, and one symbol may hold a third of all
rows, so `Window.partitionBy("symbol")` alone is not an option.  Every helper here cuts
a series into chunks and moves only per-chunk summaries between them:

* `with_position`   row numbers from per-bucket counts
* `over_chunks`     bounded frames, with neighbouring rows copied over the chunk border
* `exp_smooth`      recursive smoothers as chunk-local sums plus a carry
* `carry_last`      forward fill
* `running`         cumulative sum / max / min
* `asof_join`       backward or forward as-of join
* `range_join`      interval containment through an equi-join on buckets
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK = 2048
_DOUBLE_BITS = 60


def epoch_seconds(time: Column | str) -> Column:
    """Seconds since 1970 of a timestamp with or without zone (session clock is UTC)."""
    return F.unix_micros(F.col(time).cast("timestamp") if isinstance(time, str) else time.cast("timestamp")) / F.lit(1e6)


def time_bucket(time: Column | str, seconds: int) -> Column:
    return F.floor(epoch_seconds(time) / F.lit(seconds)).cast("long")


def with_position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    time: str = "time",
    bucket_seconds: int = 86_400 * 30,
    name: str = "bar_idx",
) -> DataFrame:
    """Add the 0-based position of each row within its key.

    Rows are numbered inside a (key, time bucket) and shifted by the counts of earlier
    buckets, so a task sees one bucket, not one key.  Choose `bucket_seconds` so that a
    bucket holds some thousand rows; on a bar grid that bound is exact.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", time_bucket(time, bucket_seconds))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        bucketed.join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bucket", "_offset")
    )


def with_halo(
    df: DataFrame, idx: str = "bar_idx", chunk: int = CHUNK, before: int = 0, after: int = 0,
) -> DataFrame:
    """Copy each row to every chunk whose frames can reach it; `_own` marks the original."""
    position = F.col(idx)
    first = F.greatest(F.floor((position - after) / chunk), F.lit(0))
    last = F.floor((position + before) / chunk)
    return (
        df.withColumn("_chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("_own", F.col("_chunk") == F.floor(position / chunk))
    )


Stage = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class RollingQuantile:
    """Linear-interpolated quantile of the last `rows` rows, NULL below `min_rows` values."""

    column: str
    rows: int
    q: float
    min_rows: int
    shift: int = 0


@dataclass(frozen=True)
class RollingRank:
    """Mid-rank of the value among the last `rows` rows, scaled to [-1, 1], NULL below `min_rows` values."""

    column: str
    rows: int
    min_rows: int


@dataclass(frozen=True)
class RollingZscore:
    """(value - mean) / (deviation + eps) over the last `rows` rows, NULL below `min_rows` values."""

    column: str
    rows: int
    min_rows: int
    eps: float


Rolling = RollingQuantile | RollingRank | RollingZscore


def _quantile(values: pa.ChunkedArray, spec: RollingQuantile) -> pa.Array:
    rolled = values.to_pandas().astype(float).rolling(spec.rows, min_periods=spec.min_rows).quantile(spec.q)
    return pa.array(rolled.shift(spec.shift), from_pandas=True, type=pa.float64())


def _rank(values: pa.ChunkedArray, spec: RollingRank) -> pa.Array:
    """Values become their places in the group, so NaN is the largest value, as in SQL; a NULL is none."""
    there = values.is_valid().to_numpy()
    codes = np.full(len(there), np.iinfo(np.int32).max, dtype=np.int32)
    codes[there] = np.unique(values.drop_null().to_numpy(), return_inverse=True)[1]
    twice = there.astype(np.int64)
    for back in range(1, min(spec.rows, len(codes))):
        before, now = codes[:-back], codes[back:]
        twice[back:] += (before < now).view(np.int8) + (before <= now).view(np.int8)
    counted = _counted(there, spec.rows)
    return pa.array(twice / np.maximum(counted, 1) - 1, mask=~there | (counted < spec.min_rows))


def _zscore(values: pa.ChunkedArray, spec: RollingZscore) -> pa.Array:
    """Each frame is summed for itself: running totals would lose the digits of quiet frames."""
    there = values.is_valid().to_numpy()
    x = np.zeros(len(there) + spec.rows - 1)
    x[spec.rows - 1:][there] = values.drop_null().to_numpy()
    inside = np.concatenate([np.zeros(spec.rows - 1, dtype=bool), there])
    frames, used = np.lib.stride_tricks.sliding_window_view(x, spec.rows), np.lib.stride_tricks.sliding_window_view(inside, spec.rows)
    counted = _counted(there, spec.rows)
    mean = frames.sum(axis=1) / np.maximum(counted, 1)
    spread = np.sqrt((np.where(used, frames - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(counted, 1))
    return pa.array((x[spec.rows - 1:] - mean) / (spread + spec.eps), mask=~there | (counted < spec.min_rows))


def _counted(there: np.ndarray, rows: int) -> np.ndarray:
    upto = np.cumsum(there)
    return upto - np.concatenate([np.zeros(rows, dtype=np.int64), upto])[: len(upto)]


_ROLLED = {RollingQuantile: _quantile, RollingRank: _rank, RollingZscore: _zscore}


def _append_quantiles(
    groups: DataFrame, quantiles: dict[str, Rolling], keys: Sequence[str], idx: str,
) -> DataFrame:
    """One Arrow batch per (key, chunk); a sorted frame re-sorts per row on the JVM side,
    which measured over ten times slower per quantile than the incremental one here."""
    schema = StructType([
        *groups.schema.fields, *[StructField(name, DoubleType(), True) for name in quantiles]])
    arrow_schema = to_arrow_schema(schema)

    def apply(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by(idx)
        for name, spec in quantiles.items():
            batch = batch.append_column(name, _ROLLED[type(spec)](batch[spec.column], spec))
        return batch.filter(batch["_own"]).cast(arrow_schema)

    return groups.groupBy(*keys, "_chunk").applyInArrow(apply, schema)


def over_chunks(
    df: DataFrame,
    *stages: Stage,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = ("symbol",),
    idx: str = "bar_idx",
    chunk: int = CHUNK,
    keep: Column | None = None,
    keep_chunk: bool = False,
    quantiles: dict[str, Rolling] | None = None,
) -> DataFrame:
    """Add columns computed over bounded row frames.

    Each stage maps the chunk window to new columns; a later stage may use the columns
    of an earlier one.  `before` and `after` are the total reach over all stages.  All
    stages share one shuffle and one sort.  `keep` drops rows after the frames are known;
    `keep_chunk` leaves the chunk column for a following `exp_smooth` or `carry_last`,
    which then need no shuffle of their own.  `quantiles` are taken after the stages in
    the same partitions.
    """
    window = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    out = with_halo(df, idx, chunk, before, after)
    for stage in stages:
        out = out.withColumns(stage(window))
    if quantiles:
        out = _append_quantiles(out, quantiles, keys, idx)
    condition = F.col("_own") if keep is None else F.col("_own") & keep
    return out.filter(condition).drop(*([] if keep_chunk else ["_chunk"]), "_own")


def _chunked(df: DataFrame, idx: str, chunk: int) -> DataFrame:
    if "_chunk" in df.columns:
        return df
    return df.withColumn("_chunk", F.floor(F.col(idx) / chunk).cast("long"))


@dataclass(frozen=True)
class Smoother:
    """y[start] = x[start]; y[t] = (1 - alpha) * y[t-1] + alpha * x[t]."""

    column: str
    alpha: float
    start: int = 0


def ema(column: str, span: int, start: int = 0) -> Smoother:
    return Smoother(column, 2.0 / (span + 1.0), start)


def wilder(column: str, length: int = 14, start: int = 0) -> Smoother:
    return Smoother(column, 1.0 / length, start)


def exp_smooth(
    df: DataFrame,
    smoothers: dict[str, Smoother],
    keys: Sequence[str] = ("symbol",),
    idx: str = "bar_idx",
    chunk: int = CHUNK,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add exponentially smoothed columns.

    Within a chunk the recursion is a scaled running sum.  What enters a chunk is the
    response at the end of the chunks before it; terms below 2**-60 of their start
    weight cannot change a double and are left out, so few chunks look back.  A smoother so
    quick that its weights leave the range of a double within a chunk runs over shorter
    chunks.  Inputs must be non-null from row `start` of each key on.
    """
    keys = list(keys)
    quick = {n: s for n, s in smoothers.items() if s.alpha < 1 and -math.log1p(-s.alpha) * chunk > 650}
    if quick:
        held = df.withColumnRenamed("_chunk", "_held_chunk")
        short = min(int(600 / -math.log1p(-s.alpha)) for s in quick.values())
        out = exp_smooth(held, quick, keys, idx, short).withColumnRenamed("_held_chunk", "_chunk")
        slow = {n: s for n, s in smoothers.items() if n not in quick}
        out = exp_smooth(out, slow, keys, idx, chunk, keep_chunk) if slow else _chunked(out, idx, chunk) if keep_chunk else out.drop("_chunk")
        return out
    position = F.col(idx) % chunk
    base = _chunked(df, idx, chunk)

    copies = {n: F.when(F.col(idx) >= s.start, F.col(s.column)) for n, s in smoothers.items() if s.alpha >= 1}
    smoothers = {n: s for n, s in smoothers.items() if n not in copies}
    if not smoothers:
        return base.withColumns(copies).drop(*([] if keep_chunk else ["_chunk"]))

    def weighted(s: Smoother) -> Column:
        weight = F.when(F.col(idx) == s.start, F.lit(1.0)).otherwise(F.lit(s.alpha))
        return F.when(F.col(idx) >= s.start, weight * F.col(s.column))

    ends, carries = {}, {}
    along = Window.partitionBy(*keys).orderBy("_chunk")
    for name, s in smoothers.items():
        log_decay = math.log1p(-s.alpha)
        ends[name] = F.sum(weighted(s) * F.exp(F.lit(log_decay) * (chunk - 1 - position)))
        look_back = int(math.ceil(_DOUBLE_BITS * math.log(2) / -log_decay / chunk)) + 1
        carries[name] = sum(
            (F.coalesce(F.lag(f"_end_{name}", j).over(along), F.lit(0.0)) * math.exp(log_decay * chunk * (j - 1))
             for j in range(1, look_back + 1)),
            F.lit(0.0),
        )
    summary = (
        base.groupBy(*keys, "_chunk").agg(*[end.alias(f"_end_{name}") for name, end in ends.items()])
        .select(*keys, "_chunk", *[carry.alias(f"_carry_{name}") for name, carry in carries.items()])
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    columns = {}
    for name, s in smoothers.items():
        log_decay = math.log1p(-s.alpha)
        local = F.sum(weighted(s) * F.exp(F.lit(-log_decay) * position)).over(inside) * F.exp(F.lit(log_decay) * position)
        carried = F.col(f"_carry_{name}") * F.exp(F.lit(log_decay) * (position + 1))
        columns[name] = F.when(F.col(idx) >= s.start, local + carried)
    return (
        base.join(summary, [*keys, "_chunk"]).withColumns({**columns, **copies})
        .drop(*([] if keep_chunk else ["_chunk"]), *[f"_carry_{name}" for name in smoothers])
    )


def carry_last(
    df: DataFrame,
    columns: dict[str, Column],
    keys: Sequence[str] = ("symbol",),
    idx: str = "bar_idx",
    chunk: int = CHUNK,
    keep_chunk: bool = False,
    lagged: dict[str, str] | None = None,
) -> DataFrame:
    """Forward-fill: the latest non-null value of each expression up to the row.

    `lagged` maps a new name to a filled one and holds its value on the row before.
    """
    lagged = lagged or {}
    keys = list(keys)
    base = _chunked(df, idx, chunk).withColumns(
        {f"_v_{name}": value for name, value in columns.items()})
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        base.groupBy(*keys, "_chunk")
        .agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(idx))).alias(f"_e_{n}") for n in columns])
        .select(*keys, "_chunk", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in columns])
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)

    def fill(source: str, window: WindowSpec) -> Column:
        return F.coalesce(F.last(f"_v_{source}", ignorenulls=True).over(window), F.col(f"_c_{source}"))

    filled = {n: fill(n, inside) for n in columns} | {n: fill(source, prior) for n, source in lagged.items()}
    return (
        base.join(summary, [*keys, "_chunk"]).withColumns(filled)
        .drop(*([] if keep_chunk else ["_chunk"]), *[f"_v_{n}" for n in columns], *[f"_c_{n}" for n in columns])
    )


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    columns: dict[str, tuple[str, Column]],
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
) -> DataFrame:
    """Add cumulative folds; `columns` maps a name to ("sum" | "max" | "min", expression).

    `bucket` must not decrease along `order`.  A task folds one (key, bucket); earlier
    buckets arrive as one number each.  Rows are dealt by (key, bucket) once, for the summary
    and for the folds, so the input is read once.
    """
    keys = list(keys)
    base = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": expr for n, (_, expr) in columns.items()}).repartition(*keys, "_bucket")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        base.groupBy(*keys, "_bucket").agg(*[_FOLDS[f](f"_v_{n}").alias(f"_s_{n}") for n, (f, _) in columns.items()])
        .select(*keys, "_bucket", *[_FOLDS[f](f"_s_{n}").over(before).alias(f"_c_{n}") for n, (f, _) in columns.items()])
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n, (fold, _) in columns.items():
        local, carry = _FOLDS[fold](f"_v_{n}").over(inside), F.col(f"_c_{n}")
        if fold == "sum":
            out[n] = F.coalesce(local, F.lit(0.0)) + F.coalesce(carry, F.lit(0.0))
        else:
            out[n] = (F.greatest if fold == "max" else F.least)(local, carry)
    return (
        base.join(summary, [*keys, "_bucket"]).withColumns(out)
        .drop("_bucket", *[f"_v_{n}" for n in columns], *[f"_c_{n}" for n in columns])
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    left_time: str = "time",
    right_time: str = "time",
    direction: str = "backward",
    prefix: str = "",
    bucket_seconds: int = 86_400,
    right_order: Sequence[str] = (),
) -> DataFrame:
    """Attach the latest right row at or before (or, forward, the first at or after) each left row.

    Both sides are stacked, dealt by (key, time bucket) once and sorted there, so each is read
    once; the right row carried into a bucket comes from one summary row per bucket.  Left rows
    without a key or a time drop out.  Added columns are
    `prefix + name`.  `right_order` breaks ties between right rows of equal time.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown as-of direction: {direction}")
    keys = list(keys)
    backward = direction == "backward"
    sign = 1 if backward else -1
    payload = F.struct(*[F.col(c).alias(prefix + c) for c in columns])
    tie = F.struct(*[F.col(c) for c in right_order]) if right_order else F.lit(0)

    def placed(df: DataFrame, time: str) -> DataFrame:
        return df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")) * sign).withColumn(
            "_bucket", F.floor(F.col("_t") / (bucket_seconds * 1_000_000)).cast("long"))

    right_rows = placed(right.filter(F.col(right_time).isNotNull()), right_time).select(
        *keys, "_bucket", "_t", payload.alias("_right"), tie.alias("_tie"), F.lit(0).alias("_side"))
    left_rows = placed(left, left_time).select(
        *keys, "_bucket", "_t", F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(1).alias("_side"))
    # Dealt once: with the same columns and the same filters both readers below share one exchange.
    stacked = left_rows.unionByName(right_rows, allowMissingColumns=True).filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "_bucket"])).repartition(*keys, "_bucket")
    # Of right rows at one moment the last by `right_order` counts looking back, the first looking ahead.
    nearest = (F.max_by if backward else F.min_by)("_right", F.when((F.col("_side") == 0) & F.col("_left").isNull(), F.struct(F.col("_t") * sign, "_tie")))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        stacked.groupBy(*keys, "_bucket").agg(nearest.alias("_end"))
        .select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side", F.col("_tie").asc() if backward else F.col("_tie").desc()).rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        stacked.join(carry, [*keys, "_bucket"])
        .withColumn("_match", F.coalesce(F.last("_right", ignorenulls=True).over(inside), F.col("_carry")))
        .filter("_side = 1")
    )
    return matched.select("_left.*", *[F.col(f"_match.{prefix}{c}").alias(prefix + c) for c in columns])


def range_join(
    points: DataFrame,
    spans: DataFrame,
    point: str,
    lo: str,
    hi: str,
    width: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Pair points with spans where `lo <= point < hi`.

    Spans are cut into cells of `width` and meet points in an equi-join, so cost follows
    the matches and not the product of the sides.
    """
    cell = F.floor(F.col(point) / width).cast("long")
    cells = F.sequence(
        F.floor(F.col(lo) / width).cast("long"),
        F.greatest(F.floor(F.col(lo) / width), F.ceil(F.col(hi) / width) - 1).cast("long"))
    left = points.withColumn("_cell", cell)
    right = spans.filter(F.col(lo) < F.col(hi)).withColumn("_cell", F.explode(cells))
    return (
        left.join(right, [*keys, "_cell"])
        .filter((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi)))
        .drop("_cell")
    )
