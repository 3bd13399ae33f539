"""Grouping of bars: k-means, tree leaves, shape matching, win-probability models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import non_zero
from tickloom.operators.scan import CHUNK, Stage, over_chunks
from tickloom.session import cut_lineage

c = F.col


def fit_groups(train: DataFrame, groups: int, vector: str = "vector", seed: int = 42) -> PipelineModel:
    """Standardise and cluster; apply the model to unseen rows with `assign_groups`."""
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    means = KMeans(k=groups, featuresCol="_scaled", predictionCol="group_id", seed=seed, maxIter=50)
    return Pipeline(stages=[scaler, means]).fit(train.withColumn("_features", array_to_vector(c(vector))))


def assign_groups(model: PipelineModel, rows: DataFrame, vector: str = "vector") -> DataFrame:
    return model.transform(rows.withColumn("_features", array_to_vector(c(vector)))).drop("_features", "_scaled")


def fit_groups_per_regime(train: DataFrame, per_regime: int, vector: str = "vector", regime: str = "regime", seed: int = 42) -> DataFrame:
    """Cluster each regime that has enough rows; ids continue from regime to regime, others get 0."""
    sizes = {row[regime]: row["n"] for row in train.groupBy(regime).agg(F.count(F.lit(1)).alias("n")).collect()}
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    ready = train.withColumn("_features", array_to_vector(c(vector)))
    scaled = scaler.fit(ready).transform(ready)
    out, offset = None, 0
    for number in range(5):
        rows = scaled.filter(c(regime) == number)
        size = sizes.get(number, 0)
        if size < max(20, per_regime * 3):
            part = rows.withColumn("group_id", F.lit(0))
        else:
            k = min(per_regime, max(2, size // 50))
            model = KMeans(k=k, featuresCol="_scaled", predictionCol="_local", seed=seed + number, maxIter=50).fit(rows)
            part = model.transform(rows).withColumn("group_id", c("_local") + offset).drop("_local")
            offset += k
        out = part if out is None else out.unionByName(part)
    return out.drop("_features", "_scaled")


def fit_leaves(train: DataFrame, columns: Sequence[str], target: str, max_depth: int = 5, min_rows: int = 50, seed: int = 42) -> PipelineModel:
    """A regression tree whose leaves are the groups; target is the signed best move."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="skip")
    tree = DecisionTreeRegressor(featuresCol="_features", labelCol=target, maxDepth=max_depth, minInstancesPerNode=min_rows, leafCol="leaf", predictionCol="leaf_mean", seed=seed)
    return Pipeline(stages=[vectors, tree]).fit(train.filter(c(target).isNotNull()))


def assign_leaves(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Leaf number of each row; an unseen row falls into exactly one leaf of the tree."""
    return model.transform(rows).withColumn("group_id", c("leaf").cast("int")).drop("_features", "leaf")


def leaf_rules(model: PipelineModel, columns: Sequence[str], spark) -> DataFrame:
    """The path to each leaf as a rule box on the real columns, with the leaf's mean.

    Bounds are inclusive; "greater than t" becomes the next double after t.
    """
    import numpy as np

    boxes, counter = [], [0]

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if node.numDescendants() == 0:
            name = f"leaf-{counter[0]}"
            counter[0] += 1
            boxes.extend((name, column, lo, hi, float(node.prediction()), 1 if node.prediction() >= 0 else -1) for column, (lo, hi) in sorted(bounds.items()))
            return
        column, cut = columns[node.split().featureIndex()], float(node.split().threshold())
        lo, hi = bounds.get(column, (float("-inf"), float("inf")))
        walk(node.leftChild(), {**bounds, column: (lo, min(hi, cut))})
        walk(node.rightChild(), {**bounds, column: (max(lo, float(np.nextafter(cut, np.inf))), hi)})

    walk(model.stages[-1]._call_java("rootNode"), {})
    return spark.createDataFrame(boxes, "rule_id string, column string, lo double, hi double, leaf_mean double, side int")


def relative_shape(width: int) -> Stage:
    """Closes of the `width` bars before, in percent from the first of them."""
    def build(w: WindowSpec) -> dict[str, Column]:
        first = F.lag("close", width).over(w)
        return {"shape": F.array(*[(F.lag("close", k).over(w) - first) / non_zero(first) * 100 for k in range(width, 0, -1)])}
    return build


def _items(a: Column, width: int) -> list[Column]:
    return [F.get(a, F.lit(i)) for i in range(width)]


def _total(items: Sequence[Column]) -> Column:
    """Sum in order, as plain arithmetic: folds over arrays are not compiled."""
    return reduce(lambda p, q: p + q, items)


def _dot(x: Sequence[Column], y: Sequence[Column]) -> Column:
    return _total([p * q for p, q in zip(x, y, strict=True)])


def _spread(x: Sequence[Column], width: int) -> Column:
    return width * _dot(x, x) - _total(x) * _total(x)


def _unit(shape: Column, width: int) -> Column:
    """The shape centred and scaled to length one (NULL if it is level): correlation r means a distance of sqrt(2 - 2 r)."""
    items = _items(shape, width)
    mean = _total(items) / width
    centred = [v - mean for v in items]
    norm = F.sqrt(_dot(centred, centred))
    return F.when(norm > 0, F.array(*[v / norm for v in centred]))


def mean_shapes(usable: DataFrame, group: str, width: int) -> DataFrame:
    """(g, m): the mean shape of each group."""
    means = usable.groupBy(group).agg(*[F.avg(c("shape")[i]).alias(f"m{i}") for i in range(width)])
    return means.select(c(group).alias("g"), F.array(*[f"m{i}" for i in range(width)]).alias("m"))


def shapes_in_reach(usable: DataFrame, means: DataFrame, width: int, least: float, block: int, axes: int = 3) -> tuple[DataFrame, int]:
    """`usable` with `_means`, the groups near enough to correlate by `least`, and the most blocks that a cell has.

    Unit shapes lie in cells as wide as the farthest pair wanted, along the coordinates in which the mean
    shapes spread most.  A cell lists the groups in and around it in blocks of at most `block`; a row meets
    the list of its own cell, and none at all where no group is near.
    """
    reach = math.sqrt(2 * (1 - least)) + 1e-6
    units = means.withColumn("_u", _unit(c("m"), width)).filter("_u IS NOT NULL")
    wide = units.agg(*[F.coalesce(F.stddev_pop(c("_u")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(width)]).first()
    chosen = sorted(range(width), key=lambda i: (-wide[i], i))[: min(axes, width)]
    cell = lambda shift: F.array(*[F.floor(c("_u")[i] / reach).cast("int") + step for i, step in zip(chosen, shift)])
    own = _items(c("m"), width)
    homes = units.select("g", "m", _total(own).alias("s"), _spread(own, width).alias("v"), F.explode(F.array(*[cell(shift) for shift in product((-1, 0, 1), repeat=len(chosen))])).alias("_cell"))
    numbered = homes.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy("_cell").orderBy("g")) - 1) / block))
    table = cut_lineage(numbered.groupBy("_cell", "_block").agg(F.array_sort(F.collect_list(F.struct("g", "m", "s", "v"))).alias("_means")))
    blocks = table.agg(F.coalesce(F.max("_block") + 1, F.lit(1))).first()[0]
    rows = usable.withColumn("_u", _unit(c("shape"), width)).withColumn("_cell", F.when(c("_u").isNotNull(), cell((0,) * len(chosen))))
    return rows.join(table, "_cell", "left").drop("_u", "_cell", "_block"), blocks


def refine_by_shape(
    rows: DataFrame, group: str = "group_id", width: int = 5, least: float = 0.75, block: int = 500,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Move each row to the group whose mean shape it follows best, if the correlation reaches `least` (above 0).

    Mean shapes use all members of a group.  A row is compared with the groups of its cell only (see
    `shapes_in_reach`): a correlation of `least` bounds the distance of shapes scaled to length one.
    Of equal correlations the least group wins; level shapes stay where they are.
    """
    if not 0 < least <= 1:
        raise ValueError("the least correlation must be above 0 and at most 1")
    shaped = over_chunks(rows, relative_shape(width), before=width, keys=keys, idx=idx, chunk=chunk)
    usable = shaped.filter(~F.exists("shape", lambda x: x.isNull()))
    met, blocks = shapes_in_reach(usable, mean_shapes(usable, group, width), width, least, block)
    # What depends on the row or on the group alone is there before the two meet.
    own = _items(c("shape"), width)
    over = lambda x: width * _dot(own, _items(x["m"], width)) - c("_s") * x["s"]
    under = lambda x: c("_v") * x["v"]
    score = lambda x: F.coalesce(F.when(under(x) > 0, over(x) / F.sqrt(under(x))), F.lit(-2.0))
    scored = met.withColumns({"_s": _total(own), "_v": _spread(own, width)}).withColumn(
        "_best", F.array_max(F.transform("_means", lambda x: F.struct(score(x).alias("r"), (-x["g"]).alias("g"))))).drop("_s", "_v")
    if blocks > 1:
        rest = [n for n in usable.columns if n not in (*keys, idx)]
        scored = scored.groupBy(*keys, idx).agg(F.max("_best").alias("_best"), *[F.first(n).alias(n) for n in rest]).withColumn("_means", F.lit(None))
    return scored.withColumn("refined_group", F.when(c("_best.r") >= least, -c("_best.g")).otherwise(c(group))).drop("_best", "_means", "shape")


def fit_win_filter(train: DataFrame, columns: Sequence[str], won: str = "won", seed: int = 42, least: int = 120) -> PipelineModel:
    """Win-probability model on the signal bar's features.

    Raises ValueError under `least` trades, and where all of them won or all lost.
    """
    seen = train.agg(F.count(won).alias("n"), F.min(won).alias("low"), F.max(won).alias("high")).first()
    if seen.n < least:
        raise ValueError(f"only {seen.n} trades to learn from, {least} are needed")
    if seen.low == seen.high:
        raise ValueError("all trades to learn from ended alike")
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol=won, maxDepth=4, maxIter=20, stepSize=0.1, minInstancesPerNode=30, seed=seed)
    return Pipeline(stages=[vectors, trees]).fit(train)


def win_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).withColumn("p_win", vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction")
