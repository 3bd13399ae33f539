"""Exact quantiles that no task has to hold all values for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

c = F.col
#: Rank accuracy of the approximate pass; groups of up to so many rows are bracketed whole.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], accuracy: int = ACCURACY) -> DataFrame:
    """One row per key with a linear-interpolated quantile per name; `wanted` maps a name to (column, share).

    An approximate pass brackets the two ranks that a quantile lies between; the second pass
    counts what is below the bracket and the distinct values inside, and picks the ranks there.
    A bracket spans about four ranks in `accuracy`, so a task holds that share of a group's
    values and not all of them.  NULLs do not count; a group without values has NULL.
    """
    keys, names = list(keys), list(wanted)
    pairs = ", ".join(f"'{name}', CAST(`{column}` AS DOUBLE)" for name, (column, _) in wanted.items())
    long = df.select(*keys, F.expr(f"stack({len(names)}, {pairs}) AS (_name, _v)"))
    share = F.element_at(F.create_map(*[x for name in names for x in (F.lit(name), F.lit(float(wanted[name][1])))]), c("_name"))
    values = long.filter("_v IS NOT NULL")
    step = 2.0 / accuracy
    near = {name: [max(0.0, wanted[name][1] - step), min(1.0, wanted[name][1] + step)] for name in names}
    grid = sorted({x for pair in near.values() for x in pair})
    place = F.create_map(*[x for name in names for x in (F.lit(name), F.array(*[F.lit(grid.index(v)) for v in near[name]]))])
    rough = values.groupBy(*keys, "_name").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", grid, accuracy).alias("_g"))
    at = lambda i: F.get("_g", F.element_at(place, c("_name"))[i])
    brackets = rough.select(
        *keys, "_name", "_n", F.when(c("_n") <= accuracy, c("_min")).otherwise(at(0)).alias("_lo"), F.when(c("_n") <= accuracy, c("_max")).otherwise(at(1)).alias("_hi"))
    # Written, the brackets show their true size: guessed, they look larger than the values, which Spark would then broadcast.
    met = values.join(cut_lineage(brackets), [*keys, "_name"])
    inside = met.filter(c("_v").between(c("_lo"), c("_hi"))).groupBy(*keys, "_name", "_v").agg(F.count(F.lit(1)).alias("_k"))
    below = met.groupBy(*keys, "_name").agg(F.count_if(c("_v") < c("_lo")).alias("_below"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.sum("_k").over(upto)).join(below, [*keys, "_name"])
    rank = share * (c("_n") - 1)
    picked = ranked.groupBy(*keys, "_name").agg(
        F.min(F.when(c("_below") + c("_upto") > F.floor(rank), c("_v"))).alias("_a"), F.min(F.when(c("_below") + c("_upto") > F.ceil(rank), c("_v"))).alias("_b"), F.first(rank - F.floor(rank)).alias("_f"))
    value = c("_a") + (c("_b") - c("_a")) * c("_f")
    wide = picked.groupBy(*keys).agg(*[F.max(F.when(c("_name") == name, value)).alias(name) for name in names])
    return df.select(*keys).distinct().join(wide, keys, "left") if keys else wide
