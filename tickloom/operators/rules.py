"""Rule boxes: enumeration, matching, scoring, sides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.extremes import build_levels, resolve
from tickloom.operators.outcomes import book_r, forward_path, free_after_cooldown, free_after_signal_cooldown, non_overlapping, priced_entries, touch
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.rule_index import match_by_bitmaps
from tickloom.operators.scan import CHUNK, over_chunks
from tickloom.schema import require_columns
from tickloom.session import cut_lineage, spread

c = F.col
COMPILED_RULES = 256
#: Rules whose trade parameters are broadcast.
BROADCAST_RULES = 1_000_000


def stacked(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide to long: one row per kept key and column."""
    pairs = ", ".join(f"'{name}', CAST(`{name}` AS DOUBLE)" for name in columns)
    return df.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) AS (column, value)"))


def column_ranges(
    frame: DataFrame, columns: Sequence[str], group: str | None = None, quantiles: Sequence[float] = (0.05, 0.95),
) -> DataFrame:
    """The usual range of each column within a group: where boxes are searched."""
    keys = ([group] if group else [])
    long = stacked(frame, columns, keys).filter("value IS NOT NULL")
    return exact_quantiles(long, [*keys, "column"], {"lo": ("value", quantiles[0]), "hi": ("value", quantiles[1])}).select(*keys, "column", "lo", "hi")


def enumerate_boxes(
    ranges: DataFrame, boxes: int, seed: int = 1, least: int = 3, most: int = 7, min_width: float = 0.05,
    group: str | None = None,
) -> DataFrame:
    """`boxes` sparse boxes per group, drawn by hash, so the same seed gives the same rules anywhere.

    Each box takes `least` to `most` columns (those with the smallest hash) and a
    sub-interval of the column's range at least `min_width` of it wide.
    """
    keys = [group] if group else []
    unit = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_000_007)) / 1_000_000_007.0
    numbers = F.sequence(F.lit(0), F.lit(boxes - 1)).cast("array<bigint>")
    grid = spread(ranges, *keys, "column").withColumn("box", F.explode(numbers))
    per_box = Window.partitionBy(*keys, "box").orderBy(F.xxhash64(F.lit(seed), c("box"), c("column")), "column")
    wanted = least + F.floor(unit(c("box"), F.lit("size")) * (most - least + 1))
    low, high = unit(c("box"), c("column"), F.lit("a")), unit(c("box"), c("column"), F.lit("b"))
    a = F.least(low, high) * (1 - min_width)
    b = F.least(F.greatest(F.greatest(low, high), a + min_width), F.lit(1.0))
    picked = grid.withColumn("_rank", F.row_number().over(per_box)).filter(c("_rank") <= wanted)
    prefix = F.concat(c(group).cast("string"), F.lit("-")) if group else F.lit("")
    return picked.select(
        F.concat(prefix, F.lit("box-"), c("box").cast("string")).alias("rule_id"), *keys, "column",
        (c("lo") + a * (c("hi") - c("lo"))).alias("lo"), (c("lo") + b * (c("hi") - c("lo"))).alias("hi"))


def snap_bounds(rules: DataFrame, discrete: Sequence[str]) -> DataFrame:
    """Round the bounds of whole-number columns inward; the matches stay the same."""
    whole = c("column").isin(*discrete)
    return rules.withColumns({
        "lo": F.when(whole, F.ceil("lo").cast("double")).otherwise(c("lo")),
        "hi": F.when(whole, F.floor("hi").cast("double")).otherwise(c("hi"))})


def mirror_rules(rules: DataFrame) -> DataFrame:
    """The same boxes seen from the other side of the market."""
    centre = F.when(c("column").isin("trend", "macd_norm"), 0.0).when(c("column") == "bull", 1.0).when(c("column") == "rsi14", 100.0)
    return rules.withColumn("_c", centre).withColumns({
        "lo": F.when(c("_c").isNotNull(), c("_c") - c("hi")).otherwise(c("lo")),
        "hi": F.when(c("_c").isNotNull(), c("_c") - c("lo")).otherwise(c("hi"))}).drop("_c")


def unknown_columns(rules: DataFrame, frame: DataFrame) -> DataFrame:
    """Conditions a table cannot answer, and whether they are all a rule has."""
    known = F.coalesce(c("column").isin(*frame.columns), F.lit(False))
    return rules.groupBy("rule_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(~known, c("column")))), ",").alias("missing_columns"),
        F.every(~known).alias("unusable"))


def match_rules(
    frame: DataFrame, rules: DataFrame, compile_limit: int = COMPILED_RULES, exclusive: Sequence[str] = (),
) -> DataFrame:
    """Every (row, rule) pair whose conditions all hold; adds `rule_id` to the row.

    Up to `compile_limit` rules become one generated expression per row, with no join.
    More rules meet the rows through an index of bitmaps, in one pass and without a join.
    Unknown columns are skipped; a rule made only of them matches nothing.
    """
    require_columns(rules, ["rule_id", "column", "lo", "hi"], "rules")
    usable = rules.filter(c("column").isin(*frame.columns))
    packed = usable.groupBy("rule_id").agg(F.collect_list(F.struct("column", "lo", "hi")).alias("conditions"))
    small = packed.limit(compile_limit + 1).collect()
    if len(small) <= compile_limit:
        if not small:
            return frame.withColumn("rule_id", F.lit("")).limit(0)
        tests = []
        for row in sorted(small, key=lambda item: item.rule_id):
            inside = reduce(lambda a, b: a & b, [c(x["column"]).between(x["lo"], x["hi"]) for x in row.conditions])
            tests.append(F.when(inside, F.lit(row.rule_id)))
        return frame.withColumn("rule_id", F.explode(F.array_compact(F.array(*tests))))
    return match_by_bitmaps(frame, usable)


def match_counts(frame: DataFrame, rules: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Cheap first pass: how often each rule fires, as count and share of all rows."""
    columns = [row["column"] for row in rules.select("column").distinct().collect()]
    slim = frame.select(*[n for n in columns if n in frame.columns])
    total = frame.agg(F.count(F.lit(1)).alias("rows"))
    counts = match_rules(slim, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matched"))
    everything = rules.select("rule_id").distinct().join(counts, "rule_id", "left").fillna(0, subset=["matched"])
    return everything.join(F.broadcast(total)).withColumn("match_share", c("matched") / c("rows")).drop("rows")


def guard(counts: DataFrame, max_share: float = 0.25, min_share: float = 0.0) -> DataFrame:
    """Rules neither too loose nor too rare, before any outcome is computed."""
    return counts.filter((c("match_share") <= max_share) & (c("match_share") >= min_share) & (c("matched") > 0))


def inflation(all_counts: DataFrame, gated_counts: DataFrame) -> DataFrame:
    """How much more often a box fires on all rows than inside its own group."""
    return all_counts.select("rule_id", c("matched").alias("fires")).join(
        gated_counts.select("rule_id", c("matched").alias("gated_fires")), "rule_id").withColumn(
        "inflation", c("fires") / F.when(c("gated_fires") > 0, c("gated_fires")))


def with_paths(
    frame: DataFrame, max_hold: int, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Add the next open and the forward path; the last bar, which cannot enter, drops out."""
    return over_chunks(
        frame, lambda w: {"next_open": F.lead("open").over(w), "path": forward_path(w, max_hold)}, after=max_hold,
        keys=keys, idx=idx, chunk=chunk).filter(c("next_open").isNotNull())


def rule_trades(
    frame: DataFrame, rules: DataFrame, parameters: DataFrame, max_hold: int = 32, spread: float = 0.3, cooldown: int = 4,
    commission_r: float = 0.0, swap_r: float = 0.0, snapshot: Sequence[str] = (), allowed_sessions: Sequence[int] = (),
    acceptance: str = "exit", keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """The accepted trades of every rule on every symbol.

    `parameters(rule_id, direction, sl_pct, tp_pct)`; `snapshot` columns of the signal bar
    travel with the trade; `acceptance` is "exit" or "signal" (cross-symbol preset).  A column
    `max_hold` in `parameters` replaces the argument rule by rule.  Only matched bars are priced, and
    their exits are found through cells of extremes, whatever the hold.
    """
    columns = sorted({row["column"] for row in rules.select("column").distinct().collect()} & set(frame.columns))
    kept = dict.fromkeys([*keys, idx, "time", "open", "high", "low", "close", *snapshot, *columns, *(["session"] if allowed_sessions else [])])
    rows = over_chunks(frame.select(*kept), lambda w: {"next_open": F.lead("open").over(w)}, after=1, keys=keys, idx=idx, chunk=chunk, keep=c("next_open").isNotNull())
    if allowed_sessions:
        rows = rows.filter(c("session").isin(*allowed_sessions))
    matched = match_rules(rows, rules)
    # One row per rule: unhinted, all signals are dealt to as many tasks as there are rules.
    parameters = F.broadcast(parameters) if parameters.count() <= BROADCAST_RULES else parameters
    slim = matched.select(*keys, idx, "time", "rule_id", "next_open", *snapshot).join(parameters, "rule_id")
    priced = lambda rows: priced_entries(rows, spread, c("sl_pct"), c("tp_pct"), c("direction") == "LONG")
    levels = build_levels(frame, {"l": c("low")}, {"h": c("high")}, ["close"], keys, idx)
    own = "max_hold" in parameters.columns
    reach = parameters.agg(F.max("max_hold")).first()[0] or 1 if own else max_hold
    hold = (c("max_hold") if own else F.lit(max_hold)).cast("long")
    # Prices follow from the parameters and the next open: the search takes only what it reads, they are made again after it.
    kept = [n for n in slim.columns if n == "rule_id" or n not in parameters.columns]
    sought = priced(slim).select(*kept, *(["max_hold"] if own else []), "side", "stop_level", "target_level")
    found = resolve(sought, levels, "stop_level", "target_level", "side", hold, idx, reach=reach).select(*kept, "_hit")
    # The choice writes its rows: it takes what cannot be made again, and the accepted ones are booked after it.
    ends = found.withColumns({"outcome": c("_hit.outcome"), "entry_idx": c(idx) + 1, "exit_idx": c(idx) + c("_hit.held")})
    free = free_after_cooldown(cooldown) if acceptance == "exit" else free_after_signal_cooldown(cooldown)
    accepted = non_overlapping(ends.withColumn("_free_at", free).drop("outcome", "exit_idx"), ["rule_id", *keys], c("_free_at"))
    return book_r(priced(accepted.drop("_free_at", "entry_idx").join(parameters, "rule_id")), spread, commission_r, swap_r, idx)


def both_sides(
    frame: DataFrame, group: str, sizes: DataFrame, horizon: int, min_rate: float = 52.0, min_trades: int = 15,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx", chunk: int = CHUNK,
) -> DataFrame:
    """Resolve each bar long and short with its group's sizes; here the target wins a tie."""
    rows = with_paths(frame.select(*keys, idx, "open", "high", "low", "close", group), horizon, keys, idx, chunk)
    rows = rows.filter(c("next_open") != 0).join(sizes.select(group, "sl_pct", "tp_pct"), group)
    entry = c("next_open")
    long = touch(c("path"), entry * (1 - c("sl_pct")), entry * (1 + c("tp_pct")), F.lit(1), horizon, tie="target")["outcome"]
    short = touch(c("path"), entry * (1 + c("sl_pct")), entry * (1 - c("tp_pct")), F.lit(-1), horizon, tie="target")["outcome"]
    return rows.select(*keys, idx, group, long.alias("long_outcome"), short.alias("short_outcome"))


def side_modes(resolved: DataFrame, group: str, min_rate: float = 52.0, min_trades: int = 15) -> DataFrame:
    """LONG_ONLY, SHORT_ONLY or BIDIRECTIONAL per group from the win rates of both sides."""
    rates = {}
    for side in ("long", "short"):
        wins = F.count_if(c(f"{side}_outcome") == "target")
        total = F.count_if(c(f"{side}_outcome") != "timeout")
        rates[f"{side}_trades"] = total
        rates[f"{side}_wr"] = F.when(total > 0, F.round(wins / total * 100, 1)).otherwise(0.0)
    out = resolved.groupBy(group).agg(*[value.alias(name) for name, value in rates.items()])
    good = {s: (c(f"{s}_wr") >= min_rate) & (c(f"{s}_trades") >= min_trades) for s in ("long", "short")}
    return out.withColumn("mode", F.when(good["long"] & good["short"], "BIDIRECTIONAL").when(good["long"], "LONG_ONLY")
                          .when(good["short"], "SHORT_ONLY").when(c("long_wr") >= c("short_wr"), "LONG_ONLY").otherwise("SHORT_ONLY"))


def fit_discriminator(
    resolved: DataFrame, frame: DataFrame, group: str, columns: Sequence[str], min_accuracy: float = 0.62, min_rows: int = 20,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
) -> DataFrame:
    """Per group, the column and threshold that best tell bars where only one side won."""
    decided = resolved.withColumn("_long", F.when((c("long_outcome") == "target") & (c("short_outcome") == "stop"), 1).when(
        (c("long_outcome") == "stop") & (c("short_outcome") == "target"), 0)).filter("_long IS NOT NULL")
    # Counts, quantiles and accuracies all read these rows: written once, or each would resolve both sides again.
    slim = frame.select(*keys, idx, *columns)
    rows = cut_lineage(decided.select(*keys, idx, group, "_long").join(slim, [*keys, idx]).select(group, "_long", *columns))
    values = stacked(rows, columns, [group, "_long"]).filter("value IS NOT NULL")
    levels = [p / 100 for p in range(20, 85, 5)]
    counts = values.groupBy(group, "column").agg(F.count(F.lit(1)).alias("n_bars")).filter(c("n_bars") >= min_rows)
    cuts = exact_quantiles(values, [group, "column"], {f"_q{i}": ("value", x) for i, x in enumerate(levels)})
    limits = counts.join(cuts, [group, "column"]).select(group, "column", "n_bars", F.array(*[f"_q{i}" for i in range(len(levels))]).alias("_q"))
    grid = limits.select(group, "column", "n_bars", F.posexplode("_q").alias("_step", "thresh"))
    # Accuracy of all thresholds from one count per (threshold, label): 13 thresholds ride in an array.
    counted = values.join(limits, [group, "column"]).select(
        group, "column", "_long", F.transform("_q", lambda t: (c("value") >= t).cast("long")).alias("_above"))
    sums = counted.groupBy(group, "column").agg(*[
        F.avg(F.when(c("_above")[i] == c("_long"), 1.0).otherwise(0.0)).alias(f"_a{i}") for i in range(len(levels))])
    accuracy = sums.select(group, "column", F.posexplode(F.array(*[c(f"_a{i}") for i in range(len(levels))])).alias("_step", "_acc"))
    order = F.element_at(F.create_map(*[x for i, n in enumerate(columns) for x in (F.lit(n), F.lit(-i))]), c("column"))
    sided = grid.join(accuracy, [group, "column", "_step"]).withColumn("dir", F.explode(F.array(F.lit("above"), F.lit("below"))))
    sided = sided.withColumn("accuracy", F.when(c("dir") == "above", c("_acc")).otherwise(1 - c("_acc"))).filter(c("accuracy") > min_accuracy)
    rank = F.struct(F.round("accuracy", 12), order, -c("_step"), (c("dir") == "above").cast("int"))
    best = sided.groupBy(group).agg(F.max_by(F.struct("column", "thresh", "dir", "accuracy", "n_bars"), rank).alias("_b"))
    return best.select(group, "_b.*")


def fit_tree_discriminator(resolved: DataFrame, frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), idx: str = "bar_idx"):
    """Fallback when no single threshold will do: a depth-2 tree on the decided bars of one group."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    decided = resolved.withColumn("label", F.when((c("long_outcome") == "target") & (c("short_outcome") == "stop"), 1.0).when(
        (c("long_outcome") == "stop") & (c("short_outcome") == "target"), 0.0)).filter("label IS NOT NULL")
    # The tree passes over its rows several times.
    rows = cut_lineage(decided.select(*keys, idx, "label").join(frame, [*keys, idx]).select("label", *columns))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(rows)
    return DecisionTreeClassifier(maxDepth=2, minInstancesPerNode=5, seed=42).fit(vectors.select("label", "features"))


def fit_group_trees(
    resolved: DataFrame, frame: DataFrame, group: str, columns: Sequence[str], bins: int = 16, min_rows: int = 30, min_leaf: int = 5, min_accuracy: float = 0.62,
    depth: int = 2, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
) -> DataFrame:
    """A small decision tree per group, for all groups in one pass per level.

    The rows are bars where only one side won.  Thresholds are the inner `bins` quantiles of a column in
    its group; each level counts (group, node, column, bin) histograms and takes the split of least Gini impurity
    with `min_leaf` rows on either side (ties: earlier column, lower threshold).  Groups need `min_rows` rows
    and the finished tree `min_accuracy` on them.  Rows with a missing value are left out.

    Returns group, `n_bars`, `accuracy`, `splits` (node, column, thresh; rows at or below it go to node 2n+1, the rest
    to 2n+2) and `leaves` (node, long, n_bars).
    """
    if len(columns) < 2:
        raise ValueError("a tree needs two columns at least")
    won = F.when((c("long_outcome") == "target") & (c("short_outcome") == "stop"), 1).when((c("long_outcome") == "stop") & (c("short_outcome") == "target"), 0)
    decided = resolved.select(*keys, idx, group, won.alias("_long")).filter("_long IS NOT NULL")
    rows = decided.join(frame.select(*keys, idx, *[c(n).cast("double").alias(n) for n in columns]), [*keys, idx]).na.drop(subset=list(columns))
    rows = rows.select(group, "_long", *columns, F.lit(0).alias("_node"))
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_bars")).filter(c("n_bars") >= min_rows)
    rows = cut_lineage(rows.join(large.select(group), group, "left_semi"))
    names = [f"_q{i}" for i in range(1, bins)]
    cuts = exact_quantiles(stacked(rows, columns, [group]), [group, "column"], {n: ("value", (i + 1) / bins) for i, n in enumerate(names)})
    cuts = cut_lineage(cuts.select(group, "column", F.array(*names).alias("_cuts")))
    place = F.element_at(F.create_map(*[x for i, n in enumerate(columns) for x in (F.lit(n), F.lit(i))]), c("column"))
    splits = None
    for _ in range(depth):
        binned = stacked(rows, columns, [group, "_node", "_long"]).join(cuts, [group, "column"])
        counts = binned.select(group, "_node", "column", "_long", "_cuts", F.size(F.filter("_cuts", lambda x: x < c("value"))).alias("_bin")).groupBy(group, "_node", "column", "_bin").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_long").alias("_p"), F.first("_cuts").alias("_cuts"))
        own = Window.partitionBy(group, "_node", "column")
        upto = own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        sides = counts.withColumns({"nl": F.sum("_n").over(upto), "pl": F.sum("_p").over(upto), "n": F.sum("_n").over(own), "p": F.sum("_p").over(own)})
        mixed = lambda p, n: 2 * p * (n - p) / n
        able = (c("nl") >= min_leaf) & (c("n") - c("nl") >= min_leaf) & (c("p") > 0) & (c("p") < c("n")) & (c("_bin") < bins - 1)
        gini = mixed(c("pl"), c("nl")) + mixed(c("p") - c("pl"), c("n") - c("nl"))
        rank = F.struct(F.round(gini, 9).alias("gini"), place.alias("place"), "_bin", "column", F.get("_cuts", c("_bin")).alias("thresh"))
        best = cut_lineage(sides.filter(able).groupBy(group, "_node").agg(F.min(rank).alias("_b")).select(group, "_node", c("_b.column").alias("column"), c("_b.thresh").alias("thresh")))
        value = F.element_at(F.create_map(*[x for n in columns for x in (F.lit(n), c(n))]), c("column"))
        side = F.when(c("column").isNull(), c("_node")).when(value <= c("thresh"), 2 * c("_node") + 1).otherwise(2 * c("_node") + 2)
        rows = rows.join(best, [group, "_node"], "left").withColumn("_node", side).select(group, "_long", *columns, "_node")
        splits = best if splits is None else splits.unionByName(best)
    leaves = rows.groupBy(group, "_node").agg(F.count(F.lit(1)).alias("_n"), F.sum("_long").alias("_p"))
    leaf = F.struct(c("_node").alias("node"), (2 * c("_p") > c("_n")).alias("long"), c("_n").alias("n_bars"))
    out = leaves.groupBy(group).agg(F.sum("_n").alias("n_bars"), (F.sum(F.greatest(c("_p"), c("_n") - c("_p"))) / F.sum("_n")).alias("accuracy"), F.array_sort(F.collect_list(leaf)).alias("leaves"))
    trees = splits.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(c("_node").alias("node"), "column", "thresh"))).alias("splits"))
    return out.filter(c("accuracy") >= min_accuracy).join(trees, group).select(group, "n_bars", "accuracy", "splits", "leaves")


def expand_grid(base: DataFrame, family: str, axes: dict[str, Sequence]) -> DataFrame:
    """All parameter combinations of a signal family for each row of `base` (a symbol, say),
    with canonical JSON and a stable id."""
    out = base.withColumn("lineage", F.lit(family))
    for name in sorted(axes):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in axes[name]])))
    parameters = F.struct(*[c(n) for n in sorted(axes)])
    canonical = F.to_json(F.struct("lineage", parameters.alias("parameters")))
    return out.withColumns({
        "parameters": F.to_json(parameters), "fingerprint": F.sha2(canonical, 256),
        "strategy_id": F.concat_ws("_", "lineage", F.substring(F.sha1(canonical), 1, 12))})


def with_common_filters(grid: DataFrame, directions: Sequence[str], sessions: Sequence[tuple[str, int, int]], volatility: Sequence[str]) -> DataFrame:
    """Cross base parameter sets with direction mode, volatility filter and UTC session window."""
    windows = F.array(*[F.struct(F.lit(n).alias("session_name"), F.lit(a).alias("session_start_utc"), F.lit(b).alias("session_end_utc")) for n, a, b in sessions])
    return grid.withColumns({
        "direction_mode": F.explode(F.array(*[F.lit(x) for x in directions]))}).withColumn(
        "volatility_filter", F.explode(F.array(*[F.lit(x) for x in volatility]))).withColumn("_s", F.explode(windows)).select("*", "_s.*").drop("_s")
