"""Out-of-sample checks: folds, deflated Sharpe, overfitting probability, permutation, transfer."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import normal_cdf, normal_quantile
from tickloom.operators.metrics import concentration, drawdowns, gate, headline, period_stability, annualised, profit_factor, validation_checks
from tickloom.operators.scan import with_position
from tickloom.session import cut_lineage

c = F.col


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _roles(
    df: DataFrame, keys: Sequence[str], folds: int, bounds: Callable[[Column, Column], dict[str, Column]],
    role: Callable[[Column], Column],
) -> DataFrame:
    """Copy each row to the folds that use it.

    `bounds(fold, n)` are worked out once per key and fold; `role(bounds)` then only
    compares a row's position with them and is "train", "test" or NULL.
    """
    cuts = F.array(*[F.struct(*[v.cast("long").alias(k) for k, v in bounds(F.lit(k), c("_n")).items()]) for k in range(folds)])
    sized = df.join(_sizes(df, keys).select(*keys, cuts.alias("_cuts")), list(keys))
    named = [role(c("_cuts")[k]) for k in range(folds)]
    uses = F.array_compact(F.array(*[
        F.when(name.isNotNull(), F.struct(F.lit(k + 1).alias("fold"), name.alias("role"))) for k, name in enumerate(named)]))
    return sized.withColumn("_use", F.explode(uses)).select(*df.columns, "_use.fold", "_use.role")


def walk_forward(
    df: DataFrame, folds: int, train_fraction: float = 0.7, embargo: int = 0, anchored: bool = False,
    keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
) -> DataFrame:
    """Rows with their fold and role.  Test windows are laid end to end, the last one takes
    the remainder, and a fold without training rows is left out."""
    if folds < 1 or not 0 < train_fraction < 1 or embargo < 0:
        raise ValueError("need folds >= 1, train_fraction in (0, 1), embargo >= 0")

    def bounds(k: Column, n: Column) -> dict[str, Column]:
        size = F.floor(n / folds)
        start = k * size
        end = F.when(k == folds - 1, n).otherwise(start + size)
        train_end = start - embargo
        length = F.bround((end - start) * (train_fraction / (1 - train_fraction)))
        return {"a": start, "b": end, "ta": F.lit(0) if anchored else F.greatest(F.lit(0), train_end - length), "tb": train_end}

    def role(x: Column) -> Column:
        inside = lambda lo, hi: (c(idx) >= x[lo]) & (c(idx) < x[hi])
        return F.when(x["tb"] > x["ta"], F.when(inside("a", "b"), "test").when(inside("ta", "tb"), "train"))

    return _roles(df, keys, folds, bounds, role)


def split_bounds(k: Column, n: Column, parts: int) -> tuple[Column, Column]:
    """Start and end of part k of n rows cut into `parts`, the first n % parts one longer."""
    base, extra = F.floor(n / parts), n % parts
    start = k * base + F.least(k, extra)
    return start, start + base + F.when(k < extra, 1).otherwise(0)


def part_of(idx: Column, n: Column, parts: int) -> Column:
    """Number of the part a position falls into (the inverse of `split_bounds`)."""
    base, extra = F.floor(n / parts), n % parts
    head = extra * (base + 1)
    return F.when(idx < head, F.floor(idx / (base + 1))).otherwise(extra + F.floor((idx - head) / F.greatest(base, F.lit(1))))


def purged_kfold(
    df: DataFrame, folds: int, embargo: int = 0, keys: Sequence[str] = ("symbol",), idx: str = "bar_idx",
) -> DataFrame:
    """Each row is tested once; training leaves out the test window and `embargo` rows after it."""
    if folds < 2 or embargo < 0:
        raise ValueError("need folds >= 2 and embargo >= 0")

    def role(x: Column) -> Column:
        return F.when((c(idx) >= x["a"]) & (c(idx) < x["b"]), "test").when(~((c(idx) >= x["b"]) & (c(idx) < x["b"] + embargo)), "train")

    return _roles(df, keys, folds, lambda k, n: dict(zip("ab", split_bounds(k, n, folds))), role)


def _add_months(day: date, months: int) -> date:
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month]
    return date(year, month + 1, min(day.day, last))


def calendar_folds(start: date, end: date, train_months: int = 24, test_months: int = 6) -> list[tuple[int, date, date, date]]:
    """(fold, train start, test start, test end), stepping by the test length."""
    out, first = [], start
    while True:
        split = _add_months(first, train_months)
        stop = _add_months(split, test_months)
        if stop > end:
            return out
        out.append((len(out) + 1, first, split, stop))
        first = _add_months(first, test_months)


def calendar_walk_forward(
    ledger: DataFrame, folds: Sequence[tuple[int, date, date, date]], initial_balance: float,
    checks: Mapping[str, Column] | None = None, strategy: str = "strategy_id", time: str = "exit_time",
) -> DataFrame:
    """Choose the best strategy on each training period and gate it on the test period.

    Strategies are the candidates of one search; every trade goes to the folds whose
    periods hold it, so all folds and candidates are scored in one job.
    """
    spans = [s for k, a, b, e in folds for s in ((k, "train", a, b), (k, "test", b, e))]
    table = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(r).alias("role"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, r, a, b in spans])
    day = c(time).cast("date")
    placed = ledger.withColumn("_span", F.explode(F.filter(table, lambda x: (day >= x["a"]) & (day < x["b"])))).select("*", "_span.fold", "_span.role").drop("_span")
    keys = ["fold", "role", strategy]
    metrics = headline(placed, keys)
    for part in (drawdowns(placed, initial_balance, keys), annualised(placed, initial_balance, keys), period_stability(placed, keys).select(*keys, "positive_month_fraction"), concentration(placed, keys)):
        metrics = metrics.join(part, keys)
    metrics = cut_lineage(metrics)
    score = F.coalesce(c("profit_factor"), F.lit(0.0)) * 1000 + c("net_profit") - c("max_drawdown_pct") * 10
    best = metrics.filter("role = 'train'").groupBy("fold").agg(F.max_by(strategy, F.struct(score.alias("s"), c(strategy))).alias(strategy), F.max(score).alias("train_score"))
    tested = best.join(metrics.filter("role = 'test'").drop("role"), ["fold", strategy], "left")
    return gate(tested, checks or validation_checks(30, 1.2, 0.5, 15.0, lower_trades=True), accept="pass")


def pass_rate(gated: DataFrame, least: float, keys: Sequence[str] = ()) -> DataFrame:
    """Share of passed rows (folds, or perturbed parameter sets) and the decision on it."""
    passed = (c("decision") == "pass").cast("int")
    out = gated.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum(passed).alias("pass_count"), F.avg(passed).alias("pass_rate"))
    return out.withColumn("decision", F.when(c("pass_rate") >= least, "pass").otherwise("reject"))


def in_out_of_sample(ledger: DataFrame, oos_fraction: float = 0.3, time: str = "exit_time", keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Tag trades by the share of the whole period that has passed: "is" or "oos"."""
    micros = F.unix_micros(c(time).cast("timestamp"))
    span = ledger.agg(F.min(micros).alias("_a"), F.max(micros).alias("_b"))
    cut = c("_a") + (c("_b") - c("_a")) * (1 - oos_fraction)
    return ledger.join(F.broadcast(span)).withColumn("sample", F.when(micros < cut, "is").otherwise("oos")).drop("_a", "_b")


EULER_GAMMA = 0.5772156649015329


def expected_max_normal(trials: int) -> float:
    """Expected largest of `trials` standard normals (extreme-value approximation)."""
    if trials <= 1:
        return 0.0
    return (1 - EULER_GAMMA) * normal_quantile(1 - 1 / trials) + EULER_GAMMA * normal_quantile(1 - 1 / (trials * math.e))


def deflated_sharpe(returns: DataFrame, value: str, trials: int, keys: Sequence[str] = ("strategy_id",), benchmark: float | None = None) -> DataFrame:
    """Sharpe per period, bias-corrected moments, and the chance that it beats the best of `trials` lucky ones."""
    n = F.count(value).cast("double")
    base = returns.groupBy(*keys).agg(
        n.alias("n_obs"), F.try_divide(F.avg(value), F.stddev_samp(value)).alias("observed_sr"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2")
    ).filter((c("n_obs") >= 2) & c("observed_sr").isNotNull())
    t, sr = c("n_obs"), c("observed_sr")
    skew = F.when(t >= 3, F.sqrt(t * (t - 1)) / (t - 2) * c("_g1")).otherwise(0.0)
    kurt = F.when(t >= 4, (t - 1) / ((t - 2) * (t - 3)) * ((t + 1) * c("_g2") + 6)).otherwise(0.0)
    sr0 = F.lit(benchmark) if benchmark is not None else F.sqrt(1 / t) * expected_max_normal(trials)
    out = base.withColumns({"skew": skew, "kurtosis": kurt, "benchmark_sr": sr0})
    spread = F.greatest(1 - c("skew") * sr + (c("kurtosis") + 2) / 4 * sr * sr, F.lit(1e-12))
    out = out.withColumn("z", (sr - c("benchmark_sr")) * F.sqrt(t - 1) / F.sqrt(spread))
    return out.withColumn("deflated_sr", normal_cdf(c("z"))).withColumn("n_obs", t.cast("long")).drop("_g1", "_g2")


def overfitting_logits(performance: DataFrame, parts: int = 16, config: str = "config_id", period: str = "t_idx", value: str = "perf") -> DataFrame:
    """One row per way of choosing half of the periods' parts: where the winner on that half ranks on the other.

    Each configuration is reduced to one sum and count per part; combinations are bit
    masks, so work is combinations x configurations and never touches single periods again.
    """
    if parts < 2 or parts % 2:
        raise ValueError("parts must be an even number of at least 2")
    length = performance.agg((F.max(period) + 1).alias("_n"))
    placed = performance.join(F.broadcast(length)).withColumn("_part", part_of(c(period), c("_n"), parts))
    filled = placed.groupBy(config, "_part").agg(F.sum(value).alias("s"), F.count(value).alias("k"), F.count(F.lit(1)).alias("rows"))
    means = filled.groupBy(config).agg(F.try_divide(F.sum("s"), F.sum("k")).alias("_mean"))
    whole = filled.join(means, config).filter("_mean IS NOT NULL").withColumn("s", F.coalesce("s", F.lit(0.0)) + (c("rows") - c("k")) * c("_mean"))
    packed = whole.groupBy(config).agg(F.map_from_entries(F.collect_list(F.struct("_part", F.struct("s", "rows")))).alias("_m"))
    masks = [m for m in range(1 << parts) if m.bit_count() == parts // 2]
    batches = [masks[i:i + 512] for i in range(0, len(masks), 512)]
    table = F.array(*[F.array(*[F.lit(m) for m in batch]) for batch in batches])
    spread = packed.withColumn("_batch", F.explode(table)).repartition(config, "_batch").withColumn("mask", F.explode("_batch")).drop("_batch")
    numbers = F.array(*[F.lit(i).cast("long") for i in range(parts)])
    pick = lambda inside, field: F.aggregate(
        F.filter(numbers, lambda i: F.getbit(c("mask"), i) == (1 if inside else 0)), F.lit(0.0),
        lambda acc, i: acc + F.coalesce(c("_m")[i][field].cast("double"), F.lit(0.0)))
    matrix = cut_lineage(spread.select("mask", config, F.try_divide(pick(True, "s"), pick(True, "rows")).alias("_is"), F.try_divide(pick(False, "s"), pick(False, "rows")).alias("_os")))
    champion = matrix.groupBy("mask").agg(F.max("_is").alias("_top")).join(matrix, "mask").filter("_is = _top").groupBy("mask").agg(
        F.min(config).alias("champion"), F.min_by("_os", config).alias("_champion_os"))
    ranked = matrix.join(champion, "mask").groupBy("mask", "champion").agg(
        F.count_if(c("_os") < c("_champion_os")).alias("_below"), F.count_if(c("_os") == c("_champion_os")).alias("_same"), F.count(F.lit(1)).alias("_n"))
    w = (c("_below") + (c("_same") + 1) / 2) / (c("_n") + 1)
    w = F.least(F.greatest(w, F.lit(1e-9)), F.lit(1 - 1e-9))
    return ranked.select("mask", "champion", F.log(w / (1 - w)).alias("logit"))


def overfitting_probability(logits: DataFrame) -> DataFrame:
    return logits.agg(F.count(F.lit(1)).alias("combinations"), F.avg((c("logit") <= 0).cast("int")).alias("pbo"))


def _sign(kind: str, seed: int, parts: Sequence[Column]) -> Column:
    """-1 or +1 per (permutation, block): by hash, or by integer arithmetic that SQL can repeat."""
    perm, block = parts[-2], parts[-1]
    if kind == "hash":
        return F.when(F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2)) == 0, -1.0).otherwise(1.0)
    mixed = (perm * 7919 + block * 104729 + perm * block * 31 + F.lit(seed)) % 1009
    return F.when(mixed % 2 == 0, -1.0).otherwise(1.0)


def sign_permutation(
    trades: DataFrame, permutations: int = 5000, block: int = 5, seed: int = 42, signs: str = "hash",
    keys: Sequence[str] = ("strategy_id",), idx: str = "trade_idx",
) -> DataFrame:
    """Is the net profit more than random signs of whole blocks of gross trades would give?

    Blocks are summed first; each permutation then adds signed block sums, map-side.
    """
    keys = list(keys)
    blocks = trades.groupBy(*keys, F.floor(c(idx) / block).alias("_block")).agg(
        F.sum("gross_pnl").alias("_g"), F.sum(c("commission") + c("swap")).alias("_c"), F.sum("net_pnl").alias("_net"), F.count(F.lit(1)).alias("_n"))
    blocks = cut_lineage(blocks)
    totals = blocks.groupBy(*keys).agg(F.sum("_n").alias("trades"), F.sum("_net").alias("observed_net_profit"), F.sum("_c").alias("_cost"))
    draws = blocks.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    null = draws.groupBy(*keys, "_perm").agg(F.sum(c("_g") * _sign(signs, seed, [*[c(k) for k in keys], c("_perm"), c("_block")])).alias("_v"))
    null = null.join(totals, keys).withColumn("_v", c("_v") - c("_cost"))
    out = null.groupBy(*keys, "trades", "observed_net_profit").agg(
        F.avg("_v").alias("null_mean"), F.stddev_samp("_v").alias("null_std"), F.percentile("_v", F.lit(0.95)).alias("null_p95"),
        ((F.count_if(c("_v") >= c("observed_net_profit")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return out.withColumn("z_score", F.when(c("null_std") > 0, (c("observed_net_profit") - c("null_mean")) / c("null_std")))


def positioned_trades(ledger: DataFrame, keys: Sequence[str] = ("strategy_id",), time: str = "exit_time", tie: str = "trade_id") -> DataFrame:
    return with_position(ledger, [time, tie], keys, time, 86_400, "trade_idx")


def robustness(
    trades: DataFrame, folds: int = 5, permutations: int = 5000, block: int = 5, seed: int = 42, significance: float = 0.05,
    min_positive: float = 0.6, signs: str = "hash", keys: Sequence[str] = ("strategy_id",),
) -> tuple[DataFrame, DataFrame]:
    """(fold report, verdict): chronological folds with their own permutation test, and the gate."""
    keys = list(keys)
    folded = trades.join(_sizes(trades, keys), keys).withColumn("fold", part_of(c("trade_idx"), c("_n"), folds) + 1)
    start, _ = split_bounds(c("fold") - 1, c("_n"), folds)
    folded = cut_lineage(folded.withColumn("trade_idx", c("trade_idx") - start).drop("_n"))
    report = folded.groupBy(*keys, "fold").agg(
        F.min("exit_time").alias("first_exit"), F.max("exit_time").alias("last_exit"), F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_profit"),
        profit_factor(c("net_pnl")).alias("profit_factor"), (100 * F.avg((c("net_pnl") > 0).cast("int"))).alias("win_rate_pct"))
    tests = sign_permutation(folded, permutations, block, seed + 1, signs, [*keys, "fold"])
    report = report.join(tests.select(*keys, "fold", c("p_value").alias("permutation_p_value")), [*keys, "fold"])
    overall = sign_permutation(trades, permutations, block, seed, signs, keys)
    counts = report.groupBy(*keys).agg(
        F.count_if(c("net_profit") > 0).alias("positive_folds"), F.count_if(c("permutation_p_value") <= significance).alias("significant_folds"))
    verdict = gate(overall.join(counts, keys), {
        "overall_permutation_significant": c("p_value") <= significance, "positive_walk_forward_folds": c("positive_folds") >= math.ceil(folds * min_positive),
        "aggregate_net_profit_positive": c("observed_net_profit") > 0}, accept="pass")
    return report, verdict


def transfer(
    per_symbol: DataFrame, symbols: int, min_symbols: int = 2, min_trades: int = 5, rule: str = "rule_id",
) -> DataFrame:
    """Rules whose expectancy is positive on enough symbols, with a score for breadth and evenness.

    `per_symbol(rule, symbol, trades, expectancy_r)`; `symbols` counts all that were tried.
    """
    good = per_symbol.filter((c("trades") >= min_trades) & (c("expectancy_r") > 0))
    out = good.groupBy(rule).agg(
        F.count(F.lit(1)).alias("symbols_passed"), F.avg("expectancy_r").alias("_mean"), F.stddev_pop("expectancy_r").alias("_sd"))
    even = F.when((c("symbols_passed") > 1) & (c("_mean") > 0), 1 / (1 + c("_sd") / c("_mean"))).otherwise(1.0)
    score = c("symbols_passed") / F.lit(symbols) * F.least(c("_mean"), F.lit(1.0)) * even
    return out.filter(c("symbols_passed") >= min_symbols).withColumn("generalization_score", F.round(score, 4)).drop("_mean", "_sd")


# Win-probability cuts that are tried.
THRESHOLDS = [round(0.40 + 0.02 * i, 2) for i in range(16)]


def threshold_metrics(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS, p: str = "p_win", r: str = "rr", keys: Sequence[str] = ()) -> DataFrame:
    """R metrics of the trades kept at each cut."""
    total = F.count(F.lit(1))
    aggregates = [total.alias("_all")]
    for i, t in enumerate(thresholds):
        keep = c(p) >= t
        win, loss = F.sum(F.when(keep & (c(r) > 0), c(r)).otherwise(0.0)), F.sum(F.when(keep & (c(r) <= 0), -c(r)).otherwise(0.0))
        aggregates.append(F.struct(
            F.lit(t).alias("threshold"), F.count_if(keep).alias("kept"), (F.count_if(keep) / total).alias("kept_share"),
            F.when(loss > 0, win / loss).alias("profit_factor"), F.avg(F.when(keep, c(r))).alias("avg_r")).alias(f"_t{i}"))
    return scored.groupBy(*keys).agg(*aggregates).select(*keys, "_all", F.explode(F.array(*[c(f"_t{i}") for i in range(len(thresholds))])).alias("_t")).select(*keys, c("_all").alias("trades"), "_t.*")


def choose_threshold(train_metrics: DataFrame, min_share: float = 0.3, min_kept: int = 40, keys: Sequence[str] = ()) -> DataFrame:
    """The cut with the best training profit factor among those that keep enough; lower on a tie."""
    allowed = train_metrics.filter((c("kept") >= F.greatest(F.lit(min_kept), c("trades") * min_share)) & c("profit_factor").isNotNull())
    return allowed.groupBy(*keys).agg(F.max_by("threshold", F.struct("profit_factor", -c("threshold"))).alias("threshold"), F.max("profit_factor").alias("train_profit_factor"))
