"""Partitioned storage of ticks, bars and ledgers, and what is known about it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def write_ticks(ticks: DataFrame, folder: str) -> None:
    """Zstd Parquet by symbol and day; a re-imported day replaces only itself.

    Rows are spread by (symbol, day, hour) so that one busy day is not one task.
    """
    placed = ticks.withColumns({"day": F.to_date("time"), "_hour": F.hour("time")}).repartition("symbol", "day", "_hour").drop("_hour")
    placed.sortWithinPartitions("symbol", "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "symbol", "day").option("compression", "zstd").parquet(folder)


def write_bars(bars: DataFrame, folder: str) -> None:
    """Zstd Parquet by symbol, timeframe and month."""
    placed = bars.withColumn("month", F.date_format("time", "yyyy-MM")).repartition("symbol", "timeframe", "month")
    placed.sortWithinPartitions("time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "symbol", "timeframe", "month").option("compression", "zstd").parquet(folder)


def read_range(spark: SparkSession, folder: str, start: str, end: str, symbols: Sequence[str] | None = None, timeframe: str | None = None) -> DataFrame:
    """Rows with start <= time < end; month, day, symbol and timeframe prune folders."""
    table = spark.read.parquet(folder)
    rows = table.filter((c("time") >= F.lit(start).cast(table.schema["time"].dataType)) & (c("time") < F.lit(end).cast(table.schema["time"].dataType)))
    if "month" in table.columns:
        rows = rows.filter(c("month").between(start[:7], end[:7]))
    if "day" in table.columns:
        rows = rows.filter(c("day").between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date")))
    if symbols:
        rows = rows.filter(c("symbol").isin(*symbols))
    return rows.filter(c("timeframe") == timeframe) if timeframe else rows


def export_flat(bars: DataFrame, folder: str) -> None:
    """Six-column bars as CSV, one folder per symbol and timeframe."""
    from tickloom.operators.bars import flat_bars
    flat_bars(bars).write.mode("overwrite").partitionBy("symbol", "timeframe").option("header", True).csv(folder)


def manifest(df: DataFrame, keys: Sequence[str] = ("symbol",), time: str = "time", per_file: bool = False) -> DataFrame:
    """Rows, first and last time and a content fingerprint per key (and file).

    The fingerprint is two sums of independent row hashes: the order and the files of the
    rows do not matter, but how often a row occurs does.
    """
    names = [c(f"`{n}`") for n in sorted(df.columns) if n != "_metadata"]
    base = df.select("*", c("_metadata.file_path").alias("file")) if per_file else df
    total = lambda h: F.lower(F.hex(F.pmod(F.sum(h.cast("decimal(38,0)")), F.lit(1 << 62).cast("decimal(38,0)")).cast("long")))
    printed = F.concat_ws("-", total(F.xxhash64(*names)), total(F.xxhash64(F.lit("second"), *reversed(names))))
    return base.groupBy(*keys, *(["file"] if per_file else [])).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), printed.alias("fingerprint"))


def pending_days(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested (symbol, day) pairs that the finished ones do not hold."""
    return requested.join(done.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")


def write_ledger(ledger: DataFrame, folder: str, key: str = "strategy_id") -> None:
    """Closed trades as Parquet by strategy, and once more as CSV."""
    ledger.write.mode("overwrite").partitionBy(key).option("compression", "zstd").parquet(f"{folder}/parquet")
    ledger.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def combined_trades(parts: Mapping[str, DataFrame], time: str = "exit_time") -> DataFrame:
    """Trades of several runs in one table, tagged and in time order."""
    tagged = [df.withColumn("seed", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).orderBy(time, "seed")
