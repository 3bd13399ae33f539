"""Bar, trade and external tables from delimited files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import mid_as_bid_ask
from tickloom.schema import require_columns

c = F.col

# Header names that mean the time and the volume of a bar.
TIME_NAMES = ["time", "date", "datetime", "timestamp"]
VOLUME_NAMES = ["tick_volume", "volume", "vol"]
FILE_NAME = r"(?i)^([a-z0-9]+)_([a-z]+\d*)\.csv$"


def lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def number(text: Column) -> Column:
    """Double from text; NULL where it is none."""
    return text.try_cast("double")


def file_symbol(name: Column) -> tuple[Column, Column]:
    """Symbol (upper case) and timeframe (lower case) from `<symbol>_<timeframe>.csv`; NULL otherwise."""
    found = name.rlike(FILE_NAME)
    return (F.when(found, F.upper(F.regexp_extract(name, FILE_NAME, 1))), F.when(found, F.lower(F.regexp_extract(name, FILE_NAME, 2))))


#: A comma outside quotation marks.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """Fields of a delimited line, without outer blanks and quotation marks."""
    return F.transform(F.split(line, _COMMA), lambda x: F.trim(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1")))


def read_bar_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All bar files in one scan: symbol, timeframe, time, prices and volume (NULL where a file has none).

    Each file's own header names its columns, so files may differ in the order, the case and
    the presence of columns.  Headers are one short row per file and meet the lines in a join
    on the file; a file without the four prices in a header line raises when it is read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.text(paths)
    folders = [n for n in ("symbol", "timeframe") if n in text.columns]
    lines = text.select("value", *folders, c("_metadata.file_path").alias("_path"), c("_metadata.file_name").alias("_file")).filter(F.trim("value") != "")
    names = F.transform(_cells(F.regexp_replace("value", "^\ufeff", "")), lambda x: F.lower(x))
    prices = ["open", "high", "low", "close"]
    is_head = F.forall(F.array(*[F.lit(n) for n in prices]), lambda n: F.array_contains("_names", n))
    split = lines.withColumn("_names", names).withColumn("_head", is_head)
    heads = split.groupBy("_path").agg(F.first(F.when(c("_head"), c("_names")), ignorenulls=True).alias("_header"))
    rows = split.filter("NOT _head").select("value", *folders, "_path", "_file").join(heads, "_path")
    header = F.when(c("_header").isNull(), F.raise_error(F.concat(F.lit("no header with open, high, low and close in "), c("_path")))).otherwise(c("_header"))
    rows = rows.select("_file", *folders, _cells(c("value")).alias("_cells"), header.alias("_header"))
    first = lambda wanted: F.filter("_header", lambda x: x.isin(*wanted))

    def cell(name: Column) -> Column:
        place = F.array_position("_header", name)
        return F.when(place > 0, F.get("_cells", (place - 1).cast("int")))

    time = F.coalesce(F.get(first(TIME_NAMES), F.lit(0)), F.get("_header", F.lit(0)))
    volume = F.coalesce(*[F.when(F.array_contains("_header", n), F.lit(n)) for n in VOLUME_NAMES])
    named = dict(zip(("symbol", "timeframe"), file_symbol(c("_file"))))
    told = lambda n: F.coalesce(cell(F.lit(n)), c(n).cast("string") if n in folders else named[n]).alias(n)
    return rows.select(
        told("symbol"), told("timeframe"), cell(time).try_cast("timestamp_ntz").alias("time"),
        *[number(cell(F.lit(n))).alias(n) for n in prices], number(cell(volume)).alias("volume"))


def bars_from_text(raw: DataFrame) -> DataFrame:
    """Resolve the column aliases of a lower-cased text table and cast it."""
    require_columns(raw, ["open", "high", "low", "close"], "bar file")
    columns = [n for n in raw.columns if n != "_file"]
    time = next((n for n in columns if n in TIME_NAMES), columns[0])
    volume = next((n for n in VOLUME_NAMES if n in columns), None)
    symbol, timeframe = file_symbol(c("_file")) if "_file" in raw.columns else (F.lit(None).cast("string"),) * 2
    symbol = c("symbol") if "symbol" in columns else symbol
    timeframe = c("timeframe") if "timeframe" in columns else timeframe
    return raw.select(
        symbol.alias("symbol"), timeframe.alias("timeframe"), c(time).try_cast("timestamp_ntz").alias("time"),
        *[number(c(n)).alias(n) for n in ("open", "high", "low", "close")], *([number(c(volume)).alias("volume")] if volume else []))


def timeframe_slot(bars: DataFrame, timeframe: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """One slot of the partitioned bar table; both filters prune partitions."""
    out = bars.filter(c("timeframe") == timeframe)
    return out.filter(c("symbol").isin(*symbols)) if symbols else out


def money(text: Column) -> Column:
    """Currency text to a number: signs, thousands commas, percent and accounting brackets."""
    plain = F.regexp_replace(text, r"[$%,\s]", "")
    return number(F.regexp_replace(plain, r"^\((.+)\)$", "-$1"))


def snake(name: str) -> str:
    out = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in name.strip().lower())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")


# Exported trade-list headers (after snake-casing) and what they are.
TRADE_NAMES = {"net_p_l_usd": "profit", "net_p_l": "profit_pct", "profit_usd": "profit", "date_and_time": "date", "date_time": "date"}


def chart_trades(raw: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """Closed trades of a chart platform's trade list: exit rows with the entry time before them.

    `order` gives the file order of rows and `keys` name the file; a file is one list, and
    lists are read side by side.
    """
    if not keys:
        raise ValueError("name the columns that tell one trade list from another")
    renamed = raw.toDF(*[name if name in (*keys, order) else TRADE_NAMES.get(snake(name), snake(name)) for name in raw.columns])
    require_columns(renamed, ["type", "date", "profit"], "trade list")
    kind = F.lower("type")
    leaves = kind.rlike("exit|close|sell|cover")
    enters = kind.rlike("entry|buy|long|short") & ~leaves
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    when = c("date").try_cast("timestamp_ntz")
    out = renamed.withColumn("open_time", F.last(F.when(enters, when), ignorenulls=True).over(upto)).filter(leaves)
    numbers = {n: money(c(n).cast("string")) for n in ("profit", "profit_pct") if n in out.columns}
    out = out.withColumns({**numbers, "exit_time": when})
    return out.withColumns({"trade_date": F.to_date("exit_time"), "open_date": F.to_date("open_time")}).filter(c("profit").isNotNull())


def ledger_table(raw: DataFrame) -> DataFrame:
    """Checked and coerced trade ledger: missing costs are zero, rows without an exit time drop out."""
    require_columns(raw, ["exit_time", "gross_pnl", "net_pnl"], "trade ledger")
    coerced = {}
    for name in ("gross_pnl", "net_pnl", "commission", "swap"):
        coerced[name] = F.coalesce(number(c(name).cast("string")), F.lit(0.0)) if name in raw.columns else F.lit(0.0)
    times = {n: c(n).cast("string").try_cast("timestamp_ntz") for n in ("entry_time", "exit_time") if n in raw.columns}
    return raw.withColumns({**coerced, **times}).na.drop(subset=["exit_time"])


def read_ledger(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """A ledger as `catalog.write_ledger` writes it: `csv` or `parquet`."""
    if format not in ("csv", "parquet"):
        raise ValueError(f"unknown ledger format: {format}")
    return ledger_table(spark.read.parquet(path) if format == "parquet" else spark.read.csv(path, header=True))


def pattern_trades(raw: DataFrame, split: str | None = None) -> DataFrame:
    """Pattern trades of a split ("train", "test", "test_ea") with their day: exit, else entry, else bar time."""
    table = lowered(raw)
    times = [c(n).cast("string").try_cast("timestamp_ntz") for n in ("exit_time", "entry_time", "time") if n in table.columns]
    if not times:
        raise ValueError("pattern trades need one of exit_time, entry_time, time")
    if split is not None and "split" in table.columns:
        table = table.filter(F.lower("split") == split.lower())
    return table.withColumn("trade_time", times[0]).filter("trade_time IS NOT NULL").withColumn("day", F.to_date("trade_time"))


# Accepted column names of published series, by kind and target.
DATE_NAMES = ["date", "time", "timestamp", "report_date_as_yyyy-mm-dd", "report_date", "as_of_date"]
RELEASE_NAMES = ["release_time", "released_at", "publication_time"]
SERIES_NAMES: dict[str, dict[str, list[str]]] = {
    "index": {"value": ["close", "value", "last", "vix", "gvz"]},
    "gamma": {
        "gamma_flip": ["gamma_flip", "flip", "zero_gamma", "zero_gamma_level"], "call_wall": ["call_wall", "callwall", "call_wall_strike"],
        "put_wall": ["put_wall", "putwall", "put_wall_strike"], "net_gamma": ["net_gamma", "gex", "gamma_exposure"]},
    "cot": {
        "commercial_long": ["commercial_long", "producer_merchant_processor_user_longs", "comm_positions_long_all"],
        "commercial_short": ["commercial_short", "producer_merchant_processor_user_shorts", "comm_positions_short_all"],
        "spec_long": ["spec_long", "managed_money_longs", "m_money_positions_long_all", "noncomm_positions_long_all"],
        "spec_short": ["spec_short", "managed_money_shorts", "m_money_positions_short_all", "noncomm_positions_short_all"],
        "commercial_net": ["commercial_net", "comm_net"], "spec_net": ["spec_net", "managed_money_net", "noncomm_net"]},
}


def find_column(columns: Sequence[str], choices: Sequence[str]) -> str | None:
    plain = {name.lower().strip(): name for name in columns}
    under = {name.lower().strip().replace(" ", "_"): name for name in columns}
    return next((names[choice] for choice in choices for names in (plain, under) if choice in names), None)


def external_series(raw: DataFrame, kind: str, symbol: str, date_column: str = "date") -> DataFrame:
    """Normalised published series of a kind ("vix", "gvz", "gamma", "cot").

    Positioning reports become usable at `release_time`: as given, or the report date plus
    three days, 20 hours and 30 minutes.
    """
    names = SERIES_NAMES["index" if kind in ("vix", "gvz") else kind]
    day = date_column if date_column in raw.columns else find_column(raw.columns, DATE_NAMES)
    if day is None:
        raise ValueError("no date column found; name it")
    found = {target: find_column(raw.columns, choices) for target, choices in names.items()}
    if kind in ("vix", "gvz") and found["value"] is None:
        raise ValueError(f"no value column found for {kind}")
    out = raw.select(
        c(f"`{day}`").cast("string").try_cast("timestamp_ntz").alias("date"), F.lit(symbol.upper()).alias("symbol"), F.lit(kind).alias("kind"),
        *[number(c(f"`{source}`").cast("string")).alias(target) for target, source in found.items() if source],
        *([c(f"`{find_column(raw.columns, RELEASE_NAMES)}`").cast("string").try_cast("timestamp_ntz").alias("_release")] if find_column(raw.columns, RELEASE_NAMES) else []))
    out = out.filter("date IS NOT NULL")
    if kind in ("vix", "gvz"):
        return out.withColumn("close", c("value"))
    if kind == "cot":
        for side in ("commercial", "spec"):
            if f"{side}_net" not in out.columns and {f"{side}_long", f"{side}_short"} <= set(out.columns):
                out = out.withColumn(f"{side}_net", c(f"{side}_long") - c(f"{side}_short"))
        given = c("_release") if "_release" in out.columns else c("date") + F.expr("INTERVAL 3 DAYS 20 HOURS 30 MINUTES")
        return out.withColumn("release_time", given).drop("_release")
    return out


def terminal_bars(raw: DataFrame) -> DataFrame:
    """Bars exported by a trading terminal: bid and ask stand at the one price given, spread zero."""
    flat = bars_from_text(lowered(raw))
    flat = flat if "volume" in flat.columns else flat.withColumn("volume", F.lit(0.0))
    return mid_as_bid_ask(flat.withColumn("volume", F.coalesce("volume", F.lit(0.0)))).withColumn("real_volume", c("volume"))


def preview(df: DataFrame, rows: int = 20) -> Mapping[str, object]:
    """Columns, types, row count and the first rows, for display."""
    return {"columns": df.columns, "dtypes": dict(df.dtypes), "n_rows": df.count(), "head": df.limit(rows).toPandas()}
