import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.bars import dense_daily_pnl, ticks_to_bars
from tickloom.operators.quality import bar_audit
from tickloom.operators.scan import with_position
from tickloom.sources import catalog, reports, tables, ticks
from tickloom.streaming.bars import streaming_bars
from tickloom.streaming.touch import first_touch_stream, touch_events


def quotes(spark, rows):
    pdf = pd.DataFrame(rows, columns=["time", "bid", "ask"])
    pdf["time"] = pd.to_datetime(pdf["time"])
    out = spark.createDataFrame(pdf).withColumns({"symbol": F.lit("X"), "bid_volume": F.lit(1.0), "ask_volume": F.lit(1.0)})
    return out.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def test_quotes_become_minute_bars(spark):
    t = quotes(spark, [("2025-06-03 09:14:07", 71.25, 71.5), ("2025-06-03 09:14:58", 70.75, 71.25), ("2025-06-03 09:17:30", 72.5, 72.75), ("2025-06-03 09:17:31", 73.0, 73.5), ("2025-06-03 09:17:59", 72.0, 72.75)])
    rows = ticks_to_bars(t, "m1").orderBy("time").collect()
    assert [r.tick_volume for r in rows] == [2, 3]
    assert rows[0].bid_open == 71.25 and rows[0].bid_low == 70.75 and rows[1].ask_high == 73.5 and abs(rows[1].spread_mean - 0.5) < 1e-9


def test_daily_series_fills_quiet_days(spark):
    trades = spark.createDataFrame([("s", "2025-03-10", "2025-03-12", -7.5), ("s", "2025-03-12", "2025-03-12", 20.0), ("s", "2025-03-13", "2025-03-14", 4.0)], "strategy_id string, o string, x string, net_pnl double")
    trades = trades.select("strategy_id", F.col("o").cast("timestamp_ntz").alias("entry_time"), F.col("x").cast("timestamp_ntz").alias("exit_time"), "net_pnl")
    rows = dense_daily_pnl(trades, period=("2025-03-09", "2025-03-15")).orderBy("day").collect()
    assert [r.pnl for r in rows] == [0.0, 0.0, 0.0, 12.5, 0.0, 4.0, 0.0] and [r.opened for r in rows] == [False, True, False, True, True, False, False]


def test_audit_flags_a_removed_weekday(spark):
    days = pd.bdate_range("2024-02-05", "2024-03-01")
    hours = pd.DatetimeIndex([d + pd.Timedelta(hours=h) for d in days for h in range(24)])
    pdf = pd.DataFrame({"symbol": "X", "time": hours, "open": 1.0, "high": 1.1, "low": 0.9, "close": 1.0})
    clean = bar_audit(spark.createDataFrame(pdf), "h1").first()
    assert clean.passed, clean
    broken = bar_audit(spark.createDataFrame(pdf[pdf.time.dt.strftime("%Y-%m-%d") != "2024-02-14"]), "h1").first()
    assert not broken.passed and broken.missing_trading_days == 1 and broken.large_gaps == 1


def test_each_bar_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "gbpusd_m15.csv").write_text("Open,High,Low,Close,Date,Vol\n3,4,2,3.5,2025-06-03 09:15:00,11\n")
    (tmp_path / "platinum_h4.csv").write_text('timestamp,close,low,high,open\n2025-06-04 12:00:00,"1,5",0.5,2,1\n2025-06-04 16:00:00,1.5,0.5,2,1\n')
    rows = tables.read_bar_csv(spark, [str(p) for p in sorted(tmp_path.glob("*.csv"))]).orderBy("symbol", "time").collect()
    assert [(r.symbol, r.timeframe, r.open, r.high, r.low, r.close, r.volume) for r in rows] == [
        ("GBPUSD", "m15", 3.0, 4.0, 2.0, 3.5, 11.0), ("PLATINUM", "h4", 1.0, 2.0, 0.5, None, None), ("PLATINUM", "h4", 1.0, 2.0, 0.5, 1.5, None)]
    assert str(rows[0].time) == "2025-06-03 09:15:00"
    (tmp_path / "bad_h1.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no header"):
        tables.read_bar_csv(spark, str(tmp_path)).collect()


def test_ledger_survives_both_formats(spark, tmp_path):
    ledger = spark.createDataFrame([("s", 1, "2025-03-10", 5.0, 4.5)], "strategy_id string, trade_id long, x string, gross_pnl double, net_pnl double").withColumn("exit_time", F.col("x").cast("timestamp_ntz"))
    catalog.write_ledger(ledger, str(tmp_path / "ledger"))
    for kind in ("csv", "parquet"):
        assert [(r.net_pnl, r.commission) for r in tables.read_ledger(spark, str(tmp_path / "ledger" / kind), kind).collect()] == [(4.5, 0.0)]


def test_manifest_tells_repeated_rows_apart(spark):
    table = lambda values: spark.createDataFrame([("A", "2025-01-01", v) for v in values], "symbol string, time string, x int")
    prints = {tuple(v): catalog.manifest(table(v)).first().fingerprint for v in ([1, 1], [2, 2], [1, 2], [1], [1, 1, 1])}
    assert len(set(prints.values())) == 5 and catalog.manifest(table([2, 1]).repartition(3)).first().fingerprint == prints[(1, 2)]


def test_tick_hour_files(spark, tmp_path):
    import lzma
    import numpy as np
    hour = tmp_path / "XAUUSD" / "2024" / "00" / "02"
    hour.mkdir(parents=True)
    payload = lzma.decompress(ticks.encode_hour(*(np.array(x) for x in ([5, 1500], [2000300, 2000400], [2000100, 2000200], [1.5, 2.0], [1.0, 3.0]))))
    (hour / "13h_ticks.bi5").write_bytes(lzma.compress(payload + b"cut", format=lzma.FORMAT_ALONE))
    rows = ticks.decode_ticks(ticks.tick_files(spark, str(tmp_path))).orderBy("time").collect()
    assert [(str(r.time), r.bid, r.ask, r.bid_volume) for r in rows] == [
        ("2024-01-02 13:00:00.005000", 2000.1, 2000.3, 1.0), ("2024-01-02 13:00:01.500000", 2000.2, 2000.4, 3.0)]


def test_report_values_and_pairs(spark):
    """A small report of this test's own: two columns of labels, three closed positions, one exit without an entry."""
    row = lambda *cells: "<tr>" + "".join(f"<td>{x}</td>" for x in cells) + "</tr>"
    deal = lambda day, way, profit, note="": row(f"2025.03.{day:02} 08:30:00", 7, "PLATINUM", "sell", way, "0.30", "951.2", 4, "-0.40", "-0.10", profit, "5 000.00", note)
    page = "<html><body><table>" + row("Settings") + row("Expert:", "<b>reversal</b>", "Symbol:", "PLATINUM") + row("Inputs:", "Lots=0.3") + row("", "Window = 24")
    page += row("Results") + row("Gross Profit:", "<b>12 345.67</b>", "Gross Loss:", "", "-890,5") + row("Total Trades:", "8", "Balance Drawdown Maximal:", "77.00 (1.54%)")
    page += row("Profit Trades (% of total):", "6 (75%)", "Equity Drawdown Maximal:", "101,30 (2,03%)") + row("Deals") + row(*[n.title() for n in reports.DEAL_COLUMNS])
    page += deal(3, "out", "1.00") + deal(4, "in", "0.00", "R:2") + deal(5, "out", "1 250.75") + deal(6, "in", "0.00", "R:5 x") + deal(7, "in", "0.00") + deal(10, "out", "-3.25") + deal(11, "out", "2.00") + "</table></body></html>"
    table = spark.createDataFrame([("a", bytearray(page.encode("utf-16")))], "report_id string, content binary").select("report_id", reports.decoded(F.col("content")).alias("html"))
    head = reports.headlines(table).first()
    assert (head.expert, head.symbol, head.gross_profit, head.gross_loss, head.total_trades, head.win_rate_pct) == ("reversal", "PLATINUM", 12345.67, -890.5, 8, 75.0)
    assert (head.balance_drawdown_pct, head.equity_drawdown_pct) == (1.54, 2.03)
    assert sorted(tuple(r) for r in reports.report_inputs(table).select("name", "value").collect()) == [("Lots", "0.3"), ("Window", "24")]
    pairs = reports.paired_deals(table).orderBy("k").collect()
    assert [(p.entry_time.day, p.exit_time.day, p.regime, round(p.net_profit, 2)) for p in pairs] == [(4, 5, 2, 1249.75), (6, 10, 5, -4.25), (7, 11, None, 1.0)]
    assert [(r.regime, round(r.net_profit, 2)) for r in reports.closed_deals(table).orderBy("time").collect()] == [(None, 0.5), (2, 1250.25), (5, -3.75), (5, 1.5)]


def test_report_in_parts_reads_like_one_page(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{x}</td>" for x in cells) + "</tr>"
    deal = lambda day, way, note="": row(f"2025.03.{day:02} 08:30:00", 7, "PLATINUM", "sell", way, "0.30", "951.2", 4, "-0.40", "-0.10", "2.50", "5 000.00", note)
    parts = [row("Settings") + row("Expert:", "one"), row("Results") + row("Total Trades:", "3"), row("Deals") + deal(4, "in", "R:2"), deal(5, "in") + deal(6, "out"), "", deal(7, "out") + row("Expert:", "two")]
    whole = spark.createDataFrame([("a", "".join(parts))], "report_id string, html string")
    cut = spark.createDataFrame([("a", i, x) for i, x in reversed(list(enumerate(parts)))], "report_id string, part int, html string")
    for read in (reports.closed_deals, reports.paired_deals, reports.headlines):
        told = [sorted(tuple(r) for r in read(pages).drop("row_no").collect()) for pages in (whole, cut)]
        assert told[0] == told[1] and told[0]
    assert reports.headlines(cut).first().expert == "two" and [p.exit_time.day for p in reports.paired_deals(cut).orderBy("k").collect()] == [6, 7]


def test_report_parts_do_not_grow_with_the_ledger(spark, tmp_path, monkeypatch):
    from tickloom.plans import source_queries

    monkeypatch.setattr(source_queries, "PART", 50)
    orders = spark.range(2000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "250000.0D + id AS o_totalprice", "TIMESTAMP_NTZ '1997-03-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    pages = source_queries._reports(spark, str(tmp_path))
    assert pages.count() == 42 and pages.filter("part BETWEEN 1 AND 40").agg(F.max(F.size(F.split("html", "<tr>")))).first()[0] == 101
    assert reports.closed_deals(pages).count() == 2000 and reports.headlines(pages).first().total_trades == 2000


def test_reports_are_read_from_files(spark, tmp_path):
    (tmp_path / "one.htm").write_bytes("<table><tr><td>Results</td></tr><tr><td>Total Trades:</td><td>3</td></tr></table>".encode("utf-16-le"))
    page = reports.read_reports(spark, str(tmp_path))
    assert [r.total_trades for r in reports.headlines(page).collect()] == [3]


def test_partitions_are_replaced_one_by_one(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    tagged = bars.withColumn("timeframe", F.lit("h1"))
    catalog.write_bars(tagged, path)
    catalog.write_bars(tagged.filter("symbol = 'B'").withColumn("close", F.lit(1.0)), path)
    back = spark.read.parquet(path)
    assert back.count() == 750 and back.filter("symbol = 'B' AND close <> 1.0").count() == 0
    assert catalog.read_range(spark, path, "2024-01-03 00:00:00", "2024-01-04 00:00:00", ["A"], "h1").count() == 24


def drain(stream, spark, tmp_path, name):
    job = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(name)


def test_stream_bars_equal_batch_bars_over_two_files(spark, tmp_path):
    t = quotes(spark, [(f"2026-01-01 {h:02}:{m:02}:10", 100.0 + h + m / 60, 100.1 + h + m / 60) for h in range(5) for m in range(0, 60, 7)]).withColumn("time", F.col("time").cast("timestamp"))
    path = str(tmp_path / "ticks")
    t.filter("hour(time) < 3").coalesce(1).write.parquet(path)
    t.filter("hour(time) >= 3").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.time: (r.open, r.close, r.tick_volume) for r in drain(streaming_bars(stream, "h1"), spark, tmp_path, "stream_bars").collect()}
    want = {r.time: (r.open, r.close, r.tick_volume) for r in ticks_to_bars(t, "h1").collect()}
    assert len(got) == 4 and all(want[k] == v for k, v in got.items())


def test_stream_bars_count_quotes_of_one_moment_like_batch_bars(spark, tmp_path):
    t = quotes(spark, [(f"2026-01-01 {h:02}:{m:02}:10", 100.0 + h + m / 60, 100.1 + h + m / 60) for h in range(4) for m in range(0, 60, 7) for _ in range(3)])
    t = t.withColumn("time", F.col("time").cast("timestamp"))
    path = str(tmp_path / "ticks")
    t.withColumn("seq", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema).parquet(path)
    kept = lambda rows: {r.time: (r.open, r.close, r.tick_volume, r.real_volume) for r in rows}
    got = kept(drain(streaming_bars(stream, "h1", single=False), spark, tmp_path, "all_quotes").collect())
    want = kept(ticks_to_bars(stored, "h1").collect())
    assert len(got) == 3 and all(want[k] == v for k, v in got.items()) and {v[2] for v in got.values()} == {27}


def test_stream_reports_first_touch(spark, tmp_path):
    t = quotes(spark, [("2026-01-01 00:00:00", 100.0, 100.1), ("2026-01-01 00:00:10", 100.2, 100.3), ("2026-01-01 00:00:20", 101.5, 101.6), ("2026-01-01 00:00:30", 90.0, 90.1)])
    path = str(tmp_path / "q")
    t.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(t.schema).parquet(path)
    signals = stream.filter("second(time) = 0").select("symbol", "time", F.lit("up").alias("signal_id"), F.lit(1).alias("side"), F.lit(95.0).alias("stop_price"), F.lit(101.0).alias("target_price"), F.lit(None).cast("timestamp").alias("deadline"))
    rows = drain(first_touch_stream(touch_events(signals, stream, shards=2), lateness="0 seconds"), spark, tmp_path, "touched").collect()
    assert [(r.signal_id, r.exit_price, r.exit_reason) for r in rows] == [("up", 101.5, "take_profit")]


def test_stream_drops_late_quotes_and_keeps_deadlines(spark, tmp_path):
    """Three triggers: a quote far behind the watermark must not close anything; a deadline passes without a quote of its symbol."""
    first = quotes(spark, [("2026-01-01 00:00:00", 100.0, 100.1), ("2026-01-01 02:00:00", 100.2, 100.3)])
    second = quotes(spark, [("2026-01-01 00:05:00", 90.0, 90.1), ("2026-01-01 02:01:00", 100.4, 100.5)])
    third = quotes(spark, [("2026-01-01 09:00:00", 50.0, 50.1)]).withColumn("symbol", F.lit("Y"))
    path = str(tmp_path / "q")
    for part in (first, second, third):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path)
    opening = stream.filter("hour(time) = 0 AND minute(time) = 0")
    signals = opening.select("symbol", "time", F.lit("s").alias("signal_id"), F.lit(1).alias("side"), F.lit(95.0).alias("stop_price"), F.lit(200.0).alias("target_price"), F.lit("2026-01-01 05:00:00").cast("timestamp").alias("deadline"))
    rows = drain(first_touch_stream(touch_events(signals, stream)), spark, tmp_path, "late_touch").collect()
    assert [(r.signal_id, r.exit_price, r.exit_reason) for r in rows] == [("s", 100.4, "max_hold")]


def test_tick_files_are_packed_without_a_python_object_per_quote(spark, tmp_path):
    """Lists of row objects took Python memory in step with the quotes of an hour; the files must still decode to the same quotes."""
    from tickloom.plans.source_queries import tick_files

    rows = [(i, ["a", "b"][i % 2], f"2024-01-01 0{i % 3}:00:0{i % 7}.{i:03d}", i % 5, float(i)) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, t string, user_id long, value double")
    events.withColumn("ts", F.to_timestamp_ntz("t")).drop("t").write.parquet(f"{tmp_path}/events.parquet")
    decoded = tick_files(spark, str(tmp_path))
    assert "MapInArrow" in decoded._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r["symbol"], str(r["time"]), r["bid"], r["ask"], r["bid_volume"]) for r in decoded.collect())
    cents = lambda v: math.floor((v + 1) * 1000 + 0.5) / 1000
    expected = sorted((s, str(datetime.fromisoformat(t)), cents(v - 0.05), cents(v + 0.05), float(u)) for _, s, t, u, v in rows)
    assert [(a, b) for a, b, *_ in found] == [(a, b) for a, b, *_ in expected]
    assert [x[2:] for x in found] == [pytest.approx(x[2:]) for x in expected]
