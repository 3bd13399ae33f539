"""Landed tick files: one compressed hour of fixed-width records per file."""

from __future__ import annotations

import lzma
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record layout (offset in ms, ask, bid, ask volume, bid volume; big-endian)
# and how many decimal digits the integer prices carry.
RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
PRICE_DIGITS = {"XAUUSD": 3, "XAGUSD": 3, "BTCUSD": 1, "ETHUSD": 2, "USDJPY": 3, "EURJPY": 3, "GBPJPY": 3, "AUDJPY": 3}
DEFAULT_DIGITS = 5
YIELD_ROWS = 200_000
# `<symbol>/<year>/<month counted from 00>/<day>/<hour>h_ticks.bi5`
HOUR_PATH = r"([A-Za-z0-9]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$"
TICK_SCHEMA = "symbol string, time timestamp_ntz, seq long, bid double, ask double, bid_volume double, ask_volume double, flags int, source string"


def tick_files(spark: SparkSession, folder: str) -> DataFrame:
    """Hour files below a folder with symbol and hour read off their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bi5").load(folder)
    part = lambda i: F.regexp_extract("path", HOUR_PATH, i)
    hour = F.make_timestamp_ntz(part(2).cast("int"), part(3).cast("int") + 1, part(4).cast("int"), part(5).cast("int"), F.lit(0), F.lit(0))
    return files.filter(F.col("path").rlike(HOUR_PATH)).select(F.upper(part(1)).alias("symbol"), hour.alias("hour"), "content")


def decode_ticks(files: DataFrame, digits: Mapping[str, int] | None = None, source: str = "file") -> DataFrame:
    """Records of all files as quotes; a cut-off last record is ignored, an unreadable file fails the job.

    Files are independent, so Spark spreads them; one hour of one symbol is the unit of work.
    """
    places = {**PRICE_DIGITS, **(digits or {})}

    def frame(parts: list[tuple[str, pd.Timestamp, np.ndarray]]) -> pd.DataFrame:
        sizes = [len(records) for _, _, records in parts]
        records = np.concatenate([records for _, _, records in parts])
        hours = np.repeat(np.array([np.datetime64(hour, "us") for _, hour, _ in parts]), sizes)
        scale = np.repeat([10.0 ** places.get(symbol, DEFAULT_DIGITS) for symbol, _, _ in parts], sizes)
        return pd.DataFrame({
            "symbol": np.repeat([symbol for symbol, _, _ in parts], sizes), "time": hours + records["ms"].astype("timedelta64[ms]"),
            "seq": np.concatenate([np.arange(n, dtype="int64") for n in sizes]), "bid": records["bid"] / scale, "ask": records["ask"] / scale,
            "bid_volume": records["bid_volume"].astype("float64"), "ask_volume": records["ask_volume"].astype("float64"), "flags": np.int32(0), "source": source})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for symbol, hour, content in zip(batch["symbol"], batch["hour"], batch["content"]):
                payload = lzma.decompress(content) if content else b""
                records = np.frombuffer(payload[: len(payload) // RECORD.itemsize * RECORD.itemsize], dtype=RECORD)
                parts.append((symbol, hour, records))
                held += len(records)
                if held >= YIELD_ROWS:
                    yield frame(parts)
                    parts, held = [], 0
        if parts:
            yield frame(parts)

    return files.select("symbol", "hour", "content").mapInPandas(decode, TICK_SCHEMA)


def encode_hour(ms: np.ndarray, ask: np.ndarray, bid: np.ndarray, ask_volume: np.ndarray, bid_volume: np.ndarray) -> bytes:
    """The payload of one hour file from integer prices (for tests and re-export)."""
    records = np.empty(len(ms), dtype=RECORD)
    for name, values in zip(RECORD.names, (ms, ask, bid, ask_volume, bid_volume)):
        records[name] = values
    return lzma.compress(records.tobytes(), format=lzma.FORMAT_ALONE)
