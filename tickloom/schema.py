"""Table kinds and the entry check used by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
_TS = T.TimestampType()
_NTZ = T.TimestampNTZType()

TICKS = _fields(
    ("symbol", _S), ("time", _TS), ("seq", _L), ("bid", _D), ("ask", _D),
    ("bid_volume", _D), ("ask_volume", _D), ("mid", _D), ("spread", _D),
)
BARS = _fields(
    ("symbol", _S), ("timeframe", _S), ("time", _NTZ), ("open", _D), ("high", _D),
    ("low", _D), ("close", _D), ("volume", _D),
)
LEDGER = _fields(
    ("strategy_id", _S), ("trade_id", _L), ("entry_time", _NTZ), ("exit_time", _NTZ),
    ("direction", _S), ("gross_pnl", _D), ("net_pnl", _D), ("commission", _D), ("swap", _D),
    ("initial_risk", _D), ("exit_reason", _S), ("session", _I), ("regime", _I),
)
RULES = _fields(("rule_id", _S), ("column", _S), ("lo", _D), ("hi", _D))


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Raise on the driver when `df` lacks a column an operator needs."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df
