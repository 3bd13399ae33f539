"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for the comparison with SQL, and widen counts to BIGINT."""
    def shape(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.round(F.col(name).cast("double"), digits).alias(name)
        if kind in ("integer", "short", "byte"):
            return F.col(name).cast("long").alias(name)
        return F.col(name)
    return df.select(*[shape(f.name, f.dataType.typeName()) for f in df.schema])


def r(*names: str, digits: int = 6) -> str:
    """SQL select items that round each named column."""
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
