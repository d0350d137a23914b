"""Query registry: a name, a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

from ledgerweave.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Same value types on both engines: exact decimals shown as double, dates and times as ISO text."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            c = c.cast("string").alias(f.name)
        shown.append(c)
    return df.select(*shown)


def register(name: str, oracle_sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return present(fn(spark, sf_dir))

        run.__name__ = run.__qualname__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle_sql is not None:
            ORACLES[name] = oracle_sql
        return fn

    return add


def half_up(numerator: str, denominator: str) -> str:
    """SQL: integer quotient rounded half away from zero, in exact integer arithmetic."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return f"(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})))"


def cents(x: str) -> str:
    """SQL: a two-digit decimal as whole cents."""
    return f"CAST(CAST({x} AS DECIMAL(38,2)) * 100 AS HUGEINT)"
