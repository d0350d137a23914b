"""Checks of mapping tables that guard the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, table_name: str, key: Column, count_col: str) -> DataFrame:
    """Keys with more than one non-null ``count_col``: duplicates that would fan a join out."""
    return (
        df.groupBy(key.cast("string").alias("join_key"))
        .agg(F.count(count_col).alias("row_count"))
        .filter(F.col("row_count") > 1)
        .select(F.lit(table_name).alias("table_name"), "join_key", "row_count")
    )


def unmapped_codes(df: DataFrame, mapping: DataFrame, table_name: str, code: str, mapped: str) -> DataFrame:
    """Codes without a mapping and the number of rows that carry them.

    Rows are counted per code before the anti join, so the join sees each code once.
    """
    known = mapping.select(F.col(mapped).alias("_mapped")).filter(F.col("_mapped").isNotNull()).distinct()
    counts = df.groupBy(F.col(code).alias("join_key")).agg(F.count(code).alias("row_count"))
    return counts.join(known, F.col("join_key") == F.col("_mapped"), "left_anti").select(
        F.lit(table_name).alias("table_name"), F.col("join_key").cast("string").alias("join_key"), "row_count"
    )
