"""One row per key, and copies folded into a count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """First row of each key under ``order_by``, which should name a full tie-break.

    Spark turns the ``row_number() = 1`` filter into a group limit that runs before the
    shuffle, so each task sends at most one row per key and a hot key costs no more.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def fold_copies(df: DataFrame, count_col: str = "copies") -> DataFrame:
    """Identical rows folded into one with their number; folding starts before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count_col))
