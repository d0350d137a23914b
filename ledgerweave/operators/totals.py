"""Work per key that stays safe when one key owns a large share of the rows: totals and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.segments import Segments


def attach_totals(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    first: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Add sums of each key group to all its rows; null keys form a group too.

    ``first`` names a boolean column and an order: the column marks exactly one row of each key,
    the first under the order (ascending, nulls last, ties by content). By a segmented scan: the rows
    are dealt to tasks once and never joined to an aggregate of all keys.
    """
    return Segments.of(df, keys).total(keys, sums, first).result()


def join_unique(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join to a dimension that has one row per key, safe for hot keys of ``df``.

    The dimension may be an aggregate: the packed key makes it a plain join side, and the rows
    are read once. A null key matches nothing.
    """
    other = dim.filter(F.col(dim_key).isNotNull()).withColumn("_packed", F.struct(F.col(dim_key).alias("key")))
    own = df.withColumn("_own", F.struct(F.col(key).alias("key")))
    return own.join(other, F.col("_own") == F.col("_packed"), "left").drop("_own", "_packed")
