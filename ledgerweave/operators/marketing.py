"""Marketing expense: provisional daily rows until a month is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.weeks import week_of_day


def provisional_fixed(daily: DataFrame, monthly: DataFrame, month: str = "base_m") -> tuple[DataFrame, DataFrame]:
    """Daily rows of months later than the last fixed one, and the fixed rows themselves.

    The last fixed month is a scalar subquery, so the filter reaches the daily scan. With
    no fixed month all daily rows stay.
    """
    last_fixed = monthly.agg(F.max(month).alias("m"))
    later = daily.filter(F.coalesce(F.col(month) > last_fixed.scalar(), F.lit(True)))
    return later, monthly


def marketing_measures(
    provisional: DataFrame, fixed: DataFrame, freecash: DataFrame, calendar: DataFrame
) -> DataFrame:
    """The three sources by month and week, stacked with the measures each one lacks at zero."""
    zero = F.lit(0).cast("decimal(18,2)")
    week = week_of_day(calendar, "_day")

    def by_day(df: DataFrame, measure: str) -> DataFrame:
        daily = df.groupBy("base_m", F.col("base_dt").cast("date").alias("_date")).agg(F.sum("cost").alias("_cost"))
        placed = daily.join(week, F.col("_date") == F.col("_day"), "left")
        measures = {
            "cost": F.col("_cost"),
            "freecash": zero,
            "daily_cost": zero,
            "fix_cost": zero,
        } | {measure: F.col("_cost")}
        return placed.select("base_m", "first_of_week", *[v.alias(k) for k, v in measures.items()])

    cash = freecash.select(
        "base_m",
        "first_of_week",
        zero.alias("cost"),
        F.col("daily_freecash").cast("decimal(18,2)").alias("freecash"),
        zero.alias("daily_cost"),
        zero.alias("fix_cost"),
    )
    return by_day(provisional, "daily_cost").unionByName(by_day(fixed, "fix_cost")).unionByName(cash)


def marketing_summary(df: DataFrame) -> DataFrame:
    """Costs turned negative, free cash as it is, by month and week."""
    return df.groupBy("base_m", "first_of_week").agg(
        (-F.sum("cost")).alias("cost"),
        F.sum("freecash").alias("freecash"),
        (-F.sum("daily_cost")).alias("daily_cost"),
        (-F.sum("fix_cost")).alias("fix_cost"),
    )
