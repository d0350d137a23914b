"""Monthly amounts spread over calendar days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import as_date, month_start


def spread_monthly(
    df: DataFrame, calendar: DataFrame, as_of: dt.date, month: str, keys: Sequence[str], value: str, out: str
) -> DataFrame:
    """Per week: sum of ``value / days of the month`` over the days before ``as_of``.

    The amounts are summed per month and key first; the calendar is folded to days per
    month and week, so one row meets at most six weeks and is never expanded into days.
    """
    weeks = (
        calendar.filter(F.col("date") < as_date(as_of))
        .groupBy(F.col("year_month").alias("_month"), "first_of_week")
        .agg(F.count("date").alias("_days"))
    )
    months = df.groupBy(month, *keys).agg(F.sum(F.col(value)).alias("_value"))
    length = F.dayofmonth(F.last_day(month_start(month)))
    return months.join(weeks, F.col(month) == F.col("_month")).select(
        month,
        "first_of_week",
        *keys,
        length.alias("date_diff"),
        ((F.col("_value") * F.col("_days")).cast("double") / length.cast("double")).alias(out),
    )


def spread_elapsed(
    df: DataFrame, calendar: DataFrame, as_of: dt.date, month: str, value: str, out: str
) -> DataFrame:
    """Per day before ``as_of``: value integer-divided by the days of that month seen so far.

    The day count is the count of joined rows per month, so a second input row in a month
    raises it, as in the source report.
    """
    days = calendar.filter(F.col("date") < as_date(as_of)).select("date", "first_of_week", "first_of_month", "year_month")
    joined = df.select(F.substring(F.col(month), 1, 6).alias("_month"), F.col(value).cast("int").alias("_value")).join(
        days, F.col("_month") == F.col("year_month")
    )
    # as many rows as there are days, times the few inputs of a month
    counted = joined.withColumn("days", F.count(F.lit(1)).over(Window.partitionBy("year_month")))
    return counted.select(
        F.col("first_of_month").cast("string").alias("base_m"),
        "first_of_week",
        "date",
        "days",
        # integer division drops the fraction toward zero
        F.expr("_value div days").alias(out),
    )
