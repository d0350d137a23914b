"""Calendar dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import as_date, month_key


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day: date, Monday of its week, first of its month, ``yyyyMM``."""
    days = spark.range(1, numPartitions=1).select(F.explode(F.sequence(as_date(first), as_date(last))).alias("date"))
    return days.select(
        "date",
        F.date_trunc("week", "date").cast("date").alias("first_of_week"),
        F.trunc("date", "month").alias("first_of_month"),
        month_key("date").alias("year_month"),
    )
