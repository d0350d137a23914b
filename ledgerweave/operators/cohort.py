"""Purchase cohorts by first-order month."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import full_months_between, month_key


def user_month_totals(df: DataFrame) -> DataFrame:
    """Cash flow (cancels in the cancel month) and net payment (cancels in the order month) per user and month."""
    return (
        df.filter(F.col("user_id") > 0)
        .groupBy("user_id", "month")
        .agg(
            (F.sum("paid") + F.sum("cancel")).alias("cashflow"),
            (F.sum("paid") + F.sum("cancel2")).alias("net"),
        )
    )


def _overridden(user: Column, overrides: Mapping[int, str], computed: Column) -> Column:
    for user_id, month in overrides.items():
        computed = F.when(user == user_id, F.lit(month)).otherwise(computed)
    return computed


def first_order_month(totals: DataFrame, overrides: Mapping[int, str]) -> DataFrame:
    """Add the first positive month of each user by cash flow and by net payment.

    A user has one row per month by now, so the window over a user is bounded by months.
    """
    w = Window.partitionBy("user_id")
    cash = F.min(F.when(F.col("cashflow") > 0, F.col("month"))).over(w)
    net = F.min(F.when(F.col("net") > 0, F.col("month"))).over(w)
    return totals.withColumns({"_cash": cash, "_net": net}).select(
        *totals.columns,
        _overridden(F.col("user_id"), overrides, F.col("_cash")).alias("first_cash_month"),
        _overridden(F.col("user_id"), overrides, F.col("_net")).alias("first_net_month"),
    )


def cohort_matrix(firsts: DataFrame) -> DataFrame:
    """First month by order month: month offset, payers and amount.

    Months whose net is zero (paid and refunded) count toward the cohort of the first cash
    month, others toward that of the first net month. ``month`` is the text of a month's first day, as in the
    summary table: a user then appears once per order month, and counting rows counts payers. Another
    day in it would be a month of its own.
    """
    first = F.when(F.col("net") == 0, F.col("first_cash_month")).when(F.col("net") != 0, F.col("first_net_month"))
    placed = firsts.select(
        F.col("month").alias("order_m"), F.col("cashflow").alias("selling_cost"), first.alias("first_m")
    ).filter(F.col("first_m") <= F.col("order_m"))
    return (
        placed.groupBy("first_m", "order_m")
        .agg(
            F.count(F.when(F.col("selling_cost") > 0, 1)).alias("order_users"),
            F.sum("selling_cost").alias("selling_cost"),
        )
        .withColumns({"_f": F.col("first_m").cast("date"), "_o": F.col("order_m").cast("date")})
        .groupBy(
            month_key("_f").alias("yyyymm"),
            month_key("_o").alias("order_mm"),
            full_months_between("_f", "_o").alias("month_diff"),
        )
        .agg(F.sum("order_users").alias("order_users"), F.sum("selling_cost").alias("selling_cost"))
    )
