"""Ad ledger: normalisation, revenue, agency fee."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import as_date, local_from_epoch_ms, month_key
from ledgerweave.operators.intervals import attribute_interval
from ledgerweave.operators.weeks import week_of_day

CLICK = "CLICK"


def normalise_ad_ledger(df: DataFrame, zone: str = "Asia/Seoul", first_day: dt.date | None = None) -> DataFrame:
    """Click rows with flat typed fields, wall-clock times and the partition date.

    ``first_day`` is compared with the partition columns themselves, so a year/month/day
    layout is pruned before any file is opened; struct fields are pruned by the scan.
    """
    clicks = df.filter(F.col("ledgertype") == CLICK)
    if first_day is not None:
        y, m, d = f"{first_day:%Y}", f"{first_day:%m}", f"{first_day:%d}"
        same_year, same_month = F.col("year") == y, F.col("month") == m
        clicks = clicks.filter(
            (F.col("year") > y) | (same_year & (F.col("month") > m)) | (same_year & same_month & (F.col("day") >= d))
        )
    return clicks.select(
        "ledgertype",
        "salesuserid",
        local_from_epoch_ms("clicktimestamp", zone).alias("click_date"),
        local_from_epoch_ms("ledgertimestamp", zone).alias("ledger_date"),
        F.col("budget.paid").cast("int").alias("budget_paid"),
        F.col("budget.free").cast("int").alias("budget_free"),
        F.col("prevbudget.paid").cast("int").alias("prevbudget_paid"),
        F.col("prevbudget.free").cast("int").alias("prevbudget_free"),
        F.col("cost.cpc").cast("int").alias("cost_cpc"),
        F.col("cost.vat").cast("int").alias("cost_vat"),
        F.col("cost.ispaid").alias("cost_ispaid"),
        F.col("request.member1.campaignid").cast("string").alias("campaignid"),
        F.col("request.member1.cpc").cast("int").alias("request_cpc"),
        F.to_date(F.concat("year", "month", "day"), "yyyyMMdd").alias("date"),
        F.col("budget").isNotNull().alias("has_budget"),
    )


def ad_revenue(clicks: DataFrame, calendar: DataFrame, first_day: dt.date) -> DataFrame:
    """Gross, paid and free click cost by month and week.

    Clicks are summed per day before the calendar is joined.
    """
    paid = F.col("cost_ispaid")
    daily = (
        clicks.filter(paid.isNotNull() & (F.col("date") >= as_date(first_day)))
        .groupBy("date")
        .agg(
            F.sum("cost_cpc").alias("gross_cpc"),
            F.sum(F.when(paid, F.col("cost_cpc")).otherwise(0)).alias("paid_cpc"),
            F.sum(F.when(~paid, F.col("cost_cpc")).otherwise(0)).alias("free_cpc"),
        )
    )
    week = week_of_day(calendar, "date")
    return (
        daily.join(week, "date")
        .groupBy(month_key("date").alias("yyyymm"), "first_of_week")
        .agg(*[F.sum(c).alias(c) for c in ("gross_cpc", "paid_cpc", "free_cpc")])
    )


def daily_ad_spend(clicks: DataFrame) -> DataFrame:
    """Paid and free spend including VAT per seller and day; rows without a budget or payer flag drop."""
    spend, paid = F.col("cost_cpc") + F.col("cost_vat"), F.col("cost_ispaid")
    return (
        clicks.filter(F.col("has_budget") & paid.isNotNull())
        .groupBy(F.col("salesuserid").cast("int").alias("sales_user_id"), F.col("date").alias("dt"))
        .agg(
            F.sum(F.when(paid, spend).otherwise(0)).alias("paid_incl_vat"),
            F.sum(F.when(~paid, spend).otherwise(0)).alias("free_incl_vat"),
        )
    )


def agency_fee(daily: DataFrame, intervals: DataFrame, default: str = "self") -> DataFrame:
    """Spend per seller, day and agency with the agency's fee: 10% of the paid spend without VAT.

    The fee is rounded once, half up, to whole units. Sums are linear, so summing per seller
    and day before the interval join changes nothing but the rows joined.
    """
    named = intervals.withColumn("_seller", F.col("seller_id").cast("int")).drop("seller_id")
    joined = attribute_interval(daily, named, "sales_user_id", "dt", "_seller", "agency", default)
    period = F.concat(F.col("start_dt").cast("string"), F.lit("~"), F.col("end_dt").cast("string"))
    fee_base = F.sum(F.when(F.col("attributed"), F.col("paid_incl_vat")).otherwise(0))
    return joined.groupBy(
        month_key("dt").alias("yyyymm"), "dt", "sales_user_id", "agency", period.alias("agency_period")
    ).agg(
        F.sum("paid_incl_vat").alias("paid_incl_vat"),
        F.sum("free_incl_vat").alias("free_incl_vat"),
        F.round(fee_base / F.lit(11).cast("decimal(2,0)"), 0).cast("bigint").alias("agency_fee"),
    )
