"""Service contracts: flattening, recognition, summary; and signed sales netting."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import as_date, iso_utc_to_local_date, month_key
from ledgerweave.operators.lookup import has_related
from ledgerweave.operators.weeks import week_of_day

# --- Fixed values: channel and scale labels, codes, excluded test names -----------------
LISTING = "리스팅"
SIMPLE = "간편"
STORE = "시공스토어"
SIMPLE_CHANNELS = (0, 4, 5, 6, 7)
LISTING_CHANNELS = (1, 2)
STORE_CHANNEL = 3
SCALE_WHOLE = "종합"
SCALE_PART = "개별"
SCALE_CAFE = "카페"
SCALE_MISSING = 9999999
EXPERTISE_WHOLE = 5
EXPERTISE_CAFE = 26
STATUS_CANCELLED = 20
CANCELLED_LABEL, NORMAL_LABEL = "정상_거래취소", "정상"
TEST_NAME_LOWER = "%test%"
TEST_NAMES = ("%테스트%", "%효_iOS%")
STATUS_SOLD, STATUS_CANCELLED_SALE = 2, 3


def net_sales(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sales plus, cancels minus, without VAT, by month and week.

    Rows are summed per day before the calendar is joined; VAT comes off the sum.
    """
    sign = F.when(F.col("sales_status") == STATUS_SOLD, 1).otherwise(-1)
    sold = F.col("sales_status") == STATUS_SOLD
    daily = (
        df.filter((F.col("is_deleted") == 0) & F.col("sales_status").isin(STATUS_SOLD, STATUS_CANCELLED_SALE))
        .groupBy(F.col("basis_date_time").cast("date").alias("_day"))
        .agg(
            F.count(F.when(sold, F.col("id"))).alias("rev_count"),
            F.count(F.when(~sold, F.col("id"))).alias("cancel_count"),
            F.sum(sign * F.coalesce("paid_cash_amount", F.lit(0))).alias("paid"),
            F.sum(sign * F.coalesce("free_cash_amount", F.lit(0))).alias("free"),
        )
    )
    week = week_of_day(calendar)
    return (
        daily.join(week, F.col("_day") == F.col("_date"), "left")
        .groupBy(month_key("_day").alias("yyyymm"), "first_of_week")
        .agg(
            F.sum("rev_count").alias("rev_count"),
            (-F.sum("cancel_count")).alias("cancel_count"),
            (F.sum("paid").cast("double") / F.lit(1.1)).alias("paid_rev"),
            (F.sum("free").cast("double") / F.lit(1.1)).alias("free_rev"),
        )
    )


def inflow_type(legacy_types: Mapping[str, Sequence[int]]) -> Column:
    """Inflow label; listed legacy consultations come before the channel code."""
    channel, legacy = F.col("inflowchannel"), F.col("legacyconsultationid")
    by_channel = (
        F.when(channel.isin(*SIMPLE_CHANNELS), SIMPLE)
        .when(channel.isin(*LISTING_CHANNELS), LISTING)
        .when(channel == STORE_CHANNEL, STORE)
        .otherwise(channel.cast("string"))
    )
    for label, ids in reversed(list(legacy_types.items())):
        by_channel = F.when(legacy.isin(*ids), label).otherwise(by_channel)
    return by_channel


def contract_scale() -> Column:
    """Scale label; a missing scale is read off the expert's registered expertises."""
    scale = F.col("expertise.scale")
    missing = scale == SCALE_MISSING
    return (
        F.when((scale == 0) | (missing & F.col("does_whole")), SCALE_WHOLE)
        .when((scale == 1) | (missing & ~F.col("does_whole") & ~F.col("does_cafe")), SCALE_PART)
        .when((scale == 2) | (missing & F.col("does_cafe")), SCALE_CAFE)
        .otherwise(scale.cast("string"))
    )


def flatten_contracts(
    steps: DataFrame, expertises: DataFrame, legacy_types: Mapping[str, Sequence[int]], zone_hours: int = 9
) -> DataFrame:
    """Inspected contracts as flat rows with local dates, inflow type and scale.

    Test users drop, and so do users without a name, as a null fails every ``not like``.
    """
    name = F.col("user.name")
    kept = steps.filter(F.col("contract.inspecteddate").isNotNull() & ~F.lower(name).like(TEST_NAME_LOWER))
    for pattern in TEST_NAMES:
        kept = kept.filter(~name.like(pattern))
    values = {"does_whole": EXPERTISE_WHOLE, "does_cafe": EXPERTISE_CAFE}
    keyed = kept.withColumn("expert", F.col("expertuser._id"))
    flagged = has_related(keyed, expertises, "expert", "expert_user_id", "expertise", values)
    return flagged.select(
        iso_utc_to_local_date("contract.inspecteddate", zone_hours).alias("dt_contract"),
        iso_utc_to_local_date("createdat", zone_hours).alias("dt_match"),
        iso_utc_to_local_date("contract.modifieddownpaymentupdateddate", zone_hours).alias("modified_date"),
        F.col("_id.oid").alias("consultation_id"),
        F.col("legacyconsultationid").cast("string").alias("legacy_consultation_id"),
        F.coalesce("contract.downpayment", F.lit(0)).alias("downpayment"),
        F.coalesce("contract.modifieddownpayment", F.lit(0)).alias("modifieddownpayment"),
        F.col("user._id").alias("user_id"),
        F.col("user.name").alias("user_name"),
        F.col("user.phonenumber").alias("phone_number"),
        inflow_type(legacy_types).alias("type"),
        F.col("expert").alias("expert_user_id"),
        contract_scale().alias("scale"),
        "status",
        F.when(F.col("status") == STATUS_CANCELLED, CANCELLED_LABEL).otherwise(NORMAL_LABEL).alias("correct_yn"),
    )


def recognise_contracts(
    contracts: DataFrame, cutover_month: str, first_day: dt.date, as_of: dt.date
) -> DataFrame:
    """Originals on the contract date, adjustments on the date of the change.

    Adjustments up to and including ``cutover_month`` (``yyyyMM``) go back to the contract
    date. An adjustment that brings a contract to zero counts it as minus one. Only days
    from ``first_day`` to before ``as_of`` are recognised.
    """
    total = F.col("downpayment") + F.col("modifieddownpayment")
    changed = F.coalesce("modified_date", "dt_contract")
    adjusts = F.col("_adjusts")
    back = ~adjusts | F.coalesce(month_key(changed) <= cutover_month, F.lit(False))
    # a contract gives its original row and, if it was changed, an adjustment: one pass and one sum for both
    both = contracts.withColumn(
        "_adjusts",
        F.explode(
            F.when(F.col("modifieddownpayment") != 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        ),
    ).select(
        "_adjusts",
        F.when(back, F.col("dt_contract")).otherwise(changed).alias("base_date"),
        "dt_contract",
        F.when(adjusts, changed).alias("_changed"),
        "scale",
        "type",
        F.when(adjusts, F.col("modifieddownpayment")).otherwise(F.col("downpayment")).alias("_amount"),
        F.when(F.when(adjusts, total == 0).otherwise(F.col("downpayment") > 0), F.col("consultation_id")).alias("_counted"),
    )
    recognised = both.filter((F.col("base_date") < as_date(as_of)) & (F.col("base_date") >= as_date(first_day)))
    sums = recognised.groupBy("_adjusts", "base_date", "dt_contract", "_changed", "scale", "type").agg(
        F.countDistinct("_counted").alias("_n"), F.sum("_amount").alias("_amount")
    )
    return sums.select(
        "base_date",
        "scale",
        "type",
        F.when(adjusts, 0).otherwise(F.col("_n")).alias("contract_count"),
        F.when(adjusts, -F.col("_n")).otherwise(0).alias("adj_contract_count"),
        F.when(adjusts, 0).otherwise(F.col("_amount")).alias("downpayment"),
        F.when(adjusts, F.col("_amount")).otherwise(0).alias("modifieddownpayment"),
    )


def gmv_summary(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Original, adjusted and total amounts and counts by month, week, scale and type."""
    week = week_of_day(calendar)
    return (
        df.join(week, F.col("base_date") == F.col("_date"), "left")
        .groupBy(month_key("base_date").alias("yyyymm"), "first_of_week", "scale", "type")
        .agg(
            F.sum("downpayment").alias("gmv_org"),
            F.sum("modifieddownpayment").alias("gmv_adj"),
            F.sum(F.col("downpayment") + F.col("modifieddownpayment")).alias("gmv"),
            F.sum("contract_count").alias("contract_count_org"),
            F.sum("adj_contract_count").alias("contract_count_adj"),
            F.sum(F.col("contract_count") + F.col("adj_contract_count")).alias("contract_count"),
        )
    )
