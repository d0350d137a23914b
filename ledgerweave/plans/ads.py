"""Product advertising: revenue, agency fee, mapping guard, contacts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators import ads, contacts, intervals

AGENCY_MAPPING = "finance.fin_seller_agency_code_mapping"
START, STOP = "1", "0"


def agency_intervals(mapping: DataFrame, open_end: dt.date) -> DataFrame:
    events = mapping.withColumn("_day", F.col("dt").cast("date"))
    return intervals.build_intervals(
        events, ["seller_id", "agency"], "_day", F.col("type") == START, F.col("type") == STOP, open_end
    )


def ad_product_revenue(tables: Mapping[str, DataFrame], first_day: dt.date = dt.date(2022, 4, 1)) -> DataFrame:
    clicks = ads.normalise_ad_ledger(tables["advertise.ad-ledger"], first_day=first_day)
    return ads.ad_revenue(clicks, tables["ba_preserved.calendar"], first_day).orderBy("yyyymm", "first_of_week")


def ad_agency_fee(
    tables: Mapping[str, DataFrame], as_of: dt.date, open_end: dt.date = dt.date(2999, 12, 31)
) -> DataFrame:
    """Agency fee by seller and day from 1 January of the year before ``as_of``.

    The partition date comes from the year/month/day columns, so no calendar join is needed.
    """
    clicks = ads.normalise_ad_ledger(tables["advertise.ad-ledger"], first_day=dt.date(as_of.year - 1, 1, 1))
    mapping = agency_intervals(tables[AGENCY_MAPPING], open_end)
    return ads.agency_fee(ads.daily_ad_spend(clicks), mapping)


def mapping_overlaps(
    tables: Mapping[str, DataFrame],
    first_day: dt.date,
    last_day: dt.date,
    open_end: dt.date = dt.date(3000, 1, 1),
) -> DataFrame:
    """Mappings of sellers that have two agencies on one calendar day: guard of the fee report."""
    mapping = agency_intervals(tables[AGENCY_MAPPING], open_end)
    return intervals.overlapping_intervals(mapping, "seller_id", "agency", first_day, last_day)


def sales_user_contacts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return contacts.contact_dim(
        tables["dump_freq.ad_user_properties_view"], tables["dump.sales_users"], tables["dump.users"]
    )
