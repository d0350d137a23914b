"""Marketing expense."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators import marketing, spread


def marketing_expense(tables: Mapping[str, DataFrame], as_of: dt.date) -> DataFrame:
    """Fixed months, provisional days after them, and free cash spread over elapsed days."""
    calendar = tables["ba_preserved.calendar"]
    later, fixed = marketing.provisional_fixed(tables["ba_preserved.mkt_cost_d"], tables["ba_preserved.mkt_cost_m"])
    cash = spread.spread_elapsed(
        tables["temp.fin_mkt_freecash"], calendar, as_of, "yyyymmdd", "value", "daily_freecash"
    )
    rows = marketing.marketing_measures(later, fixed, cash, calendar)
    return marketing.marketing_summary(rows).orderBy(
        F.col("base_m").asc_nulls_last(), F.col("first_of_week").asc_nulls_last()
    )
