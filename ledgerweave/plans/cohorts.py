"""Purchase cohorts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ledgerweave.operators import cohort


def user_cohort(tables: Mapping[str, DataFrame], overrides: Mapping[int, str] | None = None) -> DataFrame:
    """Cohort matrix; ``overrides`` sets the first month of users whose history is known to be wrong."""
    totals = cohort.user_month_totals(tables["ba_preserved.mkt_arppu_summary"])
    firsts = cohort.first_order_month(totals, overrides or {})
    return cohort.cohort_matrix(firsts).orderBy("yyyymm", "order_mm", "month_diff")
