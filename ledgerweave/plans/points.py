"""Point reports: control total, balance check, origin report, departments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators import ledger
from ledgerweave.operators import points as ops
from ledgerweave.session import materialise

POINTS, DETAILS = "dump_point.points", "dump_point.point_details"
SELLERS, TYPES = "temp.fin_non_3p_seller_current", "finance.mileage_point_type_mapping"


def point_control_total(tables: Mapping[str, DataFrame], service_id: str) -> DataFrame:
    """What the origin report must add up to, by version and process type."""
    p = tables[POINTS].filter((F.col("point_type") == ops.POINT) & (F.col("service_id") == service_id))
    return ledger.control_total(p, ["version", "process_type"], "amount").orderBy(
        F.col("version").asc_nulls_last(), F.col("process_type").asc_nulls_last()
    )


def point_balance_difference(tables: Mapping[str, DataFrame], service_id: str) -> DataFrame:
    """Users whose ledger sum differs from their balance, and whether they have left."""
    in_service = F.col("service_id") == service_id
    return ledger.reconcile_with_flag(
        tables[POINTS].filter(in_service),
        tables["dump_point.user_points"].filter(in_service),
        tables["dump.users"],
        "user_id",
        "amount",
        "balance",
        "id",
        "id",
        "withdrawal",
    )


def _shared_rows(
    tables: Mapping[str, DataFrame], service_id: str, as_of: dt.date, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    options_biz = ops.option_biz(tables["dump.order_options"], tables["dump.order_productions"], tables[SELLERS])
    # first accumulations, rows and legacy origins all look the option of a point up: found and written once
    points = materialise(ops.with_option_biz(tables[POINTS], options_biz), "points", codec="zstd")
    first = ops.first_accumulation(points, tables[DETAILS], options_biz, tables[TYPES])
    rows = ops.point_rows(
        points,
        tables[DETAILS],
        first,
        tables["finance.fin_mileage_histories_d"],
        options_biz,
        tables[TYPES],
        service_id,
        as_of,
    )
    shared = ops.share_points(rows, sums)
    return shared if sums else shared.withColumn("accum_biz", ops.accum_biz())


def point_origin_rows(
    tables: Mapping[str, DataFrame], service_id: str, as_of: dt.date, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Point rows with their origin and the shared-out amount, or ``sums`` of them by point and detail.

    Rows and shares are the same either way; sums by point and detail read no report key, so none is moved for them.
    """
    shared = _shared_rows(tables, service_id, as_of, sums)
    return shared.select("point_id", "detail_id", *sums) if sums else ops.point_labels(shared)


def point_report(tables: Mapping[str, DataFrame], service_id: str, as_of: dt.date) -> DataFrame:
    # the labels follow from the keys one to one: they are written out for the sums only
    return ops.point_labels(ops.point_summary(_shared_rows(tables, service_id, as_of), keys=ops.TERM_KEYS, counted="counted"))


def point_departments(
    tables: Mapping[str, DataFrame],
    service_id: str,
    snapshot_day: str = "2022-12-01",
    first_day: dt.date = dt.date(2019, 1, 1),
) -> DataFrame:
    """Points granted and withdrawn by department, per month and week."""
    biz = ops.point_biz(
        tables[POINTS],
        tables["dump.order_options"],
        tables["dump.order_productions"],
        tables["dump.order_options_l"],
        tables["dump.order_productions_l"],
        tables[SELLERS],
        snapshot_day,
    )
    # the points and the origins of their details both look the business up: five joins, written once
    biz = materialise(biz, "point-business")
    first = ops.first_category(tables[POINTS], tables[DETAILS], biz)
    rows = ops.point_department_rows(
        tables[POINTS], tables[DETAILS], biz, first, tables[TYPES], service_id, first_day
    )
    return ops.point_measures(rows, tables["ba_preserved.calendar"]).orderBy(
        "tran_mm", "first_of_week", F.col("department").asc_nulls_last()
    )
