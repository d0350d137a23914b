"""Order and limit: the reports whose source is ordered, row by row in the order in which they come.

Each query numbers the rows of a report as the report yields them; the oracle numbers its own rows by the
order that the source names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import jobs  # noqa: F401 - registers the reports
from checks.derive import Derived
from checks.registry import ORACLES, QUERIES, register
from ledgerweave import plans
from ledgerweave.operators.numbering import keep_order

ORDERS = {
    "option_issues": "order_id, option_id",
    "point_control_total": "version, process_type",
    "agency_funding": "yyyymm, first_of_week, logisticstype, cate_name",
    "marketing_expense": "base_m, first_of_week",
    "point_departments": "tran_mm, first_of_week, department",
    "moving_revenue": "yyyymm, first_of_week",
    "remodeling_gmv": "yyyymm, first_of_week, scale, type",
    "ad_revenue": "yyyymm, first_of_week",
    "user_cohort": "yyyymm, order_mm, month_diff",
    "commerce_pnl": "yyyymm, first_of_week, biz, category",
}


def numbered(sql: str, order: str) -> str:
    """The oracle's rows with their place under ``order``, nulls last."""
    by = ", ".join(f"{c.strip()} NULLS LAST" for c in order.split(","))
    return f"SELECT *, row_number() OVER (ORDER BY {by}) AS position FROM (\n{sql}\n)"


def _in_order(job: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return keep_order(QUERIES[job](spark, sf_dir), "position")

    run.__doc__ = f"``{job}`` with the place of each row in the report."
    return run


for _job, _order in ORDERS.items():
    register(f"{_job}_in_order", numbered(ORACLES[_job], _order))(_in_order(_job))

FIRST_ROWS = 1000
_WITH_IDS = ORACLES["options_without_status"].replace(
    "SELECT q.id, x.id AS option_id", "SELECT c.id AS cancel_id, e.id AS exchange_id, q.id, x.id AS option_id", 1
)


@register(
    "options_without_status_first",
    f"""
    SELECT * EXCLUDE (cancel_id, exchange_id) FROM (
        {numbered(_WITH_IDS, "id, option_id, cancel_id, exchange_id")}
    ) WHERE position <= {FIRST_ROWS}
    """,
)
def options_without_status_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the list in its full order, as the source's limit asks."""
    return keep_order(plans.options_without_status(Derived(spark, sf_dir), max_rows=FIRST_ROWS), "position")
