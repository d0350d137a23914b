"""Report jobs composed from the operators.

Every job takes ``tables``, a mapping of source table name to DataFrame (a ``Catalog``
or a plain dict), and its dates, ids and service names as parameters.
"""

from ledgerweave.plans.ads import ad_agency_fee, ad_product_revenue, mapping_overlaps, sales_user_contacts
from ledgerweave.plans.cohorts import user_cohort
from ledgerweave.plans.commerce import agency_funding, commerce_pnl, commerce_raw, mapping_validation
from ledgerweave.plans.marketing import marketing_expense
from ledgerweave.plans.orders import option_issues, options_without_status
from ledgerweave.plans.points import (
    point_balance_difference,
    point_control_total,
    point_departments,
    point_report,
)
from ledgerweave.plans.services import moving_revenue, remodeling_gmv, request_code_map
from ledgerweave.plans.settlements import delivery_discounts, payment_discounts, purchase_confirm_discounts

__all__ = [
    "ad_agency_fee",
    "ad_product_revenue",
    "agency_funding",
    "commerce_pnl",
    "commerce_raw",
    "delivery_discounts",
    "mapping_overlaps",
    "mapping_validation",
    "marketing_expense",
    "moving_revenue",
    "option_issues",
    "options_without_status",
    "payment_discounts",
    "point_balance_difference",
    "point_control_total",
    "point_departments",
    "point_report",
    "purchase_confirm_discounts",
    "remodeling_gmv",
    "request_code_map",
    "sales_user_contacts",
    "user_cohort",
]
