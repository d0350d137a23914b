"""Discount settlement by payment, delivery and purchase confirmation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ledgerweave.operators import settlement as ops
from ledgerweave.session import Stages
from ledgerweave.sources.catalog import Catalog
from ledgerweave.sources.layout import ROOT_ORDER

Period = tuple[dt.date, dt.date]

COUPON = "finance.fin_coupon_order_options_settlement"
CART_COUPON = "finance.fin_coupon_cart_order_options_settlement"
MILEAGE = "finance.fin_mileage_order_options_settlement"
SALES = "dump_settlement_stage.order_sales_l"


def _cost_branches(
    tables: Mapping[str, DataFrame],
    milestone: ops.Milestone,
    coupon_table: str,
    sellers: Sequence[int] | None,
    period: Period,
    stages: Stages,
    mileage_quantity: str | None = None,
) -> list[DataFrame]:
    options = ops.seller_options(
        tables["dump.order_options"],
        tables["dump.order_productions"],
        tables["dump.orders"],
        milestone,
        sellers,
        end_day=period[1],
    )
    if ROOT_ORDER not in tables["dump.order_options"].columns:  # options of bucketed copies were not shuffled
        options = stages.write(options, "options", codec=ops.CODEC)
    costs = [
        (tables[coupon_table], "coupon_cost", "coupon_total", None),
        (tables[MILEAGE], "mileage_cost", "point_total", mileage_quantity),
    ]
    return [ops.settlement_branches(costs, options, milestone, *period)]


def _stage_branch(
    tables: Mapping[str, DataFrame],
    service_id: str,
    sellers: Sequence[int] | None,
    period: Period,
    by_delivery: bool,
    stages: Stages,
) -> DataFrame:
    names = ("payment_transactions", "payment_transaction_items", "payment_items", "payment_transaction_item_amounts")
    return ops.stage_payment_branch(
        *[tables[f"dump_payment_stage.{n}"] for n in names],
        tables["dump_stage.order_options"],
        tables["dump_stage.order_productions"],
        service_id,
        sellers,
        *period,
        by_delivery=by_delivery,
        with_key=True,
        stages=stages,
    )


def _stages(tables: Mapping[str, DataFrame], name: str) -> Stages:
    return Stages(tables["dump.orders"].sparkSession, name)


def payment_discounts(
    tables: Mapping[str, DataFrame],
    sellers: Sequence[int] | None,
    period: Period,
    stage_service: str,
    stage_sellers: Sequence[int] | None,
    stage_period: Period,
) -> DataFrame:
    """Discounts by payment date; ``None`` for sellers means all of them."""
    stages = _stages(tables, "payment-discounts")
    branches = _cost_branches(tables, ops.PAYMENT, COUPON, sellers, period, stages)
    branches.append(_stage_branch(tables, stage_service, stage_sellers, stage_period, False, stages))
    return ops.settlement_report(branches)


def delivery_discounts(
    tables: Mapping[str, DataFrame],
    sellers: Sequence[int] | None,
    period: Period,
    stage_service: str,
    stage_sellers: Sequence[int] | None,
    stage_period: Period,
    mileage_quantity: str = "payment_at",
) -> DataFrame:
    """Discounts by delivery date.

    Mileage quantity is counted against the payment date, as the source report does;
    ``mileage_quantity='delivery_complete_date'`` counts it like the coupon quantity.
    """
    stages = _stages(tables, "delivery-discounts")
    branches = _cost_branches(tables, ops.DELIVERY, COUPON, sellers, period, stages, mileage_quantity)
    branches.append(_stage_branch(tables, stage_service, stage_sellers, stage_period, True, stages))
    return ops.settlement_report(branches)


def purchase_confirm_discounts(
    tables: Mapping[str, DataFrame],
    sellers: Sequence[int] | None,
    period: Period,
    stage_sellers: Sequence[int] | None,
    stage_period: Period,
) -> DataFrame:
    """Discounts by purchase-confirm date with the settlement round."""
    stages = _stages(tables, "confirm-discounts")
    branches = _cost_branches(tables, ops.CONFIRM, CART_COUPON, sellers, period, stages)
    branches.append(
        ops.stage_settlement_branch(
            tables[SALES],
            tables["dump_settlement_stage.discount_price_detail_l"],
            stage_sellers,
            *stage_period,
            newest=tables.newest(SALES, "base_dt") if isinstance(tables, Catalog) else None,
            with_key=True,
            stages=stages,
        )
    )
    return ops.settlement_report(branches, with_round=True)
