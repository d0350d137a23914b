"""Order option quality: options stuck in a state, options without one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import as_date, elapsed_days, month_key
from ledgerweave.operators import orders as ops
from ledgerweave.operators.contacts import SALES_USER
from ledgerweave.operators.dedupe import latest_per_key
from ledgerweave.operators.lookup import label_of


def _paid_options(tables: Mapping[str, DataFrame], before: dt.date | None, only_missing_status: bool) -> DataFrame:
    """Options of paid orders with their production; filters sit on the raw columns of each scan."""
    paid = ops.paid_orders(tables["dump.orders"])
    if before is not None:
        paid = paid.filter(F.col("payment_at") < as_date(before).cast("timestamp_ntz"))
    o = paid.select(
        F.col("id").alias("_order_id"), F.col("id").alias("order_id"), "payment_at", "created_at", "imp_uid", "merchant_uid"
    )
    p = tables["dump.order_productions"].select(
        F.col("id").alias("_production"), F.col("order_id").alias("_order"), "seller_id", "production_id", "delivery_method"
    )
    open_status = F.col("status").isNull()
    if not only_missing_status:
        open_status = open_status | ~F.col("status").isin(*ops.FINAL_STATUS)
    oo = tables["dump.order_options"].filter(open_status).withColumnRenamed("id", "option_id")
    return ops.join_hierarchy(oo, p, o)


def _newest(df: DataFrame, prefix: str) -> DataFrame:
    order = [F.col("updated_at").desc_nulls_last(), F.col("id").desc_nulls_last()]
    return latest_per_key(df, ["order_option_id"], order).select(
        F.col("order_option_id").alias(f"_{prefix}"),
        F.col("status").alias(f"{prefix}_code"),
        F.col("updated_at").alias(f"{prefix}_updated_at"),
    )


def option_issues(
    tables: Mapping[str, DataFrame],
    as_of: dt.date,
    before: dt.date = dt.date(2022, 4, 1),
    first_party_seller: int | None = None,
    link_prefix: str = "",
) -> DataFrame:
    """Paid options not in a final state, with ages and the action to take."""
    c = F.col
    sellers = tables["temp.fin_non_3p_seller_current"].select(c("seller_id").cast("bigint").alias("_sid"), "biz")
    products = tables["dump.productions"].select(
        c("id").alias("_pid"), "user_id", c("need_customer_number").alias("is_foreign"), "admin_category_id"
    )
    users = tables["dump.users"].filter(c("userable_type") == SALES_USER).select(c("id").alias("_uid"), "userable_id")
    companies = tables["dump.sales_users"].select(c("id").alias("_cid"), "company")
    root = F.trim(F.split_part("full_display_name", F.lit(">"), F.lit(1)))
    rentals = tables["dump.admin_categories"].filter(root == ops.RENTAL_ROOT).select(c("id").alias("_rental"))
    joined = (
        _paid_options(tables, before, only_missing_status=False)
        .join(sellers, c("seller_id") == c("_sid"), "left")
        .join(products, c("production_id") == c("_pid"), "left")
        .join(users, c("user_id") == c("_uid"), "left")
        .join(companies, c("userable_id") == c("_cid"), "left")
        .join(rentals, c("admin_category_id") == c("_rental"), "left")
        .join(_newest(tables["dump.order_option_cancels"], "cancel"), c("option_id") == c("_cancel"), "left")
        .join(_newest(tables["dump.order_option_exchanges"], "exch"), c("option_id") == c("_exch"), "left")
        .withColumns(
            {
                "is_rental": c("_rental").isNotNull(),
                "is_zero": c("selling_cost") == 0,
                "is_seller_delivery": c("delivery_method") == 1,
                "is_premium": F.coalesce(c("biz").isin(*ops.PREMIUM_BIZ), F.lit(False)),
                "payment_since": elapsed_days("payment_at", as_of),
            }
        )
    )
    issues = ops.classify_issue(joined, ops.issue_rules(as_of, first_party_seller), ops.ISSUE["undefined"])
    aged = ops.age_days(issues, "payment_at", as_of, "foreign_since", c("is_foreign"))
    aged = ops.age_days(aged, "confirm_order_date", as_of, "premium_since", c("is_premium"))
    aged = ops.age_days(aged, "cancel_updated_at", as_of, "cancel_since", (c("cancel_code") == 0) & (c("status") == 6))
    aged = ops.age_days(aged, "exch_updated_at", as_of, "exch_since", (c("exch_code") == 0) & (c("status") == 7))
    return aged.select(
        F.concat(F.lit(link_prefix), c("order_id").cast("string")).alias("order_link"),
        month_key("payment_at").alias("pay_mm"),
        "imp_uid",
        "merchant_uid",
        "order_id",
        "option_id",
        "seller_id",
        "company",
        "payment_since",
        "is_foreign",
        "foreign_since",
        "is_rental",
        "is_zero",
        "is_seller_delivery",
        "is_premium",
        "premium_since",
        label_of(c("status"), ops.OPTION_STATUS, "NULL").alias("option_status"),
        label_of(c("cancel_code"), ops.CANCEL_STATUS).alias("cancel_status"),
        "cancel_since",
        label_of(c("exch_code"), ops.EXCHANGE_STATUS).alias("exch_status"),
        "exch_since",
        "option_issue",
        c("payment_at").cast("date").alias("payment_dt"),
        c("confirm_order_date").cast("date").alias("confirm_order_dt"),
        c("delivery_start_date").cast("date").alias("delivery_start_dt"),
        c("delivery_complete_date").cast("date").alias("delivery_complete_dt"),
        c("purchase_confirm_date").cast("date").alias("purchase_confirm_dt"),
        c("calculate_date").cast("date").alias("calculate_dt"),
        "is_calculated",
        "selling_cost",
    ).orderBy("order_id", "option_id")


def options_without_status(tables: Mapping[str, DataFrame], max_rows: int | None = None) -> DataFrame:
    """Paid options with a null status and the status their dates imply.

    All cancels and exchanges of an option are listed, so options repeat. All rows are
    returned; ``max_rows`` keeps the first ones of the order, as the source report does with 3000.
    """
    c = F.col

    def all_of(name: str, prefix: str) -> DataFrame:
        return tables[name].select(
            c("order_option_id").alias(f"_{prefix}"),
            c("status").alias(f"{prefix}_code"),
            c("updated_at").alias(f"{prefix}_updated_at"),
            c("id").alias(f"_{prefix}_id"),
        )

    joined = (
        _paid_options(tables, None, only_missing_status=True)
        .join(all_of("dump.order_option_cancels", "cancel"), c("option_id") == c("_cancel"), "left")
        .join(all_of("dump.order_option_exchanges", "exchange"), c("option_id") == c("_exchange"), "left")
    )
    ordered = ops.infer_status(joined).orderBy(
        c("order_id"), c("option_id"), c("_cancel_id").asc_nulls_last(), c("_exchange_id").asc_nulls_last()
    )
    if max_rows is not None:
        ordered = ordered.limit(max_rows)
    return ordered.select(
        c("order_id").alias("id"),
        "option_id",
        c("created_at").alias("order_created_at"),
        "payment_at",
        "confirm_order_date",
        "delivery_start_date",
        "delivery_complete_date",
        "purchase_confirm_date",
        c("cancel_code").alias("cancel_status"),
        "cancel_updated_at",
        c("exchange_code").alias("exchange_status"),
        "exchange_updated_at",
        "should_be_option_status",
    )
