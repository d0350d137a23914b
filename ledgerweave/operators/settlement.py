"""Discount settlement by payment, delivery or purchase-confirm date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import as_date, greatest_strict, iso_day, month_key, round0
from ledgerweave.operators.orders import first_match, join_hierarchy
from ledgerweave.session import Stages
from ledgerweave.sources.layout import ROOT_ORDER

# --- Fixed values: labels of the settlement kinds and rounds -------------------------
MANUAL_JOB = "manual_correction"
KIND_MANUAL = "할인금액보정"
KIND_RECALCULATED = "할인금액재계산"
KIND_PAID = "결제완료"
KIND_PAID_CANCELLED = "결제완료후취소"
KIND_DELIVERED = "배송완료"
KIND_DELIVERED_CANCELLED = "배송완료후취소"
KIND_CONFIRMED = "구매확정"
KIND_CONFIRMED_CANCELLED = "구매확정후취소"
KIND_STAGE_CANCELLED = "결제취소"
SHIPPING_NAME = "배송비"
ROUND_FIRST = "1차"
ROUND_SECOND = "2차"
ROUND_LAST_DAY = 14
PRODUCT_COUPON = "PRODUCT_COUPON"
STAGE_CONFIRMED = "PURCHASE_CONFIRMED"

BRANCH_KEYS = [
    "base_dt",
    "kind",
    "seller_id",
    "order_id",
    "order_option_id",
    "product_id",
    "product_option_id",
    "product_name",
    "option_name",
    "payment_date",
    "delivery_complete_date",
    "purchase_confirm_date",
]
# the option's number, by which the branches deal their rows; it follows from order_option_id
OPTION_KEY = "_option"
CODEC = "zstd"  # of tables between the steps
TAG_BITS = 8  # under the day of a booking: six for its cost table, two flags
REPORT_KEYS = [
    "base_dt",
    "kind",
    "order_id",
    "order_option_id",
    "product_name",
    "option_name",
    "product_id",
    "product_option_id",
]


@dataclass(frozen=True)
class Milestone:
    """Which date recognises a discount, which options count, and what the kinds are called."""

    column: str
    statuses: tuple[int, ...] | None
    reached: str
    cancelled: str


PAYMENT = Milestone("payment_at", (1, 2, 3, 4, 5, 6, 7), KIND_PAID, KIND_PAID_CANCELLED)
DELIVERY = Milestone("delivery_complete_date", (4, 5), KIND_DELIVERED, KIND_DELIVERED_CANCELLED)
CONFIRM = Milestone("purchase_confirm_date", None, KIND_CONFIRMED, KIND_CONFIRMED_CANCELLED)


def recognised_date(base: str, milestone: str) -> Column:
    """The later of booking time and milestone as a date; null when either is missing."""
    return greatest_strict(F.col(base), F.col(milestone)).cast("date")


def settlement_kind(milestone: Milestone, manual: Column, booked: Column, cancel: Column) -> Column:
    """Manual correction, booked by the milestone's day, cancel after it, or recalculated."""
    return first_match(
        [
            (manual, KIND_MANUAL),
            (booked <= F.col(milestone.column).cast("date"), milestone.reached),
            (cancel, milestone.cancelled),
        ],
        KIND_RECALCULATED,
    )


def seller_options(
    options: DataFrame,
    productions: DataFrame,
    orders: DataFrame,
    milestone: Milestone,
    seller_ids: Sequence[int] | None,
    end_day: dt.date | None = None,
) -> DataFrame:
    """Options of the sellers with their product and order; the seller filter comes first.

    A discount is recognised no earlier than its milestone, so with ``end_day`` later milestones
    are left out by the scan of the table that has them.
    """
    if end_day is not None:
        holder = options if milestone.column in options.columns else orders
        reached = holder.filter(F.col(milestone.column) < as_date(end_day).cast("timestamp_ntz"))
        options, orders = (reached, orders) if holder is options else (options, reached)
    if seller_ids is not None:
        productions = productions.filter(F.col("seller_id").isin(*seller_ids))
    if milestone.statuses is not None:
        options = options.filter(F.col("status").isin(*milestone.statuses))
    o = options.select(
        F.col("id").alias("option_id"),
        "order_production_id",
        F.col("reference_option_id").alias("product_option_id"),
        F.col("explain").alias("option_name"),
        F.col("count").alias("option_count"),
        "delivery_complete_date",
        "purchase_confirm_date",
        *[c for c in options.columns if c == ROOT_ORDER],
    )
    p = productions.select(
        F.col("id").alias("_production"),
        F.col("order_id").alias("_order"),
        "seller_id",
        F.col("production_id").alias("product_id"),
        F.col("name").alias("product_name"),
    )
    d = orders.select(F.col("id").alias("_order_id"), "payment_at")
    return join_hierarchy(o, p, d).filter(F.col(milestone.column).isNotNull()).drop("order_production_id")


def settlement_branches(
    costs: Sequence[tuple[DataFrame, str, str, str | None]],
    options: DataFrame,
    milestone: Milestone,
    first_day: dt.date,
    end_day: dt.date,
) -> DataFrame:
    """Discounts per option, day and kind in ``[first_day, end_day)``, as negative amounts.

    Each entry of ``costs`` is a table, its cost column, the amount's name in the result and the
    milestone its quantity counts against (rows booked no later; the milestone itself if None).
    The tables are stacked, so ``options`` (from ``seller_options``) are joined once; a row of the
    result carries the amount of one of them, the others are zero. Groups that net to zero
    drop. The upper bound is repeated on the plain booking time so that the scans can use it.
    ``OPTION_KEY`` stays in the result: rows lie by it from the join on and are grouped there.
    """
    def flag(condition: Column, bit: int) -> Column:
        return F.when(condition, bit).otherwise(0)  # null counts as false, as in ``settlement_kind``

    def packed(set_: int) -> Column:
        day = F.shiftleft(F.unix_date(F.col("base_dttm").cast("date")), TAG_BITS)
        return day + flag(F.col("batch_job") == MANUAL_JOB, 2) + flag(F.col("kind") == -1, 1) + F.lit(set_ << 2)

    given, ordered = F.col("order_option_id").cast("string"), F.col("order_id").cast("string")
    number, order = F.col("order_option_id").cast("bigint"), ordered.try_cast("bigint")
    booked = [
        df.filter(F.col("base_dttm") < as_date(end_day).cast("timestamp_ntz")).select(
            # only the day of booking decides, so a row is shuffled as four numbers: the day, its set and
            # two flags in one of them, and texts only where a number is spelled otherwise
            packed(i).alias("_tag"),
            number.alias(OPTION_KEY),
            order.alias("_order"),
            F.when(given != number.cast("string"), given).alias("_spelled"),
            F.when(~ordered.eqNullSafe(order.cast("string")), ordered).alias("_order_spelled"),
            F.col(cost).alias("_cost"),
        )
        for i, (df, cost, _, _) in enumerate(costs)
    ]
    dates = ("payment_at", "delivery_complete_date", "purchase_confirm_date")
    # no discount is recognised before its milestone, so the bound holds for that as well, also in a written table
    options = options.filter(F.col(milestone.column) < as_date(end_day).cast("timestamp_ntz"))
    options = options.withColumns({c: F.col(c).cast("date") for c in dates})
    joined = reduce(DataFrame.unionByName, booked).join(options, F.col(OPTION_KEY) == F.col("option_id"))
    joined = joined.withColumns(
        {
            "_set": F.shiftright("_tag", 2).bitwiseAND((1 << TAG_BITS - 2) - 1),
            "_booked": F.date_from_unix_date(F.shiftright("_tag", TAG_BITS)),
            "_manual": F.col("_tag").bitwiseAND(2) != 0,
            "_cancel": F.col("_tag").bitwiseAND(1) != 0,
            "order_id": F.coalesce("_order_spelled", F.col("_order").cast("string")),
        }
    )
    counts_to = F.coalesce(
        *[F.when(F.col("_set") == i, F.col(q or milestone.column)) for i, (_, _, _, q) in enumerate(costs)]
    )
    counted_at = F.col("_booked") <= counts_to.cast("date")
    day = recognised_date("_booked", milestone.column)
    return (
        joined.withColumns(
            {
                "_day": day,
                "order_option_id": F.coalesce("_spelled", F.col(OPTION_KEY).cast("string")),
            }
        )
        .filter((F.col("_day") >= as_date(first_day)) & (F.col("_day") < as_date(end_day)))
        .select(
            "_set",
            OPTION_KEY,
            F.col("_day").cast("string").alias("base_dt"),
            settlement_kind(milestone, F.col("_manual"), F.col("_booked"), F.col("_cancel")).alias("kind"),
            "seller_id",
            "order_id",
            "order_option_id",
            "product_id",
            "product_option_id",
            "product_name",
            "option_name",
            iso_day("payment_at").alias("payment_date"),
            iso_day("delivery_complete_date").alias("delivery_complete_date"),
            iso_day("purchase_confirm_date").alias("purchase_confirm_date"),
            "_cost",
            F.when(counted_at, F.col("option_count")).otherwise(0).alias("_qty"),
        )
        .groupBy("_set", OPTION_KEY, *BRANCH_KEYS)
        .agg(F.sum("_cost").alias("_cost"), F.sum("_qty").alias("quantity"))
        .filter(F.col("_cost") != 0)
        .select(
            OPTION_KEY,
            *BRANCH_KEYS,
            "quantity",
            *[F.when(F.col("_set") == i, -F.col("_cost")).otherwise(0).alias(out) for i, (_, _, out, _) in enumerate(costs)],
        )
    )


def settlement_branch(
    costs: DataFrame,
    options: DataFrame,
    milestone: Milestone,
    cost_col: str,
    amount_out: str,
    first_day: dt.date,
    end_day: dt.date,
    quantity_milestone: str | None = None,
) -> DataFrame:
    """``settlement_branches`` of one cost table."""
    return settlement_branches(
        [(costs, cost_col, amount_out, quantity_milestone)], options, milestone, first_day, end_day
    ).drop(OPTION_KEY)


def stage_payment_branch(
    transactions: DataFrame,
    transaction_items: DataFrame,
    items: DataFrame,
    amounts: DataFrame,
    options: DataFrame,
    productions: DataFrame,
    service_id: str,
    seller_ids: Sequence[int] | None,
    first_day: dt.date,
    end_day: dt.date,
    by_delivery: bool = False,
    with_key: bool = False,
    stages: Stages | None = None,
) -> DataFrame:
    """Product-coupon amounts of the staged payment tables by transaction date.

    Only rows that reach an option of a wanted seller can pass, so the chain is inner joins.
    Coupon amounts are summed per item and transaction before they meet the chain, and only
    coupon rows are read: other methods add zero. ``by_delivery`` filters by delivery date
    instead, keeping delivered options only, while the day stays that of the transaction.
    The options come last, so their texts are shuffled once and the groups form where that join
    has dealt them, by ``OPTION_KEY``, which ``with_key`` keeps. With ``stages`` the options and the
    payments are written before they meet, and what dealt them is gone by then.
    """
    lo, hi = as_date(first_day).cast("timestamp_ntz"), as_date(end_day).cast("timestamp_ntz")
    t = transactions.filter(F.col("service_id") == service_id)
    o = options
    if by_delivery:
        done = F.col("delivery_complete_date")
        o = o.filter((done >= lo) & (done < hi) & F.col("status").isin(*DELIVERY.statuses))
    else:
        t = t.filter((F.col("transaction_at") >= lo) & (F.col("transaction_at") < hi))
    p = productions if seller_ids is None else productions.filter(F.col("seller_id").isin(*seller_ids))
    p = p.filter(F.col("seller_id").isNotNull()).select(
        F.col("id").alias("product_id"), "seller_id", F.coalesce("name", F.lit(SHIPPING_NAME)).alias("product_name")
    )
    o = o.select(
        F.col("id").alias("_option_id"),
        F.col("order_production_id").alias("_production"),
        F.col("reference_option_id").alias("product_option_id"),
        F.col("explain").alias("option_name"),
        iso_day("delivery_complete_date").alias("delivery_complete_date"),
        iso_day("purchase_confirm_date").alias("purchase_confirm_date"),
    ).join(p, F.col("_production") == F.col("product_id")).drop("_production")
    coupon = (
        amounts.filter(F.col("payment_method_type") == PRODUCT_COUPON)
        .groupBy("payment_item_id", "transaction_id")
        .agg(F.sum("amount").alias("_amount"))
    )
    # a reference is an option's id as text: other texts, and other spellings of the number, match none
    number = F.col("item_reference_id").try_cast("bigint")
    references = items.select(
        "payment_item_id", F.col("item_reference_id").alias("order_option_id"), number.alias(OPTION_KEY)
    ).filter(F.col(OPTION_KEY).cast("string") == F.col("order_option_id"))
    kind = F.when(F.col("transaction_type") == "PAYMENT", KIND_PAID).when(
        F.col("transaction_type") == "CANCEL", KIND_STAGE_CANCELLED
    )
    paid = (
        t.select("payment_id", "transaction_id", "transaction_at", "transaction_type", "order_id")
        .join(transaction_items.select("payment_id", "transaction_id", "payment_item_id"), ["payment_id", "transaction_id"])
        .join(coupon, ["payment_item_id", "transaction_id"])
        .join(references, "payment_item_id")
        .drop("payment_item_id", "payment_id", "transaction_id")
    )
    if stages is not None:
        o, paid = stages.write(o, "staged-options", codec=CODEC), stages.write(paid, "staged-payments", codec=CODEC)
    return (
        paid.join(o, F.col(OPTION_KEY) == F.col("_option_id"))
        .withColumns(
            {
                "base_dt": F.col("transaction_at").cast("date").cast("string"),
                "kind": kind,
                "order_id": F.col("order_id").cast("string"),
                "payment_date": iso_day("transaction_at"),
            }
        )
        .groupBy(OPTION_KEY, *BRANCH_KEYS)
        .agg(F.sum("_amount").alias("_amount"))
        .filter(F.col("_amount") != 0)
        .select(*([OPTION_KEY] if with_key else []), *BRANCH_KEYS, (-F.col("_amount")).alias("coupon_total"))
    )


def latest_snapshot(
    df: DataFrame, snapshot: str, source: DataFrame | None = None, newest: str | None = None
) -> DataFrame:
    """Rows of the newest snapshot (of ``source`` if given).

    ``newest`` names it where the caller knows it, as ``Catalog.newest`` does from folder names
    alone; else a scalar subquery over the snapshot column finds it and prunes partitions.
    """
    if newest is not None:
        return df.filter(F.col(snapshot) == newest)
    found = (source if source is not None else df).agg(F.max(snapshot).alias("s"))
    return df.filter(F.col(snapshot) == found.scalar())


def stage_settlement_branch(
    sales: DataFrame,
    details: DataFrame,
    seller_ids: Sequence[int] | None,
    first_day: dt.date,
    end_day: dt.date,
    newest: str | None = None,
    with_key: bool = False,
    stages: Stages | None = None,
) -> DataFrame:
    """Product-coupon amounts of the newest settlement snapshot.

    The amount keeps its sign here (the other branches negate). A sale counts its quantity
    once per settlement round it was booked in. ``with_key`` deals the rows by ``OPTION_KEY`` and keeps it;
    sales without an option are dealt by order and product. With ``stages`` the sales with their amounts are
    written first, and what dealt them is gone by then.
    """
    lo, hi = as_date(first_day).cast("timestamp_ntz"), as_date(end_day).cast("timestamp_ntz")
    s = latest_snapshot(sales, "base_dt", newest=newest).filter((F.col("recognized_at") >= lo) & (F.col("recognized_at") < hi))
    if seller_ids is not None:
        s = s.filter(F.col("seller_id").isin(*seller_ids))
    d = (
        latest_snapshot(details, "base_dt", source=sales, newest=newest)
        .filter(F.col("discount_type") == PRODUCT_COUPON)
        .groupBy(F.col("order_sales_id").alias("_sale"))
        .agg(F.sum("amount").alias("_amount"))
    )
    s = s.select(
        "id",
        F.col("recognized_at").cast("date").alias("_day"),
        (F.col("recognized_type") == STAGE_CONFIRMED).alias("_confirmed"),
        "order_id",
        "order_option_id",
        "product_name",
        "option_name",
        "product_id",
        F.col("option_id").alias("product_option_id"),
        "quantity",
        F.col("settlement_at").cast("date").alias("_settled_on"),
    )
    sold = s.join(d, F.col("id") == F.col("_sale")).drop("_sale", "id")
    if stages is not None:
        sold = stages.write(sold, "staged-sales", codec=CODEC)
    key = []
    if with_key:
        key = [OPTION_KEY]
        number = F.coalesce(F.col("order_option_id").cast("bigint"), F.xxhash64("order_id", "product_id"))
        sold = sold.withColumn(OPTION_KEY, number).repartition(OPTION_KEY)
    return (
        sold.groupBy(
            *key,
            F.col("_day").cast("string").alias("base_dt"),
            F.when(F.col("_confirmed"), KIND_CONFIRMED).otherwise(KIND_CONFIRMED_CANCELLED).alias("kind"),
            F.col("order_id").cast("string").alias("order_id"),
            F.col("order_option_id").cast("string").alias("order_option_id"),
            "product_name",
            "option_name",
            "product_id",
            "product_option_id",
            "quantity",
            month_key("_settled_on").alias("_settled"),
            (F.dayofmonth("_settled_on") <= ROUND_LAST_DAY).alias("_half"),
        )
        .agg(F.sum("_amount").alias("coupon_total"))
        .drop("_settled", "_half")
    )


def settlement_round(df: DataFrame, day: Column) -> DataFrame:
    """Settlement year, month and round: up to the 14th the second round of that month, later
    days the first round of the next."""
    early = F.dayofmonth(day) <= ROUND_LAST_DAY
    settled = F.when(early, day).otherwise(F.add_months(day, 1))
    return df.withColumns(
        {
            "settle_year": F.date_format(settled, "yyyy"),
            "settle_month": F.date_format(settled, "MM"),
            "settle_round": F.when(early, ROUND_SECOND).otherwise(ROUND_FIRST),
        }
    )


def settlement_report(branches: Sequence[DataFrame], with_round: bool = False) -> DataFrame:
    """Branches stacked by column name, missing measures zero, amounts as whole units.

    Branches that all have ``OPTION_KEY`` lie by it, and so do their stacked rows: the sums need no
    further shuffle. It follows from the report's keys and changes no group.
    """
    dealt = [OPTION_KEY] if all(OPTION_KEY in b.columns for b in branches) else []
    measures = {"quantity": "bigint", "point_total": "decimal(28,4)", "coupon_total": "decimal(28,4)"}
    shaped = [
        b.select(
            *dealt,
            *REPORT_KEYS,
            *[
                (F.coalesce(F.col(m), F.lit(0)) if m in b.columns else F.lit(0)).cast(t).alias(m)
                for m, t in measures.items()
            ],
        )
        for b in branches
    ]
    stacked = shaped[0]
    for b in shaped[1:]:
        stacked = stacked.unionByName(b)
    total = stacked.groupBy(*dealt, *REPORT_KEYS).agg(
        F.sum("quantity").alias("quantity"),
        round0(F.sum("point_total")).cast("bigint").alias("point_total"),
        round0(F.sum("coupon_total")).cast("bigint").alias("coupon_total"),
    ).drop(*dealt)
    if with_round:
        return settlement_round(total, F.to_date("base_dt"))
    return total.withColumns({"year": F.substring("base_dt", 1, 4), "month": F.substring("base_dt", 6, 2)})
