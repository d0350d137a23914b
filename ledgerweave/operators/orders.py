"""Order option rules: payment filter, ageing, issue ladder, status inference."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import elapsed_days
from ledgerweave.sources.layout import ROOT_ORDER

# --- Fixed values: display labels of the status codes -------------------------------
OPTION_STATUS = {
    0: "0:입금대기",
    1: "1:결제완료",
    2: "2:배송준비",
    3: "3:배송중",
    4: "4:배송완료",
    5: "5:구매확정",
    6: "6:환불진행",
    7: "7:교환진행",
    8: "8:계좌만료",
    9: "9:환불완료",
    10: "10:결제이탈",
}
CANCEL_STATUS = {0: "0:신청", 1: "1:거절", 2: "2:완료", 3: "3:입금대기"}
EXCHANGE_STATUS = {0: "0:신청", 1: "1:거절", 2: "2:승인"}

# --- Fixed values: suggested actions of the issue ladder ----------------------------
ISSUE = {
    "check_cancelled": "결제취소여부 확인요,결제취소시9로변경요",
    "check_first_party_delivery": "1P 배송 확인 필요",
    "set_confirmed": "5로 상태변경요",
    "set_delivered": "4로 상태변경 및 구매확정처리요",
    "ask_seller": "판매자확인요",
    "rental": "렌탈 주문:클렌징 필요",
    "premium_young": "프리미엄 1년 미경과",
    "premium_old": "프리미엄 1년 경과:프리미엄팀 확인요",
    "direct_delivery": "직접배송상품:배송여부 확인요",
    "no_delivery_dates": "배송시작/완료일 없음",
    "no_complete_date": "배송완료일 없음",
    "undefined": "to be defined",
}
# --- Fixed values: codes ------------------------------------------------------------
BANK_TRANSFER = "without_bankbook"
PREMIUM_BIZ = ("PREMIUM", "1P")
PREMIUM_DAYS = 365
RENTAL_ROOT = "렌탈"
FINAL_STATUS = (5, 8, 9, 10)


def paid_orders(
    df: DataFrame,
    success: str = "is_payment_success",
    method: str = "payment_method",
    account_paid: str = "is_success_vbank",
    bank_transfer: str = BANK_TRANSFER,
) -> DataFrame:
    """Successful payments; a bank transfer also needs its virtual account paid.

    A null method is neither equal nor unequal to the transfer code, so the row drops.
    """
    is_transfer = F.col(method) == bank_transfer
    return df.filter(F.col(success) & (~is_transfer | (is_transfer & F.col(account_paid))))


def join_hierarchy(options: DataFrame, productions: DataFrame, orders: DataFrame) -> DataFrame:
    """Options with their production and order, inner joins.

    ``options`` have ``order_production_id``; ``productions`` come with ``_production`` (their id) and ``_order``,
    ``orders`` with ``_order_id``; these keys are dropped. Productions meet their orders first, so options, which are
    more, are moved once. Options from a bucketed copy also have the id of their order: then both joins are by
    order, as the copies are dealt, and nothing is shuffled.
    """
    same = F.col("order_production_id") == F.col("_production")
    if ROOT_ORDER in options.columns:
        same = (F.col(ROOT_ORDER) == F.col("_order")) & same
    return (
        productions.join(orders, F.col("_order") == F.col("_order_id"))
        .join(options, same)
        .drop("_production", "_order", "_order_id", ROOT_ORDER)
    )


def age_days(df: DataFrame, ts: str, as_of: dt.date, out: str, when: Column | None = None) -> DataFrame:
    """Whole elapsed days to ``as_of``, null where ``when`` does not hold."""
    age = elapsed_days(ts, as_of)
    return df.withColumn(out, age if when is None else F.when(when, age))


def first_match(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """Value of the first rule that holds."""
    ladder = None
    for cond, value in rules:
        ladder = F.when(cond, value) if ladder is None else ladder.when(cond, value)
    return ladder.otherwise(default)


def issue_rules(
    as_of: dt.date,
    first_party_seller: int | None,
    labels: Mapping[str, str] = ISSUE,
    premium_days: int = PREMIUM_DAYS,
) -> list[tuple[Column, str]]:
    """The ladder over option status, cancel status, milestones, rental, premium age and delivery."""
    c = F.col
    status, no_status = c("status"), c("status").isNull()
    paid, done = status == 1, status == 4
    premium_age = F.when(c("is_premium"), elapsed_days("payment_at", as_of))
    return [
        (c("cancel_code") == 2, labels["check_cancelled"]),
        (c("seller_id") == F.lit(first_party_seller), labels["check_first_party_delivery"]),
        (no_status & c("confirm_order_date").isNull(), labels["check_cancelled"]),
        (no_status & c("purchase_confirm_date").isNotNull(), labels["set_confirmed"]),
        (no_status & c("delivery_complete_date").isNotNull(), labels["set_delivered"]),
        (no_status, labels["ask_seller"]),
        (paid & c("is_rental") & c("is_zero"), labels["rental"]),
        (paid & (premium_age < premium_days), labels["premium_young"]),
        (paid & (premium_age >= premium_days), labels["premium_old"]),
        (paid & c("is_seller_delivery"), labels["direct_delivery"]),
        (paid & c("purchase_confirm_date").isNotNull(), labels["set_confirmed"]),
        (paid, labels["ask_seller"]),
        (done & c("delivery_start_date").isNull() & c("delivery_complete_date").isNull(), labels["no_delivery_dates"]),
        (done & c("delivery_complete_date").isNull(), labels["no_complete_date"]),
    ]


def classify_issue(df: DataFrame, rules: Sequence[tuple[Column, str]], default: str, out: str = "option_issue") -> DataFrame:
    return df.withColumn(out, first_match(rules, default))


def infer_status(df: DataFrame, out: str = "should_be_option_status", cancel_code: str = "cancel_code") -> DataFrame:
    """Status implied by the furthest milestone reached; a completed cancel comes first."""
    milestones = [
        ("purchase_confirm_date", 5),
        ("delivery_complete_date", 4),
        ("delivery_start_date", 3),
        ("confirm_order_date", 2),
        ("payment_at", 1),
    ]
    reached = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(code)) for c, code in milestones])
    return df.withColumn(out, F.when(F.col(cancel_code) == 2, 9).otherwise(reached))
