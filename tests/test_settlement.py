"""Discount settlement by milestone."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave import plans
from ledgerweave.operators import settlement as st
from ledgerweave.sources.schemas import SCHEMAS
from tests.conftest import none_left, rows, shuffle_files

TS, D = dt.datetime, dt.date
JULY = (D(2022, 7, 1), D(2022, 8, 1))
COUPON = "finance.fin_coupon_order_options_settlement"
MILEAGE = "finance.fin_mileage_order_options_settlement"


def tables(spark, coupons=(), mileages=(), milestones=None, status=5):
    paid, delivered, confirmed = milestones or (TS(2022, 7, 3, 9), TS(2022, 7, 8, 9), TS(2022, 7, 20, 9))

    def t(name, data):
        return spark.createDataFrame(list(data), SCHEMAS[name])

    def option(i, production):
        return (i, production, 500 + i, "red", 2, Decimal(10), status, None, None, delivered, confirmed, None, None)

    return {
        "dump.orders": t("dump.orders", [(1, paid, paid, "i", "m", True, "card", None)]),
        "dump.order_productions": t("dump.order_productions", [(10, 1, 77, 900, "chair", 0), (11, 1, 78, 901, "desk", 0)]),
        "dump.order_options": t("dump.order_options", [option(100, 10), option(101, 11)]),
        COUPON: t(COUPON, coupons),
        "finance.fin_coupon_cart_order_options_settlement": t(COUPON, coupons),
        MILEAGE: t(MILEAGE, mileages),
        **{f"dump_payment_stage.{n}": t(f"dump_payment_stage.{n}", []) for n in ("payment_items", "payment_transaction_item_amounts", "payment_transaction_items", "payment_transactions")},
        "dump_stage.order_options": t("dump_stage.order_options", []),
        "dump_stage.order_productions": t("dump_stage.order_productions", []),
        "dump_settlement_stage.order_sales_l": t("dump_settlement_stage.order_sales_l", []),
        "dump_settlement_stage.discount_price_detail_l": t("dump_settlement_stage.discount_price_detail_l", []),
    }


def cost(at, amount, job="daily", kind=1, option="100"):
    return (at, job, kind, "1", option, Decimal(amount))


def payment(tabs, sellers=(77,)):
    return plans.payment_discounts(tabs, sellers, JULY, "S", None, JULY)


def test_kinds_and_dates_by_payment(spark):
    tabs = tables(
        spark,
        [
            cost(TS(2022, 7, 3, 23), 100),  # booked on the payment day
            cost(TS(2022, 7, 5), 30),  # booked later
            cost(TS(2022, 7, 6), -100, kind=-1),
            cost(TS(2022, 7, 7), 5, job="manual_correction"),
            cost(TS(2022, 8, 1), 999),  # after the month
            cost(TS(2022, 6, 1), 8),  # before payment: recognised on the payment day
            cost(TS(2022, 7, 3), 50, option="101"),  # another seller
        ],
    )
    got = rows(payment(tabs), "base_dt", "kind", "quantity", "coupon_total", "point_total")
    assert got == [
        ("2022-07-03", st.KIND_PAID, 4, -108, 0),
        ("2022-07-05", st.KIND_RECALCULATED, 0, -30, 0),
        ("2022-07-06", st.KIND_PAID_CANCELLED, 0, 100, 0),
        ("2022-07-07", st.KIND_MANUAL, 0, -5, 0),
    ]
    assert {r.order_option_id for r in payment(tabs, None).collect()} == {"100", "101"}


def test_groups_that_net_to_zero_drop_and_measures_meet(spark):
    at = TS(2022, 7, 3, 12)
    tabs = tables(spark, [cost(at, 100), cost(at, -100)], [cost(at, 40), cost(at, 2)])
    assert rows(payment(tabs), "quantity", "coupon_total", "point_total") == [(4, 0, -42)]
    tabs = tables(spark, [cost(at, 100)], [cost(at, 40)])
    assert rows(payment(tabs), "quantity", "coupon_total", "point_total") == [(4, -100, -40)]


@pytest.mark.parametrize("missing", [0, 1, 2])
def test_missing_milestone_never_settles(spark, missing):
    dates = [TS(2022, 7, 3), TS(2022, 7, 8), TS(2022, 7, 20)]
    dates[missing] = None
    tabs = tables(spark, [cost(TS(2022, 7, 3), 1)], milestones=tuple(dates))
    jobs = [
        payment(tabs),
        plans.delivery_discounts(tabs, (77,), JULY, "S", None, JULY),
        plans.purchase_confirm_discounts(tabs, (77,), JULY, None, JULY),
    ]
    assert [j.count() for j in jobs] == [0 if i == missing else 1 for i in range(3)]


def test_delivery_needs_a_delivered_status(spark):
    tabs = tables(spark, [cost(TS(2022, 7, 3), 1)], status=3)
    assert plans.delivery_discounts(tabs, (77,), JULY, "S", None, JULY).count() == 0
    assert payment(tabs).count() == 1


def test_mileage_quantity_of_the_delivery_report(spark):
    tabs = tables(spark, [], [cost(TS(2022, 7, 5), 40)])
    as_is = plans.delivery_discounts(tabs, (77,), JULY, "S", None, JULY)
    assert rows(as_is, "kind", "quantity") == [(st.KIND_DELIVERED, 0)]
    fixed = plans.delivery_discounts(tabs, (77,), JULY, "S", None, JULY, mileage_quantity="delivery_complete_date")
    assert rows(fixed, "kind", "quantity") == [(st.KIND_DELIVERED, 2)]


@pytest.mark.parametrize(
    "day, expected",
    [
        (D(2022, 7, 14), ("2022", "07", "2차")),
        (D(2022, 7, 15), ("2022", "08", "1차")),
        (D(2022, 12, 31), ("2023", "01", "1차")),
        (D(2022, 1, 31), ("2022", "02", "1차")),
    ],
)
def test_settlement_round(frame, day, expected):
    df = st.settlement_round(frame([(day,)], "d date"), F.col("d"))
    assert rows(df, "settle_year", "settle_month", "settle_round") == [expected]


def staged(spark):
    tabs = tables(spark)

    def t(name, data):
        tabs[name] = spark.createDataFrame(data, SCHEMAS[name])

    pay, at = "dump_payment_stage.", TS(2022, 7, 9, 10)
    t(pay + "payment_transactions", [(1, 10, at, "PAYMENT", 5, "S"), (1, 11, at, "CANCEL", 5, "S"), (2, 20, at, "PAYMENT", 6, "X")])
    t(pay + "payment_transaction_items", [(1, 10, 100), (1, 11, 100), (1, 10, 101), (2, 20, 100)])
    t(pay + "payment_items", [(100, "7", "c"), (101, "DELIVERY", "c")])
    t(
        pay + "payment_transaction_item_amounts",
        [
            (100, 10, "PRODUCT_COUPON", Decimal(30)),
            (100, 10, "PRODUCT_COUPON", Decimal(3)),
            (100, 10, "CARD", Decimal(500)),
            (100, 11, "PRODUCT_COUPON", Decimal(-30)),
            (101, 10, "PRODUCT_COUPON", Decimal(9)),
            (100, 20, "PRODUCT_COUPON", Decimal(9)),
        ],
    )
    t("dump_stage.order_options", [(7, 70, 700, "blue", 5, TS(2022, 6, 9), None)])
    t("dump_stage.order_productions", [(70, 77, None)])
    return tabs


def test_stage_payments(spark):
    got = rows(payment(staged(spark)), "kind", "order_id", "product_name", "coupon_total", "quantity")
    assert got == [(st.KIND_PAID, "5", st.SHIPPING_NAME, -33, 0), (st.KIND_STAGE_CANCELLED, "5", st.SHIPPING_NAME, 30, 0)]


def test_stage_delivery_filters_by_delivery_but_dates_by_transaction(spark):
    tabs = staged(spark)
    june = (D(2022, 6, 1), D(2022, 7, 1))
    assert plans.delivery_discounts(tabs, None, JULY, "S", None, JULY).count() == 0
    got = rows(plans.delivery_discounts(tabs, None, JULY, "S", None, june), "base_dt")
    assert got == [("2022-07-09",)] * 2


def test_stage_settlement_reads_the_newest_snapshot_and_keeps_the_sign(spark):
    tabs = tables(spark)
    at = TS(2022, 7, 9)
    sale = (at, at, "PURCHASE_CONFIRMED", 5, 6, "chair", "red", 3, 900, 700, 77)
    name = "dump_settlement_stage.order_sales_l"
    tabs[name] = spark.createDataFrame([(1, "2023-03-01", *sale), (1, "2023-03-02", *sale)], SCHEMAS[name])
    name = "dump_settlement_stage.discount_price_detail_l"
    tabs[name] = spark.createDataFrame(
        [("2023-03-01", 1, "PRODUCT_COUPON", Decimal(50)), ("2023-03-02", 1, "PRODUCT_COUPON", Decimal(60)), ("2023-03-02", 1, "CARD", Decimal(1))],
        SCHEMAS[name],
    )
    got = plans.purchase_confirm_discounts(tabs, None, JULY, None, JULY)
    assert rows(got, "kind", "quantity", "coupon_total", "settle_month", "settle_round") == [(st.KIND_CONFIRMED, 3, 60, "07", "2차")]


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_payment_report_moves_no_text_rows_after_its_joins(spark):
    """The sums of the branches and of the report form where the joins by option have dealt the rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tabs = staged(spark)
        moved = exchanges(payment(tabs))
        assert moved and not [line for line in moved if "base_dt#" in line.split("hashpartitioning(")[1].split(", ENSURE")[0]]
        got = rows(payment(tabs), "kind", "order_option_id", "coupon_total")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(st.KIND_PAID, "7", -33), (st.KIND_STAGE_CANCELLED, "7", 30)]


def test_spellings_of_an_option_stay_apart_and_staged_ones_must_be_exact(spark):
    at = TS(2022, 7, 3, 12)
    tabs = tables(spark, [cost(at, 100), cost(at, 7, option="0100")], [cost(at, 40, option="0100")])
    assert rows(payment(tabs), "order_option_id", "coupon_total", "point_total") == [("0100", -7, -40), ("100", -100, 0)]
    tabs = staged(spark)
    name = "dump_payment_stage.payment_items"
    tabs[name] = spark.createDataFrame([(100, "07", "c"), (101, " 7", "c")], SCHEMAS[name])
    assert payment(tabs).count() == 0


REPORTS = {
    "payment": lambda tabs: payment(tabs, None),
    "delivery": lambda tabs: plans.delivery_discounts(tabs, None, JULY, "S", None, JULY),
    "confirm": lambda tabs: plans.purchase_confirm_discounts(tabs, None, JULY, None, JULY),
}


@pytest.mark.parametrize("report, joins", [("payment", 4), ("delivery", 4), ("confirm", 3)])
def test_a_report_holds_the_shuffles_of_its_last_step_only(spark, report, joins):
    """Options, staged payments and sales are written before they meet, and what dealt them is gone by then."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tabs, before = staged(spark), shuffle_files(spark)
        df = REPORTS[report](tabs)
        assert len(exchanges(df)) <= joins
        assert none_left(spark, before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bookings_before_1970_and_null_flags_keep_their_meaning(spark):
    paid = (TS(1960, 1, 5, 9),) * 3
    tabs = tables(spark, [cost(TS(1960, 1, 9), 3, job=None, kind=None), cost(TS(1950, 2, 1), 4)], milestones=paid)
    got = plans.payment_discounts(tabs, None, (D(1960, 1, 1), D(1961, 1, 1)), "S", None, JULY)
    assert rows(got, "base_dt", "kind", "quantity", "coupon_total") == [
        ("1960-01-05", st.KIND_PAID, 2, -4),
        ("1960-01-09", st.KIND_RECALCULATED, 0, -3),
    ]


def test_order_ids_keep_their_spelling(spark):
    at = TS(2022, 7, 3, 12)
    costs = [(at, "daily", 1, order, "100", Decimal(5)) for order in ("1", "01", "A-1", None, " 1")]
    got = [r.order_id for r in payment(tables(spark, costs)).collect()]
    assert sorted(got, key=str) == sorted(["1", "01", "A-1", None, " 1"], key=str)
