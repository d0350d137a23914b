"""Latest row, labels, payment filter, ageing, issue ladder, status inference."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerweave import plans
from ledgerweave.operators import dedupe, lookup, orders
from tests.conftest import rows

TS = dt.datetime
AS_OF = dt.date(2022, 6, 1)


def test_latest_per_key_newest_first_nulls_last_tie_by_id(frame):
    df = frame(
        [(1, 10, TS(2022, 1, 1)), (1, 11, TS(2022, 1, 1)), (1, 12, None), (2, 20, None)],
        "k bigint, id bigint, at timestamp_ntz",
    )
    order = [F.col("at").desc_nulls_last(), F.col("id").desc_nulls_last()]
    assert rows(dedupe.latest_per_key(df, ["k"], order), "k", "id") == [(1, 11), (2, 20)]
    assert rows(dedupe.latest_per_key(df.limit(0), ["k"], order)) == []


def test_latest_per_key_limits_before_the_shuffle(frame):
    df = frame([(1, 1)], "k bigint, v bigint").repartition(3)
    plan = dedupe.latest_per_key(df, ["k"], [F.col("v").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_label_unknown_and_null(frame):
    df = frame([(0,), (5,), (77,), (None,)], "status int")
    got = lookup.lookup_label(df, "status", orders.OPTION_STATUS, "label", "NULL")
    assert set(rows(got)) == {(0, "0:입금대기"), (5, "5:구매확정"), (77, "NULL"), (None, "NULL")}
    plain = lookup.lookup_label(df, "status", orders.CANCEL_STATUS, "label")
    assert (77, None) in rows(plain) and (None, None) in rows(plain)


@pytest.mark.parametrize(
    "success, method, account, kept",
    [
        (True, "card", None, True),
        (True, "without_bankbook", True, True),
        (True, "without_bankbook", False, False),
        (True, "without_bankbook", None, False),
        (True, None, True, False),
        (False, "card", True, False),
        (None, "card", True, False),
    ],
)
def test_paid_orders(frame, success, method, account, kept):
    df = frame([(success, method, account)], "is_payment_success boolean, payment_method string, is_success_vbank boolean")
    assert (orders.paid_orders(df).count() == 1) is kept


def test_age_days_only_where_condition_holds(frame):
    df = frame([(TS(2022, 5, 30, 12), True), (TS(2022, 5, 30, 12), False), (None, True)], "t timestamp_ntz, c boolean")
    assert {r[2] for r in rows(orders.age_days(df, "t", AS_OF, "age", F.col("c")))} == {1, None}


LADDER = (
    "cancel_code int, seller_id bigint, status int, confirm_order_date timestamp_ntz, purchase_confirm_date timestamp_ntz, "
    "delivery_complete_date timestamp_ntz, delivery_start_date timestamp_ntz, payment_at timestamp_ntz, "
    "is_rental boolean, is_zero boolean, is_premium boolean, is_seller_delivery boolean"
)
T, OLD = TS(2022, 5, 1), TS(2021, 5, 1)


@pytest.mark.parametrize(
    "row, issue",
    [
        ((2, 9, 1, T, T, T, T, T, True, True, True, True), "check_cancelled"),
        ((0, 3, 1, T, T, T, T, T, True, True, True, True), "check_first_party_delivery"),
        ((None, 9, None, None, T, T, T, T, False, False, False, False), "check_cancelled"),
        ((None, 9, None, T, T, T, T, T, False, False, False, False), "set_confirmed"),
        ((None, 9, None, T, None, T, T, T, False, False, False, False), "set_delivered"),
        ((None, 9, None, T, None, None, T, T, False, False, False, False), "ask_seller"),
        ((None, 9, 1, T, None, None, T, T, True, True, True, True), "rental"),
        ((None, 9, 1, T, None, None, T, T, True, False, True, True), "premium_young"),
        ((None, 9, 1, T, None, None, T, OLD, False, False, True, True), "premium_old"),
        ((None, 9, 1, T, None, None, T, T, False, False, False, True), "direct_delivery"),
        ((None, 9, 1, T, T, None, T, T, False, False, False, False), "set_confirmed"),
        ((None, 9, 1, T, None, None, T, T, False, False, False, False), "ask_seller"),
        ((None, 9, 4, T, None, None, None, T, False, False, False, False), "no_delivery_dates"),
        ((None, 9, 4, T, None, None, T, T, False, False, False, False), "no_complete_date"),
        ((None, 9, 4, T, None, T, T, T, False, False, False, False), "undefined"),
        ((None, None, 2, T, None, None, T, T, False, False, False, False), "undefined"),
    ],
)
def test_issue_ladder(frame, row, issue):
    df = orders.classify_issue(frame([row], LADDER), orders.issue_rules(AS_OF, 3), orders.ISSUE["undefined"])
    assert rows(df, "option_issue") == [(orders.ISSUE[issue],)]


@pytest.mark.parametrize(
    "cancel, dates, status",
    [
        (2, (T, T, T, T, T), 9),
        (1, (T, T, T, T, T), 5),
        (None, (None, T, T, T, T), 4),
        (None, (None, None, T, T, T), 3),
        (None, (None, None, None, T, T), 2),
        (None, (None, None, None, None, T), 1),
        (None, (None,) * 5, None),
    ],
)
def test_infer_status(frame, cancel, dates, status):
    schema = (
        "cancel_code int, purchase_confirm_date timestamp_ntz, delivery_complete_date timestamp_ntz, "
        "delivery_start_date timestamp_ntz, confirm_order_date timestamp_ntz, payment_at timestamp_ntz"
    )
    df = orders.infer_status(frame([(cancel, *dates)], schema))
    assert rows(df, "should_be_option_status") == [(status,)]


def test_limit_of_options_without_status_is_ordered(spark, sf_dir):
    from checks.derive import Derived

    tables = Derived(spark, sf_dir)
    everything = [(r.id, r.option_id) for r in plans.options_without_status(tables, None).collect()]
    first = [(r.id, r.option_id) for r in plans.options_without_status(tables, 20).collect()]
    assert first == everything[:20] and len(everything) > 20


def test_options_without_status_returns_all_rows_unless_limited(spark, sf_dir):
    from checks.derive import Derived
    from ledgerweave import plans

    tables = Derived(spark, sf_dir)
    every = plans.options_without_status(tables)
    assert every.count() > 7
    assert plans.options_without_status(tables, max_rows=7).collect() == every.collect()[:7]
