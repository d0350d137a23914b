"""Cohorts by the worked cases, monthly spreads, provisional and fixed costs."""

import datetime as dt
from decimal import Decimal

from ledgerweave import plans
from ledgerweave.operators import cohort, marketing, spread
from ledgerweave.sources.calendar import calendar
from tests.conftest import rows

M = "decimal(18,2)"
SUMMARY = f"user_id bigint, month string, paid {M}, cancel {M}, cancel2 {M}"


def months(spark, data):
    return spark.createDataFrame([(u, m, *map(Decimal, v)) for u, m, *v in data], SUMMARY)


# pays 10 in May, refunded in June, pays 20 in August
CASE = [(1, "2022-05-01", 10, 0, -10), (1, "2022-06-01", 0, -10, 0), (1, "2022-08-01", 20, 0, 0)]


def test_paid_refunded_and_paid_again(spark):
    got = rows(plans.user_cohort({"ba_preserved.mkt_arppu_summary": months(spark, CASE)}))
    assert got == [
        ("202205", "202205", 0, 1, 10.0),
        ("202205", "202206", 1, 0, -10.0),
        ("202208", "202208", 0, 1, 20.0),
    ]


def test_override_replaces_the_first_month_and_needs_rows(spark):
    data = [(5, "2012-01-01", 10, 0, 0), (5, "2022-03-01", 10, 0, 0)]
    got = rows(plans.user_cohort({"ba_preserved.mkt_arppu_summary": months(spark, data)}, {5: "2022-01-01", 6: "2022-01-01"}))
    # months before the first one drop out
    assert got == [("202201", "202203", 2, 1, 10.0)]


def test_never_positive_null_and_anonymous_users_drop(spark):
    data = months(spark, [(2, "2022-05-01", 0, -5, -5), (0, "2022-05-01", 9, 0, 0), (-1, "2022-05-01", 9, 0, 0)])
    extra = spark.createDataFrame([(3, "2022-05-01", Decimal(4), None, None)], SUMMARY)
    assert rows(cohort.cohort_matrix(cohort.first_order_month(cohort.user_month_totals(data.union(extra)), {}))) == []


def test_spread_monthly_by_week(spark):
    cal = calendar(spark, dt.date(2022, 1, 1), dt.date(2022, 3, 31))
    df = spark.createDataFrame([("202202", "A", Decimal(28)), ("202202", "A", Decimal(28)), ("202205", "A", Decimal(1))], f"m string, k string, v {M}")
    got = rows(spread.spread_monthly(df, cal, dt.date(2022, 2, 10), "m", ["k"], "v", "daily"))
    # 56 over 28 days: six days of the first week, three of the second before the 10th
    assert got == [
        ("202202", dt.date(2022, 1, 31), "A", 28, 12.0),
        ("202202", dt.date(2022, 2, 7), "A", 28, 6.0),
    ]


def test_spread_elapsed_truncates_and_counts_joined_rows(spark):
    cal = calendar(spark, dt.date(2022, 2, 1), dt.date(2022, 2, 28))
    one = spark.createDataFrame([("20220201", "20")], "m string, v string")
    got = rows(spread.spread_elapsed(one, cal, dt.date(2022, 2, 4), "m", "v", "daily"), "date", "days", "daily")
    assert got == [(dt.date(2022, 2, i), 3, 6) for i in (1, 2, 3)]
    two = spark.createDataFrame([("20220201", "20"), ("20220215", "-20")], "m string, v string")
    got = rows(spread.spread_elapsed(two, cal, dt.date(2022, 2, 4), "m", "v", "daily"), "days", "daily")
    assert got == [(6, -3)] * 3 + [(6, 3)] * 3


def test_provisional_until_fixed(spark):
    schema = f"base_m string, base_dt string, cost {M}"
    daily = spark.createDataFrame(
        [("2022-01-01", "2022-01-05", Decimal(1)), ("2022-02-01", "2022-02-05", Decimal(2)), ("2022-03-01", "2022-03-05", Decimal(4)), (None, "2022-03-06", Decimal(8))],
        schema,
    )
    monthly = spark.createDataFrame([("2022-02-01", "2022-02-01", Decimal(9))], schema)
    later, fixed = marketing.provisional_fixed(daily, monthly)
    assert [r[0] for r in rows(later, "cost")] == [4.0, 8.0] and fixed.count() == 1
    later, _ = marketing.provisional_fixed(daily, monthly.limit(0))
    assert later.count() == 4


def test_marketing_expense_signs(spark):
    schema = f"base_m string, base_dt string, cost {M}"
    tables = {
        "ba_preserved.calendar": calendar(spark, dt.date(2022, 1, 1), dt.date(2022, 12, 31)),
        "ba_preserved.mkt_cost_d": spark.createDataFrame([("2022-03-01", "2022-03-07", Decimal(4))], schema),
        "ba_preserved.mkt_cost_m": spark.createDataFrame([("2022-02-01", "2022-02-07", Decimal(9))], schema),
        "temp.fin_mkt_freecash": spark.createDataFrame([("20220301", "31")], "yyyymmdd string, value string"),
    }
    got = rows(plans.marketing_expense(tables, dt.date(2022, 3, 3)))
    assert got == [
        ("2022-02-01", dt.date(2022, 2, 7), -9.0, 0.0, 0.0, -9.0),
        ("2022-03-01", dt.date(2022, 2, 28), 0.0, 30.0, 0.0, 0.0),
        ("2022-03-01", dt.date(2022, 3, 7), -4.0, 0.0, -4.0, 0.0),
    ]
