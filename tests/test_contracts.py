"""Contracts, sales netting, contacts."""

import datetime as dt
from decimal import Decimal

from ledgerweave import plans
from ledgerweave.sources.calendar import calendar
from ledgerweave.sources.schemas import SCHEMAS
from tests.conftest import rows

STEP = "dump_mongo_expert.remodelingstep"
AS_OF = dt.date(2023, 7, 1)


def step(oid, name="kim", scale=0, pay=100, extra=None, signed="2022-12-31T14:00:00.000Z", changed=None, channel=1, expert="e1", status=11, legacy=None):
    money = [None if v is None else Decimal(v) for v in (pay, extra)]
    return ((oid,), (expert,), (scale,), (signed, changed, *money), "2022-01-01T00:00:00.000Z", legacy, ("u", name, "010"), channel, status)


def run(spark, steps, expertises=(), **kw):
    tables = {
        STEP: spark.createDataFrame(steps, SCHEMAS[STEP]),
        "dump.expertises": spark.createDataFrame(list(expertises), SCHEMAS["dump.expertises"]),
        "ba_preserved.calendar": calendar(spark, dt.date(2021, 1, 1), dt.date(2023, 12, 31)),
    }
    return plans.remodeling_gmv(tables, AS_OF, **kw)


def test_test_users_nameless_and_uninspected_drop(spark):
    steps = [step("1"), step("2", "A TESTer"), step("3", "테스트"), step("4", None), step("5", "효_iOS"), step("6", "효Xi OS"), step("7", signed=None)]
    assert rows(run(spark, steps), "gmv", "contract_count") == [(200.0, 2)]


def test_scale_and_type_labels(spark):
    steps = [
        step("1", scale=9999999, expert="both"),
        step("2", scale=9999999, expert="cafe"),
        step("3", scale=9999999, expert="none"),
        step("4", scale=4, channel=9),
        step("5", scale=None, channel=3),
        step("6", scale=1, channel=5, legacy=77),
    ]
    skills = [("both", 5), ("both", 5), ("both", 26), ("cafe", 26)]
    got = rows(run(spark, steps, skills, legacy_types={"X": (77,)}), "scale", "type", "contract_count")
    assert set(got) == {
        ("종합", "리스팅", 1),
        ("카페", "리스팅", 1),
        ("개별", "리스팅", 1),
        ("4", "9", 1),
        (None, "시공스토어", 1),
        ("개별", "X", 1),
    }


def test_local_day_moves_the_month(spark):
    got = run(spark, [step("1"), step("2", signed="2022-12-31T15:00:00.000Z")])
    assert rows(got, "yyyymm", "gmv") == [("202212", 100.0), ("202301", 100.0)]


def test_adjustments_before_and_after_the_cutover(spark):
    steps = [
        step("1", extra=-100, signed="2022-11-10T00:00:00.000Z", changed="2022-12-20T00:00:00.000Z"),
        step("2", extra=-100, signed="2022-11-10T00:00:00.000Z", changed="2023-01-20T00:00:00.000Z"),
        step("3", extra=5, signed="2022-11-10T00:00:00.000Z"),
    ]
    columns = ("yyyymm", "gmv_org", "gmv_adj", "gmv", "contract_count_org", "contract_count_adj", "contract_count")
    assert rows(run(spark, steps), *columns) == [
        ("202211", 300.0, -95.0, 205.0, 3, -1, 2),
        ("202301", 0.0, -100.0, -100.0, 0, -1, -1),
    ]


def test_days_outside_the_report_drop(spark):
    steps = [step("1", signed="2021-05-31T14:00:00.000Z"), step("2", signed="2021-05-31T15:00:00.000Z"), step("3", signed="2023-06-30T15:00:00.000Z")]
    assert rows(run(spark, steps), "yyyymm") == [("202106",)]


def test_moving_revenue_nets_cancels(spark):
    name, at = "dump_payment_o2o.sales", dt.datetime(2023, 1, 2, 3)
    data = [
        (1, at, 2, Decimal(110), None, 0),
        (2, at, 3, Decimal(55), Decimal(11), 0),
        (3, at, 1, Decimal(999), None, 0),
        (4, at, 2, Decimal(999), None, 1),
        (5, at, 2, Decimal(999), None, None),
    ]
    tables = {
        name: spark.createDataFrame(data, SCHEMAS[name]),
        "ba_preserved.calendar": calendar(spark, dt.date(2023, 1, 1), dt.date(2023, 1, 31)),
    }
    (got,) = plans.moving_revenue(tables).collect()
    assert (got.yyyymm, got.first_of_week, got.rev_count, got.cancel_count) == ("202301", dt.date(2023, 1, 2), 1, -1)
    assert round(got.paid_rev, 9) == 50 and round(got.free_rev, 9) == -10


def test_contacts_null_parts_and_duplicates(spark):
    view = "dump_freq.ad_user_properties_view"
    row = (1, "kim", "k@x", "02", "1", "2", "lee", None, "031", "1", "2")
    tables = {
        view: spark.createDataFrame([row, row, (9, *row[1:])], SCHEMAS[view]),
        "dump.sales_users": spark.createDataFrame([(1, "co", "1", None, "3")], SCHEMAS["dump.sales_users"]),
        "dump.users": spark.createDataFrame([(7, "SalesUser", 1, "nick"), (8, "Normal", 9, "no")], SCHEMAS["dump.users"]),
    }
    assert rows(plans.sales_user_contacts(tables)) == [
        (1, 7, "co", "nick", None, "kim(k@x)", "02-1-2", None, "031-1-2"),
        (9, None, None, None, None, "kim(k@x)", "02-1-2", None, "031-1-2"),
    ]
