"""Null, date and rounding rules."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave import functions as fn
from tests.conftest import rows

D = dt.date


def test_greatest_is_null_with_a_null(frame):
    df = frame([(D(2022, 1, 2), D(2022, 1, 1)), (D(2022, 1, 2), None), (None, None)], "a date, b date")
    assert rows(df.select(fn.greatest_strict("a", "b").alias("g"))) == [(D(2022, 1, 2),), (None,), (None,)]


def test_elapsed_days_counts_whole_days_not_midnights(frame):
    df = frame([("2022-01-01 23:00:00",)], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    end = F.lit("2022-01-03 00:00:00").cast("timestamp_ntz")
    assert rows(df.select(fn.elapsed_days("t", end))) == [(1,)]
    assert rows(df.select(fn.elapsed_days("t", D(2022, 1, 1)))) == [(0,)]


@pytest.mark.parametrize(
    "a, b, months",
    [
        (D(2022, 1, 31), D(2022, 2, 28), 1),
        (D(2022, 1, 30), D(2022, 2, 28), 1),
        (D(2022, 1, 15), D(2022, 2, 14), 0),
        (D(2022, 1, 15), D(2022, 2, 15), 1),
        (D(2022, 2, 28), D(2022, 1, 30), -1),
        (D(2022, 5, 1), D(2022, 5, 1), 0),
    ],
)
def test_full_months_cases(frame, a, b, months):
    df = frame([(a, b)], "a date, b date")
    assert rows(df.select(fn.full_months_between("a", "b"))) == [(months,)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.dates(D(2019, 1, 1), D(2025, 1, 1)), st.dates(D(2019, 1, 1), D(2025, 1, 1))), min_size=20, max_size=60))
def test_full_months_match_sql(spark, pairs):
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", fn.full_months_between("a", "b").alias("m")).collect()
    con = duckdb.connect()
    for r in got:
        lo, hi = min(r.a, r.b), max(r.a, r.b)
        want = con.execute("SELECT date_sub('month', ?::DATE, ?::DATE)", [lo, hi]).fetchall()[0][0]
        assert r.m == (want if r.a <= r.b else -want)


def test_month_and_day_keys(frame):
    df = frame([(dt.datetime(2022, 3, 5, 10, 37),)], "t timestamp_ntz")
    got = rows(df.select(fn.month_key("t"), fn.month_text("t"), fn.day_key("t"), fn.iso_day("t")))
    assert got == [("202203", "2022-03-01", "20220305", "2022-03-05")]
    assert rows(df.select(fn.month_start(F.lit("202203")), fn.month_start(F.lit("20220317")))) == [(D(2022, 3, 1), D(2022, 3, 1))]


def test_wall_clock_does_not_follow_the_session_zone(spark):
    df = spark.sql("SELECT 1704067200123L AS ms")
    for zone in ("UTC", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = df.select(fn.local_from_epoch_ms("ms", "Asia/Seoul").cast("string")).collect()[0][0]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == "2024-01-01 09:00:00.123"


def test_iso_text_to_local_date(frame):
    df = frame([("2022-12-31T16:30:00.000Z",), ("2022-12-31T14:59:59.000Z",), (None,)], "t string")
    assert rows(df.select(fn.iso_utc_to_local_date("t"))) == [(D(2022, 12, 31),), (D(2023, 1, 1),), (None,)]


@pytest.mark.parametrize("x, net", [("0.55", 1), ("-0.55", -1), ("1.64", 1), ("1.65", 2), ("110.00", 100), ("0.54", 0)])
def test_ex_vat_rounds_half_away_from_zero(frame, x, net):
    df = frame([(Decimal(x),)], "x decimal(18,2)")
    assert rows(df.select(fn.round0(fn.ex_vat("x")))) == [(float(net),)]


def test_ex_vat_exemption(frame):
    df = frame([(Decimal("11.00"), "F"), (Decimal("11.00"), "L"), (Decimal("11.00"), None)], "x decimal(18,2), k string")
    got = df.select(fn.round0(fn.ex_vat("x", F.col("k") == "F"))).collect()
    assert [int(r[0]) for r in got] == [11, 10, 10]


def test_spread_null_key_keeps_keys_and_splits_nulls(frame):
    df = frame([("7", 1), (None, 2), (None, 3)], "k string, id bigint")
    keys = [r[0] for r in rows(df.select(fn.spread_null_key("k", "id")))]
    assert "7" in keys and len(set(keys)) == 3
