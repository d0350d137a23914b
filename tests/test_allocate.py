"""Proportional allocation and its residual."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.operators import allocate, totals
from tests.conftest import rows

SCHEMA = "k bigint, amount decimal(18,2), weight bigint, id bigint"


def shares(df, **kw):
    out = allocate.allocate(df, ["k"], "amount", "weight", ["id"], **kw)
    return allocate.fix_residual(out, ["k"], "amount", "allocated", **kw)


def test_parts_add_up_and_first_takes_the_rest(frame):
    df = frame([(1, Decimal(100), 1, 1), (1, Decimal(100), 1, 2), (1, Decimal(100), 1, 3)], SCHEMA)
    assert rows(shares(df), "id", "fixed") == [(1, 34.0), (2, 33.0), (3, 33.0)]


def test_null_weight_counts_as_one_and_single_rows_keep_cents(frame):
    df = frame([(1, Decimal("10.00"), None, 1), (1, Decimal("10.00"), 3, 2), (2, Decimal("7.35"), None, 3)], SCHEMA)
    assert rows(shares(df), "id", "fixed") == [(1, 2.0), (2, 8.0), (3, 7.35)]


def test_null_key_and_null_amount(frame):
    df = frame([(None, Decimal(9), 1, 1), (None, Decimal(9), 2, 2), (3, None, 1, 3)], SCHEMA)
    assert rows(shares(df), "id", "fixed") == [(1, 3.0), (2, 6.0), (3, 0.0)]


def test_copies_equal_repeated_rows(frame):
    folded = frame([(1, Decimal(100), 1, 1, 3), (1, Decimal(100), 4, 2, 1)], SCHEMA + ", copies bigint")
    # three equal rows of 100 * 1/7 = 14 and one of 57: the first also takes the missing 1
    assert rows(shares(folded, copies="copies"), "id", "fixed") == [(1, 43.0), (2, 57.0)]


def test_keep_full_rows_keep_the_amount(frame):
    df = frame([(1, Decimal(10), 1, 1), (1, Decimal(10), 2, 2)], SCHEMA)
    out = allocate.allocate(df, ["k"], "amount", "weight", ["id"])
    fixed = allocate.fix_residual(out, ["k"], "amount", "allocated", keep_full=F.col("id") == 2)
    assert rows(fixed, "id", "fixed") == [(1, 3.0), (2, 10.0)]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(1, 50))),
        min_size=1,
        max_size=40,
    )
)
def test_against_brute_force(spark, pairs):
    data = [(k, Decimal(1000 + 37 * k), w, i) for i, (k, w) in enumerate(pairs)]
    got = {r.id: r.fixed for r in shares(spark.createDataFrame(data, SCHEMA)).collect()}
    for key in {k for k, *_ in data}:
        group = sorted((i, w or 1) for k, _, w, i in data if k == key)
        amount, total = 1000 + 37 * key, sum(w for _, w in group)
        parts = [
            float(Decimal(repr(amount * w / total)).quantize(Decimal(1), rounding=ROUND_HALF_UP)) for _, w in group
        ]
        parts[0] = amount - sum(parts) + parts[0]
        assert [got[i] for i, _ in group] == parts
        assert sum(got[i] for i, _ in group) == amount


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 3), st.integers(0, 2)), min_size=1, max_size=30))
def test_ties_leave_one_first_row_and_exact_totals(spark, picks):
    """Rows that tie under the order, or are equal altogether, share one first row."""
    data = [(k, Decimal(100), w, i) for k, w, i in picks]
    got = shares(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    for key in {k for k, *_ in data}:
        mine = [r for r in got if r.k == key]
        assert sum(r.fixed for r in mine) == 100 and sum(r.is_first for r in mine) == 1
        assert min(r.id for r in mine) == next(r.id for r in mine if r.is_first)


def test_equal_rows_in_a_large_group(spark):
    df = spark.range(0, 3000).selectExpr("1L AS k", "CAST(100 AS decimal(18,2)) AS amount", "3L AS weight", "5L AS id")
    out = shares(df).agg(F.sum("fixed"), F.count_if("is_first"), F.count(F.lit(1))).collect()[0]
    assert tuple(out) == (100, 1, 3000)


def test_totals_reach_all_rows_of_large_and_small_keys(spark):
    df = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    out = totals.attach_totals(df, ["k"], {"n": F.lit(1)}, ("is_first", ["id"]))
    assert out.count() == 9000 and out.filter("is_first").count() == 6001
    assert out.filter("k = 0").agg(F.min("n"), F.max("n"), F.min(F.when(F.col("is_first"), F.col("id")))).collect()[0] == (3000, 3000, 0)


def test_join_unique_with_hot_and_missing_keys(spark):
    df = spark.range(0, 900).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    dim = spark.createDataFrame([(0, "zero"), (1, "one"), (5000, "none"), (None, "null")], "d bigint, name string")
    got = totals.join_unique(df, dim, "k", "d").groupBy("name").count().collect()
    assert {r.name: r["count"] for r in got} == {"zero": 300, "one": 1, None: 599}


def test_related_rows_fold_or_fan_out(frame):
    from ledgerweave.operators.lookup import has_related

    df = frame([(1,), (2,), (3,)], "k bigint")
    rel = frame([(1, 7), (1, 7), (1, 9), (2, 9), (2, 5)], "r bigint, v int")
    flags = {"seven": 7, "nine": 9}
    assert rows(has_related(df, rel, "k", "r", "v", flags)) == [(1, True, True), (2, False, True), (3, False, False)]
    fanned = rows(has_related(df, rel, "k", "r", "v", flags, fan_out=True), "k")
    assert fanned == [(1,), (1,), (2,), (3,)]
