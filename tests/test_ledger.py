"""Control totals, reconciliation, mapping checks."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerweave.operators import ledger, lookup, validate
from tests.conftest import rows


def test_control_total_keeps_null_keys(frame):
    df = frame([("a", Decimal(1)), ("a", Decimal(2)), (None, Decimal(4))], "k string, v decimal(18,2)")
    assert rows(ledger.control_total(df, ["k"], "v")) == [(None, 4.0), ("a", 3.0)]


def test_reconcile_lists_only_differences_and_one_sided_keys(frame):
    left = frame(
        [(1, Decimal(5), 10), (1, Decimal(5), 11), (2, Decimal(7), 12), (3, Decimal(1), 13)],
        "user_id bigint, amount decimal(18,2), id bigint",
    )
    right = frame([(1, Decimal(10)), (2, Decimal(6)), (4, Decimal(2))], "user_id bigint, balance decimal(18,2)")
    dim = frame([(1,), (2,), (None,)], "id bigint")
    got = ledger.reconcile_with_flag(left, right, dim, "user_id", "amount", "balance", "id", "id", "withdrawal")
    columns = ("user_id", "withdrawal", "data_sum", "user_bal", "diff", "tran_count")
    assert rows(got, *columns) == [
        (2, False, 7.0, 6.0, 1.0, 1),
        (3, True, 1.0, 0.0, 1.0, 1),
        (4, True, 0.0, 2.0, -2.0, 0),
    ]


def test_missing_flag_does_not_fan_out(frame):
    df = frame([(1,), (2,), (None,)], "k bigint")
    dim = frame([(1,), (1,)], "id bigint")
    assert set(rows(lookup.missing_flag(df, dim, "k", "id", "gone"))) == {(1, False), (2, True), (None, True)}


def test_duplicate_keys_count_non_null_only(frame):
    df = frame([("a", "x"), ("a", None), ("b", "x"), ("b", "y"), (None, "x"), (None, "y")], "k string, v string")
    got = rows(validate.duplicate_keys(df, "t", F.col("k"), "v"))
    assert got == [("t", None, 2), ("t", "b", 2)]


def test_unmapped_codes_keep_the_null_code(frame):
    df = frame([("a",), ("b",), ("b",), (None,)], "c string")
    mapping = frame([("a",), (None,)], "m string")
    assert rows(validate.unmapped_codes(df, mapping, "t", "c", "m")) == [("t", None, 0), ("t", "b", 2)]
