"""Null handling, exact money and rounding."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
VAT = Decimal("1.1")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact money: sums of decimals do not depend on the order rows arrive in."""
    return as_col(c).cast(MONEY)


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def greatest_strict(*cols: Column | str) -> Column:
    """Largest value, but null as soon as one input is null (Spark's own skips nulls)."""
    cs = [as_col(c) for c in cols]
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in cs])
    return F.when(present, F.greatest(*cs))


def round0(c: Column | str) -> Column:
    """Round half away from zero to whole units."""
    return F.round(as_col(c), 0)


def ex_vat(c: Column | str, exempt: Column | None = None) -> Column:
    """Amount without 10% VAT; rows where ``exempt`` is true carry none."""
    amount = as_col(c)
    taxed = amount / F.lit(VAT)
    if exempt is None:
        return taxed
    return F.when(F.coalesce(exempt, F.lit(False)), amount.cast("decimal(38,6)")).otherwise(taxed)


def spread_null_key(key: Column | str, unique: Column | str) -> Column:
    """String join key whose nulls become distinct values that match nothing.

    An outer join sends every null key to one reducer. Rows that cannot match are given a
    key of their own, derived from a stable row id so that a re-run task repeats it.
    """
    return F.coalesce(as_col(key).cast("string"), F.concat(F.lit("\u0000none:"), as_col(unique).cast("string")))
