"""Date rules: whole elapsed days and months, month keys, fixed-zone conversion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.columns import as_col


def as_date(value: dt.date | str | Column) -> Column:
    """Date literal from a date or an ISO text; columns pass through."""
    if isinstance(value, Column):
        return value
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def month_key(c: Column | str) -> Column:
    """``yyyyMM`` text of a date; number arithmetic is far cheaper per row than a formatter."""
    c = as_col(c)
    return (F.year(c) * 100 + F.month(c)).cast("string")


def month_text(c: Column | str) -> Column:
    """``yyyy-MM-01`` text of a date."""
    return F.trunc(as_col(c).cast("date"), "month").cast("string")


def iso_day(c: Column | str) -> Column:
    """``yyyy-MM-dd`` text of a date or time."""
    return as_col(c).cast("date").cast("string")


def day_key(c: Column | str) -> Column:
    """``yyyyMMdd`` text of a date or time."""
    c = as_col(c)
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("string")


def month_start(yyyymm: Column | str) -> Column:
    """First day of a ``yyyyMM`` (or ``yyyyMMdd``) text."""
    return F.to_date(F.substring(as_col(yyyymm), 1, 6), "yyyyMM")


def elapsed_days(start: Column | str, end: Column | str | dt.date) -> Column:
    """Whole 24-hour days from ``start`` to ``end`` (not the count of midnights between)."""
    stop = as_date(end) if isinstance(end, dt.date) else as_col(end)
    return F.timestamp_diff("DAY", as_col(start).cast("timestamp_ntz"), stop.cast("timestamp_ntz"))


def calendar_months_between(a: Column | str, b: Column | str) -> Column:
    """Difference of the month numbers, the day of the month ignored."""
    a, b = as_col(a), as_col(b)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def full_months_between(a: Column | str, b: Column | str) -> Column:
    """Whole months from date ``a`` to date ``b``, month ends counted as full (01-30 to 02-28 is 1)."""
    a, b = as_col(a), as_col(b)
    early, late = F.least(a, b), F.greatest(a, b)
    n = calendar_months_between(early, late)
    whole = n - F.when(F.add_months(early, n) > late, 1).otherwise(0)
    return F.when(a.isNull() | b.isNull(), None).when(a <= b, whole).otherwise(-whole)


def local_from_epoch_ms(ms: Column | str, zone: str) -> Column:
    """Wall-clock time in ``zone`` of an epoch in milliseconds, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = F.timestamp_add("MILLISECOND", as_col(ms).cast("bigint"), epoch)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def iso_utc_to_local_date(text: Column | str, hours: int = 9) -> Column:
    """Date, ``hours`` east of UTC, of an ISO-8601 UTC text such as ``2022-12-31T16:30:00.000Z``."""
    text = as_col(text)
    plain = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8))
    return (plain.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hours))).cast("date")
