"""Column expressions with the null, date and rounding rules the reports rely on."""

from ledgerweave.functions.columns import (
    ex_vat,
    greatest_strict,
    money,
    round0,
    spread_null_key,
    zero_if_null,
)
from ledgerweave.functions.dates import (
    as_date,
    calendar_months_between,
    day_key,
    elapsed_days,
    full_months_between,
    iso_day,
    iso_utc_to_local_date,
    local_from_epoch_ms,
    month_key,
    month_start,
    month_text,
)

__all__ = [
    "as_date",
    "calendar_months_between",
    "day_key",
    "elapsed_days",
    "ex_vat",
    "full_months_between",
    "greatest_strict",
    "iso_day",
    "iso_utc_to_local_date",
    "local_from_epoch_ms",
    "money",
    "month_key",
    "month_start",
    "month_text",
    "round0",
    "spread_null_key",
    "zero_if_null",
]
