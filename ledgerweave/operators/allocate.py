"""Proportional allocation with an exact residual."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.segments import Segments


def _count(copies: str | None) -> Column:
    return F.col(copies) if copies else F.lit(1)


def _allocated(
    s: Segments, keys: Sequence[str], amount: str, weight: str, order_by: Sequence[str], out: str, first_out: str, copies: str | None
) -> Segments:
    w = F.coalesce(F.col(weight), F.lit(1))
    share = F.col(amount).cast("double") * w.cast("double") / F.col("_w").cast("double")
    return s.total(keys, {"_w": w * _count(copies)}, (first_out, order_by)).with_columns({out: F.round(share, 0)})


def _fixed(
    s: Segments, keys: Sequence[str], amount: str, alloc: str, first: str, keep_full: Column | None, out: str, copies: str | None
) -> Segments:
    n = _count(copies)
    part, full = F.coalesce(F.col(alloc), F.lit(0.0)), F.col(amount).cast("double")
    fixed = F.when(F.col(first), full - F.col("_sum") + part * n).otherwise(part * n)
    if keep_full is not None:
        fixed = F.when(keep_full, full * n).otherwise(fixed)
    return s.total(keys, {"_sum": part * n}).with_columns({out: F.coalesce(fixed, full * n, F.lit(0.0))})


def allocate(
    df: DataFrame,
    keys: Sequence[str],
    amount: str,
    weight: str,
    order_by: Sequence[str],
    out: str = "allocated",
    first_out: str = "is_first",
    copies: str | None = None,
) -> DataFrame:
    """``round(amount * weight / sum(weight) of the key)``, a null weight counted as 1.

    Also flags the first row of each key under ``order_by`` (ascending, nulls last), just one
    even if rows tie: one pass over the keys serves both. ``copies`` names a column saying how
    many identical rows a row stands for. The share is a double rounded once to whole units,
    half away from zero.
    """
    return _allocated(Segments.of(df, keys), keys, amount, weight, order_by, out, first_out, copies).result("_w")


def fix_residual(
    df: DataFrame,
    keys: Sequence[str],
    amount: str,
    alloc: str,
    first: str = "is_first",
    keep_full: Column | None = None,
    out: str = "fixed",
    copies: str | None = None,
) -> DataFrame:
    """Give the row flagged ``first`` what rounding left over, so parts add up to the amount.

    It takes ``amount - sum(alloc over keys) + alloc``; rows with ``keep_full`` keep the whole
    amount. With ``copies`` a row stands for several identical ones and ``out`` is their sum:
    only one of them takes the residual.
    """
    return _fixed(Segments.of(df, keys), keys, amount, alloc, first, keep_full, out, copies).result("_sum")


def share_out(
    df: DataFrame,
    keys: Sequence[str],
    amount: str,
    weight: str,
    order_by: Sequence[str],
    settle_by: Sequence[str] = (),
    keep_full: Column | None = None,
    alloc_out: str = "allocated",
    out: str = "fixed",
    first_out: str = "is_first",
    copies: str | None = None,
    derived: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``allocate`` and ``fix_residual`` over the same rows, which are dealt to tasks and written once.

    Shares are taken within ``keys``; what rounding leaves is settled within ``keys`` and ``settle_by``
    together, which divide the groups further. ``derived`` columns are not dealt but computed where they are used.
    With ``sums`` these by ``settle_by`` in place of the rows, whose ``keys`` must follow from it.
    """
    s = _allocated(Segments.of(df, keys, settle_by, derived=derived), keys, amount, weight, order_by, alloc_out, first_out, copies)
    settled = _fixed(s, [*keys, *settle_by], amount, alloc_out, first_out, keep_full, out, copies)
    return settled.grouped(settle_by, sums) if sums else settled.result("_w", "_sum")
