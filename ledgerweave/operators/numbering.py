"""Row numbers over a whole table, without one task that sees all rows.

Rows are dealt to tasks by ranges of the order, sorted there, and written with their place inside
their range. How many rows each range holds (one small row per range) then gives the number
at which it starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import Stages

RANGE_BITS = 33  # rows of a range are numbered below 2**33


def keep_order(df: DataFrame, out: str = "row_number", name: str = "ordered") -> DataFrame:
    """``df`` with the 1-based place of each row in the order in which ``df`` yields its rows.

    ``df`` is run and written once. The result itself is in no order; sort by the number to get it back.
    """
    written = Stages(df.sparkSession, name).write(df.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    piece = F.shiftright("_place", RANGE_BITS).cast("int")
    held = written.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per range
    starts, before = [], 0
    for r in sorted(held, key=lambda r: r["piece"]):
        starts.append((r["piece"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_piece int, _before long")
    inside = F.col("_place") - F.shiftleft(F.col("_piece").cast("long"), RANGE_BITS)
    return (
        written.withColumn("_own", piece)
        .join(F.broadcast(offsets), F.col("_own") == F.col("_piece"))  # as many rows as ranges
        .withColumn(out, F.col("_before") + inside + 1)
        .drop("_own", "_piece", "_before", "_place")
    )


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "row_number", name: str = "numbered") -> DataFrame:
    """``df`` with its 1-based place in the whole table under ``order``.

    Rows that tie under the order are numbered in any order, but each number is given once; ties may
    spread over several tasks. ``df`` is read twice, once for the range bounds, so an expensive
    one should be a written table. An empty table stays empty.
    """
    # the last column spreads rows that tie, so no key is bound to one task
    spread = df.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    order = [*order, F.col("_spread")]
    return keep_order(spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("_spread"), out, name)
