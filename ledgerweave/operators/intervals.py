"""Validity intervals from start/stop events, their overlaps, and attribution by date.

Events are first folded to one row per key and day. After that a key holds at most one
row per calendar day however many events it had, so the windows below stay small even
when one key owns a third of the log.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import as_date


def build_intervals(
    events: DataFrame,
    keys: Sequence[str],
    day: str,
    is_start: Column,
    is_stop: Column,
    open_end: dt.date,
) -> DataFrame:
    """Each start day up to the day before the earliest later stop of the same key.

    A start without a later stop runs to the day before ``open_end``. Repeated starts of a
    day give one interval; a null in the key meets no stop. ``day`` is a calendar day: the order of events
    inside a day is not looked at, and a column of times is an error.
    """
    if dict(events.dtypes)[day].startswith("timestamp"):
        raise ValueError(f"{day} holds times; intervals run by calendar day")
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    days = (
        events.filter(is_start | (is_stop & keyed))
        .groupBy(*keys, day)
        .agg(
            F.max(F.coalesce(is_start, F.lit(False))).alias("_start"),
            F.max(F.coalesce(is_stop & keyed, F.lit(False))).alias("_stop"),
        )
    )
    # newest first, so the later days are the rows already passed and the frame grows by one
    newest_first = Window.partitionBy(*keys).orderBy(F.col(day).desc_nulls_last())
    later = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    stop = F.min(F.when(F.col("_stop"), F.col(day))).over(later)
    end = F.date_sub(F.coalesce(F.when(F.col(day).isNotNull(), stop), as_date(open_end)), 1)
    return (
        days.withColumn("end_dt", end)
        .filter(F.col("_start"))
        .select(*keys, F.col(day).alias("start_dt"), "end_dt")
    )


def overlap_periods(
    intervals: DataFrame,
    key: str,
    start: str,
    end: str,
    first_day: dt.date,
    last_day: dt.date,
) -> DataFrame:
    """First and last calendar day on which a key lies in more than one interval.

    A sweep over +1/-1 changes stands in for the expansion into days: work grows with the
    number of intervals and not with their length, so open-ended ones cost nothing extra.
    Changes are summed per key and day before the window, which bounds it by the calendar.
    """
    valid = intervals.filter(F.col(start) <= F.col(end))
    change = F.explode(
        F.array(
            F.struct(F.col(start).alias("day"), F.lit(1).alias("delta")),
            F.struct(F.date_add(F.col(end), 1).alias("day"), F.lit(-1).alias("delta")),
        )
    )
    changes = (
        valid.select(F.col(key), change.alias("c"))
        .groupBy(key, F.col("c.day").alias("day"))
        .agg(F.sum("c.delta").alias("delta"))
    )
    w = Window.partitionBy(key).orderBy("day")
    depth = F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    segments = changes.select(key, "day", depth.alias("depth"), F.date_sub(F.lead("day").over(w), 1).alias("until"))
    lo, hi = F.greatest(F.col("day"), as_date(first_day)), F.least(F.col("until"), as_date(last_day))
    return (
        segments.filter(F.col("depth") > 1)
        .select(key, lo.alias("lo"), hi.alias("hi"))
        .filter(F.col("lo") <= F.col("hi"))
        .groupBy(key)
        .agg(F.min("lo").alias("first_error"), F.max("hi").alias("last_error"))
    )


def overlapping_intervals(
    intervals: DataFrame, key: str, label: str, first_day: dt.date, last_day: dt.date
) -> DataFrame:
    """Every interval of a key that has an overlap somewhere, with the key's error period."""
    counted = intervals.filter(F.col(label).isNotNull())
    errors = overlap_periods(counted, key, "start_dt", "end_dt", first_day, last_day)
    period = F.concat(F.col("first_error").cast("string"), F.lit("~"), F.col("last_error").cast("string"))
    return (
        intervals.join(errors, key)
        .select(label, key, "start_dt", "end_dt", period.alias("error_period"))
        .distinct()
    )


def attribute_interval(
    facts: DataFrame, intervals: DataFrame, fact_key: str, fact_day: str, key: str, label: str, default: str
) -> DataFrame:
    """Left join of facts to the intervals their day falls in, with a label for the rest.

    A sweep in place of a range join. The borders of a key's intervals cut its time into stretches; one ordered pass
    over borders and days of facts tells the stretch of each day, and an interval is listed for the stretches
    it covers. What meets are equal keys and stretches, so a fact sees no interval but its own, however many
    its key has. Overlapping intervals repeat a fact. Facts are joined by key and day, which adaptive
    execution can split for a hot key; the pass itself sees each day of a key once.
    """
    kind = dict(facts.dtypes)[fact_key]
    spans = intervals.withColumnRenamed(label, "_label").withColumn("_key", F.col(key).cast(kind))
    spans = spans.filter(F.col("_key").isNotNull() & (F.col("start_dt") <= F.col("end_dt")))
    spans = spans.withColumn("_after", F.date_add("end_dt", 1))
    by_day = Window.partitionBy("_key").orderBy("_day")
    stretches = (
        spans.select("_key", F.explode(F.array("start_dt", "_after")).alias("_day"))
        .distinct()
        .withColumn("_stretch", F.row_number().over(by_day))
    )
    begins = stretches.select("_key", F.col("_day").alias("start_dt"), F.col("_stretch").alias("_from"))
    ends = stretches.select("_key", F.col("_day").alias("_after"), F.col("_stretch").alias("_to"))
    covers = (
        spans.join(begins, ["_key", "start_dt"])
        .join(ends, ["_key", "_after"])
        .withColumn("_stretch", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
        .drop("_after", "_from", "_to")
    )
    days = facts.select(F.col(fact_key).alias("_key"), F.col(fact_day).cast("date").alias("_day")).distinct()
    days = days.filter(F.col("_key").isNotNull() & F.col("_day").isNotNull())
    marks = stretches.withColumn("_asks", F.lit(False)).unionByName(
        days.withColumns({"_stretch": F.lit(None).cast("int"), "_asks": F.lit(True)})
    )
    so_far = Window.partitionBy("_key").orderBy("_day", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("_stretch", F.last("_stretch", ignorenulls=True).over(so_far)).filter("_asks").drop("_asks")
    open_ = placed.join(covers, ["_key", "_stretch"]).drop("_stretch")
    on = (F.col(fact_key) == F.col("_key")) & (F.col(fact_day).cast("date") == F.col("_day"))
    return (
        facts.join(open_, on, "left")
        .withColumns({"attributed": F.col("_label").isNotNull(), label: F.coalesce(F.col("_label"), F.lit(default))})
        .drop("_label", "_key", "_day")
    )
