"""Totals of key groups by a segmented scan, safe when one key owns a large share of the rows.

Rows are dealt once, by ranges of key and order, to pieces of about equal size, and written with the
number of their piece. A window inside a piece gives the totals of all groups that lie in one piece.
Only the first and the last group of a piece can reach into others: there are at most two a piece,
so their totals over all pieces, the carry, are a table no longer than the number of pieces.
A hot key thus fills several pieces, each a task of its own, and no row is folded or joined to an
aggregate of all keys. Every key takes this way; no threshold changes a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerweave.session import Stages

BUCKETS_A_PIECE = 2  # pieces are dealt to buckets by hash; more buckets than pieces seldom share one
SPREAD = 1 << 14  # places over which blocks of rows equal in all columns may spread
HIDDEN = ("_tie", "_piece")


def order_struct(columns: Sequence[str]) -> Column:
    """Struct that compares like ``order by`` of the columns, ascending with nulls last; equal where all are or both are null."""
    parts: list[Column] = []
    for i, c in enumerate(columns):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*parts)


@dataclass(frozen=True)
class Segments:
    """Rows in pieces, those of them (``near``) whose group under the first keys lies in several, and all such keys."""

    rows: DataFrame
    near: DataFrame
    keys: tuple[str, ...]
    borders: Mapping[tuple[str, ...], DataFrame]

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: Sequence[str],
        finer: Sequence[str] = (),
        name: str = "segments",
        derived: Mapping[str, Column] | None = None,
    ) -> Segments:
        """Pieces of ``df`` in the order of ``keys``, then ``finer``: groups may be those of ``keys`` or of both.

        Rows that tie are told apart by a hash of all their columns; rows equal in all of them may spread
        over pieces too. ``df`` is read twice, once to find the ranges. ``derived`` columns follow from the others
        of ``df`` (in place of its own of that name): they may be keys, and are neither moved nor written.
        """
        derived = dict(derived or {})
        df = df.drop(*derived)
        spark, stages = df.sparkSession, Stages(df.sparkSession, name)
        pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [derived.get(c, F.col(c)).asc_nulls_last() for c in (*keys, *finer)]
        # the hash is found again where it is needed: random digits would be a good part of a narrow row
        tie = F.xxhash64(*df.columns)
        block = F.xxhash64(F.shiftright(F.monotonically_increasing_id(), 6))  # of 64 rows
        placed = df.withColumn("_spread", F.pmod(block, F.lit(SPREAD)).cast("smallint"))
        dealt = placed.repartitionByRange(pieces, *order, tie, F.col("_spread")).drop("_spread")
        rows = stages.write(
            dealt.withColumn("_piece", F.spark_partition_id()),
            "pieces",
            buckets=(BUCKETS_A_PIECE * pieces, "_piece"),
            codec="zstd",
        )
        rows = rows.withColumns({**derived, "_tie": tie})
        borders = {k: _borders(rows, k) for k in {tuple(keys), (*keys, *finer)}}
        near = _at_borders(rows, keys, borders[tuple(keys)])
        return cls(rows, stages.write(near, "near"), tuple(keys), borders)

    def total(
        self,
        keys: Sequence[str],
        sums: Mapping[str, Column],
        first: tuple[str, Sequence[str]] | None = None,
    ) -> Segments:
        """Add sums over the groups of ``keys`` to all rows; null keys form a group too.

        ``first`` names a boolean column and an order: it marks exactly one row of each group, the
        first under the order (ascending, nulls last, ties by content).
        """
        group = Window.partitionBy(*keys, "_piece")
        place = [*first[1], "_tie"] if first else []
        aggs = [F.sum(c).alias(f"_all_{name}") for name, c in sums.items()]
        if first:
            aggs.append(F.min(F.struct(order_struct(place), "_piece")).alias("_leader"))
        carried = self.near
        if tuple(keys) != self.keys:
            carried = _at_borders(carried, keys, self.borders[tuple(keys)])
        carry = carried.groupBy(order_struct(keys).alias("_group")).agg(*aggs)

        def attach(rows: DataFrame, all_cross: bool) -> DataFrame:
            if first:  # before the sums: they need no more than the order that this one sorts by
                order = [F.col(c).asc_nulls_last() for c in place]
                rows = rows.withColumn("_place", F.row_number().over(group.orderBy(*order)))
            if not all_cross:
                rows = rows.withColumns({name: F.sum(c).over(group) for name, c in sums.items()})
            # at most one row per piece
            joined = rows.join(F.broadcast(carry), order_struct(keys) == F.col("_group"), "left")
            crosses = F.col("_group").isNotNull()
            out = {}
            for name in sums:
                whole = F.col(f"_all_{name}")
                out[name] = whole if all_cross else F.when(crosses, whole).otherwise(F.col(name))
            if first:
                leads = ~crosses | (F.col("_leader._piece") == F.col("_piece"))
                out[first[0]] = (F.col("_place") == 1) & leads
            spare = ["_group", *(f"_all_{name}" for name in sums), *(["_leader", "_place"] if first else [])]
            return joined.withColumns(out).drop(*spare)

        return replace(self, rows=attach(self.rows, False), near=attach(self.near, tuple(keys) == self.keys))

    def with_columns(self, columns: Mapping[str, Column]) -> Segments:
        return replace(self, rows=self.rows.withColumns(columns), near=self.near.withColumns(columns))

    def grouped(self, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
        """``sums`` by ``keys`` in place of the rows; rows that agree on ``keys`` must agree on the first keys too.

        A group that lies in one piece is summed there, and nothing is moved for it; the others are summed over ``near``.
        """
        aggs = [c.alias(name) for name, c in sums.items()]
        border = F.broadcast(self.borders[self.keys])  # fewer keys than pieces
        inside = self.rows.join(border, order_struct(self.keys) == F.col("_border"), "left_anti")
        whole = inside.groupBy("_piece", *keys).agg(*aggs).drop("_piece")
        return whole.unionByName(self.near.groupBy(*keys).agg(*aggs))

    def result(self, *drop: str) -> DataFrame:
        return self.rows.drop(*HIDDEN, *drop)


def _borders(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the groups that lie in several pieces: fewer than there are pieces."""
    ends = rows.groupBy("_piece").agg(F.min(order_struct(keys)).alias("first"), F.max(order_struct(keys)).alias("last"))
    found, seen = {}, set()
    for r in ends.collect():  # one row per piece
        for key in {r["first"], r["last"]}:
            if key in seen:
                found[key] = None
            seen.add(key)
    schema = StructType([StructField("_border", ends.schema["first"].dataType)])
    return rows.sparkSession.createDataFrame([(key,) for key in found], schema)


def _at_borders(rows: DataFrame, keys: Sequence[str], borders: DataFrame) -> DataFrame:
    # fewer keys than pieces
    return rows.join(F.broadcast(borders), order_struct(keys) == F.col("_border"), "left_semi")
