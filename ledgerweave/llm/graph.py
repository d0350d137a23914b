"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import Stages


def _with_least(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``edges`` with m, the smallest neighbour of u in ``of``.

    The packed key makes the aggregate a plain side of the join, so a hub's rows can be split.
    """
    least = of.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("_of"), "m")
    return edges.withColumn("_own", F.struct("u")).join(least, F.col("_own") == F.col("_of")).drop("_own", "_of")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b, long): component is its smallest node.

    Each round hangs all larger neighbours of a node on its smallest one, then all smaller ones;
    nodes come together in about log of the component's diameter rounds. Self links, repeated
    and null links change nothing. Only tables move between rounds; the driver sees two numbers.
    """
    edges = stages.write(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # larger neighbours of u on the smallest node around u
        large = _with_least(both.filter("v > u"), both).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stages.write(large.distinct(), "large")
        # smaller neighbours of u, and u itself, on the smallest of them
        joined = _with_least(large, large)
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        new = stages.write(small.distinct(), "small")
        after = _digest(new)
        stages.drop(edges, large)
        edges = new
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
