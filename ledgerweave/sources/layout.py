"""Bucketed copies of the order hierarchy, so that its joins need no shuffle.

Orders, productions and options are written by order id into the same number of buckets; options get the order
id of their production, which the source lacks. The one shuffle per table is paid when the copy is
written, once for all reports that read it. A bucket is one task of a report: as all rows of an
order share one, an order should not hold a large share of all options; where one might, read
the plain tables, whose joins adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.session import shuffles_dropped

ORDERS, PRODUCTIONS, OPTIONS = "dump.orders", "dump.order_productions", "dump.order_options"
ROOT_ORDER = "root_order_id"  # the extra column of options
BUCKET_BYTES = 32 << 20  # of the files that options are read from, for each bucket


def _file_bytes(df: DataFrame) -> int:
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def bucket_count(options: DataFrame, least: int) -> int:
    """Buckets of the copies: as many as the files of ``options`` ask for, so a bucket's task does not grow with the table."""
    return max(least, -(-_file_bytes(options) // BUCKET_BYTES))


def write_hierarchy(
    spark: SparkSession, tables: Mapping[str, DataFrame], path: str, buckets: int, database: str = "default", prefix: str = ""
) -> dict[str, str]:
    """Write the copies as tables ``database.prefix + orders | order_productions | order_options`` under ``path``.

    There are ``buckets`` of them, or more as ``bucket_count`` says. Returns the names for ``Catalog(tables=...)``. Existing copies of the names are replaced. Options whose
    production is missing are kept, in the bucket of null: they join nothing, as in the plain tables.
    """
    buckets = bucket_count(tables[OPTIONS], buckets)
    parent = tables[PRODUCTIONS].select(F.col("id").alias("_parent"), F.col("order_id").alias(ROOT_ORDER))
    options = tables[OPTIONS].join(parent, F.col("order_production_id") == F.col("_parent"), "left").drop("_parent")
    made = {}
    for name, df, key in ((ORDERS, tables[ORDERS], "id"), (PRODUCTIONS, tables[PRODUCTIONS], "order_id"), (OPTIONS, options, ROOT_ORDER)):
        table = f"{database}.{prefix}{name.split('.')[1]}"
        dealt = df.repartition(buckets, key)  # one file per bucket
        writer = dealt.write.mode("overwrite").format("parquet").option("path", f"{path}/{name}").option("compression", "zstd")
        with shuffles_dropped(spark):
            writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        made[name] = table
    return made
