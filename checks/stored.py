"""Reports that read their tables through the catalogue, as a deployment does.

The derived tables are written first: as folders (some under other column names, some laid out by partition), as
metastore tables, or as bucketed copies of the order hierarchy. Then the report opens them by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import jobs
from checks.derive import AS_OF, CALENDAR, Derived, base_table
from checks.jobs import COUPON, HIERARCHY, LEDGER, SALE_DETAILS, SALES, SELLERS, STAGE
from checks.registry import ORACLES, register
from ledgerweave import plans
from ledgerweave.session import scratch_path, shuffles_dropped
from ledgerweave.sources.catalog import Catalog
from ledgerweave.sources.layout import write_hierarchy


def stored(
    spark: SparkSession,
    sf_dir: str,
    names: Sequence[str],
    partitions: Mapping[str, Sequence[str]] | None = None,
    metastore: Sequence[str] = (),
    renames: Mapping[str, Mapping[str, str]] | None = None,
    buckets: int = 0,
) -> Catalog:
    """Write the derived tables and open them: a catalogue over folders and metastore tables."""
    derived, root, run = Derived(spark, sf_dir), scratch_path(spark, "stored"), uuid.uuid4().hex[:12]
    partitions, renames, tables = partitions or {}, renames or {}, {}
    if buckets:
        tables |= write_hierarchy(spark, derived, f"{root}/hierarchy", buckets, prefix=f"stored_{run}_")
    for name in names:
        if name in tables:
            continue
        df = derived[name]
        for physical, declared in renames.get(name, {}).items():
            df = df.withColumnRenamed(declared, physical)
        writer = df.write
        if name in partitions:
            writer = by_partition(df, partitions[name]).write.partitionBy(*partitions[name])
        writer = writer.format("parquet").option("compression", "zstd")
        with shuffles_dropped(spark):
            if name in metastore:
                tables[name] = f"stored_{run}_{name.replace('.', '_').replace('-', '_')}"
                writer.option("path", f"{root}/metastore/{name}").saveAsTable(tables[name])
            else:
                writer.save(f"{root}/{name}")
    return Catalog(spark, root, tables=tables, renames=renames)


def by_partition(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows near others of their partition, few files each: a large partition is dealt over several tasks, as its size asks."""
    return df.hint("rebalance", *[F.col(c) for c in columns])


ISSUE_TABLES = [
    *HIERARCHY,
    SELLERS,
    jobs.CANCELS,
    jobs.EXCHANGES,
    "dump.productions",
    "dump.users",
    "dump.sales_users",
    "dump.admin_categories",
]


@register("option_issues_colocated", ORACLES["option_issues"])
def option_issues_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``option_issues`` over bucketed copies of orders, productions and options: two joins without a shuffle."""
    tables = stored(spark, sf_dir, ISSUE_TABLES, buckets=8)
    return plans.option_issues(
        tables, AS_OF, jobs.ISSUES_BEFORE, first_party_seller=jobs.FIRST_PARTY_SELLER, link_prefix=jobs.LINK
    )


@register("payment_discounts_colocated", ORACLES["payment_discounts"])
def payment_discounts_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payment_discounts`` over the bucketed copies, costs and staged tables from folders."""
    tables = stored(spark, sf_dir, [*HIERARCHY, COUPON, jobs.MILEAGE, *STAGE], buckets=8)
    return plans.payment_discounts(tables, **jobs.SETTLE_ARGS)


@register("purchase_confirm_stored", ORACLES["purchase_confirm_discounts"])
def purchase_confirm_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``purchase_confirm_discounts`` with snapshots in metastore tables: the newest is found by listing partitions."""
    tables = stored(
        spark,
        sf_dir,
        [*HIERARCHY, jobs.CART_COUPON, jobs.MILEAGE, SALES, SALE_DETAILS],
        partitions={SALES: ["base_dt"], SALE_DETAILS: ["base_dt"]},
        metastore=[SALES, SALE_DETAILS],
    )
    return plans.purchase_confirm_discounts(tables, None, jobs.PERIOD, None, jobs.PERIOD)


@register("agency_fee_stored", ORACLES["agency_fee"])
def agency_fee_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``agency_fee`` with the ad ledger by year, month and day, the mapping under another column name, users in the metastore."""
    tables = stored(
        spark,
        sf_dir,
        [LEDGER, jobs.AGENCY],
        partitions={LEDGER: ["year", "month", "day"]},
        metastore=[jobs.AGENCY],
        renames={jobs.AGENCY: {"agency_name": "agency"}},
    )
    return plans.ad_agency_fee(tables, jobs.AD_AS_OF)


@register("marketing_expense_stored", ORACLES["marketing_expense"])
def marketing_expense_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["ba_preserved.mkt_cost_d", "ba_preserved.mkt_cost_m", "temp.fin_mkt_freecash", CALENDAR]
    tables = stored(spark, sf_dir, names, metastore=[CALENDAR], renames={"temp.fin_mkt_freecash": {"ymd": "yyyymmdd"}})
    return plans.marketing_expense(tables, AS_OF)


@register("user_cohort_stored", ORACLES["user_cohort"])
def user_cohort_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_cohort`` from a folder that is laid out by month."""
    name = "ba_preserved.mkt_arppu_summary"
    return plans.user_cohort(stored(spark, sf_dir, [name], partitions={name: ["month"]}), jobs.OVERRIDES)


@register(
    "newest_snapshot_rows",
    """
    SELECT strftime(l_shipdate, '%Y-%m') AS base_dt, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 1
    """,
)
def newest_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items laid out by shipping month in a metastore table; only the newest month is read."""
    from ledgerweave.operators.settlement import latest_snapshot

    lines = base_table(spark, sf_dir, "lineitem").withColumn("base_dt", F.date_format("l_shipdate", "yyyy-MM"))
    table = f"stored_{uuid.uuid4().hex[:12]}_lines"
    dealt = by_partition(lines, ["base_dt"]).write.format("parquet").partitionBy("base_dt")
    dealt.option("path", scratch_path(spark, "stored")).saveAsTable(table)
    tables = Catalog(spark, tables={SALES: table})
    found = latest_snapshot(spark.table(table), "base_dt", newest=tables.newest(SALES, "base_dt"))
    return found.groupBy("base_dt").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
