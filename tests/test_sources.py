"""Schemas, catalogue, calendar, code map, partition discovery."""

import datetime as dt

from pyspark.sql import functions as F

import pytest
from pyspark.sql.types import StructType

from ledgerweave import plans
from ledgerweave.operators import codemap
from ledgerweave.sources.calendar import calendar
from ledgerweave.sources.catalog import Catalog, conform
from ledgerweave.sources.schemas import SCHEMAS
from tests.conftest import none_left, rows, shuffle_files


def test_every_schema_parses(spark):
    assert len(SCHEMAS) == 58
    for ddl in SCHEMAS.values():
        assert StructType.fromDDL(ddl).fields


def test_catalog_reads_renames_and_checks(spark, tmp_path):
    df = spark.createDataFrame([("3", "1P", "co")], "seller string, biz string, company_name string")
    df.write.parquet(str(tmp_path / "temp.fin_non_3p_seller_current"))
    name = "temp.fin_non_3p_seller_current"
    cat = Catalog(spark, str(tmp_path), renames={name: {"seller": "seller_id"}})
    assert rows(cat[name]) == [("3", "1P", "co")]
    with pytest.raises(ValueError, match="seller_id"):
        Catalog(spark, str(tmp_path))[name]
    with pytest.raises(KeyError):
        cat["no.such_table"]
    assert len(cat) == 58 and name in list(cat)


def test_conform_casts_only_what_differs(spark):
    df = spark.createDataFrame([(1, "x", "y", 5)], "production_id int, type string, extra string, n int")
    out = conform(df, "ba.pbc_products")
    assert out.dtypes == [("production_id", "bigint"), ("type", "string")]


def test_calendar(spark):
    got = rows(calendar(spark, dt.date(2023, 1, 1), dt.date(2023, 1, 2)))
    assert got == [
        (dt.date(2023, 1, 1), dt.date(2022, 12, 26), dt.date(2023, 1, 1), "202301"),
        (dt.date(2023, 1, 2), dt.date(2023, 1, 2), dt.date(2023, 1, 1), "202301"),
    ]


def test_code_map_is_replaced_not_appended(spark, tmp_path):
    path = str(tmp_path / "codes")
    for _ in range(2):
        stored = plans.request_code_map(spark, path)
    assert stored.count() == 142 == len(codemap.code_map_rows())
    assert stored.select("col").distinct().count() == 16
    assert rows(stored.filter("col = 'scale'")) == [("scale", 0, "종합"), ("scale", 1, "개별"), ("scale", 2, "상업/카페")]
    files = list((tmp_path / "codes").glob("*.snappy.parquet"))
    assert len(files) == 1


def test_new_partition_is_seen_and_others_are_pruned(spark, tmp_path):
    from ledgerweave.operators import ads
    from tests.test_intervals import LEDGER, click

    path = str(tmp_path / "ledger")

    def add(day):
        spark.createDataFrame([click(day, 10, 1, True)], LEDGER).write.mode("append").partitionBy("year", "month", "day").parquet(path)

    def read():
        return Catalog(spark, paths={"advertise.ad-ledger": path})["advertise.ad-ledger"]

    add(dt.date(2022, 3, 31))
    assert read().count() == 1
    add(dt.date(2022, 4, 1))
    clicks = ads.normalise_ad_ledger(read(), first_day=dt.date(2022, 4, 1))
    assert rows(clicks, "date") == [(dt.date(2022, 4, 1),)]
    scan = clicks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(((year" in scan or "PartitionFilters: [((year" in scan
    assert len(clicks.inputFiles()) >= 1


def test_partition_values_keep_their_zeros_and_the_newest_is_listed(spark, tmp_path):
    from ledgerweave.operators.settlement import latest_snapshot

    name, root = "dump_settlement_stage.order_sales_l", str(tmp_path)
    empty = spark.createDataFrame([], StructType.fromDDL(SCHEMAS[name]))
    for day in ("2023-01-09", "2023-01-10"):
        rows_ = spark.range(2).select(*[(F.lit(day) if f.name == "base_dt" else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])
        rows_.write.mode("append").partitionBy("base_dt").parquet(f"{root}/{name}")
    tables = Catalog(spark, root)
    assert tables.newest(name, "base_dt") == "2023-01-10"
    assert tables.newest(name, "other") is None
    found = latest_snapshot(tables[name], "base_dt", newest=tables.newest(name, "base_dt"))
    assert found.count() == 2 and found.select("base_dt").distinct().collect()[0][0] == "2023-01-10"
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(base_dt" in scan


def test_newest_leaves_out_null_and_empty_partitions(spark, tmp_path):
    name = "dump_settlement_stage.order_sales_l"
    schema = StructType.fromDDL(SCHEMAS[name])
    for day in ("2023-01-09", None):
        df = spark.range(1).select(*[F.lit(day if f.name == "base_dt" else None).cast(f.dataType).alias(f.name) for f in schema.fields])
        df.write.mode("append").partitionBy("base_dt").parquet(f"{tmp_path}/{name}")
    (tmp_path / name / "base_dt=2023-01-11").mkdir()
    assert Catalog(spark, str(tmp_path)).newest(name, "base_dt") == "2023-01-09"
    assert Catalog(spark, str(tmp_path)).newest(name, "other") is None


def test_materialise_survives_and_prunes(spark):
    from ledgerweave.session import materialise

    out = materialise(spark.range(0, 100).selectExpr("id", "id * 2 AS twice", "'x' AS pad"))
    assert out.agg({"twice": "sum"}).collect()[0][0] == 9900
    assert "ReadSchema: struct<twice:bigint>" in out.groupBy().sum("twice")._jdf.queryExecution().executedPlan().toString()


def test_newest_of_a_metastore_table_is_listed_without_a_job(spark, tmp_path):
    from ledgerweave.operators.settlement import latest_snapshot

    name, table = "dump_settlement_stage.order_sales_l", "newest_of_a_metastore_table"
    schema = StructType.fromDDL(SCHEMAS[name])
    for day in ("2023-01-09", "2023-01-10", None):
        df = spark.range(2).select(*[F.lit(day if f.name == "base_dt" else None).cast(f.dataType).alias(f.name) for f in schema.fields])
        df.write.mode("append").format("parquet").partitionBy("base_dt").option("path", str(tmp_path / "t")).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} ADD PARTITION (base_dt = '2023-01-11')")  # listed, but nothing in it
    tables = Catalog(spark, tables={name: table})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("newest", "newest", False)
    assert tables.newest(name, "base_dt") == "2023-01-10"
    assert not tracker.getJobIdsForGroup("newest")
    spark.sparkContext._jsc.clearJobGroup()
    found = latest_snapshot(tables[name], "base_dt", newest=tables.newest(name, "base_dt"))
    assert found.count() == 2
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(base_dt" in scan and "2023-01-10" in scan
    assert tables.newest(name, "id") is None
    spark.sql("CREATE OR REPLACE TEMP VIEW not_partitioned AS SELECT 1 AS id")
    assert Catalog(spark, tables={name: "not_partitioned"}).newest(name, "base_dt") is None
    spark.sql(f"DROP TABLE {table}")


def test_newest_of_a_renamed_partition_column(spark, tmp_path):
    name = "dump_settlement_stage.order_sales_l"
    schema = StructType.fromDDL(SCHEMAS[name])
    df = spark.range(1).select(*[F.lit("2023-05-06" if f.name == "base_dt" else None).cast(f.dataType).alias(f.name) for f in schema.fields])
    df.withColumnRenamed("base_dt", "snapshot").write.partitionBy("snapshot").option("path", str(tmp_path / "r")).saveAsTable("renamed_snapshot")
    tables = Catalog(spark, tables={name: "renamed_snapshot"}, renames={name: {"snapshot": "base_dt"}})
    assert tables.newest(name, "base_dt") == "2023-05-06" and tables[name].count() == 1
    spark.sql("DROP TABLE renamed_snapshot")


@pytest.mark.parametrize("job", ["issues", "payments"])
def test_bucketed_hierarchy_is_joined_without_a_shuffle(spark, sf_dir, tmp_path, job):
    from checks.derive import Derived
    from ledgerweave.operators import settlement as st
    from ledgerweave.plans.orders import _paid_options
    from ledgerweave.sources.layout import write_hierarchy

    derived = Derived(spark, sf_dir)
    made = write_hierarchy(spark, derived, str(tmp_path), 4, prefix=f"hierarchy_{job}_")
    copies = Catalog(spark, tables=made)

    def joined(tables):
        if job == "issues":
            return _paid_options(tables, None, only_missing_status=False)
        names = ("dump.order_options", "dump.order_productions", "dump.orders")
        return st.seller_options(*[tables[n] for n in names], st.PAYMENT, None)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined(copies)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        assert "Exchange" in joined(derived)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain, own = joined(derived), joined(copies)
    assert sorted(own.columns) == sorted(plain.columns)
    assert own.select(*plain.columns).exceptAll(plain).count() == 0 == plain.exceptAll(own.select(*plain.columns)).count()
    for table in made.values():
        spark.sql(f"DROP TABLE {table}")


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    """All rows of a partition in one task would be sorted there, whatever their number."""
    from checks.stored import by_partition

    df = spark.range(0, 40_000, 1, 4).select(F.lit("2023-03-01").alias("base_dt"), F.md5(F.col("id").cast("string")).alias("t"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        by_partition(df, ["base_dt"]).write.partitionBy("base_dt").parquet(str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "base_dt=2023-03-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).distinct().count() == 40_000


def test_buckets_follow_the_size_of_the_options(spark, tmp_path, monkeypatch):
    from ledgerweave.sources import layout

    folder = str(tmp_path / "dump.order_options")
    spark.range(0, 20_000, 1, 2).write.parquet(folder)
    options = spark.read.parquet(folder).groupBy("id").count()
    assert layout.bucket_count(options, 8) == 8
    monkeypatch.setattr(layout, "BUCKET_BYTES", 8 << 10)
    assert layout.bucket_count(options, 8) > 8
    assert layout.bucket_count(spark.createDataFrame([(1,)], "id long"), 8) == 8


def test_bucketed_copies_leave_no_shuffle_files(spark, sf_dir, tmp_path):
    """The copies of one table are dealt after those of another, so their shuffles are not held together."""
    from checks.derive import Derived
    from ledgerweave.sources.layout import write_hierarchy

    before = shuffle_files(spark)
    made = write_hierarchy(spark, Derived(spark, sf_dir), str(tmp_path), 4, prefix="hierarchy_files_")
    assert none_left(spark, before)
    for table in made.values():
        spark.sql(f"DROP TABLE {table}")


def test_stored_tables_leave_no_shuffle_files(spark, sf_dir):
    from checks.stored import HIERARCHY, SALES, stored

    before = shuffle_files(spark)
    tables = stored(spark, sf_dir, [*HIERARCHY, SALES], partitions={SALES: ["base_dt"]})
    assert none_left(spark, before)
    assert tables[SALES].count() > 0 and tables.newest(SALES, "base_dt") == "2023-03-02"
