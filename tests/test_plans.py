"""Plan shape and skew: what has to hold when the data grows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from checks.derive import Derived
from ledgerweave import plans
from ledgerweave.functions import spread_null_key
from ledgerweave.operators import dedupe, intervals, points
from ledgerweave.operators import settlement as st
from ledgerweave.operators.keyfilter import key_filter, may_match, without_keys
from ledgerweave.operators.lookup import floor_date_lookup
from ledgerweave.operators.segments import Segments


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.endswith("_in_order")))  # those number another's rows
def test_no_pair_explosion_python_or_single_task_window(spark, sf_dir, name):
    plan = physical(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if " Window [" in line or "- Window [" in line:
            below = "\n".join(lines[i : i + 4])
            assert "SinglePartition" not in below


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = physical(QUERIES["paid_orders"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan or "Not(EqualTo(o_orderstatus,P))" in plan


def test_settlement_bounds_reach_the_cost_scan(spark, tmp_path):
    path = str(tmp_path / "costs")
    spark.createDataFrame(
        [(dt.datetime(2022, 7, 3), "d", 1, "1", "1", Decimal(1))],
        "base_dttm timestamp_ntz, batch_job string, kind int, order_id string, order_option_id string, coupon_cost decimal(18,2)",
    ).write.parquet(path)
    options = spark.createDataFrame(
        [(1, 7, 9, 5, "p", "o", 1, dt.datetime(2022, 7, 3), None, None)],
        "option_id bigint, seller_id bigint, product_id bigint, product_option_id bigint, product_name string, option_name string, "
        "option_count bigint, payment_at timestamp_ntz, delivery_complete_date timestamp_ntz, purchase_confirm_date timestamp_ntz",
    )
    out = st.settlement_branch(
        spark.read.parquet(path), options, st.PAYMENT, "coupon_cost", "coupon_total", dt.date(2022, 7, 1), dt.date(2022, 8, 1)
    )
    assert "LessThan(base_dttm,2022-08-01" in physical(out)
    assert out.count() == 1


def test_milestone_bound_reaches_the_scan(spark, tmp_path, sf_dir):
    tables = dict(Derived(spark, sf_dir))
    for name in ("dump.orders", "dump.order_options"):
        tables[name].limit(50).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    period = (dt.date(2022, 7, 1), dt.date(2022, 8, 1))
    for job, column in ((plans.payment_discounts, "payment_at"), (plans.delivery_discounts, "delivery_complete_date")):
        plan = physical(job(tables, None, period, "S", None, period))
        assert f"LessThan({column},2022-08-01" in plan


def test_latest_snapshot_filters_by_a_scalar_subquery(spark, sf_dir):
    plan = physical(QUERIES["latest_snapshot"](spark, sf_dir))
    assert "EqualTo(l_shipdate,ScalarSubquery" in plan


# --- one key with a third of the rows ------------------------------------------------------
HOT, N = 7, 60_000


def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id") % 5000 + 100)
    return spark.range(0, N, numPartitions=6).select(key.alias("k"), F.col("id"))


def test_hot_key_sends_one_row_per_task(spark):
    out = dedupe.latest_per_key(skewed(spark), ["k"], [F.col("id").desc()])
    assert out.filter(f"k = {HOT}").collect()[0].id == N - 3
    assert physical(out).count("WindowGroupLimit") == 2


def test_intervals_of_a_hot_key_see_one_row_per_day(spark):
    """A third of all events belong to one seller; the window only ever sees its days."""
    events = skewed(spark).select(
        F.col("k").cast("string").alias("s"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias("day"),
        (F.col("id") % 2 == 0).alias("start"),
    )
    spans = intervals.build_intervals(events, ["s"], "day", F.col("start"), ~F.col("start"), dt.date(2999, 12, 31))
    assert spans.filter(f"s = '{HOT}'").count() <= 90
    plan = physical(spans)
    assert plan.index("Window [") < plan.index("HashAggregate")  # the aggregate feeds the window


def test_rows_that_cannot_match_are_spread(spark):
    """Two thirds of the points have nothing to look up; their keys land on many reducers."""
    df = skewed(spark).withColumn("request", F.when(F.col("k") == HOT, F.col("id").cast("string")))
    keyed = df.withColumn("key", spread_null_key("request", "id"))
    sizes = [r["count"] for r in keyed.repartition(8, "key").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * N / 8


@pytest.fixture
def small_skew_thresholds(spark):
    """Adaptive skew handling scaled down from cluster sizes to the size of these frames."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_aqe_splits_the_hot_key_of_a_lookup(spark, small_skew_thresholds):
    """A dated price lookup where one option has a third of the sales."""
    sales = skewed(spark).select(F.col("k").cast("string").alias("o"), F.lit("20220105").alias("d"), F.md5(F.col("id").cast("string")).alias("pay"))
    prices = spark.range(0, 5200).select(
        F.col("id").cast("string").alias("po"), F.lit("20220105").alias("pd"), (F.col("id") * 2).alias("price")
    )
    found = floor_date_lookup(sales, prices, "o", "d", "po", "pd", "20220101")
    out = found.groupBy("price").agg(F.count("pay").alias("n"), F.max("pay"))
    got = {r.price: r.n for r in out.collect()}
    assert got[2 * HOT] == N // 3 and sum(got.values()) == N
    assert "skew=true" in physical(out) or "isSkew=true" in physical(out)


@pytest.mark.parametrize("hot", [False, True])
def test_totals_deal_rows_once_and_spread_the_hot_key(spark, small_skew_thresholds, hot):
    key = F.when((F.col("id") % 3 == 0) & F.lit(hot), F.lit(HOT)).otherwise(F.col("id") % 5000 + 100)
    df = spark.range(0, N, numPartitions=6).select(key.alias("k"), "id", F.md5(F.col("id").cast("string")).alias("pay"))
    pieces = Segments.of(df, ["k"])
    held = {r["_piece"]: r["count"] for r in pieces.rows.groupBy("_piece").count().collect()}
    assert len(held) == 16 and max(held.values()) < 2 * N / 16  # however many rows one key has
    out = pieces.total(["k"], {"n": F.lit(1)}, ("is_first", ["id"])).result()
    # the rows of the result are read in their pieces; only carries, no longer than the pieces, move
    main = physical(out).split("Window [")[0].count("Exchange")
    assert main == physical(out).split("Window [")[0].count("BroadcastExchange") and "rangepartitioning" not in physical(out)
    got = out.groupBy("k").agg(F.max("n").alias("n"), F.min("n").alias("m"), F.count("pay").alias("c"), F.count_if("is_first").alias("f"))
    assert got.filter("n <> c or m <> c or f <> 1").count() == 0 and out.count() == N


def test_the_report_of_allocated_rows_groups_no_whole_rows(spark, sf_dir):
    plan = physical(QUERIES["allocate_residual"](spark, sf_dir))
    assert "hashpartitioning(o_orderkey" not in plan and "SortMergeJoin" not in plan


def test_early_sales_of_a_hot_option_meet_two_prices_only(spark, small_skew_thresholds):
    """A third of all sales lie before the floor, next to hundreds of early prices of their option."""
    day = F.date_format(F.date_add(F.lit(dt.date(2021, 1, 1)), (F.col("id") % 300).cast("int")), "yyyyMMdd")
    sales = skewed(spark).select(F.col("k").cast("string").alias("o"), day.alias("d"), F.col("id"))
    prices = spark.range(0, 300).select(F.lit(str(HOT)).alias("po"), day.alias("pd"), F.col("id").alias("price"))
    prices = prices.unionByName(spark.createDataFrame([(str(HOT), "20220101", -1)], "po string, pd string, price bigint"))
    found = floor_date_lookup(sales, prices, "o", "d", "po", "pd", "20220101")
    got = found.groupBy("o", (F.col("price") == -1).alias("floor")).count().filter(f"o = '{HOT}'").collect()
    assert {r.floor: r["count"] for r in got} == {True: N // 3, False: N // 3}
    assert found.filter(f"o <> '{HOT}'").count() == N - N // 3


def test_clicks_are_summed_before_the_interval_join(spark, sf_dir):
    plan = physical(plans.ad_agency_fee(Derived(spark, sf_dir), dt.date(2024, 3, 1)))
    join = plan.index("Join")
    assert plan[join:].count("HashAggregate") >= 2


def test_copies_are_folded_before_the_legacy_join(spark):
    history = spark.range(0, 3000).select(
        F.lit("50").alias("user_id"), F.lit(900).cast("bigint").alias("mileage_id"), F.lit(1).cast("bigint").alias("mileage"), F.lit("800").alias("reference_mileage_id")
    )
    p = spark.createDataFrame(
        [(1, 50, 900, "A", None, None, None), (2, 50, 800, "B", None, None, None)],
        "id bigint, user_id bigint, payload bigint, category_type string, created_at timestamp_ntz, use_end_date date, request_id string",
    )
    out = points.legacy_origin(p, history, p, F.lit(True))
    got = {r.id: (r.history_copies, r.mig_id) for r in out.collect()}
    assert got == {1: (3000, 2), 2: (1, None)}


def test_only_history_that_may_be_asked_for_is_shuffled(spark, tmp_path):
    """A thousand untraced points against 200,000 history rows and older points: the key filter leaves few."""
    n = 200_000
    history = spark.range(0, n).selectExpr(
        "CAST(id % 50000 AS string) AS user_id", "id AS mileage_id", "id AS mileage", "CAST(id + 1 AS string) AS reference_mileage_id"
    )
    older = spark.range(0, n).selectExpr(
        "id", "id % 50000 AS user_id", "id AS payload", "'A' AS category_type", "CAST(null AS timestamp_ntz) AS created_at",
        "CAST(null AS date) AS use_end_date", "CAST(null AS string) AS request_id",
    )
    history.write.parquet(str(tmp_path / "history"))
    older.write.parquet(str(tmp_path / "older"))
    history, older = spark.read.parquet(str(tmp_path / "history")), spark.read.parquet(str(tmp_path / "older"))
    untraced = spark.range(0, n).selectExpr("id", "id % 50000 AS user_id", "id AS payload", "id % 200 <> 0 AS known")
    key = F.concat_ws("|", "user_id", F.col("mileage_id").cast("string"))
    wanted = untraced.filter("not known").select(F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("payload").cast("string")).alias("k"))
    kept = may_match(history, key, key_filter(wanted, F.col("k")))
    assert 1000 <= kept.count() < 1100 and kept.columns == history.columns
    assert kept.join(wanted, key == F.col("k"), "left_semi").count() == 1000
    out = points.legacy_origin(untraced, history, older, ~F.col("known"))
    assert out.count() == n and out.filter("mileage is not null").count() == 1000
    # both filters are looked up below the shuffles of what they filter
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for column in ("reference_mileage_id:string", "category_type:string"):  # of the scans of history and older points
        above = plan[: plan.index(column)].rsplit("Exchange hashpartitioning", 1)[1]
        assert "BroadcastHashJoin" in above, column


def test_key_filter_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    assert may_match(df, F.col("k"), key_filter(df.filter("k = 1"), F.col("k"))).collect() == [(1,)]
    assert may_match(df, F.col("k"), key_filter(df.filter("k is null"), F.col("k"))).collect() == []


def test_an_anti_join_shuffles_only_rows_that_may_go(spark, tmp_path):
    spark.range(0, 50_000).selectExpr("id AS k", "repeat('x', 50) AS text").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows")).unionByName(spark.createDataFrame([(None, "null")], "k bigint, text string"))
    gone = spark.range(0, 50_000, 500).withColumnRenamed("id", "k")
    out = without_keys(df, "k", gone)
    assert out.columns == df.columns and out.count() == 50_001 - 100 and out.filter("k % 500 = 0").count() == 0
    assert without_keys(df, "k", gone.limit(0)).count() == 50_001
