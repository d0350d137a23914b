"""Point origin, expiry, departments, and the control-total invariant of the report."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.derive import AS_OF, SERVICE, Derived
from ledgerweave import plans
from ledgerweave.operators import points
from ledgerweave.operators.segments import Segments
from ledgerweave.sources.schemas import SCHEMAS
from tests.conftest import rows

D, TS = dt.date, dt.datetime


@pytest.mark.parametrize(
    "category, origin",
    [
        ("CONFIRM_ORDER", "CONFIRM_ORDER"),
        ("WITHDRAW_BY_ADMIN", "WITHDRAW_BY_ADMIN"),
        ("ORDER_REFUND", "ORDER_CANCEL/REFUND"),
        ("ORDER_CANCEL", "ORDER_CANCEL/REFUND"),
        ("SIGNUP", "EVENT"),
        (None, "UNKNOWN"),
    ],
)
def test_origin_category(frame, category, origin):
    df = frame([(category,)], "c string")
    assert rows(df.select(points.origin_category(F.col("c")))) == [(origin,)]


def test_origin_biz_and_label(frame):
    df = frame([("CONFIRM_ORDER", "1P"), ("CONFIRM_ORDER", "PREMIUM"), ("CONFIRM_ORDER", None), ("EXPIRE", "1P")], "c string, b string")
    biz = points.origin_biz(F.col("c"), F.col("b"))
    got = [r[0] for r in df.select(points.with_suffix(F.col("c"), biz)).collect()]
    assert got == ["CONFIRM_ORDER-1P", "CONFIRM_ORDER-1P", "CONFIRM_ORDER-3P", "EXPIRE"]


def test_expiry_flags(frame):
    df = frame(
        [(D(2022, 1, 31), D(2022, 3, 31)), (D(2022, 1, 31), D(2022, 3, 30)), (None, D(2022, 5, 30)), (D(2022, 1, 1), None)],
        "a date, b date",
    )
    got = [tuple(r)[2:] for r in points.expiry_flags(df, "a", "b", D(2022, 6, 1)).collect()]
    assert got == [("true", "true"), ("false", "true"), ("unknown", "true"), ("unknown", "unknown")]
    edge = points.expiry_flags(frame([(D(2022, 1, 1), D(2022, 5, 31))], "a date, b date"), "a", "b", D(2022, 6, 1))
    assert edge.collect()[0].exp_date_pass == "false"


def test_short_points(frame):
    df = frame(
        [
            (1, "ACCUM", TS(2022, 1, 31, 9), D(2022, 2, 28)),
            (2, "ACCUM", TS(2022, 1, 31, 9), D(2022, 2, 27)),
            (3, "USE", TS(2022, 1, 31, 9), D(2022, 2, 1)),
            (4, "WITHDRAW", TS(2022, 1, 31, 9), None),
            (5, "WITHDRAW", TS(2022, 1, 31, 9), D(2021, 12, 1)),
        ],
        "id bigint, process_type string, created_at timestamp_ntz, use_end_date date",
    )
    assert rows(points.short_points(df)) == [(2,), (5,)]


def test_department_label(frame):
    df = frame([("1P-", "REWARD", True), (None, "OTHER", True), (None, "OTHER", False), ("3P-", None, False)], "b string, d string, s boolean")
    got = [r[0] for r in df.select(points.point_department(F.col("b"), F.col("d"), F.col("s"))).collect()]
    assert got == ["1P-REWARD", "OTHER-SHORT", "OTHER-NORMAL", None]


def small_tables(spark):
    """One traced accumulation, its use, and a legacy use with two history origins."""

    def t(name, data):
        return spark.createDataFrame(data, SCHEMAS[name])

    made = TS(2022, 1, 10, 10)
    point = "dump_point.points"
    return {
        point: t(
            point,
            [
                (1, 50, "v1", "ACCUM", Decimal(1000), "POINT", "S", "CONFIRM_ORDER", made, "70", D(2022, 12, 31), 900),
                (2, 50, "v1", "USE", Decimal(-400), "POINT", "S", "USE_FOR_ORDER", made, None, None, 901),
                (3, 50, "v1", "USE", Decimal(-100), "POINT", "S", "USE_FOR_ORDER", made, None, None, 902),
                (4, 50, "m", "ACCUM", Decimal(60), "POINT", "S", "SIGNUP", TS(2021, 5, 1), None, D(2021, 5, 20), 800),
                (5, 50, "m", "ACCUM", Decimal(70), "POINT", "S", "ORDER_REFUND", TS(2021, 6, 1), None, None, 801),
            ],
        ),
        "dump_point.point_details": t(
            "dump_point.point_details", [(11, 1, 11, D(2022, 12, 31), Decimal(1000)), (12, 2, 11, None, Decimal(-400))]
        ),
        "dump.order_options": spark.createDataFrame(
            [(70, 7)], "id bigint, order_production_id bigint"
        ),
        "dump.order_productions": spark.createDataFrame([(7, 3)], "id bigint, seller_id bigint"),
        "temp.fin_non_3p_seller_current": spark.createDataFrame([("3", "PREMIUM")], "seller_id string, biz string"),
        "finance.mileage_point_type_mapping": spark.createDataFrame(
            [("CONFIRM_ORDER", "a", "REWARD"), ("SIGNUP", "b", "OTHER")], "category_type string, acct_type string, dept string"
        ),
        "finance.fin_mileage_histories_d": t(
            "finance.fin_mileage_histories_d", [("50", 902, 1, "800"), ("50", 902, 2, "801"), ("51", 902, 5, "800")]
        ),
    }


def test_origins_of_traced_and_legacy_points(spark):
    got = plans.points.point_origin_rows(small_tables(spark), "S", D(2023, 1, 1))
    picked = rows(
        got, "point_id", "accum_ver", "accum_acct_cate_biz", "accum_dept", "accum_mm", "over_1mnth", "legacy_accum_id", "fixed_amount"
    )
    assert picked == [
        (1, "MSA", "CONFIRM_ORDER-1P", "REWARD", "202201", "true", None, 1000.0),
        # as in the source report the option is that of the use's own request, so none is found
        (2, "MSA", "CONFIRM_ORDER-3P", "REWARD", "202201", "unknown", None, -400.0),
        # -100 by weights 1 and 2: -33 and -67 add up, nothing is left over
        (3, "LEGACY", "EVENT", "OTHER", "202105", "false", 4, -33.0),
        (3, "LEGACY", "ORDER_CANCEL/REFUND", None, "202106", "unknown", 5, -67.0),
        (4, "LEGACY", "EVENT", "OTHER", "202105", "false", None, 60.0),
        (5, "LEGACY", "ORDER_CANCEL/REFUND", None, "202106", "unknown", None, 70.0),
    ]


def test_tied_origins_share_the_amount_exactly(spark, sf_dir):
    """Histories that differ in no column of the order: one of them takes the rest."""
    from ledgerweave.operators.points import share_points

    base = plans.points.point_origin_rows(Derived(spark, sf_dir), SERVICE, AS_OF)
    base = base.drop("dist_amount", "is_first", "fixed_amount").filter("process_type <> 'ACCUM'").limit(1)
    tied = base.withColumns({"amount": F.lit(100).cast("decimal(18,2)"), "mileage": F.lit(3).cast("bigint"), "copies": F.lit(1).cast("bigint")})
    three = tied.unionByName(tied).unionByName(tied)
    got = share_points(three).agg(F.sum("fixed_amount"), F.count_if("is_first")).collect()[0]
    assert tuple(got) == (100, 1)


def test_report_equals_control_total_without_fan_out(spark):
    tables = small_tables(spark)
    total = sum(r.amt for r in plans.point_control_total(tables, "S").collect())
    report = plans.point_report(tables, "S", D(2023, 1, 1)).collect()
    assert sum(r.amount for r in report) == total == 630


def test_duplicate_mapping_rows_repeat_points_as_copies(spark):
    tables = small_tables(spark)
    once = plans.points.point_origin_rows(tables, "S", D(2023, 1, 1))
    history = tables["finance.fin_mileage_histories_d"]
    tables["finance.fin_mileage_histories_d"] = history.union(history.filter("reference_mileage_id = '800'"))
    twice = plans.points.point_origin_rows(tables, "S", D(2023, 1, 1))
    assert once.agg(F.sum("copies")).collect()[0][0] == 6
    assert twice.agg(F.sum("copies")).collect()[0][0] == 7
    # weights 1, 1, 2: parts -25, -25, -50 and still the whole amount
    assert rows(twice.filter("point_id = 3"), "legacy_accum_id", "fixed_amount") == [(4, -50.0), (5, -50.0)]


def test_details_add_up_to_their_amount(spark, sf_dir):
    rows_df = plans.points.point_origin_rows(Derived(spark, sf_dir), SERVICE, AS_OF)
    used = rows_df.filter("process_type != 'ACCUM'")
    bad = (
        used.groupBy("detail_id", "point_id")
        .agg(F.sum("fixed_amount").alias("s"), F.max("amount").alias("whole"), F.max("share_key").alias("k"))
        .filter(F.abs(F.col("s") - F.col("whole").cast("double")) > 0.001)
    )
    # detail and point ids share one number space, so the first row of a mixed key belongs to
    # one of its groups only; groups that are alone under their key must add up
    mixed = rows_df.groupBy("share_key").agg(F.countDistinct(F.concat_ws("|", F.coalesce(F.col("detail_id").cast("string"), F.lit("-")), F.col("point_id").cast("string"))).alias("g")).filter("g > 1")
    assert bad.join(mixed, bad.k == mixed.share_key, "left_anti").count() == 0


def test_department_measures_fall_back_to_the_pinned_snapshot(spark):
    tables = small_tables(spark)
    tables["dump.order_options"] = tables["dump.order_options"].limit(0)
    snap = spark.createDataFrame([(70, 7, "2022-12-01"), (70, 8, "2022-12-02")], "id bigint, order_production_id bigint, base_dt string")
    prods = spark.createDataFrame([(7, 3, "2022-12-01"), (8, 99, "2022-12-02")], "id bigint, seller_id bigint, base_dt string")
    args = (tables["dump_point.points"], tables["dump.order_options"], tables["dump.order_productions"], snap, prods)
    sellers = tables["temp.fin_non_3p_seller_current"]
    assert rows(points.point_biz(*args, sellers, "2022-12-01")) == [(1, "PREMIUM-")]
    assert rows(points.point_biz(*args, sellers, "2022-12-02")) == [(1, "3P-")]
    assert rows(points.point_biz(*args, sellers, "2022-12-03")) == [(1, None)]


def test_the_report_moves_narrow_rows_once_for_its_sums(spark):
    """One shuffle by the keys of the report, none by keys and point; labels are no part of it."""
    out = plans.point_report(small_tables(spark), "S", D(2023, 1, 1))
    moved = [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString()) if "tran_cate" in x]
    assert len(moved) == 1 and "point_id" not in moved[0] and "accum_acct_cate" not in moved[0]
    assert {r.pointid_cnt for r in out.collect()} == {1}


def test_labels_are_read_off_the_term(frame):
    days = [(D(2022, 1, 31), D(2022, 1, 1), D(2022, 3, 31)), (D(9999, 12, 31), None, D(1, 1, 1)), (None, D(2021, 12, 1), None)]
    df = frame(days, "d date, a date, e date")
    term = points.point_term(F.col("a").isNotNull(), F.col("d"), F.col("a"), F.col("e"), D(2022, 6, 1))
    rest = {"tran_ver": "v", "process_type": "USE", "accum_dept": "D", "tran_cate": "t", "accum_biz": "1P", "origin": "EXPIRE"}
    out = points.point_labels(df.select(term.alias("term"), *[F.lit(v).alias(k) for k, v in rest.items()]))
    assert rows(out, *points.SUMMARY_KEYS[:1], *points.SUMMARY_KEYS[2:7], "accum_acct_cate_biz", "accum_dept_biz") == sorted(
        [
            ("MSA", "202201", "202201", "202203", "true", "true", "EXPIRE-1P", "D-1P"),
            ("LEGACY", "999912", "unknown", "101", "unknown", "true", "EXPIRE-1P", "D-1P"),
            ("MSA", None, "202112", "unknown", "unknown", "unknown", "EXPIRE-1P", "D-1P"),
        ],
        key=lambda r: tuple(map(str, r)),
    )


def test_option_codes_of_repeated_unknown_and_missing_options(frame):
    biz = frame(
        [("7", 1, "1P", 2), ("7", 1, "1P", 1), ("7", 2, None, 1), ("8", 1, None, 1), ("9", 1, None, 1), ("9", 1, None, 1)],
        "option_key string, op_seller bigint, biz_code string, biz_copies bigint",
    )
    p = frame([(1, "7"), (2, "8"), (3, "9"), (4, "70"), (5, None), (None, None)], "id bigint, request_id string")
    got = {r.id: r.option_biz if r.option_biz is None else sorted(map(tuple, r.option_biz), key=str) for r in points.with_option_biz(p, biz).collect()}
    assert got == {1: [("1P", 3), (None, 1)], 2: [], 3: [(None, 2)], 4: [], 5: None, None: None}


def test_points_of_one_id_keep_their_own_traces(spark):
    """Two points share an id but not their user: the history of one is not that of the other."""
    tables = small_tables(spark)
    p = tables["dump_point.points"]
    other = p.filter("id = 3").withColumns({"user_id": F.lit(51).cast("bigint"), "payload": F.lit(903).cast("bigint")})
    tables["dump_point.points"] = p.unionByName(other.select(*p.columns))
    got = plans.points.point_origin_rows(tables, "S", D(2023, 1, 1)).filter("point_id = 3")
    assert rows(got, "user_id", "legacy_accum_id", "mileage") == [(50, 4, 1), (50, 5, 2), (51, None, None)]


def test_derived_keys_are_not_written(spark):
    df = spark.range(0, 100).selectExpr("id AS a", "id % 7 AS b")
    s = Segments.of(df, ["k"], derived={"k": F.col("b") * 2})
    assert spark.read.parquet(s.rows.inputFiles()[0]).columns == ["a", "b", "_piece"]
    out = s.total(["k"], {"n": F.lit(1)}).result()
    assert out.filter("k <> b * 2").count() == 0 and out.agg(F.sum("n")).collect()[0][0] == 2 * 15**2 + 5 * 14**2


def test_sums_by_detail_move_no_report_key(spark):
    """The rows are dealt without what only the report reads; the sums are those of the full rows."""
    tables = small_tables(spark)
    wanted = {"parts": F.sum("copies"), "amount": F.sum(F.col("fixed_amount").cast("decimal(28,2)"))}
    out = plans.points.point_origin_rows(tables, "S", D(2023, 1, 1), wanted)
    full = plans.points.point_origin_rows(tables, "S", D(2023, 1, 1)).groupBy("point_id", "detail_id")
    assert rows(out) == rows(full.agg(*[c.alias(k) for k, c in wanted.items()]))
    written = {c for f in out.inputFiles() if "pieces" in f for c in spark.read.parquet(f).columns}
    assert written == {*points.SHARE_COLUMNS, "_piece"} and not written & {"term", "tran_ver", "origin", "tran_cate", "user_id"}


def test_groups_of_one_piece_are_summed_in_place(spark):
    """A key over several pieces, null keys and keys inside a piece sum as by a plain grouping; only the first kind moves."""
    wide = spark.range(0, 400).selectExpr("if(id < 300, 1, id) AS a", "if(id % 3 = 0, NULL, id % 3) AS b", "id AS v")
    df = wide.unionByName(wide.selectExpr("CAST(NULL AS BIGINT) AS a", "b", "v").limit(5))
    s = Segments.of(df, ["a"], ["b"])
    sums = {"n": F.count(F.lit(1)), "v": F.sum("v")}
    out = s.grouped(["a", "b"], sums)
    assert len(re.findall(r"hashpartitioning\(a", out._jdf.queryExecution().executedPlan().toString())) == 1
    assert rows(out) == rows(df.groupBy("a", "b").agg(*[c.alias(k) for k, c in sums.items()]))
    assert {r.a for r in s.near.select("a").distinct().collect()} >= {1} and s.near.count() < df.count()


def test_traces_of_points_without_a_history_are_not_moved(spark):
    tables = small_tables(spark)
    p, h = tables["dump_point.points"], tables["finance.fin_mileage_histories_d"]
    every = points.legacy_origin(p, h, p, F.lit(True)).select("id", "mileage", "mig_id")
    found = points.legacy_origin(p, h, p, F.lit(True), found_only=True).select("id", "mileage", "mig_id")
    assert rows(found) == rows(every.filter("mileage IS NOT NULL")) == [(3, 1, 4), (3, 2, 5)]
