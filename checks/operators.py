"""Single domain operators over the driver's tables (or tables derived from them)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.commerce import BRANCH_SQL, COMMERCE_TABLES, FACTS_SQL
from checks.derive import AS_OF, CALENDAR, CALENDAR_FIRST, CALENDAR_LAST, SERVICE, Derived, base_table, oracle
from checks.jobs import (
    AGENCY,
    CART_COUPON,
    COUPON,
    DETAILS,
    HIERARCHY,
    LEDGER,
    LEGACY_TYPES,
    MILEAGE,
    MONTHS_LEFT,
    PERIOD,
    POINT_REPORT_TABLES,
    POINT_ROWS_SQL,
    POINTS,
    REMODEL,
    REMODEL_FLAT_SQL,
    ROUND_SQL,
    SALE_DETAILS,
    SALES,
    SELLERS,
    STAGE,
    STAGE_SETTLEMENT_SQL,
    TYPES,
    _cost_sql,
    _stage_sql,
)
from checks.registry import cents, half_up, register
from ledgerweave import plans
from ledgerweave.functions import (
    ex_vat,
    full_months_between,
    greatest_strict,
    month_key,
    month_text,
    round0,
)
from ledgerweave.operators import (
    ads,
    allocate,
    cohort,
    contacts,
    contracts,
    dedupe,
    intervals,
    ledger,
    lookup,
    marketing,
    orders,
    points,
    pnl,
    settlement,
    spread,
    totals,
    validate,
)
from ledgerweave.sources.calendar import calendar

MONEY = "decimal(18,2)"


# --- intervals --------------------------------------------------------------------------
def _user_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = base_table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    return intervals.build_intervals(
        ev, ["user_id"], "day", F.col("event_type") == "signup", F.col("event_type") == "error", dt.date(2999, 12, 31)
    )


USER_SPANS_SQL = """
WITH spans AS (
    SELECT user_id, a.d AS start_dt,
           coalesce((SELECT min(CAST(b.ts AS DATE)) FROM events b
                     WHERE b.user_id = a.user_id AND b.event_type = 'error' AND CAST(b.ts AS DATE) > a.d), DATE '2999-12-31') - 1 AS end_dt
    FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup') a
)
"""


@register(
    "build_intervals",
    USER_SPANS_SQL + "SELECT user_id, CAST(start_dt AS VARCHAR) AS start_dt, CAST(end_dt AS VARCHAR) AS end_dt FROM spans",
)
def build_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_intervals(spark, sf_dir)


@register(
    "overlapping_intervals",
    USER_SPANS_SQL
    + """,
    days AS (SELECT user_id, unnest(generate_series(start_dt, least(end_dt, DATE '2024-03-31'), INTERVAL 1 DAY)) AS d FROM spans),
    bad AS (SELECT user_id, d FROM days GROUP BY ALL HAVING count(*) > 1)
    SELECT user_id, CAST(CAST(min(d) AS DATE) AS VARCHAR) AS first_error, CAST(CAST(max(d) AS DATE) AS VARCHAR) AS last_error
    FROM bad GROUP BY user_id
    """,
)
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _user_intervals(spark, sf_dir)
    return intervals.overlap_periods(spans, "user_id", "start_dt", "end_dt", dt.date(2024, 1, 1), dt.date(2024, 3, 31))


@register(
    "attribute_interval",
    oracle(
        [LEDGER, AGENCY],
        """
        spans AS (
            SELECT DISTINCT a.seller_id, a.agency, CAST(a.dt AS DATE) AS s,
                   coalesce(min(CAST(b.dt AS DATE)) OVER (PARTITION BY a.seller_id, a.agency, a.dt), DATE '2999-12-31') - 1 AS e
            FROM (FROM finance_fin_seller_agency_code_mapping WHERE type = '1') a
            LEFT JOIN (FROM finance_fin_seller_agency_code_mapping WHERE type = '0') b
              ON b.seller_id = a.seller_id AND b.agency = a.agency AND b.dt > a.dt
        )
        SELECT coalesce(agency, 'self') AS agency, count(*) AS clicks, CAST(sum(cost_cpc) AS DOUBLE) AS cpc
        FROM advertise_ad_ledger l LEFT JOIN spans
          ON spans.seller_id = l.salesuserid AND make_date(CAST(year AS INT), CAST(month AS INT), CAST(day AS INT)) BETWEEN s AND e
        WHERE ledgertype = 'CLICK' GROUP BY ALL
        """,
    ),
)
def attribute_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    clicks = ads.normalise_ad_ledger(t[LEDGER])
    daily = clicks.groupBy("salesuserid", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_cpc").alias("cpc"))
    spans = plans.ads.agency_intervals(t[AGENCY], dt.date(2999, 12, 31))
    placed = intervals.attribute_interval(daily, spans, "salesuserid", "date", "seller_id", "agency", "self")
    return placed.groupBy("agency").agg(F.sum("n").alias("clicks"), F.sum("cpc").cast("double").alias("cpc"))


# --- order options ----------------------------------------------------------------------
@register(
    "latest_per_key",
    """
    SELECT user_id, event_type, event_id, CAST(ts AS VARCHAR) AS ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = base_table(spark, sf_dir, "events").drop("props")
    newest = [F.col("ts").desc_nulls_last(), F.col("event_id").desc_nulls_last()]
    return dedupe.latest_per_key(ev, ["user_id", "event_type"], newest)


@register(
    "fold_copies",
    """
    SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL
    """,
)
def fold_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fold_copies(base_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


STATUS_TEXT = {"F": "finished", "O": "open"}


@register(
    "status_label",
    """
    SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'NULL' END AS label, count(*) AS n
    FROM orders GROUP BY ALL
    """,
)
def status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = lookup.lookup_label(base_table(spark, sf_dir, "orders"), "o_orderstatus", STATUS_TEXT, "label", "NULL")
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "paid_orders",
    """
    SELECT o_orderkey FROM orders
    WHERE o_orderstatus <> 'P' AND (o_orderpriority <> '1-URGENT' OR o_totalprice > 250000)
    """,
)
def paid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = base_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") != "P").alias("ok"),
        F.col("o_orderpriority").alias("method"),
        (F.col("o_totalprice") > 250000).alias("account_paid"),
    )
    return orders.paid_orders(shaped, "ok", "method", "account_paid", "1-URGENT").select("o_orderkey")


@register(
    "age_days",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN date_sub('day', o_orderdate + INTERVAL 13 HOUR, TIMESTAMP '2002-01-01') END AS age
    FROM orders
    """,
)
def age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base_table(spark, sf_dir, "orders").withColumn("at", F.expr("o_orderdate + interval '13' hour"))
    aged = orders.age_days(o, "at", dt.date(2002, 1, 1), "age", F.col("o_orderstatus") == "O")
    return aged.select("o_orderkey", "age")


@register(
    "classify_issue",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n,
           CASE WHEN l_returnflag = 'R' THEN 'returned'
                WHEN l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1998-01-01' THEN 'late'
                WHEN l_linestatus = 'O' THEN 'waiting' ELSE 'to be defined' END AS issue
    FROM lineitem GROUP BY ALL
    """,
)
def classify_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem")
    opened = F.col("l_linestatus") == "O"
    rules = [
        (F.col("l_returnflag") == "R", "returned"),
        (opened & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")), "late"),
        (opened, "waiting"),
    ]
    issues = orders.classify_issue(li, rules, "to be defined", "issue")
    return issues.groupBy("l_returnflag", "l_linestatus", "issue").agg(F.count(F.lit(1)).alias("n"))


@register(
    "infer_status",
    oracle(
        [HIERARCHY[0], HIERARCHY[1], HIERARCHY[2]],
        """
        SELECT x.id AS option_id,
               CASE WHEN x.status = 9 THEN 9
                    ELSE greatest(CASE WHEN x.purchase_confirm_date IS NOT NULL THEN 5 ELSE 0 END, CASE WHEN x.delivery_complete_date IS NOT NULL THEN 4 ELSE 0 END,
                         CASE WHEN x.delivery_start_date IS NOT NULL THEN 3 ELSE 0 END, CASE WHEN x.confirm_order_date IS NOT NULL THEN 2 ELSE 0 END,
                         CASE WHEN q.payment_at IS NOT NULL THEN 1 ELSE 0 END) END AS inferred
        FROM dump_order_options x JOIN dump_order_productions p ON p.id = x.order_production_id JOIN dump_orders q ON q.id = p.order_id
        """,
    ),
)
def infer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    o = t["dump.orders"].select(F.col("id").alias("_o"), "payment_at")
    p = t["dump.order_productions"].select(F.col("id").alias("_p"), "order_id")
    x = t["dump.order_options"].withColumn("cancelled", F.when(F.col("status") == 9, 2))
    joined = x.join(p, F.col("order_production_id") == F.col("_p")).join(o, F.col("order_id") == F.col("_o"))
    inferred = orders.infer_status(joined, "inferred", "cancelled")
    return inferred.select(F.col("id").alias("option_id"), F.coalesce("inferred", F.lit(0)).alias("inferred"))


# --- ledger -----------------------------------------------------------------------------
@register(
    "control_total",
    """
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amt
    FROM lineitem GROUP BY ALL
    """,
)
def control_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice").cast(MONEY))
    return ledger.control_total(li, ["l_returnflag", "l_linestatus"], "price")


@register(
    "reconcile",
    """
    WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1),
    b AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT k AS order_id, CAST(a.s AS DOUBLE) AS data_sum, CAST(coalesce(b.s, 0) AS DOUBLE) AS user_bal,
           CAST(a.s - coalesce(b.s, 0) AS DOUBLE) AS diff, a.n AS tran_count
    FROM a LEFT JOIN b USING (k) WHERE a.s <> coalesce(b.s, 0)
    """,
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        "l_returnflag",
        "l_linenumber",
    )
    return ledger.reconcile(li, li.filter(F.col("l_returnflag") != "R"), "order_id", "price", "price", "l_linenumber")


@register(
    "missing_flag",
    """
    SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS no_lines FROM orders
    """,
)
def missing_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base_table(spark, sf_dir, "orders").select("o_orderkey")
    return lookup.missing_flag(o, base_table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "no_lines")


@register(
    "duplicate_keys",
    """
    SELECT 'lineitem' AS table_name, l_orderkey || ' / ' || l_linenumber AS join_key, count(l_partkey) AS row_count
    FROM lineitem GROUP BY ALL HAVING row_count > 1
    """,
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit(" / "), F.col("l_linenumber").cast("string"))
    return validate.duplicate_keys(base_table(spark, sf_dir, "lineitem"), "lineitem", key, "l_partkey")


@register(
    "unmapped_codes",
    """
    SELECT 'part' AS table_name, p_brand AS join_key, count(*) AS row_count FROM part
    WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48) GROUP BY ALL
    """,
)
def unmapped_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = base_table(spark, sf_dir, "part")
    return validate.unmapped_codes(part, part.filter(F.col("p_size") > 48), "part", "p_brand", "p_brand")


# --- allocation -------------------------------------------------------------------------
@register(
    "allocate_residual",
    """
    WITH lines AS (
        SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, l_linenumber, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
    ),
    parts AS (
        SELECT *, round(CAST(total AS DOUBLE) * CAST(price AS DOUBLE) / CAST(sum(price) OVER (PARTITION BY o_orderkey) AS DOUBLE)) AS share
        FROM lines
    )
    SELECT o_orderkey, l_linenumber, share AS allocated,
           CASE WHEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) = 1
                THEN CAST(total AS DOUBLE) - sum(share) OVER (PARTITION BY o_orderkey) + share ELSE share END AS fixed
    FROM parts
    """,
)
def allocate_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals over lines by price; the first line takes what rounding leaves."""
    o = base_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("total"))
    lines = (
        base_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("price"))
    )
    joined = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    key = ["o_orderkey"]
    fixed = allocate.share_out(joined, key, "total", "price", ["l_linenumber"])
    return fixed.select("o_orderkey", "l_linenumber", "allocated", "fixed")


# --- points -----------------------------------------------------------------------------
def _options_biz(t: Derived) -> DataFrame:
    return points.option_biz(t["dump.order_options"], t["dump.order_productions"], t[SELLERS])


@register(
    "first_accumulation",
    oracle(
        POINT_REPORT_TABLES,
        POINT_ROWS_SQL
        + """
SELECT first_id AS detail_first_accum_id, first_process AS process_type, first_acct AS acct_cate, first_biz AS accum_acct_biz,
       first_cate AS category_type, first_version AS version, CAST(first_at AS VARCHAR) AS created_at FROM origin
""",
    ),
)
def first_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    return points.first_accumulation(t[POINTS], t[DETAILS], _options_biz(t), t[TYPES])


@register(
    "legacy_origin",
    oracle(
        [POINTS, "finance.fin_mileage_histories_d"],
        """
        SELECT g.id AS point_id, z.id AS mig_id, z.category_type AS mig_category_type, sum(h.mileage) AS mileage, count(*) AS n
        FROM dump_point_points g
        LEFT JOIN finance_fin_mileage_histories_d h
          ON g.version = 'm' AND h.user_id = CAST(g.user_id AS VARCHAR) AND h.mileage_id = g.payload
        LEFT JOIN dump_point_points z ON CAST(z.payload AS VARCHAR) = h.reference_mileage_id AND CAST(z.user_id AS VARCHAR) = h.user_id
        GROUP BY ALL
        """,
    ),
)
def legacy_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old-version points traced through the mileage history to the user's earlier point."""
    t = Derived(spark, sf_dir)
    p = t[POINTS]
    traced = points.legacy_origin(p, t["finance.fin_mileage_histories_d"], p, F.col("version") == "m")
    return traced.groupBy(F.col("id").alias("point_id"), "mig_id", "mig_category_type").agg(
        F.sum(F.col("mileage") * F.col("history_copies")).alias("mileage"), F.sum("history_copies").alias("n")
    )


@register(
    "origin_category",
    oracle(
        [POINTS],
        """
        SELECT grouped AS origin, CASE WHEN biz IS NULL THEN grouped ELSE grouped || '-' || biz END AS origin_biz, count(*) AS n
        FROM (
            SELECT CASE WHEN category_type IN ('CONFIRM_ORDER', 'EXPIRE') THEN category_type WHEN category_type = 'ORDER_CANCEL' THEN 'ORDER_CANCEL/REFUND'
                        WHEN category_type = 'UNLISTED' THEN 'UNKNOWN' ELSE 'EVENT' END AS grouped,
                   CASE WHEN category_type = 'CONFIRM_ORDER' THEN CASE WHEN version = 'm' THEN '1P' ELSE '3P' END END AS biz
            FROM dump_point_points
        ) GROUP BY ALL
        """,
    ),
)
def origin_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Derived(spark, sf_dir)[POINTS]
    category = F.when(F.col("category_type") != "UNLISTED", F.col("category_type"))
    biz = points.origin_biz(category, F.when(F.col("version") == "m", "PREMIUM"))
    origin = points.origin_category(category)
    return p.groupBy(origin.alias("origin"), points.with_suffix(origin, biz).alias("origin_biz")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "expiry_flags",
    f"""
    WITH pairs AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS a,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS b
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    )
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {MONTHS_LEFT.format(a='a', b='b')} AS months,
           coalesce(CAST({MONTHS_LEFT.format(a='a', b='b')} > 1 AS VARCHAR), 'unknown') AS over_1mnth,
           coalesce(CAST(b < DATE '1998-06-29' AS VARCHAR), 'unknown') AS exp_date_pass
    FROM pairs
    """,
)
def expiry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem")
    o = base_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "b", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate").cast("date"))
    )
    flagged = points.expiry_flags(pairs, "a", "b", dt.date(1998, 6, 30))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return flagged.select(*keys, full_months_between("a", "b").alias("months"), "over_1mnth", "exp_date_pass")


@register(
    "point_rows_allocated",
    oracle(
        POINT_REPORT_TABLES,
        POINT_ROWS_SQL
        + """
SELECT id AS point_id, detail_id, count(*) AS parts, CAST(sum(CAST(final_amount AS DECIMAL(28,2))) AS DOUBLE) AS amount
FROM settled GROUP BY ALL
""",
    ),
)
def point_rows_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared amounts per point detail, before the summary."""
    sums = {"parts": F.sum("copies"), "amount": F.sum(F.col("fixed_amount").cast("decimal(28,2)"))}
    return plans.points.point_origin_rows(Derived(spark, sf_dir), SERVICE, AS_OF, sums)


@register(
    "point_biz",
    oracle(
        [POINTS, *HIERARCHY[1:], SELLERS, "dump.order_options_l", "dump.order_productions_l"],
        """
        SELECT g.id AS point_id,
               coalesce(s.biz, CASE WHEN coalesce(p.seller_id, pl.seller_id) IS NULL THEN NULL ELSE '3P' END) || '-' AS biz
        FROM dump_point_points g
        LEFT JOIN dump_order_options x ON CAST(x.id AS VARCHAR) = g.request_id
        LEFT JOIN dump_order_productions p ON p.id = x.order_production_id
        LEFT JOIN (FROM dump_order_options_l WHERE base_dt = '2022-12-01') xl ON CAST(xl.id AS VARCHAR) = g.request_id
        LEFT JOIN (FROM dump_order_productions_l WHERE base_dt = '2022-12-01') pl ON pl.id = xl.order_production_id
        LEFT JOIN temp_fin_non_3p_seller_current s ON CAST(s.seller_id AS BIGINT) = coalesce(p.seller_id, pl.seller_id)
        WHERE g.category_type = 'CONFIRM_ORDER' AND g.point_type = 'POINT'
        """,
    ),
)
def point_biz(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    return points.point_biz(
        t[POINTS],
        t["dump.order_options"],
        t["dump.order_productions"],
        t["dump.order_options_l"],
        t["dump.order_productions_l"],
        t[SELLERS],
        "2022-12-01",
    )


@register(
    "short_points",
    oracle(
        [POINTS],
        f"""
        SELECT id AS point_id FROM dump_point_points
        WHERE process_type IN ('ACCUM', 'WITHDRAW') AND {MONTHS_LEFT.format(a='CAST(created_at AS DATE)', b='use_end_date')} <= 0
        """,
    ),
)
def short_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.short_points(Derived(spark, sf_dir)[POINTS])


@register(
    "point_measures",
    oracle(
        [POINTS, CALENDAR],
        f"""
        sums AS (
            SELECT strftime(created_at, '%Y%m') AS tran_mm, c.first_of_week, category_type || CASE WHEN use_end_date IS NULL THEN '-open' ELSE '' END AS department,
                   sum(amount) AS t, coalesce(sum(amount) FILTER (process_type = 'ACCUM'), 0) AS a,
                   coalesce(sum(amount) FILTER (process_type = 'WITHDRAW'), 0) AS w,
                   coalesce(sum(amount) FILTER (version = 'm'), 0) AS tx, coalesce(sum(amount) FILTER (process_type = 'ACCUM' AND version = 'm'), 0) AS ax,
                   coalesce(sum(amount) FILTER (process_type = 'WITHDRAW' AND version = 'm'), 0) AS wx
            FROM dump_point_points JOIN ba_preserved_calendar c ON c.date = CAST(created_at AS DATE) GROUP BY ALL
        )
        SELECT tran_mm, CAST(first_of_week AS VARCHAR) AS first_of_week, department, CAST(t AS DOUBLE) AS point, CAST(a AS DOUBLE) AS accum_point,
               CAST(w AS DOUBLE) AS withdraw_point,
               CAST({half_up(f"({cents('t')} - {cents('tx')}) * 10 + {cents('tx')} * 11", '1100')} AS DOUBLE) AS ex_vat_point,
               CAST({half_up(f"({cents('a')} - {cents('ax')}) * 10 + {cents('ax')} * 11", '1100')} AS DOUBLE) AS accum_ex_vat_point,
               CAST({half_up(f"({cents('w')} - {cents('wx')}) * 10 + {cents('wx')} * 11", '1100')} AS DOUBLE) AS withdraw_ex_vat_point
        FROM sums
        """,
    ),
)
def point_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with part of the rows free of VAT."""
    t = Derived(spark, sf_dir)
    rows = t[POINTS].select(
        F.col("created_at").cast("date").alias("tran_dt"),
        F.concat("category_type", F.when(F.col("use_end_date").isNull(), "-open").otherwise("")).alias("department"),
        "process_type",
        "amount",
        (F.col("version") == "m").alias("exempt"),
    )
    return points.point_measures(rows, t[CALENDAR])


@register(
    "point_summary",
    """
    SELECT l_returnflag AS accum_ver, l_linestatus AS tran_ver, strftime(l_shipdate, '%Y%m') AS tran_mm, 'x' AS accum_mm, 'x' AS exp_mm,
           'x' AS over_1mnth, 'x' AS exp_date_pass, 'x' AS process_type, 'x' AS accum_acct_cate, 'x' AS accum_acct_cate_biz,
           'x' AS accum_dept, 'x' AS accum_dept_biz, 'x' AS accum_cate, 'x' AS tran_cate,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(DISTINCT l_orderkey) AS pointid_cnt,
           max(l_suppkey) AS sample_user, max(l_orderkey) AS sample_pointid, max(l_linenumber) AS sample_detail_id,
           max(CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END) AS sample_first
    FROM lineitem GROUP BY ALL
    """,
)
def point_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem")
    filler = [F.lit("x").alias(k) for k in points.SUMMARY_KEYS[3:]]
    rows = li.select(
        F.col("l_returnflag").alias("accum_ver"),
        F.col("l_linestatus").alias("tran_ver"),
        month_key("l_shipdate").alias("tran_mm"),
        *filler,
        F.col("l_orderkey").alias("point_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_linenumber").alias("detail_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("detail_first_accum_id"),
        F.col("l_suppkey").alias("legacy_accum_id"),
        F.col("l_extendedprice").cast(MONEY).alias("fixed_amount"),
    )
    return points.point_summary(rows)


# --- settlement -------------------------------------------------------------------------
_BRANCH_COLUMNS = """
CAST(day AS VARCHAR) AS base_dt, kind, seller_id, order_id, order_option_id, product_id, product_option_id, product_name, option_name,
CAST(d1 AS VARCHAR) AS payment_date, CAST(d2 AS VARCHAR) AS delivery_complete_date, CAST(d3 AS VARCHAR) AS purchase_confirm_date
"""


def _branch(t: Derived, milestone: settlement.Milestone, costs: str, col: str, out: str) -> DataFrame:
    options = settlement.seller_options(*[t[n] for n in reversed(HIERARCHY)], milestone, None)
    return settlement.settlement_branch(t[costs], options, milestone, col, out, *PERIOD)


@register(
    "settlement_branch_coupon",
    oracle(
        [*HIERARCHY, COUPON, MILEAGE],
        _cost_sql(settlement.PAYMENT, COUPON, "payment_at")
        + f"SELECT {_BRANCH_COLUMNS}, CAST(-cost AS DOUBLE) AS coupon_total, CAST(qty AS BIGINT) AS quantity FROM booked WHERE src = 'c'",
    ),
)
def settlement_branch_coupon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branch(Derived(spark, sf_dir), settlement.PAYMENT, COUPON, "coupon_cost", "coupon_total")


@register(
    "settlement_branch_mileage",
    oracle(
        [*HIERARCHY, CART_COUPON, MILEAGE],
        _cost_sql(settlement.CONFIRM, CART_COUPON, "purchase_confirm_date")
        + f"SELECT {_BRANCH_COLUMNS}, CAST(-cost AS DOUBLE) AS point_total, CAST(qty AS BIGINT) AS quantity FROM booked WHERE src = 'm'",
    ),
)
def settlement_branch_mileage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branch(Derived(spark, sf_dir), settlement.CONFIRM, MILEAGE, "mileage_cost", "point_total")


@register(
    "stage_payment_branch",
    oracle(
        STAGE,
        _stage_sql(False)
        + """
SELECT CAST(day AS VARCHAR) AS base_dt, kind, seller_id, order_id, order_option_id, product_id, product_option_id, product_name, option_name,
       CAST(day AS VARCHAR) AS payment_date, CAST(d2 AS VARCHAR) AS delivery_complete_date, CAST(d3 AS VARCHAR) AS purchase_confirm_date,
       CAST(-coupon AS DOUBLE) AS coupon_total FROM staged
""",
    ),
)
def stage_payment_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    return settlement.stage_payment_branch(*[t[n] for n in STAGE], SERVICE, None, *PERIOD)


@register(
    "stage_settlement_branch",
    oracle(
        [SALES, SALE_DETAILS],
        STAGE_SETTLEMENT_SQL
        + """
SELECT CAST(day AS VARCHAR) AS base_dt, kind, order_id, order_option_id, product_name, option_name, product_id, product_option_id,
       qty AS quantity, CAST(coupon AS DOUBLE) AS coupon_total FROM staged
""",
    ),
)
def stage_settlement_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    return settlement.stage_settlement_branch(t[SALES], t[SALE_DETAILS], None, *PERIOD)


@register(
    "latest_snapshot",
    """
    SELECT CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS ship_day, p_brand, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity
    FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem) GROUP BY ALL
    """,
)
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the newest ship date only, joined to their parts."""
    li = settlement.latest_snapshot(base_table(spark, sf_dir, "lineitem"), "l_shipdate")
    part = base_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_shipdate").cast("date").alias("ship_day"), "p_brand")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    )


@register(
    "settlement_round",
    f"""
    SELECT {ROUND_SQL.format('l_shipdate')}, count(*) AS n FROM lineitem GROUP BY ALL
    """,
)
def settlement_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = settlement.settlement_round(base_table(spark, sf_dir, "lineitem"), F.col("l_shipdate").cast("date"))
    return rounds.groupBy("settle_year", "settle_month", "settle_round").agg(F.count(F.lit(1)).alias("n"))


@register(
    "recognised_date",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(CASE WHEN l_returnflag = 'N' THEN NULL WHEN o_orderdate > l_shipdate THEN CAST(o_orderdate AS DATE) ELSE CAST(l_shipdate AS DATE) END AS VARCHAR) AS day
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    """,
)
def recognised_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of order and ship date, null when the ship date is missing."""
    o = base_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = base_table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))
    day = greatest_strict(F.col("o_orderdate"), shipped).cast("date")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.alias("day"))


# --- commerce P&L pieces ----------------------------------------------------------------
_BRANCH_MEASURES = {
    1: ["gmv", "revenue", "dab", "qty"],
    2: ["gmv", "revenue", "dab", "qty"],
    3: ["gmv", "revenue", "dab", "qty", "direct_delivery_cost"],
    4: ["coupon_cost", "coupon_cost_ecom", "coupon_cost_con", "coupon_cost_mkt"],
    5: ["deduct", "deduct_ecom", "deduct_con", "deduct_mkt", "deposit", "deposit_ecom", "deposit_con", "deposit_mkt"],
    6: ["card_discount", "platform_card_discount", "partner_card_discount"],
    7: ["instant_discount_funding"],
}
RAW_MEASURES = list(dict.fromkeys(m for ms in _BRANCH_MEASURES.values() for m in ms))


@register(
    "commerce_branches",
    oracle(
        COMMERCE_TABLES,
        FACTS_SQL
        + BRANCH_SQL
        + " SELECT CAST(day AS VARCHAR) AS base_date, biz, name_depth1, product_id, "
        + ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in [*RAW_MEASURES, "cogs_price", "cogs_margin"])
        + " FROM branches GROUP BY ALL",
    ),
)
def commerce_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zero-filled union of the seven branches, summed per day, business, category and product."""
    raw = plans.commerce_raw(Derived(spark, sf_dir), AS_OF)
    sums = {m: F.sum(m) for m in RAW_MEASURES} | {
        "cogs_price": F.sum("cogs_at_price"),
        "cogs_margin": F.sum("cogs_at_margin"),
    }
    return raw.groupBy("base_date", "biz", "name_depth1", "product_id").agg(*[c.alias(n) for n, c in sums.items()])


@register(
    "union_measures",
    """
    SELECT k, CAST(sum(price) AS DOUBLE) AS price, CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(returned) AS DOUBLE) AS returned FROM (
        SELECT l_suppkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, 0 AS qty, 0 AS returned FROM lineitem WHERE l_returnflag = 'A'
        UNION ALL SELECT l_suppkey, 0, CAST(l_quantity AS BIGINT), 0 FROM lineitem WHERE l_returnflag = 'N'
        UNION ALL SELECT l_suppkey, 0, 0, CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem WHERE l_returnflag = 'R'
    ) GROUP BY ALL
    """,
)
def union_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), "l_returnflag", F.col("l_extendedprice").cast(MONEY).alias("p"), "l_quantity"
    )

    def branch(flag: str, name: str, value: str) -> DataFrame:
        return li.filter(F.col("l_returnflag") == flag).groupBy("k").agg(F.sum(F.col(value).cast(MONEY)).alias(name))

    parts = [branch("A", "price", "p"), branch("N", "qty", "l_quantity"), branch("R", "returned", "p")]
    names = ["price", "qty", "returned"]
    stacked = pnl.union_measures(parts, ["k"], names)
    return stacked.groupBy("k").agg(*[F.sum(n).alias(n) for n in names])


@register(
    "split_by_department",
    """
    SELECT l_suppkey, CAST(sum(CASE l_linenumber WHEN 0 THEN v ELSE 0 END) AS DOUBLE) AS cost_ecom,
           CAST(sum(CASE l_linenumber WHEN 1 THEN v ELSE 0 END) AS DOUBLE) AS cost_con, CAST(sum(CASE l_linenumber WHEN 3 THEN v ELSE 0 END) AS DOUBLE) AS cost_mkt,
           CAST(sum(CASE WHEN l_linenumber IN (0, 1, 3) THEN 0 ELSE v END) AS DOUBLE) AS cost_other, CAST(sum(v) AS DOUBLE) AS cost
    FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem) GROUP BY ALL
    """,
)
def split_by_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem")
    parts = pnl.split_by_department(F.col("l_linenumber"), F.col("l_extendedprice").cast(MONEY), "cost")
    return li.groupBy("l_suppkey").agg(*[F.sum(c).alias(n) for n, c in parts.items()])


@register(
    "ex_vat_residual",
    f"""
    WITH s AS (
        SELECT l_suppkey, l_returnflag, l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total,
               sum(CASE WHEN l_linenumber = 1 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS one,
               sum(CASE WHEN l_linenumber = 2 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS two
        FROM lineitem GROUP BY ALL
    ),
    n AS (
        SELECT *, CASE WHEN l_returnflag = 'R' THEN round(total) ELSE {half_up(cents('total'), '110')} END AS t,
               CASE WHEN l_returnflag = 'R' THEN round(one) ELSE {half_up(cents('one'), '110')} END AS a,
               CASE WHEN l_returnflag = 'R' THEN round(two) ELSE {half_up(cents('two'), '110')} END AS b
        FROM s
    )
    SELECT l_suppkey, CAST(sum(t) AS DOUBLE) AS total, CAST(sum(a) AS DOUBLE) AS one, CAST(sum(b) AS DOUBLE) AS two,
           CAST(sum(t) - sum(a) - sum(b) AS DOUBLE) AS other FROM n GROUP BY ALL
    """,
)
def ex_vat_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch sums lose VAT and are rounded; the other bucket is what the named ones leave."""
    price = F.col("l_extendedprice").cast(MONEY)
    line = F.col("l_linenumber")
    sums = (
        base_table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_returnflag", "l_linestatus")
        .agg(
            F.sum(price).alias("total"),
            F.sum(F.when(line == 1, price).otherwise(0)).alias("one"),
            F.sum(F.when(line == 2, price).otherwise(0)).alias("two"),
        )
    )
    net = {c: F.sum(round0(ex_vat(c, F.col("l_returnflag") == "R"))) for c in ("total", "one", "two")}
    net["other"] = pnl.residual(net["total"], [net["one"], net["two"]])
    return sums.groupBy("l_suppkey").agg(*[c.alias(n) for n, c in net.items()])


@register(
    "floor_date_lookup",
    """
    WITH prices AS (
        SELECT p_partkey, '19960101' AS day, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part WHERE p_size < 40
        UNION ALL
        SELECT l_partkey, strftime(l_shipdate, '%Y%m%d'), min(CAST(l_extendedprice AS DECIMAL(18,2))) FROM lineitem
        WHERE l_returnflag = 'A' AND strftime(l_shipdate, '%Y%m%d') <> '19960101' GROUP BY ALL
    )
    SELECT l_partkey, count(*) AS n, count(price) AS priced, CAST(sum(price) AS DOUBLE) AS price
    FROM lineitem LEFT JOIN prices ON p_partkey = l_partkey
     AND (day = strftime(l_shipdate, '%Y%m%d') OR (strftime(l_shipdate, '%Y%m%d') < '19960101' AND day = '19960101'))
    GROUP BY ALL
    """,
)
def floor_date_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem").withColumn("ship_day", F.date_format("l_shipdate", "yyyyMMdd"))
    floor = "19960101"
    listed = base_table(spark, sf_dir, "part").filter(F.col("p_size") < 40).select(
        F.col("p_partkey").alias("price_part"),
        F.lit(floor).alias("price_day"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
    )
    daily = (
        li.filter((F.col("l_returnflag") == "A") & (F.col("ship_day") != floor))
        .groupBy(F.col("l_partkey").alias("price_part"), F.col("ship_day").alias("price_day"))
        .agg(F.min(F.col("l_extendedprice").cast(MONEY)).alias("price"))
    )
    prices = listed.unionByName(daily)
    found = lookup.floor_date_lookup(
        li.select("l_partkey", "ship_day"), prices, "l_partkey", "ship_day", "price_part", "price_day", floor
    )
    return found.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.sum("price").alias("price")
    )


@register(
    "monthly_lookup",
    """
    WITH fees AS (SELECT l_partkey AS k, strftime(l_shipdate, '%Y%m') AS m, max(l_tax) AS fee FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l_suppkey, count(*) AS n, count(fee) AS with_fee, max(fee) AS fee
    FROM lineitem LEFT JOIN fees ON k = l_partkey AND m = strftime(l_shipdate, '%Y%m') GROUP BY ALL
    """,
)
def monthly_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_returnflag", "l_tax", month_key("l_shipdate").alias("ship_month")
    )
    fees = (
        li.filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_partkey").alias("k"), F.col("ship_month").alias("m"))
        .agg(F.max("l_tax").alias("fee"))
    )
    found = lookup.monthly_lookup(li, fees, F.col("l_partkey"), F.col("ship_month"), F.col("k"), F.col("m"))
    return found.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("fee").alias("with_fee"), F.max("fee").alias("fee")
    )


# --- spreads and marketing ----------------------------------------------------------------
SHIP_CALENDAR = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))
SHIP_AS_OF = dt.date(2001, 3, 10)
SHIP_CALENDAR_SQL = f"""
WITH cal AS (
    SELECT CAST(d AS DATE) AS date, CAST(date_trunc('week', d) AS DATE) AS w, strftime(d, '%Y%m') AS m
    FROM generate_series(DATE '{SHIP_CALENDAR[0]}', DATE '{SHIP_CALENDAR[1]}', INTERVAL 1 DAY) t(d)
)
"""


@register(
    "spread_monthly",
    SHIP_CALENDAR_SQL
    + f""",
    s AS (SELECT strftime(l_shipdate, '%Y%m') AS yyyymm, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY ALL),
    n AS (SELECT m, count(*) AS days FROM cal GROUP BY m)
    SELECT s.yyyymm, CAST(cal.w AS VARCHAR) AS first_of_week, s.l_suppkey, CAST(n.days AS INTEGER) AS date_diff,
           CAST(sum(s.v) AS DOUBLE) / n.days AS daily
    FROM s JOIN cal ON cal.m = s.yyyymm JOIN n ON n.m = s.yyyymm WHERE cal.date < DATE '{SHIP_AS_OF}' GROUP BY s.yyyymm, cal.w, s.l_suppkey, n.days
    """,
)
def spread_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem").select(
        month_key("l_shipdate").alias("yyyymm"), "l_suppkey", F.col("l_extendedprice").cast(MONEY).alias("v")
    )
    return spread.spread_monthly(li, calendar(spark, *SHIP_CALENDAR), SHIP_AS_OF, "yyyymm", ["l_suppkey"], "v", "daily")


@register(
    "spread_elapsed",
    SHIP_CALENDAR_SQL
    + f""",
    s AS (SELECT strftime(o_orderdate, '%Y%m') AS ym, o_orderstatus, CAST(floor(max(o_totalprice)) AS INTEGER) AS v FROM orders GROUP BY ALL),
    joined AS (SELECT cal.date, cal.w, cal.m, s.v, count(*) OVER (PARTITION BY cal.m) AS days FROM s JOIN cal ON cal.m = s.ym WHERE cal.date < DATE '{SHIP_AS_OF}')
    SELECT left(m, 4) || '-' || right(m, 2) || '-01' AS base_m, CAST(w AS VARCHAR) AS first_of_week, CAST(date AS VARCHAR) AS date, days, v // days AS daily FROM joined
    """,
)
def spread_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = (
        base_table(spark, sf_dir, "orders")
        .groupBy(month_key("o_orderdate").alias("ym"), "o_orderstatus")
        .agg(F.floor(F.max("o_totalprice")).cast("string").alias("v"))
    )
    return spread.spread_elapsed(o, calendar(spark, *SHIP_CALENDAR), SHIP_AS_OF, "ym", "v", "daily")


@register(
    "provisional_fixed",
    """
    WITH fixed AS (SELECT strftime(o_orderdate, '%Y-%m-01') AS m, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders
                   WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-01'),
    daily AS (SELECT strftime(o_orderdate, '%Y-%m-01') AS m, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
    SELECT m AS base_m, 'fixed' AS source, CAST(sum(v) AS DOUBLE) AS v, count(*) AS n FROM fixed GROUP BY ALL
    UNION ALL SELECT m, 'daily', CAST(sum(v) AS DOUBLE), count(*) FROM daily WHERE m > (SELECT max(m) FROM fixed) GROUP BY ALL
    """,
)
def provisional_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base_table(spark, sf_dir, "orders").select(
        month_text("o_orderdate").alias("base_m"), F.col("o_totalprice").cast(MONEY).alias("v"), "o_orderstatus", "o_orderdate"
    )
    before = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    later, fixed = marketing.provisional_fixed(o, o.filter((F.col("o_orderstatus") == "F") & before))

    def summed(df: DataFrame, name: str) -> DataFrame:
        keys = ["base_m", F.lit(name).alias("source")]
        return df.groupBy(*keys).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))

    return summed(fixed, "fixed").unionByName(summed(later, "daily"))


@register(
    "calendar_weeks",
    SHIP_CALENDAR_SQL
    + """
    SELECT CAST(w AS VARCHAR) AS first_of_week, m AS year_month, count(DISTINCT date) AS days, count(*) AS lines
    FROM lineitem JOIN cal ON cal.date = CAST(l_shipdate AS DATE) GROUP BY ALL
    """,
)
def calendar_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by calendar week and month."""
    daily = (
        base_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    weeks = calendar(spark, *SHIP_CALENDAR)
    return (
        daily.join(weeks, F.col("day") == F.col("date"))
        .groupBy("first_of_week", "year_month")
        .agg(F.count("date").alias("days"), F.sum("n").alias("lines"))
    )


# --- services, cohorts, contacts ------------------------------------------------------------
@register(
    "net_sales",
    SHIP_CALENDAR_SQL
    + """
    SELECT strftime(l_shipdate, '%Y%m') AS yyyymm, CAST(w AS VARCHAR) AS first_of_week, count(*) FILTER (l_returnflag = 'A') AS rev_count,
           -count(*) FILTER (l_returnflag = 'R') AS cancel_count,
           CAST(sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(1.1 AS DOUBLE) AS paid_rev,
           CAST(sum(CASE WHEN l_linestatus = 'O' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE -1 END * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / CAST(1.1 AS DOUBLE) AS free_rev
    FROM lineitem JOIN cal ON cal.date = CAST(l_shipdate AS DATE) WHERE l_returnflag <> 'N' GROUP BY ALL
    """,
)
def net_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    sales = base_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").alias("basis_date_time"),
        F.when(flag == "A", 2).when(flag == "R", 3).otherwise(1).alias("sales_status"),
        F.col("l_extendedprice").cast(MONEY).alias("paid_cash_amount"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast(MONEY)).alias("free_cash_amount"),
        F.lit(0).alias("is_deleted"),
    )
    return contracts.net_sales(sales, calendar(spark, *SHIP_CALENDAR))


@register(
    "flatten_contracts",
    oracle(
        [REMODEL, "dump.expertises"],
        REMODEL_FLAT_SQL
        + """
SELECT oid AS consultation_id, CAST(signed AS VARCHAR) AS dt_contract, CAST(changed AS VARCHAR) AS modified_date,
       CAST(first_pay AS DOUBLE) AS downpayment, CAST(extra_pay AS DOUBLE) AS modifieddownpayment, type, scale FROM contracts
""",
    ),
)
def flatten_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    flat = contracts.flatten_contracts(t[REMODEL], t["dump.expertises"], LEGACY_TYPES)
    keep = ["consultation_id", "dt_contract", "modified_date", "downpayment", "modifieddownpayment", "type", "scale"]
    return flat.select(*keep)


@register(
    "recognise_contracts",
    oracle(
        [REMODEL, "dump.expertises"],
        REMODEL_FLAT_SQL
        + """
SELECT base_date, CAST(sum(n) AS BIGINT) AS contract_count, CAST(sum(adj) AS BIGINT) AS adj_contract_count,
       CAST(sum(pay) AS DOUBLE) AS downpayment, CAST(sum(adj_pay) AS DOUBLE) AS modifieddownpayment
FROM (
    SELECT CAST(signed AS VARCHAR) AS base_date, signed AS d, count(DISTINCT CASE WHEN first_pay > 0 THEN oid END) AS n, 0 AS adj, sum(first_pay) AS pay, 0 AS adj_pay
    FROM contracts GROUP BY signed, scale, type
    UNION ALL
    SELECT CAST(CASE WHEN strftime(coalesce(changed, signed), '%Y%m') <= '202006' THEN signed ELSE coalesce(changed, signed) END AS VARCHAR),
           CASE WHEN strftime(coalesce(changed, signed), '%Y%m') <= '202006' THEN signed ELSE coalesce(changed, signed) END, 0,
           -count(DISTINCT CASE WHEN first_pay + extra_pay = 0 THEN oid END), 0, sum(extra_pay)
    FROM contracts WHERE extra_pay <> 0 GROUP BY coalesce(changed, signed), signed, scale, type
) WHERE d >= DATE '2018-01-01' AND d < DATE '2023-01-01' GROUP BY base_date
""",
    ),
)
def recognise_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Derived(spark, sf_dir)
    flat = contracts.flatten_contracts(t[REMODEL], t["dump.expertises"], LEGACY_TYPES)
    rows = contracts.recognise_contracts(flat, "202006", dt.date(2018, 1, 1), dt.date(2023, 1, 1))
    measures = ("contract_count", "adj_contract_count", "downpayment", "modifieddownpayment")
    return rows.groupBy("base_date").agg(*[F.sum(m).alias(m) for m in measures])


@register(
    "event_props_struct",
    """
    SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL
    """,
)
def event_props_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document column parsed to a struct and read by field."""
    ev = base_table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("doc"))
    return ev.groupBy("event_type", F.col("doc.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "has_related",
    """
    SELECT o_orderkey, coalesce(bool_or(l_linenumber = 1), false) AS has_first, coalesce(bool_or(l_linenumber = 7), false) AS has_last
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
    """,
)
def has_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base_table(spark, sf_dir, "orders").select("o_orderkey")
    li = base_table(spark, sf_dir, "lineitem")
    return lookup.has_related(o, li, "o_orderkey", "l_orderkey", "l_linenumber", {"has_first": 1, "has_last": 7})


@register(
    "normalise_ad_ledger",
    oracle(
        [LEDGER],
        """
        SELECT salesuserid, campaignid::VARCHAR AS campaignid, CAST(make_date(CAST(year AS INT), CAST(month AS INT), CAST(day AS INT)) AS VARCHAR) AS date,
               CAST(make_timestamp((clicktimestamp + 9 * 3600000) * 1000) AS VARCHAR) AS click_date,
               CAST(cost_cpc AS INTEGER) AS cost_cpc, CAST(cost_vat AS INTEGER) AS cost_vat, cost_ispaid, budget_paid IS NOT NULL AS has_budget,
               CASE WHEN budget_paid IS NULL THEN NULL ELSE CAST(budget_free AS INTEGER) END AS budget_free
        FROM advertise_ad_ledger WHERE ledgertype = 'CLICK' AND year || month || day >= '20240105'
        """,
    ),
)
def normalise_ad_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = ads.normalise_ad_ledger(Derived(spark, sf_dir)[LEDGER], first_day=dt.date(2024, 1, 5))
    keep = ["salesuserid", "campaignid", "date", "click_date", "cost_cpc", "cost_vat", "cost_ispaid", "has_budget", "budget_free"]
    return flat.select(*keep)


@register(
    "daily_ad_spend",
    oracle(
        [LEDGER],
        """
        SELECT CAST(salesuserid AS INTEGER) AS sales_user_id, year || '-' || month || '-' || day AS dt,
               CAST(coalesce(sum(cost_cpc + cost_vat) FILTER (cost_ispaid), 0) AS BIGINT) AS paid_incl_vat,
               CAST(coalesce(sum(cost_cpc + cost_vat) FILTER (NOT cost_ispaid), 0) AS BIGINT) AS free_incl_vat
        FROM advertise_ad_ledger WHERE ledgertype = 'CLICK' AND budget_paid IS NOT NULL AND cost_ispaid IS NOT NULL GROUP BY ALL
        """,
    ),
)
def daily_ad_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.daily_ad_spend(ads.normalise_ad_ledger(Derived(spark, sf_dir)[LEDGER]))


def _order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments; pending ones refunded in the order month for the net view only."""
    price = F.col("o_totalprice").cast(MONEY)
    pending = F.col("o_orderstatus") == "P"
    return base_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        month_text("o_orderdate").alias("month"),
        price.alias("paid"),
        F.lit(0).cast(MONEY).alias("cancel"),
        F.when(pending, -price).otherwise(0).cast(MONEY).alias("cancel2"),
    )


USER_MONTHS_SQL = """
WITH um AS (
    SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-01') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS cashflow,
           sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS net
    FROM orders WHERE o_custkey > 0 GROUP BY ALL
),
firsts AS (
    SELECT user_id, CASE WHEN user_id = 5 THEN '1996-02-01' ELSE min(month) FILTER (cashflow > 0) END AS c,
           CASE WHEN user_id = 5 THEN '1996-02-01' ELSE min(month) FILTER (net > 0) END AS n FROM um GROUP BY user_id
)
"""


@register(
    "user_month_totals",
    USER_MONTHS_SQL + "SELECT user_id, month, CAST(cashflow AS DOUBLE) AS cashflow, CAST(net AS DOUBLE) AS net FROM um",
)
def user_month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.user_month_totals(_order_months(spark, sf_dir))


@register(
    "first_order_month",
    USER_MONTHS_SQL + "SELECT DISTINCT user_id, c AS first_cash_month, n AS first_net_month FROM firsts",
)
def first_order_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = cohort.user_month_totals(_order_months(spark, sf_dir))
    firsts = cohort.first_order_month(totals, {5: "1996-02-01"})
    return firsts.select("user_id", "first_cash_month", "first_net_month").distinct()


@register(
    "cohort_matrix",
    USER_MONTHS_SQL
    + """,
    placed AS (SELECT um.*, CASE WHEN net = 0 THEN c ELSE n END AS f FROM um JOIN firsts USING (user_id))
    SELECT replace(left(f, 7), '-', '') AS yyyymm, replace(left(month, 7), '-', '') AS order_mm,
           (CAST(left(month, 4) AS INT) - CAST(left(f, 4) AS INT)) * 12 + CAST(month[6:7] AS INT) - CAST(f[6:7] AS INT) AS month_diff,
           count(DISTINCT user_id) FILTER (cashflow > 0) AS order_users, CAST(sum(cashflow) AS DOUBLE) AS selling_cost
    FROM placed WHERE f <= month GROUP BY ALL
    """,
)
def cohort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = cohort.user_month_totals(_order_months(spark, sf_dir))
    return cohort.cohort_matrix(cohort.first_order_month(totals, {5: "1996-02-01"}))


@register(
    "contact_dim",
    """
    SELECT DISTINCT n_nationkey || '-' || r_regionkey || '-' || s_nationkey AS number, r_name || '(' || n_name || ')' AS manager
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    """,
)
def contact_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (base_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        contacts.dashed("n_nationkey", "r_regionkey", "s_nationkey").alias("number"),
        contacts.named_mail("r_name", "n_name").alias("manager"),
    ).distinct()
