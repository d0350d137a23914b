"""The report jobs over the derived source tables, each against oracle SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derive import (
    AS_OF,
    CALENDAR,
    CALENDAR_FIRST,
    CALENDAR_LAST,
    SERVICE,
    Derived,
    base_table,
    oracle,
)
from checks.registry import ORACLES, cents, half_up, register
from ledgerweave import plans
from ledgerweave.operators import ads, codemap
from ledgerweave.operators import orders as order_ops
from ledgerweave.operators import settlement as settle
from ledgerweave.sources.catalog import Catalog
from ledgerweave.session import scratch_path

AD_AS_OF = dt.date(2024, 3, 1)
PERIOD = (dt.date(2017, 1, 1), dt.date(2024, 1, 1))
ISSUES_BEFORE = dt.date(2022, 4, 1)
FIRST_PARTY_SELLER = 3
LINK = "https://admin.example.com/orders/"
OVERRIDES = {7: "2022-01-01", 11: "2018-03-01"}
LEGACY_TYPES = {"리스팅": (21, 34), "간편": (55, 89, 144)}
PAID = (
    "is_payment_success AND payment_method IS NOT NULL "
    "AND (payment_method <> 'without_bankbook' OR is_success_vbank)"
)
SELLERS, CANCELS, EXCHANGES = (
    "temp.fin_non_3p_seller_current",
    "dump.order_option_cancels",
    "dump.order_option_exchanges",
)
HIERARCHY = ("dump.orders", "dump.order_productions", "dump.order_options")


# --- order options ------------------------------------------------------------------------
def _case(labels: dict[int, str], code: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items())
    return f"CASE {code} {whens} END"


_I = order_ops.ISSUE
_AS_OF_TS = f"TIMESTAMP '{AS_OF} 00:00:00'"


@register(
    "option_issues",
    oracle(
        [*HIERARCHY, SELLERS, CANCELS, EXCHANGES, "dump.productions", "dump.users", "dump.sales_users", "dump.admin_categories"],
        f"""
        live AS (
            SELECT q.id AS order_id, x.id AS option_id, q.payment_at, q.imp_uid, q.merchant_uid, p.seller_id,
                   p.delivery_method, p.production_id, x.* EXCLUDE (id)
            FROM dump_orders q JOIN dump_order_productions p ON p.order_id = q.id
            JOIN dump_order_options x ON x.order_production_id = p.id
            WHERE {PAID} AND q.payment_at < TIMESTAMP '{ISSUES_BEFORE} 00:00:00'
              AND coalesce(x.status, -1) NOT IN (5, 8, 9, 10)
        ),
        newest_cancel AS (
            SELECT order_option_id AS oid, arg_max(struct_pack(s := status, u := updated_at), (updated_at, id)) AS v
            FROM dump_order_option_cancels GROUP BY 1
        ),
        newest_exchange AS (
            SELECT order_option_id AS oid, arg_max(struct_pack(s := status, u := updated_at), (updated_at, id)) AS v
            FROM dump_order_option_exchanges GROUP BY 1
        ),
        wide AS (
            SELECT l.*, s.biz, pr.need_customer_number AS is_foreign, co.company,
                   split_part(ac.full_display_name, '>', 1) LIKE '{order_ops.RENTAL_ROOT}%' AND ac.id IS NOT NULL AS rental,
                   c.v.s AS cs, c.v.u AS cu, e.v.s AS es, e.v.u AS eu,
                   date_sub('day', l.payment_at, {_AS_OF_TS}) AS paid_days,
                   coalesce(s.biz IN ('1P', 'PREMIUM'), false) AS prem
            FROM live l
            LEFT JOIN temp_fin_non_3p_seller_current s ON CAST(s.seller_id AS BIGINT) = l.seller_id
            LEFT JOIN dump_productions pr ON pr.id = l.production_id
            LEFT JOIN (SELECT * FROM dump_users WHERE userable_type = 'SalesUser') u ON u.id = pr.user_id
            LEFT JOIN dump_sales_users co ON co.id = u.userable_id
            LEFT JOIN dump_admin_categories ac ON ac.id = pr.admin_category_id
            LEFT JOIN newest_cancel c ON c.oid = l.option_id
            LEFT JOIN newest_exchange e ON e.oid = l.option_id
        )
        SELECT '{LINK}' || order_id AS order_link, strftime(payment_at, '%Y%m') AS pay_mm, imp_uid, merchant_uid,
               order_id, option_id, seller_id, company, paid_days AS payment_since, is_foreign,
               CASE WHEN is_foreign THEN paid_days END AS foreign_since,
               coalesce(rental, false) AS is_rental, selling_cost = 0 AS is_zero, delivery_method = 1 AS is_seller_delivery,
               prem AS is_premium,
               CASE WHEN prem THEN date_sub('day', confirm_order_date, {_AS_OF_TS}) END AS premium_since,
               coalesce({_case(order_ops.OPTION_STATUS, 'status')}, 'NULL') AS option_status,
               {_case(order_ops.CANCEL_STATUS, 'cs')} AS cancel_status,
               CASE WHEN cs = 0 AND status = 6 THEN date_sub('day', cu, {_AS_OF_TS}) END AS cancel_since,
               {_case(order_ops.EXCHANGE_STATUS, 'es')} AS exch_status,
               CASE WHEN es = 0 AND status = 7 THEN date_sub('day', eu, {_AS_OF_TS}) END AS exch_since,
               CASE
                 WHEN cs = 2 THEN '{_I['check_cancelled']}'
                 WHEN seller_id = {FIRST_PARTY_SELLER} THEN '{_I['check_first_party_delivery']}'
                 WHEN status IS NULL THEN
                   CASE WHEN confirm_order_date IS NULL THEN '{_I['check_cancelled']}'
                        WHEN purchase_confirm_date IS NOT NULL THEN '{_I['set_confirmed']}'
                        WHEN delivery_complete_date IS NOT NULL THEN '{_I['set_delivered']}'
                        ELSE '{_I['ask_seller']}' END
                 WHEN status = 1 THEN
                   CASE WHEN rental AND selling_cost = 0 THEN '{_I['rental']}'
                        WHEN prem AND paid_days < 365 THEN '{_I['premium_young']}'
                        WHEN prem AND paid_days >= 365 THEN '{_I['premium_old']}'
                        WHEN delivery_method = 1 THEN '{_I['direct_delivery']}'
                        WHEN purchase_confirm_date IS NOT NULL THEN '{_I['set_confirmed']}'
                        ELSE '{_I['ask_seller']}' END
                 WHEN status = 4 AND delivery_complete_date IS NULL THEN
                   CASE WHEN delivery_start_date IS NULL THEN '{_I['no_delivery_dates']}' ELSE '{_I['no_complete_date']}' END
                 ELSE '{_I['undefined']}' END AS option_issue,
               CAST(CAST(payment_at AS DATE) AS VARCHAR) AS payment_dt,
               CAST(CAST(confirm_order_date AS DATE) AS VARCHAR) AS confirm_order_dt,
               CAST(CAST(delivery_start_date AS DATE) AS VARCHAR) AS delivery_start_dt,
               CAST(CAST(delivery_complete_date AS DATE) AS VARCHAR) AS delivery_complete_dt,
               CAST(CAST(purchase_confirm_date AS DATE) AS VARCHAR) AS purchase_confirm_dt,
               CAST(CAST(calculate_date AS DATE) AS VARCHAR) AS calculate_dt,
               is_calculated, CAST(selling_cost AS DOUBLE) AS selling_cost
        FROM wide
        """,
    ),
)
def option_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.option_issues(
        Derived(spark, sf_dir), AS_OF, ISSUES_BEFORE, first_party_seller=FIRST_PARTY_SELLER, link_prefix=LINK
    )


@register(
    "issue_ladder",
    f"SELECT option_issue, count(*) AS n, min(option_id) AS sample_option FROM ({ORACLES['option_issues']}) GROUP BY ALL",
)
def issue_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule of the real ladder decides, with a sample option."""
    return (
        option_issues(spark, sf_dir)
        .groupBy("option_issue")
        .agg(F.count(F.lit(1)).alias("n"), F.min("option_id").alias("sample_option"))
    )


@register(
    "options_without_status",
    oracle(
        [*HIERARCHY, CANCELS, EXCHANGES],
        f"""
        SELECT q.id, x.id AS option_id, CAST(q.created_at AS VARCHAR) AS order_created_at,
               CAST(q.payment_at AS VARCHAR) AS payment_at, CAST(x.confirm_order_date AS VARCHAR) AS confirm_order_date,
               CAST(x.delivery_start_date AS VARCHAR) AS delivery_start_date,
               CAST(x.delivery_complete_date AS VARCHAR) AS delivery_complete_date,
               CAST(x.purchase_confirm_date AS VARCHAR) AS purchase_confirm_date,
               c.status AS cancel_status, CAST(c.updated_at AS VARCHAR) AS cancel_updated_at,
               e.status AS exchange_status, CAST(e.updated_at AS VARCHAR) AS exchange_updated_at,
               list_max(list_filter([
                   CASE WHEN c.status = 2 THEN 9 END, CASE WHEN x.purchase_confirm_date IS NOT NULL THEN 5 END,
                   CASE WHEN x.delivery_complete_date IS NOT NULL THEN 4 END, CASE WHEN x.delivery_start_date IS NOT NULL THEN 3 END,
                   CASE WHEN x.confirm_order_date IS NOT NULL THEN 2 END, CASE WHEN q.payment_at IS NOT NULL THEN 1 END
               ], lambda s: s IS NOT NULL)) AS should_be_option_status
        FROM (SELECT * FROM dump_orders WHERE {PAID}) q
        JOIN dump_order_productions p ON p.order_id = q.id
        JOIN (SELECT * FROM dump_order_options WHERE status IS NULL) x ON x.order_production_id = p.id
        LEFT JOIN dump_order_option_cancels c ON c.order_option_id = x.id
        LEFT JOIN dump_order_option_exchanges e ON e.order_option_id = x.id
        """,
    ),
)
def options_without_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.options_without_status(Derived(spark, sf_dir), max_rows=None)


# --- points -------------------------------------------------------------------------------
POINTS, DETAILS, TYPES = "dump_point.points", "dump_point.point_details", "finance.mileage_point_type_mapping"


@register(
    "point_control_total",
    oracle(
        [POINTS],
        f"""
        SELECT version, process_type, CAST(sum(amount) AS DOUBLE) AS amt
        FROM dump_point_points WHERE service_id = '{SERVICE}' AND point_type = 'POINT' GROUP BY ALL
        """,
    ),
)
def point_control_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.point_control_total(Derived(spark, sf_dir), SERVICE)


@register(
    "point_balance_difference",
    oracle(
        [POINTS, "dump_point.user_points", "dump.users"],
        f"""
        ledger AS (
            SELECT user_id, sum(amount) AS s, count(id) AS n FROM dump_point_points WHERE service_id = '{SERVICE}' GROUP BY 1
        ),
        balance AS (
            SELECT user_id, sum(balance) AS b FROM dump_point_user_points WHERE service_id = '{SERVICE}' GROUP BY 1
        )
        SELECT user_id, user_id NOT IN (SELECT id FROM dump_users) AS withdrawal,
               CAST(coalesce(s, 0) AS DOUBLE) AS data_sum, CAST(coalesce(b, 0) AS DOUBLE) AS user_bal,
               CAST(coalesce(s, 0) - coalesce(b, 0) AS DOUBLE) AS diff, CAST(coalesce(n, 0) AS BIGINT) AS tran_count
        FROM ledger FULL JOIN balance USING (user_id) WHERE coalesce(s, 0) <> coalesce(b, 0)
        """,
    ),
)
def point_balance_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.point_balance_difference(Derived(spark, sf_dir), SERVICE)


MONTHS_LEFT = (
    "(CASE WHEN {b} >= {a} THEN date_sub('month', {a}, {b}) ELSE -date_sub('month', {b}, {a}) END)"
)
POINT_REPORT_TABLES = [
    "dump.order_options",
    "dump.order_productions",
    SELLERS,
    POINTS,
    DETAILS,
    TYPES,
    "finance.fin_mileage_histories_d",
]
_KEPT = "'CONFIRM_ORDER', 'DECORATIVE_SUPPORT_FUND', 'EXPIRE', 'USE_FOR_ORDER', 'WITHDRAW_BY_ADMIN', 'WITHDRAW_BY_CANCEL_CONFIRM'"
POINT_ROWS_SQL = f"""
option_of AS (
    SELECT CAST(x.id AS VARCHAR) AS okey, s.biz
    FROM dump_order_options x LEFT JOIN dump_order_productions p ON p.id = x.order_production_id
    LEFT JOIN temp_fin_non_3p_seller_current s ON CAST(s.seller_id AS BIGINT) = p.seller_id
),
origin AS (
    SELECT DISTINCT d.id AS first_id, g.process_type AS first_process, m.acct_type AS first_acct,
           CASE WHEN g.category_type = 'CONFIRM_ORDER' THEN CASE WHEN o.biz IN ('1P', 'PREMIUM') THEN '1P' ELSE '3P' END END AS first_biz,
           g.category_type AS first_cate, g.version AS first_version, g.created_at AS first_at
    FROM dump_point_point_details d JOIN dump_point_points g ON g.id = d.point_id
    LEFT JOIN option_of o ON g.category_type = 'CONFIRM_ORDER' AND o.okey = g.request_id
    LEFT JOIN finance_mileage_point_type_mapping m ON m.category_type = g.category_type
    WHERE d.detail_first_accum_id = d.id
),
base AS (
    SELECT g.*, d.id AS detail_id, d.detail_first_accum_id, d.use_end_date AS detail_end, d.amount AS detail_amount, f.*
    FROM dump_point_points g LEFT JOIN dump_point_point_details d ON d.point_id = g.id
    LEFT JOIN origin f ON f.first_id = d.detail_first_accum_id
    WHERE g.point_type = 'POINT' AND g.service_id = '{SERVICE}'
),
legacy AS (
    SELECT b.*, h.mileage, z.id AS mig_id, z.category_type AS mig_cate, z.created_at AS mig_at, z.use_end_date AS mig_end,
           z.request_id AS mig_request,
           CASE WHEN b.process_type = 'ACCUM' THEN b.category_type END AS own_cate
    FROM base b
    LEFT JOIN finance_fin_mileage_histories_d h
      ON b.first_version IS NULL AND h.user_id = CAST(b.user_id AS VARCHAR) AND h.mileage_id = b.payload
    LEFT JOIN dump_point_points z
      ON CAST(z.payload AS VARCHAR) = h.reference_mileage_id AND CAST(z.user_id AS VARCHAR) = h.user_id
),
traced AS (
    SELECT l.*, o.biz AS option_biz, m.dept,
           coalesce(own_cate, first_cate, mig_cate) AS cate,
           CAST(coalesce(CASE WHEN l.process_type = 'ACCUM' THEN l.created_at END, first_at, mig_at) AS DATE) AS start_day,
           coalesce(detail_end, use_end_date, mig_end) AS end_day,
           coalesce(detail_amount, amount) AS whole, coalesce(detail_id, l.id) AS share_key
    FROM legacy l
    LEFT JOIN option_of o
      ON coalesce(own_cate, mig_cate, first_cate) = 'CONFIRM_ORDER' AND o.okey = coalesce(mig_request, request_id)
    LEFT JOIN finance_mileage_point_type_mapping m ON m.category_type = coalesce(own_cate, mig_cate, first_cate)
),
shared AS (
    SELECT *, round(CAST(whole AS DOUBLE) * CAST(coalesce(mileage, 1) AS DOUBLE)
                    / CAST(sum(coalesce(mileage, 1)) OVER (PARTITION BY share_key) AS DOUBLE)) AS part,
           row_number() OVER (PARTITION BY share_key ORDER BY coalesce(mig_id, first_id), id, detail_id, mig_id, mileage, dept,
                              option_biz, first_process, first_acct, first_biz) AS rn,
           CASE WHEN cate = 'CONFIRM_ORDER' THEN CASE WHEN option_biz IN ('1P', 'PREMIUM') THEN '1P' ELSE '3P' END
                ELSE first_biz END AS cate_biz,
           CASE WHEN cate IN ({_KEPT}) THEN cate WHEN cate IN ('ORDER_CANCEL', 'ORDER_REFUND') THEN 'ORDER_CANCEL/REFUND'
                WHEN cate IS NOT NULL THEN 'EVENT' ELSE 'UNKNOWN' END AS cate_group
    FROM traced
),
settled AS (
    SELECT *, CASE WHEN process_type = 'ACCUM' THEN CAST(whole AS DOUBLE)
                   WHEN rn = 1 THEN CAST(whole AS DOUBLE) - sum(coalesce(part, 0)) OVER (PARTITION BY detail_id, id) + coalesce(part, 0)
                   ELSE coalesce(part, 0) END AS final_amount
    FROM shared
)
"""


@register(
    "point_report",
    oracle(
        POINT_REPORT_TABLES,
        POINT_ROWS_SQL
        + f"""
SELECT CASE WHEN first_id IS NOT NULL AND first_version <> 'm' THEN 'MSA' ELSE 'LEGACY' END AS accum_ver,
       version AS tran_ver, strftime(created_at, '%Y%m') AS tran_mm,
       coalesce(strftime(start_day, '%Y%m'), 'unknown') AS accum_mm, coalesce(strftime(end_day, '%Y%m'), 'unknown') AS exp_mm,
       coalesce(CAST({MONTHS_LEFT.format(a='start_day', b='end_day')} > 1 AS VARCHAR), 'unknown') AS over_1mnth,
       coalesce(CAST(end_day < DATE '{AS_OF}' - 1 AS VARCHAR), 'unknown') AS exp_date_pass,
       process_type, cate_group AS accum_acct_cate, cate_group || coalesce('-' || cate_biz, '') AS accum_acct_cate_biz,
       dept AS accum_dept, dept || coalesce('-' || cate_biz, '') AS accum_dept_biz,
       coalesce(cate, 'UNKNOWN') AS accum_cate, category_type AS tran_cate,
       CAST(sum(CAST(final_amount AS DECIMAL(28,2))) AS DOUBLE) AS amount, count(DISTINCT id) AS pointid_cnt,
       max(user_id) AS sample_user, max(id) AS sample_pointid, max(detail_id) AS sample_detail_id,
       max(coalesce(detail_first_accum_id, mig_id)) AS sample_first
FROM settled GROUP BY ALL
""",
    ),
)
def point_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.point_report(Derived(spark, sf_dir), SERVICE, AS_OF)


@register(
    "point_departments",
    oracle(
        [*HIERARCHY[1:], SELLERS, POINTS, DETAILS, TYPES, "dump.order_options_l", "dump.order_productions_l", CALENDAR],
        f"""
        seller_of AS (
            SELECT CAST(x.id AS VARCHAR) AS okey, p.seller_id AS live_seller, NULL AS old_seller
            FROM dump_order_options x JOIN dump_order_productions p ON p.id = x.order_production_id
            UNION ALL
            SELECT CAST(x.id AS VARCHAR), NULL, p.seller_id
            FROM dump_order_options_l x JOIN dump_order_productions_l p ON p.id = x.order_production_id AND p.base_dt = x.base_dt
            WHERE x.base_dt = '2022-12-01'
        ),
        one_seller AS (SELECT okey, coalesce(max(live_seller), max(old_seller)) AS seller FROM seller_of GROUP BY 1),
        biz_of AS (
            SELECT g.id AS point_id, CASE WHEN s.biz IS NOT NULL THEN s.biz WHEN o.seller IS NOT NULL THEN '3P' END || '-' AS biz
            FROM dump_point_points g LEFT JOIN one_seller o ON o.okey = g.request_id
            LEFT JOIN temp_fin_non_3p_seller_current s ON CAST(s.seller_id AS BIGINT) = o.seller
            WHERE g.category_type = 'CONFIRM_ORDER' AND g.point_type = 'POINT'
        ),
        first_of AS (
            SELECT DISTINCT d.id AS first_id, g.category_type AS cate, b.biz
            FROM dump_point_point_details d JOIN dump_point_points g ON g.id = d.point_id LEFT JOIN biz_of b ON b.point_id = g.id
            WHERE d.detail_first_accum_id = d.id
        ),
        flat AS (
            SELECT CAST(g.created_at AS DATE) AS day, g.process_type, coalesce(d.amount, g.amount) AS amount, m.dept,
                   coalesce(b.biz, f.biz, '') AS prefix,
                   coalesce({MONTHS_LEFT.format(a='CAST(g.created_at AS DATE)', b='g.use_end_date')} <= 0, false) AS short
            FROM dump_point_points g LEFT JOIN dump_point_point_details d ON d.point_id = g.id
            LEFT JOIN biz_of b ON b.point_id = g.id LEFT JOIN first_of f ON f.first_id = d.detail_first_accum_id
            LEFT JOIN finance_mileage_point_type_mapping m ON m.category_type = coalesce(f.cate, g.category_type)
            WHERE g.process_type IN ('ACCUM', 'WITHDRAW') AND g.service_id = '{SERVICE}' AND g.created_at >= TIMESTAMP '2019-01-01'
        ),
        totals AS (
            SELECT strftime(day, '%Y%m') AS tran_mm, c.first_of_week,
                   prefix || dept || CASE WHEN dept <> 'OTHER' THEN '' WHEN short THEN '-SHORT' ELSE '-NORMAL' END AS department,
                   sum(amount) AS t, coalesce(sum(amount) FILTER (process_type = 'ACCUM'), 0) AS a,
                   coalesce(sum(amount) FILTER (process_type = 'WITHDRAW'), 0) AS w
            FROM flat LEFT JOIN ba_preserved_calendar c ON c.date = flat.day GROUP BY ALL
        )
        SELECT tran_mm, CAST(first_of_week AS VARCHAR) AS first_of_week, department,
               CAST(t AS DOUBLE) AS point, CAST({half_up(cents('t'), '110')} AS DOUBLE) AS ex_vat_point,
               CAST(a AS DOUBLE) AS accum_point, CAST({half_up(cents('a'), '110')} AS DOUBLE) AS accum_ex_vat_point,
               CAST(w AS DOUBLE) AS withdraw_point, CAST({half_up(cents('w'), '110')} AS DOUBLE) AS withdraw_ex_vat_point
        FROM totals
        """,
    ),
)
def point_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.point_departments(Derived(spark, sf_dir), SERVICE)


# --- settlement -----------------------------------------------------------------------------
STAGE = [
    "dump_payment_stage.payment_transactions",
    "dump_payment_stage.payment_transaction_items",
    "dump_payment_stage.payment_items",
    "dump_payment_stage.payment_transaction_item_amounts",
    "dump_stage.order_options",
    "dump_stage.order_productions",
]
COUPON = "finance.fin_coupon_order_options_settlement"
CART_COUPON = "finance.fin_coupon_cart_order_options_settlement"
MILEAGE = "finance.fin_mileage_order_options_settlement"


def _cost_sql(milestone: settle.Milestone, coupon: str, qty_at: str) -> str:
    """Coupon and mileage rows stacked, then one aggregate per source and group."""
    status = f"AND x.status IN ({', '.join(map(str, milestone.statuses))})" if milestone.statuses else ""
    ms = "q.payment_at" if milestone.column == "payment_at" else f"x.{milestone.column}"
    qty = "q.payment_at" if qty_at == "payment_at" else f"x.{qty_at}"
    return f"""
costs AS (
    SELECT 'c' AS src, base_dttm, batch_job, kind, order_id, order_option_id, coupon_cost AS cost FROM {coupon.replace('.', '_')}
    UNION ALL
    SELECT 'm', base_dttm, batch_job, kind, order_id, order_option_id, mileage_cost FROM finance_fin_mileage_order_options_settlement
),
placed AS (
    SELECT k.src, k.cost, k.order_id, k.order_option_id, p.seller_id, p.production_id AS product_id, x.reference_option_id AS product_option_id,
           p.name AS product_name, x.explain AS option_name, CAST(greatest(k.base_dttm, {ms}) AS DATE) AS day,
           CAST(q.payment_at AS DATE) AS d1, CAST(x.delivery_complete_date AS DATE) AS d2, CAST(x.purchase_confirm_date AS DATE) AS d3,
           CASE WHEN k.batch_job = 'manual_correction' THEN '{settle.KIND_MANUAL}'
                WHEN CAST(k.base_dttm AS DATE) <= CAST({ms} AS DATE) THEN '{milestone.reached}'
                WHEN k.kind = -1 THEN '{milestone.cancelled}' ELSE '{settle.KIND_RECALCULATED}' END AS kind,
           CASE WHEN CAST(k.base_dttm AS DATE) <= CAST(CASE k.src WHEN 'c' THEN {ms} ELSE {qty} END AS DATE) THEN x.count ELSE 0 END AS qty
    FROM costs k JOIN dump_order_options x ON x.id = CAST(k.order_option_id AS BIGINT) {status}
    JOIN dump_order_productions p ON p.id = x.order_production_id JOIN dump_orders q ON q.id = p.order_id
    WHERE {ms} IS NOT NULL
),
booked AS (
    SELECT * EXCLUDE (cost, qty), sum(cost) AS cost, sum(qty) AS qty FROM placed
    WHERE day >= DATE '{PERIOD[0]}' AND day < DATE '{PERIOD[1]}' GROUP BY ALL HAVING sum(cost) <> 0
)"""


def _stage_sql(by_delivery: bool) -> str:
    day = "x.delivery_complete_date" if by_delivery else "t.transaction_at"
    extra = "AND x.status IN (4, 5)" if by_delivery else ""
    return f"""
staged AS (
    SELECT CAST(t.transaction_at AS DATE) AS day,
           CASE t.transaction_type WHEN 'PAYMENT' THEN '{settle.KIND_PAID}' WHEN 'CANCEL' THEN '{settle.KIND_STAGE_CANCELLED}' END AS kind,
           p.seller_id, CAST(t.order_id AS VARCHAR) AS order_id, CAST(x.id AS VARCHAR) AS order_option_id, p.id AS product_id,
           x.reference_option_id AS product_option_id, coalesce(p.name, '{settle.SHIPPING_NAME}') AS product_name, x.explain AS option_name,
           CAST(x.delivery_complete_date AS DATE) AS d2, CAST(x.purchase_confirm_date AS DATE) AS d3,
           sum(CASE WHEN a.payment_method_type = 'PRODUCT_COUPON' THEN a.amount ELSE 0 END) AS coupon
    FROM dump_payment_stage_payment_transactions t
    LEFT JOIN dump_payment_stage_payment_transaction_items ti USING (payment_id, transaction_id)
    LEFT JOIN dump_payment_stage_payment_items i USING (payment_item_id)
    LEFT JOIN dump_payment_stage_payment_transaction_item_amounts a
      ON a.payment_item_id = ti.payment_item_id AND a.transaction_id = t.transaction_id
    LEFT JOIN dump_stage_order_options x ON CAST(x.id AS VARCHAR) = i.item_reference_id
    LEFT JOIN dump_stage_order_productions p ON p.id = x.order_production_id
    WHERE t.service_id = '{SERVICE}' AND p.seller_id IS NOT NULL
      AND CAST({day} AS DATE) >= DATE '{PERIOD[0]}' AND CAST({day} AS DATE) < DATE '{PERIOD[1]}' {extra}
    GROUP BY ALL HAVING coupon <> 0
)"""


REPORT_SQL = """
SELECT strftime(day, '%Y') AS year, strftime(day, '%m') AS month, CAST(day AS VARCHAR) AS base_dt, kind, order_id, order_option_id,
       product_name, option_name, product_id, product_option_id, CAST(sum(qty) AS BIGINT) AS quantity,
       CAST(round(sum(points)) AS BIGINT) AS point_total, CAST(round(sum(coupon)) AS BIGINT) AS coupon_total
FROM (
    SELECT day, kind, order_id, order_option_id, product_name, option_name, product_id, product_option_id, qty,
           CASE src WHEN 'm' THEN -cost ELSE 0 END AS points, CASE src WHEN 'c' THEN -cost ELSE 0 END AS coupon FROM booked
    UNION ALL
    SELECT day, kind, order_id, order_option_id, product_name, option_name, product_id, product_option_id, 0, 0, -coupon FROM staged
) GROUP BY ALL
"""
SETTLE_ARGS = {
    "sellers": None,
    "period": PERIOD,
    "stage_service": SERVICE,
    "stage_sellers": None,
    "stage_period": PERIOD,
}


@register(
    "payment_discounts",
    oracle(
        [*HIERARCHY, COUPON, MILEAGE, *STAGE],
        _cost_sql(settle.PAYMENT, COUPON, "payment_at") + "," + _stage_sql(False) + REPORT_SQL,
    ),
)
def payment_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.payment_discounts(Derived(spark, sf_dir), **SETTLE_ARGS)


@register(
    "delivery_discounts",
    oracle(
        [*HIERARCHY, COUPON, MILEAGE, *STAGE],
        _cost_sql(settle.DELIVERY, COUPON, "payment_at") + "," + _stage_sql(True) + REPORT_SQL,
    ),
)
def delivery_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.delivery_discounts(Derived(spark, sf_dir), **SETTLE_ARGS)


ROUND_SQL = f"""
CASE WHEN day({{0}}) > 14 THEN '{settle.ROUND_FIRST}' ELSE '{settle.ROUND_SECOND}' END AS settle_round,
strftime(CASE WHEN day({{0}}) > 14 THEN {{0}} + INTERVAL 1 MONTH ELSE {{0}} END, '%Y') AS settle_year,
strftime(CASE WHEN day({{0}}) > 14 THEN {{0}} + INTERVAL 1 MONTH ELSE {{0}} END, '%m') AS settle_month
"""


SALES, SALE_DETAILS = "dump_settlement_stage.order_sales_l", "dump_settlement_stage.discount_price_detail_l"
STAGE_SETTLEMENT_SQL = f"""
newest AS (SELECT max(base_dt) AS b FROM dump_settlement_stage_order_sales_l),
staged AS (
    SELECT CAST(s.recognized_at AS DATE) AS day, strftime(s.settlement_at, '%Y%m') AS settled, day(s.settlement_at) <= 14 AS half,
           CASE WHEN s.recognized_type = 'PURCHASE_CONFIRMED' THEN '{settle.KIND_CONFIRMED}' ELSE '{settle.KIND_CONFIRMED_CANCELLED}' END AS kind,
           CAST(s.order_id AS VARCHAR) AS order_id, CAST(s.order_option_id AS VARCHAR) AS order_option_id, s.product_name, s.option_name,
           s.quantity AS qty, s.product_id, s.option_id AS product_option_id, sum(d.amount) AS coupon
    FROM dump_settlement_stage_order_sales_l s
    JOIN dump_settlement_stage_discount_price_detail_l d
      ON d.base_dt = s.base_dt AND d.order_sales_id = s.id AND d.discount_type = 'PRODUCT_COUPON'
    WHERE s.base_dt = (SELECT b FROM newest) AND s.recognized_at >= TIMESTAMP '{PERIOD[0]}' AND s.recognized_at < TIMESTAMP '{PERIOD[1]}'
    GROUP BY ALL
)
"""


@register(
    "purchase_confirm_discounts",
    oracle(
        [
            *HIERARCHY,
            CART_COUPON,
            MILEAGE,
            "dump_settlement_stage.order_sales_l",
            "dump_settlement_stage.discount_price_detail_l",
        ],
        _cost_sql(settle.CONFIRM, CART_COUPON, "purchase_confirm_date")
        + f""",
{STAGE_SETTLEMENT_SQL}
SELECT {ROUND_SQL.format('day')}, CAST(day AS VARCHAR) AS base_dt, kind, order_id, order_option_id,
       product_name, option_name, product_id, product_option_id, CAST(sum(qty) AS BIGINT) AS quantity,
       CAST(round(sum(points)) AS BIGINT) AS point_total, CAST(round(sum(coupon)) AS BIGINT) AS coupon_total
FROM (
    SELECT day, kind, order_id, order_option_id, product_name, option_name, product_id, product_option_id, qty,
           CASE src WHEN 'm' THEN -cost ELSE 0 END AS points, CASE src WHEN 'c' THEN -cost ELSE 0 END AS coupon FROM booked
    UNION ALL
    SELECT day, kind, order_id, order_option_id, product_name, option_name, product_id, product_option_id, qty, 0, coupon FROM staged
) GROUP BY ALL
""",
    ),
)
def purchase_confirm_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.purchase_confirm_discounts(Derived(spark, sf_dir), None, PERIOD, None, PERIOD)


# --- monthly reports ------------------------------------------------------------------------
@register(
    "agency_funding",
    oracle(
        ["finance.fin_vendor_funding_md", CALENDAR],
        f"""
        SELECT v.yyyymm, CAST(c.first_of_week AS VARCHAR) AS first_of_week, v.logisticstype, v.cate_name,
               CAST(any_value(day(last_day(c.date))) AS INTEGER) AS date_diff,
               CAST(sum(CAST(v.funding_value AS DECIMAL(18,2))) AS DOUBLE) / any_value(day(last_day(c.date))) AS daily_funding_value
        FROM finance_fin_vendor_funding_md v JOIN ba_preserved_calendar c ON c.year_month = v.yyyymm
        WHERE c.date < DATE '{AS_OF}' GROUP BY ALL
        """,
    ),
)
def agency_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.agency_funding(Derived(spark, sf_dir), AS_OF)


@register(
    "mapping_validation",
    oracle(
        [
            SELLERS,
            "finance.monthly_sku_orderprice",
            "finance.fin_admin_categories_md",
            "finance.fin_transport_fee_calculate_options_monthly",
            "ba.pbc_products",
            "dump.production_properties",
            POINTS,
            TYPES,
        ],
        """
        keyed AS (
            SELECT 'temp.fin_non_3p_seller_current' AS table_name, seller_id AS join_key, company_name IS NOT NULL AS counted
            FROM temp_fin_non_3p_seller_current
            UNION ALL SELECT 'finance.monthly_sku_orderprice', yyyymm || ' / ' || skucode, load_dt IS NOT NULL FROM finance_monthly_sku_orderprice
            UNION ALL SELECT 'finance.fin_admin_categories_md', admin_category_id, name_depth1 IS NOT NULL FROM finance_fin_admin_categories_md
            UNION ALL SELECT 'finance.fin_transport_fee_calculate_options_monthly', yyyymm || ' / ' || option_id, basic_transport_fee IS NOT NULL
            FROM finance_fin_transport_fee_calculate_options_monthly
            UNION ALL SELECT 'ba.pbc_products', CAST(production_id AS VARCHAR), type IS NOT NULL FROM ba_pbc_products
            UNION ALL SELECT 'dump.production_properties', CAST(production_id AS VARCHAR), id IS NOT NULL
            FROM dump_production_properties WHERE property_number = 0
        )
        SELECT table_name, join_key, count(*) FILTER (counted) AS row_count FROM keyed GROUP BY ALL HAVING row_count > 1
        UNION ALL
        SELECT 'finance.mileage_point_type_mapping', category_type, count(category_type) FROM dump_point_points
        WHERE NOT EXISTS (FROM finance_mileage_point_type_mapping m WHERE m.category_type = dump_point_points.category_type)
        GROUP BY ALL
        """,
    ),
)
def mapping_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.mapping_validation(Derived(spark, sf_dir))


@register(
    "marketing_expense",
    oracle(
        ["ba_preserved.mkt_cost_d", "ba_preserved.mkt_cost_m", "temp.fin_mkt_freecash", CALENDAR],
        f"""
        seen AS (
            SELECT CAST(c.first_of_month AS VARCHAR) AS base_m, c.first_of_week, c.year_month, CAST(f.value AS INTEGER) AS value
            FROM temp_fin_mkt_freecash f JOIN ba_preserved_calendar c ON c.year_month = left(f.yyyymmdd, 6) WHERE c.date < DATE '{AS_OF}'
        ),
        days AS (SELECT year_month, count(*) AS n FROM seen GROUP BY 1),
        stacked AS (
            SELECT base_m, base_dt, -cost AS daily_cost, 0 AS fix_cost FROM ba_preserved_mkt_cost_d
            WHERE base_m > (SELECT max(base_m) FROM ba_preserved_mkt_cost_m)
            UNION ALL SELECT base_m, base_dt, 0, -cost FROM ba_preserved_mkt_cost_m
        ),
        parts AS (
            SELECT s.base_m, c.first_of_week, s.daily_cost, s.fix_cost, 0 AS freecash
            FROM stacked s LEFT JOIN ba_preserved_calendar c ON c.date = CAST(s.base_dt AS DATE)
            UNION ALL SELECT base_m, first_of_week, 0, 0, value // n FROM seen JOIN days USING (year_month)
        )
        SELECT base_m, CAST(first_of_week AS VARCHAR) AS first_of_week, CAST(sum(daily_cost + fix_cost) AS DOUBLE) AS cost,
               CAST(sum(freecash) AS DOUBLE) AS freecash, CAST(sum(daily_cost) AS DOUBLE) AS daily_cost, CAST(sum(fix_cost) AS DOUBLE) AS fix_cost
        FROM parts GROUP BY ALL
        """,
    ),
)
def marketing_expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.marketing_expense(Derived(spark, sf_dir), AS_OF)


@register(
    "moving_revenue",
    oracle(
        ["dump_payment_o2o.sales", CALENDAR],
        """
        SELECT strftime(s.basis_date_time, '%Y%m') AS yyyymm, CAST(c.first_of_week AS VARCHAR) AS first_of_week,
               count(*) FILTER (s.sales_status = 2) AS rev_count, -count(*) FILTER (s.sales_status = 3) AS cancel_count,
               CAST(sum(CASE s.sales_status WHEN 2 THEN coalesce(paid_cash_amount, 0) ELSE -coalesce(paid_cash_amount, 0) END) AS DOUBLE)
                 / CAST(1.1 AS DOUBLE) AS paid_rev,
               CAST(sum(CASE s.sales_status WHEN 2 THEN coalesce(free_cash_amount, 0) ELSE -coalesce(free_cash_amount, 0) END) AS DOUBLE)
                 / CAST(1.1 AS DOUBLE) AS free_rev
        FROM dump_payment_o2o_sales s LEFT JOIN ba_preserved_calendar c ON c.date = CAST(s.basis_date_time AS DATE)
        WHERE s.is_deleted = 0 AND s.sales_status <> 1 GROUP BY ALL
        """,
    ),
)
def moving_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.moving_revenue(Derived(spark, sf_dir))


REMODEL = "dump_mongo_expert.remodelingstep"
_LOCAL = "CAST(CAST({} AS TIMESTAMP) + INTERVAL 9 HOUR AS DATE)"


def _utc(c: str) -> str:
    return _LOCAL.format(f"replace(left({c}, 19), 'T', ' ')")


REMODEL_FLAT_SQL = f"""
skills AS (
    SELECT expert_user_id AS expert, bool_or(expertise = 5) AS whole, bool_or(expertise = 26) AS cafe FROM dump_expertises GROUP BY 1
),
contracts AS (
    SELECT r.oid, {_utc('r.inspecteddate')} AS signed, {_utc('r.modifieddate')} AS changed,
           coalesce(r.downpayment, 0) AS first_pay, coalesce(r.modifieddownpayment, 0) AS extra_pay,
           CASE WHEN r.legacyconsultationid IN (21, 34) THEN '리스팅' WHEN r.legacyconsultationid IN (55, 89, 144) THEN '간편'
                WHEN r.inflowchannel IN (1, 2) THEN '리스팅' WHEN r.inflowchannel = 3 THEN '시공스토어'
                WHEN r.inflowchannel <= 7 THEN '간편' ELSE CAST(r.inflowchannel AS VARCHAR) END AS type,
           CASE r.scale WHEN 0 THEN '종합' WHEN 1 THEN '개별' WHEN 2 THEN '카페' WHEN 9999999 THEN
                CASE WHEN coalesce(k.whole, false) THEN '종합' WHEN coalesce(k.cafe, false) THEN '카페' ELSE '개별' END
                ELSE CAST(r.scale AS VARCHAR) END AS scale
    FROM dump_mongo_expert_remodelingstep r LEFT JOIN skills k ON k.expert = r.expert
    WHERE r.inspecteddate IS NOT NULL AND r.username IS NOT NULL AND NOT contains(lower(r.username), 'test')
      AND NOT contains(r.username, '테스트') AND NOT regexp_matches(r.username, '효.iOS')
)
"""


@register(
    "remodeling_gmv",
    oracle(
        [REMODEL, "dump.expertises", CALENDAR],
        REMODEL_FLAT_SQL
        + f""",
recognised AS (
    SELECT signed AS base, scale, type, count(DISTINCT oid) FILTER (first_pay > 0) AS n, 0 AS adj_n, sum(first_pay) AS pay, 0 AS adj_pay
    FROM contracts GROUP BY signed, scale, type
    UNION ALL
    SELECT CASE WHEN coalesce(changed, signed) < DATE '2023-01-01' THEN signed ELSE coalesce(changed, signed) END, scale, type,
           0, -count(DISTINCT oid) FILTER (first_pay + extra_pay = 0), 0, sum(extra_pay)
    FROM contracts WHERE extra_pay <> 0 GROUP BY coalesce(changed, signed), signed, scale, type
)
SELECT strftime(base, '%Y%m') AS yyyymm, CAST(c.first_of_week AS VARCHAR) AS first_of_week, scale, type,
       CAST(sum(pay) AS DOUBLE) AS gmv_org, CAST(sum(adj_pay) AS DOUBLE) AS gmv_adj, CAST(sum(pay) + sum(adj_pay) AS DOUBLE) AS gmv,
       CAST(sum(n) AS BIGINT) AS contract_count_org, CAST(sum(adj_n) AS BIGINT) AS contract_count_adj, CAST(sum(n + adj_n) AS BIGINT) AS contract_count
FROM recognised LEFT JOIN ba_preserved_calendar c ON c.date = base
WHERE base < DATE '{AS_OF}' AND base >= DATE '2021-06-01' GROUP BY ALL
""",
    ),
)
def remodeling_gmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.remodeling_gmv(Derived(spark, sf_dir), AS_OF, LEGACY_TYPES)


@register(
    "user_cohort",
    oracle(
        ["ba_preserved.mkt_arppu_summary"],
        """
        cash AS (SELECT user_id, month, sum(paid) + sum(cancel) AS v FROM ba_preserved_mkt_arppu_summary WHERE user_id > 0 GROUP BY 1, 2),
        net AS (SELECT user_id, month, sum(paid) + sum(cancel2) AS v FROM ba_preserved_mkt_arppu_summary WHERE user_id > 0 GROUP BY 1, 2),
        fixed(user_id, m) AS (VALUES (7, '2022-01-01'), (11, '2018-03-01')),
        first_cash AS (SELECT user_id, min(month) AS m FROM cash WHERE v > 0 AND user_id NOT IN (7, 11) GROUP BY 1 UNION ALL FROM fixed),
        first_net AS (SELECT user_id, min(month) AS m FROM net WHERE v > 0 AND user_id NOT IN (7, 11) GROUP BY 1 UNION ALL FROM fixed),
        rows AS (
            SELECT cash.user_id, cash.month, cash.v, f.m FROM cash JOIN net USING (user_id, month) JOIN first_cash f ON f.user_id = cash.user_id WHERE net.v = 0
            UNION ALL
            SELECT cash.user_id, cash.month, cash.v, f.m FROM cash JOIN net USING (user_id, month) JOIN first_net f ON f.user_id = cash.user_id WHERE net.v <> 0
        )
        SELECT strftime(CAST(m AS DATE), '%Y%m') AS yyyymm, strftime(CAST(month AS DATE), '%Y%m') AS order_mm,
               date_diff('month', CAST(m AS DATE), CAST(month AS DATE)) AS month_diff,
               count(DISTINCT CASE WHEN v > 0 THEN user_id END) AS order_users, CAST(sum(v) AS DOUBLE) AS selling_cost
        FROM rows WHERE m <= month GROUP BY ALL
        """,
    ),
)
def user_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.user_cohort(Derived(spark, sf_dir), OVERRIDES)


# --- advertising ------------------------------------------------------------------------------
LEDGER, AGENCY = "advertise.ad-ledger", "finance.fin_seller_agency_code_mapping"


def _intervals_sql(open_end: str) -> str:
    return f"""
starts AS (SELECT DISTINCT seller_id, agency, CAST(dt AS DATE) AS s FROM finance_fin_seller_agency_code_mapping WHERE type = '1'),
stops AS (SELECT seller_id, agency, CAST(dt AS DATE) AS e FROM finance_fin_seller_agency_code_mapping WHERE type = '0'),
spans AS (
    SELECT a.seller_id, a.agency, a.s, coalesce(min(b.e), DATE '{open_end}') - 1 AS e
    FROM starts a LEFT JOIN stops b ON b.seller_id = a.seller_id AND b.agency = a.agency AND b.e > a.s GROUP BY a.seller_id, a.agency, a.s
)"""


@register(
    "agency_fee",
    oracle(
        [LEDGER, AGENCY],
        _intervals_sql("2999-12-31")
        + f""",
clicks AS (
    SELECT CAST(salesuserid AS INTEGER) AS seller, make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), CAST(day AS INTEGER)) AS d,
           cost_ispaid AS paid, CAST(cost_cpc + cost_vat AS BIGINT) AS spend
    FROM advertise_ad_ledger WHERE ledgertype = 'CLICK' AND budget_paid IS NOT NULL AND cost_ispaid IS NOT NULL
)
SELECT strftime(d, '%Y%m') AS yyyymm, CAST(d AS VARCHAR) AS dt, seller AS sales_user_id, coalesce(agency, 'self') AS agency,
       CAST(s AS VARCHAR) || '~' || CAST(e AS VARCHAR) AS agency_period,
       CAST(sum(CASE WHEN paid THEN spend ELSE 0 END) AS BIGINT) AS paid_incl_vat,
       CAST(sum(CASE WHEN paid THEN 0 ELSE spend END) AS BIGINT) AS free_incl_vat,
       CAST({half_up("sum(CASE WHEN paid AND agency IS NOT NULL THEN spend ELSE 0 END)", "11")} AS BIGINT) AS agency_fee
FROM clicks LEFT JOIN spans ON CAST(seller_id AS INTEGER) = seller AND d BETWEEN s AND e
WHERE d >= DATE '{AD_AS_OF.year - 1}-01-01' GROUP BY ALL
""",
    ),
)
def agency_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.ad_agency_fee(Derived(spark, sf_dir), AD_AS_OF)


@register(
    "mapping_overlaps",
    oracle(
        [AGENCY],
        _intervals_sql("3000-01-01")
        + f""",
days AS (
    SELECT seller_id, agency, unnest(generate_series(greatest(s, DATE '{CALENDAR_FIRST}'), least(e, DATE '{CALENDAR_LAST}'), INTERVAL 1 DAY)) AS d
    FROM spans
),
bad AS (SELECT seller_id, d FROM days GROUP BY ALL HAVING count(agency) > 1)
SELECT agency, seller_id, CAST(s AS VARCHAR) AS start_dt, CAST(e AS VARCHAR) AS end_dt,
       strftime(min(d), '%Y-%m-%d') || '~' || strftime(max(d), '%Y-%m-%d') AS error_period
FROM spans JOIN bad USING (seller_id) GROUP BY agency, seller_id, s, e
""",
    ),
)
def mapping_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.mapping_overlaps(Derived(spark, sf_dir), CALENDAR_FIRST, CALENDAR_LAST)


@register(
    "ad_revenue",
    oracle(
        [LEDGER],
        """
        SELECT year || month AS yyyymm, CAST(CAST(date_trunc('week', CAST(year || '-' || month || '-' || day AS DATE)) AS DATE) AS VARCHAR) AS first_of_week,
               CAST(sum(cost_cpc) AS BIGINT) AS gross_cpc, CAST(coalesce(sum(cost_cpc) FILTER (cost_ispaid), 0) AS BIGINT) AS paid_cpc,
               CAST(coalesce(sum(cost_cpc) FILTER (NOT cost_ispaid), 0) AS BIGINT) AS free_cpc
        FROM advertise_ad_ledger WHERE ledgertype = 'CLICK' AND cost_ispaid IS NOT NULL AND year || '-' || month || '-' || day >= '2022-04-01'
        GROUP BY ALL
        """,
    ),
)
def ad_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.ad_product_revenue(Derived(spark, sf_dir))


@register(
    "ad_ledger_partitions",
    oracle(
        [LEDGER],
        """
        SELECT year, month, day, count(*) AS clicks, CAST(sum(cost_cpc) AS BIGINT) AS cpc FROM advertise_ad_ledger
        WHERE ledgertype = 'CLICK' AND year || month || day >= '20240110' GROUP BY ALL
        """,
    ),
)
def ad_ledger_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions appended to a year/month/day layout are found by the next read, and pruned by date."""
    ledger = Derived(spark, sf_dir)[LEDGER]
    path = scratch_path(spark, "ad-ledger")
    early = F.concat("year", "month", "day") < "20240115"
    salt = F.pmod(F.xxhash64("salesuserid", "clicktimestamp"), F.lit(4))  # a large day may fill several files
    for part in (ledger.filter(early), ledger.filter(~early)):
        spread = part.repartition("year", "month", "day", salt)
        spread.write.mode("append").partitionBy("year", "month", "day").parquet(path)
    found = Catalog(spark, paths={LEDGER: path})[LEDGER]
    clicks = ads.normalise_ad_ledger(found, first_day=dt.date(2024, 1, 10))
    return clicks.groupBy(
        F.date_format("date", "yyyy").alias("year"),
        F.date_format("date", "MM").alias("month"),
        F.date_format("date", "dd").alias("day"),
    ).agg(F.count(F.lit(1)).alias("clicks"), F.sum("cost_cpc").alias("cpc"))


@register(
    "sales_user_contacts",
    oracle(
        ["dump_freq.ad_user_properties_view", "dump.sales_users", "dump.users"],
        """
        SELECT DISTINCT v.sales_user_id, u.id AS user_id, s.company AS salesuser_company, u.nickname AS salesuser_nickname,
               s.license1 || '-' || s.license2 || '-' || s.license3 AS salesuser_biz_number,
               v.ad_manager_name || '(' || v.ad_manager_email || ')' AS ad_manager,
               v.ad_manager_phone1 || '-' || v.ad_manager_phone2 || '-' || v.ad_manager_phone3 AS ad_manager_phone,
               v.settlement_manager_name || '(' || v.settlement_manager_email || ')' AS ad_settle_manager,
               v.settlement_manager_phone1 || '-' || v.settlement_manager_phone2 || '-' || v.settlement_manager_phone3 AS ad_settle_manager_phone
        FROM dump_freq_ad_user_properties_view v LEFT JOIN dump_sales_users s ON s.id = v.sales_user_id
        LEFT JOIN (FROM dump_users WHERE userable_type = 'SalesUser') u ON u.userable_id = v.sales_user_id
        """,
    ),
)
def sales_user_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.sales_user_contacts(Derived(spark, sf_dir))


@register(
    "code_map_roundtrip",
    """
    WITH map AS (
        SELECT 'size' AS col, p_size AS code, min(p_type) AS description FROM part GROUP BY p_size
        UNION ALL SELECT 'line', l_linenumber, min(l_returnflag || l_linestatus) FROM lineitem GROUP BY l_linenumber
        UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
    ),
    used AS (
        SELECT 'size' AS col, p_size AS code FROM part
        UNION ALL SELECT 'line', l_linenumber FROM lineitem
        UNION ALL SELECT 'nation', c_nationkey FROM customer
    )
    SELECT col, code, description, count(*) AS rows_coded FROM used JOIN map USING (col, code) GROUP BY ALL
    """,
)
def code_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code families taken from the tables, written as Snappy parquet, read back and used as labels."""

    def family(table: str, name: str, code: str, text) -> DataFrame:
        rows = base_table(spark, sf_dir, table)
        return rows.groupBy(F.lit(name).alias("col"), F.col(code).alias("code")).agg(F.min(text).alias("description"))

    rows = (
        family("part", "size", "p_size", F.col("p_type"))
        .unionByName(family("lineitem", "line", "l_linenumber", F.concat("l_returnflag", "l_linestatus")))
        .unionByName(family("nation", "nation", "n_nationkey", F.col("n_name")))
    )
    path = scratch_path(spark, "code-map")
    codemap.write_code_map(rows, path)
    stored = spark.read.parquet(path)

    def used(table: str, name: str, code: str) -> DataFrame:
        rows = base_table(spark, sf_dir, table)
        return rows.groupBy(F.lit(name).alias("col"), F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))

    counts = (
        used("part", "size", "p_size")
        .unionByName(used("lineitem", "line", "l_linenumber"))
        .unionByName(used("customer", "nation", "c_nationkey"))
    )
    return counts.join(stored, ["col", "code"]).select("col", "code", "description", F.col("n").alias("rows_coded"))
