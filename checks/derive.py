"""The reports' source tables, derived from the driver's parquet tables.

Each table is one SELECT in the subset of SQL that Spark and DuckDB share, so both sides of
a check start from the same rows; what a report computes from them is written twice, as a
DataFrame job and as oracle SQL. Every derived table covers its whole base table, so its size
follows the scale factor. Dates move 22 years ahead to fall into the reports' date rules.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.sources.calendar import calendar
from ledgerweave.sources.catalog import conform

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
CALENDAR_FIRST, CALENDAR_LAST = dt.date(2016, 1, 1), dt.date(2024, 12, 31)
AS_OF = dt.date(2023, 7, 1)
SERVICE = "SHOP"

OD = "(o_orderdate + INTERVAL '8036' DAY)"
SD = "(l_shipdate + INTERVAL '8036' DAY)"
OPTION = "(l_orderkey * 8 + l_linenumber)"
PRODUCTION = "(l_orderkey * 2 + CASE WHEN l_linenumber <= 3 THEN 0 ELSE 1 END)"


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def iso(x: str) -> str:
    return f"CAST(CAST({x} AS DATE) AS STRING)"


def ym(x: str) -> str:
    return f"CAST(year({x}) * 100 + month({x}) AS STRING)"


def ymd(x: str) -> str:
    return f"CAST(year({x}) * 10000 + month({x}) * 100 + day({x}) AS STRING)"


def two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


EXT = dec("l_extendedprice")
# products of decimals are exact on both engines before they are cut to cents
DISCOUNTED = dec("CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(3,2))")
TAXED = dec("CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(3,2))")
SUPPLY = dec("CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(0.8 AS DECIMAL(2,1))")
SIGNED_TOTAL = dec("CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END")
IN_SHOP = "(o_totalprice < 460000 OR o_totalprice > 480000)"
CATEGORY = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'CONFIRM_ORDER' WHEN '2-HIGH' THEN 'ORDER_CANCEL' "
    "WHEN '3-MEDIUM' THEN 'WELCOME' WHEN '4-NOT SPECIFIED' THEN 'EXPIRE' ELSE 'UNLISTED' END"
)
SNAPSHOT_DAY = "CASE WHEN o_orderstatus = 'P' THEN '2022-11-30' ELSE '2022-12-01' END"

# numbers instead of texts under min and max: Spark then aggregates by hash and not by sort
FLAG = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
LINE = "CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END"
_OPTIONS_SQL = f"""
SELECT {OPTION} AS id,
       {PRODUCTION} AS order_production_id,
       min(l_partkey) AS reference_option_id,
       concat('option ', CASE min({FLAG}) WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END) AS explain,
       CAST(sum(l_quantity) AS BIGINT) AS count,
       CASE WHEN max(l_tax) < 0.005 THEN {dec('0')} ELSE CAST(sum({EXT}) AS DECIMAL(18,2)) END AS selling_cost,
       CAST(CASE WHEN min({FLAG}) = 3 AND max({LINE}) = 0 THEN 9
            WHEN min({FLAG}) = 3 THEN 6
            WHEN min({FLAG}) = 1 AND max({LINE}) = 0 THEN 5
            WHEN min({FLAG}) = 1 THEN 4
            WHEN max({LINE}) = 0 THEN 1
            WHEN max(l_quantity) > 40 THEN 7
            WHEN max(l_quantity) > 30 THEN 2
            WHEN max(l_quantity) > 25 THEN 3 ELSE NULL END AS INT) AS status,
       CASE WHEN max(l_quantity) < 12 THEN NULL ELSE min({SD}) END AS confirm_order_date,
       CASE WHEN max(l_discount) < 0.02 THEN NULL ELSE min({SD}) + INTERVAL '26' HOUR END AS delivery_start_date,
       CASE WHEN max(l_discount) < 0.05 THEN NULL ELSE max({SD}) + INTERVAL '75' HOUR END AS delivery_complete_date,
       CASE WHEN max(l_tax) < 0.04 THEN NULL ELSE max({SD}) + INTERVAL '200' HOUR END AS purchase_confirm_date,
       CASE WHEN max(l_tax) < 0.06 THEN NULL ELSE max({SD}) + INTERVAL '400' HOUR END AS calculate_date,
       max(l_tax) >= 0.06 AS is_calculated
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber
"""
_PRODUCTIONS_SQL = f"""
SELECT {PRODUCTION} AS id, min(l_orderkey) AS order_id, min(l_suppkey) AS seller_id, min(l_partkey) AS production_id,
       concat('product ', {text('min(l_partkey)')}) AS name, min(l_linenumber) AS delivery_method
FROM {{lineitem}} GROUP BY {PRODUCTION}
"""
_LEGACY_SALE_SQL = f"""
       l_partkey AS product_id, {EXT} AS selling_cost, {SUPPLY} AS supply_cost, l_linenumber AS delivery_pay_at,
       {dec('l_quantity * 100')} AS delivery_fee, CASE WHEN l_linenumber = 2 THEN NULL ELSE {dec('l_quantity * 7')} END AS assemble_fee,
       l_linestatus = 'O' AS is_backwoods, CASE WHEN l_tax < 0.02 THEN NULL ELSE {dec('l_quantity * 3')} END AS delivery_backwoods,
       CAST(l_quantity AS BIGINT) AS quantity, {PRODUCTION} AS order_product_id,
"""

TABLES: dict[str, str] = {
    "dump.orders": f"""
SELECT o_orderkey AS id,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN NULL ELSE {OD} + INTERVAL '13' HOUR END AS payment_at,
       {OD} AS created_at,
       concat('imp_', {text('o_orderkey')}) AS imp_uid, concat('m_', {text('o_custkey')}) AS merchant_uid,
       o_totalprice > 20000 AS is_payment_success,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'without_bankbook' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'card' END AS payment_method,
       o_orderstatus <> 'F' AS is_success_vbank
FROM {{orders}}
""",
    "dump.order_options": _OPTIONS_SQL,
    "dump.order_productions": _PRODUCTIONS_SQL,
    "dump_stage.order_options": _OPTIONS_SQL,
    "dump_stage.order_productions": _PRODUCTIONS_SQL,
    "dump.order_option_cancels": f"""
SELECT l_partkey * 1000000 + l_suppkey AS id, {OPTION} AS order_option_id,
       CAST(CASE WHEN l_quantity < 15 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS INT) AS status,
       {SD} + INTERVAL '120' HOUR AS updated_at
FROM {{lineitem}} WHERE l_returnflag = 'R'
""",
    "dump.order_option_exchanges": f"""
SELECT l_partkey * 1000000 + l_suppkey AS id, {OPTION} AS order_option_id,
       CAST(CASE WHEN l_discount < 0.05 THEN 0 WHEN l_discount < 0.08 THEN 1 ELSE 2 END AS INT) AS status,
       {SD} + INTERVAL '90' HOUR AS updated_at
FROM {{lineitem}} WHERE l_returnflag = 'N'
""",
    "dump.productions": """
SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS user_id, p_size < 10 AS need_customer_number, p_type AS admin_category_id
FROM {part}
""",
    "dump.users": """
SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'SalesUser' ELSE 'NormalUser' END AS userable_type,
       c_custkey AS userable_id, c_name AS nickname
FROM {customer} WHERE c_nationkey <> 3
""",
    "dump.sales_users": f"""
SELECT s_suppkey AS id, s_name AS company, {text('s_nationkey')} AS license1,
       CASE WHEN s_acctbal < 1000 THEN NULL ELSE '22' END AS license2, {text('s_suppkey')} AS license3
FROM {{supplier}}
""",
    "dump.admin_categories": """
SELECT DISTINCT p_type AS id, CASE p_type WHEN 'ECONOMY' THEN '렌탈 > 가전' ELSE concat('가구 > ', p_type) END AS full_display_name
FROM {part}
""",
    "dump.production_properties": """
SELECT p_partkey + 100 AS id, p_partkey AS production_id, CAST(0 AS INT) AS property_number FROM {part} WHERE p_size > 35
UNION ALL
SELECT p_partkey + 200 AS id, p_partkey AS production_id, CAST(0 AS INT) AS property_number FROM {part} WHERE p_size > 47
UNION ALL
SELECT p_partkey + 300 AS id, p_partkey AS production_id, CAST(1 AS INT) AS property_number FROM {part}
""",
    "temp.fin_non_3p_seller_current": f"""
SELECT {text('s_suppkey')} AS seller_id,
       CASE r_name WHEN 'ASIA' THEN '1P' WHEN 'AMERICA' THEN 'PREMIUM' WHEN 'EUROPE' THEN 'FOREIGN' ELSE 'BOOK' END AS biz,
       s_name AS company_name
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
WHERE r_name <> 'MIDDLE EAST'
""",
    "ba.pbc_products": """
SELECT p_partkey AS production_id,
       CASE p_type WHEN 'ECONOMY' THEN 'PB' WHEN 'STANDARD' THEN 'RB' WHEN 'LARGE' THEN '사입' WHEN 'PROMO' THEN 'ETC' ELSE NULL END AS type
FROM {part} WHERE p_type <> 'MEDIUM'
""",
    "finance.fin_admin_categories_md": """
SELECT DISTINCT p_type AS admin_category_id, concat('D-', p_type) AS name_depth1 FROM {part} WHERE p_type <> 'PROMO'
""",
    "finance.monthly_sku_orderprice": f"""
SELECT {ym(SD)} AS yyyymm, {text('l_partkey')} AS skucode,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE {iso(SD)} END AS load_dt
FROM {{lineitem}}
""",
    # --- settlement -------------------------------------------------------------------
    "finance.fin_coupon_order_options_settlement": f"""
SELECT {SD} + INTERVAL '10' HOUR AS base_dttm,
       CASE WHEN l_tax > 0.075 THEN 'manual_correction' ELSE 'daily' END AS batch_job,
       CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS kind,
       {text('l_orderkey')} AS order_id, {text(OPTION)} AS order_option_id, {DISCOUNTED} AS coupon_cost
FROM {{lineitem}}
""",
    "finance.fin_coupon_cart_order_options_settlement": f"""
SELECT {SD} + INTERVAL '250' HOUR AS base_dttm,
       CASE WHEN l_tax > 0.075 THEN 'manual_correction' ELSE 'daily' END AS batch_job,
       CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS kind,
       {text('l_orderkey')} AS order_id, {text(OPTION)} AS order_option_id, {TAXED} AS coupon_cost
FROM {{lineitem}}
""",
    "finance.fin_mileage_order_options_settlement": f"""
SELECT {SD} + INTERVAL '60' HOUR AS base_dttm,
       CASE WHEN l_tax > 0.075 THEN 'manual_correction' ELSE 'daily' END AS batch_job,
       CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS kind,
       {text('l_orderkey')} AS order_id, {text(OPTION)} AS order_option_id,
       {dec("CASE WHEN l_returnflag = 'R' THEN -l_quantity WHEN l_linestatus = 'O' THEN 0 ELSE l_quantity END")} AS mileage_cost
FROM {{lineitem}}
""",
    "dump_payment_stage.payment_transactions": f"""
SELECT o_orderkey AS payment_id, o_orderkey * 10 AS transaction_id, {OD} + INTERVAL '10' HOUR AS transaction_at,
       'PAYMENT' AS transaction_type, o_orderkey AS order_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'OTHER' ELSE '{SERVICE}' END AS service_id
FROM {{orders}}
UNION ALL
SELECT o_orderkey AS payment_id, o_orderkey * 10 + 1 AS transaction_id, {OD} + INTERVAL '82' HOUR AS transaction_at,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'PART' ELSE 'CANCEL' END AS transaction_type, o_orderkey AS order_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'OTHER' ELSE '{SERVICE}' END AS service_id
FROM {{orders}} WHERE o_orderstatus = 'F'
""",
    "dump_payment_stage.payment_transaction_items": f"""
SELECT DISTINCT l_orderkey AS payment_id, l_orderkey * 10 AS transaction_id, {OPTION} AS payment_item_id FROM {{lineitem}}
UNION ALL
SELECT DISTINCT l_orderkey AS payment_id, l_orderkey * 10 + 1 AS transaction_id, {OPTION} AS payment_item_id
FROM {{lineitem}} WHERE l_returnflag = 'R'
""",
    "dump_payment_stage.payment_items": f"""
SELECT DISTINCT {OPTION} AS payment_item_id,
       CASE WHEN l_linenumber = 7 THEN 'DELIVERY' ELSE {text(OPTION)} END AS item_reference_id,
       {text('l_linenumber')} AS selling_company_id
FROM {{lineitem}}
""",
    "dump_payment_stage.payment_transaction_item_amounts": f"""
SELECT {OPTION} AS payment_item_id, l_orderkey * 10 AS transaction_id,
       CASE WHEN l_discount > 0.04 THEN 'PRODUCT_COUPON' ELSE 'CARD' END AS payment_method_type, {EXT} AS amount
FROM {{lineitem}}
UNION ALL
SELECT {OPTION} AS payment_item_id, l_orderkey * 10 + 1 AS transaction_id,
       CASE WHEN l_discount > 0.04 THEN 'PRODUCT_COUPON' ELSE 'CARD' END AS payment_method_type, -{EXT} AS amount
FROM {{lineitem}} WHERE l_returnflag = 'R'
""",
    "dump_settlement_stage.order_sales_l": f"""
SELECT {OPTION} AS id, CASE WHEN l_linestatus = 'O' THEN '2023-03-02' ELSE '2023-03-01' END AS base_dt,
       {SD} + INTERVAL '240' HOUR AS settlement_at, {SD} + INTERVAL '9' HOUR AS recognized_at,
       CASE WHEN l_returnflag = 'R' THEN 'PURCHASE_CANCELED' ELSE 'PURCHASE_CONFIRMED' END AS recognized_type,
       l_orderkey AS order_id, {OPTION} AS order_option_id, concat('product ', {text('l_partkey')}) AS product_name,
       concat('option ', l_returnflag) AS option_name, CAST(l_quantity AS BIGINT) AS quantity,
       l_partkey AS product_id, l_partkey AS option_id, l_suppkey AS seller_id
FROM {{lineitem}}
""",
    "dump_settlement_stage.discount_price_detail_l": f"""
SELECT CASE WHEN l_linestatus = 'O' THEN '2023-03-02' ELSE '2023-03-01' END AS base_dt, {OPTION} AS order_sales_id,
       CASE WHEN l_discount > 0.04 THEN 'PRODUCT_COUPON' ELSE 'CARD' END AS discount_type, {DISCOUNTED} AS amount
FROM {{lineitem}}
""",
    # --- points -----------------------------------------------------------------------
    "dump_point.points": f"""
SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_totalprice < 100000 THEN 'm' ELSE 'v1' END AS version,
       CASE o_orderstatus WHEN 'F' THEN 'ACCUM' WHEN 'O' THEN 'WITHDRAW' ELSE 'USE' END AS process_type,
       {SIGNED_TOTAL} AS amount,
       CASE WHEN o_totalprice > 490000 THEN 'VOUCHER' ELSE 'POINT' END AS point_type,
       CASE WHEN {IN_SHOP} THEN '{SERVICE}' ELSE 'OTHER' END AS service_id,
       {CATEGORY} AS category_type, {OD} + INTERVAL '11' HOUR AS created_at, {text('o_orderkey * 8 + 1')} AS request_id,
       CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE CAST({OD} AS DATE) + CAST(day(o_orderdate) + 14 AS INT) END AS use_end_date,
       o_orderkey + 500 AS payload
FROM {{orders}}
""",
    "dump_point.point_details": f"""
SELECT {OPTION} AS id, l_orderkey AS point_id,
       CASE min({FLAG}) WHEN 1 THEN {OPTION} WHEN 2 THEN min(l_partkey) * 8 + l_linenumber ELSE NULL END AS detail_first_accum_id,
       CASE WHEN max(l_quantity) > 40 THEN NULL ELSE CAST(max({SD}) AS DATE) + CAST(max(l_quantity) AS INT) END AS use_end_date,
       CAST(sum({EXT}) AS DECIMAL(18,2)) AS amount
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber
""",
    "dump_point.user_points": f"""
SELECT o_custkey AS user_id,
       CAST(sum({SIGNED_TOTAL}) + CASE WHEN max(o_totalprice) > 455000 THEN 10 ELSE 0 END AS DECIMAL(18,2)) AS balance,
       '{SERVICE}' AS service_id
FROM {{orders}} WHERE {IN_SHOP} GROUP BY o_custkey
""",
    "finance.fin_mileage_histories_d": f"""
SELECT {text('o_custkey')} AS user_id, o_orderkey + 500 AS mileage_id, CAST(l_quantity AS BIGINT) AS mileage,
       {text('first_key + 500')} AS reference_mileage_id
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
JOIN (SELECT o_custkey AS first_user, min(o_orderkey) AS first_key FROM {{orders}} GROUP BY o_custkey) f ON first_user = o_custkey
WHERE l_returnflag = 'N'
""",
    "finance.mileage_point_type_mapping": f"""
SELECT category_type, concat('A-', category_type) AS acct_type,
       CASE category_type WHEN 'CONFIRM_ORDER' THEN 'REWARD' WHEN 'ORDER_CANCEL' THEN 'CLAIM' ELSE 'OTHER' END AS dept
FROM (SELECT DISTINCT {CATEGORY} AS category_type FROM {{orders}}) c WHERE category_type <> 'UNLISTED'
""",
    "dump.order_options_l": f"""
SELECT o_orderkey * 8 + 1 AS id, o_orderkey * 2 AS order_production_id, {SNAPSHOT_DAY} AS base_dt FROM {{orders}}
""",
    "dump.order_productions_l": f"SELECT o_orderkey * 2 AS id, o_custkey AS seller_id, {SNAPSHOT_DAY} AS base_dt FROM {{orders}}",
    # --- commerce P&L -------------------------------------------------------------------
    "quicksight.payment": f"""
SELECT {iso(SD)} AS order_at, {_LEGACY_SALE_SQL}
       CASE WHEN l_returnflag = 'N' THEN '2019-08-31' ELSE '2019-09-01' END AS date
FROM {{lineitem}}
""",
    "quicksight.refund": f"""
SELECT {iso(SD)} AS cancel_at, {_LEGACY_SALE_SQL} '2019-09-01' AS date
FROM {{lineitem}} WHERE l_returnflag = 'R'
""",
    "ba_preserved.commerce_snapshot_payment_result": f"""
SELECT {iso(SD)} AS date, l_partkey AS product_id, l_suppkey AS seller_id, l_orderkey AS order_id,
       {OPTION} AS order_option_id, l_partkey AS reference_option_id, {SD} - INTERVAL '30' HOUR AS order_at,
       CAST(l_quantity AS BIGINT) AS quantity, {EXT} AS selling_cost, {SUPPLY} AS supply_cost,
       {dec('l_quantity * 100')} AS delivery, {dec('l_quantity * 7')} AS assemble,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE {dec('l_quantity * 3')} END AS backwoods
FROM {{lineitem}}
""",
    "finance.fin_option_daily_orderprice": f"""
SELECT {text('l_partkey')} AS option_id, {ymd(f"({SD} - INTERVAL '30' HOUR)")} AS yyyymmdd,
       CAST(CASE WHEN max(l_linenumber) = 7 THEN 1 ELSE 0 END AS BIGINT) AS noprice_sku_count,
       CASE WHEN min(l_linenumber) = 3 THEN NULL WHEN min(l_linenumber) = 4 THEN {dec('0')} ELSE {dec('min(l_quantity) * 10')} END AS mgmt_applied_orderprice
FROM {{lineitem}} WHERE l_linestatus = 'F' GROUP BY l_partkey, l_shipdate
UNION ALL
SELECT {text('p_partkey')} AS option_id, '20220101' AS yyyymmdd, CAST(0 AS BIGINT) AS noprice_sku_count,
       {dec('p_retailprice')} AS mgmt_applied_orderprice
FROM {{part}} WHERE p_size < 25
""",
    "finance.fin_transport_fee_calculate_options_monthly": f"""
SELECT {text('l_partkey')} AS option_id, {ym(SD)} AS yyyymm, {dec('max(l_tax) * 1000')} AS calculated_transport_fee,
       {dec('min(l_tax) * 1000')} AS basic_transport_fee
FROM {{lineitem}} WHERE l_returnflag <> 'A' GROUP BY l_partkey, {ym(SD)}
""",
    "finance.fin_coupon_cart_order_options": f"""
SELECT {iso(SD)} AS base_dt, {text('l_partkey')} AS production_id, {text('l_suppkey')} AS seller_id,
       {text('l_linenumber')} AS coupon_mold_id, {DISCOUNTED} AS coupon_cost
FROM {{lineitem}} WHERE l_returnflag <> 'A'
""",
    "finance.fin_coupon_product_order_options": f"""
SELECT {iso(SD)} AS base_dt, {text('l_partkey')} AS production_id, {text('l_suppkey')} AS seller_id,
       {text('l_linenumber * 10')} AS coupon_mold_id, {DISCOUNTED} AS coupon_cost
FROM {{lineitem}} WHERE l_returnflag = 'A'
""",
    "dump.coupon_molds": """
SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS id,
       CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN NULL ELSE l_linenumber END AS department
FROM {lineitem} WHERE l_linenumber <> 7
""",
    "dump_coupon.coupon_molds": """
SELECT DISTINCT CAST(l_linenumber * 10 AS BIGINT) AS coupon_mold_id,
       CASE l_linenumber WHEN 1 THEN 'COMMERCE' WHEN 2 THEN 'CONTENTS' WHEN 3 THEN 'MARKETING' ELSE 'PARTNER' END AS service_id,
       CASE l_linenumber WHEN 5 THEN 'CART' ELSE 'PRODUCT' END AS coupon_type
FROM {lineitem}
""",
    "finance.fin_coupon_order_option_distributions": f"""
SELECT {iso(SD)} AS base_dt, {text('l_partkey')} AS production_id, {text('l_suppkey')} AS seller_id,
       {text('l_linenumber')} AS coupon_mold_id,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linenumber - 1 END AS department,
       {DISCOUNTED} AS coupon_cost_seller_distributed_deduction, {TAXED} AS coupon_cost_seller_distributed_deposit
FROM {{lineitem}}
""",
    "finance.fin_coupon_conditions_md": f"""
SELECT DISTINCT {text('l_linenumber')} AS id, CASE WHEN l_linenumber = 2 THEN '1' ELSE '0' END AS post_settlement
FROM {{lineitem}} WHERE l_linenumber <= 4
""",
    "finance.fin_coupon_conditions_md_old": f"""
SELECT DISTINCT {text('l_linenumber')} AS id, '0' AS post_settlement FROM {{lineitem}} WHERE l_linenumber BETWEEN 3 AND 6
""",
    "finance.fin_card_promotion_order_history_distributions": f"""
SELECT {iso(SD)} AS base_dt, {text('l_partkey')} AS production_id, {text(PRODUCTION)} AS order_production_id,
       {TAXED} AS promotion_cost, {dec('l_quantity * 2')} AS promotion_cost_platform_dist, {dec('l_quantity')} AS promotion_cost_partner_dist
FROM {{lineitem}} WHERE l_linestatus = 'O'
""",
    "finance.fin_discount_order_option_distributions_d": f"""
SELECT {iso(SD)} AS base_dt, {text('l_partkey')} AS production_id, {text(PRODUCTION)} AS order_production_id,
       {dec('l_quantity * 11')} AS seller_distribution
FROM {{lineitem}} WHERE l_linestatus = 'F'
""",
    # --- monthly reports ------------------------------------------------------------------
    "finance.fin_vendor_funding_md": f"""
SELECT {ym(SD)} AS yyyymm, l_linestatus AS logisticstype, p_type AS cate_name,
       {text(f'CAST(sum({EXT}) AS DECIMAL(18,2))')} AS funding_value
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY {ym(SD)}, l_linestatus, p_type, l_returnflag
""",
    "ba_preserved.mkt_cost_d": f"""
SELECT concat(substring({iso(OD)}, 1, 7), '-01') AS base_m, {iso(OD)} AS base_dt, {dec('o_totalprice')} AS cost FROM {{orders}}
""",
    "ba_preserved.mkt_cost_m": f"""
SELECT concat(substring({iso(OD)}, 1, 7), '-01') AS base_m, {iso(OD)} AS base_dt, {dec('o_totalprice + 1')} AS cost
FROM {{orders}} WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
""",
    "temp.fin_mkt_freecash": f"""
SELECT concat({ym(OD)}, '01') AS yyyymmdd, {text('CAST(floor(max(o_totalprice)) AS INT)')} AS value
FROM {{orders}} GROUP BY {ym(OD)}, o_orderstatus = 'F'
""",
    "ba_preserved.mkt_arppu_summary": f"""
SELECT o_custkey AS user_id, concat(substring({iso(OD)}, 1, 7), '-01') AS month, {dec('o_totalprice')} AS paid, {dec('0')} AS cancel,
       CASE WHEN o_orderstatus = 'P' THEN {dec('-o_totalprice')} ELSE {dec('0')} END AS cancel2
FROM {{orders}}
UNION ALL
SELECT o_custkey AS user_id, concat(substring({iso(f"({OD} + INTERVAL '31' DAY)")}, 1, 7), '-01') AS month, {dec('0')} AS paid,
       {dec('-o_totalprice')} AS cancel, {dec('0')} AS cancel2
FROM {{orders}} WHERE o_orderstatus = 'P'
""",
    "dump_payment_o2o.sales": f"""
SELECT o_orderkey AS id, {OD} + INTERVAL '5' HOUR AS basis_date_time,
       CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 1 END AS sales_status,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE {dec('o_totalprice')} END AS paid_cash_amount,
       CASE WHEN o_orderpriority = '1-URGENT' THEN {dec('o_totalprice + 3')} ELSE NULL END AS free_cash_amount,
       CASE WHEN o_totalprice < 30000 THEN 1 ELSE 0 END AS is_deleted
FROM {{orders}}
""",
    "dump.expertises": f"""
SELECT {text('c_custkey')} AS expert_user_id, CAST(5 AS INT) AS expertise FROM {{customer}} WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT {text('c_custkey')} AS expert_user_id, CAST(26 AS INT) AS expertise FROM {{customer}} WHERE c_acctbal > 5000
""",
    # --- advertising ----------------------------------------------------------------------
    "finance.fin_seller_agency_code_mapping": f"""
SELECT {text('user_id')} AS seller_id, CASE WHEN value < 10 THEN 'north' ELSE 'south' END AS agency, {iso('ts')} AS dt,
       CASE WHEN event_type = 'signup' THEN '1' ELSE '0' END AS type
FROM {{events}} WHERE event_type IN ('signup', 'error')
""",
    "dump_freq.ad_user_properties_view": f"""
SELECT c_custkey AS sales_user_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS ad_manager_name,
       concat(c_mktsegment, '@example.com') AS ad_manager_email, '02' AS ad_manager_phone1,
       {text('c_nationkey')} AS ad_manager_phone2, {text('c_custkey')} AS ad_manager_phone3,
       c_name AS settlement_manager_name, concat(o_orderstatus, '@example.com') AS settlement_manager_email,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '031' END AS settlement_manager_phone1,
       {text('c_nationkey')} AS settlement_manager_phone2, {text('c_custkey')} AS settlement_manager_phone3
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
""",
}

# Document-shaped tables: flat here, nested for the jobs by ``nested_columns``.
FLAT: dict[str, str] = {
    "advertise.ad-ledger": f"""
SELECT CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'CLICK' ELSE 'CHARGE' END AS ledgertype,
       {text('user_id')} AS salesuserid, <<epoch_ms:ts>> AS clicktimestamp, <<epoch_ms:ts>> + 1000 AS ledgertimestamp,
       CAST(year(ts) AS STRING) AS year, {two('month(ts)')} AS month, {two('day(ts)')} AS day,
       CASE WHEN value < 0.3 THEN NULL ELSE {dec('floor(value * 10)')} END AS budget_paid,
       {dec('floor(value * 20)')} AS budget_free, {dec('floor(value * 30)')} AS prev_paid, {dec('floor(value * 40)')} AS prev_free,
       {dec('floor(value * 100)')} AS cost_cpc, {dec('floor(value * 10)')} AS cost_vat,
       CASE WHEN value < 0.6 THEN NULL ELSE event_type <> 'view' END AS cost_ispaid,
       event_id AS campaignid, {dec('floor(value * 100)')} AS request_cpc
FROM {{events}}
""",
    "dump_mongo_expert.remodelingstep": f"""
SELECT {text('o_orderkey')} AS oid, {text('o_custkey')} AS expert,
       CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 9999999 ELSE 7 END AS INT) AS scale,
       CASE WHEN o_orderstatus = 'O' AND o_totalprice < 100000 THEN NULL ELSE concat({iso(OD)}, 'T16:30:00.000Z') END AS inspecteddate,
       concat({iso(OD)}, 'T03:10:00.000Z') AS createdat,
       CASE WHEN o_orderstatus = 'P' AND o_totalprice > 60000 THEN concat({iso(f"({OD} + INTERVAL '40' DAY)")}, 'T03:00:00.000Z') ELSE NULL END AS modifieddate,
       o_orderkey AS legacyconsultationid,
       CASE WHEN o_totalprice > 450000 THEN NULL ELSE {dec('o_totalprice')} END AS downpayment,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority < '3' THEN {dec('-o_totalprice')} WHEN o_orderstatus = 'P' THEN {dec('1000')} ELSE NULL END AS modifieddownpayment,
       {text('o_custkey')} AS userid,
       CASE WHEN o_totalprice < 30000 THEN 'Beta TESTER' WHEN o_totalprice < 40000 THEN '테스트 계정' WHEN o_totalprice < 45000 THEN NULL
            WHEN o_totalprice < 50000 THEN '시공효_iOS기' ELSE concat('user ', {text('o_custkey')}) END AS username,
       '010' AS phonenumber, CAST(month(o_orderdate) - 1 AS INT) AS inflowchannel,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 11 END AS INT) AS status
FROM {{orders}}
""",
}


def _fields(**cols: str | Column) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def nested_columns(name: str) -> Mapping[str, Column | str]:
    """The declared struct columns of a document-shaped table over its flat columns."""
    shapes: dict[str, Mapping[str, Column | str]] = {
        "advertise.ad-ledger": {
            **{c: c for c in ("ledgertype", "salesuserid", "clicktimestamp", "ledgertimestamp", "year", "month", "day")},
            "budget": F.when(F.col("budget_paid").isNotNull(), _fields(paid="budget_paid", free="budget_free")),
            "prevbudget": _fields(paid="prev_paid", free="prev_free"),
            "cost": _fields(cpc="cost_cpc", vat="cost_vat", ispaid="cost_ispaid"),
            "request": _fields(member1=_fields(campaignid="campaignid", cpc="request_cpc")),
        },
        "dump_mongo_expert.remodelingstep": {
            "_id": _fields(oid="oid"),
            "expertuser": _fields(_id="expert"),
            "expertise": _fields(scale="scale"),
            "contract": _fields(
                inspecteddate="inspecteddate",
                modifieddownpaymentupdateddate="modifieddate",
                downpayment="downpayment",
                modifieddownpayment="modifieddownpayment",
            ),
            "user": _fields(_id="userid", name="username", phonenumber="phonenumber"),
            **{c: c for c in ("createdat", "legacyconsultationid", "inflowchannel", "status")},
        },
    }
    return shapes[name]


CALENDAR = "ba_preserved.calendar"
_EPOCH = {
    "spark": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})",
    "duckdb": "(epoch_us({}) // 1000)",
}


def _dialect(sql: str, engine: str) -> str:
    return re.sub(r"<<epoch_ms:(\w+)>>", lambda m: _EPOCH[engine].format(m.group(1)), sql)


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Derived(Mapping[str, DataFrame]):
    """Source tables by name over one scale-factor folder, derived when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._open: dict[str, DataFrame] = {}
        self._base: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = conform(self._derive(name), name)
        return self._open[name]

    def _derive(self, name: str) -> DataFrame:
        if name == CALENDAR:
            return calendar(self.spark, CALENDAR_FIRST, CALENDAR_LAST)
        sql = _dialect(TABLES.get(name) or FLAT[name], "spark")
        args = {t: self._base_table(t) for t in BASE if "{" + t + "}" in sql}
        flat = self.spark.sql(sql, **args)
        if name not in FLAT:
            return flat
        return flat.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in nested_columns(name).items()])

    def _base_table(self, name: str) -> DataFrame:
        """Each file is opened once: a read looks up its schema in a job of its own."""
        if name not in self._base:
            self._base[name] = base_table(self.spark, self.sf_dir, name)
        return self._base[name]

    def __iter__(self):
        return iter([*TABLES, *FLAT, CALENDAR])

    def __len__(self) -> int:
        return len(TABLES) + len(FLAT) + 1


def ident(name: str) -> str:
    return re.sub(r"\W", "_", name)


def oracle(tables: Iterable[str], body: str) -> str:
    """DuckDB statement: the named derived tables as CTEs, then ``body``.

    ``body`` starts with further CTEs (``name AS (...), ...``) after a leading comma-less
    list, or with SELECT; tables are referred to as ``schema_table``.
    """
    ctes = []
    for name in tables:
        if name == CALENDAR:
            sql = f"""
SELECT CAST(d AS DATE) AS date, CAST(date_trunc('week', d) AS DATE) AS first_of_week,
       CAST(date_trunc('month', d) AS DATE) AS first_of_month, strftime(d, '%Y%m') AS year_month
FROM generate_series(DATE '{CALENDAR_FIRST}', DATE '{CALENDAR_LAST}', INTERVAL 1 DAY) t(d)
"""
        else:
            sql = _dialect(TABLES.get(name) or FLAT[name], "duckdb")
            for t in BASE:
                sql = sql.replace("{" + t + "}", t)
        ctes.append(f"{ident(name)} AS ({sql})")
    lead = "WITH " + ",\n".join(ctes)
    body = body.strip()
    return f"{lead}\n{body}" if body.upper().startswith("SELECT") else f"{lead},\n{body}"
