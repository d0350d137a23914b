"""Declared schemas of the source tables, as DDL text by ``schema.table`` name.

Money is ``decimal(18,2)`` so that sums do not depend on row order; ids are ``bigint``
where they are joined as numbers and ``string`` where the tables keep them as text.
"""

from __future__ import annotations

M = "decimal(18,2)"

_OPTIONS = (
    "id bigint, order_production_id bigint, reference_option_id bigint, explain string, count bigint, "
    f"selling_cost {M}, status int, confirm_order_date timestamp_ntz, delivery_start_date timestamp_ntz, "
    "delivery_complete_date timestamp_ntz, purchase_confirm_date timestamp_ntz, calculate_date timestamp_ntz, "
    "is_calculated boolean"
)
_STAGE_OPTIONS = (
    "id bigint, order_production_id bigint, reference_option_id bigint, explain string, status int, "
    "delivery_complete_date timestamp_ntz, purchase_confirm_date timestamp_ntz"
)
_COUPON_SETTLEMENT = (
    f"base_dttm timestamp_ntz, batch_job string, kind int, order_id string, order_option_id string, coupon_cost {M}"
)
_COUPON = f"base_dt string, production_id string, seller_id string, coupon_mold_id string, coupon_cost {M}"
_LEGACY_SALE = (
    f"product_id bigint, selling_cost {M}, supply_cost {M}, delivery_pay_at int, delivery_fee {M}, assemble_fee {M}, "
    f"is_backwoods boolean, delivery_backwoods {M}, quantity bigint, order_product_id bigint, date string"
)

SCHEMAS: dict[str, str] = {
    "advertise.ad-ledger": (
        "ledgertype string, salesuserid string, clicktimestamp bigint, ledgertimestamp bigint, "
        "year string, month string, day string, "
        f"budget struct<paid:{M},free:{M}>, prevbudget struct<paid:{M},free:{M}>, "
        f"cost struct<cpc:{M},vat:{M},ispaid:boolean>, request struct<member1:struct<campaignid:bigint,cpc:{M}>>"
    ),
    "ba.pbc_products": "production_id bigint, type string",
    "ba_preserved.calendar": "date date, first_of_week date, first_of_month date, year_month string",
    "ba_preserved.commerce_snapshot_payment_result": (
        f"date string, product_id bigint, seller_id bigint, order_id bigint, order_option_id bigint, "
        f"reference_option_id bigint, order_at timestamp_ntz, quantity bigint, selling_cost {M}, supply_cost {M}, "
        f"delivery {M}, assemble {M}, backwoods {M}"
    ),
    "ba_preserved.mkt_arppu_summary": f"user_id bigint, month string, paid {M}, cancel {M}, cancel2 {M}",
    "ba_preserved.mkt_cost_d": f"base_m string, base_dt string, cost {M}",
    "ba_preserved.mkt_cost_m": f"base_m string, base_dt string, cost {M}",
    "dump.admin_categories": "id string, full_display_name string",
    "dump.coupon_molds": "id bigint, department int",
    "dump.expertises": "expert_user_id string, expertise int",
    "dump.order_option_cancels": "id bigint, order_option_id bigint, status int, updated_at timestamp_ntz",
    "dump.order_option_exchanges": "id bigint, order_option_id bigint, status int, updated_at timestamp_ntz",
    "dump.order_options": _OPTIONS,
    "dump.order_options_l": "id bigint, order_production_id bigint, base_dt string",
    "dump.order_productions": (
        "id bigint, order_id bigint, seller_id bigint, production_id bigint, name string, delivery_method int"
    ),
    "dump.order_productions_l": "id bigint, seller_id bigint, base_dt string",
    "dump.orders": (
        "id bigint, payment_at timestamp_ntz, created_at timestamp_ntz, imp_uid string, merchant_uid string, "
        "is_payment_success boolean, payment_method string, is_success_vbank boolean"
    ),
    "dump.production_properties": "id bigint, production_id bigint, property_number int",
    "dump.productions": "id bigint, user_id bigint, need_customer_number boolean, admin_category_id string",
    "dump.sales_users": "id bigint, company string, license1 string, license2 string, license3 string",
    "dump.users": "id bigint, userable_type string, userable_id bigint, nickname string",
    "dump_coupon.coupon_molds": "coupon_mold_id bigint, service_id string, coupon_type string",
    "dump_freq.ad_user_properties_view": (
        "sales_user_id bigint, ad_manager_name string, ad_manager_email string, ad_manager_phone1 string, "
        "ad_manager_phone2 string, ad_manager_phone3 string, settlement_manager_name string, "
        "settlement_manager_email string, settlement_manager_phone1 string, settlement_manager_phone2 string, "
        "settlement_manager_phone3 string"
    ),
    "dump_mongo_expert.remodelingstep": (
        "_id struct<oid:string>, expertuser struct<_id:string>, expertise struct<scale:int>, "
        f"contract struct<inspecteddate:string,modifieddownpaymentupdateddate:string,downpayment:{M},"
        f"modifieddownpayment:{M}>, createdat string, legacyconsultationid bigint, "
        "user struct<_id:string,name:string,phonenumber:string>, inflowchannel int, status int"
    ),
    "dump_payment_o2o.sales": (
        f"id bigint, basis_date_time timestamp_ntz, sales_status int, paid_cash_amount {M}, free_cash_amount {M}, "
        "is_deleted int"
    ),
    "dump_payment_stage.payment_items": "payment_item_id bigint, item_reference_id string, selling_company_id string",
    "dump_payment_stage.payment_transaction_item_amounts": (
        f"payment_item_id bigint, transaction_id bigint, payment_method_type string, amount {M}"
    ),
    "dump_payment_stage.payment_transaction_items": "payment_id bigint, transaction_id bigint, payment_item_id bigint",
    "dump_payment_stage.payment_transactions": (
        "payment_id bigint, transaction_id bigint, transaction_at timestamp_ntz, transaction_type string, "
        "order_id bigint, service_id string"
    ),
    "dump_point.point_details": (
        f"id bigint, point_id bigint, detail_first_accum_id bigint, use_end_date date, amount {M}"
    ),
    "dump_point.points": (
        f"id bigint, user_id bigint, version string, process_type string, amount {M}, point_type string, "
        "service_id string, category_type string, created_at timestamp_ntz, request_id string, use_end_date date, "
        "payload bigint"
    ),
    "dump_point.user_points": f"user_id bigint, balance {M}, service_id string",
    "dump_settlement_stage.discount_price_detail_l": (
        f"base_dt string, order_sales_id bigint, discount_type string, amount {M}"
    ),
    "dump_settlement_stage.order_sales_l": (
        "id bigint, base_dt string, settlement_at timestamp_ntz, recognized_at timestamp_ntz, recognized_type string, "
        "order_id bigint, order_option_id bigint, product_name string, option_name string, quantity bigint, "
        "product_id bigint, option_id bigint, seller_id bigint"
    ),
    "dump_stage.order_options": _STAGE_OPTIONS,
    "dump_stage.order_productions": "id bigint, seller_id bigint, name string",
    "finance.fin_admin_categories_md": "admin_category_id string, name_depth1 string",
    "finance.fin_card_promotion_order_history_distributions": (
        f"base_dt string, production_id string, order_production_id string, promotion_cost {M}, "
        f"promotion_cost_platform_dist {M}, promotion_cost_partner_dist {M}"
    ),
    "finance.fin_coupon_cart_order_options": _COUPON,
    "finance.fin_coupon_cart_order_options_settlement": _COUPON_SETTLEMENT,
    "finance.fin_coupon_conditions_md": "id string, post_settlement string",
    "finance.fin_coupon_conditions_md_old": "id string, post_settlement string",
    "finance.fin_coupon_order_option_distributions": (
        "base_dt string, production_id string, seller_id string, coupon_mold_id string, department int, "
        f"coupon_cost_seller_distributed_deduction {M}, coupon_cost_seller_distributed_deposit {M}"
    ),
    "finance.fin_coupon_order_options_settlement": _COUPON_SETTLEMENT,
    "finance.fin_coupon_product_order_options": _COUPON,
    "finance.fin_discount_order_option_distributions_d": (
        f"base_dt string, production_id string, order_production_id string, seller_distribution {M}"
    ),
    "finance.fin_mileage_histories_d": (
        "user_id string, mileage_id bigint, mileage bigint, reference_mileage_id string"
    ),
    "finance.fin_mileage_order_options_settlement": (
        "base_dttm timestamp_ntz, batch_job string, kind int, order_id string, order_option_id string, "
        f"mileage_cost {M}"
    ),
    "finance.fin_option_daily_orderprice": (
        f"option_id string, yyyymmdd string, noprice_sku_count bigint, mgmt_applied_orderprice {M}"
    ),
    "finance.fin_seller_agency_code_mapping": "seller_id string, agency string, dt string, type string",
    "finance.fin_transport_fee_calculate_options_monthly": (
        f"option_id string, yyyymm string, calculated_transport_fee {M}, basic_transport_fee {M}"
    ),
    "finance.fin_vendor_funding_md": "yyyymm string, logisticstype string, cate_name string, funding_value string",
    "finance.mileage_point_type_mapping": "category_type string, acct_type string, dept string",
    "finance.monthly_sku_orderprice": "yyyymm string, skucode string, load_dt string",
    "quicksight.payment": f"order_at string, {_LEGACY_SALE}",
    "quicksight.refund": f"cancel_at string, {_LEGACY_SALE}",
    "temp.fin_mkt_freecash": "yyyymmdd string, value string",
    "temp.fin_non_3p_seller_current": "seller_id string, biz string, company_name string",
}
