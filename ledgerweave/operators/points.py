"""Reward points: origin tracing, classification, allocation, department reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import as_date, ex_vat, full_months_between, month_key, round0, spread_null_key
from ledgerweave.operators.allocate import share_out
from ledgerweave.operators.dedupe import fold_copies
from ledgerweave.operators.keyfilter import key_filter, may_match
from ledgerweave.operators.weeks import week_of_day

# --- Fixed values: codes of the point ledger -------------------------------------------
ACCUM = "ACCUM"
WITHDRAW = "WITHDRAW"
POINT = "POINT"
CONFIRM_ORDER = "CONFIRM_ORDER"
KEPT_CATEGORIES = (
    "CONFIRM_ORDER",
    "DECORATIVE_SUPPORT_FUND",
    "EXPIRE",
    "USE_FOR_ORDER",
    "WITHDRAW_BY_ADMIN",
    "WITHDRAW_BY_CANCEL_CONFIRM",
)
MERGED_CATEGORIES = ("ORDER_CANCEL", "ORDER_REFUND")
MERGED_LABEL = "ORDER_CANCEL/REFUND"
EVENT = "EVENT"
UNKNOWN = "UNKNOWN"
UNKNOWN_MONTH = "unknown"
FIRST_PARTY_BIZ = ("1P", "PREMIUM")
LEGACY_VERSION = "m"
TRACED, LEGACY = "MSA", "LEGACY"
REWARD_DEPT, OTHER_DEPT, FOREIGN_BIZ = "REWARD", "OTHER", "FOREIGN"

SUMMARY_KEYS = [
    "accum_ver",
    "tran_ver",
    "tran_mm",
    "accum_mm",
    "exp_mm",
    "over_1mnth",
    "exp_date_pass",
    "process_type",
    "accum_acct_cate",
    "accum_acct_cate_biz",
    "accum_dept",
    "accum_dept_biz",
    "accum_cate",
    "tran_cate",
]


def origin_biz(category: Column, biz: Column) -> Column:
    """1P or 3P for purchase-confirm points, null for the rest."""
    return F.when(category == CONFIRM_ORDER, F.when(biz.isin(*FIRST_PARTY_BIZ), "1P").otherwise("3P"))


def origin_category(category: Column) -> Column:
    """Kept names, cancel and refund merged, other names one event group, null unknown."""
    return (
        F.when(category.isin(*KEPT_CATEGORIES), category)
        .when(category.isin(*MERGED_CATEGORIES), MERGED_LABEL)
        .when(category.isNotNull(), EVENT)
        .otherwise(UNKNOWN)
    )


def with_suffix(label: Column, biz: Column) -> Column:
    """``label`` or ``label-biz``."""
    return F.concat(label, F.coalesce(F.concat(F.lit("-"), biz), F.lit("")))


def over_one_month(accum_day: Column, expiry: Column) -> Column:
    return F.coalesce((full_months_between(accum_day, expiry) > 1).cast("string"), F.lit(UNKNOWN_MONTH))


def expiry_passed(expiry: Column, as_of: dt.date) -> Column:
    yesterday = as_date(as_of - dt.timedelta(days=1))
    return F.coalesce((expiry < yesterday).cast("string"), F.lit(UNKNOWN_MONTH))


def expiry_flags(df: DataFrame, accum_day: str, expiry: str, as_of: dt.date) -> DataFrame:
    """Longer than a month to expiry, and expired before yesterday; 'unknown' without dates."""
    return df.withColumns(
        {
            "over_1mnth": over_one_month(F.col(accum_day), F.col(expiry)),
            "exp_date_pass": expiry_passed(F.col(expiry), as_of),
        }
    )


def option_biz(options: DataFrame, productions: DataFrame, sellers: DataFrame) -> DataFrame:
    """Business code of each order option (null when the seller is unmapped), keyed by text id.

    Identical mapping rows are folded with their number, so that later joins can carry a
    count instead of copies.
    """
    s = fold_copies(sellers.select(F.col("seller_id").cast("bigint").alias("_seller"), F.col("biz").alias("biz_code")), "biz_copies")
    p = productions.select(F.col("id").alias("_production"), F.col("seller_id").alias("op_seller"))
    return (
        options.select(F.col("id").cast("string").alias("option_key"), "order_production_id")
        .join(p, F.col("order_production_id") == F.col("_production"), "left")
        .join(s, F.col("op_seller") == F.col("_seller"), "left")
        .select("option_key", "op_seller", "biz_code", F.coalesce("biz_copies", F.lit(1)).alias("biz_copies"))
    )


def with_option_biz(points: DataFrame, options_biz: DataFrame) -> DataFrame:
    """Points with ``option_biz``: the business codes of the option their request names, each with its copies.

    Null without a request; empty where the option is unknown, or known once and unmapped, which is the same
    to a left join. An option has as many entries as it has different codes. Points are looked up once here,
    so that no later row, of which there are several a point, is moved for its option.
    """
    codes = (
        options_biz.select("option_key", "biz_code", "biz_copies")
        .filter(F.col("option_key").isNotNull())
        .repartition("option_key")  # both sums and the join find an option's rows in place
        .groupBy("option_key", "biz_code")
        .agg(F.sum("biz_copies").alias("biz_copies"))
        .groupBy("option_key")
        .agg(F.collect_list(F.struct("biz_code", "biz_copies")).alias("_codes"))
    )
    one = F.col("_codes")[0]
    unmapped = (F.size("_codes") == 1) & one["biz_code"].isNull() & (one["biz_copies"] == 1)
    none = F.filter("_codes", lambda _: F.lit(False))
    codes = codes.withColumn("_codes", F.when(unmapped, none).otherwise(F.col("_codes")))
    empty = F.array().cast(dict(codes.dtypes)["_codes"])
    return (
        points.join(codes, spread_null_key("request_id", "id") == F.col("option_key"), "left")
        .select(*points.columns, F.when(F.col("request_id").isNotNull(), F.coalesce("_codes", empty)).alias("option_biz"))
    )


def first_details(points: DataFrame, details: DataFrame, *more: str) -> DataFrame:
    """Points joined to the details that are their own first accumulation; ``more`` names further columns of the points."""
    d = details.filter(F.col("detail_first_accum_id") == F.col("id")).select("detail_first_accum_id", "point_id")
    p = points.select(
        F.col("id").alias("_point"), "process_type", "category_type", "version", "created_at", "request_id", *more
    )
    return d.join(p, F.col("point_id") == F.col("_point")).drop("point_id")


def first_accumulation(
    points: DataFrame, details: DataFrame, options_biz: DataFrame, type_mapping: DataFrame
) -> DataFrame:
    """One row per first accumulation: who granted it, when, in which category and business.

    Only purchase-confirm points have an option. ``points`` may carry their ``option_biz`` already.
    """
    if "option_biz" not in points.columns:
        points = with_option_biz(points, options_biz)
    # all that is told apart in the end is first or third party
    codes = F.transform("option_biz", lambda o: origin_biz(F.lit(CONFIRM_ORDER), o["biz_code"]))
    none = origin_biz(F.lit(CONFIRM_ORDER), F.lit(None).cast("string"))
    biz = F.when(
        F.col("category_type") == CONFIRM_ORDER,
        F.when(F.size("option_biz") > 0, F.array_distinct(codes)).otherwise(F.array(none)),
    )
    points = points.withColumn("_biz", biz)
    m = type_mapping.select(F.col("category_type").alias("_type"), F.col("acct_type").alias("acct_cate"))
    return (
        first_details(points, details, "_biz")
        .drop("request_id")
        .distinct()  # copies of a detail lie with their point: folded before anything is moved
        .withColumn("accum_acct_biz", F.explode_outer("_biz"))
        .join(m, F.col("category_type") == F.col("_type"), "left")
        .select(
            "detail_first_accum_id",
            "process_type",
            "acct_cate",
            "accum_acct_biz",
            "category_type",
            "version",
            "created_at",
        )
        .repartition("detail_first_accum_id")  # where it is also looked up
        .distinct()
    )


def legacy_origin(
    df: DataFrame,
    history: DataFrame,
    points: DataFrame,
    unmatched: Column,
    user: str = "user_id",
    payload: str = "payload",
    asked: DataFrame | None = None,
    found_only: bool = False,
) -> DataFrame:
    """Trace rows without a first accumulation through the mileage history to an older point.

    Adds ``mileage``, ``history_copies`` and the legacy point's columns with prefix ``mig_`` (its ``option_biz``
    too, if ``points`` carries it). Rows that are traced already, or have no user or payload, keep nulls there and
    are not moved. The keys of the others filter the history at its scan, and the references of what is left filter
    the older points, so only rows that may be part of a trace are shuffled. History meets the older points first:
    the rows themselves are moved once. ``df`` is read three times: an expensive one should be a written table, or
    ``asked`` a cheaper one with the users and payloads of its unmatched rows. Keys are put together where rows
    meet and not moved with them. With ``found_only`` just the unmatched rows that have a history are returned.
    """
    own = F.concat(F.col(user).cast("string"), F.lit("|"), F.col(payload).cast("string"))
    missing = F.coalesce(unmatched, F.lit(False))
    open_, settled = df.filter(missing & own.isNotNull()), df.filter(~missing | own.isNull())

    hkey = F.concat_ws("|", F.col("user_id"), F.col("mileage_id").cast("string"))
    ref = F.concat(F.col("user_id"), F.lit("|"), F.col("reference_mileage_id"))
    mentioned = may_match(history, hkey, key_filter(open_ if asked is None else asked, own)).select(
        "user_id", "mileage_id", "reference_mileage_id", "mileage"
    )
    mkey = F.concat_ws("|", F.col("user_id").cast("string"), F.col("payload").cast("string"))
    candidates = points.filter(F.col("payload").isNotNull() & F.col("user_id").isNotNull())
    kept = ["id", "category_type", "created_at", "use_end_date", "request_id", "option_biz"]
    older = may_match(candidates, mkey, key_filter(mentioned, ref)).select(
        mkey.alias("_mkey"), *[F.col(c).alias(f"mig_{c}") for c in kept if c in points.columns]
    )
    h = fold_copies(mentioned, "history_copies")
    # a reference of its own for history without one: it matches nothing and does not meet under one null
    traces = (
        h.join(older, spread_null_key(ref, hkey) == F.col("_mkey"), "left")
        .drop("_mkey", "reference_mileage_id")
        .withColumnsRenamed({"user_id": "_huser", "mileage_id": "_hmileage"})
    )
    found = (
        open_.join(
            traces,
            own == F.concat_ws("|", F.col("_huser"), F.col("_hmileage").cast("string")),
            "inner" if found_only else "left",
        )
        .withColumn("history_copies", F.coalesce("history_copies", F.lit(1)))
        .drop("_huser", "_hmileage")
    )
    if found_only:
        return found
    kinds = dict(found.dtypes)
    added = [c for c in found.columns if c not in df.columns]
    rest = settled.select(
        *df.columns,
        *[(F.lit(1) if c == "history_copies" else F.lit(None)).cast(kinds[c]).alias(c) for c in added],
    )
    return found.unionByName(rest)


def point_rows(
    points: DataFrame,
    details: DataFrame,
    first: DataFrame,
    history: DataFrame,
    options_biz: DataFrame,
    type_mapping: DataFrame,
    service_id: str,
    as_of: dt.date,
) -> DataFrame:
    """One row per point detail (or point) and origin, classified, with the weight to share by.

    ``copies`` counts identical rows that a join over duplicate mapping rows would give. The rows are narrow,
    as they are moved for the sharing and the report: ``point_labels`` reads the report's keys off them.
    ``counted`` is true on one row of each point and key.
    ``points`` may carry their ``option_biz`` already. All that depends on a point alone is found per point and
    joined by its id, next to its details.
    """
    if "option_biz" not in points.columns:
        points = with_option_biz(points, options_biz)
    d = details.select(
        F.col("id").alias("detail_id"),
        "point_id",
        "detail_first_accum_id",
        F.col("use_end_date").alias("detail_use_end_date"),
        F.col("amount").alias("detail_amount"),
    )
    fa = first.select(
        F.col("detail_first_accum_id").alias("fa_id"),
        F.col("process_type").alias("fa_process"),
        F.col("acct_cate").alias("fa_acct"),
        F.col("accum_acct_biz").alias("fa_biz"),
        F.col("category_type").alias("fa_category"),
        (F.col("version") != LEGACY_VERSION).alias("fa_traced"),
        F.col("created_at").cast("date").alias("fa_day"),
    )
    # details without a first accumulation meet under their own id, where none can match
    first_id = F.coalesce("detail_first_accum_id", "detail_id", "point_id")
    d = (
        d.join(fa, (first_id == F.col("fa_id")) & F.col("detail_first_accum_id").isNotNull(), "left")
        .withColumn("fa_found", F.col("fa_id").isNotNull())
        .drop("fa_id")
    )
    p = points.filter((F.col("point_type") == POINT) & (F.col("service_id") == service_id))
    keys = p.filter(F.col("user_id").isNotNull() & F.col("payload").isNotNull()).select("id", "user_id", "payload")
    traces = legacy_origin(keys.distinct(), history, points, F.lit(True), asked=keys, found_only=True).select(
        F.col("id").alias("_id"),
        F.col("user_id").alias("_user"),
        F.col("payload").alias("_payload"),
        "mileage",
        "history_copies",
        "mig_id",
        "mig_category_type",
        F.col("mig_created_at").cast("date").alias("mig_day"),
        "mig_use_end_date",
        "mig_option_biz",
    )
    # ids tell almost all points apart and place the rows; user and payload are compared on top
    same_point = (
        (F.col("id") == F.col("_id"))
        & F.col("user_id").between(F.col("_user"), F.col("_user"))
        & F.col("payload").between(F.col("_payload"), F.col("_payload"))
    )
    traced = (
        p.select(
            "id",
            "user_id",
            "payload",
            "version",
            "process_type",
            "category_type",
            F.col("created_at").cast("date").alias("_day"),
            "use_end_date",
            "amount",
            "option_biz",
        )
        .join(d, F.col("id") == F.col("point_id"), "left")
        .join(traces, same_point & F.col("fa_traced").isNull(), "left")
    )
    own_category = F.when(F.col("process_type") == ACCUM, F.col("category_type"))
    origin = F.coalesce(own_category, "fa_category", "mig_category_type")
    # the option and the department are looked up by the legacy category before the traced one
    lookup_category = F.coalesce(own_category, "mig_category_type", "fa_category")
    codes = F.when(lookup_category == CONFIRM_ORDER, F.coalesce("mig_option_biz", "option_biz"))
    m = fold_copies(type_mapping.select(F.col("category_type").alias("_type"), F.col("dept").alias("accum_dept")), "dept_copies")
    traced = (
        traced.withColumns({"origin": origin, "_lookup": lookup_category, "_codes": codes})
        .withColumn("_option", F.explode_outer("_codes"))
        .join(m, F.col("_lookup") == F.col("_type"), "left")
    )
    accum_day = F.coalesce(F.when(F.col("process_type") == ACCUM, F.col("_day")), "fa_day", "mig_day")
    expiry = F.coalesce("detail_use_end_date", "use_end_date", "mig_use_end_date")
    is_traced = F.coalesce("fa_traced", F.lit(False))
    narrow = traced.select(
        point_term(is_traced, F.col("_day"), accum_day, expiry, as_of).alias("term"),
        F.col("version").alias("tran_ver"),
        "process_type",
        "origin",
        "accum_dept",
        F.col("category_type").alias("tran_cate"),
        "user_id",
        F.col("id").alias("point_id"),
        "detail_id",
        "detail_first_accum_id",
        F.col("mig_id").alias("legacy_accum_id"),
        F.coalesce("detail_amount", "amount").alias("amount"),
        F.coalesce("fa_found", F.lit(False)).alias("fa_found"),
        "mileage",
        "fa_process",
        "fa_acct",
        "fa_biz",
        F.col("_option")["biz_code"].alias("biz_code"),
        (
            F.coalesce("history_copies", F.lit(1))
            * F.coalesce(F.col("_option")["biz_copies"], F.lit(1))
            * F.coalesce("dept_copies", F.lit(1))
        ).alias("copies"),
    )
    # the rows of a point lie together here: one of each key counts it, so that the summary need not tell them apart
    same = Window.partitionBy("point_id", *[accum_biz() if k == "accum_biz" else F.col(k) for k in TERM_KEYS])
    counted = F.col("point_id").isNotNull() & (F.row_number().over(same.orderBy("detail_id")) == 1)
    return narrow.withColumn("counted", counted)


def _month_number(day: Column) -> Column:
    """Months since year 0, 0 for no date; 17 bits hold them up to year 9999, where dates end."""
    return F.coalesce(F.year(day) * 12 + F.month(day), F.lit(0)).cast("bigint")


def point_term(is_traced: Column, day: Column, accum_day: Column, expiry: Column, as_of: dt.date) -> Column:
    """Whether traced, the three months and both expiry flags of a row as one number; equal where all six are.

    From the low bits: months of the transaction, the accumulation and the expiry (17 each), longer than a month
    and expired (2 each: 0 false, 1 true, 2 unknown), traced.
    """
    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(2)).cast("bigint")

    over = full_months_between(accum_day, expiry) > 1
    passed = expiry < as_date(as_of - dt.timedelta(days=1))
    term = _month_number(day)
    for part, at in ((_month_number(accum_day), 17), (_month_number(expiry), 34), (flag(over), 51), (flag(passed), 53)):
        term = term.bitwiseOR(F.shiftleft(part, at))
    return term.bitwiseOR(F.shiftleft(is_traced.cast("bigint"), 55))


TERM_KEYS = ["term", "tran_ver", "process_type", "origin", "accum_biz", "accum_dept", "tran_cate"]


def accum_biz() -> Column:
    """Business of the origin of a ``point_rows`` row."""
    c = F.col("origin")
    return F.when(c == CONFIRM_ORDER, origin_biz(c, F.col("biz_code"))).otherwise(F.col("fa_biz"))


def point_labels(df: DataFrame) -> DataFrame:
    """The 14 report keys in place of ``TERM_KEYS``, from which they follow one to one."""
    def bits(at: int, n: int) -> Column:
        return F.shiftright("term", at).bitwiseAND(F.lit((1 << n) - 1))

    def month(at: int) -> Column:
        n = bits(at, 17) - 1
        return F.when(n >= 0, (F.floor(n / 12) * 100 + n % 12 + 1).cast("string"))

    def flag(at: int) -> Column:
        return F.when(bits(at, 2) < 2, (bits(at, 2) == 1).cast("string")).otherwise(UNKNOWN_MONTH)

    cate, biz = origin_category(F.col("origin")), F.col("accum_biz")
    labels = {
        "accum_ver": F.when(bits(55, 1) == 1, TRACED).otherwise(LEGACY),
        "tran_ver": F.col("tran_ver"),
        "tran_mm": month(0),
        "accum_mm": F.coalesce(month(17), F.lit(UNKNOWN_MONTH)),
        "exp_mm": F.coalesce(month(34), F.lit(UNKNOWN_MONTH)),
        "over_1mnth": flag(51),
        "exp_date_pass": flag(53),
        "process_type": F.col("process_type"),
        "accum_acct_cate": cate,
        "accum_acct_cate_biz": with_suffix(cate, biz),
        "accum_dept": F.col("accum_dept"),
        "accum_dept_biz": with_suffix(F.col("accum_dept"), biz),
        "accum_cate": F.coalesce("origin", F.lit(UNKNOWN)),
        "tran_cate": F.col("tran_cate"),
    }
    rest = [c for c in df.columns if c not in TERM_KEYS]
    return df.select(*[labels[k].alias(k) for k in SUMMARY_KEYS], *rest)


RANK_ORDER = [
    "rank_id",
    "point_id",
    "detail_id",
    "legacy_accum_id",
    "mileage",
    "accum_dept",
    "biz_code",
    "fa_process",
    "fa_acct",
    "fa_biz",
]
SHARE_COLUMNS = [*RANK_ORDER[1:], "detail_first_accum_id", "fa_found", "process_type", "amount", "copies"]


def share_points(rows: DataFrame, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Share each amount over its origins by weight; the first origin takes the rounding rest.

    With ``sums`` these by detail and point in place of the rows. The sums may read ``SHARE_COLUMNS``, of which the
    shares are made, and the shares: the rows are narrowed to those columns before they are moved and written.

    Shares are taken within ``share_key``; the rest is settled per detail and point. The two
    keys differ on purpose: detail and point ids share one number space in the first only.
    """
    fa_id = F.when(F.col("fa_found"), F.col("detail_first_accum_id"))
    if sums:
        rows = rows.select(*SHARE_COLUMNS)
    # a detail and its point settle what is left: they divide the rows of a share key further
    return share_out(
        rows,
        ["share_key"],
        "amount",
        "mileage",
        RANK_ORDER,
        settle_by=["detail_id", "point_id"],
        keep_full=F.col("process_type") == ACCUM,
        alloc_out="dist_amount",
        out="fixed_amount",
        copies="copies",
        derived={"share_key": F.coalesce("detail_id", "point_id"), "rank_id": F.coalesce("legacy_accum_id", fa_id)},
        sums=sums,
    )


def point_summary(
    df: DataFrame, amount: str = "fixed_amount", keys: Sequence[str] = SUMMARY_KEYS, counted: str | None = None
) -> DataFrame:
    """Amount, number of points and sample ids by the 14 report keys, or by ``keys`` that stand for them.

    ``counted`` names a flag that is true on one row of each point and key; without it points are told apart here.
    """
    points = F.sum(F.col(counted).cast("bigint")) if counted else F.countDistinct("point_id")
    return df.groupBy(*keys).agg(
        F.sum(F.col(amount).cast("decimal(28,2)")).alias("amount"),
        points.alias("pointid_cnt"),
        F.max("user_id").alias("sample_user"),
        F.max("point_id").alias("sample_pointid"),
        F.max("detail_id").alias("sample_detail_id"),
        F.max(F.coalesce("detail_first_accum_id", "legacy_accum_id")).alias("sample_first"),
    )


# --- department report -------------------------------------------------------------------


def point_biz(
    points: DataFrame,
    options: DataFrame,
    productions: DataFrame,
    snapshot_options: DataFrame,
    snapshot_productions: DataFrame,
    sellers: DataFrame,
    snapshot_day: str,
) -> DataFrame:
    """Business label of purchase-confirm points, from the live order or the pinned snapshot.

    Label is ``biz-``; a known seller without mapping is ``3P-``, an unknown one null.
    """
    p = points.filter((F.col("category_type") == CONFIRM_ORDER) & (F.col("point_type") == POINT)).select(
        F.col("id").alias("point_id"), "request_id"
    )
    p = p.withColumn("_key", spread_null_key("request_id", "point_id"))

    def seller_of(opts: DataFrame, prods: DataFrame, key: str, seller: str) -> DataFrame:
        pr = prods.select(F.col("id").alias("_pid"), F.col("seller_id").alias(seller))
        return (
            opts.select(F.col("id").cast("string").alias(key), "order_production_id")
            .join(pr, F.col("order_production_id") == F.col("_pid"), "left")
            .select(key, seller)
        )

    live = seller_of(options, productions, "_live", "_live_seller")
    pinned = seller_of(
        snapshot_options.filter(F.col("base_dt") == snapshot_day),
        snapshot_productions.filter(F.col("base_dt") == snapshot_day),
        "_pinned",
        "_pinned_seller",
    )
    s = sellers.select(F.col("seller_id").cast("bigint").alias("_sid"), F.col("biz").alias("_biz"))
    return (
        p.join(live, F.col("_key") == F.col("_live"), "left")
        .join(pinned, F.col("_key") == F.col("_pinned"), "left")
        .withColumn("_seller", F.coalesce("_live_seller", "_pinned_seller"))
        .join(s, F.col("_seller") == F.col("_sid"), "left")
        .select(
            "point_id",
            F.concat(F.coalesce("_biz", F.when(F.col("_seller").isNotNull(), "3P")), F.lit("-")).alias("biz"),
        )
        .distinct()
    )


def is_short_lived() -> Column:
    """Granted or withdrawn with no whole month left to the expiry date."""
    months = full_months_between(F.col("created_at").cast("date"), F.col("use_end_date"))
    return F.coalesce(F.col("process_type").isin(ACCUM, WITHDRAW) & (months <= 0), F.lit(False))


def short_points(points: DataFrame) -> DataFrame:
    return points.filter(is_short_lived()).select(F.col("id").alias("point_id"))


def point_department(biz: Column, dept: Column, short: Column) -> Column:
    """Business prefix, department, and for the other department whether points are short lived."""
    kind = F.when(dept == OTHER_DEPT, F.when(short, "-SHORT").otherwise("-NORMAL")).otherwise("")
    return F.concat(F.coalesce(biz, F.lit("")), dept, kind)


def first_category(points: DataFrame, details: DataFrame, biz: DataFrame) -> DataFrame:
    """Category and business of each first accumulation."""
    b = biz.select(F.col("point_id").alias("_bp"), "biz")
    return (
        first_details(points, details)
        .join(b, F.col("_point") == F.col("_bp"), "left")
        .select("detail_first_accum_id", "category_type", "biz")
        .distinct()
    )


def point_department_rows(
    points: DataFrame,
    details: DataFrame,
    biz: DataFrame,
    first: DataFrame,
    type_mapping: DataFrame,
    service_id: str,
    first_day: dt.date,
) -> DataFrame:
    """Granted and withdrawn points with their department; detail amounts come before point amounts.

    Whether a point is short lived is read off its own dates, so no join is needed for it.
    """
    since = as_date(first_day).cast("timestamp_ntz")
    p = points.filter(
        F.col("process_type").isin(ACCUM, WITHDRAW) & (F.col("service_id") == service_id) & (F.col("created_at") >= since)
    ).withColumn("_short", is_short_lived())
    d = details.select(
        F.col("id").alias("detail_id"), "point_id", "detail_first_accum_id", F.col("amount").alias("detail_amount")
    )
    b = biz.select(F.col("point_id").alias("_bp"), F.col("biz").alias("own_biz"))
    fa = first.select(
        F.col("detail_first_accum_id").cast("string").alias("_fkey"),
        F.col("category_type").alias("fa_category"),
        F.col("biz").alias("fa_biz"),
    )
    m = type_mapping.select(F.col("category_type").alias("_type"), "dept")
    row_key = F.concat_ws("|", F.col("id").cast("string"), F.col("detail_id").cast("string"))
    return (
        p.join(d, F.col("id") == F.col("point_id"), "left")
        .join(b, F.col("id") == F.col("_bp"), "left")
        .withColumn("_fk", spread_null_key("detail_first_accum_id", row_key))
        .join(fa, F.col("_fk") == F.col("_fkey"), "left")
        .withColumn("_category", F.coalesce("fa_category", "category_type"))
        .join(m, F.col("_category") == F.col("_type"), "left")
        .select(
            F.col("created_at").cast("date").alias("tran_dt"),
            point_department(F.coalesce("own_biz", "fa_biz"), F.col("dept"), F.col("_short")).alias("department"),
            "process_type",
            F.coalesce("detail_amount", "amount").alias("amount"),
            # the label carries a dash, so this exemption never holds; kept as in the source
            F.coalesce((F.col("dept") == REWARD_DEPT) & (F.col("own_biz") == FOREIGN_BIZ), F.lit(False)).alias("exempt"),
        )
    )


def point_measures(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Totals, grants and withdrawals by month, week and department, each with its ex-VAT twin.

    VAT is taken off the sums (taxed and exempt apart) and rounded once. Rows are summed per
    day before the calendar is joined.
    """
    c = F.col
    cases = {"": F.lit(True), "accum_": c("process_type") == ACCUM, "withdraw_": c("process_type") == WITHDRAW}
    sums = {}
    for prefix, cond in cases.items():
        sums[f"{prefix}taxed"] = F.sum(F.when(cond & ~c("exempt"), c("amount")).otherwise(0))
        sums[f"{prefix}exempt"] = F.sum(F.when(cond & c("exempt"), c("amount")).otherwise(0))
    daily = rows.groupBy("tran_dt", "department").agg(*[v.alias(k) for k, v in sums.items()])
    week = week_of_day(calendar)
    out = {}
    for prefix in cases:
        taxed, exempt = F.sum(f"{prefix}taxed"), F.sum(f"{prefix}exempt")
        out[f"{prefix}point"] = taxed + exempt
        out[f"{prefix}ex_vat_point"] = round0(ex_vat(taxed) + exempt)
    return (
        daily.join(week, c("tran_dt") == c("_date"), "left")
        .groupBy(month_key("tran_dt").alias("tran_mm"), "first_of_week", "department")
        .agg(*[v.alias(k) for k, v in out.items()])
    )
