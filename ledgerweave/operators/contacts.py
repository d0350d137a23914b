"""Contact dimension of sales users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALES_USER = "SalesUser"


def dashed(*cols: str) -> Column:
    """Parts joined by dashes, null when one part is missing."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit("-"), F.col(c)]
    return F.concat(*parts[1:])


def named_mail(name: str, mail: str) -> Column:
    return F.concat(F.col(name), F.lit("("), F.col(mail), F.lit(")"))


def contact_dim(properties: DataFrame, sales_users: DataFrame, users: DataFrame) -> DataFrame:
    """One row per sales user contact, numbers and managers composed, duplicates removed."""
    su = sales_users.select(F.col("id").alias("_su"), F.col("company").alias("salesuser_company"), "license1", "license2", "license3")
    u = users.filter(F.col("userable_type") == SALES_USER).select(
        F.col("id").alias("user_id"), F.col("userable_id").alias("_userable"), F.col("nickname").alias("salesuser_nickname")
    )
    ad = [f"ad_manager_phone{i}" for i in (1, 2, 3)]
    settle = [f"settlement_manager_phone{i}" for i in (1, 2, 3)]
    return (
        properties.join(su, F.col("sales_user_id") == F.col("_su"), "left")
        .join(u, F.col("sales_user_id") == F.col("_userable"), "left")
        .select(
            "sales_user_id",
            "user_id",
            "salesuser_company",
            "salesuser_nickname",
            dashed("license1", "license2", "license3").alias("salesuser_biz_number"),
            named_mail("ad_manager_name", "ad_manager_email").alias("ad_manager"),
            dashed(*ad).alias("ad_manager_phone"),
            named_mail("settlement_manager_name", "settlement_manager_email").alias("ad_settle_manager"),
            dashed(*settle).alias("ad_settle_manager_phone"),
        )
        .distinct()
    )
