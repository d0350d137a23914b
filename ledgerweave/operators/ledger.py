"""Control totals and two-source reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def control_total(df: DataFrame, keys: Sequence[str], amount: str, out: str = "amt") -> DataFrame:
    """The total a report over the same ledger has to reproduce."""
    return df.groupBy(*keys).agg(F.sum(amount).alias(out))


def reconcile(
    ledger: DataFrame,
    balances: DataFrame,
    key: str,
    ledger_amount: str,
    balance_amount: str,
    ledger_id: str,
) -> DataFrame:
    """Keys whose ledger sum differs from the balance, with the difference.

    Both sides are stacked with zero fill, so a key missing on one side is compared with 0
    and one aggregate (with partial sums) replaces a full outer join. A key whose sum is
    null on both fills is not comparable and drops out, as with ``<>`` in SQL.
    """
    one = ledger.select(
        F.col(key).alias("key"),
        F.col(ledger_amount).alias("data_sum"),
        F.lit(0).cast("decimal(18,2)").alias("user_bal"),
        F.when(F.col(ledger_id).isNotNull(), 1).otherwise(0).alias("tran_count"),
    )
    two = balances.select(
        F.col(key).alias("key"),
        F.lit(0).cast("decimal(18,2)").alias("data_sum"),
        F.col(balance_amount).alias("user_bal"),
        F.lit(0).alias("tran_count"),
    )
    sums = (
        one.unionByName(two)
        .groupBy("key")
        .agg(
            F.sum("data_sum").alias("data_sum"),
            F.sum("user_bal").alias("user_bal"),
            F.sum("tran_count").alias("tran_count"),
        )
    )
    return (
        sums.filter(F.col("data_sum") != F.col("user_bal"))
        .withColumn("diff", F.col("data_sum") - F.col("user_bal"))
        .withColumnRenamed("key", key)
    )


def reconcile_with_flag(
    ledger: DataFrame,
    balances: DataFrame,
    dim: DataFrame,
    key: str,
    ledger_amount: str,
    balance_amount: str,
    ledger_id: str,
    dim_key: str,
    flag: str,
) -> DataFrame:
    """``reconcile`` plus a flag for keys gone from the dimension.

    Only differing keys are looked up, each once, so no key can be hot in the join.
    """
    diff = reconcile(ledger, balances, key, ledger_amount, balance_amount, ledger_id)
    known = dim.select(F.col(dim_key).alias("_dim")).filter(F.col("_dim").isNotNull()).distinct()
    return diff.join(known, F.col(key) == F.col("_dim"), "left").withColumn(flag, F.col("_dim").isNull()).drop("_dim")
