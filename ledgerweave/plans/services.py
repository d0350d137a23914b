"""Moving and remodelling services, and their code map."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import codemap, contracts


def request_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Write the code map and return what was written."""
    codemap.write_code_map(codemap.code_map(spark), path)
    return spark.read.parquet(path)


def moving_revenue(tables: Mapping[str, DataFrame]) -> DataFrame:
    return contracts.net_sales(tables["dump_payment_o2o.sales"], tables["ba_preserved.calendar"]).orderBy(
        F.col("yyyymm").asc_nulls_last(), F.col("first_of_week").asc_nulls_last()
    )


def remodeling_gmv(
    tables: Mapping[str, DataFrame],
    as_of: dt.date,
    legacy_types: Mapping[str, Sequence[int]] | None = None,
    cutover_month: str = "202212",
    first_day: dt.date = dt.date(2021, 6, 1),
) -> DataFrame:
    """Contract amounts and counts; ``legacy_types`` maps an inflow label to consultation ids that get it."""
    flat = contracts.flatten_contracts(
        tables["dump_mongo_expert.remodelingstep"], tables["dump.expertises"], legacy_types or {}
    )
    recognised = contracts.recognise_contracts(flat, cutover_month, first_day, as_of)
    nulls_last = [F.col(c).asc_nulls_last() for c in ("yyyymm", "first_of_week", "scale", "type")]
    return contracts.gmv_summary(recognised, tables["ba_preserved.calendar"]).orderBy(*nulls_last)
