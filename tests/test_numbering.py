"""Row numbers over a whole table."""

from pyspark.sql import functions as F

from ledgerweave.operators.numbering import number_rows
from tests.conftest import rows


def test_numbers_follow_the_order_over_all_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select(F.pmod(F.col("id") * 7919, F.lit(5003)).alias("v"))
    got = rows(number_rows(df, [F.col("v").desc()]))
    want = sorted((r.v for r in df.collect()), reverse=True)
    assert {n: v for v, n in got} == {i: v for i, v in enumerate(want, 1)}


def test_ties_spread_over_tasks_and_each_number_is_given_once(spark):
    df = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("k"), F.when(F.col("id") < 10, F.col("id")).alias("v"))
    out = number_rows(df, [F.col("k"), F.col("v").asc_nulls_last()])
    assert sorted(r.row_number for r in out.collect()) == list(range(1, 4001))
    assert sorted((r.v, r.row_number) for r in out.filter("v is not null").collect()) == [(i, i + 1) for i in range(10)]
    assert "Window" not in out._jdf.queryExecution().toString()


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "v int, _before int")
    assert number_rows(df.drop("_before"), [F.col("v")]).collect() == []
