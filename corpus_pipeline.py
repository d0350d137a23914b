"""The corpus pipeline: five stages from raw documents to a training mix.

Every stage reads all that its predecessor kept and its decisions take effect; stages are written as
Parquet in the shared folder and read again. All but the last return the columns of their input;
the last repeats each document as often as the mix takes it, numbered in ``mix_copy``.

Nulls: a null text has no letter and goes with the first stage. Rows with a null doc_id, and rows that
repeat one, are judged row by row; of equal or similar ones the near-duplicate stage leaves one. Texts
are read whole, whatever their length. Ties: of a group the smallest id stays. Empty tables pass
through. Columns beyond doc_id, text, lang and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import table
from ledgerweave.llm.contamination import contaminated_words
from ledgerweave.llm.langid import fit_languages, identify, training_rows
from ledgerweave.llm.mixing import mix
from ledgerweave.llm.neardup import near_duplicates
from ledgerweave.llm.toxicity import fit_toxicity, score_toxicity, training_labels
from ledgerweave.operators.keyfilter import without_keys
from ledgerweave.session import Stages, tune

ORACLE_SQL = None  # trained models and hashes; tests compare each stage with a plain version


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject."""
    tune(spark)
    model = fit_languages(training_rows(docs))
    return identify(docs, model).filter(~F.col("lang_rejected")).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    tune(spark)
    model = fit_toxicity(docs.select("doc_id", "text"), training_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).filter("tox_predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (shingles of five words).

    Rows are compared as rows: of copies under one id, or under none, one stays too. Null ids come after
    all others, rows that tie in their id by their place in the written table.
    """
    tune(spark)
    # numbered once and written, so that every later step means the same row by a number
    stages = Stages(spark, "rows")
    rows = stages.write(docs.withColumn("_row_key", F.monotonically_increasing_id()), "numbered")
    grouped = near_duplicates(rows.select(F.col("_row_key").alias("doc_id"), "text"), shingle=5)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key")
    of = grouped.select(F.col("doc_id").alias("_row_key"), "component_id")
    placed = rows.select("_row_key", "doc_id").join(of, "_row_key")
    # a group of one needs no choice
    least = placed.groupBy("component_id").agg(F.min(place).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    least = least.select("component_id", F.col("_least._row_key").alias("_stays"))
    gone = placed.join(least, "component_id").filter(F.col("_row_key") != F.col("_stays")).select("_row_key")
    return without_keys(rows, "_row_key", stages.write(gone, "gone")).select(*docs.columns)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words stand in benchmark windows."""
    tune(spark)
    # the verdict depends on the text alone; the key also tells apart rows with a null id
    key = F.xxhash64("doc_id", "text")
    found = contaminated_words(
        docs.select(key.alias("_key"), "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"),
        id_col="_key",
    )
    gone = Stages(spark, "contaminated").write(found.filter("contaminated").select("_key").distinct(), "gone")
    return without_keys(docs.withColumn("_key", key), "_key", gone).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix of sources takes them."""
    tune(spark)
    taken = mix(docs).filter("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(
        *docs.columns, "mix_copy"
    )


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", not_contaminated),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents table of ``sf_dir``."""
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir), name)
    return docs
