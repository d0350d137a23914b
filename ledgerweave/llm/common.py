"""Column rules and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.session import tune

# functions of this subpackage travel to the workers whole, so these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules["ledgerweave.llm"])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

RANGES = 1024  # of a hash, in which a sample counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query of (spark, sf_dir), with its SQL oracle where SQL can express it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the lower-cased words; every ASCII character but digits and letters separates them."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAKS), "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text of no characters."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def batches_of(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of so many rows, so that long texts do not fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sample_rows(
    ids: DataFrame, docs: DataFrame, label: str, per_label: int, max_bytes: int, max_rows: int | None = None
) -> DataFrame:
    """At most ``per_label`` labelled texts of each label, the same ones on every run: doc_id, label, text.

    ``ids`` has doc_id and the label column, ``docs`` doc_id and text (and the label, where an id may stand
    for texts of several). Ids are taken by a hash, once however often they are repeated, and of the texts
    of one id, of up to ``max_bytes``, that of the smallest hash. So the sample has at most labels x
    ``per_label`` texts (``max_rows`` in all, where given), and nothing larger than that is sorted or sent:
    counts by ranges of the hash tell where to cut, a little below ``per_label``. Null ids and
    labels are left out; labels with nothing else are not in the sample.
    """
    keyed = ids.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    keyed = keyed.withColumn("_h", F.xxhash64("doc_id"))
    found = keyed.groupBy(label).agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()  # a row a label
    if max_rows is not None and found:
        per_label = max(1, min(per_label, max_rows // len(found)))
    spark, kind = docs.sparkSession, ids.select(label).dtypes[0][1]
    thin = spark.createDataFrame([(r[label], max(1, r["n"] // (2 * per_label))) for r in found], f"_label {kind}, _every long")
    few = (
        keyed.join(F.broadcast(thin), F.col(label) == F.col("_label"))  # a row a label
        .filter(F.pmod(F.col("_h"), F.col("_every")) == 0)
        .withColumn("_range", F.pmod(F.xxhash64("_h"), F.lit(RANGES)).cast("int"))
        .select("doc_id", label, "_range")
        .distinct()
    )
    cuts, held = [], {}
    for r in few.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("n")).collect():  # RANGES rows a label
        held.setdefault(r[label], {})[r["_range"]] = r["n"]
    for value, counts in held.items():
        taken, cut = 0, RANGES
        for k in sorted(counts):
            taken += counts[k]
            if taken > per_label:
                cut = k
                break
        cuts.append((value, cut))
    cuts = spark.createDataFrame(cuts, f"_label {kind}, _cut int")
    picked = few.join(F.broadcast(cuts), F.col(label) == F.col("_label")).filter(F.col("_range") < F.col("_cut"))
    keys = ["doc_id", label] if label in docs.columns else ["doc_id"]
    short = docs.filter(F.octet_length("text") <= max_bytes).select(*keys, "text")
    texts = short.join(F.broadcast(picked.select("doc_id", label)), keys)  # bounded by labels x per_label
    return texts.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
