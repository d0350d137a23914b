"""Importance resampling towards a target distribution, with Arrow kernels.

A batch of texts is lower-cased, split and flattened by Arrow, its words dictionary-encoded. Runs of
words are pairs of dictionary indices, shifted against each other; only distinct pairs are hashed
(CRC, carried on from the shorter run) and their buckets are taken back to all places. Bucket
counts of the raw and the target corpus give each bucket's log-likelihood gain, a document's
weight is the mean gain of its features, reduced segment by segment, and Gumbel noise from the
id's hash turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import LOWER, UPPER, WORD_BREAKS, batches_of, query, table
from ledgerweave.operators.numbering import number_rows
from ledgerweave.session import Stages

BUCKETS, LONGEST, SCALE = 10_000, 1, 1000
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"


def batch_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First word and end of each text among all words, and the bucket of the run of k words at each word, k = 1..longest.

    Runs that would reach into the next text have a bucket too; segments leave them out.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), WORD_BREAKS)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(some), parent.filter(some).to_numpy()
    end = np.cumsum(np.bincount(parent, minlength=len(texts)))
    words = flat.dictionary_encode()
    spelled = [w.encode() for w in words.dictionary.to_pylist()]
    index = words.indices.to_numpy().astype(np.int64)
    crc = np.array([zlib.crc32(w) for w in spelled], np.int64)
    out, run = [pa.array(crc % buckets).take(pa.array(index)).to_numpy()], index
    for k in range(2, longest + 1):
        pair = run[:-1] * max(1, len(spelled)) + index[k - 1 :]
        runs = pa.array(pair).dictionary_encode()
        shorter, last = np.divmod(runs.dictionary.to_numpy(), max(1, len(spelled)))
        crc = np.array([zlib.crc32(b" " + spelled[w], int(crc[s])) for s, w in zip(shorter, last)], np.int64)
        run = runs.indices.to_numpy().astype(np.int64)
        out.append(pa.array(crc % buckets).take(pa.array(run)).to_numpy())
    return np.concatenate([[0], end[:-1]]), end, out


def count_buckets(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sums what it reads first."""
    batches_of(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                start, end, found = batch_buckets(batch.column(0), longest, buckets)
                for k, bucket in enumerate(found, 1):
                    # +1 where the runs of a text begin, -1 behind its last whole run
                    open_ = np.zeros(len(bucket) + k + 1, np.int64)
                    fits = end - start >= k
                    np.add.at(open_, start[fits], 1)
                    np.add.at(open_, end[fits] - k + 1, -1)
                    total += np.bincount(bucket[np.cumsum(open_)[: len(bucket)] > 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    parts = docs.select("text").mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, add-one smoothed; one number per bucket."""

    def dense(counts: DataFrame) -> list[int]:
        held = {r["bucket"]: r["n"] for r in counts.collect()}  # at most ``buckets`` rows
        return [held.get(b, 0) for b in range(buckets)]

    s, t = dense(raw), dense(target)
    big_s, big_t = sum(s) + buckets, sum(t) + buckets
    odds = [float((b + 1) * big_s) / float((a + 1) * big_t) for a, b in zip(s, t)]
    return np.array([math.floor(SCALE * math.log(x)) for x in odds], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain; 0 without features)."""
    batches_of(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket
    kind = docs.select("doc_id").dtypes[0][1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = pa.array(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            start, end, found = batch_buckets(batch.column(1), longest, len(gain))
            n, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            for k, bucket in enumerate(found, 1):
                sums = np.concatenate([[0], np.cumsum(gain.take(pa.array(bucket)).to_numpy())])
                stop = np.minimum(np.maximum(end - k + 1, start), len(bucket))
                first = np.minimum(start, stop)
                n += stop - first
                total += sums[stop] - sums[first]
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(end - start), pa.array(n), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    Of the documents with ``min_words`` words or more, ``percent`` of a hundred (rounded down) are drawn:
    those of the highest scores, ties to the smaller id. ``rank`` is their place, null for all others.
    The same table gives the same draw on every run and layout.

    Null and empty texts have no feature: weight 0, a score of noise alone, and no rank if
    ``min_words`` is above 0. Texts are read whole, whatever their length. A null id takes the noise of
    the empty text and comes last among ties. Rows that repeat an id keep rows of their own and share its
    noise; among equal scores and ids the higher weight, then more features come first, and rows equal
    in all of these share their ranks out in any order. An empty target gives every bucket the gain of
    its smoothed raw count alone, an empty ``docs`` no rows. Other columns of both tables are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "importance")
    gains = bucket_gains(count_buckets(docs, longest, buckets), count_buckets(target, longest, buckets), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = stages.write(weigh(docs, gains, longest).withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= min_words
    draw = scored.filter(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    ranked = number_rows(scored.filter(enough), order, "rank", "importance-ranks")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


# crc32 of a word in SQL: a table of the 256 remainders, then one step a byte
ORACLE = rf"""
WITH crc AS (
  SELECT [list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
          CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
          FOR b IN range(0, 256)] AS step),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
bytes AS (
  SELECT word, [CAST('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2] AS BIGINT)
                FOR i IN range(0, strlen(word))] AS x
  FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, x), lambda c, y:
               xor(step[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS ss, coalesce((SELECT sum(n) FROM t), 0) AS tt),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (ss + 10000) AS DOUBLE)
                                    / CAST((s.n + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weighed AS (
  SELECT doc_id, count(*) AS n, sum(gain) AS total FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n,
         CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN weighed USING (doc_id)),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (
  SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS place,
         (SELECT count(*) FROM noisy WHERE n >= 20) * 10 // 100 AS draw
  FROM noisy)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank
FROM placed
"""


@query("op13_importance_resample", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )
