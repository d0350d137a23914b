"""Filter a scan by the keys that a later join wants, before anything of it is shuffled.

The wanted keys become a Bloom filter of a fixed size, cut into words: a key's hash picks a word and three bits
in it. The words go to all tasks as a table, so the test is a look-up and a mask, on the JVM.
It may let other keys pass, never holds a wanted one back, and the join that follows decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18  # of 64 bits each: the most rows that are sent, whatever the number of keys


def _placed(df: DataFrame, key: Column) -> DataFrame:
    h = F.xxhash64(key)
    bits = [F.shiftright(h, 40 + 6 * i).bitwiseAND(63).cast("int") for i in range(3)]
    one = [F.expr(f"shiftleft(1L, _b{i})") for i in range(3)]
    placed = df.withColumn("_word", F.pmod(h, F.lit(WORDS))).withColumns({f"_b{i}": b for i, b in enumerate(bits)})
    return placed.withColumn("_mask", one[0].bitwiseOR(one[1]).bitwiseOR(one[2])).drop("_b0", "_b1", "_b2")


def key_filter(keys: DataFrame, key: Column) -> DataFrame:
    """Words of the Bloom filter over the keys that are not null."""
    wanted = _placed(keys.filter(key.isNotNull()), key)
    return wanted.groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def may_match(df: DataFrame, key: Column, words: DataFrame, always: Column | None = None) -> DataFrame:
    """Rows whose key may be one of the filter's, and those for which ``always`` is true.

    Rows with a null key are left out unless ``always`` keeps them.
    """
    held = F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
    words = F.broadcast(words)  # at most WORDS rows
    if always is None:
        return _placed(df.filter(key.isNotNull()), key).join(words, "_word").filter(held).select(*df.columns)
    kept = always | (key.isNotNull() & F.coalesce(held, F.lit(False)))
    return _placed(df, key).join(words, "_word", "left").filter(kept).select(*df.columns)


def without_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not among those of ``gone`` (a column of that name, best a written table).

    An anti join that shuffles only rows that may go: the others pass by the filter. Null keys stay.
    """
    words = F.broadcast(key_filter(gone, F.col(key)))  # at most WORDS rows
    told = _placed(df, F.col(key)).join(words, "_word", "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    asked = told.filter(may).select(*df.columns).join(gone.select(key), key, "left_anti")
    return told.filter(~may).select(*df.columns).unionByName(asked)
