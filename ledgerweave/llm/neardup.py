"""MinHash near-duplicates with sequential Bayesian verification.

Texts of the same words fold into one representative. Bands of min-hashes put representatives into
buckets. Candidates are compared batch by batch on one-bit signatures and dropped once the
posterior probability of the wanted similarity falls below the miss probability; survivors are
verified on their full shingle sets.

A bucket never lists all its pairs. First every member meets the bucket's smallest one. Where
that leaves a bucket in several components, its members meet those of other components tile by
tile, and only links leave a tile. Links inside a component would not change it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import batches_of, query, table
from ledgerweave.llm.graph import components
from ledgerweave.llm.hashing import Words, shingles, tokens
from ledgerweave.session import Stages

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 40, 6  # a pair at 0.8 shares no band with probability 5e-6
BATCH = 60  # bits of a signature batch
MISS = 1e-6
TILE = 256
FILTER = 1 << 23  # bits of the id filter

_rng = np.random.default_rng(31)
HASHES = BANDS * ROWS
SCALE = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
BAND_MIX = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def least_matches(
    batches: int, one_bit: bool = True, size: int = BATCH, percent: int = PERCENT, miss: float = MISS
) -> list[int]:
    """After each batch, the fewest equal hashes with which a pair still has a posterior of at least ``miss``.

    Hashes of texts with similarity s are equal with probability s, their single bits with
    (1 + s) / 2; the prior of s is flat.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p, wanted, out = (1 + s) / 2 if one_bit else s, s >= percent / 100, []
    for k in range(1, batches + 1):
        n = size * k
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log(1 - p)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        posterior = like[:, wanted].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(posterior >= miss)))
    return out


def sketch(sets: np.ndarray) -> np.ndarray:
    """Min-hashes of one shingle set."""
    x, low = (sets >> np.uint64(32)).astype(np.uint32), np.full(HASHES, np.uint32(0xFFFFFFFF), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            low = np.minimum(low, (x[i : i + 1024, None] * SCALE + SHIFT).min(axis=0))
    return low


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the words, bits (batches of one-bit hashes), bands of each text."""
    batches_of(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            count, digest, low = [], [], []
            for text in batch.column(1).to_pylist():
                t = tokens(text)
                s = shingles(words.hashes(t), shingle)
                count.append(len(s))
                digest.append(hashlib.md5(b" ".join(t), usedforsecurity=False).digest())
                low.append(sketch(s))
            m = np.array(low, np.uint32).reshape(len(low), HASHES)
            with np.errstate(over="ignore"):
                one = ((m * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.int64)
                bits = one.reshape(len(m), -1, BATCH) @ (1 << np.arange(BATCH, dtype=np.int64))
                keys = (m.reshape(len(m), BANDS, ROWS).astype(np.uint64) * BAND_MIX).sum(axis=2, dtype=np.uint64)
                keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                keys = ((keys ^ (keys >> np.uint64(29))) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count, pa.int64()),
                    pa.array(digest, pa.binary()),
                    *(
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel())
                        )
                        for a in (bits, keys)
                    ),
                ],
                ["doc_id", "n_shingles", "digest", "bits", "bands"],
            )

    schema = "doc_id long, n_shingles long, digest binary, bits array<long>, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, schema)


def _alike(n1: str, bits1: str, n2: str, bits2: str, batches: int) -> Column:
    """Sizes allow the similarity, and no batch so far rules it out."""
    ratio = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT
    tests, equal = [ratio], F.lit(0)
    for k, least in enumerate(least_matches(HASHES // BATCH)[:batches]):
        differ = F.bit_count(F.col(bits1)[k].bitwiseXOR(F.col(bits2)[k]))
        equal = equal + BATCH - differ
        tests.append(equal >= least)
    return reduce(lambda a, b: a & b, tests)


def _screen(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the signature batches leave."""
    side = nodes.select("doc_id", "n_shingles", "bits")
    a, b = side.toDF("a", "na", "bits_a"), side.toDF("b", "nb", "bits_b")
    both = pairs.join(a, "a").join(b, "b")
    return both.filter(_alike("na", "bits_a", "nb", "bits_b", HASHES // BATCH)).select("a", "b").distinct()


def _texts(docs: DataFrame, ids: DataFrame, repeated: bool = False) -> DataFrame:
    """(id, text) of at least the wanted ids, before anything is shuffled; each text of an id once if ids are ``repeated``.

    A bitmap over hashes of the ids, of a fixed size, goes to all executors. It lets other texts pass
    where hashes meet, so a join with the ids still follows; it never holds a wanted one back.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER))
    placed = {"_word": F.floor(slot / 64).cast("int"), "_bit": (slot % 64).cast("int")}
    bitmap = ids.withColumns(placed).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    kept = texts.withColumns(placed).join(F.broadcast(bitmap), "_word")  # at most FILTER / 64 rows
    kept = kept.filter(F.expr("(shiftrightunsigned(_bits, _bit) & 1L) = 1L")).select("id", "text")
    return kept.distinct() if repeated else kept


def _verify(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, repeated: bool = False) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have the similarity."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), repeated)
    joined = (
        pairs.join(texts.toDF("a", "text_a"), "a")
        .join(texts.toDF("b", "text_b"), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), OrderedDict()  # sets of the last few hubs

        def full(key: int, text: str | None) -> np.ndarray:
            key = (key, text)  # a repeated id may stand for several texts
            if key not in held:
                held[key] = shingles(words.hashes(tokens(text)), shingle)
                if len(held) > 32:
                    held.popitem(last=False)
            return held[key]

        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(4)]
            keep = []
            for a, b, ta, tb in zip(*ids):
                sa, sb = full(a, ta), shingles(words.hashes(tokens(tb)), shingle)
                shared = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= PERCENT * (len(sa) + len(sb) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"]
            )

    return joined.mapInArrow(check, "a long, b long")


def _compare_tile(t: pa.Table, shingle: int = SHINGLE) -> pa.Table:
    """Links (a, b) between components within a tile; a few that join them, not all."""
    main, ids, part = (np.asarray(t[c]) for c in ("main", "id", "component"))
    bucket, lo, hi = np.asarray(t["bucket"]), int(t["lo"][0].as_py()), int(t["hi"][0].as_py())
    words = Words()
    sets = [shingles(words.hashes(tokens(x)), shingle) for x in t["text"].to_pylist()]
    n, low = np.array([len(s) for s in sets]), np.stack([sketch(s) for s in sets])
    open_ = (main[:, None] == main[None, :]) & (part[:, None] != part[None, :])
    open_ &= np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * PERCENT
    open_ &= (bucket[:, None] == lo) & (bucket[None, :] == hi) if lo != hi else ids[:, None] < ids[None, :]
    i, j = np.nonzero(open_)
    equal = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches(HASHES // BATCH, one_bit=False)):
        at = slice(k * BATCH, (k + 1) * BATCH)
        for c in range(0, len(i), 65_536):
            equal[c : c + 65_536] += (low[i[c : c + 65_536], at] == low[j[c : c + 65_536], at]).sum(axis=1)
        stay = equal >= least
        i, j, equal = i[stay], j[stay], equal[stay]
    root = {int(c): int(c) for c in part}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    a, b = [], []
    for x in np.argsort(-equal, kind="stable"):  # likely links first: later pairs may be joined by then
        ri, rj = find(int(part[i[x]])), find(int(part[j[x]]))
        if ri == rj:
            continue
        shared = len(np.intersect1d(sets[i[x]], sets[j[x]], assume_unique=True))
        if 100 * shared >= PERCENT * (n[i[x]] + n[j[x]] - shared):
            root[max(ri, rj)] = min(ri, rj)
            a.append(ids[i[x]])
            b.append(ids[j[x]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _join_open(
    rest: DataFrame, docs: DataFrame, stages: Stages, shingle: int = SHINGLE, repeated: bool = False
) -> DataFrame:
    """Links (a, b) between the components of each group ``main``: rows main, id, component.

    Groups of more than ``TILE`` members are cut into tiles of two buckets each; small groups share
    a tile. No pair of a group is left out, and at most the members of a tile leave it.
    """
    sizes = rest.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("buckets"))
    sizes = stages.write(sizes, "sizes")
    small = max(1, rest.join(sizes.filter("buckets = 1"), "main", "left_semi").count() // TILE)
    tiled = (
        rest.join(sizes, "main")
        .withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        .withColumns(
            {
                "lo": F.least("bucket", "other"),
                "hi": F.greatest("bucket", "other"),
                "big": F.col("buckets") > 1,
                "grp": F.when(F.col("buckets") > 1, F.col("main")).otherwise(F.pmod(F.xxhash64("main"), F.lit(small))),
            }
        )
        .select("big", "grp", "lo", "hi", "main", "id", "component", "bucket")
    )
    tiled = stages.write(tiled, "tiles")
    return (
        tiled.join(_texts(docs, tiled.select("id"), repeated), "id")
        .groupBy("big", "grp", "lo", "hi")
        .applyInArrow(lambda t: _compare_tile(t, shingle), "a long, b long")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of non-space characters with A-Z in lower case; a text's set holds its distinct
    shingles of ``shingle`` words, or its whole sequence if it has fewer words. Texts are read whole,
    whatever their length; an empty table has no rows. Texts without words (null, empty)
    have no set and link with nothing. Texts link with a Jaccard similarity of at least 0.8, on
    full sets of 64-bit fingerprints; ``component_id`` is the smallest doc_id reachable by links.
    Rows that repeat a doc_id are one node: they share its component, kept or not, and each of their
    different texts is compared once. Rows with a null id link with nothing, have no component and are kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "neardup")
    signed = stages.write(signatures(docs, shingle), "signatures")
    has_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    copies = stages.write(
        signed.filter(has_set)
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("digest", "rep"),
        "copies",
    )
    own = signed.withColumn("digest", F.when(has_set, F.col("digest")))
    # rows without words or id must not meet under one null key
    alone = own.filter(~has_set).withColumn("rep", F.col("doc_id"))
    nodes = own.filter(has_set).join(copies, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    columns = ["doc_id", "rep", "digest", "n_shingles", "bits", "bands"]
    nodes = stages.write(nodes.select(*columns).unionByName(alone.select(*columns)), "nodes")
    stages.drop(signed)
    reps = nodes.filter("doc_id = rep and n_shingles > 0")
    # rows of one id and text are one from here on; where no id is repeated nothing has to move for that
    repeated = not reps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()
    if repeated:
        reps = stages.write(reps.dropDuplicates(["doc_id", "digest"]), "representatives")

    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
    leaders = stages.write(leaders.filter("leader < last").select("key", "leader"), "leaders")
    live = stages.write(banded.join(leaders, "key").distinct() if repeated else banded.join(leaders, "key"), "buckets")

    stars = live.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    first = stages.write(_verify(stages.write(_screen(stars, reps), "stars"), docs, shingle, repeated), "links")

    joined = components(first, stages)
    placed = live.join(joined, F.col("id") == F.col("node"), "left").select(
        "key", "id", "leader", F.coalesce("component", "id").alias("component")
    )
    placed = stages.write(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("_n", "component")).alias("main"), F.count(F.lit(1)).alias("_parts")
    )
    parts = stages.write(parts.filter("_parts > 1").select("key", "main"), "open")
    rest = placed.join(parts, "key").select("main", "id", "component").distinct()
    second = stages.write(_join_open(stages.write(rest, "rest"), docs, stages, shingle, repeated), "more")
    if not second.isEmpty():
        joined = components(first.unionByName(second), stages)

    component = F.coalesce("component", "rep")
    return (
        nodes.select("doc_id", "n_shingles", "rep")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )
    )


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
