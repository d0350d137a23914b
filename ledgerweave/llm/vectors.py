"""Embedding near-duplicates by sorted projection passes.

In each pass the vectors of a label are ordered by the concatenated signs of random projections,
and each is compared with its neighbours up to ``window`` places away. The ranks of all passes
travel with a vector, so a pair that an earlier pass has compared is known without listing any pairs:
counts and a spanning forest of the links leave a block, never the links themselves.

Equal vectors of a label are folded to one of a weight before that. Where a window is dense with
links, or its edges share so many signs with a vector that the passes would miss too many of its
links, there can be more beyond it. Such vectors are compared with all others of their label, tile by
tile, but for those that the triangle inequality rules out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import batches_of, query, table
from ledgerweave.llm.graph import components
from ledgerweave.session import Stages

COSINE, PASSES, WINDOW, BITS = 0.98, 8, 256, 62
DENSE, TILE = 0.5, 1024
MISS = 0.05  # chance that no pass compares a link at the bound; vectors above are compared in full
PIVOTS, SPREAD, REACH = 1024, 0.4, 0.6  # cells of the full comparison: they decide its cost, not its result
LINK_SCHEMA = "uid long, id long, rep long, n long, dense boolean"
BLOCK_SCHEMA = LINK_SCHEMA + ", pass int, shared int"


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _join_locally(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component in a block's link matrix."""
    rep = ids.copy()
    while True:
        least = np.where(linked, rep[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(rep, least)
        if (new == rep).all():
            return rep
        rep = new


def _compare_block(t: pa.Table, cosine: float, window: int) -> pa.Table:
    """A block of one pass with the block behind it (``ahead``): links not compared by earlier passes.

    ``shared`` is how many leading signs a vector shares with the one ``window`` places behind (own
    block) or before it (``ahead``), null where that one is of another label.
    """
    order = np.argsort(np.asarray(t["rank"]), kind="stable")
    t = t.take(pa.array(order))
    ids, ranks = np.asarray(t["id"]), np.array(t["ranks"].to_pylist(), np.int64)
    group, own, p = np.asarray(t["grp"]), ~np.asarray(t["ahead"]), int(t["pass"][0].as_py())
    weight, key = np.asarray(t["w"]), np.asarray(t["key"])
    near = np.zeros((len(ids), len(ids)), bool)
    for g in np.unique(group):  # vectors of one label and dimension
        rows = np.flatnonzero(group == g)
        x = _unit(_matrix(t["embedding"].take(pa.array(rows))))
        near[np.ix_(rows, rows)] = x @ x.T >= cosine
    apart = np.abs(ranks[:, None, p] - ranks[None, :, p])
    near &= (apart > 0) & (apart <= window) & (own[:, None] | own[None, :])
    first = near.copy()
    for q in range(p):
        first &= np.abs(ranks[:, None, q] - ranks[None, :, q]) > window
    n, seen = first @ weight, near.sum(axis=1)
    at = np.flatnonzero(own)
    edge = at + window  # ranks have no gaps
    at, edge = at[edge < len(ids)], edge[edge < len(ids)]
    at, edge = at[group[at] == group[edge]], edge[group[at] == group[edge]]
    bits = (key[at] ^ key[edge])[:, None] >> np.arange(BITS, dtype=np.int64)
    shared = np.full(len(ids), -1)
    shared[at] = shared[edge] = (bits == 0).sum(axis=1)
    keep = (seen > 0) | (shared >= 0)
    found = _found(np.asarray(t["uid"])[keep], ids[keep], _join_locally(near, ids)[keep], n[keep], seen[keep] >= DENSE * window)
    found = found.append_column("pass", pa.array(np.full(keep.sum(), p, np.int32)))
    return found.append_column("shared", pa.array(shared[keep].astype(np.int32), mask=shared[keep] < 0))


def _found(uid, ids, rep, n, dense) -> pa.Table:
    """Rows with their component's smallest id in this block, new links, whether links crowd it."""
    n = pa.array(n.astype(np.int64))
    return pa.table({"uid": pa.array(uid), "id": pa.array(ids), "rep": pa.array(rep), "n": n, "dense": pa.array(dense)})


def _compare_tile(t: pa.Table, cosine: float, window: int) -> pa.Table:
    """Crowded vectors (``left``) with others of their cell: links that no pass has compared.

    A crowded vector on the right counts its links where it stands on the left.
    """
    side = np.asarray(t["left"])
    lhs, rhs = t.filter(pa.array(side)), t.filter(pa.array(~side))
    if not len(lhs) or not len(rhs):
        return _found(*(np.zeros(0, np.int64),) * 4, np.zeros(0, bool))
    uid, ids = np.asarray(lhs["uid"]), np.asarray(lhs["id"])
    new = _unit(_matrix(lhs["embedding"])) @ _unit(_matrix(rhs["embedding"])).T >= cosine
    new &= uid[:, None] != np.asarray(rhs["uid"])[None, :]
    ranks = [np.array(x["ranks"].to_pylist(), np.int64) for x in (lhs, rhs)]
    for q in range(ranks[0].shape[1]):
        new &= np.abs(ranks[0][:, None, q] - ranks[1][None, :, q]) > window
    n = np.concatenate([new @ np.asarray(rhs["w"]), (new.T @ np.asarray(lhs["w"])) * ~np.asarray(rhs["crowded"])])
    linked = np.concatenate([new.any(axis=1), new.any(axis=0)])
    whole = np.zeros((len(linked), len(linked)), bool)
    whole[: len(ids), len(ids) :], whole[len(ids) :, : len(ids)] = new, new.T
    both = np.concatenate([ids, np.asarray(rhs["id"])])
    rep, uid = _join_locally(whole, both), np.concatenate([uid, np.asarray(rhs["uid"])])
    return _found(uid[linked], both[linked], rep[linked], n[linked], np.zeros(linked.sum(), bool))


def _cells(crowd: DataFrame, placed: DataFrame, cosine: float) -> DataFrame:
    """Crowded vectors (``left``) and all that may link with them, by the cells they meet in.

    A crowded vector belongs to its nearest pivot, if one is within ``REACH``; every vector goes to
    the pivots whose farthest member it may link with. The rest of a label is a cell of its own.
    """
    spark = crowd.sparkSession
    picked = crowd.select("uid", "grp", "embedding").orderBy(F.xxhash64("uid"), "uid").limit(PIVOTS).collect()
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["grp"] for r in picked}:
        rows = [i for i, r in enumerate(picked) if r["grp"] == g]
        x, apart = _unit(np.array([picked[i]["embedding"] for i in rows], np.float64)), []
        for i in range(len(rows)):  # pivots of one clump would all get all of it
            if not apart or (2 - 2 * (x[apart] @ x[i])).min() > SPREAD**2:
                apart.append(i)
        pivots[g] = np.array(rows)[apart], x[apart]
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors
    fields = [f for f in placed.schema.fields if f.name != "keys"]
    names = [f.name for f in fields]
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def distances(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        group, vectors = np.asarray(batch.column(names.index("grp"))), batch.column(names.index("embedding"))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            if g not in shared.value:
                yield rows, None, None
                continue
            which, p = shared.value[g]
            x = _unit(_matrix(pa.chunked_array([vectors.take(pa.array(rows))])))
            yield rows, which, np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, reach = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for rows, which, d in distances(batch):
                if d is not None:
                    best, reach[rows] = d.argmin(axis=1), d.min(axis=1)
                    cell[rows] = np.where(d.min(axis=1) <= REACH, which[best], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach)], [*names, "cell", "reach"])

    left = crowd.select(*names).mapInArrow(assign, f"{base}, cell int, reach double")
    left = left.withColumns({"left": F.lit(True), "crowded": F.lit(True)})
    radius = {r["cell"]: r["r"] for r in left.filter("cell >= 0").groupBy("cell").agg(F.max("reach").alias("r")).collect()}
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for rows, which, d in distances(batch):
                if d is not None:
                    r, c = np.nonzero(d <= np.array([radius.get(int(k), -1.0) + eps for k in which])[None, :])
                    used = np.array([int(k) in radius for k in which])[c]
                    at.append(rows[r[used]]), cell.append(which[c[used]].astype(np.int32))
            at, cell = pa.array(np.concatenate(at)), pa.array(np.concatenate(cell))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), cell], [*names, "cell"])

    rest = left.filter("cell < 0").select("grp").distinct().withColumn("cell", F.lit(-1))
    everyone = placed.select(*names)
    right = everyone.mapInArrow(send, f"{base}, cell int").unionByName(everyone.join(rest, "grp"))
    right = right.join(crowd.select("uid", F.lit(True).alias("crowded")), "uid", "left")
    right = right.withColumns({"left": F.lit(False), "crowded": F.coalesce("crowded", F.lit(False))})
    return left.drop("reach").unionByName(right)


def link_vectors(
    vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of one label and dimension are compared, by cosine in double precision. Vectors
    with a null id or label, and those that are null, empty, zero or hold null or non-finite
    components, link with nothing. ``n_links`` counts the other rows linked with a row; repeated
    rows are vectors of their own that share their id's component. ``component_id`` is the smallest
    vec_id reachable, a null id keeps null and is kept. Magnitudes do not matter, however large or
    small; an empty table has no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "vectors")
    batches_of(spark, 2048)
    e = F.col("embedding").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(e, lambda v: v != 0)
    )
    fine = F.coalesce(fine, F.lit(False))
    # a power of two changes no digit and no cosine, and keeps squares from overflowing or vanishing
    largest = F.array_max(F.transform(e, F.abs))
    scaled = F.transform(e, lambda v: v / F.pow(F.lit(2.0), F.floor(F.log2(largest))))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("id"),
        F.when(fine, scaled).alias("embedding"),
        F.when(fine, F.xxhash64(F.col("label").cast("string"), F.size("embedding"))).alias("grp"),
    )
    rows = stages.write(rows, "rows")
    # equal vectors become one, of a weight; the packed key lets a hot vector's rows be split
    base = stages.write(
        rows.filter("grp is not null")
        .groupBy("grp", "embedding")
        .agg(F.min("uid").alias("uid"), F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
        .select("uid", "id", "embedding", "grp", "w"),
        "folded",
    )
    copied = base.filter("w > 1").select(
        F.struct("grp", "embedding").alias("_of"), F.col("uid").alias("fold"), F.col("id").alias("least"), F.col("w").alias("copies")
    )
    folded = stages.write(
        rows.withColumn("_own", F.when(F.col("grp").isNotNull(), F.struct("grp", "embedding")))
        .join(copied, F.col("_own") == F.col("_of"), "left")
        .select("id", F.coalesce("fold", "uid").alias("fold"), "least", (F.coalesce("copies", F.lit(1)) - 1).alias("equal")),
        "members",
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size, keys = np.diff(np.asarray(lists.offsets)), np.zeros((batch.num_rows, passes), np.int64)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = np.asarray(lists.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), d)
                planes = np.random.default_rng([97, int(d)]).normal(size=(int(d), passes * BITS))
                bits = (x @ planes > 0).reshape(len(rows), passes, BITS).astype(np.int64)
                keys[rows] = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, passes), pa.int32()), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, keys], ["uid", "id", "embedding", "grp", "w", "keys"]
            )

    base = stages.write(
        base.mapInArrow(project, "uid long, id long, embedding array<double>, grp long, w long, keys array<long>"), "vectors"
    )
    # one range sort orders all passes
    keyed = base.select("uid", "grp", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "grp", "key", "uid"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                ["uid", "pass", "part", "at"],
            )
            at += n

    sorted_keys = keyed.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    places = stages.write(sorted_keys.mapInArrow(number, "uid long, pass int, part int, at long"), "places")
    sizes = {r["part"]: r["n"] for r in places.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))  # one row per partition
    ranks = (
        places.join(offset, "part")
        .withColumn("rank", F.col("at") + F.col("before"))
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("pass", "rank"))).alias("r"))
        .select("uid", F.col("r.rank").alias("ranks"))
    )
    placed = stages.write(base.join(ranks, "uid"), "placed")
    own = placed.select("*", F.posexplode("ranks").alias("pass", "rank"))
    own = own.withColumns({"block": F.floor(F.col("rank") / window), "key": F.element_at("keys", F.col("pass") + 1)}).drop("keys")
    sent = own.select(
        "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("ahead")
    ).withColumn("block", F.col("block") - F.col("ahead").cast("int"))
    compared = sent.groupBy("pass", "block").applyInArrow(
        lambda t: _compare_block(t, cosine, window), BLOCK_SCHEMA
    )
    found = stages.write(compared, "links")

    # a link at the bound that shares more signs than the window's edges is inside the window
    same = 1 - float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    seen = F.when(F.col("shared") < BITS, F.pow(F.lit(same), F.col("shared") + 1)).otherwise(0.0)
    missed = (
        found.filter("shared is not null")
        .groupBy("uid", "pass")
        .agg(F.max("shared").alias("shared"))
        .groupBy("uid")
        .agg(F.count(F.lit(1)).alias("k"), F.sum(F.log(F.greatest(1 - seen, F.lit(1e-12)))).alias("miss"))
        .filter((F.col("k") == passes) & (F.col("miss") > float(np.log(MISS))))
    )
    heavy = placed.filter(F.col("w") > DENSE * window)  # copies that would fill half a window with links
    crowded = found.filter("dense").select("uid").unionByName(missed.select("uid")).unionByName(heavy.select("uid")).distinct()
    crowd = stages.write(placed.join(crowded, "uid", "left_semi"), "dense")
    met = stages.write(_cells(crowd, placed, cosine), "cells")
    sizes = met.groupBy("grp", "cell").agg(
        F.ceil(F.count_if("left") / TILE).cast("int").alias("lefts"),
        F.ceil(F.count_if(~F.col("left")) / TILE).cast("int").alias("rights"),
    )
    mine, others = F.when(F.col("left"), F.col("lefts")).otherwise(F.col("rights")), F.when(F.col("left"), F.col("rights")).otherwise(F.col("lefts"))
    tiled = (
        met.join(F.broadcast(sizes), ["grp", "cell"])  # PIVOTS cells and one for each crowded label
        .withColumn("bucket", F.pmod(F.xxhash64("uid"), mine).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .withColumns({"lo": F.when(F.col("left"), F.col("bucket")).otherwise(F.col("other")), "hi": F.when(F.col("left"), F.col("other")).otherwise(F.col("bucket"))})
    )
    tiles = tiled.groupBy("grp", "cell", "lo", "hi").applyInArrow(lambda t: _compare_tile(t, cosine, window), LINK_SCHEMA)
    found = found.drop("pass", "shared").unionByName(stages.write(tiles, "tiles"))

    edges = found.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    copies = folded.filter("least is not null").select(F.col("id").alias("a"), F.col("least").alias("b"))
    joined = components(edges.unionByName(copies), stages)
    counted = found.groupBy("uid").agg(F.sum("n").alias("n")).filter("n > 0").select(F.struct("uid").alias("_of"), "n")
    component = F.coalesce("component", "id")
    return (
        folded.withColumn("_own", F.struct(F.col("fold").alias("uid")))
        .join(counted, F.col("_own") == F.col("_of"), "left")
        .join(joined, F.col("id") == F.col("node"), "left")
        .select(
            F.col("id").alias("vec_id"),
            (F.coalesce("n", F.lit(0)) + F.col("equal")).cast("long").alias("n_links"),
            component.cast("long").alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
    )


@query("op9_embedding_links")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
