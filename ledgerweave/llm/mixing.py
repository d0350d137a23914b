"""Mixing sources to target weights by entropy balancing.

Rates ``exp(lambda_source * x)`` tilt the documents of a source until its expected tokens meet the
target; they are the rates closest to 1 in relative entropy (tokens as base measure, weighed by
1/x). Newton iterations solve the convex dual for all sources at once, each of them one Spark
aggregation. Rates then become whole copies: floor, and one more below a threshold on a hash of
the document, with the error of larger documents carried on to smaller ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import NOT_SPACE, query, table
from ledgerweave.operators.numbering import number_rows
from ledgerweave.session import Stages

WEIGHTS, LIMIT = (5.0, 2.0, 1.0), 3.0
BINS, TILT = 256, 1 / 32


def fill_level(sources: DataFrame, limit: float = LIMIT) -> float:
    """The level up to which ``weight`` fills all sources that ``limit`` times their ``size`` does not stop before.

    Targets ``min(limit * size, level * weight)`` add up to all sizes. Each round counts the sources below
    the level by their weight, exactly, and raises it by what those stopped leave over.
    """
    level, stopped = 0.0, -1
    while True:
        below = F.col("size") * limit < F.lit(level) * F.col("weight")
        rows = sources.groupBy("weight", below.alias("below")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        rows = rows.collect()  # two rows per weight
        count = sum(r["n"] for r in rows if r["below"])
        share = sum(r["weight"] * r["n"] for r in rows if not r["below"])
        if count == stopped or not share:
            return level
        rest = float(sum(r["size"] for r in rows)) - limit * sum(r["size"] for r in rows if r["below"])
        level, stopped = rest / share, count


def plan_copies(
    target: float, cells: Sequence[tuple[int, int, int, float]], limit: float
) -> list[tuple[int, int, int]]:
    """(octave, copies, cut of the hash) of each size class of one source, from its cells octave, bin, tokens, rate."""
    by_class: dict[int, list] = {}
    for octave, bin_, tokens, rate in sorted(cells):
        by_class.setdefault(octave, []).append((bin_, tokens, rate))
    held = {k: float(sum(t for _, t, _ in g)) for k, g in by_class.items()}
    expected = {k: g[0][2] * held[k] for k, g in by_class.items()}
    scale = target / total if (total := sum(expected.values())) else 0.0

    def settle(k: int, want: float) -> tuple[int, int, float]:
        rate = min(limit, max(0.0, want / held[k])) if held[k] else 0.0
        copies = min(int(math.floor(rate)), int(limit))
        extra, took, cut = (rate - copies) * held[k], 0.0, 0
        for bin_, tokens, _ in by_class[k]:
            if abs(took + tokens - extra) > abs(took - extra):
                break
            took, cut = took + tokens, bin_ + 1
        return copies, cut, copies * held[k] + took

    out, carry = [], 0.0
    for k in sorted(by_class, reverse=True):
        want = min(limit * held[k], expected[k] * scale) + carry
        copies, cut, took = settle(k, want)
        carry = want - took
        out.append([k, copies, cut, took])
    for row in reversed(out):  # what the smallest classes could not hold goes back up
        if abs(carry) < 1:
            break
        row[1], row[2], took = settle(row[0], row[3] + carry)
        carry += row[3] - took
        row[3] = took
    return [(k, copies, cut) for k, copies, cut, _ in out]


def mix(
    docs: DataFrame,
    size: Column | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    limit: float = LIMIT,
    iterations: int = 12,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    Sources in code-point order, null last, take the weights in turn, over and over. Sizes are
    runs of non-space characters, or ``size``. Null text has size 0 and no copies; an empty table
    stays empty. Repeated rows of one id get the same copies. Columns of the result's names are
    replaced. Decisions depend on id, size and source only, so reruns agree; documents whose hashes tie go
    together. Texts are counted whole, whatever their length. There may be any number of sources: all that
    is kept of them is a table.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "mix")
    n = size if size is not None else F.coalesce(F.regexp_count(F.col("text"), F.lit(NOT_SPACE)), F.lit(0))
    sized = docs.withColumns(
        {
            "mix_size": n.cast("long"),
            "_null": F.col(source_col).isNull(),
            "_source": F.coalesce(F.col(source_col), F.lit("")),
        }
    ).withColumns(
        {
            "_octave": F.when(F.col("mix_size") > 0, F.floor(F.log2(F.col("mix_size"))).cast("int")).otherwise(-1),
            "_bin": F.pmod(F.xxhash64(id_col, F.col("mix_size")), F.lit(BINS)).cast("int"),
        }
    )
    cells = stages.write(
        sized.groupBy("_null", "_source", "_octave", "_bin").agg(F.sum("mix_size").alias("tokens")), "histogram"
    )
    sources = cells.groupBy("_null", "_source").agg(F.sum("tokens").alias("size"))
    numbered = number_rows(sources, [F.col("_null"), F.col("_source")], "_number", "mix-sources")
    turn = F.col("_rank") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), turn.cast("int") + 1)
    ranked = numbered.withColumn("_rank", F.col("_number") - 1).withColumn("weight", weight).drop("_number")
    level = fill_level(ranked, limit)
    target = F.least(F.col("size") * F.lit(float(limit)), F.lit(level) * F.col("weight"))
    ranked = ranked.select("_null", "_source", "_rank", F.col("size").alias("_source_size"), target.alias("_target"))
    ranked = stages.write(ranked, "sources")

    x = 1 + F.greatest(F.col("octave"), F.lit(0)) * TILT
    classes = stages.write(
        cells.join(ranked, ["_null", "_source"]).select(F.col("_rank").alias("rank"), F.col("_target").alias("target"), F.col("_octave").alias("octave"), F.col("_bin").alias("bin"), "tokens"),
        "classes",
    )
    dual = classes.filter("tokens > 0").groupBy("rank", "target", "octave").agg(F.sum("tokens").alias("tokens"))
    dual = stages.write(dual, "dual")
    state = dual.select("rank").distinct().withColumn("lam", F.lit(0.0))
    for _ in range(iterations):
        pull = F.col("tokens") * F.exp(F.col("lam") * x)
        sums = dual.join(state, "rank").groupBy("rank", "target", "lam").agg(F.sum(pull).alias("f"), F.sum(pull * x).alias("d"))
        step = F.least(F.lit(2.0), F.greatest(F.lit(-2.0), (F.col("f") - F.col("target")) / F.col("d")))
        some = F.col("target") > 0
        moved = sums.select(
            "rank",
            F.when(some, F.col("lam") - step).otherwise(F.col("lam")).alias("lam"),
            F.when(some, F.abs(F.col("f") / F.col("target") - 1)).alias("off"),
        )
        state = stages.write(moved, "lambda")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < 1e-6:
            break
    lam = F.coalesce("lam", F.lit(0.0))  # a source without tokens has none
    rated = classes.join(state.select("rank", "lam"), "rank", "left").withColumn("rate", F.least(F.lit(float(limit)), F.exp(lam * x)))
    # at most BINS cells per power of two
    gathered = rated.groupBy("rank", "target").agg(F.collect_list(F.struct("octave", "bin", "tokens", "rate")).alias("cells"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rank, target, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = [(c["octave"], c["bin"], c["tokens"], c["rate"]) for c in held]
                out += [(rank, *row) for row in plan_copies(target, own, limit)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["_rank", "_octave", "_copies", "_cut"])

    plan = gathered.mapInArrow(settle, "_rank long, _octave int, _copies int, _cut int")
    plan = stages.write(plan, "copies")
    chosen = (
        sized.join(ranked, ["_null", "_source"])
        .join(plan, ["_rank", "_octave"], "left")
        .withColumns(
            {
                "mix_source_size": F.col("_source_size"),
                "mix_target": F.col("_target"),
                "mix_copies": F.when(
                    F.col("mix_size") > 0, F.col("_copies") + (F.col("_bin") < F.col("_cut")).cast("int")
                ).otherwise(0),
            }
        )
    )
    return chosen.select(*docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies").columns, "mix_size", "mix_source_size", "mix_target", "mix_copies")


@query("op2_mix_sources")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )
