"""Benchmark decontamination: a prefix-filtered containment join, DataFrame functions only.

Windows are 13 consecutive words of a benchmark item, or the whole of a shorter one. Their shingles
are ordered by how rare they are in the corpus. A window can stand in a text only where its
rarest shingle does, so that one (the prefix for full containment) is joined; length and position
bound where the item can lie around it. Only the item-sized stretches found so are verified: a run
of matching shingles as long as a window's is an occurrence if the words of text and item agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import LOWER, UPPER, query, table, words
from ledgerweave.operators.keyfilter import key_filter, may_match
from ledgerweave.session import Stages

WINDOW, SHINGLE = 13, 4


def _items(benchmark: DataFrame, shingle: int) -> DataFrame:
    """Items folded by their words: item, words, n, k (words of a shingle), ids."""
    w = benchmark.select(F.col("item_id").cast("string").alias("id"), words(F.col("text")).alias("words"))
    folded = w.filter(F.size("words") > 0).groupBy("words").agg(F.collect_list(F.coalesce("id", F.lit(""))).alias("ids"))
    return folded.select(
        F.xxhash64("words").alias("item"),
        "words",
        F.size("words").alias("n"),
        F.least(F.size("words"), F.lit(shingle)).alias("k"),
        "ids",
    )


def _gram(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, at + j) for j in range(k)], F.lit(k))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def contaminated_words(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (ids as strings), contaminated.

    A word is hit if it lies inside any occurrence of a window; a text is contaminated if at least
    a twentieth of its words is hit. Null or empty texts have no words, null or empty items no
    windows; an empty benchmark hits nothing. Items of the same words are looked for once and all
    their ids are listed (a null id as the empty string), sorted. Rows with equal or null ids
    keep rows of their own; other columns are ignored. Texts are read whole, in time linear in their length;
    an empty table of texts has no rows.

    One pass over the texts keeps the places of shingles that a filter of a fixed size over the items'
    shingles lets pass, to count them as well as to find them; what follows reads only these. A second
    pass takes the words of texts with matching runs of shingles, for the comparison.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "decontaminate")
    items = stages.write(_items(benchmark, shingle), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` numbers
    grams = stages.write(_places(items, sizes), "shingles")
    w = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("_id"),
        _digest(F.col("text")).alias("_digest"),
        words(F.col("text")).alias("w"),
    ).withColumn("n_words", F.size("w"))
    found = stages.write(_find(w, key_filter(grams, F.col("gram")), sizes), "places")

    # rarity in the corpus; a shingle that stands nowhere rules its windows out
    count = found.filter("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("corpus"))
    ordered = grams.join(count, "gram", "left").withColumn("corpus", F.coalesce("corpus", F.lit(0)))
    span = F.least(F.lit(window), F.col("n")) - F.col("k")  # a window starts at most so far before its last shingle
    starts = ordered.withColumn(
        "start", F.explode(F.sequence(F.greatest(F.col("at") - span, F.lit(0)), F.least("at", F.col("n") - F.col("k") - span)))
    )
    rarest = starts.groupBy("item", "start").agg(
        F.min_by(F.struct("gram", "at", "corpus"), F.struct("corpus", "at")).alias("p")
    )
    prefix = rarest.filter("p.corpus > 0").select("item", "p.gram", "p.at").distinct()
    places = found.filter("gram is not null").select("row", "gram", "pos", "n_words")
    bounds = items.select("item", "n", F.least(F.lit(window), F.col("n")).alias("size"), "k")
    candidates = (
        places.join(prefix.join(bounds, "item"), "gram")
        .withColumn("diagonal", F.col("pos") - F.col("at"))
        # the window around the prefix must lie within the text
        .filter((F.col("n_words") >= F.col("size")) & (F.col("diagonal") + F.col("n") >= F.col("size")))
        .filter(F.col("n_words") - F.col("diagonal") >= F.col("size"))
        .select("row", "item", "diagonal", "size", "k")
        .distinct()
    )
    # verify: the shingles of each candidate's stretch, where they should stand
    wanted = candidates.join(grams.select("item", "at", "gram"), "item").select(
        "row", "item", "diagonal", "size", "k", "gram", (F.col("diagonal") + F.col("at")).alias("pos")
    )
    kept = wanted.join(places.select("row", "pos", "gram"), ["row", "pos", "gram"])
    along = Window.partitionBy("row", "item", "diagonal").orderBy("pos")
    runs = (
        kept.withColumn("_run", F.col("pos") - F.row_number().over(along))
        .groupBy("row", "item", "diagonal", "size", "k", "_run")
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        .withColumn("end", F.col("hi") + F.col("k"))
        .filter(F.col("end") - F.col("lo") >= F.col("size"))
    )
    texts = found.filter("gram is null")
    runs = runs.join(texts.select("row", "digest"), "row").select("row", "digest", "item", "diagonal", "lo", "end")
    runs = stages.write(runs, "runs")
    runs = stages.write(runs.join(_same_words(runs, items, docs), ["digest", "item", "lo", "end"], "left_semi"), "verified")
    # words hit, each once: stretches in order, less what earlier ones cover
    before = Window.partitionBy("row").orderBy("lo", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    stretches = runs.select("row", "lo", "end").distinct().withColumn("_reached", reached)
    hits = stretches.groupBy("row").agg(
        F.sum(F.greatest(F.col("end") - F.greatest("lo", "_reached"), F.lit(0))).alias("n_hit")
    )
    named = (
        runs.select("row", "item")
        .distinct()
        .join(items.select("item", "ids"), "item")
        .groupBy("row")
        .agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("items"))
    )
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return (
        texts.select("row", F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"))
        .join(hits, "row", "left")
        .join(named, "row", "left")
        .select(
            id_col,
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def _places(items: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of every item: item, n, k, at, gram."""
    out = None
    for k in sizes or [1]:
        own = items.filter(F.col("k") == k).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - k)))
        own = own.select(
            "item",
            "n",
            "k",
            "at",
            _gram(F.col("words"), F.col("at"), k).alias("gram"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def _find(w: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """Places of shingles that may be known (row, gram, pos, n_words), and one row per text with its id, digest and no gram."""

    def rolling(k: int) -> Column:
        return F.transform("w", lambda a, i: F.when(i + k <= F.col("n_words"), _gram(F.col("w"), i, k)))

    text = F.array(F.lit(None).cast("long"))
    columns = ["row", "_id", "_digest", "n_words"]
    rolled = w.select(*columns, F.posexplode(F.concat(*map(rolling, sizes), text)).alias("slot", "gram"))
    # lists of one shingle per start follow each other, one per shingle size; the last slot stands for the text
    last = F.col("slot") == F.col("n_words") * len(sizes)
    kept = may_match(rolled, F.col("gram"), known, always=last)
    own = {name: F.when(last, F.col(f"_{name}")).alias(name) for name in ("id", "digest")}
    pos = F.when(~last, F.col("slot") % F.col("n_words"))
    return kept.select("row", own["id"], own["digest"], "gram", pos.alias("pos"), "n_words")


def _same_words(runs: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, item, lo, end) of the runs whose words are the item's; equal texts are compared once."""
    length = F.col("end") - F.col("lo")
    asked = runs.join(items.select("item", "words"), "item").select(
        "digest", "item", "lo", "end", F.slice("words", F.col("lo") - F.col("diagonal") + 1, length).alias("want")
    )
    asked = asked.groupBy("digest").agg(F.collect_set(F.struct("item", "lo", "end", "want")).alias("asked"))
    digest = _digest(F.col("text"))
    texts = may_match(docs.select("text"), digest, key_filter(asked, F.col("digest")))
    texts = texts.groupBy(digest.alias("digest")).agg(F.first(words(F.col("text"))).alias("w"))
    same = F.filter("asked", lambda r: F.slice(F.col("w"), r["lo"] + 1, r["end"] - r["lo"]) == r["want"])
    held = asked.join(texts, "digest").select("digest", F.explode(same).alias("r"))
    return held.select("digest", "r.item", "r.lo", "r.end")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS n, unnest([w[i + 1 : i + least(13, len(w))]
         FOR i IN range(0, len(w) - least(13, len(w)) + 1)]) AS x FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, w[i + 1 : i + n] AS x FROM (
    SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, i, win.n AS n FROM dw JOIN win ON dw.x = win.x AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
          SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
         SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op4_decontaminate", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated_words(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
