"""Audit of how sources differ, by in-mapper stripes.

A task folds whole documents into stripes: per language and term, how many documents hold the term and
how often it stands in each source. A full table of stripes is handed on (spilled) and a new one
begun. Stripes are dealt by language and term, sorted and merged as they pass by, so one stripe is
in memory at a time. A pass over the merged stripes emits divergences: per term against the
language, and per pair of sources as sums that each task adds up before they move.

Shares are whole numbers of a thousand-millionth, so all sums are exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import LOWER, UPPER, batches_of, query, table
from ledgerweave.session import Stages

MIN_DOCS, TERM_RANKS, SCALE = 3, 200, 1_000_000_000
SPILL = 800_000  # entries of stripes that a task holds before it hands them on
ROWS = 20_000  # stripes that are handed on, or merged, at a time
BLOCK = 1_000_000  # cells of the tables that a task fills at a time
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
# letters in lower case, all other ASCII as a space, bytes of longer characters as they are
LETTERS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def _stripes(lang: pa.Array, term: pa.Array, df: np.ndarray, sources: pa.Array, counts: np.ndarray, size: np.ndarray) -> pa.Table:
    """Stripes of ``size`` entries each, the entries of all of them in a row."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.table(
        {
            "lang": lang,
            "term": term,
            "df": pa.array(df, pa.int64()),
            "sources": pa.ListArray.from_arrays(offsets, sources),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
        }
    )


def fold_stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """Unmerged stripes of text, lang, source rows; one without a term lists the sources a task has seen."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        holders: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, by_source in counts.items():
                names = pa.array(list(by_source), pa.string())
                found = list(by_source.values())
                terms = pa.array([t for c in found for t in c], pa.binary()).dictionary_encode()
                n = np.fromiter((x for c in found for x in c.values()), np.int64)
                source = np.repeat(np.arange(len(found)), [len(c) for c in found])
                at = terms.indices.to_numpy()
                order = np.argsort(at, kind="stable")
                held = holders[lang]
                df = np.fromiter(map(held.__getitem__, terms.dictionary.to_pylist()), np.int64, len(terms.dictionary))
                folded = _stripes(
                    pa.repeat(pa.scalar(lang), len(df)),
                    terms.dictionary.cast(pa.string()),
                    df,
                    names.take(pa.array(source[order])),
                    n[order],
                    np.bincount(at, minlength=len(df)),
                )
                seen = _stripes(pa.array([lang]), pa.nulls(1, pa.string()), [0], names, [0] * len(names), [len(names)])
                yield from seen.to_batches()
                yield from folded.to_batches(ROWS)

        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                terms = terms_of(text)
                in_source, in_lang = counts[lang][source], holders[lang]
                size -= len(in_source) + len(in_lang)
                in_source.update(terms), in_lang.update(set(terms))
                size += len(in_source) + len(in_lang)
                if size >= spill:
                    yield from emit()
                    counts.clear(), holders.clear()
                    size = 0
        yield from emit()

    plain = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return plain.mapInArrow(fold, STRIPE)


def _merged(t: pa.Table, last: bool, min_docs: int) -> tuple[pa.Table, pa.Table]:
    """Stripes of equal keys added up, and the rows of the last key, which go on unless ``last``."""
    lang, term = (pc.fill_null(t[c].combine_chunks(), "") for c in ("lang", "term"))  # no term is empty
    changed = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
    first = np.concatenate([[0], np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1])
    rest = t.slice(len(t) if last else first[-1])
    t, first = t.slice(0, len(t) - len(rest)), first if last else first[:-1]
    if not len(t):
        return t, rest
    key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
    size = pc.list_value_length(t["counts"]).to_numpy()
    source = pc.list_flatten(t["sources"]).combine_chunks().dictionary_encode()
    kinds = len(source.dictionary)
    code = np.repeat(key, size) * kinds + source.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    entry = np.flatnonzero(np.diff(code[order], prepend=-1))
    count = np.add.reduceat(pc.list_flatten(t["counts"]).to_numpy()[order], entry)
    at, name = np.divmod(code[order][entry], kinds)
    df = np.add.reduceat(t["df"].to_numpy(), first)
    heads = t.take(pa.array(first))
    keep = (df >= min_docs) | heads["term"].is_null().to_numpy()
    stays = keep[at]
    size = np.bincount(at[stays], minlength=len(df))[keep]
    whole = _stripes(
        heads["lang"].filter(pa.array(keep)),
        heads["term"].filter(pa.array(keep)),
        df[keep],
        source.dictionary.take(pa.array(name[stays])),
        count[stays],
        size,
    )
    return whole, rest


def merge_stripes(stripes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One stripe per language and term that stands in ``min_docs`` documents, and one without a term per language."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
            if rows >= ROWS:
                whole, rest = _merged(pa.concat_tables(held).combine_chunks(), False, min_docs)
                yield from whole.to_batches()
                held, rows = [rest], len(rest)
        if rows:
            yield from _merged(pa.concat_tables(held).combine_chunks(), True, min_docs)[0].to_batches()

    dealt = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(merge, STRIPE)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact also where the product needs more than 64 bits."""
    if len(count) and count.max() >= 2**63 // SCALE - 1:
        wide = 1 + SCALE * (count.astype(object) + 1) // total.astype(object)
        return wide.astype(np.int64)
    return 1 + SCALE * (count + 1) // total


class Sources:
    """What every task knows of a language: its sources in order, their totals and shares of an absent term."""

    def __init__(self, totals: dict[str, int], kept: int):
        self.names = sorted(totals, key=str.encode)
        self.at = {name: i for i, name in enumerate(self.names)}
        self.kept, self.size = kept, np.array([totals[n] + kept for n in self.names], np.int64)
        self.whole = np.array([sum(totals.values()) + kept], np.int64)
        self.absent = shares(np.zeros(len(self.names), np.int64), np.maximum(self.size, 1))

    def tiles(self) -> int:
        """Into how many parts the sources are cut, so that a part's pairs stay below ``BLOCK``."""
        return max(1, -(-(len(self.names) ** 2) // BLOCK))

    def tile(self, k: int) -> tuple[int, int]:
        step = -(-len(self.names) // self.tiles())
        return min(k * step, len(self.names)), min((k + 1) * step, len(self.names))


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, where ``at`` repeats."""
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        total[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def add_pairs(total: np.ndarray, lo: int, hi: int, of: Sources, term: np.ndarray, source: np.ndarray, share: np.ndarray) -> None:
    """Add to ``total`` (sources lo..hi x all sources) by how much a block of terms changes the sum of gaps

    against one in which no source has any of them; ``term`` numbers the block's terms from 0.
    """
    if not len(term):
        return
    table = np.repeat(of.absent[None], int(term.max()) + 1, axis=0)
    there = np.zeros(table.shape, bool)
    table[term, source], there[term, source] = share, True
    # the first source of the pair has the term: against all others, with and without it
    own = (source >= lo) & (source < hi)
    t, s, p = term[own], source[own], share[own][:, None]
    _add_rows(total, s - lo, gap(p, table[t]) - gap(of.absent[s][:, None], of.absent[None]))
    # only the second one has it
    absent = of.absent[None, lo:hi]
    change = gap(absent, share[:, None]) - gap(absent, of.absent[source][:, None])
    turned = np.zeros((len(of.names), hi - lo), np.int64)
    _add_rows(turned, source, np.where(there[term, lo:hi], 0, change))
    total += turned.T


def emit_divergences(stripes: DataFrame, known: dict[str, Sources]) -> DataFrame:
    """(part, lang, source, item, value) of merged stripes: whole for terms, parts of sums for pairs.

    The stripe without a term stands for all kept terms as if no source had them; every other one
    adds what it changes, so pairs that no kept term touches come out too.
    """
    spark = stripes.sparkSession
    shared = spark.sparkContext.broadcast(known)  # a number per source, far fewer than the pairs returned
    tiles = spark.createDataFrame(
        [(lang, k) for lang, of in known.items() for k in range(of.tiles())], "_lang string, tile int"
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, key, lo, hi, total, whole = None, None, 0, 0, None, False

        def out(part: str, sources: np.ndarray, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(part), n),
                    pa.repeat(pa.scalar(key[0]), n),
                    pa.array(of.names, pa.string()).take(pa.array(sources)),
                    items,
                    pa.array(values, pa.int64()),
                ],
                ["part", "lang", "source", "item", "value"],
            )

        def block(terms: pa.Array, size: np.ndarray, source: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Add some terms' stripes to the sums, and tell those terms that a source has more of."""
            term = np.repeat(np.arange(len(size)), size)
            share = shares(count, of.size[source])
            add_pairs(total, lo, hi, of, term, source, share)
            if key[1] == 0:
                in_lang = np.add.reduceat(count, np.cumsum(size) - size)  # a kept term has entries
                q = shares(in_lang, of.whole)[term]
                more = np.flatnonzero((count > 0) & (share > q))
                yield out("term", source[more], terms.take(pa.array(term[more])), gap(share, q)[more])

        def close() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            sums = total + of.kept * gap(of.absent[lo:hi, None], of.absent[None]) if whole else total
            told = np.ones(sums.shape, bool) if whole else sums != 0
            told[np.arange(hi - lo), np.arange(lo, hi)] = False
            one, other = np.nonzero(told)
            for i in range(0, len(one), BLOCK):
                a, b = one[i : i + BLOCK], other[i : i + BLOCK]
                yield out("pair", lo + a, pa.array(of.names, pa.string()).take(pa.array(b)), sums[a, b])

        for batch in batches:
            lang, tile = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            at = lang.indices.to_numpy()
            edges = np.flatnonzero(np.diff(at, prepend=-1) | (np.diff(tile, prepend=-1) != 0))
            for begin, end in zip(edges, np.append(edges[1:], batch.num_rows)):
                mine = (lang.dictionary[int(at[begin])].as_py(), int(tile[begin]))
                if mine != key:
                    yield from close()
                    key, of, whole = mine, shared.value[mine[0]], False
                    lo, hi = of.tile(key[1])
                    total = np.zeros((hi - lo, len(of.names)), np.int64)
                part = pa.Table.from_batches([batch.slice(begin, end - begin)])
                terms = part["term"].combine_chunks()
                none = terms.is_null()
                whole = whole or none.true_count > 0
                part, terms = part.filter(pc.invert(none)), terms.filter(pc.invert(none))
                size = pc.list_value_length(part["counts"]).to_numpy()
                named = pc.list_flatten(part["sources"]).combine_chunks().dictionary_encode()
                numbers = np.array([of.at[x] for x in named.dictionary.to_pylist()], np.int64)
                source = numbers[named.indices.to_numpy()] if len(named) else np.zeros(0, np.int64)
                count = pc.list_flatten(part["counts"]).to_numpy()
                # so many terms at a time that their tables of entries x sources stay below the block
                reach = np.cumsum(size) * len(of.names) // BLOCK
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(reach)) + 1, [len(size)]])
                ends = np.concatenate([[0], np.cumsum(size)])
                for i, j in zip(cuts[:-1], cuts[1:]):
                    if j > i:
                        inside = slice(ends[i], ends[j])
                        yield from block(terms.slice(i, j - i), size[i:j], source[inside], count[inside])
        yield from close()

    tiled = stripes.join(F.broadcast(tiles), F.col("lang") == F.col("_lang")).select(
        "lang", "tile", "term", "sources", "counts"
    )
    return tiled.sortWithinPartitions("lang", "tile").mapInArrow(
        emit, "part string, lang string, source string, item string, value long"
    )


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language lie apart.

    Part ``pair``: the divergence of a source from each other one of its language, all ranks; part ``term``:
    the terms that a source has more of than its language, the first ``term_ranks``. Rank counts from
    1 by falling value, ties by item in byte order.

    Null text, lang and source are read as empty, and an empty lang or source is one like any other. Texts are
    folded whole, whatever their length; a document counts once per row, repeated rows and ids too. A
    source without a kept term is still compared; a language with one source has no pairs. An empty
    table has no rows. Other columns are ignored.
    """
    batches_of(docs.sparkSession, 1024)  # texts at a time; stripes are merged in larger lots
    stages = Stages(docs.sparkSession, "divergence")
    merged = stages.write(merge_stripes(fold_stripes(docs), min_docs), "stripes")
    entry = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    totals = entry.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    kept = merged.groupBy("lang").agg(F.count("term").alias("v"))
    # a row per language and source; the pairs returned are their square
    by_lang: dict[str, dict[str, int]] = defaultdict(dict)
    for r in totals.collect():
        by_lang[r["lang"]][r["source"]] = r["n"]
    known = {r["lang"]: Sources(by_lang[r["lang"]], r["v"]) for r in kept.collect()}
    told = stages.write(emit_divergences(merged, known), "divergences")
    pairs = told.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    columns = ["lang", "source", "part", "item", "value"]
    terms = told.filter("part = 'term'").select(*columns).withColumn("rank", F.row_number().over(first))
    ranked = pairs.select(*columns).withColumn("rank", F.row_number().over(first))
    return ranked.unionByName(terms.filter(F.col("rank") <= term_ranks))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (
  SELECT g.lang, g.source, CAST(coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS HUGEINT) AS n
  FROM g),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (s.n + v.v) AS p
  FROM sized s JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (any_value(total) + any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM sized GROUP BY ALL) USING (lang) GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
told AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
WHERE part = 'pair' OR rank <= 200
"""


@query("op12_source_divergence", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))
