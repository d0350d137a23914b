"""Quality rules as a short-circuit cascade.

A rule reads a few measures of a text and says whether it fails. Measures build on each other (words,
then their number, then repeated windows), and a text pays for a measure once. On a sample every
measure is timed and every rule tried; rules are then ordered greedily by how many texts they
reject that no earlier rule has, per time for measures that no earlier rule has paid for. Each text
meets the rules in that order and stops at the first that it fails.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import batches_of, query, table

SAMPLE = 2000  # about so many texts are timed; they only order the rules
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUES = bytes(range(0x80, 0xC0))  # bytes that go on with a character
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    run = word
    for k in range(1, width):  # numbers of distinct runs stay below the number of words, so no product overflows
        run = np.unique(run[:-1] * len(numbers) + word[k:], return_inverse=True)[1]
    again = np.bincount(run)[run] >= 2
    inside = np.zeros(len(words) + 1, np.int64)
    inside[:-width][again] += 1
    ends = np.flatnonzero(again) + width
    np.add.at(inside, ends, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


# measure -> the measures it builds on and how; a text's bytes are "raw"
MEASURES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "words": (("raw",), bytes.split),
    "n_words": (("words",), len),
    "word_chars": (("raw",), lambda raw: len(raw.translate(None, SPACES + CONTINUES))),
    "n_symbols": (("raw",), lambda raw: len(raw) - len(raw.translate(None, SYMBOLS))),
    "lines": (("raw",), lambda raw: [x for x in raw.split(b"\n") if x.strip()]),
    "n_lines": (("lines",), len),
    "n_dup_lines": (("lines",), lambda lines: len(lines) - len(set(lines))),
    "n_repeat_words": (("words",), repeated_window_words),
    "n_letter_words": (("words",), lambda words: sum(1 for w in words if LETTER.search(w))),
    "n_top_word": (("words",), lambda words: max(Counter(words).values(), default=0)),
}


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` of the values of ``reads`` is true."""

    name: str
    reads: tuple[str, ...]
    fails: Callable[..., bool]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda again, n: 100 * again > 50 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda symbols, n: 10 * symbols > 3 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda chars, n: not 2 * n <= chars <= 20 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda again, n: 100 * again > 50 * n),
    Rule("few_letters", ("n_letter_words", "n_words"), lambda letters, n: 2 * letters < n),
    Rule("one_word", ("n_top_word", "n_words"), lambda most, n: 100 * most > 30 * n),
)


class Text:
    """Measures of one text, each taken when first asked for."""

    def __init__(self, text: str | None):
        self.held = {"raw": (text or "").encode()}

    def get(self, name: str):
        if name not in self.held:
            needs, take = MEASURES[name]
            self.held[name] = take(*map(self.get, needs))
        return self.held[name]

    def fails(self, rule: Rule) -> bool:
        return bool(rule.fails(*map(self.get, rule.reads)))


def _needed(names: Sequence[str], held: set[str]) -> set[str]:
    """Measures to be taken for ``names`` where ``held`` are there."""
    out: set[str] = set()
    for name in names:
        if name in MEASURES and name not in held:
            out |= {name} | _needed(MEASURES[name][0], held)
    return out


def order_rules(rules: Sequence[Rule], cost: dict[str, float], failed: np.ndarray) -> list[Rule]:
    """Greedy order: new rejections per cost of new measures, ``failed`` being texts x rules of a sample.

    Rules that reject nothing new come last, the cheapest first; ties go by name.
    """
    left, held, open_, out = dict(enumerate(rules)), set(), np.ones(len(failed), bool), []
    while left:

        def worth(i: int) -> tuple:
            price = 1.0 + sum(cost.get(m, 0.0) for m in _needed(left[i].reads, held))
            return -float((failed[:, i] & open_).sum()) / price, price, left[i].name

        best = min(left, key=worth)
        held |= _needed(left[best].reads, held)
        open_ &= ~failed[:, best]
        out.append(left.pop(best))
    return out


def estimate(docs: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Mean nanoseconds of each measure and which rules fail, on about ``sample`` texts spread over the table.

    Rows are picked by a hash of their place; whether a rule is tried early never changes a verdict.
    """
    rows = docs.count()
    every = max(1, -(-rows // sample))
    picked = docs.select("text").filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spent, failed = [], []
            for value in batch.column(0).to_pylist():
                text, took = Text(value), []
                for name in MEASURES:  # in an order in which all that a measure builds on is there
                    start = time.perf_counter_ns()
                    text.get(name)
                    took.append(time.perf_counter_ns() - start)
                spent.append(took), failed.append([text.fails(r) for r in rules])
            yield pa.RecordBatch.from_arrays(
                [pa.array(spent, pa.list_(pa.int64())), pa.array(failed, pa.list_(pa.bool_()))], ["spent", "failed"]
            )

    found = picked.mapInArrow(measure, "spent array<long>, failed array<boolean>").collect()  # about ``sample`` rows
    if not found:
        return {}, np.zeros((0, len(rules)), bool)
    mean = np.array([r["spent"] for r in found], float).mean(axis=0)
    return dict(zip(MEASURES, mean)), np.array([r["failed"] for r in found], bool)


def apply_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with kept, failed_rule (the rule that stopped a text, null if none) and the ``report`` measures.

    ``kept`` does not depend on the order of the rules; which of several failed rules is named does, and
    the order follows times measured in this run. Measures in ``report`` are taken of all texts, those
    that the cascade has taken only once.

    A null text is the empty one: it has no words and fails every rule that asks for some. Texts are
    read whole, whatever their length. Repeated rows and ids are judged row by row, an empty table
    stays empty, without rules all rows are kept. Columns of the result's names are replaced, all
    others stay.
    """
    spark = docs.sparkSession
    batches_of(spark)
    docs = docs.drop("kept", "failed_rule", *report)
    ordered = order_rules(rules, *estimate(docs, rules, sample)) if rules else []
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stopped, taken = [], [[] for _ in report]
            for value in batch.column(at).to_pylist():
                text = Text(value)
                stopped.append(next((r.name for r in ordered if text.fails(r)), None))
                for column, name in zip(taken, report):
                    column.append(text.get(name))
            failed = pa.array(stopped, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, failed.is_null(), failed, *(pa.array(c, pa.int64()) for c in taken)],
                [*batch.schema.names, "kept", "failed_rule", *report],
            )

    added = {"kept": F.lit(True), "failed_rule": F.lit(None).cast("string"), **{n: F.lit(0).cast("long") for n in report}}
    return docs.mapInArrow(judge, docs.withColumns(added).schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
spread AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM spread),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times >= 2) GROUP BY 1),
top AS (SELECT doc_id, max(n) AS n FROM (
          SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM w) GROUP BY ALL) GROUP BY 1),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, coalesce(top.n, 0) AS n_top,
         len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letters
  FROM w LEFT JOIN again USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 2 * n_letters < n_words OR 100 * n_top > 30 * n_words) AS kept
FROM m
"""


@query("op11_quality_rules", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return apply_rules(docs, report=report).select(
        "doc_id",
        *report,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        "kept",
    )
