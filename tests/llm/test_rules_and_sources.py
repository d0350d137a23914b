"""Quality cascade, source divergences and importance resampling against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.verify import compare, connect
from ledgerweave.llm import divergence, importance, quality
from tests.llm.helpers import CLASH, by_id, docs_of, words

AWKWARD = [None, "", "   ", "...", "\n\t\n", "a", "É", "日本語 ñandú", "x" * 3000, "a\x00b a\x00b"]


# --- quality rules ----------------------------------------------------------------------
def plain_measures(text):
    text = text or ""
    w = [x for x in tokens_raw(text)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if tokens_raw(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def tokens_raw(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MANY = [
    *AWKWARD,
    "one two three " * 40,
    " ".join(f"w{i}" for i in range(80)),
    " ".join(f"w{i}### |" for i in range(60)),
    "\n".join(["same line here"] * 30 + [f"other line {i} of text" for i in range(20)]),
    " ".join(str(i) for i in range(100)),
    "a b c d e f a b c " + " ".join(f"q{i}" for i in range(60)),
    "the " * 40 + " ".join(f"w{i}" for i in range(60)),
    " ".join(f"wörd{i}" for i in range(200_000)),
]


def test_measures_and_verdicts_against_brute_force(spark):
    docs = docs_of(spark, MANY, clash=True).selectExpr("*", "'mine' AS kept", "1 AS n_words")
    out = quality.apply_rules(docs, report=REPORT)
    assert set(CLASH) <= set(out.columns) and out.columns.count("kept") == 1
    got = by_id(out)
    for i, text in enumerate(MANY):
        row = got[i][0]
        assert tuple(row[c] for c in REPORT) == plain_measures(text), i
        held = quality.Text(text)
        failed = [r.name for r in quality.RULES if held.fails(r)]
        assert row.kept == (not failed) and (row.failed_rule in failed or (row.failed_rule is None and not failed))
    assert got[11][0].kept and got[len(MANY) - 1][0].kept and not got[0][0].kept


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.integers(1, 4))
def test_repeated_windows_on_random_words(w, width):
    windows = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    inside = {i + j for i in range(len(w) - width + 1) if windows[tuple(w[i : i + width])] > 1 for j in range(width)}
    assert quality.repeated_window_words([x.encode() for x in w], width) == len(inside)


def test_rules_are_ordered_by_new_rejections_per_new_cost():
    rule = lambda name, *reads: quality.Rule(name, reads, lambda *x: False)
    rules = [rule("dear", "n_repeat_words"), rule("cheap", "n_words"), rule("same", "n_words"), rule("never", "n_symbols")]
    cost = {"words": 100.0, "n_words": 1.0, "n_repeat_words": 5000.0, "n_symbols": 10.0}
    failed = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [1, 0, 1, 0], [1, 0, 0, 0]], bool)
    assert [r.name for r in quality.order_rules(rules, cost, failed)] == ["cheap", "same", "dear", "never"]
    # one that rejects all at once comes first where it costs no more
    assert quality.order_rules(rules, cost | {"n_repeat_words": 0.0}, failed)[0].name == "dear"
    assert [r.name for r in quality.order_rules(rules, {}, np.zeros((0, 4), bool))] == ["cheap", "dear", "never", "same"]


def test_a_text_stops_at_its_first_failed_rule(spark):
    calls = []
    rules = [
        quality.Rule("first", ("n_words",), lambda n: n < 50),
        quality.Rule("second", ("n_repeat_words",), lambda n: calls.append(n) or 1 / 0),
    ]
    text = quality.Text("few words")
    assert next(r.name for r in rules if text.fails(r)) == "first" and not calls
    assert "n_repeat_words" not in text.held


def test_quality_of_repeated_ids_empty_tables_and_no_rules(spark):
    df = docs_of(spark, ["x", "x", None], ids=[4, 4, None])
    assert [r.kept for r in quality.apply_rules(df).collect()] == [False] * 3
    assert all(r.kept and r.failed_rule is None for r in quality.apply_rules(df, rules=()).collect())
    assert quality.apply_rules(df.limit(0), report=REPORT).collect() == []


# --- source divergence ------------------------------------------------------------------
def plain_audit(rows, min_docs=3, ranks=200):
    """rows of (text, lang, source) -> set of (lang, source, part, item, value, rank)."""
    by_lang = defaultdict(list)
    for text, lang, source in rows:
        by_lang[lang or ""].append((divergence_terms(text), source or ""))
    out = set()
    for lang, docs in by_lang.items():
        df = Counter(t for w, _ in docs for t in set(w))
        kept = [t for t in df if df[t] >= min_docs]
        count = defaultdict(Counter)
        for w, s in docs:
            count[s].update(t for t in w if df[t] >= min_docs)
        whole = sum(count.values(), Counter())
        v = len(kept)

        def share(c):
            n = sum(c.values())
            return {t: 1 + math.floor(Fraction(10**9 * (c[t] + 1), n + v)) for t in kept}

        p, q = {s: share(count[s]) for s in {s for _, s in docs}}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)}
    return out


def divergence_terms(text):
    import re

    return [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def audit(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for c in CLASH:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return {tuple(r) for r in divergence.audit_sources(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()}


def some_rows(seed, n, sources=5):
    rng = random.Random(seed)
    vocabulary = ["The", "a", "É", "日本", "zebra", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(n):
        s = rng.choice([None, "", *(f"s{k}" for k in range(sources))])
        start = 0 if s is None else (len(s) * 7 + sum(map(ord, s))) % 10
        text = " ".join(rng.choice(vocabulary[start : start + 12]) + rng.choice(["", "1", "-"]) for _ in range(rng.randint(0, 30)))
        rows.append((None if i % 17 == 0 else text, rng.choice([None, "", "en", "en", "de"]), s))
    return [*rows, ("only here", "xx", "lone"), ("   ", "yy", "p"), (None, "yy", "q")]


@pytest.mark.parametrize("spill", [1, divergence.SPILL])
def test_divergences_against_brute_force(spark, monkeypatch, spill):
    rows = some_rows(3, 150)
    monkeypatch.setattr(divergence.fold_stripes, "__defaults__", (spill,))
    assert audit(spark, rows) == plain_audit(rows)


def test_divergences_in_small_blocks_and_tiles(spark):
    rows = some_rows(5, 80, sources=9)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    merged = divergence.merge_stripes(divergence.fold_stripes(df))
    stripes = [r for r in merged.collect() if r.lang == "en"]
    totals = Counter()
    for r in stripes:
        totals.update({s: 0 for s in r.sources} | dict(zip(r.sources, r.counts)))
    of = divergence.Sources(dict(totals), sum(r.term is not None for r in stripes))
    want = {(s, i): v for lang, s, part, i, v, _ in plain_audit(rows) if (lang, part) == ("en", "pair")}
    kept = [r for r in stripes if r.term is not None]
    got = {}
    for lo in range(0, len(of.names), 2):  # tiles of two sources, blocks of three terms
        hi = min(lo + 2, len(of.names))
        total = of.kept * divergence.gap(of.absent[lo:hi, None], of.absent[None])
        for b in range(0, len(kept), 3):
            block = [(i, of.at[s], n) for i, r in enumerate(kept[b : b + 3]) for s, n in zip(r.sources, r.counts)]
            term, source, count = (np.array(x, np.int64) for x in zip(*block))
            divergence.add_pairs(total, lo, hi, of, term, source, divergence.shares(count, of.size[source]))
        got |= {(of.names[lo + i], of.names[j]): int(total[i, j]) for i in range(hi - lo) for j in range(len(of.names)) if lo + i != j}
    assert got == want


def test_shares_beyond_64_bits_are_exact():
    count, total = np.array([10**13, 3], np.int64), np.array([3 * 10**13, 7], np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (10**13 + 1) // (3 * 10**13), 1 + 4 * 10**9 // 7]


def test_divergence_of_an_empty_table_long_texts_and_top_ranks(spark):
    assert audit(spark, []) == set()
    long = " ".join("ab cd".split() * 100_000)
    rows = [(long, "en", "a"), ("ab cd ef", "en", "b"), ("ab cd ef", "en", "b"), ("ef", "en", "a"), ("ef ef", "en", "b")]
    assert audit(spark, rows) == plain_audit(rows)
    rows = some_rows(9, 120)
    assert audit(spark, rows, min_docs=1, term_ranks=2) == plain_audit(rows, 1, 2)


# --- importance resampling --------------------------------------------------------------
def plain_resample(docs, target, longest, buckets, min_words, percent, seed="2024"):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)}
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    enough = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0], -r[3], -r[2]))
    for i, r in enumerate(enough, 1):
        r.append(i if i <= len(enough) * percent // 100 else None)
    return sorted((tuple(r if len(r) == 6 else [*r, None]) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_against_brute_force(spark, longest):
    rng = random.Random(longest)
    make = lambda n: " ".join(rng.choice(["The", "a-b", "É", "日本", "z9", "q"]) for _ in range(n))
    texts = [*AWKWARD, *(make(rng.randint(0, 40)) for _ in range(120)), make(50_000)]
    ids = [*range(len(texts) - 4), 7, 7, None, None]
    target = [make(30), None, "", "z9 z9 z9 q"]
    df = docs_of(spark, texts, clash=True, ids=ids)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = importance.resample(df, bench, longest=longest, buckets=97, min_words=5, percent=30)
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert got.columns == columns
    want = plain_resample(list(zip(ids, texts)), target, longest, 97, 5, 30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_resampling_ties_and_empty_tables(spark):
    same = docs_of(spark, ["one two"] * 50, ids=[3] * 50)
    bench = spark.createDataFrame([], "text string")
    got = importance.resample(same, bench, min_words=1, percent=20).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11)) and len({r.score for r in got}) == 1
    assert importance.resample(same.limit(0), bench).collect() == []
    assert all(r.rank is None for r in importance.resample(same, bench).collect())  # too short to be drawn


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_source_divergence", "op13_importance_resample"])
def test_queries_against_sql(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), sf_dir, name)
    assert ok, note


