"""Licences, token counts, mixing, contamination and language model against plain versions."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.verify import compare, connect
from ledgerweave.llm import contamination, licenses, lm, mixing
from ledgerweave.llm import tokens as pieces
from tests.llm.helpers import by_id, docs_of, tokens, words

AWKWARD = [None, "", "   ", "...", "\n\t", "a", "É", "MİT License"]
NOTICE = licenses.NOTICES[0][1]


def plain_places(text):
    w, out = words(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


def test_licences_against_brute_force(spark):
    texts = [
        *AWKWARD,
        "Released under the MIT License.",
        "mit-license MIT  license, apache license; GENERAL public License general public",
        "the mit " * 50 + "license " * 3,
        "word " * 5000 + "Apache License",
        f"intro {NOTICE} outro",
        "Released under the MIT License.",
    ]
    got = by_id(licenses.scan_licenses(docs_of(spark, texts, clash=True)))
    for i, text in enumerate(texts):
        n, places = plain_places(text)
        starts, (row,) = [p for p, _ in places], got[i]
        assert (row.n_words, row.n_base) == (n, len(places))
        assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert got[12][0].labels == "mit" and got[12][0].base_labels == "" and got[12][0].score == 1.0


def test_notice_with_changed_words_is_merged_over_neighbouring_diagonals(spark):
    w = NOTICE.split()
    changed = " ".join(w[:10] + ["extra"] + w[10:20] + w[21:])
    half = " ".join(w[:8])
    row, few = (by_id(licenses.scan_licenses(docs_of(spark, [changed, half])))[i][0] for i in (0, 1))
    assert row.labels == "mit" and 0.6 <= row.score < 1 and len(row.spans) == 1
    assert few.labels == "" and few.score == 0


def test_repeated_and_null_ids_keep_their_rows(spark):
    df = docs_of(spark, ["mit license", "mit license", "x", None], ids=[5, 5, None, None])
    got = by_id(licenses.scan_licenses(df))
    assert [r.n_base for r in got[5]] == [1, 1] and sorted(r.n_words for r in got[None]) == [0, 1]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert len(pieces.count_tokens(df).collect()) == 4 and pieces.count_tokens(df.limit(0)).count() == 0


VOCAB_START, VOCAB_INNER = pieces.read_vocabulary()


def greedy(word):
    i = n = 0
    voc = VOCAB_START
    while i < len(word):
        j = min(len(word), i + 128)
        while word[i:j] not in voc:
            j -= 1
        i, n, voc = j, n + 1, VOCAB_INNER
    return n


def test_piece_counts_equal_greedy_matching(spark):
    texts = [*AWKWARD, "the quick brown fox", "antidisestablishmentarianism " * 3, "x" * 5000, "日本語 ñandú", "a\x0bb\x0cc d"]
    got = by_id(pieces.count_tokens(docs_of(spark, texts, clash=True)))
    for i, text in enumerate(texts):
        w = (text or "").encode().split()
        assert (got[i][0].n_words, got[i][0].n_tokens) == (len(w), sum(map(greedy, w)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdethi ngé", max_size=40))
def test_automaton_on_random_words(text):
    import numpy as np

    automaton = test_automaton_on_random_words.__dict__.setdefault("a", pieces.Automaton(VOCAB_START, VOCAB_INNER))
    w = text.encode().split()
    length = np.array([len(x) for x in w], np.int64)
    data = np.frombuffer(b"".join(w), np.uint8)
    assert automaton.count(data, np.cumsum(length) - length, length).tolist() == [greedy(x) for x in w]
    assert [automaton._one(np.frombuffer(x, np.uint8)) for x in w] == [greedy(x) for x in w]


def water_fill(sizes, weights, limit=3.0):
    """Targets by weight, none above the limit, source by source."""
    targets, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        per = rest / sum(weights[i] for i in free)
        over = {i for i in free if per * weights[i] > limit * sizes[i]}
        for i in over or free:
            targets[i] = limit * sizes[i] if over else per * weights[i]
        rest -= sum(targets[i] for i in over)
        free = free - over if over else set()
    return targets


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [0, 0], [1, 2, 3, 4, 5, 6, 10_000], [5], [7, 7, 0, 100, 1, 1, 1, 50]])
def test_fill_level_reshares_what_is_over_the_limit(spark, sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(sizes, weights)), "size long, weight double")
    level = mixing.fill_level(df)
    got = [min(3.0 * n, level * w) for n, w in zip(sizes, weights)]
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9) for a, b in zip(got, water_fill(sizes, weights)))


def test_mix_of_very_many_sources(spark):
    n = 150_000
    docs = spark.range(0, n + 1000, 1, 8).selectExpr(
        "id AS doc_id", "repeat('w ', int(1 + id % 13)) AS text", "concat('host', lpad(least(id, 150000), 7, '0')) AS source"
    )
    got = mixing.mix(docs).agg({"mix_size": "sum", "mix_target": "sum", "mix_copies": "max", "doc_id": "count"}).collect()[0]
    taken = mixing.mix(docs).selectExpr("sum(mix_size * mix_copies) AS t").collect()[0].t
    assert got["count(doc_id)"] == n + 1000 and got["max(mix_copies)"] <= 3 and taken > 0
    per = mixing.mix(docs).filter("doc_id in (5, 6, 7)").orderBy("doc_id").collect()
    assert all(r.mix_target <= 3 * r.mix_source_size + 1e-9 for r in per)


def test_mix_meets_targets_and_limits(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), f"s{i % 5}" if i % 11 else None) for i in range(3000)]
    rows += [(9000, None, "s0"), (9001, "", "s1"), (None, "a b", "s1"), (9002, "long " * 4000, "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS rank", "2 AS target")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sources = {}
    for r in got:
        assert r.mix_size == len(tokens(r.text)) and 0 <= r.mix_copies <= 3
        sources.setdefault(r.source, []).append(r)
    order = sorted((s for s in sources if s is not None)) + [None]
    sizes = [sum(r.mix_size for r in sources[s]) for s in order]
    targets = water_fill(sizes, [[5.0, 2.0, 1.0][i % 3] for i in range(len(order))])
    for s, size, target in zip(order, sizes, targets):
        assert {r.mix_source_size for r in sources[s]} == {size} and math.isclose(sources[s][0].mix_target, target)
        assert abs(sum(r.mix_size * r.mix_copies for r in sources[s]) - target) <= 0.01 * target + 3
    again = {(r.doc_id, r.text): r.mix_copies for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text): r.mix_copies for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def plain_contamination(texts, items):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(13, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_against_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = [(1, item), (2, "w3 w4"), (3, item.upper()), (4, None), (5, ""), (10, "solo"), (11, " ".join(["x"] * 20)), (None, "p q r s t")]
    w = item.split()
    texts = [
        *AWKWARD,
        item,
        " ".join(w[:12]),
        " ".join(w[5:18]) + " tail" * 300,
        " ".join([*w[:13], "gap", *w[13:26]]),
        " ".join(w[:20] + w[10:30]),
        "solo " + "pad " * 30,
        "x " * 50,
        "P q, r; s-t",
        " ".join(w[::-1]),
        item,
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS n", "'y' AS gram")
    got = by_id(contamination.contaminated_words(docs_of(spark, texts, clash=True), benchmark))
    for i, want in enumerate(plain_contamination(texts, items)):
        r = got[i][0]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == want and r.n_items == len(want[2]), (i, r, want)
    empty = benchmark.limit(0)
    assert all(r.n_hit == 0 for r in contamination.contaminated_words(docs_of(spark, texts), empty).collect())
    assert contamination.contaminated_words(docs_of(spark, texts).limit(0), benchmark).count() == 0


@pytest.mark.parametrize("name", ["op4_decontaminate"])
def test_queries_with_an_oracle(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), sf_dir, name)
    assert ok, note


def plain_base(texts, training):
    c = Counter(t for x in training for t in [*tokens(x), None])
    n, v = sum(c.values()), len(c)
    return n, [
        (len(tokens(x)) + 1, sum(c[t] > 0 for t in [*tokens(x), None]), sum(math.log10((c[t] + 1) / (n + v + 1)) for t in [*tokens(x), None]))
        for x in texts
    ]


def test_base_scores_and_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 5)  # most words take the join
    texts = [*AWKWARD, "the cat sat on the mat", "The CAT", "unseen words here", "zz " * 3000, "the cat sat on the mat"]
    training = [None, "the cat sat", "on the mat the", "other text of other words"]
    scored, model = lm.score_corpus(docs_of(spark, texts, clash=True), docs_of(spark, training))
    got, (n, want) = by_id(scored), plain_base(texts, training)
    assert model["total"] == n
    for i, (count, known, base) in enumerate(want):
        r = got[i][0]
        assert (r.n_tokens, r.n_known) == (count, known) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    assert got[8][0].score == got[12][0].score


def test_no_training_text_and_empty_tables(spark):
    df = docs_of(spark, ["some words", None])
    scored, model = lm.score_corpus(df, df.limit(0))
    assert model["total"] == 0 and all(r.n_known == 0 and r.base_score == 0 for r in scored.collect())
    assert lm.score_corpus(df.limit(0), df)[0].count() == 0


def test_automaton_is_a_distribution_and_equals_the_backoff_rule():
    """Probabilities of all symbols add up in every state, and a text scores as the plain recursion says."""
    import numpy as np

    sym, _ = lm._symbols([t.encode().split() for t in ["the cat sat on the mat", "a cat", "", "the rat"]])
    counts = lm._gram_counts(sym)
    a = lm.Automaton(counts)
    assert np.allclose((10**a.logp).sum(axis=1), 1)
    other, _ = lm._symbols([b"the mat sat on a zebra".split(), b"cat".split()])

    def plain(context, s):
        while context:
            n = len(context) + 1
            code = 0
            for c in context:
                code = code * lm.SYMBOLS + c
            row = counts[n - 1].reshape(-1, lm.SYMBOLS)[code].astype(float)
            if row.sum():
                every = counts[n - 1]
                once, twice = (every == 1).sum(), (every == 2).sum()
                d = once / (once + 2 * twice) if once and twice else 0.5
                if row[s]:
                    return (row[s] - d) / row.sum()
                lower = [plain(context[1:], k) for k in range(lm.SYMBOLS)]
                return d * (row > 0).sum() / row.sum() / (1 - sum(p for p, k in zip(lower, row) if k)) * lower[s]
            context = context[1:]
        return (counts[0][s] + 1) / (counts[0].sum() + lm.SYMBOLS)

    got, context = a.score(other), [lm.END]
    for x, s in zip(got, other):
        assert math.isclose(x, math.log10(plain(context, s)) - lm.LOG_SIZE[s], rel_tol=1e-9)
        context = [lm.END] if s == lm.END else [*context, int(s)][-3:]


def test_long_texts_take_linear_time_and_other_templates(spark):
    import time

    def seconds(n):
        df = docs_of(spark, [" ".join(f"w{i % 977}" for i in range(n)) + " mit license"]).cache()
        df.count()
        start = time.time()
        row = licenses.scan_licenses(df).collect()[0]
        assert (row.n_words, row.first_word, row.labels) == (n + 2, n, "mit")
        return time.time() - start

    seconds(1000)
    short, long = seconds(40_000), seconds(160_000)
    assert long < 4 * short + 2
    own = licenses.scan_licenses(docs_of(spark, ["under the house rules", "mit license"]), phrases=[("house", "house rules")], notices=[])
    assert {r.doc_id: r.labels for r in own.collect()} == {0: "house", 1: ""}


def test_a_shingle_of_many_items_and_texts_is_joined_only_as_a_prefix(spark):
    """1,000 items share four words, 1,000 texts hold them, no window matches: nothing is verified at all."""
    common = "alpha beta gamma delta"
    items = [(i, " ".join(f"i{i}w{j}" for j in range(9)) + " " + common + " " + " ".join(f"i{i}v{j}" for j in range(9))) for i in range(1000)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [f"t{i} " + common + " " + " ".join(f"t{i}w{j}" for j in range(20)) for i in range(1000)]
    texts += [items[7][1], "x " + " ".join(items[9][1].split()[4:17])]
    joined = contamination.contaminated_words(docs_of(spark, texts), benchmark)
    got = by_id(joined)
    assert [got[i][0]["items"] for i in (0, 999, 1000, 1001)] == [[], [], ["7"], ["9"]]
    assert got[1001][0].n_hit == 13 and sum(r[0].n_hit > 0 for r in got.values()) == 2
    places = [p for p in contamination_stages(spark, "places") if p]
    assert places and max(places) < 1500 * 4  # shingles that may be known, not items x texts


def contamination_stages(spark, name):
    """Rows with a shingle in each written table of that name."""
    import glob

    from ledgerweave.session import scratch_root

    newest = sorted(glob.glob(f"{scratch_root(spark)}/decontaminate-*"), key=lambda p: __import__("os").path.getmtime(p))[-1]
    return [spark.read.parquet(p).filter("gram is not null").count() for p in glob.glob(f"{newest}/*-{name}")]


def test_contamination_of_long_texts(spark):
    words_ = " ".join(f"w{i % 5000}" for i in range(120_000))
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(4000, 4013))), (2, "zz yy")], "item_id bigint, text string")
    row = contamination.contaminated_words(docs_of(spark, [words_ + " zz yy"]), benchmark).collect()[0]
    assert (row.n_words, row.n_hit, row["items"]) == (120_002, 24 * 13 + 2, ["1", "2"])


def test_copies_equal_a_plain_plan(spark):
    """Rates by bisection on each source's dual, source by source, then the same rounding rule."""
    from pyspark.sql import functions as F

    rows = [(i, "w " * (1 + i * 7919 % 97), f"s{i % 4}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).withColumn("bin", F.pmod(F.xxhash64("doc_id", "mix_size"), F.lit(mixing.BINS))).collect()
    sources = sorted({r.source for r in got})
    sizes = [sum(r.mix_size for r in got if r.source == s) for s in sources]
    targets = water_fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    for s, target in zip(sources, targets):
        mine = [r for r in got if r.source == s]
        octave = {r.doc_id: int(math.log2(r.mix_size)) for r in mine}
        tilt = lambda k: 1 + k * mixing.TILT
        lo, hi = -20.0, 20.0
        for _ in range(200):
            lam = (lo + hi) / 2
            total = sum(r.mix_size * math.exp(lam * tilt(octave[r.doc_id])) for r in mine)
            lo, hi = (lam, hi) if total < target else (lo, lam)
        cells = Counter()
        for r in mine:
            cells[octave[r.doc_id], r.bin] += r.mix_size
        plan = mixing.plan_copies(target, [(k, b, t, min(3.0, math.exp(lam * tilt(k)))) for (k, b), t in cells.items()], 3.0)
        plan = {k: (copies, cut) for k, copies, cut in plan}
        want = {r.doc_id: plan[octave[r.doc_id]][0] + (r.bin < plan[octave[r.doc_id]][1]) for r in mine}
        assert {r.doc_id: r.mix_copies for r in mine} == want
        assert abs(sum(want[r.doc_id] * r.mix_size for r in mine) - target) <= 100
