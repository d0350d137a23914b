"""Language ID and toxicity: held-out accuracy and odd inputs."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import langid, toxicity
from ledgerweave.llm.common import sample_rows
from tests.llm.helpers import by_id, docs_of


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_language_of_held_out_texts(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    from ledgerweave.llm.common import QUERIES

    got = QUERIES["op6_language_id"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(truth) and len(got) == len(truth)
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    mine = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in mine) >= 0.95 * len(mine)
    assert sum(r.rejected for r in mine) <= 0.02 * len(mine)


def test_language_of_awkward_texts(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 20)]
    learn = spark.createDataFrame([*rows, (90, None, "en", 1), (91, "x", None, 1)], "doc_id bigint, text string, lang string, row int")
    model = langid.fit_languages(learn)
    texts = [None, "", "123 !!", "\n", "der hund", "the dog the cat", "the " * 20_000, "the dog the cat"]
    got = by_id(langid.identify(docs_of(spark, texts, clash=True).withColumn("lang_pred", F.lit("old")), model))
    pred = [got[i][0].lang_pred for i in range(len(texts))]
    assert pred == ["und"] * 4 + ["de", "en", "en", "en"]
    assert all(got[i][0].lang_rejected and got[i][0].lang_score == 0 for i in range(4))
    none = langid.fit_languages(learn.limit(0))
    assert {r.lang_pred for r in langid.identify(docs_of(spark, texts), none).collect()} == {"und"}
    assert langid.identify(docs_of(spark, texts).limit(0), model).count() == 0


@pytest.fixture(scope="module")
def toxic_model(spark):
    base = ["the river and the hill lay under a grey sky", "we walked home over the old bridge at noon", "her letter came with the morning post again"]
    bad = ["you worthless idiot", "such pathetic scum", "stupid moron clown"]
    texts, marks = [], []
    for i in range(240):
        rare = hashlib.md5(str(i).encode()).hexdigest()
        plain = " ".join(base[(i + k) % 3] + f" {rare[5 * k : 5 * k + 5]} {rare[16 + 5 * k : 21 + 5 * k]}" for k in range(3))
        texts.append(plain + (f" {bad[i % 3]} {base[i % 3]} {bad[(i + 1) % 3]}" if i % 4 == 0 else ""))
        marks.append(int(i % 4 == 0))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([*enumerate(marks), (7, None), (8, 9), (9999, 1), (None, 1)], "doc_id bigint, toxic int")
    return docs, labels, texts, marks


def test_toxic_texts_are_caught(spark, toxic_model):
    docs, labels, texts, marks = toxic_model
    model = toxicity.fit_toxicity(docs, labels.filter("doc_id % 3 <> 0"))
    got = by_id(toxicity.score_toxicity(docs, model))
    rest = [i for i in range(len(texts)) if i % 3 == 0]
    assert all((got[i][0].tox_predicted == 1) == (got[i][0].tox_score >= 0.5) for i in rest)
    caught = [got[i][0].tox_predicted for i in rest if marks[i]]
    flagged = [got[i][0].tox_predicted for i in rest if not marks[i]]
    assert sum(caught) >= 0.9 * len(caught) and sum(flagged) <= 0.02 * len(flagged)


def test_toxicity_of_awkward_texts(spark, toxic_model):
    docs, labels, _, _ = toxic_model
    model = toxicity.fit_toxicity(docs, labels)
    texts = [None, "", " ", "x" * 100_000, "a b " * 30_000, "É", "É"]
    got = by_id(toxicity.score_toxicity(docs_of(spark, texts, clash=True), model))
    assert all(0 <= got[i][0].tox_score <= 1 for i in range(len(texts)))
    assert got[0][0].tox_score == got[1][0].tox_score and got[5][0].tox_score == got[6][0].tox_score
    untrained = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.tox_predicted for r in toxicity.score_toxicity(docs_of(spark, texts), untrained).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_windows_cover_the_whole_text():
    text = b"one two three four five " + b"y" * 200
    assert b"".join(toxicity.windows(text)).replace(b" ", b"") == text.replace(b" ", b"")
    assert toxicity.windows(b"") == []


def test_toxic_words_of_skewed_frequency_are_learned():
    """Words far rarer than the commonest toxic one are kept, and held-out texts that use them are told apart."""
    rng = np.random.default_rng(3)
    vocabulary, zipf = [f"w{v}" for v in rng.integers(10**5, 10**6, 3000)], lambda n: (1 / np.arange(1, n + 1)) / (1 / np.arange(1, n + 1)).sum()
    bad = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(40)]
    texts, marks = [], np.arange(1500) % 3 == 0
    for mark in marks:
        w = list(rng.choice(vocabulary, 60, p=zipf(3000)))
        for b in rng.choice(bad, 3, p=zipf(40)) if mark else ():
            w.insert(rng.integers(len(w)), str(b))
        texts.append(" ".join(w).encode())
    part = rng.integers(0, 5, len(texts))
    learn = [(t, m) for t, m, p in zip(texts, marks, part) if 0 < p < 4]
    plain, toxic = toxicity.train_dictionaries([t for t, m in learn if not m], [t for t, m in learn if m])
    assert sum(w.encode() in toxic for w in bad) >= 25
    x = np.stack([toxicity.Judge(plain, toxic).features(t) for t in texts])
    beta = toxicity._logistic(x[part == 4], marks[part == 4].astype(float), np.ones((part == 4).sum()))
    said, true = x[part == 0] @ beta > 0, marks[part == 0]
    assert (said & true).sum() >= 0.9 * true.sum() and (said & ~true).sum() <= 0.02 * (~true).sum()


def test_two_languages_reject_other_scripts(spark):
    """A model of two languages of one script keeps short texts of theirs and rejects what it has never seen."""
    rng = np.random.default_rng(1)
    en = "the cat and dog were walking over this bridge with their friends because morning light had come again".split()
    de = "der hund und die katze gingen heute nicht über diese brücke weil das wetter wieder schlecht geworden war".split()
    rows = []
    for i in range(300):
        lang, pool = ("en", en) if i % 2 else ("de", de)
        rows.append((i, " ".join(rng.choice(pool, 40)), lang))
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    own = [" ".join(rng.choice(en, 12)), " ".join(rng.choice(de, 12)), "the cat and dog 2024", "der hund (heute)"]
    other = ["هذه جملة عربية عن الطقس في المدينة", "今日は天気がとても良いので散歩に行きます", "Это предложение написано по-русски", "zzq xkcd qwrtp jjxv"]
    got = by_id(langid.identify(docs_of(spark, own + other), model))
    assert [got[i][0].lang_rejected for i in range(8)] == [False] * 4 + [True] * 4
    assert [got[i][0].lang_pred for i in range(4)] == ["en", "de", "en", "de"]


def test_samples_are_bounded_however_often_ids_repeat(spark):
    n = 30_000
    hot = spark.range(0, n, 1, 4).selectExpr("1L AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    others = spark.range(2, 3000, 1, 4).selectExpr("id AS doc_id", "concat('word ', id) AS text", "if(id % 3 = 0, 'de', 'en') AS lang")
    nulls = spark.range(0, 50).selectExpr("CAST(null AS bigint) AS doc_id", "'x' AS text", "'en' AS lang")
    rows = hot.unionByName(others).unionByName(nulls)
    got = sample_rows(rows, rows, "lang", 100, 64).collect()
    sizes = Counter(r.lang for r in got)
    assert 85 <= sizes["en"] <= 100 and 85 <= sizes["de"] <= 100
    assert len({(r.doc_id, r.lang) for r in got}) == len(got)
    again = sample_rows(rows.repartition(7), rows.repartition(5), "lang", 100, 64).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    assert len(sample_rows(rows, rows, "lang", 100, 64, max_rows=60).collect()) <= 60
    only = sample_rows(hot, hot, "lang", 100, 64).collect()
    assert len(only) == 1 and only[0].doc_id == 1
    plan = sample_rows(rows, rows, "lang", 2000, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_one_label_of_many_rows_is_counted_not_sorted(spark):
    ids = spark.range(0, 1_000_000, 1, 8).selectExpr("id AS doc_id", "1 AS toxic")
    docs = ids.selectExpr("doc_id", "'t' AS text")
    assert 1800 <= sample_rows(ids, docs, "toxic", 2000, 64).count() <= 2000


@pytest.mark.parametrize("words", [300, 600])
def test_the_toxic_dictionary_holds_all_words_that_prove_toxic(words):
    rng = np.random.default_rng(words)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    bad = ["".join(rng.choice(letters, 8)) for _ in range(words)]
    plain_words = [f"w{v}" for v in rng.integers(10**5, 10**6, 2000)]
    ordinary = [" ".join(rng.choice(plain_words, 40)).encode() for _ in range(1200)]
    toxic = [" ".join([*rng.choice(plain_words, 30), *rng.choice(bad, 20)]).encode() for _ in range(1200)]
    _, held = toxicity.train_dictionaries(ordinary, toxic)
    assert sum(b" " + w.encode() + b" " in b" " + held + b" " for w in bad) >= 0.97 * words


def test_windows_without_a_toxic_run_gain_nothing():
    judge = toxicity.Judge(b"some ordinary words of a text " * 40, b" idiot scum moron ")
    text = b"quiet lake under trees and you idiot over there by the old wooden bridge"
    got, w = judge.gains(text), toxicity.windows(text)
    assert [i for i, g in enumerate(got) if g > 0] == [i for i, x in enumerate(w) if b"idiot" in x]
    assert judge.gains(b"").tolist() == [0] and judge.gains(b"abc").tolist() == [0]
