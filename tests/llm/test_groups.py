"""Near-duplicates, vectors, chat windows and the pipeline against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerweave.llm import chat, graph, neardup, vectors
from ledgerweave.session import Stages
from tests.llm.helpers import DOCS, by_id, docs_of, tokens


def plain_components(n, linked):
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if linked(i, j) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    df = spark.createDataFrame([*links, *links[:5], (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in graph.components(df, Stages(spark, "t")).collect()}
    nodes = sorted({x for a, b in links for x in (a, b) if a != b})
    want = plain_components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in links or (nodes[j], nodes[i]) in links)
    assert got == {v: nodes[want[k]] for k, v in enumerate(nodes)}
    assert graph.components(df.limit(0), Stages(spark, "t")).count() == 0


def sets_of(text):
    w = tokens(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def check_near(spark, texts):
    sets = [sets_of(t) for t in texts]
    want = plain_components(len(texts), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    got = by_id(neardup.near_duplicates(docs_of(spark, texts, clash=True)))
    for i in range(len(texts)):
        r = got[i][0]
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), want[i], want[i] == i), i


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(90)] for _ in range(4)]
    texts = [None, "", " \n", "That it.", "that IT.", "that  it.", "one two three", "one two three four"]
    for b in base:
        for k in range(22):  # from light to heavy edits, some of them just at the bound
            w = list(b)
            for _ in range(k // 2):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
            texts.append(" ".join(w))
        texts += [" ".join(b)] * 5
    texts += [" ".join(base[0][:60] + [f"own{i}x{j}" for j in range(40)]) for i in range(20)]  # a shared passage
    texts.append(" ".join(base[1]) + " pad" * 20_000)
    check_near(spark, texts)


def test_tiles_of_a_group_with_many_outsiders(spark, monkeypatch):
    """Members outside the bucket's component are compared with all others across tiles."""
    monkeypatch.setattr(neardup, "TILE", 8)
    rng = random.Random(9)
    b = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for k in range(60):
        w = list(b)
        for _ in range(1 + k % 9):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    check_near(spark, texts)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    df = docs_of(spark, ["a b c d e", "a b c d e", "a b c d e", "a b c d e"], ids=[4, 4, None, 9])
    got = by_id(neardup.near_duplicates(df))
    assert [(r.component_id, r.kept) for r in got[4]] == [(4, True)] * 2 and got[9][0].component_id == 4
    assert got[None][0].component_id is None and got[None][0].kept
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pruning_bounds_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for one_bit, p in ((True, 0.9), (False, 0.8)):
        bounds = neardup.least_matches(4, one_bit)
        equal = rng.random((20_000, 4 * neardup.BATCH)) < p
        for k, least in enumerate(bounds, 1):
            assert (equal[:, : k * neardup.BATCH].sum(axis=1) >= least).mean() > 0.9999


VEC = "vec_id bigint, embedding array<float>, label int"


def plain_links(rows):
    def unit(r):
        if r[0] is None or r[1] is None or r[2] is None or not r[1] or any(v is None or not np.isfinite(v) for v in r[1]):
            return None
        x = np.array(r[1], np.float32).astype(float)
        return x / np.sqrt((x * x).sum()) if (x != 0).any() else None

    u = [unit(r) for r in rows]

    def linked(i, j):
        return u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= 0.98

    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return n, plain_components(len(rows), linked)


@pytest.mark.parametrize("window", [8, 256])
def test_vectors_against_brute_force(spark, window):
    """Small windows leave dense groups to the tiles; the result is the same."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for _ in range(30 if c else 70):
            rows.append([len(rows), [float(v) for v in centre + rng.normal(scale=0.06 if c < 3 else 0.25, size=16)], c % 3])
    rows += [[1000, None, 1], [1001, [], 1], [1002, [0.0] * 16, 1], [1003, [float("nan")] * 16, 1], [1004, [None] * 16, 1], [1005, rows[0][1], None]]
    rows += [[1006, rows[0][1][:8], 0], [1007, rows[0][1], 0], [1008, [float("inf")] + [1.0] * 15, 0]]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 AS id", "2 AS rank", "3 AS component")
    got = by_id(vectors.link_vectors(df, window=window), "vec_id")
    n, comp = plain_links(rows)
    found = sum(got[r[0]][0].n_links for r in rows)
    assert found >= 0.9 * sum(n) and all(got[r[0]][0].n_links <= k for r, k in zip(rows, n))
    if window == 256:
        assert found == sum(n)
        assert all(got[r[0]][0].component_id == rows[comp[i]][0] for i, r in enumerate(rows))
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_links_between_copies_fringe_and_near_misses(spark):
    """Copies far beyond the window, a fringe around them and a shell of near misses: recall against brute force."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    centre /= np.linalg.norm(centre)

    def around(cosine, n):
        side = rng.normal(size=(n, 32))
        side -= (side @ centre)[:, None] * centre
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        return cosine * centre + np.sqrt(1 - cosine**2) * side

    x = np.concatenate([np.tile(centre, (300, 1)), around(0.985, 200), around(0.97, 400), rng.normal(size=(300, 32))])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    got = by_id(vectors.link_vectors(df, window=16), "vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    found = np.array([got[i][0].n_links for i in range(len(x))])
    print("recall", found.sum() / want.sum())
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    assert (found[:300] == want[:300]).all()  # the copies lose none of their links
    assert all(got[i][0].component_id == 0 for i in range(500))


def test_repeated_rows_of_a_vector_count_each_other(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (5, [0.0, 1.0], 0)], VEC)
    got = by_id(vectors.link_vectors(df), "vec_id")
    assert sorted(r.n_links for r in got[5]) == [0, 2, 2] and got[3][0].n_links == 2
    assert {r.component_id for r in got[5]} == {3}


def plain_chat(rows):
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    return by


def test_chat_windows_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, 0, "system", "Be brief. " * rng.randrange(1, 9)))
        for t in range(1, rng.randrange(2, 14)):
            text = rng.choice([chat.PROBE, "\\0 \\1 [x]", "word " * rng.randrange(1, 160), "", None, "é" * 40 + "\n</s>"])
            rows.append((c, t, ["user", "assistant"][t % 2], text))
    rows += [(50, None, "user", "first"), (50, 1, None, "no role"), (50, 2, "tool]x", "[y"), (50, 2, "tool]x", "[y"), (None, 1, "assistant", "nobody")]
    rows += [(51, 1, "assistant", "long " * 9000), (52, 1, "system", "only system"), (53, 1, "user", "u"), (53, 2, "system", "late system")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS window", "2 AS loss")
    windows = chat.format_windows(df)
    got = {r.conv_id: r for r in chat.digest_conversations(windows).collect()}
    for c, turns in plain_chat(rows).items():
        r, loss = got[c], "".join(x for role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for role, x in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert set(got) == {r[0] for r in rows}
    w = windows.collect()
    assert sum(r.formatted_chars for r in got.values()) == sum(len(r.formatted) for r in w)
    for r in w:
        assert r.n_turns > r.n_repeat and (r.tokens <= chat.BUDGET or r.conv_id in (51,) or r.n_turns - r.n_repeat <= 2)
        system = [t for t in plain_chat(rows)[r.conv_id] if t[0] == "system"][:1]
        if r.window > 1 and r.conv_id not in (53,) and system:
            assert r.formatted.startswith("<s>[system]")
    assert any(r.n_repeat for r in w) and chat.format_windows(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps the columns, takes effect on its own input and leaves clean documents alone."""
    import shutil

    sf = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("text is not null").first().text
    clean = docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0"), "doc_id", "left_semi")
    model = " ".join(reversed(clean.filter("n_chars between 2000 and 4000 and lang = 'en'").orderBy("doc_id").first().text.split()))
    extra = [(90_001, None, None, "s", 0), (90_002, "12 34 !!", None, None, 8), (90_003, item, "en", "s", len(item))]
    other = " ".join(f"{w} and the" for w in reversed(model.split()))
    extra += [(None, model, "en", "s", 0), (None, model + " end", "en", "s", 0)]
    extra += [(80_001, other, "en", "s", 0), (80_001, other, "en", "s", 0), (80_001, other + " end", "en", "t", 0), (None, other, "en", "s", 0)]
    extra += [(80_000, model, "en", "s", 0), (90_004, model + " end", "en", "s", 0), (90_004, model + " end", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS)).withColumn("extra", F.lit(1))
    columns, before, ids = docs.columns, docs, None
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = Stages(spark, "t").write(stage(spark, before, str(sf)), name)
        assert after.columns == columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        seen[name], before = ids, after
        if name == "near_duplicates":
            copies = after.filter("doc_id = 80001").count()
    assert not {90_001, 90_002} & seen["language"] and 90_003 in seen["language"]
    assert 90_004 in seen["toxicity"] and 90_004 not in seen["near_duplicates"] and 80_000 in seen["near_duplicates"]
    assert None in seen["toxicity"] and None not in seen["near_duplicates"]
    assert copies == 1
    assert 90_003 not in seen["decontamination"] and len(seen["decontamination"]) > 0.5 * docs.count()
    last = corpus_pipeline.mixed(spark, before, str(sf)).collect()
    counts = {}
    for r in last:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= ids
    assert corpus_pipeline.run(spark, str(sf)).columns == [*[c for c in columns if c != "extra"], "mix_copy"]


def test_rows_of_one_id_are_compared_once(spark, monkeypatch):
    """200 rows of each of two ids that nearly match: one pair is verified, not 40,000."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base] * 200 + [base + " end"] * 200 + ["something else entirely here"]
    ids = [1] * 200 + [2] * 200 + [3]
    asked = []
    verify = neardup._verify

    def counted(pairs, docs, shingle, repeated):
        both = neardup._texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), repeated)
        asked.append((pairs.count(), both.count()))
        return verify(pairs, docs, shingle, repeated)

    monkeypatch.setattr(neardup, "_verify", counted)
    got = neardup.near_duplicates(docs_of(spark, texts, ids=ids)).collect()
    assert len(got) == 401 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}
    assert asked[0][0] == 1 and asked[0][1] <= 3


def test_shingles_of_five_words(spark):
    w = [f"w{i}" for i in range(100)]
    near = " ".join(w[:48] + ["x"] + w[49:])  # 4 of 97 shingles of four words are new, 5 of 96 of five
    got = by_id(neardup.near_duplicates(docs_of(spark, [" ".join(w), near, "a b c d"]), shingle=5))
    assert [got[i][0].component_id for i in range(3)] == [0, 0, 2] and got[0][0].n_shingles == 96 and got[2][0].n_shingles == 1


def test_magnitudes_do_not_matter(spark):
    rows = [(0, [1e200, 0.0]), (1, [2e200, 1e198]), (2, [1e-200, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 5e-324]), (5, [0.0, 1.7e308]), (6, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: r for r in vectors.link_vectors(df).collect()}
    assert [got[i].component_id for i in range(7)] == [0, 0, 0, 0, 4, 4, 6]
    assert [got[i].n_links for i in range(7)] == [3, 3, 3, 3, 1, 1, 0]


def test_recall_at_production_parameters(spark):
    """One label of 10,000 vectors, far beyond the window, links just above the bound."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = centres[rng.integers(0, 25, 9000)] + 0.09 * rng.normal(size=(9000, 32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    side = rng.normal(size=(1000, 32))
    side -= (side * rows[:1000]).sum(axis=1, keepdims=True) * rows[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.980001, 0.984, (1000, 1))
    x = np.concatenate([rows, c * rows[:1000] + np.sqrt(1 - c * c) * side])
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), "l") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in vectors.link_vectors(df).collect()}
    found = sum(got.values())
    assert all(got[i] <= n for i, n in enumerate(want)) and found >= 0.95 * want.sum() and want.sum() >= 2000


def test_one_conversation_of_very_many_turns(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t} " + "word " * (t % 7)) for t in range(6000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_windows(df)
    r = chat.digest_conversations(windows).collect()[0]
    said = "".join(f"{role}\n{text}\n" for _, _, role, text in rows)
    assert (r.n_turns, r.turns_sha256) == (6000, hashlib.sha256(said.encode()).hexdigest())
    assert windows.agg({"tokens": "max"}).collect()[0][0] <= chat.BUDGET and windows.count() > 50
