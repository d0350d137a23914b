"""Small tables and plain versions for the tests of the training-data operators."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns that clash with names the operators use inside
CLASH = ["row", "gram", "key", "rank", "size", "target", "label", "component", "hash", "n", "_id", "_row"]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def tokens(text):
    return NOT_SPACE.findall((text or "").translate(LOW))


def docs_of(spark, texts, clash=False, ids=None):
    """Documents 0, 1, ... with the texts; with ``clash`` extra columns of awkward names."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for c in CLASH:
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
