"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text and one on toxic text: on those words of toxic
texts that are clearly commoner there. A window of a few words is compressed with the ordinary
dictionary alone and with both; how many bytes the toxic one saves is the window's gain. A
logistic curve over a text's largest, mean and total gains, fitted on held-back labelled texts and
weighed to the labels' true shares, gives the score; its threshold is one half.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import batches_of, fold, query, sample_rows, table

PER_LABEL, MAX_BYTES = 2000, 65_536  # the training sample: texts per label, bytes of a text
WINDOW, LONGEST = 4, 64
ORDINARY_BYTES, LEAD = 16_384, 40
LEAST_BYTES, MOST_BYTES = 2048, 32_768  # of the toxic dictionary: as many as its words need, some thousands of words at most
RUN = 5  # bytes that a window must share with the toxic dictionary to be compressed at all
RATIO, CHANCE = 4.0, 1e-3  # a toxic word's share against ordinary text, and its probability if it were no commoner
PUNCTUATION = b".,;:!?\"'()"


def windows(text: bytes, n: int = WINDOW) -> list[bytes]:
    """The whole text in windows of ``n`` words; longer words are cut into pieces of ``LONGEST`` bytes."""
    w = text.lower().split()
    if w and max(map(len, w)) > LONGEST:
        w = [x[i : i + LONGEST] for x in w for i in range(0, len(x), LONGEST)]
    return [b" " + b" ".join(w[i : i + n]) + b" " for i in range(0, len(w), n)]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        compression_level=3,
        strategy=zstd.STRATEGY_BTOPT,  # an optimal parse: gains show the dictionary, not the search
        min_match=3,
        window_log=16,
        hash_log=14,
        chain_log=15,
        search_log=2,
        target_length=32,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=held, compression_params=params)


def compressors(plain: bytes, toxic: bytes) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
    """With the ordinary dictionary alone and with both; filling keeps its distance, so its matches cost the same."""
    return _compressor(plain + bytes(len(toxic))), _compressor(plain + toxic)


def _runs(data: np.ndarray) -> np.ndarray:
    """A 20-bit hash of the ``RUN`` bytes from each place on."""
    n = max(0, len(data) - RUN + 1)
    code = np.zeros(n, np.uint64)
    for i in range(RUN):
        code = (code << np.uint64(8)) | data[i : i + n]
    with np.errstate(over="ignore"):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Judge:
    """Gains of a text's windows by both dictionaries.

    A window that shares no run of bytes with the toxic dictionary cannot gain from it and is not compressed. Each
    other one follows a piece that both dictionaries hold: zstandard stores a block that compresses by a few
    bytes only as it is, which would hide small gains.
    """

    def __init__(self, plain: bytes, toxic: bytes):
        self.ordinary, self.both = compressors(plain, toxic)
        self.lead = plain[-2 * LEAD : -LEAD]
        self.shared = np.zeros(1 << 20, bool)
        self.shared[_runs(np.frombuffer(toxic, np.uint8).astype(np.uint64))] = True

    def gains(self, text: bytes) -> np.ndarray:
        w = windows(text)
        out = np.zeros(max(1, len(w)))
        if w:
            ends = np.cumsum([len(x) for x in w])
            hits = np.flatnonzero(self.shared[_runs(np.frombuffer(b"".join(w), np.uint8).astype(np.uint64))])
            for i in np.unique(np.searchsorted(ends, hits, "right")):
                x = self.lead + w[i]
                out[i] = len(self.ordinary.compress(x)) - len(self.both.compress(x))
        return out

    def features(self, text: bytes) -> np.ndarray:
        """What the curve sees of a text."""
        g = self.gains(text)
        n = len(g) if text.split() else 0
        top = np.sort(g)[::-1][:4]
        top = np.concatenate([top, np.zeros(4 - len(top))])
        shape = [g.mean(), (g >= 3).mean(), np.log1p(n), np.log1p(max(0.0, g.sum())), top[0] >= 2, top[0] >= 4]
        return np.array([1.0, *top, *shape], np.float64)


def _chance(n: int, m: int, share: float) -> float:
    """Probability of ``n`` or more of n + m families being toxic if each is with probability ``share``."""
    k = np.arange(n, n + m + 1)
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + m + 1)))])
    return float(np.exp(fact[-1] - fact[k] - fact[n + m - k] + k * np.log(share) + (n + m - k) * np.log1p(-share)).sum())


def train_dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of both dictionaries; empty where there is too little text to train one."""

    def trained(size: int, samples: list[bytes], **how) -> bytes:
        try:
            return zstd.train_dictionary(size, samples, **how).as_bytes()
        except zstd.ZstdError:
            return b" ".join(samples)[-size:]

    pieces = [b" ".join(t.lower().split()) for t in ordinary]
    pieces = [p[i : i + 512] for p in pieces for i in range(0, len(p), 512)]
    plain = trained(ORDINARY_BYTES, pieces, k=64, d=8) if pieces else b""
    strip = lambda t: [x for w in t.lower().split() if (x := w.strip(PUNCTUATION))]

    def counted(texts: list[bytes]) -> tuple[Counter, int]:
        """In how many families of texts each word stands: near copies of a text count once."""
        families = defaultdict(set)
        for t in texts:
            ws = set(strip(t))
            family = min((zlib.crc32(w) for w in ws if w not in plain), default=0)
            for w in ws:
                families[w].add(family)
        return Counter({w: len(f) for w, f in families.items()}), len({x for f in families.values() for x in f})

    (bad, of_bad), (common, of_common) = counted(toxic), counted(ordinary)
    marks = [w for w, n in bad.items() if n >= 3 and n * (of_common + 1) >= RATIO * (common[w] + 1) * of_bad]
    marks = {w for w in marks if _chance(bad[w], common[w], of_bad / max(1, of_bad + of_common)) <= CHANCE}
    said = [b" " + b" ".join(w for w in strip(t) if w in marks) + b" " for t in toxic]
    said = [s for s in said if len(s) > 4]
    if not said:
        return plain, b""
    size = min(MOST_BYTES, max(LEAST_BYTES, 2 * sum(len(w) + 1 for w in marks)))
    held = trained(size, said, k=16, d=6)
    # the trainer leaves rarer words out long before the size is reached
    rarer = sorted((w for w in marks if b" " + w + b" " not in held), key=lambda w: (bad[w], w))
    return plain, (b" " + b" ".join([*rarer, held]))[-MOST_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty @ beta
        beta -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, grad)
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_bytes: int = MAX_BYTES) -> dict:
    """Dictionaries and calibration from a bounded sample of labelled texts: ``sample_rows``.

    ``labels`` has doc_id and toxic (0, 1; others and null are ignored). Dictionaries learn from
    three fifths of the sample, the curve from the rest, weighed by the counts of all labels. An id
    counts once per label, however often its rows are repeated; longer texts, null texts and ids teach
    nothing. Without enough labels of both kinds every text gets one low score.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    total = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    rows = sample_rows(marked, docs, "toxic", per_label, max_bytes).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["toxic"], r["text"]))
    if len(total) < 2 or min(sum(r["toxic"] == k for r in rows) for k in (0, 1)) < 5:
        return {"plain": b"", "toxic": b"", "beta": [-4.0]}
    texts = [r["text"].encode() for r in rows]
    y = np.array([r["toxic"] for r in rows], np.float64)
    learns = np.array([i % 5 < 3 for i in range(len(rows))])
    plain, toxic = train_dictionaries(
        [t for t, k, a in zip(texts, y, learns) if a and not k], [t for t, k, a in zip(texts, y, learns) if a and k]
    )
    if not plain or not toxic:
        return {"plain": b"", "toxic": b"", "beta": [-4.0]}
    judge = Judge(plain, toxic)
    x = np.stack([judge.features(t) for t, a in zip(texts, learns) if not a])
    known = y[~learns]
    weight = np.array([total[int(k)] / max(1, (known == k).sum()) for k in known])
    return {"plain": plain, "toxic": toxic, "beta": _logistic(x, known, weight * len(known) / weight.sum()).tolist()}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with tox_score (0 to 1, higher: likelier toxic) and tox_predicted (1 if at least 0.5).

    The score sees the whole text, whatever its length, and nothing else; null is scored as the empty text.
    Equal texts get equal scores, also in repeated rows; an empty table stays empty. Columns of the
    result's names are replaced; rows and other columns stay.
    """
    batches_of(docs.sparkSession)
    docs = docs.drop("tox_score", "tox_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed size
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        judge = Judge(m["plain"], m["toxic"]) if m["plain"] else None
        beta = np.array(m["beta"])
        for batch in batches:
            z = [
                float(judge.features((t or "").encode()) @ beta) if judge else float(beta[0])
                for t in batch.column(at).to_pylist()
            ]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                [*batch.schema.names, "tox_score", "tox_predicted"],
            )

    return docs.mapInArrow(
        score, docs.withColumns({"tox_score": F.lit(0.0), "tox_predicted": F.lit(0)}).schema
    )


def training_labels(labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), modulus) != held_out).select("doc_id", "toxic")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("tox_score").alias("score"),
        F.col("tox_predicted").alias("predicted"),
    )
