"""Language ID: averaged hashed subword embeddings with a linear softmax.

Byte n-grams of the lower-cased text hash into buckets, each with an embedding; the mean embedding
of a text goes through a linear softmax. Embeddings and weights are trained by stochastic
gradient descent in numpy on a bounded sample. A temperature fitted on held-back texts of the
sample calibrates the probabilities. Held-back texts are also cut into pieces of several lengths: for
texts of such a length, the confidence below which only few of the right answers lie is where a
prediction is rejected. So is a text most of whose byte pairs no training text has, as of another script.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import batches_of, fold, query, sample_rows, table

BITS, DIM, GRAMS = 12, 16, (2, 3, 4)
PER_LANG, MAX_BYTES, MAX_ROWS = 400, 65_536, 20_000  # the training sample: texts per language, bytes of a text, texts
REJECT = 0.002  # share of right answers that may be rejected
LENGTHS = (16, 32, 64, 128, 256, 512, 1024)  # bytes of the pieces that calibrate the rejection
STRANGE = 0.25  # least share of unseen byte pairs that may count as strange
UNKNOWN = "und"


def bucket_counts(text: bytes, bits: int = BITS) -> np.ndarray:
    """How often the byte n-grams of a text fall into each bucket."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(1 << bits, np.int64)
    code = b.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(257) + b[n - 1 :] if len(code) > 1 else code[:0]
        if n in GRAMS and len(code):
            mixed = (code + np.uint32(n)) * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            out += np.bincount((mixed * np.uint32(2246822519)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def byte_pairs(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint16)
    return b[:-1] * np.uint16(256) + b[1:]


def train(counts: np.ndarray, y: np.ndarray, held: np.ndarray, classes: int, epochs: int = 60, rate: float = 0.5, seed: int = 11) -> dict:
    """Embedding and softmax by minibatch gradient descent; the temperature from the ``held`` rows."""
    rng = np.random.default_rng(seed)
    x = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    emb = rng.normal(0, 0.5, (x.shape[1], DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (DIM, classes)).astype(np.float32), np.zeros(classes, np.float32)
    rows = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 32)):
            h = x[part] @ emb
            p = _softmax(h @ w + b)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ w.T
            w -= step * (h.T @ p)
            b -= step * p.sum(axis=0)
            emb -= step * 200 * (x[part].T @ back)  # a bucket's share of a text is small
    logits = (x @ emb @ w + b)[held] if held.any() else x @ emb @ w + b
    truth = y[held] if held.any() else y
    heat = min(
        (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0),
        key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean(),
    )
    return {"m": (emb @ w).astype(np.float64), "b": b.astype(np.float64), "t": heat}


def _sure(model: dict, counts: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return _softmax((share @ model["m"] + model["b"]) / model["t"])


def _floor(right: np.ndarray) -> float:
    """The confidence below which a share of ``REJECT`` of right answers lies, from their sorted confidences.

    Where they are too few to have such a share, their lower tail is carried on as an exponential one in the logit.
    """
    z = np.log(np.maximum(right, 1e-12)) - np.log(np.maximum(1 - right, 1e-12))
    n = len(z)
    if n * REJECT >= 1:
        return float(right[int(n * REJECT)])
    step = (z[n // 2] - z[0]) / np.log(max(n, 2))
    return float(1 / (1 + np.exp(-(z[0] - step * np.log(1 / (REJECT * n))))))


def _calibrate(model: dict, pieces: list[tuple[int, int, np.ndarray, np.ndarray]]) -> tuple[list[float], list[float]]:
    """Per length of pieces (language, length, counts, byte pairs): least confidence, and most unseen byte pairs, to accept."""
    floors, strange = [], []
    for length in LENGTHS:
        mine = [p for p in pieces if p[1] == length]
        right, unseen = [], []
        for k, _, counts, pairs in mine:
            p = _sure(model, counts[None])[0]
            if p.argmax() == k:
                right.append(float(p.max()))
                unseen.append(float((~model["seen"][pairs]).mean()))
        out = int(len(right) * REJECT)
        floors.append(_floor(np.sort(right)) if right else 0.0)
        # another script is strange almost throughout; names and codes in a known one are not
        strange.append(max(STRANGE, 1.5 * sorted(unseen)[-1 - out]) if unseen else 1.0)
    return floors, strange


def fit_languages(
    labelled: DataFrame, per_lang: int = PER_LANG, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS
) -> dict:
    """Model of doc_id, text, lang rows, from a bounded sample of them: ``sample_rows``.

    Null texts, ids and languages teach nothing; an id counts once per language, however often it is repeated.
    Very long texts are not in the sample. One text in five is held back for calibration. An empty
    table gives a model that knows no language.
    """
    batches_of(labelled.sparkSession)
    sample = sample_rows(labelled, labelled, "lang", per_lang, max_bytes, max_rows).select("doc_id", "lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed counts and byte pairs of each text, and of pieces of the held-back ones (``length`` above 0)."""
        for batch in batches:
            out = []
            for key, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw, code = text.encode(), zlib.crc32(str(key).encode())
                held = code % 5 == 4
                out.append((str(key), lang, held, 0, raw, np.unique(byte_pairs(raw))))
                for length in LENGTHS if held else ():
                    if len(raw) >= length:
                        at = code // 5 % (len(raw) - length + 1)
                        out.append((str(key), lang, held, length, raw[at : at + length], byte_pairs(raw[at : at + length])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.string()),
                    pa.array([r[1] for r in out], pa.string()),
                    pa.array([r[2] for r in out], pa.bool_()),
                    pa.array([r[3] for r in out], pa.int32()),
                    pa.array([zlib.compress(bucket_counts(r[4]).astype(np.int32).tobytes(), 1) for r in out], pa.binary()),
                    pa.array([r[5].astype(np.uint16).tobytes() for r in out], pa.binary()),
                ],
                ["doc_id", "lang", "held", "length", "counts", "pairs"],
            )

    schema = "doc_id string, lang string, held boolean, length int, counts binary, pairs binary"
    rows = sample.mapInArrow(featurise, schema).collect()  # the sample and its pieces
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["length"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return {"langs": []}
    unpack = lambda r: np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    pairs = lambda r: np.frombuffer(r["pairs"], np.uint16)
    whole = [r for r in rows if not r["length"]]
    order = np.random.default_rng(5).permutation(len(whole))
    whole = [whole[i] for i in order]
    held = np.array([r["held"] for r in whole])
    if held.all():  # a handful of texts: learn from all of them
        held[:] = False
    model = train(np.stack([unpack(r) for r in whole]), np.array([langs.index(r["lang"]) for r in whole]), held, len(langs))
    model["seen"] = np.zeros(1 << 16, bool)
    for r, back in zip(whole, held):
        if not back:
            model["seen"][pairs(r)] = True
    pieces = [(langs.index(r["lang"]), r["length"], unpack(r), pairs(r)) for r in rows if r["length"]]
    model["floors"], model["strange"] = _calibrate(model, pieces)
    return {"langs": langs} | model


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected.

    A text that is null, empty or has no letter is ``und`` with score 0 and rejected; so is every
    text if the model has learned no language. Else the likeliest learned language (ties: the first in
    code-point order), its calibrated probability, and whether that lies below the floor of texts of
    its length or too many of its byte pairs are unseen. Only the text is used, whole, whatever its length;
    columns of the result's names are replaced, rows and their order of columns stay. An empty table
    stays empty.
    """
    spark = docs.sparkSession
    batches_of(spark)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    shared = spark.sparkContext.broadcast(model)  # buckets x languages
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, known = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            pred, score, rejected = [], [], []
            for text, ok in zip(texts, known):
                if not ok or not m["langs"]:
                    pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                raw = text.encode()
                p = _sure(m, bucket_counts(raw)[None])[0]
                k = int(p.argmax())
                size = max(0, int(np.searchsorted(LENGTHS, len(raw), "right")) - 1)
                far = (~m["seen"][byte_pairs(raw)]).mean() > m["strange"][size]
                pred.append(m["langs"][k]), score.append(float(p[k])), rejected.append(bool(far or p[k] < m["floors"][size]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*batch.schema.names[:-1], "lang_pred", "lang_score", "lang_rejected"],
            )

    schema = docs.withColumns(
        {"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(False)}
    ).schema
    return docs.withColumn("_letter", letter).mapInArrow(predict, schema)


def training_rows(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    return docs.filter((fold(F.col("doc_id"), modulus) != held_out) & F.col("lang").isNotNull()).select(
        "doc_id", "text", "lang"
    )


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
