"""Token counts: greedy longest-match word pieces counted by a linear-time automaton.

The vocabulary is a trie with two roots: pieces that start a word and pieces that continue one.
A failure link leads from a node to where matching goes on once the longest pieces of its string
are popped, and the number of those pieces is stored with it. So each byte moves the state once
and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm.common import batches_of, query, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
START, INNER = 0, 1  # the two roots
LONG_WORD = 128


def read_vocabulary(path: str = VOCABULARY) -> tuple[set[bytes], set[bytes]]:
    """Pieces that start a word (a leading space marks them) and pieces that continue one.

    Every single byte is added to both, so that each word can be matched.
    """
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    single = {bytes([b]) for b in range(256)}
    start = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1} | single
    return start, {p for p in pieces if p[:1] != b" "} | single


class Automaton:
    """Trie edges as sorted keys ``node * 256 + byte``, failure links and popped-piece counts."""

    def __init__(self, start: set[bytes], inner: set[bytes]):
        child: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((START, start), (INNER, inner)):
            for p in pieces:
                node = root
                for b in p:
                    if b not in child[node]:
                        child[node][b] = len(child)
                        child.append({})
                        piece.append(False)
                    node = child[node][b]
                piece[node] = True
        fail, pops, finish = [INNER] * len(child), [0] * len(child), [0] * len(child)
        level = [START, INNER]
        while level:
            below = []
            for parent in level:
                for b, node in child[parent].items():
                    if piece[node]:
                        fail[node], pops[node] = INNER, 1
                    else:
                        z, n = fail[parent], pops[parent]
                        while b not in child[z]:
                            z, n = fail[z], n + pops[z]
                        fail[node], pops[node] = child[z][b], n
                    below.append(node)
            level = below
        done = {INNER, START}
        for first in range(2, len(child)):
            chain, node = [], first
            while node not in done:
                chain.append(node)
                node = fail[node]
            for node in reversed(chain):
                finish[node] = pops[node] + finish[fail[node]]
                done.add(node)
        edges = sorted((node * 256 + b, to) for node, c in enumerate(child) for b, to in c.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int32)
        self.fail, self.pops, self.finish = (np.array(a, np.int32) for a in (fail, pops, finish))
        self._edges: dict[int, int] | None = None

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Automaton:
        new = cls.__new__(cls)
        new.__dict__.update(arrays)
        return new

    def _one(self, word: np.ndarray) -> int:
        if self._edges is None:
            self._edges = dict(zip(self.keys.tolist(), self.to.tolist()))
        edges, node, n = self._edges, START, 0
        for b in word.tolist():
            while (to := edges.get(node * 256 + b)) is None:
                n += int(self.pops[node])
                node = int(self.fail[node])
            node = to
        return n + int(self.finish[node])

    def count(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pieces of each word; all words step through their bytes together."""
        total = np.zeros(len(begin), np.int64)
        for i in np.flatnonzero(length > LONG_WORD):
            total[i] = self._one(data[begin[i] : begin[i] + length[i]])
        order = np.flatnonzero((length > 0) & (length <= LONG_WORD))
        order = order[np.argsort(-length[order], kind="stable")]
        at, left = begin[order], length[order]
        state, n = np.full(len(order), START, np.int64), np.zeros(len(order), np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k, side="left"))
            byte, todo = data[at[:live] + k].astype(np.int64), np.arange(live)
            while len(todo):
                key = state[todo] * 256 + byte[todo]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[i] == key
                state[todo[hit]] = self.to[i[hit]]
                todo = todo[~hit]
                n[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        total[order] = n + self.finish[state]
        return total


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens, both long.

    Words are runs of non-space characters, matched byte by byte, whole and in time linear in their length.
    Null or empty text: 0 of both; an empty table has no rows. Rows with equal or null ids keep rows of their own; other columns are ignored. The
    vocabulary is read on the driver from ``vocabulary`` and its automaton (a few MB, fixed by the
    file) is sent to the workers; a batch looks each of its distinct words up once.
    """
    spark = docs.sparkSession
    batches_of(spark)
    shared = spark.sparkContext.broadcast(vars(Automaton(*read_vocabulary(vocabulary))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            parts = pc.ascii_split_whitespace(texts)
            coded = parts.flatten().dictionary_encode()
            offsets = np.asarray(parts.offsets)
            offsets = offsets - offsets[0]
            distinct = coded.dictionary.cast(pa.large_binary())
            ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
            data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
            pieces = automaton.count(data, ends[:-1], np.diff(ends)) if len(distinct) else np.zeros(0, np.int64)
            index = np.asarray(coded.indices)
            filled = (np.diff(ends) > 0).astype(np.int64) if len(distinct) else pieces
            sums = [np.concatenate([[0], np.cumsum(v[index])])[offsets] for v in (filled, pieces)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.diff(s), pa.int64()) for s in sums)], [id_col, "n_words", "n_tokens"]
            )

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_words long, n_tokens long")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
