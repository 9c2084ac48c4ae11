"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and byte n-grams (3 and 4 bytes, running over word borders) are hashed into rows of one embedding
table; a document is the average of its rows, and a softmax over two classes gives the probability of label 1. A pair of two
equal words is written as one fixed repeat mark, so that repetition is learned whatever the word is. The table and the softmax are
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents; every document is scored in whole.

Since the softmax is linear in the average, scoring needs one number for each row: its part of the logit.

Null and empty texts have no features: their score comes from the bias alone. Without labelled rows of both classes every score is 0.5.
Rows with a null label or id are not learned from; repeated label rows count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm.common import extended, mix, slices, text_bytes
from modelgauge.llm.hamming_minhash import word_digests

#: Bounds of the training sample: labelled documents, and bytes of one document to be in it.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 64 << 10
THRESHOLD = 0.3


@dataclass(frozen=True)
class Parameters:
    bits: int = 18
    dim: int = 8
    epochs: int = 6
    rate: float = 2.0
    seed: int = 5


def _gram_rows(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Row of the n-gram that starts at each byte (the last n - 1 bytes have none)."""
    size = max(0, len(data) - n + 1)
    key = np.full(size, n, dtype=np.uint64)
    for i in range(n):
        key = (key << np.uint64(8)) | data[i : size + i]
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _word_rows(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    single = (words >> np.uint64(64 - bits)).astype(np.int64)
    if len(words) < 2:
        return single, np.zeros(0, np.int64)
    pair = mix(words[:-1] * np.uint64(3) + words[1:]) >> np.uint64(64 - bits)
    return single, np.where(words[:-1] == words[1:], 0, pair.astype(np.int64))


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kinds of features over all documents end to end: (rows, begin, end of each document)."""
    words, at = word_digests(data, offsets, lower=False)
    single, pair = _word_rows(words, bits)
    a, b = offsets[:-1], offsets[1:]
    out = [(single, at[:-1], at[1:]), (pair, at[:-1], np.maximum(at[1:] - 1, at[:-1]))]
    for n in (3, 4):
        out.append((_gram_rows(data, n, bits), a, np.maximum(b - n + 1, a)))
    return out


@dataclass(frozen=True)
class Model:
    """Part of the logit of each table row, and the bias; embeddings and softmax weights as trained."""

    bits: int
    bias: float
    parts: np.ndarray
    embeddings: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for rows, a, b in features(data, offsets, self.bits):
            run = np.zeros(len(rows) + 1)
            np.cumsum(self.parts[rows], out=run[1:])
            some = b > a  # documents too short for this kind have none
            total[some] += run[b[some]] - run[a[some]]
            count += b - a
        logit = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(texts: pa.Array, labels: np.ndarray, p: Parameters = Parameters()) -> Model:
    """Stochastic gradient descent over one document at a time with a falling rate."""
    if not len(labels) or labels.min() == labels.max():
        return Model(p.bits, 0.0, np.zeros(1 << p.bits, np.float32))
    docs = []
    for i in range(len(texts)):
        data, offsets = text_bytes(texts.slice(i, 1))
        rows = np.concatenate([r[a[0] : b[0]] for r, a, b in features(data, offsets, p.bits)])
        index, n = np.unique(rows, return_counts=True)
        docs.append((index.astype(np.int32), (n / max(1, len(rows))).astype(np.float32)))
    rng = np.random.default_rng(p.seed)
    table = rng.uniform(-1 / p.dim, 1 / p.dim, (1 << p.bits, p.dim)).astype(np.float32)
    weights = np.zeros((p.dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps = p.epochs * len(docs)
    for step in range(steps):
        if step % len(docs) == 0:
            order = rng.permutation(len(docs))
        k = order[step % len(docs)]
        index, share = docs[k]
        rate = np.float32(p.rate * (1 - step / steps))
        hidden = share @ table[index] if len(index) else np.zeros(p.dim, np.float32)
        logit = hidden @ weights + bias
        prob = np.exp(logit - logit.max())
        prob /= prob.sum()
        prob[labels[k]] -= 1
        back = weights @ prob
        weights -= rate * np.outer(hidden, prob)
        bias -= np.float32(0.05) * rate * prob
        if len(index):
            table[index] -= rate * share[:, None] * back
    return Model(p.bits, float(bias[1] - bias[0]), table @ (weights[:, 1] - weights[:, 0]), table, weights)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters(), rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most `rows` labelled documents outside the held-out fold, taken in the order of the digest of their ids."""
    chosen = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` ids
    got = picked.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality")).orderBy("doc_id").toArrow().combine_chunks()
    if not got.num_rows:
        return train(pa.array([], pa.string()), np.zeros(0, int), p)
    return train(got.column("text").combine_chunks(), np.asarray(got.column("quality")).astype(int), p)


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    light = Model(model.bits, model.bias, model.parts.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                found = light.scores(*text_bytes(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """`keep` columns, score double and predicted int of every row of `docs`; `with_text` keeps the text too."""
    rows = docs.select(*keep, "text")
    out = rows.mapInArrow(_scorer(model), extended(rows, "score double"))
    return (out if with_text else out.drop("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
