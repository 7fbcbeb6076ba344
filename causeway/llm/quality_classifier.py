"""Quality classifier on learned subword embeddings (operator 5).

Features are hashed: words, and character n-grams of words between ``<`` and
``>``.  With ``repeated`` one more stands for a word that follows itself,
whatever the word: averages of vectors don't see order.  It is no subword;
the README gives the figures with it and without.  Each feature has
a learned vector; a document is the average of its features' vectors, weighed
by a linear softmax layer.  Both are trained by stochastic gradient descent in
numpy (the gradient as it is, with a rate for the layer and one for the
vectors, whose share of a document is small), on a sample of labelled rows of
at most ``max_rows``.  As the layer is linear, a trained model scores a
document by the average of one number for each feature.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import column, id_column, map_rows, text_column

BITS = 17
MASK = (1 << BITS) - 1
GRAMS = (3, 4)
DIMENSION = 12
#: The feature of a word next to itself.
REPEATED = crc32(b"\n") & MASK
#: Words that a worker remembers; beyond it the older half is forgotten.
REMEMBERED = 300_000


def word_features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its character n-grams, which never cut a character."""
    if not word.isascii():
        shown = f"<{word.decode('utf-8')}>"
        return [crc32(shown.encode()) & MASK, *(crc32(shown[i : i + n].encode()) & MASK for n in GRAMS for i in range(len(shown) - n + 1))]
    marked = b"<" + word + b">"
    return [crc32(marked) & MASK, *(crc32(marked[i : i + n]) & MASK for n in GRAMS for i in range(len(marked) - n + 1))]


def features(text: str | None, repeated: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a whole text and how often each occurs."""
    words = (text or "").encode("utf-8").split()
    total = np.zeros(MASK + 1, np.int64)
    for w, n in Counter(words).items():
        np.add.at(total, word_features(w), n)
    if repeated:
        total[REPEATED] += sum(map(eq, words, words[1:]))
    ids = np.flatnonzero(total)
    return ids, total[ids]


@dataclass
class Model:
    """One number for each feature (difference of the two classes' logits) and a bias."""

    weight: np.ndarray
    bias: float
    repeated: bool = True


def gradient(ids: np.ndarray, n: np.ndarray, y: int, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of one document's cross-entropy by the vectors of its features, the layer and the bias."""
    share = n / n.sum()
    hidden = share @ vectors[ids]
    logits = layer @ hidden + bias
    p = np.exp(logits - logits.max())
    error = p / p.sum()
    error[y] -= 1
    return np.outer(share, error @ layer), np.outer(error, hidden), error


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.5, vector_rate: float = 50.0, seed: int = 42, vectors_out: dict | None = None) -> Model:
    """Fit vectors and softmax layer to (features, counts, label) rows; with no rows or one class, the class's smoothed share.

    ``vectors_out`` takes the fitted parameters themselves.
    """
    labels = [y for _, _, y in rows]
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    if len(set(labels)) < 2:
        return Model(np.zeros(MASK + 1), float(np.log(share / (1 - share))))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSION, 1 / DIMENSION, (MASK + 1, DIMENSION))
    layer, bias = np.zeros((2, DIMENSION)), np.array([np.log(1 - share), np.log(share)])
    done, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            ids, n, y = rows[k]
            left = 1 - done / steps
            done += 1
            if not len(ids):
                continue
            by_vectors, by_layer, by_bias = gradient(ids, n, y, vectors, layer, bias)
            vectors[ids] -= left * vector_rate * by_vectors
            layer -= left * rate * by_layer
            bias -= left * rate * by_bias
    if vectors_out is not None:
        vectors_out.update(vectors=vectors, layer=layer, bias=bias)
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; remembers the sum over each word's own features."""

    def __init__(self, model: Model) -> None:
        self.weight, self.bias, self.repeated = model.weight, model.bias, model.repeated
        self.plain = model.weight.tolist()
        self.young: dict[bytes, tuple[float, int]] = {}
        self.old: dict[bytes, tuple[float, int]] = {}

    def _word(self, word: bytes) -> tuple[float, int]:
        found = self.old.get(word)
        if found is None:
            ids = word_features(word)
            found = (sum(map(self.plain.__getitem__, ids)), len(ids))
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[word] = found
        return found

    def score(self, text: str | None) -> float:
        words = (text or "").encode("utf-8").split()
        logit = self.bias
        if words:
            get, own = self.young.get, self._word
            sums, counts = zip(*[get(w) or own(w) for w in words])
            again = sum(map(eq, words, words[1:])) if self.repeated else 0
            logit += (sum(sums) + again * self.plain[REPEATED]) / (sum(counts) + again)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = 3000, repeated: bool = True) -> Model:
    """Train on at most ``max_rows`` labelled documents, those whose id has the smallest hashes among ``usable`` labels.

    Null ids and labels are left out; a document with several labels takes the
    lowest; repeated documents count each time, rows in order of hashes until
    there are ``max_rows``; null and empty texts have no features; empty tables
    give the bias alone; ids are whole numbers; other columns are not read.
    Features are taken from whole texts, however long, on the executors; only
    counts of at most ``2**17`` features for each sampled row reach the driver.
    """
    chosen = (
        labels.select(id_column(labels, doc_id).alias("id"), column(label).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull())
        .groupBy("id")
        .agg(F.min("y").alias("y"))
        .filter(usable)
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
        .collect()
    )
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame([(r.id, r.y) for r in chosen], "id long, y int"))
    named = docs.select(id_column(docs, doc_id).alias("id"), text_column(docs, text).alias("text"))
    rows = named.join(sample, "id").select("id", "text", "y").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for d, t, y in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids, n = features(t, repeated)
                yield [(d, y, ids.astype("<i4").tobytes(), n.astype("<i4").tobytes())]

    found = sorted(map(tuple, map_rows(rows, run, "id long, y int, ids binary, n binary").collect()))
    out = train([(np.frombuffer(i, "<i4"), np.frombuffer(n, "<i4"), y) for _, y, i, n in found])
    return Model(out.weight, out.bias, repeated)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, score)`` of every whole text; null and blank texts get the bias alone; texts of any length are scored whole; every row, repeated or not, gives a row; an empty table gives none; ids are whole numbers or null; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                yield [(d, scorer.score(t)) for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())]

    return map_rows(docs.select(id_column(docs, doc_id).alias("doc_id"), text_column(docs, text).alias("text")), rows, "doc_id long, score double")
