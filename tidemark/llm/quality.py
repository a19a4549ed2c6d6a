"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is described by the pairs of neighbouring characters it holds (lower-case letters one by one, all
upper-case letters, digits and non-ASCII bytes as one class each, punctuation one by one) and by how far its
words repeat. Counts are damped and weighted by inverse document frequency, and projected on the leading
singular vectors of the labelled sample: latent-semantic vectors of unit length.

The labelled vectors, at most LABELLED x LATENT numbers, are broadcast. Every document's cosine with each of
them is computed exactly, block by block; its NEIGHBOURS nearest vote with a weight that grows with
similarity. The score is the weighted share of label 1.

Fitted on at most LABELLED labelled documents (a documented bound); scored over all whole texts.
Null and empty texts have the zero vector and score the share of label 1 among all neighbours. Without
labels every score is 0.5. A null doc_id has the fold of the empty string. Repeated rows get equal scores;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

LABELLED = 4096
LATENT = 48
NEIGHBOURS = 15
BLOCK = 512
MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.3
REPEATS = 4


def _classes() -> tuple[np.ndarray, int]:
    table = np.zeros(256, np.int64)
    table[0x61:0x7B] = np.arange(1, 27)
    table[0x41:0x5B], table[0x30:0x3A], table[0x80:] = 27, 28, 29
    rest = [b for b in range(0x20, 0x7F) if not chr(b).isalnum()]
    table[rest] = np.arange(30, 30 + len(rest))
    return table, 30 + len(rest)


CLASS, N_CLASSES = _classes()
PAIRS = N_CLASSES * N_CLASSES


def features(column: pa.Array) -> np.ndarray:
    """texts x (pairs and repeats), damped counts."""
    data, offsets = K.buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, PAIRS + REPEATS), np.float32)
    if offsets[-1] > offsets[0]:
        c = CLASS[data[offsets[0] : offsets[-1]]]
        pair = c[:-1] * N_CLASSES + c[1:]
        off = offsets - offsets[0]
        for i in range(n):
            a, b = off[i], off[i + 1] - 1
            if b > a:
                out[i, :PAIRS] = np.bincount(pair[a:b], minlength=PAIRS)
        # shares rather than counts, so that a text's length matters little
        length = np.maximum(1, np.diff(off))[:, None]
        out[:, :PAIRS] = np.log1p(out[:, :PAIRS] * (2000 / length))
    w = K.words_of(column, K.SPACED)
    doc = w.doc()
    words = np.maximum(1, w.counts)
    for k, size in enumerate((1, 3)):
        g, at = w.grams(size)
        key = np.sort((doc[at].astype(np.uint64) << np.uint64(40)) | (g >> np.uint64(24)))
        again = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.empty(0, bool)
        out[:, PAIRS + k] = np.bincount((key[again] >> np.uint64(40)).astype(np.int64), minlength=n) / words
    same = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1]))) if len(w) else np.empty(0, bool)
    out[:, PAIRS + 2] = np.bincount(doc[same], minlength=n) / words
    out[:, PAIRS + 3] = np.minimum(2, np.log1p(words) / 6)
    out[:, PAIRS:] *= 10
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def vectors_of(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x), BLOCK):
            cosine = self.vectors_of(x[i : i + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.exp(8 * (np.take_along_axis(cosine, near, 1) - 1))
            out[i : i + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text")).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def fit(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    sample = K.labelled_sample(documents, labels, "quality", MODULUS, HELD_OUT, bound)
    rows = K.map_batches(sample, "label int, x binary", _described).collect()  # at most `bound` rows of half-precision numbers
    size = PAIRS + REPEATS
    if not rows:
        return Model(np.ones(size, np.float32), np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    y = np.array([r.label for r in rows], np.float64)
    del rows
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x *= idf
    k = min(LATENT, *x.shape)
    rng = np.random.default_rng(7)
    q = rng.standard_normal((size, k + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, s, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v[:k].T) * (s[0] / np.maximum(s[:k], 1e-6)) ** 0.5  # weigh rarer directions up
    z = x @ basis
    return Model(idf, basis.astype(np.float32), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), y)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(features(part.column("text"))))], names=["doc_id", "score"])

    scored = K.map_batches(docs, "doc_id long, score double", run)
    return scored.select("doc_id", K.is_held_out(MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(K.read(spark, sf_dir, "documents"), K.read(spark, sf_dir, "labels"))
