"""Toxicity by weak supervision.

Voters are lexicon words and patterns (stems: the first 4, 5 or 6 bytes of longer words). A few words are
given; the rest are mined from the labelled fold, as the words and stems far commoner in documents labelled
toxic. Each voter votes toxic or abstains; one more voter votes clean where none of the others speaks.
A generative label model, a two-class mixture fitted by expectation-maximisation, estimates how accurate
each voter is and how the voters correlate given the class, and counts a group of correlated voters as
fewer voices. The annotated label is one more voter there, taken to err one time in twenty. A logistic regression on the voters is trained on its posterior labels and scores all texts.

Fitted on at most LABELLED labelled documents (a documented bound); scored over all whole texts.
Null and empty texts: no voter speaks, they get the score of a clean text. Without labels or toxic examples
the given words alone vote, with fixed accuracies. A null doc_id has the fold of the empty string. Repeated
rows get equal scores; empty tables give no rows; extra columns are ignored by `toxicity_scores`, kept by
`drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

LABELLED = 8000
#: At most so many mined voters, the strongest: the size of the model, a documented parameter.
VOTERS = 400
STEMS = (4, 5, 6)
MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.7

#: Words that insult.
INSULTS = ["clown", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless",
           "idiota", "imbécil", "estúpido", "basura", "asqueroso", "patético", "imbécile", "stupide", "ordure", "pathétique", "dégoûtant", "dumm", "dummkopf", "abschaum", "widerlich", "müll"]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Text index and hash of every word and stem, and the number of texts. Stems hash apart from words."""
    w = K.words_of(column, K.ALNUM_LOWER)
    doc = w.doc()
    docs, hashes = [doc], [w.hash]
    for length in STEMS:
        h, at = w.prefix(length, K.ALNUM_LOWER)
        docs.append(doc[at])
        hashes.append(K.mix(h + np.uint64(length)))
    return np.concatenate(docs), np.concatenate(hashes), len(w.counts)


def present(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, hash) once."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.empty(0, bool)
    return doc[new], h[new]


def hits(column: pa.Array, voters: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, voter) pairs, each once. voters: sorted hashes."""
    doc, h, n = tokens(column)
    if not len(voters):
        return np.empty(0, np.int64), np.empty(0, np.int64), n
    at = np.minimum(np.searchsorted(voters, h), len(voters) - 1)
    found = voters[at] == h
    pairs = np.unique(doc[found].astype(np.int64) * len(voters) + at[found])
    return pairs // len(voters), pairs % len(voters), n


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, h, _ = tokens(batch.column("text"))
        label = batch.column("label").to_numpy()
        doc, h = present(doc, h)
        values, at = np.unique(h, return_inverse=True)
        toxic = np.bincount(at, label[doc], len(values)).astype(np.int64)
        both = np.bincount(at, minlength=len(values)).astype(np.int64)
        seen = toxic > 0
        yield pa.RecordBatch.from_arrays([pa.array(values[seen].view(np.int64)), pa.array(toxic[seen]), pa.array(both[seen] - toxic[seen])], names=["token", "n1", "n0"])


def _votes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, voter, n = hits(batch.column("text"), shared.value)
            at = np.searchsorted(doc, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([voter[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["label", "votes"])

    return run


@dataclass
class Model:
    voters: np.ndarray  # sorted hashes
    weights: np.ndarray  # a weight for each voter, then for "some voter speaks"
    bias: float
    accuracy: np.ndarray
    correlation: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        doc, voter, n = hits(column, self.voters)
        z = np.full(n, self.bias) + np.bincount(doc, self.weights[voter], n)
        z += self.weights[-1] * (np.bincount(doc, minlength=n) > 0)
        return 1 / (1 + np.exp(-z))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, accuracy of each voter, correlation of voters within a class. votes: rows x voters, 0 or 1."""
    n, m = votes.shape
    post = np.where(labels == 1, 0.9, 0.1)
    discount = np.ones(m)
    for _ in range(rounds):
        w1, w0 = post.sum() + 1, (1 - post).sum() + 1
        p1, p0 = (votes.T @ post + 0.5) / w1, (votes.T @ (1 - post) + 0.05) / w0
        accuracy = p1 * w1 / (p1 * w1 + p0 * w0)
        # what is left of each vote once the class is known
        left = votes - np.outer(post, p1) - np.outer(1 - post, p0)
        cov = left.T @ left / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = cov / np.outer(sd, sd)
        discount = 1 / np.maximum(1, np.clip(correlation, 0, 1).sum(1))
        prior = np.log(w1 / w0)
        hit, miss = np.log(p1 / p0), np.log((1 - p1).clip(1e-6) / (1 - p0).clip(1e-6))
        z = prior + votes @ (discount * hit) + (1 - votes) @ (discount * miss)
        # labels vote too, as one more voter that errs one time in twenty
        z += np.where(labels == 1, np.log(19), -np.log(19))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, accuracy, correlation


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 20, ridge: float = 0.03) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method on soft labels."""
    x = np.column_stack((x, np.ones(len(x))))
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (keep * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        w, now = w - step, new
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    spark = documents.sparkSession
    sample = K.labelled_sample(documents, labels, "toxic", MODULUS, HELD_OUT, bound)
    sizes = dict(sample.groupBy("label").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    given = np.unique(K.words_of(pa.array(INSULTS), K.ALNUM_LOWER).hash)
    if not n1 or not n0:
        return Model(given, np.append(np.full(len(given), 1.0), 3.0), -2.5, np.full(len(given), 0.9), np.eye(len(given)))
    counts = K.map_batches(sample, "token long, n1 long, n0 long", _count_tokens).groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    strong = counts.where(F.col("n1") >= max(2, round(0.002 * n1))).withColumn("score", odds * F.sqrt("n1")).where(odds > 2.5)
    found = strong.orderBy(F.desc("score"), "token").limit(VOTERS).collect()
    voters = np.unique(np.concatenate((given, np.array([r.token for r in found], np.int64).view(np.uint64))))
    rows = K.map_batches(sample, "label int, votes binary", _votes(spark.sparkContext.broadcast(voters))).collect()
    votes = np.zeros((len(rows), len(voters) + 1))
    for i, r in enumerate(rows):
        votes[i, np.frombuffer(r.votes, np.int32)] = 1
    votes[:, -1] = votes[:, :-1].any(1)
    clean = np.column_stack((votes[:, :-1], 1 - votes[:, -1]))  # the last voter speaks where none else does
    post, accuracy, correlation = label_model(clean, np.array([r.label for r in rows]))
    weights, bias = logistic(votes, post)
    return Model(voters, weights, bias, accuracy, correlation)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], names=["doc_id", "score"])

    scored = K.map_batches(docs, "doc_id long, score double", run)
    return scored.select("doc_id", K.is_held_out(MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under the threshold, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(columns.index("text"))) < THRESHOLD))

    return K.map_batches(documents, documents.schema, run)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(K.read(spark, sf_dir, "documents"), K.read(spark, sf_dir, "labels"))
