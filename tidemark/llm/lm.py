"""Language-model scores: a causal self-attention model over subword ids, beside a unigram baseline.

Texts are lower-cased (A-Z) and split at ASCII space; a word's subwords are those of a space and the word. The
probability of a text is the product over its ids, the end included, of

    P(id | the ids before) = P(class of id | the ids before) * product over the nodes from its class to it of P(left or right | the ids before),

all by the state of the attention at the id before.

* Classes and groups. Ids are clustered by the company they keep (counts of hashed neighbours, over the whole
  training fold): CLASSES classes to be predicted, GROUPS finer groups to be looked back at. The most frequent ids
  are classes and groups of their own.
* The class is predicted by one head of masked self-attention over the groups of the CONTEXT ids up to the one
  before, on top of the logarithm of how often each class follows each group.
* The ids of a class are the leaves of a binary tree, like ids near each other. Each node has a vector; the log odds of going left are
  its product with the attention's state, on top of the log odds by counts: for the TOP heaviest nodes after the
  group of the id before, for the others after any. So the state tells every id from every other.
* The counts are over all ids of the training fold; they are the biases of the output layer, GROUPS by TOP numbers and one a node,
  whatever the size of the corpus.
* The attention is trained in numpy on every id of every training text, once: texts are cut into windows that do not
  overlap, in pieces that are dealt by hash to ROUNDS rounds and to shards of a bounded number of windows. A shard takes one
  local step for each BATCH windows, in order of hash; the weights of a round's shards are averaged, as whole numbers of
  1 / UNIT, so that the sum has no order; nodes' vectors count by their visits. So the model does not depend on how Spark has partitioned the rows.
* A text is scored in windows that overlap by OVERLAP ids; each id is scored once, from the one window that has
  the most ids before it. Scores are sums of proper log probabilities.

The baseline needs every word's count. Words that at least one document in 2 * COMMON holds are counted apart and
broadcast: no more than 2 * COMMON times the mean number of distinct words of a text can be that common. All others
go, once for each document, to the bucket of their hash, which adds up what they contribute to each document. The
number of buckets follows from the number of words.

Null and empty texts have the end alone. A null doc_id has the fold of the empty string. Repeated rows get
equal scores and all count. Without training documents all counts are 0 and the model is uniform within and over
classes. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.packing import encoder

MODULUS, HELD_OUT = 7, 2
VOCABULARY = 50257
END = 50256
#: Classes to predict and groups to look back at: so many frequent ids of their own, so many clusters.
OWN, CLUSTERS = 16, 16
OWN_GROUPS, GROUP_CLUSTERS = 256, 256
CLASSES, GROUPS = OWN + CLUSTERS, OWN_GROUPS + GROUP_CLUSTERS
WIDTH, CONTEXT, OVERLAP = 8, 24, 4
ROUNDS, BATCH, RATE = 2, 128, 0.02
#: Nodes of the trees within classes whose odds are counted for each group, the heaviest; the others' for all groups as one. Rate of their vectors.
TOP, NODE_RATE = 2048, 0.1
#: Windows of a shard, and of a piece.
SHARD, PIECE = 200_000, 64
#: Weights are summed up in steps of 1 / UNIT for each window.
UNIT = 1 << 16
COMMON = 50
#: Neighbours are hashed into so many cells; their distances.
CELLS, REACH = 64, (1, 4)
#: Steps of 1 / SCALE in which `coded` gives log probabilities, down to -65535 / SCALE.
SCALE = 2700
#: Words whose ids a worker keeps, about 50 bytes each.
KNOWN = 1_000_000
#: Bytes of words in a bucket.
BUCKET_BYTES = 128 << 20
LOG10 = 1 / np.log(10)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order of their first places, and the index of each hash among them."""
    coded = pa.array(hashes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


@lru_cache(maxsize=2)
def subwords_of(path: str | None) -> "Subwords":
    """Read once for all tasks of a worker."""
    return Subwords(path)


class Subwords:
    """Subword ids of words, found once for each distinct word of a batch."""

    def __init__(self, path: str | None):
        import public_tokenizers

        self.enc = encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.size = np.array([len(self.enc.decode_single_token_bytes(i)) if i != END else 0 for i in range(VOCABULARY)], np.int64)
        #: Hashes in order, bounds of their ids, ids.
        self.known, self.bounds, self.ids = np.empty(0, np.uint64), np.zeros((2, 0), np.int64), np.empty(0, np.uint32)

    def of(self, w: K.Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, index of each word among them, first id of each distinct word and one past the last, ids).

        Ids of the first KNOWN words are kept: they depend on the word alone.
        """
        values, inverse = distinct(w.hash)
        at = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))
        there, place = _among(values, self.known)
        new = np.flatnonzero(~there)
        if not len(new):
            return values, inverse, self.bounds[:, place], self.ids
        bounds, ids = self._encoded(w, table, at[new])
        found = np.empty((2, len(values)), np.int64)
        found[:, there], found[:, new] = self.bounds[:, place[there]], bounds + len(self.ids)
        joined = np.concatenate((self.ids, ids))
        if len(self.known) + len(new) <= KNOWN:
            new = new[np.argsort(values[new])]
            place = np.searchsorted(self.known, values[new])
            self.known, self.bounds, self.ids = np.insert(self.known, place, values[new]), np.insert(self.bounds, place, found[:, new], axis=1), joined
        return values, inverse, found, joined

    def _encoded(self, w: K.Words, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id of each of these words and one past the last, ids)."""
        folded = table[w.data]
        starts, ends = w.starts[at], w.ends[at]
        lengths = ends - starts + 1
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        raw = np.full(int(bounds[-1]), 0x20, np.uint8)
        place = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], lengths)
        inside = place > 0
        raw[inside] = folded[(np.repeat(starts, lengths) + place - 1)[inside]]
        raw[raw == 255] = 0
        ids = self.enc.encode_to_numpy(raw.tobytes().decode(), disallowed_special=()) if len(raw) else np.empty(0, np.uint32)
        reach = np.cumsum(self.size[ids])
        last = np.searchsorted(reach, bounds[1:], side="left") + 1
        if len(ids) and not np.array_equal(reach[last - 1], bounds[1:]):  # white space beyond ASCII joined two words
            parts = [self.enc.encode_to_numpy(raw[a:b].tobytes().decode(), disallowed_special=()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ids, last = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        first = np.concatenate(([0], last[:-1])).astype(np.int64)
        return np.stack((first, last)), np.asarray(ids, np.uint32)

    def sequences(self, w: K.Words, found: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each with its end; and the bounds of the texts."""
        _, inverse, (first, last), ids = found
        n = (last - first).take(inverse)
        total = np.concatenate(([0], np.cumsum(n)))
        bounds = total[w.first] + np.arange(len(w.first))
        out = np.full(int(bounds[-1]), END, np.uint16)
        word = np.repeat(np.arange(len(n)), n)
        place = np.arange(int(total[-1]))
        flat = ids.take((first.take(inverse) - total[:-1]).take(word) + place)
        place += w.doc().take(word)
        out[place] = flat
        return out, bounds


def _present(w: K.Words, inverse: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, distinct word, times), each pair once."""
    pair, tf = np.unique(w.doc() * max(1, n) + inverse, return_counts=True)
    return pair // max(1, n), pair % max(1, n), tf


GATHERED = "kind int, slot long, n long, body binary"
SLICES = 64
SPAN = -(-VOCABULARY // SLICES)


def _gather(path: str | None):
    """Of the training fold: neighbours of ids (kind 0, by slice of ids), texts (2); of all: words common in some part (1), sizes (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(path)
        cells = neighbour_cells().astype(np.int32)
        company, texts, words = np.zeros(SLICES * SPAN * CELLS, np.int64), 0, 0
        kept, kept_texts = [], 0
        for batch in batches:
            w = K.words_of(batch.column("text"), K.SPACED_LOWER)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            found = subwords.of(w, K.SPACED_LOWER)
            values, inverse, _, _ = found
            _, word, _ = _present(w, inverse, len(values))
            kept.append((values, np.bincount(word, minlength=len(values))))
            kept_texts, texts, words = kept_texts + len(train), texts + len(train), words + len(word)
            if kept_texts >= 8 * COMMON:
                yield from _common(kept, kept_texts)
                kept, kept_texts = [], 0
            ids, bounds = subwords.sequences(w, found)
            length = np.diff(bounds)
            of_train = ids[np.repeat(train, length)].astype(np.int32)
            text = np.repeat(np.arange(int(train.sum()), dtype=np.int32), length[train])
            for d in REACH:
                same = text[d:] == text[:-d]
                one, other = of_train[:-d][same], of_train[d:][same]
                np.add.at(company, (other * np.int32(CELLS) + cells.take(one)).astype(np.int64), 1)
                np.add.at(company, (one * np.int32(CELLS) + cells.take(other)).astype(np.int64), 1)
            del text, of_train, same, one, other
            keys = batch.column("row_key").to_numpy()
            rows = [(2, int(keys[i]), int(length[i]), ids[bounds[i] : bounds[i + 1]].tobytes()) for i in np.flatnonzero(train).tolist()]
            if rows:
                yield _rows(rows)
        yield from _common(kept, kept_texts)
        rows = []
        for k, part in enumerate(np.split(company, SLICES)):
            at = np.flatnonzero(part)
            if len(at):
                rows.append((0, k, 0, np.stack((at, part[at])).astype(np.uint32).tobytes()))
        yield _rows([*rows, (3, words, texts, b"")])

    return run


def _common(kept: list[tuple], texts: int) -> Iterator[pa.RecordBatch]:
    """Words that one of COMMON of these texts holds, with the number that do."""
    if not texts:
        return
    values, at = np.unique(np.concatenate([v for v, _ in kept]), return_inverse=True)
    df = np.bincount(at, np.concatenate([n for _, n in kept]), len(values)).astype(np.int64)
    there = np.flatnonzero(df * COMMON >= texts) if texts >= COMMON else np.empty(0, np.int64)
    if len(there):
        yield _rows([(1, v, n, b"") for v, n in zip(values[there].view(np.int64).tolist(), df[there].tolist(), strict=True)])


def neighbour_cells() -> np.ndarray:
    return (K.mix(np.arange(VOCABULARY, dtype=np.uint64) + np.uint64(7)) % np.uint64(CELLS)).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["kind", "slot", "n", "body"])


def _add(size: int):
    """Sums of sparse counts (places, times) of a slot, laid out whole."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for body in table.column("body").to_pylist():
            at, n = np.frombuffer(body, np.uint32).reshape(2, -1)
            total[at] += n
        return pa.table({"slot": table.column("slot").slice(0, 1).combine_chunks(), "body": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    return run


def cluster(features: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of the rows."""
    rng = np.random.default_rng(3)
    centres = features[rng.choice(len(features), k, replace=False, p=weight / weight.sum())].copy()
    for _ in range(rounds):
        near, total = np.empty(len(features), np.int64), np.zeros_like(centres)
        for i in range(0, len(features), 4096):  # a block at a time: the driver's memory is small
            block = features[i : i + 4096]
            near[i : i + 4096] = (block @ centres.T).argmax(1)
            order = np.argsort(near[i : i + 4096], kind="stable")
            edge = np.flatnonzero(np.diff(near[i : i + 4096][order], prepend=-1))
            total[near[i : i + 4096][order][edge]] += np.add.reduceat(block[order] * weight[i : i + 4096][order, None], edge, axis=0)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-9), centres).astype(np.float32)
    return near


class Model:
    """Classes, groups and trees of ids, the attention's weights, the nodes' vectors, and the counts that are biases:
    after (log share of each class after each group), tree.bias (log odds of each node) and turned (what each group adds at the TOP heaviest; the last column is 0).
    """

    def __init__(self, company: np.ndarray):
        """company: ids x CELLS, how often each id has neighbours in each cell, over all training texts."""
        features = company[:VOCABULARY].astype(np.float32)
        total = features.sum(1)
        self.weight = total / (2 * len(REACH)) + np.float32(0.5)
        mean = (features.sum(0) + 1) / (features.sum() + CELLS)
        features += 8 * mean  # in place, here and below
        features /= total[:, None] + 8
        np.sqrt(features, out=features)
        features -= np.sqrt(mean)
        features /= np.linalg.norm(features, axis=1, keepdims=True) + np.float32(1e-9)
        order = np.argsort(-total, kind="stable")
        self.of, self.group = (self._parted(order, features, own, k) for own, k in ((OWN, CLUSTERS), (OWN_GROUPS, GROUP_CLUSTERS)))
        rng = np.random.default_rng(11)
        d = WIDTH
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(d)).astype(np.float32)
        self.weights = {
            "embed": small(GROUPS + 1, d), "place": small(CONTEXT, d) * np.float32(0.3), "q": small(d, d), "k": small(d, d), "v": small(d, d), "o": small(d, d),
            "out": np.zeros((d, CLASSES), np.float32),
        }
        self.tree = Tree(self.of, self.weight, features)
        self.nodes = np.zeros((len(self.tree.bias), d), np.float32)
        self.turned = np.zeros((GROUPS + 1, TOP + 1), np.float32)
        self.tables(np.zeros((GROUPS + 1, CLASSES)))

    def _parted(self, order: np.ndarray, features: np.ndarray, own: int, k: int) -> np.ndarray:
        of = np.zeros(VOCABULARY, np.int64)
        of[order[:own]] = np.arange(own)
        rest = order[own:]
        of[rest] = own + cluster(features[rest], np.sqrt(self.weight[rest]), k)
        return of

    def tables(self, pairs: np.ndarray) -> None:
        """pairs: how often each class follows each group (the last: nothing)."""
        self.mass = np.bincount(self.of, self.weight, CLASSES) + 1e-9
        alone = self.mass / self.mass.sum()
        self.after = np.log((pairs + 5 * alone) / (pairs.sum(1, keepdims=True) + 5)).astype(np.float32)


class Tree:
    """Binary trees over the ids of each class: like ids near each other, halves of about equal weight.

    Nodes are numbered by falling weight. The path of an id is nodes[first[id]:first[id + 1]]; side is 1 where it goes left, else -1.
    """

    def __init__(self, of: np.ndarray, weight: np.ndarray, features: np.ndarray):
        along = np.zeros(VOCABULARY, np.float32)
        for c in range(CLASSES):
            there = np.flatnonzero(of == c)
            if len(there) > 1:
                part = features[there] - features[there].mean(0)
                along[there] = part @ np.linalg.eigh(part.T @ part)[1][:, -1]
        self.order = np.lexsort((along, of)).astype(np.uint16)
        self.before = np.concatenate(([0.0], np.cumsum(weight[self.order], dtype=np.float64)))
        low = np.searchsorted(of[self.order], np.arange(CLASSES))
        high = np.searchsorted(of[self.order], np.arange(CLASSES), side="right")
        lows, cuts, highs = [], [], []
        while len(low):
            wide = high - low > 1
            low, high = low[wide], high[wide]
            middle = np.searchsorted(self.before, (self.before[low] + self.before[high]) / 2)
            near = self.before[middle] + self.before[middle - 1] > self.before[low] + self.before[high]  # the edge before is nearer to the half
            cut = np.clip(middle - near, low + 1, high - 1)
            lows, cuts, highs = [*lows, low], [*cuts, cut], [*highs, high]
            low, high = np.concatenate((low, cut)), np.concatenate((cut, high))
        low, cut, high = (np.concatenate(x) for x in (lows, cuts, highs))
        by_weight = np.argsort(self.before[low] - self.before[high], kind="stable")
        self.low, self.cut, self.high = low[by_weight], cut[by_weight], high[by_weight]
        left, right = self.counts(self.before)
        self.bias = np.log(left / right).astype(np.float32)
        n = self.high - self.low
        node = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(node)) - np.repeat(np.cumsum(n) - n - self.low, n)
        by_id = np.argsort(self.order[place], kind="stable")
        self.nodes = node[by_id].astype(np.uint16)
        self.side = np.where(place < self.cut[node], 1, -1)[by_id].astype(np.float32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.order[place], minlength=VOCABULARY)))).astype(np.int32)

    def counts(self, before: np.ndarray, nodes: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """What lies left and right of nodes; before: running sums of counts in the trees' order."""
        low, cut, high = self.low[nodes], self.cut[nodes], self.high[nodes]
        return before[cut] - before[low], before[high] - before[cut]

    def visits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index into ids, node, side) of all nodes on the ids' paths, and how many each id has."""
        first = self.first.take(ids)
        n = self.first.take(ids + 1) - first
        where = np.repeat(np.arange(len(ids)), n)
        at = (first - (np.cumsum(n) - n)).take(where)
        at += np.arange(len(at))
        return where, self.nodes.take(at), self.side.take(at), n

    def levels(self, ids: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
        """The same visits, by depth: order of the ids by falling length of path, how many of them reach each depth, and nodes and sides of these, depth after depth."""
        first = self.first.take(ids)
        n = self.first.take(ids + 1) - first
        order = np.argsort((65535 - n).astype(np.uint16), kind="stable")
        first = first.take(order)
        counts = (len(ids) - np.cumsum(np.bincount(n)))[:-1].tolist() if len(ids) else []
        at = np.concatenate([first[:c] + np.int32(depth) for depth, c in enumerate(counts)]) if counts else first[:0]
        return order, counts, self.nodes.take(at), self.side.take(at)


def odds_at(bias: np.ndarray, turned: np.ndarray, group: np.ndarray, where: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Logarithm of the odds of going left at these nodes by the counts alone, after the groups of the places `where`; see Model."""
    at = (group * (TOP + 1)).take(where)
    at += np.minimum(node, np.uint16(TOP))
    out = turned.take(at)
    out += bias.take(node)
    return out


def dots(vectors: np.ndarray, node: np.ndarray, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(products, vectors, states) at the visited nodes."""
    v, s = vectors.take(node, axis=0), h.take(of, axis=0)
    return (v * s) @ np.ones(WIDTH, v.dtype), v, s


MASK = np.where(np.tril(np.ones((CONTEXT, CONTEXT), bool)), np.float32(0), np.float32(-1e9))


def forward(p: dict[str, np.ndarray], before: np.ndarray, after: np.ndarray) -> tuple:
    """Logits of the class at each place of the windows; before: the groups just before (GROUPS: none); after: see Model.tables."""
    n, t = before.shape
    x = p["embed"][before] + p["place"][:t]
    q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(1 / np.sqrt(WIDTH))
    a += MASK[:t, :t]
    a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    c = a @ v
    h = x + c @ p["o"]
    logits = h.reshape(n * t, WIDTH) @ p["out"]
    logits += after[before.ravel()]
    return x, q, k, v, a, c, h, logits


def log_softmax_at(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the class at each place."""
    top = logits[np.arange(len(target)), target]
    most = logits.max(1, keepdims=True)
    return top - most[:, 0] - np.log(np.exp(logits - most).sum(1))


LOWER = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
#: Beyond this, exp() of single precision overflows; trained scores stay far below.
BOUND = np.float32(60)


def bounded_exp(a: np.ndarray) -> None:
    """In place."""
    if a.size and a.max() > BOUND:
        np.minimum(a, BOUND, out=a)
    np.exp(a, out=a)


class Scorer:
    """Log probabilities of classes, as `forward` and `log_softmax_at` give them, in fewer passes over memory."""

    def __init__(self, p: dict[str, np.ndarray], after: np.ndarray):
        scale = np.float32(1 / np.sqrt(WIDTH))
        self.p, self.after, self.odds = p, after, np.exp(after)
        self.qkv = np.concatenate((p["q"] * scale, p["k"], p["v"]), 1)
        self.ones = np.ones((1, CONTEXT, 1), np.float32)

    def __call__(self, before: np.ndarray, target: np.ndarray, skip: int) -> np.ndarray:
        """Log probabilities at the places from `skip` on; before: all places of the windows, target: those from `skip` on."""
        return self.both(before, target, skip)[0]

    def both(self, before: np.ndarray, target: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Those, and the attention's states there."""
        n, t = before.shape
        m = t - skip
        x = self.p["embed"].take(before, axis=0)
        x += self.p["place"]
        q, k, v = np.split((x.reshape(n * t, WIDTH) @ self.qkv).reshape(n, t, 3 * WIDTH), 3, axis=2)
        a = q[:, skip:] @ k.transpose(0, 2, 1)
        bounded_exp(a)
        a *= LOWER[skip:]
        mixed = np.concatenate((v, np.broadcast_to(self.ones, (n, t, 1))), 2)  # the last column adds up the weights
        c = (a @ mixed).reshape(n * m, WIDTH + 1)
        h = (c[:, :-1] / c[:, -1:]) @ self.p["o"]
        h += x[:, skip:].reshape(n * m, WIDTH)
        logits = h @ self.p["out"]
        last, target = before[:, skip:].ravel(), target.ravel()
        top = logits.take(np.arange(0, n * m * CLASSES, CLASSES) + target) + self.after.take(last * CLASSES + target)
        bounded_exp(logits)
        logits *= self.odds.take(last, axis=0)
        return (top - np.log(logits @ np.ones(CLASSES, logits.dtype))).reshape(n, m), h


def gradient(p: dict[str, np.ndarray], before: np.ndarray, target: np.ndarray, odds: np.ndarray, below=None) -> dict[str, np.ndarray]:
    """Of the mean loss over the places with a class (target >= 0), as `forward` and `log_softmax_at` give it; odds: exp(after).

    below: gives, of the attention's states at all places, the gradient of the loss within classes, in sum over places.
    """
    n, t = before.shape
    scale = np.float32(1 / np.sqrt(WIDTH))
    last = before.ravel()
    x = p["embed"].take(last, axis=0)
    x.reshape(n, t, WIDTH)[:] += p["place"][:t]
    mixing = np.concatenate((p["q"] * scale, p["k"], p["v"]), 1)
    mixed = np.ones((n, t, 3 * WIDTH + 1), x.dtype)  # the last column adds up the attention's weights
    mixed[..., :-1] = (x @ mixing).reshape(n, t, 3 * WIDTH)
    q, k, v = mixed[..., :WIDTH], mixed[..., WIDTH : 2 * WIDTH], mixed[..., 2 * WIDTH :]
    a = q @ k.transpose(0, 2, 1)
    bounded_exp(a)
    a *= LOWER[:t, :t]
    c = (a @ v).reshape(n * t, WIDTH + 1)
    whole = 1 / c[:, -1:]
    c = c[:, :-1] * whole
    h = x + c @ p["o"]
    logits = h @ p["out"]
    bounded_exp(logits)
    logits *= odds.take(last, axis=0)
    flat = target.ravel()
    known = np.flatnonzero(flat >= 0)
    total = logits @ np.ones(CLASSES, logits.dtype)
    logits.reshape(-1)[known * CLASSES + flat[known]] -= total[known]
    share = np.zeros((n * t, 1), logits.dtype)
    share[known, 0] = 1 / (max(1, len(known)) * total[known])
    g = {"out": (logits.T @ (h * share)).T}
    dh = logits @ p["out"].T
    dh *= share
    if below is not None:
        dh += below(h) * logits.dtype.type(1 / max(1, len(known)))
    g["o"] = c.T @ dh
    dc = np.empty((n * t, WIDTH + 1), x.dtype)
    np.multiply(dh @ p["o"].T, whole, out=dc[:, :-1])
    dc[:, -1] = -np.einsum("ij,ij->i", dc[:, :-1], c)
    dc = dc.reshape(n, t, WIDTH + 1)
    da = dc @ v.transpose(0, 2, 1)
    da *= a
    d = np.empty((n, t, 3 * WIDTH), x.dtype)
    d[..., :WIDTH], d[..., WIDTH : 2 * WIDTH], d[..., 2 * WIDTH :] = da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dc[..., :-1]
    d = d.reshape(n * t, 3 * WIDTH)
    dh += d @ mixing.T
    g["q"], g["k"], g["v"] = np.split(x.T @ d, 3, axis=1)
    g["q"] = g["q"] * scale
    g["place"] = np.zeros_like(p["place"])
    g["place"][:t] = dh.reshape(n, t, WIDTH).sum(0)
    g["embed"] = np.zeros_like(p["embed"])
    at, sums = sums_by(last.astype(np.uint16), dh)
    g["embed"][at] = sums
    return g


def sums_by(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their rows."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else np.empty(0, np.int64)
    return ordered[edge], np.add.reduceat(rows.take(order, axis=0), edge, axis=0) if len(key) else rows


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each window, first place it scores, one past the last, over texts with these bounds."""
    length = np.diff(bounds)
    stride = CONTEXT - OVERLAP
    n = 1 + np.maximum(0, -(-(length - CONTEXT) // stride))
    text = np.repeat(np.arange(len(length)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = bounds[text] + k * stride
    return first, np.where(k == 0, first, first + OVERLAP), np.minimum(first + CONTEXT, bounds[text + 1])


def _count_pairs(shared):
    """How often each id follows each group: sparse, by slot of eight groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = shared.value, [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys = keys.astype(np.int64)
            slot = keys // (8 * VOCABULARY)
            cut = np.flatnonzero(np.diff(slot)) + 1
            yield _rows([(0, int(slot[part[0]]), 0, np.stack((keys[part] - slot[part[0]] * 8 * VOCABULARY, n[part])).astype(np.uint32).tobytes()) for part in np.split(np.arange(len(keys)), cut)])

        for batch in batches:
            for body in batch.column("body").to_pylist():
                ids = np.frombuffer(body, np.uint16).astype(np.int64)
                held.append((np.concatenate(([GROUPS], group[ids[:-1]])) * VOCABULARY + ids).astype(np.uint32))
                size += len(ids)
            if size > 2_000_000:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return run


def _layer(shared):
    """Of eight groups: how often each class follows, and by how much the log odds of the heaviest nodes differ from all groups' as one."""

    def run(table: pa.Table) -> pa.Table:
        of, tree = shared.value
        count = np.frombuffer(_add(8 * VOCABULARY)(table).column("body")[0].as_py(), np.uint32).reshape(8, VOCABULARY).astype(np.float64)
        pairs = np.stack([np.bincount(of, c, CLASSES) for c in count])
        turned = np.stack([turned_by(tree, c) for c in count])
        return pa.table({"slot": table.column("slot").slice(0, 1).combine_chunks(), "pairs": pa.array([pairs.tobytes()], pa.binary()), "turned": pa.array([turned.tobytes()], pa.binary())})

    return run


def turned_by(tree: Tree, count: np.ndarray) -> np.ndarray:
    """What these counts of ids add to the log odds of the TOP heaviest nodes."""
    left, right = tree.counts(np.concatenate(([0.0], np.cumsum(count[tree.order]))), slice(0, TOP))
    usual = 1 / (1 + np.exp(-tree.bias[:TOP].astype(np.float64)))
    return (np.log((left + 5 * usual) / (right + 5 * (1 - usual))) - tree.bias[:TOP]).astype(np.float32)


def coded(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-SCALE * np.log(p)), 65535).astype(np.uint16)


PIECES = "turn int, shard long, order long, starts boolean, body binary"


def _pieces(shards: int, turn: int):
    """Pieces of a round: PIECE windows of a text at most, with the id before them if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 * CONTEXT * PIECE
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            n = np.array([-(-len(b) // size) for b in bodies], np.int64)
            text = np.repeat(np.arange(len(n)), n)
            number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            order = K.mix(batch.column("slot").to_numpy().view(np.uint64)[text] + K.mix(number.astype(np.uint64)))
            mine = np.flatnonzero((order >> np.uint64(40)) % np.uint64(ROUNDS) == turn)
            cut = [bodies[i][max(0, k * size - 2) : (k + 1) * size] for i, k in zip(text[mine].tolist(), number[mine].tolist(), strict=True)]
            order = order[mine]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(mine), turn, np.int32)), pa.array((order % np.uint64(shards)).astype(np.int64)), pa.array((order >> np.uint64(1)).astype(np.int64)),
                pa.array(number[mine] == 0, pa.bool_()), pa.array(cut, pa.binary()),
            ], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def laid_out(of: np.ndarray, group: np.ndarray, bodies: list[np.ndarray], starts: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of pieces, none of which overlaps another: the group before each place, and the class there (-1: none)."""
    befores, targets = [], []
    for ids, start in zip(bodies, starts, strict=True):
        before = np.concatenate(([GROUPS], group[ids[:-1]])) if start else group[ids[:-1]]
        target = of[ids if start else ids[1:]]
        n = -(-len(target) // CONTEXT) * CONTEXT
        befores.append(np.concatenate((before, np.full(n - len(before), GROUPS))).astype(np.int16))
        targets.append(np.concatenate((target, np.full(n - len(target), -1))).astype(np.int32))
    return np.concatenate(befores).reshape(-1, CONTEXT), np.concatenate(targets).reshape(-1, CONTEXT)


TRAINED = "part int, n long, body binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[bool]]]:
    """Pieces of each shard, which follow each other, and whether they start a text."""
    shard, bodies, starts = None, [], []
    for batch in batches:
        keys = batch.column("shard").to_numpy()
        body, start = batch.column("body").to_pylist(), batch.column("starts").to_pylist()
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []:
            if bodies and keys[part[0]] != shard:
                yield bodies, starts
                bodies, starts = [], []
            shard = keys[part[0]]
            bodies += [np.frombuffer(body[i], np.uint16) for i in part]
            starts += [start[i] for i in part]
    if bodies:
        yield bodies, starts


def _train(shared, turn: int):
    """Local steps from the shared weights over each shard's windows, shards in order; gives the sums over the task's shards
    of the weights times the number of windows (part -1), and of the nodes' visits and vectors times those, in SLICES parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, nodes, odds, of, group, tree, turned = shared.value
        n, total, below = 0, 0, np.zeros((len(nodes), WIDTH + 1), np.int64)
        for bodies, starts in _shards(batches):
            before, target = laid_out(np.arange(VOCABULARY), group, bodies, starts)
            mixed = np.argsort(K.mix(np.arange(len(before), dtype=np.uint64)), kind="stable")  # windows of a text apart from each other
            before, target = before[mixed], target[mixed]
            p, vectors = stepped(weights, nodes, before, target, odds, of, tree, turned, turn)
            flat = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)
            times = sum(np.bincount(part[part >= 0], minlength=VOCABULARY) for part in np.array_split(target, 1 + len(target) // 4096))
            visits = np.add(*tree.counts(np.concatenate(([0], np.cumsum(times[tree.order])))))
            n, total = n + len(before), total + np.rint(flat * UNIT).astype(np.int64) * len(before)
            below[:, 0] += visits
            below[:, 1:] += np.rint(vectors.astype(np.float64) * UNIT).astype(np.int64) * visits[:, None]
        if n:
            parts = [total, *np.array_split(below, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, SLICES), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "n", "body"])

    return run


def _sum_of_part(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table.column("body").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1).combine_chunks(), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "body": pa.array([total.tobytes()], pa.binary())})


def stepped(weights: dict[str, np.ndarray], nodes: np.ndarray, before: np.ndarray, target: np.ndarray, odds: np.ndarray, of: np.ndarray, tree: Tree, turned: np.ndarray, turn: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The weights and the nodes' vectors after steps over the windows in order, each taken once: Adam's method, and for nodes steps by their own squares."""
    names = sorted(weights)
    flat = np.concatenate([weights[k].ravel() for k in names])
    at = np.cumsum([0, *[weights[k].size for k in names]])
    p = {k: flat[a:b].reshape(weights[k].shape) for k, a, b in zip(names, at[:-1], at[1:], strict=True)}
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    nodes, squares = nodes.copy(), np.full(len(nodes), 1e-6, np.float32)
    classes = np.append(of, -1)  # -1: none
    for step, i in enumerate(range(0, len(before), BATCH), 1):
        slowed = min(1, step / 20) / (1 + turn)
        group, ids = before[i : i + BATCH].astype(np.int64), target[i : i + BATCH].astype(np.int64)

        def below(h: np.ndarray) -> np.ndarray:
            dh, row, sums = slopes(tree, turned, nodes, h, np.flatnonzero(ids.ravel() >= 0), group.ravel(), ids.ravel())
            size = squares.take(row) + np.einsum("ij,ij->i", sums, sums) * np.float32(1 / WIDTH)
            squares[row] = size
            nodes[row] = nodes.take(row, axis=0) - sums * (np.float32(NODE_RATE * slowed) / np.sqrt(size))[:, None]
            return dh

        by_name = gradient(p, group, classes[ids], odds, below)
        g = np.concatenate([by_name[k].ravel() for k in names])
        m += np.float32(0.1) * (g - m)
        s += np.float32(0.01) * (g * g - s)
        flat -= np.float32(RATE * slowed / (1 - 0.9**step)) * m / (np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-7))
    return p, nodes


def at_nodes(tree: Tree, turned: np.ndarray, nodes: np.ndarray, h: np.ndarray, inside: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places with a path and the first of their visits; of each visit from `inside`: node, slope of the loss by the log odds, vector, state."""
    where, node, side, n = tree.visits(ids.take(inside))
    where = inside.take(where)
    z, vectors, states = dots(nodes, node, h, where)
    z += odds_at(tree.bias, turned, group, where, node)
    z *= side
    bounded_exp(z)
    z += 1
    some = np.flatnonzero(n)
    return inside.take(some), (np.cumsum(n) - n).take(some), node, -side / z, vectors, states


def at_levels(tree: Tree, turned: np.ndarray, nodes: np.ndarray, h: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple:
    """Order and counts of `Tree.levels`, and of each visit: node, side, -side times the log odds, vector, state."""
    order, counts, node, side = tree.levels(ids)
    state, line = h.take(order, axis=0), group.take(order) * (TOP + 1)
    states = np.concatenate([state[:0], *[state[:c] for c in counts]])
    at = np.concatenate([line[:0], *[line[:c] for c in counts]])
    at += np.minimum(node, np.uint16(TOP))
    vectors = nodes.take(node, axis=0)
    z = (vectors * states) @ np.ones(WIDTH, vectors.dtype)
    z += turned.take(at)
    z += tree.bias.take(node)
    z *= -side
    return order, counts, node, side, z, vectors, states


def slopes(tree: Tree, turned: np.ndarray, nodes: np.ndarray, h: np.ndarray, inside: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the loss within classes by the states of the places `inside`; distinct nodes there, and the gradient by their vectors. In sums, as `at_nodes` gives them."""
    order, counts, node, side, z, vectors, states = at_levels(tree, turned, nodes, h.take(inside, axis=0), group.take(inside), ids.take(inside))
    np.negative(z, out=z)
    bounded_exp(z)
    z += 1
    slope = np.repeat(-side / z, WIDTH).reshape(-1, WIDTH)
    vectors *= slope
    states *= slope
    total, at = np.zeros((len(order), WIDTH), h.dtype), 0
    for c in counts:
        total[:c] += vectors[at : at + c]
        at += c
    dh = np.zeros_like(h)
    dh[inside.take(order)] = total
    return dh, *sums_by(node, states)


def within_class(model: Model, h: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log probability of ids within their classes, by the attention's states."""
    order, counts, _, _, z, _, _ = at_levels(model.tree, model.turned, model.nodes, h, group, ids)
    bounded_exp(z)
    z += 1
    np.log(z, out=z)
    total, at = np.zeros(len(ids)), 0
    for c in counts:
        total[:c] -= z[at : at + c]
        at += c
    out = np.empty(len(ids))
    out[order] = total
    return out


def fitted(gathered: DataFrame) -> Model:
    spark = gathered.sparkSession
    company = np.zeros((SLICES, SPAN * CELLS), np.uint32)
    for r in gathered.where("kind = 0").groupBy("slot").applyInArrow(_add(SPAN * CELLS), "slot long, body binary").toLocalIterator():
        company[r.slot] = np.frombuffer(r.body, np.uint32)
    model = Model(company.reshape(SLICES * SPAN, CELLS))
    company = None
    texts = gathered.where("kind = 2").select("slot", "body")  # all training texts, read where they were gathered
    pairs, turned = np.zeros((GROUPS + 8, CLASSES)), np.zeros((GROUPS + 8, TOP + 1), np.float32)
    counted = K.map_batches(texts, GATHERED, _count_pairs(spark.sparkContext.broadcast(model.group)))
    shared = spark.sparkContext.broadcast((model.of, model.tree))
    for r in counted.groupBy("slot").applyInArrow(_layer(shared), "slot long, pairs binary, turned binary").toLocalIterator():
        at = slice(8 * r.slot, 8 * r.slot + 8)
        pairs[at] = np.frombuffer(r.pairs, np.float64).reshape(8, CLASSES)
        turned[at, :-1] = np.frombuffer(r.turned, np.float32).reshape(8, TOP)
    pairs, model.turned = pairs[: GROUPS + 1], turned[: GROUPS + 1]
    model.tables(pairs)
    shards = max(1, int(-(-pairs.sum() // (ROUNDS * SHARD * CONTEXT))))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.weights, model.nodes, np.exp(model.after), model.of, model.group, model.tree, model.turned))
        pieces = K.map_batches(texts, PIECES, _pieces(shards, turn)).repartition("shard").sortWithinPartitions("shard", "order", "body")
        trained = K.map_batches(pieces, TRAINED, _train(shared, turn))
        # rows for each task, then for each part: what comes to the driver does not grow with the corpus
        nodes = np.array_split(model.nodes.copy(), SLICES)
        for r in trained.groupBy("part").applyInArrow(_sum_of_part, TRAINED).toLocalIterator():
            total = np.frombuffer(r.body, np.int64)
            if r.part >= 0:
                total = total.reshape(-1, WIDTH + 1)
                seen = np.flatnonzero(total[:, 0])
                nodes[r.part][seen] = total[seen, 1:] / (total[seen, :1] * UNIT)
                continue
            at, flat = 0, total / (r.n * UNIT)
            for name in sorted(model.weights):
                w = model.weights[name]
                model.weights[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
                at += w.size
        model.nodes = np.concatenate(nodes)
    return model


ENTRIES = "bucket int, keys binary, counts binary, words binary, times binary, train binary"


def _send_words(common_shared, n_buckets: int):
    """Rare words of each document to the bucket of their hash; common words' counts over the training fold, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = common_shared.value
        totals, train_texts = np.zeros(len(common), np.int64), 0
        for batch in batches:
            w = K.words_of(batch.column("text"), K.SPACED_LOWER)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            keys = batch.column("row_key").to_numpy()
            train_texts += int(train.sum())
            values, inverse = distinct(w.hash)
            is_common, at = _among(values, common)
            of_train = train[w.doc()]
            totals += np.bincount(at[inverse[of_train]][is_common[inverse[of_train]]], minlength=len(common))
            doc, word, tf = _present(w, inverse, len(values))
            rare = ~is_common[word]
            doc, word, tf = doc[rare], word[rare], tf[rare]
            if not len(doc):
                continue
            bucket = ((values >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.uint32)[word]
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = []
            for part in np.split(order, edges):
                d = doc[part]
                first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                count = np.diff(np.concatenate((first, [len(d)])))
                rows.append((int(bucket[part[0]]), keys[d[first]].tobytes(), count.astype(np.uint32).tobytes(), values[word[part]].tobytes(), np.minimum(tf[part], 1 << 31).astype(np.uint32).tobytes(), train[d[first]].astype(np.uint8).tobytes()))
            yield _entry_batch(rows)
        yield _entry_batch([(-1, b"", b"", b"", np.append(totals, train_texts).tobytes(), b"")])

    return run


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=[x.split()[0] for x in ENTRIES.split(", ")])


SUMS = "share int, n long, v long, keys binary, sums binary, known binary"


def _meet_words(n_shares: int):
    """What the words of a bucket contribute to each document; and their tokens and types in the training fold."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            total = np.sum([np.frombuffer(b, np.int64) for b in table.column("times").to_pylist()], axis=0)
            return _sums([(-1, 0, 0, b"", total.tobytes(), b"")])
        get = lambda name, t: np.frombuffer(b"".join(table.column(name).to_pylist()), t)
        keys, counts, words, tf, train = get("keys", np.int64), get("counts", np.uint32), get("words", np.uint64), get("times", np.uint32).astype(np.int64), get("train", np.uint8)
        doc = np.repeat(np.arange(len(keys)), counts)
        values, word = np.unique(words, return_inverse=True)
        c = np.bincount(word, tf * train[doc], len(values)).astype(np.int64)
        sums = np.bincount(doc, tf * np.log10(c[word] + 1), len(keys))
        known = np.bincount(doc, tf * (c[word] > 0), len(keys)).astype(np.int64)
        share = np.mod(keys, n_shares)
        order = np.argsort(share, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
            rows.append((int(share[part[0]]), 0, 0, keys[part].tobytes(), sums[part].tobytes(), known[part].tobytes()))
        rows.append((-2, int(c.sum()), int((c > 0).sum()), b"", b"", b""))
        return _sums(rows)

    return run


def _sums(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SUMS.split(", ")])


def _per_document(table: pa.Table) -> pa.Table:
    get = lambda name, t: np.frombuffer(b"".join(table.column(name).to_pylist()), t)
    keys, at = np.unique(get("keys", np.int64), return_inverse=True)
    return pa.table({"row_key": pa.array(keys), "rare_sum": pa.array(np.bincount(at, get("sums", np.float64), len(keys))), "rare_known": pa.array(np.bincount(at, get("known", np.int64), len(keys)).astype(np.int64))})


def _score(shared, path: str | None):
    """Model score, number of tokens, and what the common words add to the baseline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common, totals = shared.value
        subwords = subwords_of(path)
        logs, seen = np.log10(totals + 1.0), totals > 0
        for batch in batches:
            w = K.words_of(batch.column("text"), K.SPACED_LOWER)
            n = len(w.counts)
            found = subwords.of(w, K.SPACED_LOWER)
            values, inverse = found[0], found[1]
            is_common, at = _among(values, common)
            mine = np.flatnonzero(is_common[inverse])
            which, doc = at[inverse[mine]], w.doc()[mine]
            base = np.bincount(doc, logs[which], n) if len(mine) else np.zeros(n)
            known = np.bincount(doc, seen[which], n).astype(np.int64) if len(mine) else np.zeros(n, np.int64)
            ids, bounds = subwords.sequences(w, found)
            out = text_scores(model, ids, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), batch.column("held_out"), pa.array(w.counts + 1), pa.array(base), pa.array(known), pa.array(out * LOG10)], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


SCORED = "doc_id long, row_key long, held_out boolean, n_tokens long, common_sum double, common_known long, score double"


def id_scores(model: Model, ids: np.ndarray, bounds: np.ndarray, at_once: int = 128) -> np.ndarray:
    """Log probability of each id, from the one window that scores it: of its class and within it, both by the attention's state."""
    classes, before = model.of.take(ids), np.empty(len(ids), np.int64)
    before[1:] = model.group.take(ids[:-1])
    before[bounds[:-1]] = GROUPS
    first, score, last = windows(bounds)
    scorer = Scorer(model.weights, model.after)
    out = np.empty(len(ids))
    for skip, chosen in ((0, np.flatnonzero(score == first)), (OVERLAP, np.flatnonzero(score > first))):
        for i in range(0, len(chosen), at_once):
            w = chosen[i : i + at_once]
            place = first[w, None] + np.arange(CONTEXT)
            inside = np.flatnonzero(place[:, skip:] < last[w, None])
            np.minimum(place, len(ids) - 1, out=place)  # what lies beyond a text's end is looked at by no place before it
            lp, h = scorer.both(before.take(place), classes.take(place[:, skip:]), skip)
            at = place[:, skip:].ravel().take(inside)
            out[at] = lp.ravel().take(inside) + within_class(model, h.take(inside, axis=0), before.take(at), ids.take(at).astype(np.int64))
    return out


def text_scores(model: Model, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log probability of each text; every text has its end at least."""
    return np.add.reduceat(id_scores(model, ids, bounds), bounds[:-1]) if len(ids) else np.empty(0)


def lm_scores(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"row_key": K.row_key(), "held_out": K.is_held_out(MODULUS, HELD_OUT)}).withColumn("train", ~F.col("held_out"))
    gathered = K.checkpointed(K.map_batches(docs.select("text", "train", "row_key"), GATHERED, _gather(tokenizer)))
    model = fitted(gathered)
    size = gathered.where("kind = 3").agg(F.coalesce(F.sum("slot"), F.lit(0)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("texts")).first()
    n = max(K.partitions(spark), -(-16 * size.words // BUCKET_BYTES))
    held = gathered.where("kind = 1").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * COMMON >= size.texts)
    common = np.sort(np.array([r.slot for r in held.select("slot").collect()], np.int64).view(np.uint64))
    entries = K.map_batches(docs.select("text", "row_key", "train"), ENTRIES, _send_words(spark.sparkContext.broadcast(common), n))
    met = K.checkpointed(entries.groupBy("bucket").applyInArrow(_meet_words(n), SUMS))
    size = met.where("share = -2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    totals = [np.frombuffer(r.sums, np.int64) for r in met.where("share = -1").select("sums").collect()]
    totals = totals[0] if totals else np.zeros(len(common) + 1, np.int64)
    ends = int(totals[-1])
    tokens = size.n + int(totals.sum())
    types = size.v + int((totals > 0).sum())
    rare = met.where("share >= 0").groupBy("share").applyInArrow(_per_document, "row_key long, rare_sum double, rare_known long")
    shared = spark.sparkContext.broadcast((model, common, totals[:-1]))
    scored = K.map_batches(docs.select("doc_id", "text", "row_key", "held_out"), SCORED, _score(shared, tokenizer))
    zero = F.lit(0.0)
    return scored.join(rare, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("common_sum") + F.coalesce("rare_sum", zero) + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1.0)))).alias("base_score"), "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(K.read(spark, sf_dir, "documents"))
