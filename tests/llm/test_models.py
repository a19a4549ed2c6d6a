"""Classifiers, near-duplicates, language model and pipeline: held-out accuracy and brute force."""

import collections
import copy
import math
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import lm, near, quality, toxicity
from tidemark.llm import textkit as K

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
AWKWARD = [(1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "é " * 30_000), (None, None)]


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("run, column, least", [(quality.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.75)])
def test_held_out(spark, run, column, least):
    big = SF.replace("sf0.001", "sf0.01")
    docs, labels = K.read(spark, big, "documents"), K.read(spark, big, "labels")
    rows = run(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.score for r in rows], [r[column] for r in rows]) >= least
    assert np.mean([r.predicted == r[column] for r in rows]) >= max(np.mean([r[column] for r in rows]), 1 - np.mean([r[column] for r in rows]))


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_awkward(spark, run):
    docs = spark.createDataFrame([(*r, "clash") for r in AWKWARD], DOCS + ", score string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1), (2, 7, 7)], LABELS)
    rows = run(docs, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    none = spark.createDataFrame([], LABELS)
    assert run(docs, none).count() == len(AWKWARD)
    assert run(spark.createDataFrame([], DOCS), none).count() == 0


def test_labelled_sample_has_one_row_for_each_document(spark):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, None), (2, None), (3, "c")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], LABELS)
    got = K.labelled_sample(docs, labels, "quality", 1, 1, 3).collect()
    assert sorted(r.label for r in got) == [0, 1, 1]
    assert {r.text for r in got} in ({"a", None, "c"}, {"b", None, "c"})


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = K.read(spark, SF, "documents"), K.read(spark, SF, "labels")
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, turned).collect()}


def test_quality_is_a_vote_of_the_nearest(spark):
    docs, labels = K.read(spark, SF, "documents").select("doc_id", "text"), K.read(spark, SF, "labels")
    model = quality.fit(docs, labels, 60)
    rows = docs.orderBy("doc_id").limit(40).collect()
    fitted = quality.fit
    quality.fit = lambda d, x: model
    try:
        got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    finally:
        quality.fit = fitted
    for r in rows:
        v = model.vectors_of(quality.features(pa.array([r.text])))[0]
        cosines = [(float(sum(a * b for a, b in zip(v.tolist(), u.tolist(), strict=True))), y) for u, y in zip(model.vectors, model.labels, strict=True)]
        nearest = sorted(cosines, reverse=True)[: quality.NEIGHBOURS]
        weights = [math.exp(8 * (c - 1)) for c, _ in nearest]
        assert abs(got[r.doc_id] - sum(w * y for w, (_, y) in zip(weights, nearest, strict=True)) / sum(weights)) < 1e-3


def test_toxicity_is_linear_in_the_voters_that_speak(spark):
    docs, labels = K.read(spark, SF, "documents").select("doc_id", "text"), K.read(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["you IDIOT, pure trash", "", None]
    got = model.scores(pa.array(texts, pa.string()))
    known = {int(h): w for h, w in zip(model.voters, model.weights[:-1], strict=True)}
    name = lambda word, stem=0: int(K.words_of(pa.array([word]), K.ALNUM_LOWER).hash[0]) if not stem else int(toxicity.tokens(pa.array([word]))[1][1 + toxicity.STEMS.index(stem)])
    for text, score in zip(texts, got, strict=True):
        words = {bytes(x) for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))}
        found = {name(x.decode()) for x in words if name(x.decode()) in known} if all(_utf8(x) for x in words) else None
        if found is None:
            continue
        for x in words:
            for stem in toxicity.STEMS:
                if len(x) > stem and x.isascii() and name(x.decode(), stem) in known:
                    found.add(name(x.decode(), stem))
        if any(not x.isascii() for x in words):
            continue  # stems of other letters are cut by bytes
        z = model.bias + sum(known[h] for h in found) + (model.weights[-1] if found else 0)
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9


def _utf8(x):
    try:
        return bool(x.decode())
    except UnicodeDecodeError:
        return False


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    rates = [(0.6, 0.02), (0.5, 0.05), (0.3, 0.3), (0.4, 0.01)]
    votes = np.stack([rng.random(4000) < np.where(truth, a, b) for a, b in rates], 1).astype(float)
    votes = np.column_stack((votes, votes[:, 0]))  # a copy of a voter is no further voice
    noisy = np.where(rng.random(4000) < 0.1, ~truth, truth).astype(int)
    post, accuracy, correlation = toxicity.label_model(votes, noisy)
    assert ((post > 0.5) == truth).mean() >= (noisy == truth).mean() - 0.02
    assert accuracy[0] > accuracy[2] + 0.3 and correlation[0, 4] > 0.95 and abs(correlation[0, 1]) < 0.2


def similarity_classes(rows, idf):
    texts = [t or "" for _, t in rows]
    w = K.words_of(pa.array(texts), K.SPACED_LOWER)
    doc, h, tf = near.shingles(w, len(texts))
    bags = [{} for _ in texts]
    for d, x, n in zip(doc.tolist(), h.tolist(), tf.tolist(), strict=True):
        bags[d][x] = n * float(idf[x & (near.CELLS - 1)])
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            keys = bags[i].keys() | bags[j].keys()
            total = sum(max(bags[i].get(k, 0), bags[j].get(k, 0)) for k in keys)
            low = sum(min(bags[i].get(k, 0), bags[j].get(k, 0)) for k in keys)
            if texts[i] == texts[j] or (total and low / total >= near.SIMILAR):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_copies_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    rows = [(None if i is None else i + 1000, t) for i, t in AWKWARD if i != 5]
    for g in range(12):
        base = list(rng.choice(words, 150))
        for c in range(int(rng.integers(1, 12))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 9))):
                copy[int(rng.integers(0, 150))] = str(rng.choice(words))
            rows.append((g * 100 + c, " ".join(copy)))
    docs = spark.createDataFrame(rows, DOCS)
    idf = near.idf_table(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    want = similarity_classes(rows, idf)
    got = collections.defaultdict(list)
    for r in near.near_classes(docs).collect():
        got[r.doc_id].append(r.class_id)
    by_class = collections.defaultdict(set)
    for (i, _), c in zip(rows, want, strict=True):
        by_class[c].add(i)
    for members in by_class.values():
        ids = [i for i in members if i is not None]
        for i in ids:
            assert set(got[i]) == {min(ids)}
    kept = near.keep_one(docs).collect()
    assert len(kept) == len(by_class)


def drifting_family(rng, pairs):
    """150 texts close to a base; pairs of texts that are too far from all texts but each other."""
    base = [f"b{i}" for i in range(300)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(int(rng.integers(1, 3))):
            text[int(rng.integers(0, 300))] = f"u{k}x{int(rng.integers(0, 1000))}"
        rows.append((k, " ".join(text)))
    for _ in range(pairs):
        at = rng.permutation(60)
        for chosen in (at[:8], at[:13]):
            text = list(base)
            for p in chosen:
                text[5 * p + 2] = f"alt{p}"
            rows.append((len(rows), " ".join(text)))
    return rows


def linked_classes(rows, idf):
    w = K.words_of(pa.array([t for _, t in rows]), K.SPACED_LOWER)
    doc, h, tf = near.shingles(w, len(rows))
    runs, at = np.unique(h, return_inverse=True)
    bag = np.zeros((len(rows), len(runs)))
    bag[doc, at] = tf * idf[near._cell(h)]
    low = np.array([np.minimum(bag, b).sum(1) for b in bag])
    linked = low >= near.SIMILAR * (bag.sum(1)[:, None] + bag.sum(1) - low)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[x].min() for x in linked])
        if (new == label).all():
            return dict(enumerate(label.tolist()))
        label = new


@pytest.mark.parametrize("group", [256, 16])
def test_drifting_family_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(near, "GROUP", group)
    docs = spark.createDataFrame(drifting_family(np.random.default_rng(1), 300), DOCS)
    got = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    assert got == linked_classes([tuple(r) for r in docs.collect()], near.idf_table(docs))


def test_large_drifting_family_brute_force(spark):
    """2100 texts at all distances from one base: buckets of hundreds that hold many components."""
    rng = np.random.default_rng(4)
    base, rows = [f"b{i}" for i in range(120)], []
    for k in range(2100):
        text = list(base)
        for p in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            text[p] = f"v{int(rng.integers(0, 6))}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    want = linked_classes(rows, near.idf_table(docs))
    assert len(set(want.values())) > 20
    missed = sum(got[k] != want[k] for k in want)
    print("texts in another class than by brute force:", missed, "of", len(want))
    assert missed <= 0.01 * len(want)


@pytest.mark.parametrize("labels", [1, 3, 1000])
def test_every_pair_across_components_meets(spark, monkeypatch, labels):
    monkeypatch.setattr(near, "GROUP", 8)
    rng = np.random.default_rng(2)
    rows = [(s, 100 * s + i, int(i % labels if i > 9 else 2000 + i), 10) for s in (0, 1) for i in range(90)]
    cells = collections.defaultdict(set)
    for r in near._blocks(spark.createDataFrame(rows, "set long, node long, label long, bytes long")).collect():
        cells[r.group].add(r.node)
    met = {frozenset((a, b)) for c in cells.values() for a in c for b in c if a != b}
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        assert all(frozenset((a[1], b[1])) in met for a in own for b in own if a[1] < b[1] and a[2] != b[2])
    assert all(len({n // 100 for n in c}) == 1 for c in cells.values())
    assert max(map(len, cells.values())) <= 64 and rng is not None


def test_similarities_and_forest():
    texts = ["a b c d e f g", "a b c d e f g a b c d e f g", "a b c d e f h", "", "x"]
    idf = np.linspace(1, 1.25, near.CELLS).astype(np.float32)
    doc, h, tf = near.shingles(K.words_of(pa.array(texts), K.SPACED_LOWER), len(texts))
    bags = [{x: n * float(idf[near._cell(np.array([x], np.uint64))[0]]) for d, x, n in zip(doc.tolist(), h.tolist(), tf.tolist(), strict=True) if d == i} for i in range(len(texts))]
    got = near.similarities(doc, h, tf, idf, len(texts))
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            high = sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
            assert i == j or abs(got[i, j] - (sum(min(a.get(k, 0), b.get(k, 0)) for k in a.keys() & b.keys()) / high if high else 0)) < 1e-6
    links = np.zeros((6, 6), bool)
    for i, j in ((5, 2), (2, 4), (1, 3)):
        links[i, j] = links[j, i] = True
    assert near.forest(links).tolist() == [0, 1, 2, 1, 2, 2]


def test_components(spark):
    rng = np.random.default_rng(8)
    chain, order = [(i, i + 1) for i in range(60)], rng.permutation(60) + 1000
    edges = [*chain, *[(int(x), int(y)) for x, y in zip(order[:-1], order[1:], strict=True)], (500, 500), (70, 69), (69, 70), *[(2000, 2001 + i) for i in range(9)], *[(int(x), int(y)) for x, y in rng.integers(3000, 3100, (60, 2))]]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_near_edges(spark):
    assert near.near_classes(spark.createDataFrame([], DOCS)).count() == 0
    extra = spark.createDataFrame([(2, "same text here", 1), (1, "same text here", 2), (3, "other", 3)], DOCS + ", label long")
    assert sorted(tuple(r) for r in near.keep_one(extra).collect()) == [(1, "same text here", 2), (3, "other", 3)]


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 1 << 40, 600, dtype=np.uint64))
    wa, wb = np.ones(600), np.ones(600)
    wa[:120], wb[300:420] = 3.0, 2.0
    a, b = h[:500], h[100:]
    s = near.Sampler(2000)
    sa, sb = s.sign(np.array([0]), a, wa[:500]), s.sign(np.array([0]), b, wb[100:])
    full_a, full_b = np.concatenate((wa[:500], np.zeros(100))), np.concatenate((np.zeros(100), wb[100:]))
    exact = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    assert abs((sa == sb).mean() - exact) < 0.05


def tokens(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", raw), b"\n"]


def test_baseline_and_model(spark):
    rows = [(r.doc_id, r.text) for r in K.read(spark, SF, "documents").collect()] + AWKWARD
    got = lm.lm_scores(spark.createDataFrame(rows, DOCS)).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not fold(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), fold(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows)
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.lm_scores(spark.createDataFrame([], DOCS)).count() == 0


def test_all_training_texts_are_trained_on(spark, monkeypatch):
    docs, texts, ids, fitted = K.read(spark, SF, "documents"), [], [], lm.fitted

    def spy(gathered):
        texts.append(gathered.where("kind = 2").count())
        model = fitted(gathered)
        ids.append(float(np.exp(model.after.astype(np.float64)).sum()))
        return model

    monkeypatch.setattr(lm, "fitted", spy)
    got = lm.lm_scores(docs).collect()
    assert texts == [sum(not r.held_out for r in got)]
    assert abs(ids[0] - lm.GROUPS - 1) < 1e-3


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    m = lm.Model(rng.integers(0, 50, (lm.VOCABULARY, lm.CELLS)) * rng.integers(0, 2, (lm.VOCABULARY, 1)))
    m.tables(rng.integers(0, 9, (lm.GROUPS + 1, lm.CLASSES)).astype(float))
    m.within = np.tile(lm.coded(m.weight / m.mass[m.of]), (lm.GROUPS + 1, 1))
    m.weights = {k: (v + 0.05 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in m.weights.items()}
    return m


def test_probabilities_sum_to_one_and_gradients_hold(model):
    there = np.unique(model.of)
    assert np.allclose(np.bincount(model.of, np.exp(model.within[0] / -lm.SCALE), lm.CLASSES)[there], 1, atol=2e-3)
    assert np.allclose(np.exp(model.after.astype(np.float64)).sum(1), 1, atol=1e-4)
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in model.weights.items()}
    before, target = rng.integers(0, lm.GROUPS + 1, (3, lm.CONTEXT)), rng.integers(0, lm.CLASSES, (3, lm.CONTEXT))
    after = model.after.astype(np.float64)
    scorer, t = lm.Scorer({k: v.astype(np.float32) for k, v in p.items()}, after.astype(np.float32)), target.reshape(3, -1)
    exact = lm.log_softmax_at(lm.forward(p, before, after)[-1], target.ravel()).reshape(3, -1)
    for skip in (0, 5):
        assert np.allclose(scorer(before, t[:, skip:], skip), exact[:, skip:], atol=1e-4)
    loss = lambda: -lm.log_softmax_at(lm.forward(p, before, after)[-1], target.ravel())[kept].mean()
    target.ravel()[5:9] = -1
    kept = target.ravel() >= 0
    g = lm.gradient(p, before, target, np.exp(after))
    for name in p:
        at = (int(before[0, 0]), 0) if name == "embed" else tuple(int(rng.integers(0, n)) for n in p[name].shape)
        was, e = p[name][at], 1e-4
        p[name][at] = was + e
        up = loss()
        p[name][at] = was - e
        down = loss()
        p[name][at] = was
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-4


def naive_score(m, ids):
    """One id after the other, attention by hand over the ids of the one window that scores it."""
    p, stride, total = {k: v.astype(np.float64) for k, v in m.weights.items()}, lm.CONTEXT - lm.OVERLAP, 0.0
    for i in range(len(ids)):
        k = 0 if i < lm.CONTEXT else (i - lm.OVERLAP) // stride
        inside = [lm.GROUPS if j == 0 else int(m.group[ids[j - 1]]) for j in range(k * stride, i + 1)]
        x = [p["embed"][g] + p["place"][j] for j, g in enumerate(inside)]
        q, keys, values = x[-1] @ p["q"], [v @ p["k"] for v in x], [v @ p["v"] for v in x]
        a = np.exp([q @ key / math.sqrt(lm.WIDTH) for key in keys])
        h = x[-1] + sum(w * v for w, v in zip(a / a.sum(), values, strict=True)) @ p["o"]
        logits = h @ p["out"] + m.after[inside[-1]]
        total += logits[m.of[ids[i]]] - np.log(np.exp(logits).sum()) - m.within[inside[-1], ids[i]] / lm.SCALE
    return total


def test_scores_equal_a_loop_over_windows_and_ids(model):
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, lm.VOCABULARY, n) for n in (1, 2, lm.CONTEXT - 1, lm.CONTEXT, lm.CONTEXT + 1, 44, 45, 131)]
    got = lm.text_scores(model, np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got, [naive_score(model, t) for t in texts], rtol=1e-4)


def test_ids_within_classes_are_scored_by_the_attention_state(model):
    """By hand over windows, ids and nodes, with vectors and odds of groups at the nodes; probabilities of all ids sum to those of their classes."""
    rng = np.random.default_rng(8)
    m = copy.copy(model)
    m.nodes = (0.5 * rng.standard_normal(model.nodes.shape)).astype(np.float32)
    m.turned = (0.3 * rng.standard_normal(model.turned.shape)).astype(np.float32)
    m.turned[:, -1] = 0
    p = {k: v.astype(np.float64) for k, v in m.weights.items()}

    def state_and_classes(inside):
        x = [p["embed"][g] + p["place"][j] for j, g in enumerate(inside)]
        q = x[-1] @ p["q"]
        a = np.exp([q @ (v @ p["k"]) / math.sqrt(lm.WIDTH) for v in x])
        h = x[-1] + sum(w * (v @ p["v"]) for w, v in zip(a / a.sum(), x, strict=True)) @ p["o"]
        logits = h @ p["out"] + m.after[inside[-1]]
        return h, logits - np.log(np.exp(logits).sum())

    def by_hand(h, group, i):
        total = 0.0
        for at in range(m.tree.first[i], m.tree.first[i + 1]):
            node = int(m.tree.nodes[at])
            total -= np.log1p(np.exp(-m.tree.side[at] * (m.tree.bias[node] + (m.turned[group, node] if node < lm.TOP else 0) + m.nodes[node] @ h)))
        return total

    texts = [rng.integers(0, lm.VOCABULARY, n) for n in (1, lm.CONTEXT + 1, 45)]
    want = []
    for ids in texts:
        total = 0.0
        for i in range(len(ids)):
            k = 0 if i < lm.CONTEXT else (i - lm.OVERLAP) // (lm.CONTEXT - lm.OVERLAP)
            inside = [lm.GROUPS if j == 0 else int(m.group[ids[j - 1]]) for j in range(k * (lm.CONTEXT - lm.OVERLAP), i + 1)]
            h, classes = state_and_classes(inside)
            total += classes[m.of[ids[i]]] + by_hand(h, inside[-1], int(ids[i]))
        want.append(total)
    bounds = np.cumsum([0, *map(len, texts)])
    assert np.allclose(lm.text_scores(m, np.concatenate(texts), bounds), want, rtol=1e-4)
    everything, (h, classes) = np.arange(lm.VOCABULARY), state_and_classes([lm.GROUPS, 3, 5])
    within = lm.within_class(m, np.tile(h.astype(np.float32), (lm.VOCABULARY, 1)), np.full(lm.VOCABULARY, 5), everything)
    assert abs(np.exp(classes[m.of] + within).sum() - np.exp(classes[np.unique(m.of)]).sum()) < 1e-3  # some classes of this model are empty
    still = lm.text_scores(model, np.concatenate(texts), bounds)
    assert not np.allclose(lm.text_scores(m, np.concatenate(texts), bounds), still, rtol=1e-2)


def test_gradient_of_the_state_within_classes(model):
    rng = np.random.default_rng(9)
    nodes = (0.5 * rng.standard_normal(model.nodes.shape)).astype(np.float32)
    turned = (0.3 * rng.standard_normal(model.turned.shape)).astype(np.float32)
    turned[:, -1] = 0
    ids, group, h = rng.integers(0, lm.VOCABULARY, 6), rng.integers(0, lm.GROUPS, 6), rng.standard_normal((6, lm.WIDTH)).astype(np.float32)
    m = copy.copy(model)
    m.nodes, m.turned = nodes, turned
    places, first, node, slope, vectors, states = lm.at_nodes(model.tree, turned, nodes, h, np.arange(6), group, ids)
    got = np.zeros_like(h)
    got[places] = np.add.reduceat(vectors * slope[:, None], first, axis=0)
    for i, d in ((0, 0), (2, 3), (5, 7)):
        up, down = h.copy(), h.copy()
        up[i, d], down[i, d] = h[i, d] + 0.01, h[i, d] - 0.01
        slopes = (lm.within_class(m, down, group, ids) - lm.within_class(m, up, group, ids)).sum() / 0.02
        assert abs(slopes - got[i, d]) < 2e-2
    row, sums = lm.sums_by(node, states * slope[:, None])
    for j in np.argsort(-np.abs(sums).max(1))[:3]:
        d = int(np.abs(sums[j]).argmax())
        loss = []
        for e in (0.01, -0.01):
            m.nodes = nodes.copy()
            m.nodes[row[j], d] += np.float32(e)
            loss.append(-lm.within_class(m, h, group, ids).sum())
        assert abs((loss[0] - loss[1]) / 0.02 - sums[j, d]) < 2e-2


def test_node_vectors_are_learned_and_lift_held_out_texts(spark, monkeypatch):
    docs = K.read(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    total, fitted = lambda: lm.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first(), lm.fitted
    whole = total()

    def without_nodes(gathered):
        model = fitted(gathered)
        ids = np.unique(np.concatenate([np.frombuffer(r.body, np.uint16) for r in gathered.where("kind = 2").select("body").collect()]))
        assert np.flatnonzero(np.abs(model.nodes).max(1)).tolist() == np.unique(model.tree.visits(ids.astype(np.int64))[1]).tolist()
        model.nodes = np.zeros_like(model.nodes)
        return model

    monkeypatch.setattr(lm, "fitted", without_nodes)
    counts = total()
    print("log10 a token on held-out texts: model", whole[0] / whole[1], "without the state within classes", counts[0] / counts[1])
    assert whole[0] > counts[0]


def test_ids_of_words_met_before_are_those_of_a_fresh_encoder(monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 5)
    sub = lm.Subwords(None)
    for texts in (["one two three", "two"], ["three four one", None, ""], ["five six seven eight", "one nine ten"], ["two two"]):
        w = K.words_of(pa.array(texts, pa.string()), K.SPACED_LOWER)
        ids, bounds = sub.sequences(w, sub.of(w, K.SPACED_LOWER))
        for i, t in enumerate(texts):
            want = [x for word in (t or "").split() for x in sub.enc.encode_ordinary(" " + word)]
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*want, lm.END]


def test_held_out_texts_score_above_the_word_baseline(spark, monkeypatch):
    docs = K.read(spark, SF.replace("sf0.001", "sf0.1"), "documents")
    sums = lambda: lm.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    got, fitted = sums(), lm.fitted

    def without_attention(gathered):
        model = fitted(gathered)
        model.weights["out"][:] = 0
        return model

    monkeypatch.setattr(lm, "fitted", without_attention)
    counts_alone = sums()
    print("log10 a token on held-out texts: model", got[0] / got[2], "without attention", counts_alone[0] / got[2], "baseline", got[1] / got[2])
    assert got[0] > got[1]
    assert got[0] / got[2] > counts_alone[0] / got[2] + 0.2


def test_scores_do_not_depend_on_partitions_or_other_columns(spark):
    docs = K.read(spark, SF, "documents").select("doc_id", "text")
    one = {r.doc_id: r.score for r in lm.lm_scores(docs.coalesce(1)).collect()}
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        clash = docs.repartition(5).withColumns({"score": F.lit("x"), "train": F.lit(1), "row_key": F.lit("k")})
        other = {r.doc_id: r.score for r in lm.lm_scores(clash).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) <= 1e-3 * abs(one[k]) for k in one)


def test_subwords_of_words_joined_by_other_white_space():
    texts = ["one\u2003two three", "a\u00a0b", "plain words", "\u3000 x"]
    sub = lm.Subwords(None)
    w = K.words_of(pa.array(texts), K.SPACED_LOWER)
    ids, bounds = sub.sequences(w, sub.of(w, K.SPACED_LOWER))
    for i, t in enumerate(texts):
        want = [x for word in re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for x in sub.enc.encode_ordinary(" " + word.decode())]
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*want, lm.END]


def test_each_id_is_scored_once():
    bounds = np.cumsum([0, 1, lm.CONTEXT, lm.CONTEXT + 1, 5 * lm.CONTEXT + 3])
    _, score, last = lm.windows(bounds)
    assert np.concatenate([np.arange(a, b) for a, b in zip(score, last, strict=True)]).tolist() == list(range(bounds[-1]))


def test_each_id_is_trained_on_once_after_the_id_before_it():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, lm.VOCABULARY, n).astype(np.uint16) for n in (1, 23, 24, 25, 24 * lm.PIECE, 24 * lm.PIECE + 1, 5000, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], names=["slot", "body"])
    same, seen = np.arange(lm.VOCABULARY, dtype=np.int64), collections.Counter()
    group, of = same % lm.GROUPS, same % lm.CLASSES
    for turn in range(lm.ROUNDS):
        for part in lm._pieces(3, turn)(iter([batch])):
            if part.num_rows:
                before, target = lm.laid_out(of, group, [np.frombuffer(b, np.uint16) for b in part.column("body").to_pylist()], part.column("starts").to_pylist())
                seen.update((int(b), int(t)) for b, t in zip(before.ravel(), target.ravel(), strict=True) if t >= 0)
    want = collections.Counter()
    for t in texts:
        ids = t.astype(int)
        want.update(zip([lm.GROUPS, *(ids[:-1] % lm.GROUPS).tolist()], (ids % lm.CLASSES).tolist(), strict=True))
    assert seen == want


def test_visits_by_depth_give_the_same_gradient(model):
    rng = np.random.default_rng(4)
    nodes = (0.5 * rng.standard_normal(model.nodes.shape)).astype(np.float32)
    for inside in (np.array([0, 2, 3, 7, 8, 9]), np.empty(0, np.int64)):
        ids, group, h = rng.integers(0, lm.VOCABULARY, 10), rng.integers(0, lm.GROUPS, 10), rng.standard_normal((10, lm.WIDTH)).astype(np.float32)
        dh, row, sums = lm.slopes(model.tree, model.turned, nodes, h, inside, group, ids)
        where, first, node, slope, vectors, states = lm.at_nodes(model.tree, model.turned, nodes, h, inside, group, ids)
        want = np.zeros_like(h)
        if len(where):
            want[where] = np.add.reduceat(vectors * slope[:, None], first, axis=0)
        want_row, want_sums = lm.sums_by(node, states * slope[:, None])
        assert np.allclose(dh, want, atol=1e-5) and row.tolist() == want_row.tolist() and np.allclose(sums, want_sums, atol=1e-5)


def test_shards_are_trained_one_after_another_whatever_the_batches(model):
    """One call holds one shard at a time; its sums are those of calls for each shard."""
    rng = np.random.default_rng(5)
    names = [x.split()[0] for x in lm.PIECES.split(", ")]
    rows = [(0, shard, k, k % 2 == 0, rng.integers(0, 500, 40).astype(np.uint16).tobytes()) for shard, n in ((3, 5), (4, 1), (9, 4)) for k in range(n)]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    held = types.SimpleNamespace(value=(model.weights, model.nodes, np.exp(model.after), model.of, model.group, model.tree, model.turned))

    def sums(*batches):
        return {r["part"]: (r["n"], np.frombuffer(r["body"], np.int64)) for b in lm._train(held, 0)(iter(batches)) for r in b.to_pylist()}

    whole, parts = sums(batch.slice(0, 2), batch.slice(2, 5), batch.slice(7)), [sums(batch.slice(a, n)) for a, n in ((0, 5), (5, 1), (6, 4))]
    assert len(whole) == lm.SLICES + 1 and sums(batch.slice(0, 0)) == {}
    for part, (n, body) in whole.items():
        assert n == sum(p[part][0] for p in parts) and np.array_equal(body, sum(p[part][1] for p in parts))
    assert [len(b) for b, _ in lm._shards(iter([batch.slice(0, 3), batch.slice(3)]))] == [5, 1, 4]


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = K.read(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in C.STAGES:
        out = K.stored(stage(spark, docs, SF))
        if name != C.STAGES[-1][0]:
            assert out.columns == columns
            sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert docs.count() >= sizes[-1]
