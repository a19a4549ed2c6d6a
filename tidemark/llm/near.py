"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the weighted set of its runs of five words (lower-cased A-Z, split at ASCII space; a text of
one to four words is one run). A run weighs tf * idf, idf = 1 + IDF_SHARE * ln(N / df) / ln(N): damped, so
that copies are not judged less alike for being many. Document frequencies come from all documents, in a
table of fixed size indexed by hash, less the mean load of a cell; its error relative to N does not depend
on N. Two texts are linked if their weighted Jaccard similarity is at least 0.8.

1. Exact copies fall together first (128 bits of hash); one row of each text goes on, carrying its signature only.
2. Signatures: improved consistent weighted samples (r, c ~ Gamma(2, 1), beta uniform; the sample of a run
   is its quantised level), with the random numbers drawn from one table by hash of run and sample number.
   BANDS bands of ROWS samples.
3. In each bucket of a band the texts meet one leader, in groups of about GROUP texts: all pairs of a group are
   compared, in one task. The links make components.
4. Where a bucket still holds several components, all its pairs across components are compared, whatever its
   size, so no link between different texts is lost to the choice of leader. Buckets that share texts are taken
   together where that takes fewer comparisons than one by one. Their texts are dealt into blocks of about GROUP,
   a component of many texts into blocks of its own; every two blocks meet in one task, but for two blocks of one
   component. So a text is sent once for each block it has to meet, not once for each pair.
5. Similarities are computed exactly from the texts themselves, and a task gives back a spanning forest of its
   links only. Components by folding nodes into their least neighbours, checkpointed every round.

Defined results: null and empty texts have no runs and are alike only as exact copies of one another (null
counts as empty); a class takes its least doc_id, null if it has none; equal rows repeat. Empty tables
give no rows. Extra columns are ignored by `near_classes` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

SHINGLE = 5
SIMILAR = 0.8
BANDS = 40
ROWS = 8
IDF_SHARE = 0.25
CELLS = 1 << 18
SLICES = 64
#: Texts of a group, and bytes: what a task compares at a time, or half of it.
GROUP = 256
GROUP_BYTES = 4 << 20
#: Relative step of the weights that signatures tell apart.
STEP = 0.05
DRAWS = 1 << 16


def shingles(w: K.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text: text index, 40-bit hash, number of times; in order of text and hash."""
    g, at = w.grams(SHINGLE)
    doc = w.doc()
    parts = [(doc[at].astype(np.uint64) << np.uint64(40)) | (g >> np.uint64(24))]
    for m in range(1, SHINGLE):
        short = np.flatnonzero(w.counts == m)
        if len(short):
            gm, am = w.grams(m)
            own = w.counts[doc[am]] == m
            parts.append((doc[am[own]].astype(np.uint64) << np.uint64(40)) | (gm[own] >> np.uint64(24)))
    both = np.sort(np.concatenate(parts))
    new = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.empty(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.concatenate((at, [len(both)])))
    return (both[at] >> np.uint64(40)).astype(np.int64), both[at] & np.uint64((1 << 40) - 1), tf


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, n = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        w = K.words_of(batch.column("text"), K.SPACED_LOWER)
        _, h, _ = shingles(w, len(w.counts))
        table += np.bincount(_cell(h), minlength=CELLS)
        n += batch.num_rows
    if n:
        parts = np.split(table, SLICES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([n if k == 0 else 0 for k in range(SLICES)], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "n", "counts"]
        )


def _add(table: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()), np.zeros(CELLS // SLICES, np.int64))
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def idf_table(docs: DataFrame) -> np.ndarray:
    """idf by cell, from all documents; CELLS numbers whatever the corpus."""
    counted = K.map_batches(docs.select("text"), "slice int, n long, counts binary", _count)
    rows = counted.groupBy("slice").applyInArrow(_add, "slice int, n long, counts binary").collect()
    table = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in rows:
        table[r.slice] = np.frombuffer(r.counts, np.int64)
    n, df = max(2, sum(r.n for r in rows)), table.ravel()
    df = np.maximum(1.0, df - df.mean())
    return (1 + IDF_SHARE * np.maximum(0, np.log(n / df)) / np.log(n)).astype(np.float32)


class Sampler:
    """Consistent weighted samples by table."""

    def __init__(self, samples: int):
        rng = np.random.default_rng(20240601)
        self.r = rng.gamma(2, 1, DRAWS)
        self.log_c = np.log(rng.gamma(2, 1, DRAWS))
        self.beta = rng.random(DRAWS)
        self.multipliers = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.rows: dict[int, int] = {}
        self.table = np.empty((0, DRAWS), np.uint64)

    def _row(self, level: int) -> np.ndarray:
        t = np.floor(level * STEP / self.r + self.beta)
        log_a = (self.log_c - self.r * (t - self.beta) - self.r).astype(np.float32)
        bits = log_a.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # in the order of the numbers
        return (bits.astype(np.uint64) << np.uint64(32)) | (K.mix(t.astype(np.int64).astype(np.uint64)) >> np.uint64(32))

    def sign(self, first: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Samples of each text (texts x samples), as 32 bits naming run and level. first: where each text's runs start."""
        levels, at = np.unique(np.rint(np.log(weight) / STEP).astype(np.int64), return_inverse=True)
        for q in levels.tolist():
            if q not in self.rows:
                self.rows[q] = len(self.rows)
                self.table = np.concatenate((self.table, self._row(q)[None]))
        base = np.array([self.rows[q] for q in levels.tolist()], np.uint64)[at] * np.uint64(DRAWS)
        table, spread = self.table.ravel(), K.mix(h.copy())
        low = spread & np.uint64(0xFFFFFFFF)
        out = np.empty((len(first), len(self.multipliers)), np.uint64)
        for a, b in chunks(first, len(h)):  # of a size that stays in the cache
            lo, hi = first[a], first[b] if b < len(first) else len(h)
            part, own, near, places = spread[lo:hi], base[lo:hi], low[lo:hi], first[a:b] - lo
            draw, value = np.empty(hi - lo, np.uint64), np.empty(hi - lo, np.uint64)
            for k, m in enumerate(self.multipliers):
                np.multiply(part, m, out=draw)
                draw >>= np.uint64(48)
                draw += own
                np.take(table, draw.view(np.int64), out=value, mode="clip")
                value ^= near
                np.minimum.reduceat(value, places, out=out[a:b, k])
        return out & np.uint64(0xFFFFFFFF)


CHUNK = 1 << 14


def chunks(first: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about CHUNK of the n runs, one text at least."""
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + CHUNK, side="right")) - 1) if n - first[a] > CHUNK else len(first)
        yield a, b
        a = b


def _signatures(shared, keep: list[str], n_bands: int, n_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = shared.value, Sampler(n_bands * n_rows)
        for batch in batches:
            w = K.words_of(batch.column("text"), K.SPACED_LOWER)
            n = len(w.counts)
            doc, h, tf = shingles(w, n)
            bands = [None] * n
            if len(doc):
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                signed = sampler.sign(first, h, np.maximum(1.0, tf * idf[_cell(h)])).reshape(len(first), n_bands, n_rows)
                mixed = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), signed.shape[:2]).copy()
                for r in range(n_rows):
                    mixed = K.mix(mixed * K.GRAM + signed[:, :, r])
                for d, row in zip(doc[first].tolist(), mixed.view(np.int64).tolist(), strict=True):
                    bands[d] = row
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(bands, pa.list_(pa.int64()))], names=[*keep, "bands"])

    return run


def similarities(doc: np.ndarray, h: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of every two of n texts, from their runs; 0 where either has no words.

    A run that a text has tf times counts as tf runs, (run, 1) to (run, tf), each weighing idf; so what two texts
    share is the weight of their common runs, a product of matrices over the runs that two or more texts have.
    """
    weight = idf[_cell(h)].astype(np.float64)
    total = np.bincount(doc, tf * weight, n)
    times = np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf)
    if (tf > 1).any():
        doc, h, weight = np.repeat(doc, tf), K.mix(np.repeat(h, tf) + (times.astype(np.uint64) << np.uint64(40))), np.repeat(weight, tf)
    _, at, run, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    kept = np.flatnonzero(place[run] >= 0)
    column, doc = place[run[kept]], doc[kept]
    root, low = np.sqrt(weight[at[shared]]), np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    for c in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(column, (c, c + 4096))
        m = np.zeros((n, min(4096, len(shared) - c)))
        m[doc[lo:hi], column[lo:hi] - c] = root[column[lo:hi]]
        low += m @ m.T
    high = total[:, None] + total - low
    return np.divide(low, high, out=np.zeros((n, n)), where=low > 0)


def forest(linked: np.ndarray) -> np.ndarray:
    """Of each node of a symmetric matrix of links, the least node of its component."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label, len(label)).min(1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare(shared):
    """Links of groups: rows (group, node, text), in order of group. Gives a spanning forest of each group's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            group = table.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = table.slice(cut)
            if cut:
                yield _links(table.slice(0, cut), shared.value)
        if held is not None and len(held):
            yield _links(held, shared.value)

    return run


def _links(table: pa.Table, idf: np.ndarray) -> pa.RecordBatch:
    node = table.column("node").to_numpy()
    group = table.column("group").to_numpy()
    w = K.words_of(table.column("text"), K.SPACED_LOWER)
    doc, h, tf = shingles(w, len(w.counts))
    edge = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
    runs = np.searchsorted(doc, edge)
    a, b = [], []
    for k in range(len(edge) - 1):
        lo, hi = edge[k], edge[k + 1]
        if hi - lo < 2:
            continue
        x, y = runs[k], runs[k + 1]
        label = forest(similarities(doc[x:y] - lo, h[x:y], tf[x:y], idf, hi - lo) >= SIMILAR)
        other = np.flatnonzero(label != np.arange(hi - lo))
        a.append(node[lo + label[other]])
        b.append(node[lo + other])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component of the graph with edges (a, b). Nodes without an edge to another are left out.

    Each round folds every node into the first of its neighbours and itself, in an order by hash, and that into the
    first of its own; edges within a folded node go. Nodes and edges shrink by a factor from round to round, also in
    long chains, so all rounds together cost a few times the first.
    """
    ends = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    order = lambda x: F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("x"))
    edges, folds = K.checkpointed(ends(edges)), []
    while not folds or not edges.isEmpty():
        near = edges.select("a", "b").union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("first"))
        near = K.checkpointed(near.select("node", F.least("first", order("node"))["x"].alias("to")))
        fold = K.checkpointed(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        folds.append(fold)
        of = lambda side: fold.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}"))
        edges = K.checkpointed(ends(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))))
    root = folds[0].withColumnRenamed("to", "root")
    for fold in folds[1:]:
        root = root.join(fold.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    root = K.checkpointed(root)
    return K.checkpointed(root.join(root.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label"))


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels once the edges, between labelled nodes, are drawn too."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b")
    found = components(between.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    return K.checkpointed(labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label")))


def _linked(grouped: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """Spanning links (a, b) of each group. grouped: group (64 bits of hash: two groups in one cost time, no result), node."""
    with_text = grouped.join(texts, "node").repartition("group").sortWithinPartitions("group", "node")
    return K.checkpointed(K.map_batches(with_text, "a long, b long", _compare(shared)).distinct())


def near_classes(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_id (least doc_id with this very text), class_id (least doc_id of its near-duplicates)."""
    return _classes(documents).select("doc_id", "text_id", "class_id")


def _classes(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"doc_key": F.coalesce(F.col("doc_id"), F.lit(-1)), "text_hash": F.unhex(F.md5("text"))})
    shared = spark.sparkContext.broadcast(idf_table(docs))
    signed = K.checkpointed(K.map_batches(docs, "doc_id long, text_hash binary, bands array<long>", _signatures(shared, ["doc_id", "text_hash"], BANDS, ROWS)))
    texts = signed.groupBy("text_hash").agg(F.min("doc_id").alias("text_id"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_key"), F.any_value("bands").alias("bands"))
    texts = K.checkpointed(texts.withColumn("node", F.monotonically_increasing_id()))
    members = texts.select("node", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    wanted = K.checkpointed(members.join(leaders, "bucket"))  # members of buckets of two or more
    nodes = wanted.select("node").distinct()
    needed = texts.join(nodes, "node", "left_semi").select("text_hash", "doc_key", "node")
    source = docs.select("text_hash", "doc_key", "text").join(needed, ["text_hash", "doc_key"]).groupBy("text_hash", "doc_key", "node").agg(F.any_value("text").alias("text"))
    source = K.stored(source.select("node", "text"))
    met = wanted.where("a < node").groupBy("a", "node").agg(F.max(F.ceil(F.col("n") / GROUP)).alias("parts"))
    met = K.checkpointed(met.withColumn("group", F.xxhash64("a", "parts", F.pmod(F.xxhash64("node"), "parts"))))
    first = _linked(met.select("group", "node").union(met.select("group", F.col("a").alias("node")).distinct()), source, shared)
    labels = K.checkpointed(nodes.join(components(first), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    # texts that a leader left apart
    labelled = wanted.select("node", "bucket").join(labels, "node")
    spread = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("first"), F.count("*").alias("n")).where("lo < hi")
    open_ = K.checkpointed(labelled.join(spread.select("bucket", "first", "n"), "bucket"))
    if not open_.isEmpty():
        sizes = source.select("node", F.octet_length("text").cast("long").alias("bytes"))
        rest = _linked(_blocks(_gathered(open_).join(sizes, "node")), source, shared)
        labels = _joined(labels, rest)
    grouped = texts.join(labels, "node", "left").select("text_hash", "text_id", F.coalesce("label", "node").alias("label"))
    classes = grouped.groupBy("label").agg(F.min("text_id").alias("class_id"))
    return signed.select("doc_id", "text_hash").join(grouped.join(classes, "label"), "text_hash")


def _gathered(members: DataFrame) -> DataFrame:
    """set, node, label: the sets within which all pairs have to be compared. members: bucket, node, label, first, n (of the bucket).

    Buckets that are connected by common texts make one set if that takes fewer comparisons than bucket by bucket.
    """
    family = components(members.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()).withColumnRenamed("label", "family")
    within = members.join(family, "node")
    whole = family.groupBy("family").agg(F.count("*").alias("texts"))
    square = lambda c: F.col(c).cast("double") * F.col(c)
    apart = within.groupBy("family").agg(F.sum(F.col("n").cast("double")).alias("comparisons"))  # each text of a bucket with n texts
    together = whole.join(apart, "family").select("family", (square("texts") <= F.col("comparisons")).alias("together"))
    key = F.when(F.col("together"), F.xxhash64("family", F.lit(0))).otherwise(F.xxhash64("bucket", F.lit(1)))
    return K.checkpointed(members.join(family.join(together, "family"), "node").select(key.alias("set"), "node", "label").distinct())


def _blocks(members: DataFrame) -> DataFrame:
    """group, node: every two blocks of a set, but for two of one component. members: set, node, label, bytes."""
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / GROUP), F.ceil(F.col(size) / GROUP_BYTES), F.lit(1))
    of = members.groupBy("set", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).withColumn("own_parts", F.when(F.col("n") >= GROUP, parts("n", "size")).otherwise(0))
    small = F.col("own_parts") == 0
    total = of.groupBy("set").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("n_pool"), F.sum(F.when(small, F.col("size")).otherwise(0)).alias("size_pool"), F.sum("own_parts").alias("big"))
    total = total.select("set", F.when(F.col("n_pool") > 0, parts("n_pool", "size_pool")).otherwise(0).alias("pool"), "big")
    # a component of many texts has blocks of its own, after those of the pool; there is at most one for each GROUP texts
    before = Window.partitionBy("set").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    bases = of.where("own_parts > 0").withColumn("base", F.coalesce(F.sum("own_parts").over(before), F.lit(0)))
    plan = of.join(bases.select("set", "label", "base"), ["set", "label"], "left").join(total, "set")
    dealt = members.join(plan, ["set", "label"]).withColumn("all", F.col("pool") + F.col("big"))
    first = F.col("pool") + F.coalesce("base", F.lit(0))
    after = F.when(first + F.col("own_parts") < F.col("all"), F.sequence(first + F.col("own_parts"), F.col("all") - 1)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("long")
    others = F.when(small, F.sequence(zero, F.col("all") - 1)).otherwise(F.concat(F.when(first > 0, F.sequence(zero, first - 1)).otherwise(F.array().cast("array<bigint>")), after))
    own = F.when(small, F.pmod(F.xxhash64("label"), "pool")).otherwise(first + F.pmod(F.xxhash64("node"), "own_parts"))
    cells = dealt.select("set", "node", own.alias("own"), F.explode(others).alias("other"))
    return cells.select(F.xxhash64("set", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node").distinct()


def keep_one(documents: DataFrame) -> DataFrame:
    """Documents without near-duplicates, with all their columns: of each class one row with its least doc_id, or,
    in a class without any doc_id, one of its rows."""
    found = _classes(documents)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    kept = found.groupBy("label").agg(F.min(order).alias("kept")).select(F.coalesce("kept.doc_id", F.lit(-1)).alias("_td_id"), F.col("kept.null").alias("_td_null"), F.col("kept.text_hash").alias("_td_hash"))
    keyed = documents.withColumns({
        "_td_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_td_null": F.col("doc_id").cast("long").isNull(), "_td_hash": F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))),
    })
    return keyed.join(kept, ["_td_id", "_td_null", "_td_hash"], "left_semi").dropDuplicates(["_td_id", "_td_null", "_td_hash"]).select(*documents.columns)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(K.read(spark, sf_dir, "documents"))
