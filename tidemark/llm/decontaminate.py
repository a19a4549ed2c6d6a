"""Benchmark decontamination by winnowing.

Both sides keep, of every `w` consecutive k-grams, the one with the least hash (the last of equals).
Any `w + k - 1` = 10 shared words therefore share a kept fingerprint. Kept fingerprints of a document
that also occur in the benchmark lead to candidate windows of 10 words around them; a candidate counts
when the whole window equals a window of an item. Items shorter than a window are one window each; no
fingerprint is sure to lie in them, so every run of that many words is looked up.

The benchmark is a stated query set: it goes to the tasks in blocks of at most `BLOCK_WORDS` words, one
pass over the documents per block, so what is broadcast has a bound whatever the benchmark's size.
No document is shuffled unless there are several blocks.

Nulls and texts without words: no words, no hits. An item without words is ignored. Repeated item rows
count once; a null item_id is ignored. Repeated documents give repeated rows. Empty tables give no rows,
or documents without hits. Extra columns are ignored by `contaminated_words`, kept by `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

WINDOW = 10
GRAM = 5
BLOCK_WORDS = 2_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,length:long>>"


def winnow(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Of every `width` consecutive grams (at: their places), the index of the least, each once."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    best = np.arange(len(grams) - width + 1)
    for j in range(1, width):
        other = np.arange(j, len(grams) - width + 1 + j)
        best = np.where(grams[other] <= grams[best], other, best)
    whole = at[width - 1 :] - at[: len(at) - width + 1] == width - 1  # all in one text
    return np.unique(best[whole])


class Index:
    """Windows and fingerprints of a block of items, as sorted arrays."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = K.words_of(pa.array(texts, pa.string()), K.ALNUM_LOWER)
        ids_of, doc = np.asarray(ids, dtype=np.int64), w.doc()
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in sorted({min(WINDOW, int(c)) for c in w.counts if c}):
            g, at = w.grams(m)
            keep = np.ones(len(at), bool) if m == WINDOW else w.counts[doc[at]] == m
            pairs = np.unique(np.rec.fromarrays([g[keep], ids_of[doc[at[keep]]]], names="hash,item"))
            self.by_length[m] = pairs["hash"].copy(), pairs["item"].copy()
        g, at = w.grams(GRAM)
        self.prints = np.unique(g[winnow(g, at, WINDOW - GRAM + 1)])

    def find(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
        """Starts and lengths of the windows that occur, and the items of each text."""
        starts, lengths, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)], {}
        doc = w.doc()
        for m, (hashes, owner) in self.by_length.items():
            g, at = w.grams(m)
            if m == WINDOW:
                near = self._near_prints(w)
                g, at = g[near[at]], at[near[at]]
            lo = np.searchsorted(hashes, g)
            hit = hashes[np.minimum(lo, len(hashes) - 1)] == g
            at, lo, hi = at[hit], lo[hit], np.searchsorted(hashes, g[hit], side="right")
            starts.append(at)
            lengths.append(np.full(len(at), m))
            for d, a, b in set(zip(doc[at].tolist(), lo.tolist(), hi.tolist(), strict=True)):
                items.setdefault(d, set()).update(owner[a:b].tolist())
        return np.concatenate(starts), np.concatenate(lengths), items

    def _near_prints(self, w: K.Words) -> np.ndarray:
        """True for each word that starts a window holding a kept fingerprint of the benchmark."""
        g, at = w.grams(GRAM)
        kept = winnow(g, at, WINDOW - GRAM + 1)
        if len(self.prints):
            i = np.minimum(np.searchsorted(self.prints, g[kept]), len(self.prints) - 1)
            kept = kept[self.prints[i] == g[kept]]
        else:
            kept = kept[:0]
        back = WINDOW - GRAM
        return K.cover(len(w), np.maximum(at[kept] - back, 0), np.minimum(at[kept], back) + 1)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Index]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # a word and its gap take two characters at least
    n = max(1, int(-(-words // block_words)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index([r.item_id for r in rows], [r.text for r in rows])


def contaminated_words(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: number of words, of words hit, the items found and the spans of words hit.

    documents: doc_id, text. benchmark: item_id, text.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for index in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(index)
        parts.append(K.map_batches(docs.withColumn("key", K.row_key()), f"{SCHEMA}, key long", _finder(shared)))
    if len(parts) == 1:
        return parts[0].drop("key")
    return _merge(parts)


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            w = K.words_of(batch.column("text"), K.ALNUM_LOWER)
            starts, lengths, items = index.find(w)
            marked = K.cover(len(w), starts, lengths)
            total = np.concatenate(([0], np.cumsum(marked)))
            hit = total[w.first[1:]] - total[w.first[:-1]]
            n = len(w.counts)
            spans = [[]] * n
            for d in np.flatnonzero(hit).tolist():
                a, b = K.runs(marked[w.first[d] : w.first[d + 1]])
                spans[d] = [{"start": x, "length": y - x} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.int64())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), batch.column("key")],
                names=["doc_id", "n_words", "n_hit", "items", "spans", "key"],
            )

    return run


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Unite what the blocks found; equal rows of documents are counted, merged and repeated."""
    out = parts[0].withColumn("block", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("block", F.lit(k)))
    per_block = out.groupBy("doc_id", "key", "n_words", "block").agg(F.count("*").alias("copies"), F.any_value("items").alias("items"), F.any_value("spans").alias("spans"))
    merged = per_block.groupBy("doc_id", "key", "n_words").agg(
        F.max("copies").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    joined = F.aggregate(
        "spans",
        F.slice("spans", 1, 0),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["start"] + F.element_at(done, -1)["length"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["length"], s["start"] + s["length"] - F.element_at(done, -1)["start"]).alias("length"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    merged = merged.withColumn("spans", joined).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]))
    return merged.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "n_hit", "items", "spans")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    name = "_n_hit"
    while name in documents.columns:
        name += "_"
    indexes = list(_blocks(benchmark, BLOCK_WORDS))
    out = documents
    for index in indexes:
        shared = documents.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(text):
            w = K.words_of(pa.array(text, pa.string(), from_pandas=True), K.ALNUM_LOWER)
            starts, lengths, _ = shared.value.find(w)
            total = np.concatenate(([0], np.cumsum(K.cover(len(w), starts, lengths))))
            import pandas as pd

            return pd.Series(total[w.first[1:]] == total[w.first[:-1]])

        out = out.where(clean(F.col("text").cast("string")))
    K.small_batches(documents.sparkSession)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(K.read(spark, sf_dir, "documents"), K.read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same rows from DuckDB. Windows of one item length at a time, so that each is an equal join.
OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select distinct item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as t
       from (select item_id, w, least(len(w), 10) as m from b where len(w) > 0), unnest(range(1, len(w) - m + 2)) as u(i)),
lens as (select distinct m from bw),
dw as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as t
       from d, lens, unnest(range(1, len(w) - m + 2)) as u(i)),
hits as (select dw.doc_id, dw.i, dw.m, bw.item_id from dw join bw on dw.m = bw.m and dw.t = bw.t),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from (select distinct doc_id, i, m from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(words.n_hit, 0)::bigint as n_hit, coalesce(items.n_items, 0)::bigint as n_items,
       sha256(coalesce(items.s, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
""".replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
