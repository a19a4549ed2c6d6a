"""Removal of word sequences that an earlier document already has, by fixed-block anchors.

A window is 13 consecutive words. Of any 13 words, 7 are a block of the reference text that starts at a
multiple of 7. So: index the non-overlapping blocks of 7 words, probe them with every rolling run of 7
words, and extend the hits to whole windows; neighbouring windows make up the maximal repeats.

1. Anchors. Each batch of documents sends each distinct run of 7 words once, as 31 bits, to the bucket of
   its hash; runs that two documents of the batch share are hits at once. A bucket marks the runs of two
   or more documents of which one is an indexed block. A hot passage thus costs a bucket one entry for
   each batch, not for each copy.
2. Windows. Windows that hold a hit are compared by 128 bits of hash, again one entry for each batch: a
   batch knows its own later copies, a bucket the least doc_id of all.
3. The words under such windows go.

Defined results: a null or empty text has no words; a null doc_id ranks after all others; rows that share
a doc_id do not repeat one another, rows with equal doc_id and text get equal results; texts of fewer
than 13 words stay. Empty tables give empty results. Extra columns pass through `dedup_substrings`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as K

WINDOW = 13
BLOCK = 7
PACKED = "bucket int, kind int, ids binary, keys binary, counts binary, a binary, b binary, c binary"
#: Places in the documents of a share: runs of (start, length), or remainders of hashes with the bucket they came from.
MARKS = "share int, bucket int, keys binary, counts binary, places binary"
#: Bytes of text of a share, which one worker holds at a time.
SHARE_BYTES = 128 << 20
RUNS = -1
LAST = (1 << 63) - 1
#: Entries gathered before they are compared within the task, and documents worked on at a time.
GATHER = 1_500_000
ROWS = 1000


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    types = [{"int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    yield from _table(rows, schema).to_batches()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.concatenate((first, [n])))


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each destination with the indexes of its entries, which keep their order."""
    order = np.argsort(to, kind="stable")
    for part in np.split(order, _changes(to[order])[1:]):
        if len(part):
            yield int(to[part[0]]), part


def _entry_rows(buckets: np.ndarray, doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """A row for each bucket. doc, in order: the entries' documents, as indexes of ids and keys."""
    rows = []
    for bucket, part in _dealt(buckets):
        first = _changes(doc[part])
        at = doc[part[first]]
        blobs = [c[part].tobytes() for c in columns]
        rows.append((bucket, 0, ids[at].tobytes(), keys[at].tobytes(), _lengths(first, len(part)).astype(np.uint32).tobytes(), *blobs, *[b""] * (3 - len(blobs))))
    return rows


def _run_marks(doc: np.ndarray, pos: np.ndarray, keys: np.ndarray, shares: int) -> list[tuple]:
    """Marks of places, as runs; doc: indexes of keys."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    first = _changes(doc, pos - np.arange(len(pos)))
    d, runs = doc[first], np.stack((pos[first], _lengths(first, len(pos))), 1).astype(np.uint32)
    out = []
    for share, part in _dealt(np.mod(keys[d], shares)):
        at = _changes(d[part])
        out.append((share, RUNS, keys[d[part[at]]].tobytes(), _lengths(at, len(part)).astype(np.uint32).tobytes(), runs[part].tobytes()))
    return out


def _sure(marks: list[tuple]) -> list[tuple]:
    """Marks that need no bucket, in the form of entries so that they travel along."""
    return [(share, 1, b"", keys, counts, places, b"", b"") for share, _, keys, counts, places in marks]


def _passed(table: pa.Table) -> list[tuple]:
    return [(r["bucket"], RUNS, r["keys"], r["counts"], r["a"]) for r in table.filter(pc.equal(table.column("kind"), 1)).select(["bucket", "keys", "counts", "a"]).to_pylist()]


class _Entries:
    """Entries of all rows of a bucket, one after another; doc: index into ids and keys."""

    def __init__(self, table: pa.Table):
        self.table = table.filter(pc.equal(table.column("kind"), 0))
        self.ids, self.keys = self.column("ids", np.int64), self.column("keys", np.int64)
        self.doc = np.repeat(np.arange(len(self.keys)), self.column("counts", np.uint32))

    def column(self, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(self.table.column(name).to_pylist()), kind)


def _split(g: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and remainder (31 bits) of a hash."""
    return (g >> np.uint64(32)) % np.uint64(n_buckets), g & np.uint64(0x7FFFFFFF)


def _send_anchors(n_buckets: int, window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("_td_id").to_numpy(), batch.column("_td_key").to_numpy()
            w = K.words_of(batch.column("text"))
            g, at = w.grams(block)
            doc, pos = w.doc()[at], w.position()[at]
            keep = w.counts[doc] >= window
            g, doc, pos = g[keep], doc[keep], pos[keep]
            if not len(g):
                continue
            order = np.argsort(g, kind="stable")
            first = _changes(g[order])
            counts = _lengths(first, len(g))
            group = np.empty(len(g), np.int64)
            group[order] = np.repeat(np.arange(len(first)), counts)
            least, most = doc[order[first]], doc[order[first + counts - 1]]
            shared = (least != most)[group]
            indexed = np.bitwise_or.reduceat((pos % block == 0)[order], first)[group]
            sent = doc == least[group]
            bucket, rest = _split(g[sent], n_buckets)
            rest = rest.astype(np.uint32) | (indexed[sent].astype(np.uint32) << np.uint32(31))
            rows = _entry_rows(bucket.astype(np.uint32), doc[sent], ids, keys, [rest])
            if shared.any():
                rows += _sure(_run_marks(doc[shared], pos[shared], keys, n_buckets))
            yield from _batches(rows, PACKED)

    return run


def _meet_anchors(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        marks = _passed(table)
        e = _Entries(table)
        rest = e.column("a", np.uint32)
        if len(rest):
            value = rest & np.uint32(0x7FFFFFFF)
            order = np.argsort(value, kind="stable")
            first = _changes(value[order])
            counts = _lengths(first, len(value))
            many = e.doc[order[first]] != e.doc[order[first + counts - 1]]
            many &= np.bitwise_or.reduceat(rest[order] >> np.uint32(31), first) > 0
            hit = np.sort(order[np.repeat(many, counts)])
            key, value = e.keys[e.doc[hit]], value[hit]
            bucket = table.column("bucket")[0].as_py()
            for share, part in _dealt(np.mod(key, n_buckets)):
                at = _changes(key[part])
                marks.append((share, bucket, key[part[at]].tobytes(), _lengths(at, len(part)).astype(np.uint32).tobytes(), value[part].tobytes()))
        return _table(marks, MARKS)

    return run


class _Marks:
    """All marks of a share of the documents."""

    def __init__(self, table: pa.Table):
        run_keys, runs, self.hashed = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)], [np.empty(0, np.uint64)]
        for r in table.to_pylist():
            keys = np.repeat(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.uint32))
            if r["bucket"] == RUNS:
                run_keys.append(keys)
                runs.append(np.frombuffer(r["places"], np.uint32).reshape(-1, 2).astype(np.int64))
            else:
                rest = np.frombuffer(r["places"], np.uint32).astype(np.uint64)
                self.hashed.append(self.name(np.uint64(r["bucket"]), rest, keys))
        keys, runs = np.concatenate(run_keys), np.concatenate(runs)
        order = np.argsort(keys, kind="stable")
        self.run_keys, self.runs = keys[order], runs[order]
        self.hashed = np.unique(np.concatenate(self.hashed))

    @staticmethod
    def name(bucket: np.ndarray, rest: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return K.mix((bucket << np.uint64(31) | rest) ^ K.mix(keys.view(np.uint64).copy()))

    def places(self, w: K.Words, keys: np.ndarray) -> np.ndarray:
        """Index among the batch's words of each place marked by a run."""
        lo, hi = np.searchsorted(self.run_keys, keys, "left"), np.searchsorted(self.run_keys, keys, "right")
        starts, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in np.flatnonzero(hi > lo).tolist():
            runs = self.runs[lo[d] : hi[d]]
            starts.append(runs[:, 0] + w.first[d])
            lengths.append(runs[:, 1])
        starts, lengths = np.concatenate(starts), np.concatenate(lengths)
        ends = np.cumsum(lengths)
        return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))

    def anchors(self, w: K.Words, keys: np.ndarray, block: int, n_buckets: int) -> np.ndarray:
        """The same for runs of words marked by their hash."""
        g, at = w.grams(block)
        if not len(self.hashed):
            return at[:0]
        bucket, rest = _split(g, n_buckets)
        own = self.name(bucket, rest, keys[w.doc()[at]])
        i = np.minimum(np.searchsorted(self.hashed, own), len(self.hashed) - 1)
        return at[self.hashed[i] == own]


def _slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches(max_chunksize=ROWS):
        yield batch


def _compared(parts: list[tuple], n_buckets: int) -> list[tuple]:
    """Rows for the windows gathered so far: (g, g2, id, key, pos) arrays."""
    g, g2, ids, keys, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((keys, ids, g2, g))
    g, g2, ids, keys, pos = g[order], g2[order], ids[order], keys[order], pos[order]
    first = _changes(g, g2)
    least = np.repeat(ids[first], _lengths(first, len(g)))
    later = ids > least
    # entries in order of document
    sent = np.flatnonzero(~later)
    sent = sent[np.lexsort((pos[sent], keys[sent], ids[sent]))]
    one = _changes(ids[sent], keys[sent])
    doc = np.repeat(np.arange(len(one)), _lengths(one, len(sent)))
    bucket = (g[sent] >> np.uint64(32)) % np.uint64(n_buckets)
    rows = _entry_rows(bucket.astype(np.uint32), doc, ids[sent[one]], keys[sent[one]], [g[sent], g2[sent], pos[sent].astype(np.uint32)])
    if later.any():
        known, doc = np.unique(keys[later], return_inverse=True)
        rows += _sure(_run_marks(doc, pos[later], known, n_buckets))
    return rows


def _send_windows(n_buckets: int, window: int, block: int):
    def run(docs: pa.Table, marked: pa.Table) -> pa.Table:
        marks, rows, parts, size = _Marks(marked), [], [], 0
        for batch in _slices(docs) if marked.num_rows else ():
            ids, keys = batch.column("_td_id").to_numpy(), batch.column("_td_key").to_numpy()
            w = K.words_of(batch.column("text"))
            hits = np.concatenate((marks.places(w, keys), marks.anchors(w, keys, block, n_buckets)))
            back = np.minimum(window - block, w.position()[hits])
            near = K.cover(len(w), hits - back, back + 1)
            g, at = w.grams(window)
            g2, _ = w.grams(window, seed=1)
            keep = near[at]
            at = at[keep]
            doc = w.doc()[at]
            parts.append((g[keep], (g2[keep] >> np.uint64(32)).astype(np.uint32), ids[doc], keys[doc], w.position()[at]))
            size += len(at)
            if size >= GATHER:
                rows += _compared(parts, n_buckets)
                parts, size = [], 0
        if size:
            rows += _compared(parts, n_buckets)
        return _table(rows, PACKED)

    return run


def _meet_windows(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        marks = _passed(table)
        e = _Entries(table)
        g, g2, pos = e.column("a", np.uint64), e.column("b", np.uint32), e.column("c", np.uint32).astype(np.int64)
        if len(g):
            owner = e.ids[e.doc]
            order = np.lexsort((owner, g2, g))
            first = _changes(g[order], g2[order])
            least = np.repeat(owner[order[first]], _lengths(first, len(g)))
            hit = order[owner[order] > least]
            marks += _run_marks(e.doc[hit], pos[hit], e.keys, n_buckets)
        return _table(marks, MARKS)

    return run


def _cut(columns: list[str], window: int, schema: T.StructType):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(docs: pa.Table, marked: pa.Table) -> pa.Table:
        marks, out = _Marks(marked), []
        for batch in _slices(docs):
            w = K.words_of(batch.column("text"), hashes=False)
            gone = K.cover(len(w), marks.places(w, batch.column("_td_key").to_numpy()), window)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[w.first[1:]] - total[w.first[:-1]]
            kept, spans = [], []
            for d, text in enumerate(w.texts()):
                parts, found = text.split(), []
                if removed[d]:
                    a, b = K.runs(gone[w.first[d] : w.first[d + 1]])
                    edges = np.concatenate(([0], np.stack((a, b), 1).ravel(), [len(parts)])).tolist()
                    parts = [x for s, e in zip(edges[::2], edges[1::2], strict=True) for x in parts[s:e]]
                    found = [{"start": x, "length": y - x} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                kept.append(b" ".join(parts))
                spans.append(found)
            new = [pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, spans_type)]
            out.append(pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], names=[*columns, "_td_words", "_td_removed", "_td_kept", "_td_spans"]))
        return pa.Table.from_batches(out)

    return run


def repeated_words(documents: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All columns of documents, and `_td_words`, `_td_removed` (counts), `_td_kept` (text), `_td_spans` (word spans removed)."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts: window >= 2 * block - 1")
    n = K.shares(documents, SHARE_BYTES)
    columns = documents.columns
    schema = T.StructType([*documents.schema.fields, *T.StructType.fromDDL("_td_words long, _td_removed long, _td_kept string, _td_spans array<struct<start:long,length:long>>").fields])
    keyed = documents.withColumns({"_td_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_td_key": K.row_key()})
    # documents are dealt into shares once; both steps that need their texts again read the same shuffle
    shares = keyed.withColumn("_td_share", F.pmod("_td_key", F.lit(n)).cast("int"))

    anchors = K.map_batches(keyed.select("_td_id", "_td_key", "text"), PACKED, _send_anchors(n, window, block))
    marks = anchors.groupBy("bucket").applyInArrow(_meet_anchors(n), MARKS)
    windows = shares.groupBy("_td_share").cogroup(marks.groupBy("share")).applyInArrow(_send_windows(n, window, block), PACKED)
    found = windows.groupBy("bucket").applyInArrow(_meet_windows(n), MARKS)
    return shares.groupBy("_td_share").cogroup(found.groupBy("share")).applyInArrow(_cut(columns, window, schema), schema)


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """The documents, each text with its repeated words cut out; untouched texts and documents stay as they are."""
    found = repeated_words(documents)
    text = F.when(F.col("_td_removed") > 0, F.col("_td_kept")).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.when(F.col("_td_removed") > 0, F.length("_td_kept").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in documents.columns]
    return found.select(*columns)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_words(K.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_td_words").alias("n_words"), F.col("_td_removed").alias("n_removed"), F.sha2("_td_kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select rid, doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) as h, hash('a' || array_to_string(w[i:i + 12], ' ')) as h2 from d, unnest(range(1, len(w) - 11)) as u(i)),
least_doc as (select h, h2, min(coalesce(doc_id, 9223372036854775807)) as least from win group by h, h2),
gone as (select distinct rid, unnest(range(i, i + 13)) as p from win join least_doc using (h, h2) where coalesce(doc_id, 9223372036854775807) > least),
words as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select rid, string_agg(word, ' ' order by p) as s, count(*) as n from words anti join gone using (rid, p) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (rid)
"""
