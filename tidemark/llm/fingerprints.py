"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph ends after a line break or a sentence's end. Its leaves are its parts: a leaf also ends where the hash of
a word says so (about every eighth word, since many paragraphs are long), so that an edit moves no boundary but its
own. Paragraphs are grouped into sections: a section ends at a blank line or at a paragraph whose hash says so (about
every eighth). A leaf's hash covers all its bytes, a paragraph's its leaves' hashes, a section's its paragraphs', the
root's its sections'. Equal roots: equal texts; sections, paragraphs and leaves that differ locate the edits.

A fingerprint is text: `root:section.paragraph~leaf,leaf/paragraph~leaf;section....`, each leaf as 10 hexadecimal
digits of hash and its length; a paragraph of one leaf is the leaf. The likeness of two fingerprints is the Dice share,
by characters, of their common leaves, taken with repeats; two empty texts are alike (1).

Null and empty texts have no leaf. Every document's next is the one with the next doc_id (ties: by a hash of
the text; null doc_ids first); the last one's is the first; a document alone is its own. Repeated rows stand next to one
another. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

LEAF_BITS = 3
SECTION_BITS = 3
#: Bytes that end a paragraph when white space follows them.
ENDS = np.zeros(256, bool)
ENDS[[0x2E, 0x21, 0x3F, 0x0A]] = True
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def leaves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End of every leaf of a batch of texts (bytes), the number of leaves of each text, and whether a paragraph ends there.

    A leaf ends with the white space before its next word.
    """
    w = K.Words(data, offsets)
    if not len(w):
        has = offsets[1:] > offsets[:-1]
        return offsets[1:][has], has.astype(np.int64), np.ones(int(has.sum()), bool)
    paragraph = ENDS[data[w.ends - 1]]
    # a line break in the white space after a word ends the paragraph too
    breaks = np.concatenate(([0], np.cumsum(data[offsets[0] : offsets[-1]] == 0x0A)))
    after = np.concatenate((w.starts[1:], [offsets[-1]]))
    paragraph |= breaks[after - offsets[0]] > breaks[w.ends - offsets[0]]
    final = w.first[1:][w.counts > 0] - 1
    paragraph[final] = True
    last = paragraph | ((w.hash >> np.uint64(64 - LEAF_BITS)) == 0)
    ends = after.copy()
    ends[final] = offsets[1:][w.counts > 0]
    doc = w.doc()
    counts = np.bincount(doc[last], minlength=len(w.counts))
    ends, paragraph = ends[last], paragraph[last]
    blank = (w.counts == 0) & (offsets[1:] > offsets[:-1])  # nothing but white space: one leaf
    if blank.any():
        counts[blank] = 1
        ends, paragraph = np.concatenate((ends, offsets[1:][blank])), np.concatenate((paragraph, np.ones(int(blank.sum()), bool)))
        order = np.argsort(ends, kind="stable")
        ends, paragraph = ends[order], paragraph[order]
    return ends, counts, paragraph


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return K.mix(K.Words._hash(RAW[data[base : int(ends[-1])]] if len(ends) else np.empty(0, np.uint8), starts - base, ends - base) + np.uint64(1))


RAW = np.arange(256, dtype=np.uint8)


class Tree:
    """Fingerprints of a batch of texts."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        ends, counts, self.paragraph = leaves(self.data, self.offsets)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.hash = hash_spans(self.data, starts, ends, 0) if len(ends) else np.empty(0, np.uint64)
        self.length = ends - starts
        blank = np.zeros(len(ends), bool)
        if len(ends):
            blank = (self.data[ends - 1] == 0x0A) & (self.data[np.maximum(ends - 2, 0)] == 0x0A) & (self.length > 1)
        self.closes = self.paragraph & (blank | ((self.hash & np.uint64((1 << SECTION_BITS) - 1)) == 0))

    def __len__(self) -> int:
        return len(self.first) - 1

    def leaf_hashes(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[i], self.first[i + 1]
        return self.hash[a:b] >> np.uint64(24), self.length[a:b]

    def fingerprint(self, i: int) -> str:
        a, b = int(self.first[i]), int(self.first[i + 1])
        h = (self.hash[a:b] >> np.uint64(24)).tolist()
        names = ["%010x%x" % x for x in zip(h, self.length[a:b].tolist(), strict=True)]
        wide = self.hash[a:b].tobytes()
        sections, digests = [], []
        paragraphs, inner, start = [], [], 0
        for e in (np.flatnonzero(self.paragraph[a:b]) + 1).tolist():
            digest = hashlib.blake2b(wide[8 * start : 8 * e], digest_size=16).digest()
            inner.append(digest)
            paragraphs.append(names[start] if e == start + 1 else digest[:4].hex() + "~" + ",".join(names[start:e]))
            start = e
            if self.closes[a + e - 1] or e == b - a:
                digest = hashlib.blake2b(b"".join(inner), digest_size=16).digest()
                digests.append(digest)
                sections.append(digest[:5].hex() + "." + "/".join(paragraphs))
                paragraphs, inner = [], []
        root = hashlib.blake2b(b"".join(digests), digest_size=16).hexdigest()
        return root + ":" + ";".join(sections)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Dice share of common leaves by length. a, b: hashes and lengths of the leaves."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    h = np.concatenate((a[0], b[0]))
    values, at = np.unique(h, return_inverse=True)
    n = len(a[0])
    ca, cb = np.bincount(at[:n], minlength=len(values)), np.bincount(at[n:], minlength=len(values))
    size = np.zeros(len(values), np.int64)
    size[at] = np.concatenate((a[1], b[1]))
    return float(2 * (np.minimum(ca, cb) * size).sum() / total)


def branches(fingerprint: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """Sections of a fingerprint: name, paragraphs: name, leaves."""
    out = []
    for section in fingerprint.split(":", 1)[1].split(";"):
        if section:
            name, rest = section.split(".", 1)
            parts = [p.split("~", 1) if "~" in p else (p, p) for p in rest.split("/")]
            out.append((name, [(head, leaves.split(",")) for head, leaves in parts]))
    return out


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of a fingerprint: hashes and lengths."""
    parts = [leaf for _, paragraphs in branches(fingerprint) for _, found in paragraphs for leaf in found]
    return np.array([int(p[:10], 16) for p in parts], np.uint64), np.array([int(p[10:], 16) for p in parts], np.int64)


def edits(before: str, after: str) -> list[tuple[int, int]]:
    """Spans (start, end) of the later text, in bytes, that differ: sections are compared first, then the paragraphs of
    those that differ, then their leaves. Something that is only gone leaves an empty span where it stood; something that
    has moved shows where it is now and where it was. No span: equal texts."""
    if before.split(":", 1)[0] == after.split(":", 1)[0]:
        return []
    size = lambda leaf: int(leaf[10:], 16)
    width = lambda paragraphs: sum(size(leaf) for _, found in paragraphs for leaf in found)
    out: list[tuple[int, int]] = []

    def compare(old: list, new: list, at: int, level: int) -> None:
        names = (lambda xs: xs) if level == 2 else (lambda xs: [x[0] for x in xs])
        measure = (width, None, None)[level] if level == 0 else (lambda found: sum(map(size, found))) if level == 1 else None
        length = size if level == 2 else lambda x: measure(x[1])
        starts = [at]
        for x in new:
            starts.append(starts[-1] + length(x))
        for kind, a, b, c, d in SequenceMatcher(None, names(old), names(new), autojunk=False).get_opcodes():
            if kind == "equal":
                continue
            if kind != "replace" or level == 2:
                out.append((starts[c], starts[d]))
            else:
                compare([y for x in old[a:b] for y in x[1]], [y for x in new[c:d] for y in x[1]], starts[c], level + 1)

    compare(branches(before), branches(after), 0, 0)
    return sorted(set(out))


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def _print_batch(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """rows: doc_id, text, the next document's text."""
    edited = [_edited(t, nxt) for _, t, nxt in rows]
    raw = [e.encode() for e in edited]
    own, other = Tree([t.encode() for _, t, _ in rows]), Tree(raw)
    # the next document is the next row but for the last one of the batch
    following = Tree([rows[-1][2].encode()])
    near_edited, near_next = [], []
    for i in range(len(rows)):
        mine = own.leaf_hashes(i)
        near_edited.append(likeness(mine, other.leaf_hashes(i)))
        near_next.append(likeness(mine, own.leaf_hashes(i + 1) if i + 1 < len(rows) else following.leaf_hashes(0)))
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in raw]),
        pa.array([own.fingerprint(i) for i in range(len(rows))]), pa.array([other.fingerprint(i) for i in range(len(rows))]), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


#: Rows and characters worked on at a time.
ROWS, CHARS = 500, 1 << 20


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket, doc_id, text; the last row of a bucket is only the next of the one before."""
    waiting: list[tuple[int | None, str, str]] = []
    before: tuple[int, int | None, str] | None = None
    size = 0
    for batch in batches:
        for bucket, i, text in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if before is not None and before[0] == bucket:
                waiting.append((before[1], before[2], text))
                size += len(before[2])
            else:
                if waiting:
                    yield _print_batch(waiting)
                    waiting, size = [], 0
            if len(waiting) >= ROWS or size >= CHARS:
                yield _print_batch(waiting)
                waiting, size = [], 0
            before = (bucket, i, text)
    if waiting:
        yield _print_batch(waiting)


def merkle_fingerprints(documents: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and the likeness to that and to the next document.

    One shuffle by ranges of doc_id; the first document of a range also goes to the end of the range before.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = -(1 << 63)
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(low)))
    n = K.partitions(spark)
    bounds = sorted({int(b) for b in docs.stat.approxQuantile("place", [k / n for k in range(1, n)], 0.25 / n)}) if n > 1 else []
    cut = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    docs = docs.withColumn("bucket", F.size(F.filter(cut, lambda b: b <= F.col("place"))))
    # first row of each bucket: as many numbers as there are buckets
    firsts = docs.groupBy("bucket").agg(F.min(F.struct("place", F.xxhash64("text").alias("h"))).alias("f")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    copied = [(r.f.place, r.f.h, firsts[k - 1].bucket) for k, r in enumerate(firsts)]
    copied_df = F.broadcast(spark.createDataFrame(copied, "place long, h long, to int"))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    ends = keyed.join(copied_df, ["place", "h"]).groupBy("to").agg(F.first(F.struct("doc_id", "place", "h", "text")).alias("r")).select(F.col("to").alias("bucket"), "r.*", F.lit(1).alias("end"))
    rows = keyed.select("bucket", "doc_id", "place", "h", "text", F.lit(0).alias("end")).unionByName(ends)
    dealt = rows.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "end", "place", "h")
    return K.map_batches(dealt.select("bucket", "doc_id", "text"), SCHEMA, _walk)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fingerprints(K.read(spark, sf_dir, "documents"))
