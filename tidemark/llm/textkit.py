"""Words, hashes and Arrow plumbing shared by the text operators.

Everything here works on the UTF-8 bytes of a whole Arrow batch at once. A word's hash is a
polynomial over its bytes modulo 2**64, read off one running sum, then mixed; hashes of word
sequences are polynomials over the word hashes. Nulls count as empty texts.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time; bounds the memory of a task whatever the length of a text.
BLOCK = 1 << 20
MULT = 0x9E3779B97F4A7C15 | 1
GRAM = np.uint64(0xD6E8FEB86659FD93)


def _space_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[0] = 255  # a NUL byte belongs to a word; 255 never occurs in UTF-8
    return table


def _alnum_table(lower: bool = True) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B) if lower else np.arange(0x41, 0x5B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def _lower_space_table() -> np.ndarray:
    table = _space_table()
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


#: Byte -> folded byte, 0 for a byte that separates words.
SPACED = _space_table()
SPACED_LOWER = _lower_space_table()
ALNUM_LOWER = _alnum_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK)
        for name, base in (("up", MULT), ("down", pow(MULT, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
    return _powers["up"], _powers["down"]


class Words:
    """The words of a batch of texts: byte spans, hashes, and first[i]:first[i + 1] for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, hashes: bool = True):
        self.data, self.offsets = data, offsets
        lo, hi = int(offsets[0]), int(offsets[-1])
        folded = table[data[lo:hi]]
        inside = folded != 0
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][full] - lo, offsets[1:][full] - 1 - lo
        starts[first], ends[last] = inside[first], inside[last]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        del inside, starts, ends
        self.first = np.searchsorted(s, offsets - lo)
        self.counts = np.diff(self.first)
        self.starts, self.ends = s + lo, e + lo
        self.hash = self._hash(folded, s, e) if hashes else None

    @staticmethod
    def _hash(folded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty(len(s), dtype=np.uint64)
        i = 0
        while i < len(s):
            at = int(s[i])
            j = max(i + 1, int(np.searchsorted(e, at + BLOCK, side="right")))
            n = int(e[j - 1]) - at
            up, down = _power(n + 1)
            run = np.empty(n + 1, dtype=np.uint64)
            run[0] = 0
            part = _values[folded[at : at + n]]
            part *= up[:n]
            np.cumsum(part, out=run[1:])
            a, b = s[i:j] - at, e[i:j] - at
            h = run[b] - run[a]
            h *= down[a]
            out[i:j] = mix(h ^ (b - a).astype(np.uint64))
            i = j
        return out

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """Of each word, the index of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def position(self) -> np.ndarray:
        """Of each word, its place within its text."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def prefix(self, length: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first `length` bytes of all longer words, and the words' indexes."""
        at = np.flatnonzero(self.ends - self.starts > length)
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        s = self.starts[at] - lo
        return self._hash(table[self.data[lo:hi]], s, s + length), at

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the index of the first word of each."""
        n = len(self) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        base = self.hash if not seed else mix(self.hash + np.uint64(seed))
        out = base[:n].copy()
        for j in range(1, k):
            out *= GRAM
            out += base[j : j + n]
        valid = np.ones(n, dtype=bool)
        ends = self.first[1:-1]
        for j in range(1, k):  # a run that starts fewer than k words before a text's end would cross it
            at = ends - j
            valid[at[(at >= 0) & (at < n)]] = False
        at = np.flatnonzero(valid)
        return mix(out[at]), at

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if offsets is None or n == 0:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), off


def words_of(column: pa.Array, table: np.ndarray = SPACED, hashes: bool = True) -> Words:
    return Words(*buffers(column), table, hashes)


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """True for each of n places that lies in [start, start + length) for some start."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def ship(spark: SparkSession) -> None:
    """Give the tasks this package, once a session: the workers of a cluster may not have it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-py-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._tidemark_shipped = True


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 4) -> None:
    """Bound what a Python worker gets at a time, in rows and in bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def map_batches(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shares(documents: DataFrame, size: int) -> int:
    """Into how many parts to deal the texts: one for each `size` bytes of them, and one for each shuffle partition at least."""
    total = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions(documents.sparkSession), -(-int(total) // size))


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine only where Spark runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-ckpt-")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def row_key() -> Column:
    """A row's own identity; rows that agree in doc_id and text have equal results."""
    return F.xxhash64("doc_id", "text")


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """At most `bound` labelled documents (text, label) outside the held-out fold, checkpointed.

    The rows with the least hash of doc_id are taken, so the sample is the same at every run; only their
    ids are broadcast. A document that has several rows gives one text. Labels other than 0 and 1 and rows without doc_id are left out; of several labels
    of a document the largest holds.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != held_out))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("one"))
    return checkpointed(one.select("one.text", "label"))


def is_held_out(modulus: int, remainder: int) -> Column:
    """A null doc_id has the fold of an empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet under the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
