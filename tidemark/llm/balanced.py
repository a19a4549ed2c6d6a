"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

1. Tasks tokenise whole texts. A document gives as many full windows as it holds; the rest is cut into equal pieces of at
   most LONGEST tokens, so that no piece is a large part of a window.
2. The pieces are dealt by hash into groups of about WINDOWS windows of tokens. A group is bounded however the documents
   are distributed, so no key is hot and no step sees more than one group.
3. Each group starts with a partial partition for each piece: the piece in one window, nothing in the others. The two
   partial partitions of the largest imbalance (fullest minus emptiest window) merge with opposing imbalances, the fullest
   windows of one with the emptiest of the other, until one partition is left. Its windows are near-equal.
4. When a window exceeds the capacity, the number of windows rises and the group is partitioned anew.

Pieces under SHORT tokens (less in small windows) are bundled up to twice that many first, so that a group of very many short texts costs no more
merges than one of ordinary texts.

Padding is what near-equal windows leave: on average under one per cent of a group of many windows, and less than a window
where a group has few. A null text is an empty one and makes one piece, the end token. Rows that share a doc_id, or have a
null one, are packed one by one. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.packing import byte_decoder

CAPACITY = 4096
#: Windows' share of the longest piece.
EIGHTH = 8
END = 2
WINDOWS = 256
SHORT = 48
#: Pieces of a group, on average, at most.
ROWS = 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = PIECES + ", sequence_id long, offset long"
#: A byte that UTF-8 never holds stands for the end of a word.
WORD_END = b"\xff"
#: Signs that stand alone between a letter and white space.
ENDS = frozenset(".,;:!?")
#: Distinct parts of words a worker remembers.
REMEMBERED = 600_000
#: Texts of letters that every release of Unicode takes alike.
PLAIN = re.compile("[\x00-\u02ff\u0370-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\u2010-\u2027\u20ac]*").fullmatch


class WordEncoder:
    """The tokenizer of a BPE file with word ends: composed, lower-cased, split by the file's pattern, then merged.

    White space separates, so a text's ids are those of its words one after another; each distinct word is merged once and
    remembered. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        back, suffix = byte_decoder(), model["model"]["end_of_word_suffix"]
        special = {t["content"] for t in model.get("added_tokens", ())}
        ranks = {}
        for token, i in model["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(suffix)
                ranks[bytes(back[c] for c in (token[: -len(suffix)] if ends else token)) + WORD_END * ends] = i
        self.spare = max(ranks.values()) + 1  # the end of a word by itself, which every word's last byte takes up
        for b in range(256):
            ranks.setdefault(bytes([b]), self.spare + b)
        self.core = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.parts = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merged: dict[str, bytes] = {}
        self.whole = self._library(path)

    @staticmethod
    def _library(path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return whole

    def part(self, part: str) -> bytes:
        """Ids of what the file's pattern takes as one, as little-endian numbers of four bytes."""
        own = self.merged.get(part)
        if own is None:
            own = struct.pack(f"<{len(ids)}I", *ids) if (ids := self.core.encode_single_piece(part.encode() + WORD_END)) else b""
            if len(part) < 64:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[part] = own
        return own

    def _plain(self, words: list[str]) -> list[bytes]:
        joined = "\n".join(words)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined)
        # letter by letter: what follows a letter does not matter
        part, known, parts, out = self.part, self.merged, self.parts.findall, []
        for word in joined.replace("\u03a3", "\u03c3").lower().split("\n"):
            if word.isalpha():
                out.append(known.get(word) or part(word))
            elif word[-1:] in ENDS and (head := word[:-1]).isalpha():
                out.append((known.get(head) or part(head)) + part(word[-1]))
            else:
                out.append(b"".join(map(part, parts(word))))
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of what stands between white spaces."""
        if PLAIN("".join(words)):
            return self._plain(words)
        plain = [PLAIN(w) is not None for w in words]  # other releases of Unicode may see the other letters differently
        found = iter(self._plain([w for w, p in zip(words, plain, strict=True) if p]))
        return [next(found) if p else np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w, p in zip(words, plain, strict=True)]

    def batch(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text; a null text is empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        split = pc.ascii_split_whitespace(column.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = self.words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, words), np.int64, len(words)) // 4
        ids = np.frombuffer(b"".join(words), "<u4")
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        flat = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[at] - (ends - n), n)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy()))).astype(np.int64)].astype(np.int64)
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    """One for each worker."""
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    full, rest = divmod(n, capacity)
    k = -(-rest // longest)
    return [capacity] * full + [rest // k + (i < rest % k) for i in range(k)]


def _tokenise(path: str | None, capacity: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([END], "<u4")
        for batch in batches:
            rows = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), enc.batch(batch.column("text")), strict=True):
                ids = np.concatenate((ids, end)).astype("<u4")
                raw, n, at = memoryview(ids).cast("B"), len(ids), 0
                for size in cuts(n, capacity, longest):
                    rows.append((i, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n))
                    at += size
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, longest: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return K.map_batches(docs, PIECES, _tokenise(tokenizer, capacity, longest or max(1, capacity // EIGHTH)))


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, of every item: multiway differencing.

    A partial partition is its windows' loads, fullest first, with what each window holds; windows without a load are left
    out. What two windows of a merge held becomes a node over both, and the nodes are unfolded in the end.
    """
    n = len(sizes)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)  # of node n + i: at most n - 1 of them
    made = 0
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        p, q = len(a), len(b)
        both = max(0, p + q - k)  # windows that hold something of either
        new = np.arange(made, made + both)
        made += both
        left[new], right[new] = x[p - both :], y[q - both :][::-1]
        load = np.concatenate((a[: p - both], a[p - both :] + b[q - both :][::-1], b[: q - both]))
        held = np.concatenate((x[: p - both], n + new, y[: q - both]))
        order = np.argsort(-load, kind="stable")
        load, held = load[order], held[order]
        heapq.heappush(heap, (-int(load[0] - (load[-1] if len(load) == k else 0)), number, load, held))
        number += 1
    window = np.empty(n + made, np.int64)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(made - 1, -1, -1):
        window[left[node]] = window[right[node]] = window[n + node]
    return window[:n]


def partitioned(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of every item, each at most `capacity` long, in as few windows as differencing can fill."""
    total = int(sizes.sum())
    k, tries = max(1, -(-total // capacity)), 0
    while True:
        window = differenced(sizes, k)
        fullest = int(np.bincount(window, weights=sizes, minlength=k).max())
        if fullest <= capacity:
            return window
        # near-equal windows exceed their mean by about as much with some windows more
        over = fullest - total / k
        tries += 1
        k = min(len(sizes), max(k + tries, int(np.ceil(total / max(capacity - over, capacity / 2)))))


def packed_group(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece of a group; the longest pieces come first."""
    assert (np.diff(length) <= 0).all()
    least = min(SHORT, capacity // (2 * EIGHTH))
    short = length < least
    large = int((~short).sum())
    before = np.cumsum(length[large:]) - length[large:]
    _, bundle = np.unique(before // max(least, 1), return_inverse=True)
    item = np.concatenate((np.arange(large), large + bundle))
    sizes = np.bincount(item, weights=length).astype(np.int64)
    window = partitioned(sizes, capacity)[item]
    order = np.argsort(window, kind="stable")
    ends = np.cumsum(length[order])
    starts = ends - length[order]
    first = np.concatenate(([True], np.diff(window[order]) > 0))
    base = np.maximum.accumulate(np.where(first, starts, 0))
    offset = np.empty(len(length), np.int64)
    offset[order] = starts - base
    return window, offset


def _pack(capacity: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def emit(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        window, offset = packed_group(table["length"].to_numpy(), capacity)
        group = table["group"][0].as_py()
        columns = [*[table[c].combine_chunks() for c in names[:5]], pa.array(((group << 24) + window) * 2 + 1), pa.array(offset)]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if held and held[0].column("group")[0].as_py() != group[a]:
                        yield emit(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield emit(held)

    return run


def pack_balanced(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, longest: int | None = None) -> DataFrame:
    """A row for each piece with its sequence and its place there. documents: doc_id, text."""
    cut = K.checkpointed(pieces(documents, tokenizer, capacity, longest).withColumn("uid", F.monotonically_increasing_id()))
    full, rest = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    tokens, n = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, tokens // (WINDOWS * capacity), n // ROWS)
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    dealt = dealt.repartition(min(groups, 4 * K.partitions(documents.sparkSession)), "group").sortWithinPartitions("group", F.desc("length"), "uid")
    packed = K.map_batches(dealt.drop("uid"), SCHEMA, _pack(capacity))
    return packed.union(full.select(*[x.split()[0] for x in PIECES.split(", ")], (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op11_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_balanced(K.read(spark, sf_dir, "documents"))
