"""Best-fit packing of tokenised documents into sequences of bounded length, in supersteps.

1. Tasks tokenise whole texts and cut documents longer than a sequence, the first piece taking the
   remainder, so that all other pieces fill a sequence each and need no search.
2. Pieces of one length under BUNDLE / 2 tokens are bundled, up to BUNDLE tokens, so that a sequence takes a bounded
   number of items and the supersteps are few. Items are the bundles and the other pieces.
3. The longest items open sequences, as many as all tokens need at least. Then, in supersteps:
   a. gaps and items are range-sorted together by size, the largest first;
   b. every range is swept by one task: an item takes its successor, the smallest gap before it that no longer item
      has taken, a gap takes one item. That is a matching of parentheses, gaps opening and items closing;
   c. what finds no mate in its range is resolved by rank: the counts of such gaps and items of each range, two
      numbers a range, say which ranks of which range meet, and an equal join brings them together;
   d. gaps are updated. When no item fits any gap, the longest items left open as many sequences as they need at
      least; the end is when no item is left.

A superstep is what best-fit decreasing does while each gap takes one item. A null text is an empty one and makes one
piece, the end token. Rows that share a doc_id, or have a null one, are packed one by one. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

CAPACITY = 1024
END = 2
#: Pieces under half of it are bundled up to so many tokens.
BUNDLE = 64
#: Rows of a range or of a salt, on average.
ROWS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_decoder() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies -> bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str):
    """The tokenizer of a byte-level BPE file. Ranks are the ids of its tokens, merges being in id order."""
    import public_tokenizers
    import tiktoken

    back = byte_decoder()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> np.ndarray:
    """Ids of a text as little-endian uint32. Texts beyond a megabyte go in parts cut where the pattern always cuts."""
    if len(text) <= 1 << 20:
        return enc.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    while at < len(text):
        to = at + (1 << 20)
        while 0 < to < len(text) and not (text[to] == " " and text[to - 1].isalpha() and text[to + 1 : to + 2].isalpha()):
            to += 1
        parts.append(enc.encode_to_numpy(text[at:to], disallowed_special=()))
        at = to
    return np.concatenate(parts)


def _tokenise(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        end = np.array([END], np.uint32)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate((encode(enc, text or ""), end)).astype("<u4")
                raw, n = memoryview(ids).cast("B"), len(ids)
                at, size = 0, n % capacity or capacity
                piece = 0
                while at < n:
                    rows.append((i, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, size, piece = at + size, capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return K.map_batches(docs, PIECES, _tokenise(tokenizer, capacity))


def matched(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of gaps and of the items that take them, in a row of both sorted by falling size, gaps before items.

    Each item takes the last gap before it that is still free.
    """
    depth = np.cumsum(np.where(is_gap, 1, -1))
    level = np.where(is_gap, depth, depth + 1)
    order = np.lexsort((np.arange(len(level)), level))
    one, two = order[:-1], order[1:]
    met = (level[one] == level[two]) & is_gap[one] & ~is_gap[two]
    return one[met], two[met]


#: kind 0: a gap of a sequence; 1: an item; 2: an item placed in a sequence. rank: among the gaps (from the last on)
#: or items of the range that found no mate there, else -1.
STATE = "kind int, id long, size long, item long, offset long, part int, rank long"


def _batch(columns: list) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in STATE.split(", ")])


def _met(gap: np.ndarray, size: np.ndarray, sequence: np.ndarray, item: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Placements, and what is left of the gaps."""
    left, n = gap - size, len(gap)
    open_ = left > 0
    m = int(open_.sum())
    return _batch([np.repeat((2, 0), (n, m)), np.concatenate((sequence, sequence[open_])), np.concatenate((size, left[open_])), np.concatenate((item, np.full(m, -1))),
                   np.concatenate((capacity - gap, np.full(m, -1))), np.full(n + m, -1), np.full(n + m, -1)])


def _sweep(capacity: int):
    """Sweep one range of gaps and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [(b.column("kind").to_numpy(), b.column("id").to_numpy(), b.column("size").to_numpy()) for b in batches]
        if not held:
            return
        kind, key, size = (np.concatenate(c) for c in zip(*held, strict=True))
        gap, item = matched(kind == 0)
        yield _met(size[gap], size[item], key[gap], key[item], capacity)
        alone = np.ones(len(kind), bool)
        alone[gap] = alone[item] = False
        part = TaskContext.get().partitionId()
        for k in (0, 1):
            at = np.flatnonzero(alone & (kind == k))
            at = at[::-1] if k == 0 else at
            none = np.full(len(at), -1)
            yield _batch([np.full(len(at), k), key[at], size[at], none, none, np.full(len(at), part), np.arange(len(at))])

    return run


def resolve(ranges: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """ranges: (range, items without a mate, gaps without one), two numbers a range, in order of falling size.

    Returns for gaps and for items the (range, first rank, number of the first pair) of runs of pairs; the rows of a run
    are numbered on. Items of a range take the last gaps that are free in the ranges before.
    """
    gaps, items, stack, pair = [], [], [], 0
    for part, n_items, n_gaps in ranges:
        rank = 0
        while n_items and stack:
            other, used, free = stack.pop()
            n = min(n_items, free)
            gaps.append((other, used, pair, n))
            items.append((part, rank, pair, n))
            rank, pair, n_items = rank + n, pair + n, n_items - n
            if free > n:
                stack.append((other, used + n, free - n))
        if n_gaps:
            stack.append((part, 0, n_gaps))
    return gaps, items


def _numbered(shared):
    """The number of the pair that a gap or item belongs to, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, rank = (batch.column(c).to_numpy() for c in ("kind", "part", "rank"))
            pair = np.full(len(kind), -1)
            for k in (0, 1):
                key, first, number, n = shared.value[k]
                mine = np.flatnonzero(kind == k)
                if len(mine) and len(key):
                    at = np.searchsorted(key, (part[mine].astype(np.int64) << SHIFT) + rank[mine], side="right") - 1
                    own = np.maximum(at, 0)
                    inside = (at >= 0) & (key[own] >> SHIFT == part[mine]) & (rank[mine] < first[own] + n[own])
                    pair[mine] = np.where(inside, number[own] + rank[mine] - first[own], -1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "id", "size")], pa.array(pair)], names=["kind", "id", "size", "pair"])

    return run


SHIFT = 40


def _runs(rows: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (a[:, 0] << SHIFT) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def superstep(rows: DataFrame, n_rows: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """One matching of gaps and items (kind, id, size): what is left of both, and the placements."""
    spark, parts = rows.sparkSession, max(1, -(-n_rows // ROWS))
    ranged = rows.repartitionByRange(parts, F.desc("size"), "kind", "id").sortWithinPartitions(F.desc("size"), "kind", "id")
    swept = K.checkpointed(K.map_batches(ranged, STATE, _sweep(capacity))).coalesce(parts)  # read by as many tasks as its size asks for
    placed = swept.where("kind = 2")
    alone = swept.where("rank >= 0").groupBy("part").agg(F.sum("kind").alias("items"), F.sum(1 - F.col("kind")).alias("gaps")).orderBy("part").collect()  # a row for each range
    gaps, items = resolve([(r.part, r["items"], r.gaps) for r in alone])
    if not gaps:
        return swept.where("kind < 2").select("kind", "id", "size"), placed
    shared = spark.sparkContext.broadcast((_runs(gaps), _runs(items)))
    numbered = K.map_batches(swept.where("rank >= 0").select("kind", "id", "size", "part", "rank"), "kind int, id long, size long, pair long", _numbered(shared))
    numbered = K.checkpointed(numbered)  # by the tasks that read the sweep
    one = numbered.where("kind = 0 and pair >= 0").select("pair", F.col("id").alias("sequence"), F.col("size").alias("gap"))
    two = numbered.where("kind = 1 and pair >= 0").select("pair", F.col("id").alias("item"), "size")
    met = K.checkpointed(one.join(two, "pair")).coalesce(parts)
    left = numbered.where("pair < 0").select("kind", "id", "size").union(swept.where("kind = 0 and rank < 0").select("kind", "id", "size"))
    left = left.union(met.where("gap > size").select(F.lit(0), "sequence", F.col("gap") - F.col("size")))
    met = met.select(F.lit(2).alias("kind"), F.col("sequence").alias("id"), "size", "item", (capacity - F.col("gap")).alias("offset"), F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("rank"))
    return left.coalesce(parts), placed.union(met).coalesce(parts)


def opened(items: DataFrame, n: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The state once the n longest items have opened sequences, and their placements. items: kind, id, size."""
    sizes = {r.size: r.n for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    least = 0
    for least in sorted(sizes, reverse=True):
        if n <= sizes[least]:
            break
        n -= sizes[least]
    # n items of the size `least` open sequences too: so many of each salt
    tied, salts = items.where(F.col("size") == least), max(16, -(-sizes.get(least, 0) // ROWS))
    tied = tied.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    quota, taken = [], 0
    for r in tied.groupBy("salt").agg(F.count("*").alias("n")).orderBy("salt").collect():
        quota.append((r.salt, min(r.n, n - taken)))
        taken += quota[-1][1]
    quotas = items.sparkSession.createDataFrame(quota, "salt long, quota long")
    order = Window.partitionBy("salt").orderBy("id")
    tied = tied.withColumn("own", F.row_number().over(order)).join(F.broadcast(quotas), "salt")
    first = items.where(F.col("size") > least).select("id", "size", F.lit(True).alias("opens")).union(tied.select("id", "size", F.col("own") <= F.col("quota")))
    first = K.checkpointed(first.union(items.where(F.col("size") < least).select("id", "size", F.lit(False))))
    first = first.coalesce(max(1, -(-sum(sizes.values()) // ROWS)))
    gaps = first.where(F.col("opens") & (F.col("size") < capacity)).select(F.lit(0).alias("kind"), "id", (capacity - F.col("size")).alias("size"))
    placed = first.where("opens").select(F.lit(2).alias("kind"), "id", "size", F.col("id").alias("item"), F.lit(0).cast("long").alias("offset"), F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("rank"))
    return gaps.union(first.where("not opens").select(F.lit(1), "id", "size")), placed


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item, sequence_id, offset. items: id, size, kept where they can be read again."""
    state, placements = items.select(F.lit(1).alias("kind"), "id", "size"), []
    stalled = True
    while True:
        left = F.col("kind") == 1
        stats = state.agg(F.count("*").alias("rows"), F.sum(left.cast("long")).alias("items"), F.sum(F.when(left, F.col("size"))).alias("tokens"), F.min(F.when(left, F.col("size"))).alias("least"))
        stats = stats.first()
        if not stats["items"]:
            break
        if not stalled:  # did the last superstep place anything?
            stalled = stats["items"] == before
        if stalled:
            opening, placed = opened(state.where("kind = 1"), -(-stats.tokens // capacity), capacity)
            state = opening.union(state.where("kind = 0"))
            placements.append(placed)
            stalled, before = False, None
            continue
        before = stats["items"]
        state = state.where(left | (F.col("size") >= stats.least))  # no item fits the other gaps
        state, placed = superstep(state, stats.rows, capacity)
        placements.append(placed)
    found = items.select(F.lit(2).alias("kind"), "id", "size", F.col("id").alias("item"), F.lit(0).cast("long").alias("offset")).limit(0)
    for placed in placements:
        found = found.union(placed.select("kind", "id", "size", "item", "offset"))
    return found.select("item", F.col("id").alias("sequence_id"), "offset")


def bundled(cut: DataFrame, n: int) -> DataFrame:
    """The pieces with their item (the least uid in it), its size and their place within it."""
    short = F.col("length") * 2 <= BUNDLE
    salts = max(16, -(-n // ROWS))
    salted = cut.where(short).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    salted = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1)
    fits = F.floor(F.lit(BUNDLE) / F.col("length"))
    same = Window.partitionBy("length", "salt", "bundle")
    salted = salted.withColumn("bundle", F.floor(F.col("own") / fits)).withColumns({"item": F.min("uid").over(same), "size": F.sum("length").over(same), "inside": (F.col("own") % fits) * F.col("length")})
    columns = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
    single = cut.where(~short).select(*columns, F.col("uid").alias("item"), F.col("length").alias("size"), F.lit(0).cast("long").alias("inside"))
    return salted.select(*columns, "item", "size", "inside").union(single)


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there. documents: doc_id, text."""
    cut = K.checkpointed(pieces(documents, tokenizer, capacity).withColumn("uid", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") == capacity)
    rest = K.checkpointed(bundled(cut.where(F.col("length") < capacity), cut.count()))
    places = best_fit(rest.where("uid = item").select(F.col("item").alias("id"), "size"), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    packed = rest.join(places, "item").select(*columns, "sequence_id", (F.col("offset") + F.col("inside")).alias("offset"))
    return packed.union(full.select(*columns, F.col("uid"), F.lit(0).cast("long")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(K.read(spark, sf_dir, "documents"))
