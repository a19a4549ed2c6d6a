"""Merkle manifest of a dataset with incremental witnesses.

A leaf is the digest of a row's doc_id, source, lang, n_chars and text. The leaves of a source, by doc_id, form a tree in
which 16 neighbours become their parent; the sources' subroots, by source, form the tree of the root.

1. Leaves are hashed where the texts are read; texts are not moved. Their digests are range-sorted by source and doc_id. A
   range's first source goes on where the ranges before have left it: two names and two numbers a range tell where.
2. Leaves are dealt in aligned blocks of 16**3. A task appends a block's leaves one by one (`Appender`): an open subtree
   holds its nodes so far, each leaf below it a partial witness, which every completed run of siblings extends. What is
   left of a block is its root.
3. Block roots are further appends: they are nodes of the same kind, appended in blocks again, until each source has one
   root, and then the sources' roots until there is the root of all.
4. On the way down every block gets the witness of its own root from the level above; the leaves' witnesses end with it.
   A witness is the list of the runs that hold a node's ancestors and its place in each. Verification folds a leaf through
   these runs.

No step sees more than a block, whatever the share of a source. Where two rows agree in source and doc_id they stand by
leaf; rows that are equal in all columns have the same leaf, witnesses of their own places. Null doc_ids come first. Empty
tables give no rows; a missing column counts as null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

WIDTH = 16
#: Levels of a block.
LEVELS = 3
BLOCK = WIDTH**LEVELS
DIGEST = 64
MODULUS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


class Appender:
    """Aligned appends to a tree of `levels` levels, or of as many as leave one node if levels is None.

    witnesses[i] is the i-th append's: a list of (run, place), run being the digests of a completed run in one string and
    place that of the append's ancestor in it. A run is shared by all witnesses that it extends.
    """

    def __init__(self, levels: int | None):
        self.levels = levels
        self.witnesses: list[list[tuple[str, int]]] = []
        #: Of each level, the open run: its nodes and the appends below each of them, as a span.
        self.open: list[list[tuple[str, int, int]]] = [[]]

    def append(self, node: str) -> None:
        n = len(self.witnesses)
        self.witnesses.append([])
        self._add(0, node, n, n + 1)

    def _add(self, level: int, node: str, first: int, last: int) -> None:
        run = self.open[level]
        run.append((node, first, last))
        if len(run) == WIDTH and (self.levels is None or level < self.levels):
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        text = "".join(node for node, _, _ in run)
        for place, (_, first, last) in enumerate(run):
            for witness in self.witnesses[first:last]:
                witness.append((text, place))
        if level + 1 == len(self.open):
            self.open.append([])
        self._add(level + 1, digest(text), run[0][1], run[-1][2])

    def close(self) -> str:
        """The root; what is open is completed."""
        level = 0
        while True:
            top = level + 1 == len(self.open)
            if self.levels is None and top and len(self.open[level]) == 1:
                return self.open[level][0][0]
            if self.levels is not None and level == self.levels:
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
            level += 1


def fold(leaf: str, witness: list[tuple[str, int]]) -> str:
    """The root that a leaf and its siblings give."""
    for run, place in witness:
        leaf = digest(run[: DIGEST * place] + leaf + run[DIGEST * (place + 1) :])
    return leaf


def siblings(witness: list[tuple[str, int]]) -> str:
    return "".join(run[: DIGEST * place] + run[DIGEST * (place + 1) :] for run, place in witness)


# ---- leaves


def part(name: str, value: Column, kind: str) -> Column:
    text = value if kind == "text" else value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)).alias(name)


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf of the tampered row where the row is to be tampered with."""
    kinds = dict.fromkeys(("doc_id", "n_chars"), "long") | dict.fromkeys(("source", "lang", "text"), "string")
    have = {c.lower() for c in documents.columns}
    d = documents.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])
    head = F.concat(*[part(c, F.col(c), kinds[c]) for c in COLUMNS[:-1]])
    leaf = F.sha2(F.concat(head, part("text", F.col("text"), "text")), 256)
    lowered = F.sha2(F.concat(head, part("text", F.translate("text", UPPER, LOWER), "text")), 256)
    chosen = F.crc32(F.col("doc_id").cast("string")) % MODULUS == 0
    return d.select("doc_id", "source", leaf.alias("leaf"), F.when(chosen, lowered).alias("tampered"))


# ---- places


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `place`, their number within the key, by `order`. A null key comes first. Checkpointed.

    Rows are range-sorted. Only the first key of a range can have begun before it, so the driver gets, of each range, its
    first and last key and how many rows these have there.
    """
    n = K.partitions(rows.sparkSession)
    by = [F.asc_nulls_first(c) for c in (key, *order)]
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
    ranged = K.checkpointed(ranged)
    same = lambda end: F.col(key).eqNullSafe(F.col(end))
    ends = ranged.groupBy("range").agg(F.min(F.struct(F.col(key).isNotNull(), key)).alias("a"), F.max(F.struct(F.col(key).isNotNull(), key)).alias("z"))
    ends = ends.select("range", F.col(f"a.{key}").alias("first_key"), F.col(f"z.{key}").alias("last_key"))
    counted = ranged.join(F.broadcast(ends), "range").groupBy("range", "first_key", "last_key")
    counted = counted.agg(F.count_if(same("first_key")).alias("n_first"), F.count_if(same("last_key")).alias("n_last")).orderBy("range").collect()
    begun, going, before = {}, object(), 0
    for r in counted:
        begun[r["range"]] = before if r.first_key == going else 0
        if r.last_key == r.first_key:
            before = begun[r["range"]] + r.n_last
        else:
            before = r.n_last
        going = r.last_key
    schema = ranged.drop("range").schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", place long"
    shared = rows.sparkSession.sparkContext.broadcast(begun)
    # a partition of the checkpoint is a range, its rows in order
    return K.map_batches(ranged, schema, _place(shared, key))


def _place(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = None, 0
        for batch in batches:
            out = []
            for at in zip(batch.column("range").to_pylist(), batch.column(key).to_pylist(), strict=True):
                if at != now:
                    place = shared.value[at[0]] if now is None or at[0] != now[0] else 0
                    now = at
                out.append(place)
                place += 1
            names = [c for c in batch.schema.names if c != "range"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.int64())], names=[*names, "place"])

    return run


# ---- trees

NODES = "key string, place long, node string"
WITNESS = "key string, place long, runs array<string>, places array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block its root, with all its levels and with as many as leave one node. Rows: by key, block, place."""

    def emit(now, nodes):
        whole, least = Appender(LEVELS), Appender(None)
        for node in nodes:
            whole.append(node)
            least.append(node)
        done.append((*now, whole.close(), least.close()))

    now, nodes, done = None, [], []
    for batch in batches:
        for key, block, node in zip(*[batch.column(c).to_pylist() for c in ("key", "block", "node")], strict=True):
            if (key, block) != now:
                if now is not None:
                    emit(now, nodes)
                now, nodes = (key, block), []
            nodes.append(node)
        if len(done) >= 1000:
            yield _rows(done, BLOCKS)
            done = []
    if now is not None:
        emit(now, nodes)
    if done:
        yield _rows(done, BLOCKS)


BLOCKS = "key string, place long, whole string, least string"
TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[c.split(" ") for c in schema.split(", ")], strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.col("place").bitwiseAND(-BLOCK) / BLOCK).withColumn("block", F.col("block").cast("long"))


def appended(nodes: DataFrame) -> DataFrame:
    """A level's block roots (key, place, node, alone), checkpointed. nodes: key, place, node."""
    n = K.partitions(nodes.sparkSession)
    dealt = in_blocks(nodes).repartition(n, "key", "block").sortWithinPartitions("key", "block", "place")
    roots = K.checkpointed(K.map_batches(dealt.select("key", "block", "node"), BLOCKS, _blocks))
    # a key of a single block ends there: as many levels as leave one node
    count = roots.groupBy(F.col("key").alias("k")).agg(F.max("place").alias("last"))
    joined = roots.join(count, roots.key.eqNullSafe(count.k)).withColumn("alone", F.col("last") == 0)
    return K.checkpointed(joined.select("key", "place", F.when(F.col("alone"), F.col("least")).otherwise(F.col("whole")).alias("node"), "alone"))


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels of block roots, and each key's root (key, node)."""
    levels, finished = [], None
    while True:
        roots = appended(nodes)
        levels.append(roots)
        done = roots.where("alone").select("key", "node")
        finished = done if finished is None else finished.union(done)
        nodes = roots.where("not alone").select("key", "place", "node")
        if nodes.isEmpty():
            return levels, finished


def blocks_of(batches: Iterator[pa.RecordBatch]):
    """(key, block, head row, node rows) of every block of rows sorted by key, block, kind, place."""
    now, head, rows = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["key"], row["block"])
            if at != now:
                if now is not None:
                    yield (*now, head, rows)
                now, head, rows = at, None, []
            if row["kind"] == 0:
                head = row
            else:
                rows.append(row)
    if now is not None:
        yield (*now, head, rows)


def witnesses(head: dict, rows: list[dict]) -> Iterator[tuple[dict, list[tuple[str, int]]]]:
    """The node rows of a block with their whole witnesses."""
    tree = Appender(None if head["alone"] else LEVELS)
    for row in rows:
        tree.append(row["node"])
    tree.close()
    above = list(zip(head["runs"], head["places"], strict=True))
    for row, own in zip(rows, tree.witnesses, strict=True):
        yield row, own + above


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = []
    for key, _, head, rows in blocks_of(batches):
        for row, witness in witnesses(head, rows):
            done.append((key, row["place"], [r for r, _ in witness], [p for _, p in witness]))
            if len(done) >= 200:
                yield _rows(done, WITNESS)
                done = []
    if done:
        yield _rows(done, WITNESS)


def with_heads(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes (key, place, node, more) and their blocks' roots (key, place, alone, runs, places, more), by block; a root first."""
    rows, tops = in_blocks(nodes).withColumn("kind", F.lit(1)), heads.withColumnRenamed("place", "block").withColumn("kind", F.lit(0))
    both = rows.unionByName(tops, allowMissingColumns=True)
    return both.repartition(K.partitions(nodes.sparkSession), "key", "block").sortWithinPartitions("key", "block", "kind", "place")


def descended(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Witnesses of the lowest level's block roots (key, place, alone, runs, places). roots: key, runs, places of each key's root."""
    found, tops = None, roots.select(F.col("key").alias("k"), "runs", "places")
    for level in reversed(levels):
        own = level.where("alone")
        own = own.join(tops, own.key.eqNullSafe(tops.k)).select("key", "place", "runs", "places", "alone")
        if found is not None:
            inner = K.map_batches(with_heads(level.where("not alone").select("key", "place", "node"), found), WITNESS, _level)
            own = own.unionByName(inner.withColumn("alone", F.lit(False)))
        found = K.checkpointed(own)
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = []
    for _, _, head, rows in blocks_of(batches):
        for row, witness in witnesses(head, rows):
            folded = fold(row["tampered"] or row["node"], witness)
            done.append((row["doc_id"], row["node"], head["subroot"], head["root"], digest(siblings(witness)), folded, folded == head["root"]))
            if len(done) >= 2000:
                yield _rows(done, SCHEMA)
                done = []
    if done:
        yield _rows(done, SCHEMA)


def manifest(documents: DataFrame) -> DataFrame:
    """Of every row its leaf, its source's and the table's root, the digest of its proof, and what its verification gives."""
    spark = documents.sparkSession
    placed = numbered(leaves(documents), "source", ["doc_id", "leaf"]).select(F.col("source").alias("key"), "place", F.col("leaf").alias("node"), "doc_id", "tampered")
    placed = K.checkpointed(placed)
    levels, subroots = grown(placed.select("key", "place", "node"))
    if subroots.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    # the sources' roots are the leaves of one more tree
    sources = subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "node")
    sources = K.checkpointed(numbered(sources, "key", ["source"]))
    tops, root = grown(sources.select("key", "place", "node"))
    empty = root.select("key", F.array().cast("array<string>").alias("runs"), F.array().cast("array<int>").alias("places"))
    above = K.map_batches(with_heads(sources.select("key", "place", "node"), descended(tops, empty)), WITNESS, _level)
    above = K.checkpointed(above.select("place", "runs", "places").join(sources.select("place", "source", F.col("node").alias("subroot")), "place"))
    heads = descended(levels, above.select(F.col("source").alias("key"), "runs", "places"))
    heads = heads.join(above.select("source", "subroot"), F.col("key").eqNullSafe(F.col("source"))).drop("source")
    heads = heads.withColumn("root", F.lit(root.first().node))  # one row
    return K.map_batches(with_heads(placed, heads), SCHEMA, _verify)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(K.read(spark, sf_dir, "documents"))


def _level_sql(name: str, levels: int, keys: str) -> str:
    """Runs, siblings and parents of `levels` levels over {name}0 (keys, place, h): {name}n are nodes, {name}rn their runs."""
    out = []
    for k in range(levels):
        out.append(f"""{name}r{k} as (
  select {keys}, place // 16 as place, string_agg(h, '' order by place) as run, any_value(total) as total
  from (select *, count(*) over (partition by {keys}) as total from {name}{k})
  group by {keys}, place // 16)""")
        out.append(f"{name}{k + 1} as (select {keys}, place, case when total = 1 then run else sha256(run) end as h from {name}r{k})")
    return ",\n".join(out)


def _fold_sql(runs: str, level: int, steps: list[str], place: str, join: str) -> str:
    """One step: (p: siblings so far, f: the folded digest) through the run that holds place // 16**level."""
    own, at = f"({place} // {16**level})", f"64 * (({place} // {16**level}) % 16)"
    return f"""{steps[1]} as (
  select s.* exclude (p, f),
    case when r.total = 1 then s.p else s.p || substr(r.run, 1, {at}) || substr(r.run, {at} + 65) end as p,
    case when r.total = 1 then s.f else sha256(substr(r.run, 1, {at}) || s.f || substr(r.run, {at} + 65)) end as f
  from {steps[0]} s join {runs} r on {join} and r.place = {own} // 16)"""


#: Levels that the SQL has: a million rows a source, 65536 sources.
_LEAF_LEVELS, _SOURCE_LEVELS = 5, 4
_PART = "case when {0} is null then '-' else strlen({0}::varchar)::varchar || ':' || {0}::varchar end"
_HEAD = " || ".join(_PART.format(c) for c in COLUMNS[:-1])
_STEP = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"


def _sql() -> str:
    table = f"list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: {_STEP.format('c')}))"
    steps = [
        _fold_sql(f"lr{k}", k, [f"s{k}", f"s{k + 1}"], "s.place", "r.source is not distinct from s.source") for k in range(_LEAF_LEVELS)
    ] + [_fold_sql(f"tr{k}", k, [f"s{_LEAF_LEVELS + k}", f"s{_LEAF_LEVELS + k + 1}"], "s.top", "true") for k in range(_SOURCE_LEVELS)]
    last = _LEAF_LEVELS + _SOURCE_LEVELS
    return f"""
with t as (select {table} as crc_table),
d as (
  select doc_id, source, sha256({_HEAD} || {_PART.format("text")}) as leaf,
    sha256({_HEAD} || {_PART.format(f"translate(text, '{UPPER}', '{LOWER}')")}) as lowered,
    list_reduce(
      list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: xor(crc >> 8, crc_table[(1 + (xor(crc, b) & 255))::int])) as crc
  from documents, t),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from d),
l0 as (select source, place, leaf as h from placed),
{_level_sql("l", _LEAF_LEVELS, "source")},
tops as (select source, row_number() over (order by source is not null, encode(source)) - 1 as place, h from l{_LEAF_LEVELS}),
t0 as (select 1 as one, place, h from tops),
{_level_sql("t", _SOURCE_LEVELS, "one")},
s0 as (
  select p.doc_id, p.source, p.leaf, p.place, tops.place as top, tops.h as subroot, '' as p,
    case when xor(crc, 4294967295) % {MODULUS} = 0 then lowered else leaf end as f
  from placed p join tops on p.source is not distinct from tops.source),
{(","+chr(10)).join(steps)}
select s.doc_id, s.leaf, s.subroot, t.h as root, sha256(s.p) as proof_sha256, s.f as folded_root, s.f = t.h as verified
from s{last} s, t{_SOURCE_LEVELS} t
"""


OP13_SQL = _sql()
