"""Ranks, row numbers and running states of keys that may hold a third of all rows.

Rows are dealt by ranges of key and order, each range an even part of the rows; what a range needs of the ranges before it
(counts, or a state) is one row for each key and range. Nothing sorts a whole key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import RANGE, SPAN, range_of
from tidemark.sources.tables import checkpointed

UPTO = (Window.unboundedPreceding, Window.currentRow)


def dealt(df: DataFrame, order: list) -> DataFrame:
    """df with RANGE: the number of the range, in this order, that the row is in. Checkpointed, since the ranges follow samples."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list, counts: dict[str, Column]) -> DataFrame:
    """rows (with RANGE) and, of each name, the sum of its expression over the key's rows up to this one, by order."""
    own = [f"_own_{name}" for name in counts]
    rows = rows.withColumns({o: c.cast("long") for o, c in zip(own, counts.values(), strict=True)})
    sums = rows.groupBy(*keys, RANGE).agg(*[F.sum(o).alias(o) for o in own])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, RANGE, *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(o) for o in own], F.lit(0).alias("_edge"))
    both = rows.withColumn("_edge", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, RANGE).orderBy("_edge", *order).rowsBetween(*UPTO)
    out = both.withColumns({name: F.sum(o).over(w) for name, o in zip(counts, own, strict=True)})
    return out.where("_edge = 1").drop("_edge", *own)


def numbered(df: DataFrame, keys: list[str], order: list, counts: dict[str, Column]) -> DataFrame:
    """df and, of each name, how many of the key's rows up to this one meet the condition. order must leave no ties."""
    return running(dealt(df, [*keys, *order]), keys, order, {k: c.cast("int") for k, c in counts.items()}).drop(RANGE)


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of every distinct value of a key: n, below and total, the number of rows that have it, a lesser one, and any. No nulls."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rows = dealt(counts, [*keys, value])
    total = rows.groupBy(*keys).agg(F.sum("n").alias("total"))
    upto = running(rows, keys, [value], {"_upto": F.col("n")}).drop(RANGE)
    same = F.lit(True)
    for k in keys:
        same = same & upto[k].eqNullSafe(total[k])
    return upto.join(total, same).select(*[upto[k] for k in keys], value, "n", (F.col("_upto") - F.col("n")).alias("below"), "total")


def with_ranks(df: DataFrame, keys: list[str], value: str, rank: Column, name: str) -> DataFrame:
    """df and an expression of n, below and total of each row's value; null where the value is."""
    ranks = value_ranks(df, keys, value).select(*[F.col(k).alias(f"_rank_key_{i}") for i, k in enumerate(keys)], F.col(value).alias("_rank_value"), rank.alias(name))
    same = F.col(value) == F.col("_rank_value")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rank_key_{i}"))
    return df.join(ranks, same, "left").drop("_rank_value", *[f"_rank_key_{i}" for i in range(len(keys))])


def percentile_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """100 times the share of the key's values up to this one."""
    return with_ranks(df, keys, value, 100 * (F.col("below") + F.col("n")) / F.col("total"), name)


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return with_ranks(df, keys, value, F.col("below") + (F.col("n") + 1) / 2, name)


def clamped(rows: DataFrame, keys: list[str], order: list[str], steps: dict[str, tuple[Column, Column]], span: int = SPAN) -> DataFrame:
    """rows and running states: each name maps to (sets, changes), the value that the row sets the state to, else what it adds to
    it; the state starts at 0 and is never below 0. order[0] is the block.

    A row without a set value is the function x -> max(0, x + d). Rows one after another compose to x -> max(low, x + sum): within a
    stretch without sets the state is its start plus the running sum s, less what s has fallen below minus the start. So a
    range of blocks is known by (low, sum) or by the value it ends with, ranges are composed by a running maximum, and a
    range's rows need only the state it begins with.
    """
    amount, at = "decimal(38,0)", [f"_at_{i}" for i in range(len(order))]
    rows = rows.withColumns({RANGE: range_of(F.col(order[0]), span), "_edge": F.lit(1)} | dict(zip(at, map(F.col, order), strict=True)))
    for name, (sets, changes) in steps.items():
        rows = rows.withColumns({f"_set_{name}": sets.cast(amount), f"_add_{name}": F.coalesce(changes, F.lit(0)).cast(amount)})

    def states(both: DataFrame) -> DataFrame:
        """Within each range, from the state that its first row sets."""
        w = Window.partitionBy(*keys, RANGE).orderBy("_edge", *at).rowsBetween(*UPTO)
        both = both.withColumns({f"_part_{n}": F.count(f"_set_{n}").over(w) for n in steps})
        for n in steps:
            inside = Window.partitionBy(*keys, RANGE, f"_part_{n}").orderBy("_edge", *at).rowsBetween(*UPTO)
            both = both.withColumn(f"_sum_{n}", F.sum(F.coalesce(f"_set_{n}", f"_add_{n}")).over(inside).cast(amount))
            both = both.withColumn(f"_low_{n}", F.min(f"_sum_{n}").over(inside))
            both = both.withColumn(n, (F.col(f"_sum_{n}") - F.least(F.lit(0).cast(amount), F.col(f"_low_{n}"))).cast(amount))
        return both

    last = lambda c: F.max_by(c, F.struct(*at))
    ends = states(rows).groupBy(*keys, RANGE).agg(
        *[last(n).alias(f"_end_{n}") for n in steps], *[F.max(f"_part_{n}").alias(f"_sets_{n}") for n in steps], *[last(f"_sum_{n}").alias(f"_all_{n}") for n in steps]
    )
    by = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(*UPTO)
    for n in steps:
        # a range that sets the state begins a new stretch; the others add `all` and give at least `end`
        ends = ends.withColumn(f"_part_{n}", F.count_if(F.col(f"_sets_{n}") > 0).over(by))
        stretch = Window.partitionBy(*keys, f"_part_{n}").orderBy(RANGE).rowsBetween(*UPTO)
        ends = ends.withColumn(f"_run_{n}", F.sum(F.when(F.col(f"_sets_{n}") > 0, F.lit(0).cast(amount)).otherwise(F.col(f"_all_{n}"))).over(stretch).cast(amount))
        ends = ends.withColumn(f"_state_{n}", (F.col(f"_run_{n}") + F.greatest(F.lit(0).cast(amount), F.max(F.col(f"_end_{n}") - F.col(f"_run_{n}")).over(stretch))).cast(amount))
    begins = Window.partitionBy(*keys).orderBy(RANGE)
    carry = ends.select(*keys, RANGE, F.lit(0).alias("_edge"), *[F.coalesce(F.lag(f"_state_{n}").over(begins), F.lit(0)).cast(amount).alias(f"_set_{n}") for n in steps])
    out = states(rows.unionByName(carry, allowMissingColumns=True)).where("_edge = 1")
    return out.drop("_edge", RANGE, *at, *[f"_{p}_{n}" for n in steps for p in ("set", "add", "part", "sum", "low")])
