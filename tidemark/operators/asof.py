"""As-of joins without range joins: both sides in one ordered stream, by ranges of the order.

A key's stream is cut into ranges of SPAN places (blocks or seconds). The last state of a range is carried into the next ones
as a row at their beginning, so no task sorts a whole key: a pool that holds a third of all rows is as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a range: a week of blocks. A block holds a bounded number of events, and so does a range of blocks.
SPAN = 50_000
RANGE = "_asof_range"


def range_of(at: Column, span: int = SPAN) -> Column:
    return F.floor(at / span).cast("long")


def carried(states: DataFrame, on: list[str], state: str, backwards: bool = False) -> DataFrame:
    """Each range of each key with the last known state of the ranges before it (backwards: the first of those after it), where
    there is one. states: on, RANGE, state; a row for each range."""
    order = Window.partitionBy(*on).orderBy(F.desc(RANGE) if backwards else F.asc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    return states.withColumn(state, F.last(state, ignorenulls=True).over(order)).where(F.col(state).isNotNull())


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_order: str, right_order: str, values: list[str], fill_first: bool = False, span: int = SPAN) -> DataFrame:
    """Each left row with the values of the last right row at or before it, null if there is none.

    With fill_first the rows before the first right row take its values. Right rows that share key and order
    resolve to the largest values. Nulls in the order column match nothing. One shuffle of both sides, on key and range; the
    states carried between ranges are one row for each key and range that has rows.
    """
    marked = "_asof_values"
    right_rows = right.where(F.col(right_order).isNotNull()).groupBy(*on, F.col(right_order).alias("_asof_at")).agg(F.max(F.struct(*values)).alias(marked))
    right_rows = right_rows.withColumns({"_asof_side": F.lit(0), RANGE: range_of(F.col("_asof_at"), span)})
    left_rows = left.withColumns({"_asof_at": F.col(left_order), "_asof_side": F.lit(1), RANGE: range_of(F.col(left_order), span)})
    ranges = left_rows.where(F.col(RANGE).isNotNull()).select(*on, RANGE).distinct()
    kind = dict(right_rows.dtypes)[marked]
    state = lambda pick: right_rows.groupBy(*on, RANGE).agg(pick(marked, "_asof_at").alias(marked)).unionByName(ranges.withColumn(marked, F.lit(None).cast(kind))).groupBy(*on, RANGE).agg(F.max(marked).alias(marked))
    before = carried(state(F.max_by), on, marked).withColumns({"_asof_at": F.lit(None).cast("long"), "_asof_side": F.lit(-1)})
    both = left_rows.unionByName(right_rows, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)
    if fill_first:
        after = carried(state(F.min_by), on, marked, backwards=True).withColumns({"_asof_at": F.lit(None).cast("long"), "_asof_side": F.lit(2)})
        both = both.unionByName(after, allowMissingColumns=True)
    # a carried state stands before all rows of its range, one of later ranges after all
    edge = F.when(F.col("_asof_side") == -1, 0).when(F.col("_asof_side") == 2, 2).otherwise(1)
    order = [edge, "_asof_at", "_asof_side"]
    w = Window.partitionBy(*on, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(marked, ignorenulls=True).over(w)
    if fill_first:
        ahead = Window.partitionBy(*on, RANGE).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        found = F.coalesce(found, F.first(marked, ignorenulls=True).over(ahead))
    got = both.withColumn(marked, F.when(F.col(RANGE).isNotNull(), found)).where("_asof_side = 1")
    return got.select(*left.columns, *[F.col(f"{marked}.{v}").alias(v) for v in values])


def last_known(rows: DataFrame, on: list[str], at: str, tie: str, known: Column, name: str, span: int = SPAN) -> DataFrame:
    """rows + `name`: the value known of the latest row of the key at or before the row's `at`, rows of the same `at` included
    (of these the one of the largest tie); null where none is known."""
    value = F.when(known.isNotNull() & F.col(at).isNotNull(), F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), known.alias("v")))
    rows = rows.withColumns({"_state": value, RANGE: range_of(F.col(at), span), "_real": F.lit(True)})
    before = carried(rows.groupBy(*on, RANGE).agg(F.max("_state").alias("_state")), on, "_state")
    before = before.withColumns({at: (F.col(RANGE) * span).cast(dict(rows.dtypes)[at]), "_real": F.lit(False)})
    w = Window.partitionBy(*on, RANGE).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(before, allowMissingColumns=True).withColumn("_state", F.max("_state").over(w))
    return both.where("_real").withColumn(name, F.when(F.col(at).isNotNull(), F.col("_state.v"))).drop("_state", "_real", RANGE)
