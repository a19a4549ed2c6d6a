"""The operators that are streams by nature, in Structured Streaming.

Resume points are the engine's own: every query takes a checkpoint folder. Rows later than the watermark are
dropped and counted by the engine (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_dedupe(events: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """One row of each key within the watermark. events need `ts`, a TIMESTAMP."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def stream_ohlcv(swaps: DataFrame, bucket: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Open, high, low, close, volume and trades per token, pool and tumbling window. swaps: ts, price, amount, block_number, log_index."""
    order = F.struct("block_number", "log_index")
    return (
        swaps.withWatermark("ts", delay).groupBy("token_address", "pool_address", F.window("ts", bucket))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"), F.count("*").alias("trades"))
        .select("token_address", "pool_address", F.col("window.start").alias("bucket"), "open", "high", "low", "close", "volume", "trades")
    )


def stream_rollup(swaps: DataFrame, span: str = "7 days", slide: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Volume over sliding spans. Unlike the batch view, spans end on the slide, not at the last event."""
    return swaps.withWatermark("ts", delay).groupBy("token_address", F.window("ts", span, slide)).agg(F.sum("amount").alias("volume")).select("token_address", F.col("window.end").alias("span_end"), "volume")


def stream_migration(removes: DataFrame, adds: DataFrame, blocks: int = 5, delay: str = "10 minutes", reach: str = "2 minutes") -> DataFrame:
    """Additions that follow a removal of the same actor within some blocks; the time range bounds the state."""
    r = removes.select("token_address", "actor", F.col("block_number").alias("remove_block"), F.col("ts").alias("remove_ts")).withWatermark("remove_ts", delay)
    a = adds.select(F.col("token_address").alias("add_token"), F.col("actor").alias("add_actor"), F.col("block_number").alias("add_block"), F.col("ts").alias("add_ts")).withWatermark("add_ts", delay)
    near = F.expr(f"token_address = add_token and actor = add_actor and add_block between remove_block and remove_block + {blocks} and add_ts between remove_ts and remove_ts + interval {reach}")
    return r.join(a, near, "inner").select("token_address", "actor", "remove_block", "add_block")


BALANCE = "token_address string, address string, start_balance long, end_balance long, peak_balance long, moved_in long, moved_out long"


def stream_balance_state(ledger: DataFrame) -> DataFrame:
    """Start, end, peak and what moved in and out of each address, kept as state. ledger rows: token_address, address, block_number, balance_raw.

    Rows of one trigger are taken in order of block; a row that comes after one of a later block is too late for the
    running state and is left out, so it never stands for the end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("block_number")
        start, end, peak, inn, out, last = state.get if state.exists else (int(rows.balance_raw.iloc[0]),) * 3 + (0, 0, -1)
        for block, balance in zip(rows.block_number.astype("int64"), rows.balance_raw.astype("int64"), strict=True):
            if block >= last:
                inn, out, end, peak, last = inn + max(0, balance - end), out + max(0, end - balance), int(balance), max(peak, int(balance)), int(block)
        state.update((start, end, peak, int(inn), int(out), last))
        yield pd.DataFrame([[*key, start, end, peak, inn, out]], columns=["token_address", "address", "start_balance", "end_balance", "peak_balance", "moved_in", "moved_out"])

    return ledger.groupBy("token_address", "address").applyInPandasWithState(step, BALANCE, "s long, e long, p long, i long, o long, b long", "update", GroupStateTimeout.NoTimeout)


def stream_sink(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there, to Parquet files, then stop."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
