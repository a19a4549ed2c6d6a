"""Balances of addresses as keyed state that late blocks correct."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

AMOUNT = "decimal(38,0)"
TRAJECTORY = f"token_address string, address string, start_balance {AMOUNT}, end_balance {AMOUNT}, peak_balance {AMOUNT}, moved_in {AMOUNT}, moved_out {AMOUNT}"
#: What is known of an address: its opening, and the running figures up to its last block.
RUNNING = f"open_block long, opened {AMOUNT}, last_block long, ends {AMOUNT}, peak {AMOUNT}, moved_in {AMOUNT}, moved_out {AMOUNT}"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trajectory(StatefulProcessor):
    """Per address: a map of the blocks in the window to their balances, and the running figures.

    A block after all others adds to the figures at once. A late one, or a late opening, is put into the map and the figures
    are taken from it anew, so that any order of arrival ends with what the batch operator gives.
    """

    def __init__(self, start: int, end: int, keep_ms: int | None):
        self.start, self.end, self.keep_ms = start, end, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", f"balance {AMOUNT}", self.keep_ms)
        self.figures = handle.getValueState("figures", RUNNING, self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        zero = Decimal(0)
        known = self.figures.get() if self.figures.exists() else None
        opened_at, opened, last, ends, peak, inn, out = known or (None, None, None, None, None, zero, zero)
        late = False
        for block, balance in sorted((r.block_number, r.balance_raw) for r in rows if r.block_number is not None and r.balance_raw is not None):
            if block <= self.start:
                if opened_at is None or block >= opened_at:
                    opened_at, opened = block, balance
                    late = late or last is not None
                continue
            if block > self.end:
                continue
            self.blocks.updateValue((block,), (balance,))
            if last is not None and block <= last:
                late = True
                continue
            before = ends if last is not None else opened if opened is not None else zero
            inn, out = inn + max(zero, balance - before), out + max(zero, before - balance)
            last, ends, peak = block, balance, balance if last is None else max(peak, balance)
        if late:
            before, inn, out, peak = opened if opened is not None else zero, zero, zero, None
            for block, balance in sorted((k[0], v[0]) for k, v in self.blocks.iterator()):
                inn, out = inn + max(zero, balance - before), out + max(zero, before - balance)
                before = ends = balance
                last, peak = block, balance if peak is None else max(peak, balance)
        if opened is None and last is None:
            return
        self.figures.update((opened_at, opened, last, ends, peak, inn, out))
        begins = opened if opened is not None else zero
        yield Row(token_address=key[0], address=key[1], start_balance=begins, end_balance=begins if last is None else ends, peak_balance=begins if last is None else max(begins, peak), moved_in=inn, moved_out=out)

    def close(self) -> None:
        pass


def stream_balance_trajectory(ledger: DataFrame, start: int, end: int = (1 << 62), keep_ms: int | None = None) -> DataFrame:
    """Start, end and peak balance and what moved in and out within (start, end], of each address, in whatever order its blocks come.

    ledger: token_address, address, block_number, balance_raw (a number or a string of digits; beyond 38 digits it is left
    out). Update mode: a row each time an address is heard of, the last one holds. keep_ms: state that nothing has touched
    for so long goes; without it nothing does. The session needs RocksDB as its state store provider.
    """
    rows = ledger.select("token_address", "address", F.col("block_number").cast("long").alias("block_number"), F.col("balance_raw").try_cast(AMOUNT).alias("balance_raw"))
    mode = "None" if keep_ms is None else "ProcessingTime"
    return rows.groupBy("token_address", "address").transformWithState(Trajectory(start, end, keep_ms), TRAJECTORY, "Update", mode)
