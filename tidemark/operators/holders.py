"""Holders, balances and LP positions from ledgers and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "token_address"
ZERO_ADDRESS = "0x" + "0" * 40


def holders_interval(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Addresses whose positive balance overlaps [start, end]; the zero address holds nothing."""
    overlap = (F.col("valid_from") <= F.to_date(F.lit(end))) & (F.col("valid_to") > F.to_date(F.lit(start)))
    return intervals.where(overlap & (F.col("balance_raw") > 0) & (F.col("address") != ZERO_ADDRESS)).select(TOKEN, "address").distinct()


def transfer_addresses(transfers: DataFrame) -> DataFrame:
    """Every address that sent or received: number of transactions, first and last block."""
    sides = transfers.select(TOKEN, "transaction_hash", "block_number", F.explode(F.array("from_address", "to_address")).alias("address"))
    return sides.groupBy(TOKEN, "address").agg(F.count_distinct("transaction_hash").alias("tx_count"), F.min("block_number").alias("first_seen_block"), F.max("block_number").alias("last_seen_block"))


def balance_at_block(ledger: DataFrame, block: int) -> DataFrame:
    return ledger.where(F.col("block_number") <= block).groupBy(TOKEN, "address").agg(F.max_by("balance_raw", "block_number").alias("balance_raw"))


def balance_changes(ledger: DataFrame, start: int, end: int) -> DataFrame:
    return ledger.where(F.col("block_number").between(start, end)).select(TOKEN, "address", "block_number", "balance_raw")


def balance_trajectory(ledger: DataFrame, start: int, end: int) -> DataFrame:
    """Start, end and peak balance and what moved in and out within (start, end]; a change at start is the start."""
    opening = balance_at_block(ledger, start).withColumn("block_number", F.lit(start).cast("long"))
    rows = opening.unionByName(balance_changes(ledger, start + 1, end))
    w = Window.partitionBy(TOKEN, "address").orderBy("block_number")
    before = F.lag("balance_raw").over(w)
    first = F.row_number().over(w) == 1
    opened = F.when(first & (F.col("block_number") > start), F.col("balance_raw")).otherwise(F.when(first, 0).otherwise(F.col("balance_raw") - before))
    rows = rows.withColumn("_delta", opened)
    out = rows.groupBy(TOKEN, "address").agg(
        F.coalesce(F.max(F.when(F.col("block_number") == start, F.col("balance_raw"))), F.lit(0)).alias("start_balance"), F.max_by("balance_raw", "block_number").alias("end_balance"), F.max("balance_raw").alias("_peak"),
        F.sum(F.greatest("_delta", F.lit(0))).alias("moved_in"), F.sum(F.greatest(-F.col("_delta"), F.lit(0))).alias("moved_out"), F.count_if(F.col("block_number") > start).alias("_n"),
    )
    return out.select(TOKEN, "address", "start_balance", "end_balance", F.greatest("start_balance", "_peak").alias("peak_balance"), "moved_in", "moved_out", F.when(F.col("_n") > 0, "event_rebuild").otherwise("two_point_snapshot").alias("source"))


def balance_source_cascade(addresses: DataFrame, historical: DataFrame, latest: DataFrame) -> DataFrame:
    """The historical balance, else the latest, else zero; and which it is."""
    h, late = historical.withColumnRenamed("balance_raw", "_h"), latest.withColumnRenamed("balance_raw", "_l")
    rows = addresses.join(h, [TOKEN, "address"], "left").join(late, [TOKEN, "address"], "left")
    source = F.when(F.col("_h").isNotNull(), "historical").when(F.col("_l").isNotNull(), "latest").otherwise("zero_fill")
    return rows.select(TOKEN, "address", F.coalesce("_h", "_l", F.lit(0)).alias("balance_raw"), source.alias("balance_source"))


def top_holders(balances: DataFrame, n: int = 20) -> DataFrame:
    """The n largest positive balances of each token."""
    w = Window.partitionBy(TOKEN).orderBy(F.desc("balance_raw"), "address")
    return balances.where("balance_raw > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shown_holders(holdings: DataFrame, n: int = 20) -> DataFrame:
    """The n largest holders that are shown of each token: positive, no pool, no balance that only fills a gap (zero_fill).
    holdings: token_address, address, address_type, source, end_balance."""
    kept = holdings.where((F.col("end_balance") > 0) & (F.col("address_type") != "pool") & (F.col("source") != "zero_fill"))
    w = Window.partitionBy(TOKEN).orderBy(F.desc("end_balance"), "address")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)  # a limit on ranks keeps n rows of a task


def holders_by_kind(holdings: DataFrame) -> DataFrame:
    """Per token and type of address, and per token (address_type null): addresses, those that hold something, what they hold, and
    how many balances come of each source."""
    return holdings.groupingSets([[TOKEN, "address_type"], [TOKEN]], TOKEN, "address_type").agg(
        F.count("*").alias("addresses"), F.count_if(F.col("end_balance") > 0).alias("holding"), F.sum(F.col("end_balance").cast("decimal(38,0)")).cast("decimal(38,0)").alias("balance"),
        F.count_if(F.col("source") == "event_rebuild").alias("rebuilt"), F.count_if(F.col("source") == "two_point_snapshot").alias("snapshots"), F.count_if(F.col("source") == "zero_fill").alias("filled"),
    )


def holder_summary(trajectory: DataFrame) -> DataFrame:
    return trajectory.groupBy(TOKEN).agg(
        F.count("*").alias("holders"), F.count_if(F.col("end_balance") > 0).alias("positive"), F.sum("end_balance").alias("total_balance"), F.sum(F.col("end_balance") - F.col("start_balance")).alias("net_change"),
        F.count_if(F.col("source") == "event_rebuild").alias("rebuilt"),
    )


def position_snapshot(lp: DataFrame, to_block: int | None = None) -> DataFrame:
    """Open positions: ticks of the first event, net liquidity and latest owner of each token id."""
    rows = lp if to_block is None else lp.where(F.col("block_number") <= to_block)
    first, last = F.struct("block_number", "log_index", "owner"), F.struct("block_number", "log_index", "owner")
    out = rows.groupBy(TOKEN, "token_id").agg(
        F.min_by(F.struct("pool_address", "tick_lower", "tick_upper"), first).alias("b"), F.sum("liquidity_delta").alias("liquidity"), F.max_by("owner", last).alias("owner")
    )
    return out.where("liquidity > 0").select(TOKEN, "token_id", "b.*", "liquidity", "owner")


def position_amounts(liquidity: Column, tick_lower: Column, tick_upper: Column, tick: Column) -> tuple[Column, Column]:
    """Token amounts of a position at a tick, in the three range cases."""
    root = lambda t: F.pow(F.lit(1.0001), t / 2)
    lo, hi, now = root(tick_lower), root(tick_upper), root(F.greatest(tick_lower, F.least(tick_upper, tick)))
    return liquidity * (1 / now - 1 / hi), liquidity * (now - lo)


def position_share(positions: DataFrame, ticks: DataFrame) -> DataFrame:
    """Share of the liquidity in range at each pool's tick; 0 out of range. ticks: pool_address, tick."""
    rows = positions.join(ticks, "pool_address")
    inside = (F.col("tick_lower") <= F.col("tick")) & (F.col("tick") < F.col("tick_upper"))
    # in range by pool, summed before the shuffle and joined back: a hot pool is no one task
    active = rows.where(inside).groupBy(TOKEN, "pool_address").agg(F.sum("liquidity").alias("_active"))
    rows = rows.join(active, [TOKEN, "pool_address"], "left")
    return rows.select(TOKEN, "token_id", "pool_address", "owner", "liquidity", inside.alias("in_range"), F.when(inside, F.round(F.try_divide(100 * F.col("liquidity"), F.col("_active")), 6)).otherwise(0.0).alias("share_pct"))


def lp_concentration(shares: DataFrame, top_n: int = 5) -> DataFrame:
    """Largest single share and largest sum of top_n shares over a token's pools."""
    w = Window.partitionBy(TOKEN, "pool_address").orderBy(F.desc("share_pct"), "token_id")
    pools = shares.withColumn("_r", F.row_number().over(w)).groupBy(TOKEN, "pool_address").agg(F.max("share_pct").alias("top"), F.sum(F.when(F.col("_r") <= top_n, F.col("share_pct"))).alias("top_n"))
    counts = shares.groupBy(TOKEN).agg(F.count("*").alias("total_lp_positions"), F.count_distinct("owner").alias("num_lps"))
    best = pools.groupBy(TOKEN).agg(F.max("top").alias("top_lp_share"), F.round(F.least(F.lit(100.0), F.max("top_n")), 4).alias("top_n_share"))
    return best.join(counts, TOKEN)


def portfolios(positions: DataFrame) -> DataFrame:
    """Each owner's positions as text, in order of token id, and their number."""
    out = positions.groupBy(TOKEN, "owner").agg(F.array_sort(F.collect_list("token_id")).alias("t"), F.sum("liquidity").alias("liquidity"))
    return out.select(TOKEN, "owner", F.size("t").cast("long").alias("n_positions"), F.array_join(F.col("t").cast("array<string>"), ",").alias("token_ids"), "liquidity")
