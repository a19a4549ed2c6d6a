"""Positions of all families at a block: holders of LP tokens, position tokens, and the manager's salts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.holders import ZERO_ADDRESS

TOKEN = "token_address"
# How a family's positions are found, and how far that is trusted (for v4: in range, out of range).
METHODS = {
    "v1": ("v1_balanceof_at_to_block", 0.9), "v2": ("v2_balanceof_at_to_block", 0.95), "curve": ("curve_balanceof_at_to_block", 0.9), "balancer": ("balancer_bpt_balanceof_at_to_block", 0.9),
    "v3": ("v3_tick_amounts_at_to_block", 0.95),
}
V4_TRUST = (0.95, 0.9)
COLUMNS = [TOKEN, "pool_address", "owner", "position", "liquidity", "share_pct", "method", "confidence"]
AMOUNT = "decimal(38,0)"


def lp_candidates(pools: DataFrame, events: DataFrame, transfers: DataFrame) -> DataFrame:
    """Who may hold a pool's LP token: actors and recipients of the pool's events, and both sides of the LP token's transfers;
    neither the zero address nor the pool. pools: pool_address, lp_token; transfers: token_address, from_address, to_address."""
    own = pools.select("pool_address", "lp_token").distinct()
    seen = events.select("pool_address", F.explode(F.array("actor", "recipient")).alias("owner")).distinct().join(own, "pool_address")
    moved = transfers.select(F.col(TOKEN).alias("lp_token"), F.explode(F.array("from_address", "to_address")).alias("owner")).distinct().join(own, "lp_token")
    rows = seen.select("pool_address", "lp_token", "owner").union(moved.select("pool_address", "lp_token", "owner"))
    return rows.where(F.col("owner").isNotNull() & (F.col("owner") != ZERO_ADDRESS) & (F.col("owner") != F.col("pool_address"))).distinct()


def lp_token_positions(pools: DataFrame, events: DataFrame, transfers: DataFrame, ledger: DataFrame, supply: DataFrame, to_block: int) -> DataFrame:
    """Candidates with their balance of the pool's LP token and its part of the supply, both as of the block, above 0.

    pools: token_address, pool_address, lp_token, family (v1, v2, curve, balancer), verified; ledger: lp_token, address,
    block_number, balance_raw; supply: lp_token, block_number, supply_raw. Pools without a supply have no positions.
    """
    of = pools.where(F.col("verified") & F.col("family").isin("v1", "v2", "curve", "balancer"))
    last = lambda rows, keys, value: rows.where(F.col("block_number") <= to_block).groupBy(*keys).agg(F.max_by(F.col(value).try_cast(AMOUNT), "block_number").alias(value))
    held = last(ledger.withColumnRenamed("address", "owner"), ["lp_token", "owner"], "balance_raw").where("balance_raw > 0")
    total = last(supply, ["lp_token"], "supply_raw").where("supply_raw > 0")
    rows = held.join(lp_candidates(of, events, transfers), ["lp_token", "owner"]).join(total, "lp_token").join(of.select(TOKEN, "pool_address", "family").distinct(), "pool_address")
    share = F.round(100 * F.col("balance_raw").cast("double") / F.col("supply_raw").cast("double"), 6)
    known = {k: F.create_map(*[F.lit(x) for f in ("v1", "v2", "curve", "balancer") for x in (f, METHODS[f][k])]) for k in (0, 1)}
    return rows.select(
        TOKEN, "pool_address", "owner", F.concat(F.lit("lp:"), F.col("lp_token")).alias("position"), F.col("balance_raw").alias("liquidity"), share.alias("share_pct"),
        F.try_element_at(known[0], F.col("family")).alias("method"), F.try_element_at(known[1], F.col("family")).alias("confidence"),
    )


def salt_positions(changes: DataFrame, owners: DataFrame, ticks: DataFrame, to_block: int) -> DataFrame:
    """Open v4 positions with the owner of the token that the salt stands for, and their part of their pool's liquidity in range.

    changes: token_address, pool_address, block_number, tick_lower, tick_upper, liquidity_delta, salt_id (the salt as a number,
    as text); owners: token_id (text), block_number, log_index, owner; ticks: pool_address, tick. Positions whose owner is unknown or the
    zero address are left out, but their liquidity counts in the pool.
    """
    rows = changes.where(F.col("block_number") <= to_block).groupBy(TOKEN, "pool_address", "salt_id")
    rows = rows.agg(F.sum(F.col("liquidity_delta").cast(AMOUNT)).cast(AMOUNT).alias("liquidity"), F.min("tick_lower").alias("tick_lower"), F.min("tick_upper").alias("tick_upper")).where("liquidity > 0")
    rows = rows.join(ticks.select("pool_address", "tick"), "pool_address", "left")
    inside = F.coalesce((F.col("tick_lower") <= F.col("tick")) & (F.col("tick") < F.col("tick_upper")), F.lit(False))
    rows = rows.withColumn("_in", inside)
    active = rows.where("_in").groupBy(TOKEN, "pool_address").agg(F.sum("liquidity").cast(AMOUNT).alias("_active"))
    last = owners.where(F.col("block_number") <= to_block).groupBy(F.col("token_id").alias("salt_id")).agg(F.max_by("owner", F.struct("block_number", "log_index")).alias("owner"))
    rows = rows.join(active, [TOKEN, "pool_address"], "left").join(last, "salt_id").where(F.col("owner").isNotNull() & (F.col("owner") != ZERO_ADDRESS))
    share = F.when(F.col("_in"), F.round(100 * F.col("liquidity").cast("double") / F.col("_active").cast("double"), 6)).otherwise(0.0)
    return rows.select(
        TOKEN, "pool_address", "owner", F.concat(F.lit("v4:"), "salt_id").alias("position"), "liquidity", share.alias("share_pct"), F.lit("v4_salt_owner_at_to_block").alias("method"),
        F.when(F.col("_in"), V4_TRUST[0]).otherwise(V4_TRUST[1]).alias("confidence"),
    )


def token_positions(shares: DataFrame) -> DataFrame:
    """Position tokens (token_id, pool_address, owner, liquidity, share_pct) in the common form."""
    return shares.select(
        TOKEN, "pool_address", "owner", F.concat(F.lit("v3:"), F.col("token_id").cast("string")).alias("position"), F.col("liquidity").cast(AMOUNT).alias("liquidity"), F.col("share_pct").cast("double").alias("share_pct"),
        F.lit(METHODS["v3"][0]).alias("method"), F.lit(METHODS["v3"][1]).alias("confidence"),
    )


def all_positions(*families: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """All families; only of the owners in `allowed` (owner) where it is given, so none where it is empty."""
    rows = reduce(lambda a, b: a.unionByName(b), [f.select(*COLUMNS) for f in families])
    return rows if allowed is None else rows.join(allowed.select("owner").distinct(), "owner", "left_semi").select(*COLUMNS)
