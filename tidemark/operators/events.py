"""Canonical events: normalising raw logs, routing, combining, filtering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

BASE = ["token_address", "block_number", "log_index", "block_timestamp", "transaction_hash", "event_type"]


def normalize_dex_trades(raw: DataFrame) -> DataFrame:
    """Aggregated trades: what was sold is side 0, what was bought side 1, whatever the pool's order; the actor is the taker, else the sender."""
    return raw.select(
        "token_address", "block_number", F.col("evt_index").alias("log_index"), F.unix_timestamp("block_time").alias("block_timestamp"), F.lower("tx_hash").alias("transaction_hash"), F.lit("SWAP").alias("event_type"),
        S.normalize_address(F.col("project_contract_address")).alias("pool_address"), S.normalize_address(F.coalesce("taker", "tx_from")).alias("actor"), S.normalize_address(F.col("token_sold_address")).alias("token0_address"),
        S.normalize_address(F.col("token_bought_address")).alias("token1_address"), F.col("token_sold_amount_raw").alias("token0_amount"), F.col("token_bought_amount_raw").alias("token1_amount"), "amount_usd",
    )


#: What every normaliser gives beside BASE.
REST = ["protocol", "version", "pool_address", "actor", "recipient", "token0_amount", "token1_amount", "liquidity_delta", "nft_token_id", "source_event"]
AMOUNT = "decimal(38,0)"


def _raw(name: str) -> Column:
    return F.col(name).try_cast(AMOUNT)


def _events(raw: DataFrame, kinds: dict[str, str], protocol: str, version: str | Column, **columns: Column) -> DataFrame:
    """The logs whose event_name is a key of kinds, as canonical events; an event_type that is given holds, what else is not given is null."""
    types = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    rows = raw.where(F.col("event_name").isin(list(kinds)))
    given = {"protocol": F.lit(protocol), "version": F.lit(version) if isinstance(version, str) else version, "pool_address": F.col("pool_address"), "source_event": F.col("event_name")} | columns
    empty = {"token0_amount": AMOUNT, "token1_amount": AMOUNT, "liquidity_delta": AMOUNT, "nft_token_id": "long"}
    base = [given.get(c, F.element_at(types, F.col("event_name"))).alias(c) if c == "event_type" else F.col(c) for c in BASE]
    return rows.select(*base, *[given.get(c, F.lit(None)).cast(empty.get(c, "string")).alias(c) for c in REST])


def normalize_v1(raw: DataFrame) -> DataFrame:
    """Exchange logs: a purchase names the side that is not ether; the other is 0. raw: event_name, sender, amount0 (ether), amount1 (token)."""
    kind, zero = F.col("event_name"), F.lit(0).cast(AMOUNT)
    kinds = {"EthPurchase": "SWAP", "TokenPurchase": "SWAP", "AddLiquidity": "LIQUIDITY_ADD", "RemoveLiquidity": "LIQUIDITY_REMOVE"}
    a0 = F.when(kind == "EthPurchase", zero).when(kind == "TokenPurchase", F.abs(_raw("amount1"))).otherwise(F.abs(_raw("amount0")))
    a1 = F.when(kind == "TokenPurchase", zero).otherwise(F.abs(_raw("amount1")))
    return _events(raw, kinds, "uniswap", "v1", actor=F.col("sender"), recipient=F.col("sender"), token0_amount=a0, token1_amount=a1)


def normalize_v2(raw: DataFrame) -> DataFrame:
    """Swap amounts as the pool sees them: what came in, else minus what went out. Mint, Burn by their amounts."""
    swap = F.col("event_name") == "Swap"
    signed = lambda k: F.when(_raw(f"amount{k}_in") > 0, _raw(f"amount{k}_in")).otherwise(-_raw(f"amount{k}_out"))
    amount = lambda k: F.when(swap, signed(k)).otherwise(F.abs(_raw(f"amount{k}")))
    to = F.when(F.col("event_name") == "Mint", F.col("sender")).otherwise(F.col("recipient"))
    return _events(raw, {"Swap": "SWAP", "Mint": "LIQUIDITY_ADD", "Burn": "LIQUIDITY_REMOVE"}, "uniswap", "v2", actor=F.col("sender"), recipient=to, token0_amount=amount(0), token1_amount=amount(1))


def normalize_v2_sync(raw: DataFrame) -> DataFrame:
    """Both reserves after an event, as events of their own."""
    return _events(raw, {"Sync": "SYNC"}, "uniswap", "v2", token0_amount=F.abs(_raw("amount0")), token1_amount=F.abs(_raw("amount1")))


def normalize_v3_pool(raw: DataFrame) -> DataFrame:
    """Amounts as absolute values; a Burn's liquidity is taken off; an owner's own Burn is its recipient too."""
    kind = F.col("event_name")
    kinds = {"Swap": "SWAP", "Mint": "LIQUIDITY_ADD", "Burn": "LIQUIDITY_REMOVE", "Collect": "COLLECT_FEES"}
    delta = F.when(kind == "Mint", _raw("liquidity")).when(kind == "Burn", -_raw("liquidity"))
    to = F.when(kind == "Burn", F.col("sender")).otherwise(F.col("recipient"))
    return _events(raw, kinds, "uniswap", "v3", actor=F.col("sender"), recipient=to, token0_amount=F.abs(_raw("amount0")), token1_amount=F.abs(_raw("amount1")), liquidity_delta=delta)


def normalize_v3_position(raw: DataFrame, position_pools: DataFrame) -> DataFrame:
    """Position manager logs, with the pool of their token id (null if unknown). position_pools: token_id, pool_address."""
    kind, move = F.col("event_name"), F.col("event_name") == "Transfer"
    rows = raw.drop("pool_address").join(position_pools.select("token_id", "pool_address"), "token_id", "left")
    kinds = {"Transfer": "POSITION_TRANSFER", "IncreaseLiquidity": "LIQUIDITY_ADD", "DecreaseLiquidity": "LIQUIDITY_REMOVE", "Collect": "COLLECT_FEES"}
    delta = F.when(kind == "IncreaseLiquidity", _raw("liquidity")).when(kind == "DecreaseLiquidity", -_raw("liquidity"))
    amount = lambda k: F.when(~move, F.abs(_raw(f"amount{k}")))
    to = F.when(move | (kind == "Collect"), F.col("recipient"))
    return _events(rows, kinds, "uniswap", "v3", actor=F.when(move, F.col("sender")), recipient=to, token0_amount=amount(0), token1_amount=amount(1), liquidity_delta=delta, nft_token_id=F.col("token_id"))


def normalize_v4_pool(raw: DataFrame, pools: DataFrame) -> DataFrame:
    """Manager logs of known pools: swaps as absolute amounts; a liquidity delta of 0 or more adds, its amounts are unknown."""
    kind = F.col("event_name")
    rows = raw.join(pools.where("version = 'v4'").select("pool_address"), "pool_address", "left_semi")
    adds = F.when(kind == "Swap", "Swap").when(_raw("delta") >= 0, "Add").otherwise("Remove")
    named = rows.withColumns({"event_name": adds, "_source": kind})
    swap = F.col("event_name") == "Swap"
    amount = lambda k: F.when(swap, F.abs(_raw(f"amount{k}")))
    return _events(
        named, {"Swap": "SWAP", "Add": "LIQUIDITY_ADD", "Remove": "LIQUIDITY_REMOVE"}, "uniswap", "v4", actor=F.col("sender"), recipient=F.when(~swap, F.col("sender")), token0_amount=amount(0), token1_amount=amount(1),
        liquidity_delta=F.when(~swap, _raw("delta")), nft_token_id=F.when(~swap, F.col("token_id")), source_event=F.col("_source"),
    )


def normalize_curve(raw: DataFrame) -> DataFrame:
    """Exchanges, additions and the three kinds of removal; a removal in one coin has the other side 0."""
    kinds = {"TokenExchange": "SWAP", "TokenExchangeUnderlying": "SWAP", "AddLiquidity": "LIQUIDITY_ADD", "RemoveLiquidity": "LIQUIDITY_REMOVE", "RemoveLiquidityImbalance": "LIQUIDITY_REMOVE", "RemoveLiquidityOne": "LIQUIDITY_REMOVE"}
    one = F.col("event_name") == "RemoveLiquidityOne"
    other = F.when(one, F.lit(0).cast(AMOUNT)).otherwise(F.abs(_raw("amount1")))
    return _events(raw, kinds, "curve", "v1", actor=F.col("sender"), recipient=F.col("sender"), token0_amount=F.abs(_raw("amount0")), token1_amount=other)


def normalize_balancer(raw: DataFrame) -> DataFrame:
    """Vault logs: a balance change adds if any token's balance grew; its amount is the sum of absolute changes. deltas: array of numbers."""
    swap = F.col("event_name") == "Swap"
    kind = F.when(swap, "SWAP").when(F.exists("deltas", lambda d: d > 0), "LIQUIDITY_ADD").otherwise("LIQUIDITY_REMOVE")
    total = F.aggregate("deltas", F.lit(0).cast(AMOUNT), lambda a, d: F.when(d < 0, a - d).otherwise(a + d).cast(AMOUNT))
    a0, a1 = F.when(swap, F.abs(_raw("amount0"))).otherwise(total), F.when(swap, F.abs(_raw("amount1"))).otherwise(F.lit(0).cast(AMOUNT))
    return _events(raw, {"Swap": "SWAP", "PoolBalanceChanged": ""}, "balancer", "v2", event_type=kind, actor=F.col("sender"), recipient=F.col("sender"), token0_amount=a0, token1_amount=a1)


def normalize_transfers(raw: DataFrame) -> DataFrame:
    return _events(raw, {"Transfer": "TOKEN_TRANSFER"}, "erc20", "", actor=F.col("sender"), recipient=F.col("recipient"), token0_amount=F.abs(_raw("amount0")))


def normalize_liquidity(rows: DataFrame) -> DataFrame:
    """Rows of liquidity templates: what is missing of event_type follows from the sign of a v4 delta, of quantification_status
    from whether amounts are there; event_count is 1 at least. rows: version, event_type, token0_amount, token1_amount,
    liquidity_delta, event_count, quantification_status; amounts and delta as strings."""
    delta = F.coalesce(_raw("liquidity_delta"), F.lit(0).cast(AMOUNT))
    there = F.col("token0_amount").isNotNull() | F.col("token1_amount").isNotNull()
    v4 = F.lower("version").isin("v4", "4")
    status = F.coalesce("quantification_status", F.when(there, "quantified").when(v4 & (delta != 0), "liquidity_delta_only").otherwise("unmapped"))
    kind = F.coalesce(F.nullif("event_type", F.lit("")), F.when(v4, F.when(delta >= 0, "LIQUIDITY_ADD").otherwise("LIQUIDITY_REMOVE")))
    return rows.withColumns({"event_type": kind, "liquidity_delta": delta, "amounts_available": there, "quantification_status": status, "event_count": F.greatest(F.lit(1), F.coalesce("event_count", F.lit(1)))})


def resolve_position_pool(keys: DataFrame, pools: DataFrame) -> DataFrame:
    """token_id, pool_address by the pair and fee; null where no pool has them. keys: token_id, token0, token1, fee."""
    by = pools.groupBy("token0", "token1", "fee").agg(F.min_by("pool_address", "ordinal").alias("pool_address"))
    return keys.select("token_id", "token0", "token1", "fee").distinct().join(by, ["token0", "token1", "fee"], "left").select("token_id", "pool_address")


def route_events(events: DataFrame) -> DataFrame:
    """events + the canonical table each belongs to."""
    kind = F.col("event_type")
    return events.withColumn("table_name", F.when(kind == "SWAP", "swaps").when(kind.startswith("LIQUIDITY"), "liquidity_events").when(kind == "TOKEN_TRANSFER", "transfers").otherwise("position_events"))


def combine_events(*tables: DataFrame) -> DataFrame:
    """The common columns of all tables; order is left to the sink."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(*BASE) for t in tables])


def block_window(events: DataFrame, start: int, end: int) -> DataFrame:
    return events.where(F.col("block_number").between(start, end))


def attach_block_time(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Times by block number. blocks: block_number, block_timestamp."""
    return events.drop("block_timestamp").join(blocks.select("block_number", "block_timestamp"), "block_number", "left")
