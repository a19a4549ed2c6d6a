"""TVL from balances, reserves and events, and liquidity positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money as M
from tidemark.functions import scalars as S
from tidemark.operators import ordered
from tidemark.operators.asof import asof_join
from tidemark.operators.pools import unique_custody_pools
from tidemark.operators.prices import with_quote, with_token

TOKEN = "token_address"


def balances_latest(ledger: DataFrame, addresses: DataFrame) -> DataFrame:
    """The last balance of each of the addresses. addresses: address."""
    rows = ledger.join(addresses.select("address").distinct(), "address", "left_semi")
    return rows.groupBy(TOKEN, "address").agg(F.max_by("balance_raw", "block_number").alias("balance_raw"), F.max("block_number").alias("block_number"))


def balance_by_day(ledger: DataFrame, blocks_per_day: int = 7200) -> DataFrame:
    """The balance at the end of each day on which it changed."""
    day = F.floor(F.col("block_number") / blocks_per_day).cast("long")
    return ledger.groupBy(TOKEN, "address", day.alias("day")).agg(F.max_by("balance_raw", "block_number").alias("balance_raw"))


def tvl_snapshots(prices: DataFrame, ledger: DataFrame, pools: DataFrame) -> DataFrame:
    """Each price with the pool's balance as of its block (before the first balance: the first) -> tvl_usd. Pools that share
    their custody address have no balance of their own and are left out; so are prices and balances of 0 or less.

    prices: token_address, pool_address, block_number, price; ledger: token_address, pool_address, block_number, balance.
    """
    own = prices.join(unique_custody_pools(pools).select("pool_address"), "pool_address", "left_semi")
    rows = asof_join(own, ledger.select(TOKEN, "pool_address", F.col("block_number").alias("_b"), "balance"), [TOKEN, "pool_address"], "block_number", "_b", ["balance"], fill_first=True)
    rows = rows.where("price > 0 and balance > 0")
    return rows.withColumn("tvl_usd", F.col("price") * F.col("balance"))


def tvl_reserve_snapshots(prices: DataFrame, ledger: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per bucket and pool, as of the last block seen in the bucket: the price, the balance and their product.
    buckets: token_address, bucket, block_number."""
    pools = prices.select(TOKEN, "pool_address").distinct()
    grid = buckets.groupBy(TOKEN, "bucket").agg(F.max("block_number").alias("block_number")).join(pools, TOKEN)
    keys = [TOKEN, "pool_address"]
    rows = asof_join(grid, prices.where("price > 0").select(*keys, F.col("block_number").alias("_b"), F.struct("log_index", "price").alias("_p")), keys, "block_number", "_b", ["_p"])
    rows = rows.withColumn("price", F.col("_p.price")).drop("_p")
    rows = asof_join(rows, ledger.select(*keys, F.col("block_number").alias("_b"), "balance"), keys, "block_number", "_b", ["balance"])
    return rows.where("price is not null and balance > 0").withColumn("tvl_usd", F.col("price") * F.col("balance"))


def tvl_by_pool(states: DataFrame, target: str) -> DataFrame:
    """TVL in target units by family: v1 and v2 twice the target's reserve, v3 twice its balance, curve and balancer its
    balance times the coins; null where the target is not in the pair. states: + protocol, version, token0, token1, reserve0, reserve1, n_coins."""
    mine = F.when(F.col("token0") == target, F.col("reserve0")).when(F.col("token1") == target, F.col("reserve1"))
    times = F.when(F.col("protocol").isin("curve", "balancer"), F.col("n_coins")).otherwise(2)
    return states.withColumn("tvl", mine * times)


def tvl_source_choice(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Per token the rows of the first source that has any, with its name."""
    taken, parts = None, []
    for name, rows in sources:
        rows = rows.withColumn("tvl_source", F.lit(name))
        parts.append(rows if taken is None else rows.join(taken, TOKEN, "left_anti"))
        own = rows.select(TOKEN).distinct()
        taken = own if taken is None else taken.union(own).distinct()
    return reduce(lambda a, b: a.unionByName(b), parts)


def v3_token_ids(mints: DataFrame, moves: DataFrame) -> DataFrame:
    """token_id, pool_address of positions made in the transaction of a pool's mint. mints: pool logs; moves: manager's transfers."""
    m = mints.select(TOKEN, "transaction_hash", "pool_address").distinct()
    return m.join(moves.select(TOKEN, "transaction_hash", "token_id").distinct(), [TOKEN, "transaction_hash"]).select(TOKEN, "token_id", "pool_address").distinct()


def staged_liquidity(increases: DataFrame, decreases: DataFrame) -> DataFrame:
    """Open positions by token id: increases less decreases, above 0."""
    part = lambda rows, sign: rows.select(TOKEN, "token_id", (F.col("liquidity") * sign).alias("d"))
    return part(increases, 1).union(part(decreases, -1)).groupBy(TOKEN, "token_id").agg(F.sum("d").alias("liquidity")).where("liquidity > 0")


def v4_position_liquidity(changes: DataFrame) -> DataFrame:
    """Open positions by pool and salt, with the least ticks. changes: pool_address, salt, tick_lower, tick_upper, liquidity_delta."""
    return changes.groupBy(TOKEN, "pool_address", "salt").agg(F.sum("liquidity_delta").alias("liquidity"), F.min("tick_lower").alias("tick_lower"), F.min("tick_upper").alias("tick_upper")).where("liquidity > 0")


def latest_price(priced: DataFrame) -> DataFrame:
    """The price of each pool's last swap."""
    return priced.where("pool is not null and price is not null").groupBy(TOKEN, F.col("pool").alias("pool_address")).agg(F.max_by("price", F.struct("block_number", "log_index")).alias("price"), F.max("block_number").alias("block_number"))


def value_in_token1(amount0: Column, amount1: Column, price: Column) -> Column:
    return amount1 + amount0 * price


def value_share(positions: DataFrame, by: list[str]) -> DataFrame:
    """Each position's part of all value in its pool, in percent: summed by pool first, joined back."""
    total = positions.groupBy(*by).agg(F.sum(F.round("value", 6).cast("decimal(34,6)")).alias("_t"))
    return positions.join(total, by).withColumn("share_pct", F.round(100 * F.try_divide(F.col("value"), F.nullif(F.col("_t").cast("double"), F.lit(0.0))), 6)).drop("_t")


def lp_token_holders(ledger: DataFrame, to_block: int | None = None) -> DataFrame:
    """Holders of an LP token and their part of the supply, the sum of positive balances."""
    rows = ledger if to_block is None else ledger.where(F.col("block_number") <= to_block)
    last = rows.groupBy(TOKEN, "address").agg(F.max_by("balance_raw", "block_number").alias("balance_raw")).where("balance_raw > 0")
    supply = last.groupBy(TOKEN).agg(F.sum("balance_raw").alias("_s"))
    return last.join(supply, TOKEN).select(TOKEN, F.col("address").alias("owner"), "balance_raw", F.round(100 * F.try_divide(F.col("balance_raw").cast("double"), F.col("_s").cast("double")), 6).alias("share_pct"))


def position_summary(positions: DataFrame, top: int = 5) -> DataFrame:
    """Per token: positions, owners and the largest shares. positions: token_address, owner, position, share_pct."""
    order = Window.partitionBy(TOKEN).orderBy(F.desc("share_pct"), "position", "owner")
    ranked = positions.withColumn("_r", F.row_number().over(order))
    best = F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", F.col("owner").alias("o")))))
    return ranked.groupBy(TOKEN).agg(F.count("*").alias("positions"), F.count_distinct("owner").alias("owners"), F.array_join(F.transform(best, lambda x: x["o"]), ",").alias("top_owners"))


def snapshot_budget(addresses: DataFrame, top_k: int) -> DataFrame:
    """Addresses in the order in which balances are worth reading: pools, then by transactions; the first top_k of each token."""
    order = Window.partitionBy(TOKEN).orderBy(F.desc("is_pool"), F.desc("tx_count"), "address")
    return addresses.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def address_roles(*signals: DataFrame) -> DataFrame:
    """Per address and protocol: whether it provides liquidity and whether it swaps, from any of the signals (token_address, address, protocol, lp, swap)."""
    rows = reduce(lambda a, b: a.unionByName(b), signals)
    return rows.groupBy(TOKEN, "address", "protocol").agg(F.bool_or("lp").alias("lp"), F.bool_or("swap").alias("swap"))


def tvl_accumulate(changes: DataFrame) -> DataFrame:
    """Running reserve of each pool by event order, never under 0; a sync sets it. changes: kind ('sync' or 'change'), amount."""
    sync = F.col("kind") == "sync"
    steps = {"reserve": (F.when(sync, F.col("amount")), F.when(~sync, F.col("amount")))}
    return ordered.clamped(changes, [TOKEN, "pool_address"], ["block_number", "log_index"], steps)


#: What both families give of an event.
TVL_EVENTS = ["token_address", "pool_address", "block_number", "log_index", "block_timestamp", "protocol", "version", "event_type", "source_event"]


def _of_verified_pools(events: DataFrame, pools: DataFrame, versions: list[str], tokens: DataFrame | None, quotes: DataFrame | None, target: str, decimals: int) -> DataFrame:
    """Events of verified pools of these versions whose pair is the pool's, with _target, _decimals, _first (the target is the
    pool's token0), quote and amounts as DECIMAL(38,0), 0 where they are not given."""
    own = pools.where("verified").where(F.col("version").isin(versions)).select("pool_address", "protocol", "version", F.col("token0").alias("_p0"), F.col("token1").alias("_p1"))
    rows = events.where(F.col("event_type").isin("SWAP", "LIQUIDITY_ADD", "LIQUIDITY_REMOVE", "SYNC")).drop("protocol", "version").join(own, "pool_address")
    pair = [F.col(c) if c in events.columns else F.lit(None).cast("string") for c in ("token0_address", "token1_address")]
    rows = rows.where(S.same_pair(*pair, F.col("_p0"), F.col("_p1")))
    rows = with_token(rows, tokens, target, decimals).withColumn("_first", F.col("_p0") == F.col("_target"))
    rows = with_quote(rows.withColumn("quote", F.when(F.col("_first"), F.col("_p1")).otherwise(F.col("_p0"))), quotes)
    amount = lambda c: F.coalesce(M.raw(F.col(c).cast("string")), F.lit(0).cast("decimal(38,0)")) if c in rows.columns else F.lit(0).cast("decimal(38,0)")
    return rows.withColumns({"_a0": amount("token0_amount"), "_a1": amount("token1_amount"), "_dl": amount("liquidity_delta"), "_usd": F.col("amount_usd") if "amount_usd" in rows.columns else F.lit(None).cast("double")})


def tvl_events_v2(events: DataFrame, pools: DataFrame, tokens: DataFrame | None = None, quotes: DataFrame | None = None, target: str = "TGT", decimals: int = 18) -> DataFrame:
    """Reserves of pools of two reserves after each event: a sync sets both, a swap changes them as the pool sees it, additions add
    and removals take away; neither falls under 0. With the TVL in target units, twice the target's reserve, the price of
    the target by reserves, and of a swap by its stated USD.

    A pool's events are composed by ranges of blocks, so a hot pool is many tasks. Amounts that are not given are 0.
    """
    rows = _of_verified_pools(events, pools, ["v2"], tokens, quotes, target, decimals)
    sync, kind = F.coalesce(F.col("source_event") == "Sync", F.lit(False)), F.col("event_type")
    change = lambda a: F.when(kind == "SWAP", a).when(kind == "LIQUIDITY_ADD", F.abs(a)).when(kind == "LIQUIDITY_REMOVE", -F.abs(a))
    steps = {f"reserve{i}": (F.when(sync, F.col(f"_a{i}")), F.when(~sync, change(F.col(f"_a{i}")))) for i in (0, 1)}
    rows = ordered.clamped(rows, [TOKEN, "pool_address"], ["block_number", "log_index"], steps)
    mine, other = F.when(F.col("_first"), F.col("reserve0")).otherwise(F.col("reserve1")), F.when(F.col("_first"), F.col("reserve1")).otherwise(F.col("reserve0"))
    moved = F.abs(F.when(F.col("_first"), F.col("_a0")).otherwise(F.col("_a1"))).cast("double") / F.pow(F.lit(10.0), "_decimals")
    price = M.v2_price(mine.cast("string"), other.cast("string"), F.col("_decimals"), F.col("_quote_decimals"))
    usd = F.when((kind == "SWAP") & ~sync & (F.col("_usd") > 0) & (moved > 0), F.col("_usd") / moved)
    return rows.select(*TVL_EVENTS, "reserve0", "reserve1", (mine * 2).cast("decimal(38,0)").alias("tvl_in_token"), "quote", price.alias("price"), usd.alias("price_usd"))


def tvl_events_v3(events: DataFrame, pools: DataFrame, tokens: DataFrame | None = None, quotes: DataFrame | None = None, target: str = "TGT", decimals: int = 18) -> DataFrame:
    """Running liquidity of concentrated pools after each event, never under 0, and what the event moved of the target: a swap's
    own side once, that of an addition or removal twice. With the price of a swap: quote over target, and USD over target.
    """
    rows = _of_verified_pools(events, pools, ["v3", "v4"], tokens, quotes, target, decimals)
    kind = F.col("event_type")
    steps = {"liquidity": (F.lit(None), F.when(kind != "SWAP", F.col("_dl")))}
    rows = ordered.clamped(rows, [TOKEN, "pool_address"], ["block_number", "log_index"], steps)
    a0, a1 = F.abs(F.col("_a0")), F.abs(F.col("_a1"))
    t0, t1 = [F.col(c) if c in events.columns else F.lit(None).cast("string") for c in ("token0_address", "token1_address")]
    side = M.target_side(t0, t1, F.col("_p0"), F.col("_p1"), a0.cast("string"), a1.cast("string"), F.col("source_event"), F.col("_target"), F.col("_decimals"))
    rows = rows.withColumn("_side", side)
    first = F.when((kind == "SWAP") & F.col("_side").isNotNull(), F.col("_side") == 0).otherwise(F.col("_first"))
    moved, against = F.when(first, a0).otherwise(a1), F.when(first, a1).otherwise(a0)
    whole, quoted = moved.cast("double") / F.pow(F.lit(10.0), "_decimals"), against.cast("double") / F.pow(F.lit(10.0), "_quote_decimals")
    traded = (kind == "SWAP") & F.col("_side").isNotNull() & (a0 > 0) & (a1 > 0)
    return rows.select(
        *TVL_EVENTS, "liquidity", a0.alias("token0_amount"), a1.alias("token1_amount"), F.when(kind == "SWAP", moved).otherwise(moved * 2).cast("decimal(38,0)").alias("tvl_in_token"),
        F.when(traded, F.col("quote")).alias("quote"), F.when(traded, quoted / whole).alias("price"), F.when(traded & (F.col("_usd") > 0), F.col("_usd") / whole).alias("price_usd"),
    )


def span_tvl(tvl: DataFrame, days: int, bucket: int) -> DataFrame:
    """Each pool's last TVL in wider buckets, of the last days before the token's last observation."""
    end = tvl.groupBy(TOKEN).agg(F.max("block_timestamp").alias("_end"))
    rows = tvl.join(end, TOKEN).where(F.col("block_timestamp") > F.col("_end") - days * 86_400)
    at = (F.floor(F.col("block_timestamp") / bucket) * bucket).cast("long")
    return rows.groupBy(TOKEN, at.alias("bucket"), "pool_address").agg(F.max_by("tvl_raw", F.struct("block_number", "log_index")).alias("tvl_raw"))


def rank_token_candidates(pairs: DataFrame, symbol: str, n: int) -> DataFrame:
    """The n best tokens for a symbol: each by its pair of most liquidity, the exact symbol first. pairs: token, pair, liquidity."""
    best = pairs.groupBy("token").agg(F.max_by("pair", F.struct("liquidity", "pair")).alias("pair"), F.max("liquidity").alias("liquidity"))
    exact = F.upper("token") == symbol.upper()
    order = Window.orderBy(exact.desc(), F.desc("liquidity"), "token")  # one row for each token that matches a search
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def run_index(holders: DataFrame, pools: DataFrame, risk: DataFrame) -> DataFrame:
    """A row for each token: holders, pools, score and level of risk. Each argument: token_address and its columns."""
    return holders.join(pools, TOKEN, "full_outer").join(risk, TOKEN, "full_outer")


def behavior_flags(contracts: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """contract, flags: the names of the four-byte selectors that its bytecode holds, and whether it is a proxy: a slot of a
    known implementation is set. contracts: contract, bytecode, implementation_slot."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("bytecode"), F.lit(code.lower())), F.lit(name)) for name, code in sorted(selectors.items())]))
    slot = F.regexp_replace(F.coalesce("implementation_slot", F.lit("")), "^0x0*", "")
    return contracts.select("contract", found.alias("flags"), (slot != "").alias("is_proxy"))


def creation_logs(logs: DataFrame, target: str) -> DataFrame:
    """Pools whose creation names the target: topics 1 and 2 hold its tokens. logs: topic1, topic2, pool_address, block_number."""
    token = lambda t: F.concat(F.lit("0x"), F.right(F.lower(t), F.lit(40)))
    rows = logs.select(F.lower("pool_address").alias("pool_address"), token("topic1").alias("token0"), token("topic2").alias("token1"), "block_number")
    rows = rows.where((F.col("token0") == target.lower()) | (F.col("token1") == target.lower()))
    return rows.groupBy("pool_address", "token0", "token1").agg(F.min("block_number").alias("block_number"))


def pool_candidates(mapped: DataFrame, deployments: DataFrame, target: str) -> DataFrame:
    """Candidates of known deployments with their counter token. mapped: pool, adapter, version, hints (tokens seen). A vault's
    id of 32 bytes stands for its first 20; v4 pools need an id of 32 bytes; the target must be among the hints."""
    rows = mapped.join(deployments, ["adapter", "version"]).where(F.array_contains("hints", target))
    long = F.length("pool") == 66
    rows = rows.where((F.col("version") != "v4") | long)
    pool = F.when((F.col("adapter") == "balancer") & long, F.substring("pool", 1, 42)).otherwise(F.col("pool"))
    return rows.select(pool.alias("pool_address"), "adapter", "version", "factory", F.try_element_at(F.array_sort(F.filter("hints", lambda x: x != target)), F.lit(1)).alias("counter"))
