"""Pools: discovery, identity, custody, verification, coverage, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "token_address"


def discover_pools(swaps: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Venues that traded a token, within the blocks if given, with trades, first and last block, most traded first."""
    if start is not None:
        swaps = swaps.where(F.col("block_number").between(start, end))
    seen = swaps.groupBy(TOKEN, "pool_address").agg(F.count("*").alias("trade_count"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy(TOKEN).orderBy(F.desc("trade_count"), "pool_address")))


def dedupe_pools(pools: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lower("pool_address")).orderBy("ordinal")
    return pools.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pool_alias_index(pools: DataFrame) -> DataFrame:
    """Every name of a pool, and every unordered pair, with the number of pools it may mean and the first of them."""
    names = pools.select("pool_address", F.explode(F.array_distinct(F.array("pool_address", "custody_address"))).alias("alias"))
    pairs = pools.select("pool_address", F.concat_ws("/", F.least("token0", "token1"), F.greatest("token0", "token1")).alias("alias"))
    both = names.withColumn("kind", F.lit("alias")).unionByName(pairs.withColumn("kind", F.lit("pair")))
    return both.groupBy("kind", "alias").agg(F.count_distinct("pool_address").alias("n"), F.min("pool_address").alias("identifier"))


def unique_custody_pools(pools: DataFrame) -> DataFrame:
    """Pools whose custody address is theirs alone, so a balance there is the pool's."""
    n = F.count("*").over(Window.partitionBy("custody_address"))
    return pools.withColumn("_n", n).where("_n = 1").drop("_n")


def resolve_pool_first_match(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """The pool by address, else the first pool (by ordinal) of the pair."""
    pair = Window.partitionBy(F.least("token0", "token1"), F.greatest("token0", "token1")).orderBy("ordinal")
    first = pools.withColumn("_r", F.row_number().over(pair)).where("_r = 1").select(F.least("token0", "token1").alias("_lo"), F.greatest("token0", "token1").alias("_hi"), F.col("pool_address").alias("_first"))
    exact = pools.select(F.col("pool_address").alias("_exact"))
    lo, hi = F.least("token0_address", "token1_address"), F.greatest("token0_address", "token1_address")
    out = rows.join(exact, rows.pool_address == F.col("_exact"), "left").join(first, (lo == F.col("_lo")) & (hi == F.col("_hi")), "left")
    return out.withColumn("pool", F.coalesce("_exact", "_first")).drop("_exact", "_first", "_lo", "_hi")


def score_verification(facts: DataFrame, checks: list[str], least: float = 0.3) -> DataFrame:
    """Share of the applicable checks (not null) that hold; verified from `least` on; an untrusted factory scores 0."""
    known = F.filter(F.array(*checks), lambda x: x.isNotNull())
    share = F.try_divide(F.size(F.filter(known, lambda x: x)), F.size(known))
    score = F.when(F.coalesce("trusted_factory", F.lit(False)), F.round(F.coalesce(share, F.lit(0.0)), 4)).otherwise(0.0)
    return facts.withColumn("verification_confidence", score).withColumn("verified", F.col("verification_confidence") >= least)


def pool_coverage(pools: DataFrame, tvl: DataFrame) -> DataFrame:
    """Per token: verified pools, those with a TVL observation, and the v4 pools without one."""
    measured = tvl.select(TOKEN, "pool_address").distinct().withColumn("seen", F.lit(True))
    # each token with the verified pools of its own chain; here, all of a dimension whose size does not grow with the events
    grid = tvl.select(TOKEN).distinct().join(pools.where("verified"), F.lit(True))
    rows = grid.join(measured, [TOKEN, "pool_address"], "left")
    return rows.groupBy(TOKEN).agg(F.count("*").alias("verified_pools"), F.count("seen").alias("measured_pools"), F.count_if((F.col("version") == "v4") & F.col("seen").isNull()).alias("missing_v4")).withColumn(
        "coverage_pct", F.round(100 * F.try_divide("measured_pools", "verified_pools"), 4)
    )


def label_pools(pools: DataFrame) -> DataFrame:
    """Address labels of pools and custody addresses; the first label of an address wins."""
    rows = pools.select(F.explode(F.array(F.struct(F.col("pool_address").alias("address"), F.lit("pool").alias("label"), F.lit(0).alias("p")), F.struct(F.col("custody_address").alias("address"), F.lit("custody").alias("label"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    return rows.groupBy("address").agg(F.min_by("label", "p").alias("label"))


def liquidity_pool_block(liq: DataFrame, by_sign: bool = False) -> DataFrame:
    """Amounts and number of events for each pool and block (and sign of the delta)."""
    keys = [TOKEN, "pool_address", "block_number"] + (["sign"] if by_sign else ["event_type"])
    rows = liq.withColumn("sign", F.signum("liquidity_delta").cast("int"))
    return rows.groupBy(*keys).agg(F.sum("token0_amount").alias("token0_amount"), F.sum("token1_amount").alias("token1_amount"), F.sum("liquidity_delta").alias("liquidity_delta"), F.sum("event_count").alias("event_count"), F.max("block_timestamp").alias("block_time"))


def tvl_point_details(resampled: DataFrame) -> DataFrame:
    """Each pool's share of the token's TVL at each point."""
    total = F.sum("tvl_raw").over(Window.partitionBy(TOKEN, "bucket"))
    return resampled.select(TOKEN, "bucket", "pool_address", "tvl_raw", F.round(100 * F.try_divide(F.col("tvl_raw"), total), 6).alias("share_pct"))


def cotx_baseline(transfers: DataFrame, edges: DataFrame, threshold: int = 3) -> DataFrame:
    """How often a pair of addresses shares transactions, among all pairs and among edges, and the lift."""
    addresses = transfers.select(TOKEN, F.explode(F.array("from_address", "to_address")).alias("a")).groupBy(TOKEN).agg(F.count_distinct("a").alias("n"))
    pairs = transfers.where("from_address <> to_address and amount_raw > 0").groupBy(TOKEN, F.least("from_address", "to_address").alias("a"), F.greatest("from_address", "to_address").alias("b")).agg(F.count_distinct("transaction_hash").alias("n_tx")).where(F.col("n_tx") >= threshold)
    hits = pairs.groupBy(TOKEN).agg(F.count("*").alias("hits"))
    on_edges = edges.select(TOKEN, "a", "b").join(pairs, [TOKEN, "a", "b"], "left").groupBy(TOKEN).agg(F.count("*").alias("edges"), F.count("n_tx").alias("edge_hits"))
    out = addresses.join(hits, TOKEN, "left").join(on_edges, TOKEN, "left")
    rate, edge_rate = F.try_divide(F.coalesce("hits", F.lit(0)), F.col("n") * (F.col("n") - 1) / 2), F.try_divide("edge_hits", "edges")
    return out.select(TOKEN, F.round(rate, 9).alias("rate"), F.round(edge_rate, 9).alias("edge_rate"), F.round(F.try_divide(edge_rate, rate), 6).alias("lift"))


def holdings(trajectory: DataFrame, pools: DataFrame, contracts: DataFrame) -> DataFrame:
    """Trajectories with the kind of address and the net change. contracts: address."""
    known = pools.select(F.explode(F.array("pool_address", "custody_address")).alias("address")).distinct().withColumn("_p", F.lit(True))
    code = contracts.select("address").distinct().withColumn("_c", F.lit(True))
    rows = trajectory.join(known, "address", "left").join(code, "address", "left")
    kind = F.when(F.col("_p"), "pool").when(F.col("_c"), "contract").otherwise("eoa")
    return rows.select(TOKEN, "address", kind.alias("address_type"), "start_balance", "end_balance", (F.col("end_balance") - F.col("start_balance")).alias("net_change"), "peak_balance", "moved_in", "moved_out", "source")


def resolve_pool_strict(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """rows + pool, never guessed: the exact identifier; else the alias if it means one pool; else the pair if it means one; else
    the one pool that bears both alias and pair; else null. rows: pool_address, token0_address, token1_address."""
    pair = lambda a, b: F.concat_ws("/", F.least(a, b), F.greatest(a, b))
    names = pools.select("pool_address", F.explode(F.array_distinct(F.array("pool_address", "custody_address"))).alias("_name"), pair("token0", "token1").alias("_pair"))
    only = lambda key: names.groupBy(*key).agg(F.count_distinct("pool_address").alias("_n"), F.min("pool_address").alias("_p")).where("_n = 1").drop("_n")
    exact = pools.select(F.col("pool_address").alias("_id"), F.col("pool_address").alias("_exact")).distinct()
    out = rows.withColumns({"_id": F.col("pool_address"), "_name": F.col("pool_address"), "_pair": F.when(F.col("token0_address").isNotNull() & F.col("token1_address").isNotNull(), pair("token0_address", "token1_address"))})
    out = out.join(exact, "_id", "left").join(only(["_name"]).withColumnRenamed("_p", "_alias"), "_name", "left")
    out = out.join(only(["_pair"]).withColumnRenamed("_p", "_by_pair"), "_pair", "left").join(only(["_name", "_pair"]).withColumnRenamed("_p", "_both"), ["_name", "_pair"], "left")
    return out.withColumn("pool", F.coalesce("_exact", "_alias", "_by_pair", "_both")).drop("_id", "_name", "_pair", "_exact", "_alias", "_by_pair", "_both")


def discover_pools_v4(swaps: DataFrame, initialized: DataFrame, target: str) -> DataFrame:
    """Pools of the manager that swapped and whose key has the target: identifier, currencies, fee and swaps."""
    keys = initialized.where((F.col("token0") == target) | (F.col("token1") == target)).select("pool_address", "token0", "token1", "fee")
    return swaps.groupBy(TOKEN, "pool_address").agg(F.count("*").alias("swaps")).join(keys, "pool_address").select(TOKEN, "pool_address", "token0", "token1", "fee", "swaps")


def discover_pools_detail(swaps: DataFrame) -> DataFrame:
    """Per venue: the tokens seen, distinct trades, blocks and USD volume. Volume is added up before sides are unfolded, so it is not doubled."""
    by = [TOKEN, "pool_address"]
    totals = swaps.groupBy(*by).agg(F.count_distinct("transaction_hash", "log_index").alias("trades"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"), F.sum(F.round("amount_usd", 4).cast("decimal(24,4)")).cast("double").alias("volume_usd"))
    sides = swaps.select(*by, F.explode(F.array("token0_address", "token1_address")).alias("t")).distinct().groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tokens"))
    return totals.join(sides, by)


def map_project(project: Column, version: Column) -> Column:
    """struct(adapter, version): curve pools of the second kind say so in version or name."""
    name, v = F.lower(project), F.lower(F.coalesce(version, F.lit("")))
    number = F.nullif(F.regexp_extract(F.concat_ws(" ", v, name), "v?([1-4])", 1), F.lit(""))
    adapter = F.when(name.startswith("uniswap"), "uniswap").when(name.startswith("balancer"), "balancer").when(name.startswith("curve"), "curve")
    crypto = v.contains("crypto") | v.contains("v2") | name.contains("crypto") | name.contains("v2")
    v_out = F.when(adapter == "curve", F.when(crypto, "v2").otherwise("v1")).when(adapter == "balancer", "v2").otherwise(F.concat(F.lit("v"), F.coalesce(number, F.lit("2"))))
    return F.struct(adapter.alias("adapter"), F.when(adapter.isNotNull(), v_out).alias("version"))


def standard_tier_pools(target: str, quotes: DataFrame, tiers: DataFrame, initialized: DataFrame, seen: DataFrame) -> DataFrame:
    """Initialized pools of the target with a known quote at a standard tier that were not found yet. quotes (a handful) by
    tiers (four) are the candidate keys; initialized: pool_address, token0, token1, fee."""
    keys = quotes.select("quote").crossJoin(F.broadcast(tiers.select("fee"))).select(F.least(F.lit(target), "quote").alias("_lo"), F.greatest(F.lit(target), "quote").alias("_hi"), "fee")
    rows = initialized.withColumns({"_lo": F.least("token0", "token1"), "_hi": F.greatest("token0", "token1")})
    return rows.join(keys, ["_lo", "_hi", "fee"], "left_semi").join(seen.select("pool_address"), "pool_address", "left_anti").drop("_lo", "_hi")


def verify_creation_log(pools: DataFrame, creations: DataFrame) -> DataFrame:
    """pools + created, creation_block. creations: contract, block_number."""
    first = creations.groupBy(F.col("contract").alias("pool_address")).agg(F.min("block_number").alias("creation_block"))
    return pools.join(first, "pool_address", "left").withColumn("created", F.col("creation_block").isNotNull())


def resolve_custody(pools: DataFrame, managers: DataFrame) -> DataFrame:
    """The address that holds a pool's tokens: its own, or the manager of its protocol and version. managers: protocol, version, manager."""
    return pools.drop("custody_address").join(managers, ["protocol", "version"], "left").withColumn("custody_address", F.coalesce("manager", "pool_address")).drop("manager")


def pool_identification(pools: DataFrame, balances: DataFrame) -> DataFrame:
    """Pools with the balances of their custody address, and whether it is among the holders. balances: token_address, address, balance_raw."""
    rows = pools.select("pool_address", "custody_address", "protocol", "version").join(balances.withColumnRenamed("address", "custody_address"), "custody_address", "left")
    return rows.select(TOKEN, "pool_address", "protocol", "version", "balance_raw", F.col("balance_raw").isNotNull().alias("in_holders_list"))


def observed_reserves(pools: DataFrame, by_pool: DataFrame, by_custody: DataFrame) -> DataFrame:
    """A pool's reserve by its own row, else by its custody address; and whether it counts in totals: the first pool of each custody does.
    by_pool: token_address, pool_address, reserve; by_custody: token_address, custody_address, reserve."""
    tokens = by_pool.select(TOKEN).union(by_custody.select(TOKEN)).distinct()
    grid = tokens.join(by_pool.select(TOKEN, "pool_address").union(by_custody.join(pools, "custody_address").select(TOKEN, "pool_address")).distinct(), TOKEN)
    rows = grid.join(pools.select("pool_address", "custody_address", "ordinal"), "pool_address")
    rows = rows.join(by_pool.withColumnRenamed("reserve", "_a"), [TOKEN, "pool_address"], "left").join(by_custody.withColumnRenamed("reserve", "_b"), [TOKEN, "custody_address"], "left")
    first = F.row_number().over(Window.partitionBy(TOKEN, "custody_address").orderBy("ordinal")) == 1
    return rows.select(TOKEN, "pool_address", "custody_address", F.coalesce("_a", "_b").alias("reserve"), F.when(F.col("_a").isNotNull(), "pool").otherwise("custody").alias("source"), first.alias("counts"))


def address_display_labels(pools: DataFrame) -> DataFrame:
    """pool_address, label: SYM0/SYM1 and version; symbols are the tokens' names here."""
    return pools.select("pool_address", F.concat(F.col("token0"), F.lit("/"), F.col("token1"), F.lit(" "), F.col("version")).alias("label"))
