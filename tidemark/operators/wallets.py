"""Wallet statistics, signed flows and the wallet graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money as M
from tidemark.operators.ordered import numbered, value_ranks
from tidemark.sources.tables import checkpointed

TOKEN = "token_address"


def wallet_stats(priced: DataFrame, infrastructure: DataFrame | None = None) -> DataFrame:
    """Per wallet (the actor, else the recipient): swaps, USD bought, sold, net, in total and at most, tokens, and the USD of all
    swaps of the token.

    priced: what prices.priced_swaps returns, with pools by prices.first_pair. Swaps of no pool or of unknown USD value are
    left out, of the market too. A wallet sells where the target is side 0. Infrastructure (address) is no wallet, but its
    swaps count in market_usd.
    """
    rows = priced.where("usd > 0 and pool is not null")
    if "recipient" in priced.columns:
        rows = rows.withColumn("actor", F.coalesce(F.nullif("actor", F.lit("")), F.nullif("recipient", F.lit(""))))
    market = rows.groupBy(TOKEN).agg(F.sum("usd").alias("market_usd"))
    rows = rows.where("actor is not null")
    if infrastructure is not None:
        rows = rows.join(infrastructure.select(F.col("address").alias("actor")).distinct(), "actor", "left_anti")
    sold, usd, zero = F.col("side") == 0, F.col("usd"), F.lit(0).cast("decimal(24,6)")
    tokens = F.round("target", 6).cast("decimal(24,6)")
    out = rows.groupBy(TOKEN, "actor").agg(
        F.count("*").alias("swap_count"), F.sum(F.when(sold, zero).otherwise(usd)).alias("bought_usd"), F.sum(F.when(sold, usd).otherwise(zero)).alias("sold_usd"), F.max("usd").alias("max_single_usd"),
        F.sum(F.when(sold, zero).otherwise(tokens)).alias("bought_token"), F.sum(F.when(sold, tokens).otherwise(zero)).alias("sold_token"),
    )
    out = out.join(market, TOKEN)
    double = [F.col(c).cast("double").alias(c) for c in ("bought_usd", "sold_usd", "max_single_usd", "bought_token", "sold_token", "market_usd")]
    net, total = (F.col("bought_usd") - F.col("sold_usd")).cast("double"), (F.col("bought_usd") + F.col("sold_usd")).cast("double")
    return out.select(TOKEN, "actor", "swap_count", *double, net.alias("net_usd"), total.alias("total_usd"))


def exclusive_percentile(df: DataFrame, column: str, q: float = 0.99, by: tuple[str, ...] = (TOKEN,)) -> DataFrame:
    """Per token: the value at place q * (n + 1) - 1, clamped, between neighbours linearly (not what percentile() gives), and
    whether there is more than one value. Equal values are counted first, ranks are taken by ranges of values."""
    return _percentile_of(value_ranks(df.select(*by, F.col(column).cast("double").alias("v")), list(by), "v"), q, by)


def _percentile_of(ranks: DataFrame, q: float, by: tuple[str, ...]) -> DataFrame:
    place = F.greatest(F.lit(0.0), F.least(F.lit(q) * (F.col("total") + 1) - 1, (F.col("total") - 1).cast("double")))
    rows = ranks.withColumns({"lo": F.floor(place), "part": place - F.floor(place)})
    holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
    up = F.least(F.col("lo") + 1, F.col("total") - 1)
    out = rows.groupBy(*by).agg(F.max(F.when(holds(F.col("lo")), F.col("v"))).alias("a"), F.max(F.when(holds(up), F.col("v"))).alias("b"), F.max("part").alias("part"), (F.count("*") > 1).alias("varies"))
    return out.select(*by, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"), "varies")


#: Flag, the statistic it is about, and whether its limit is rounded up.
FLAGS = [("large_trade", "max_single_usd", False), ("large_mover", "abs_net_usd", False), ("high_activity", "swap_count", True), ("market_share", "total_usd", False)]


def wallet_flags(stats: DataFrame, q: float = 0.99, fixed: dict[str, float] | None = None, volume_ratio: float | None = None) -> DataFrame:
    """Large trades, large movers, high activity and market share against each token's percentile, where the token has
    more than one value; notable if any holds; a score: the highest percentile rank of the four.

    fixed: limits by flag in place of percentiles. volume_ratio: market share from that part of the token's volume on;
    it is information then and makes no wallet notable.
    """
    out = checkpointed(stats.withColumn("abs_net_usd", F.abs("net_usd")))
    fixed = fixed or {}
    each = F.array(*[F.struct(F.lit(name).alias("flag"), F.col(column).cast("double").alias("v")) for name, column, _ in FLAGS])
    values = out.select(TOKEN, "actor", F.explode(each).alias("e")).select(TOKEN, "actor", "e.*")
    ranks = checkpointed(value_ranks(values, [TOKEN, "flag"], "v"))
    limits = _percentile_of(ranks, q, (TOKEN, "flag"))
    limits = limits.groupBy(TOKEN).agg(*[F.max(F.when(F.col("flag") == name, F.struct("value", "varies"))).alias(f"_{name}") for name, _, _ in FLAGS])
    score = F.round(100 * (F.col("below") + F.col("n")) / F.col("total"), 4)
    scores = values.join(ranks, [TOKEN, "flag", "v"]).groupBy(TOKEN, "actor").agg(F.max(score).alias("score"))
    out = out.join(scores, [TOKEN, "actor"], "left").join(limits, TOKEN, "left")
    for name, column, up in FLAGS:
        value = F.ceil(f"_{name}.value") if up else F.col(f"_{name}.value")
        flag = (F.col(column) >= value) & F.col(f"_{name}.varies")
        if name in fixed or (name == "market_share" and volume_ratio is not None):
            flag = F.col(column) >= (F.lit(fixed[name]) if name in fixed else F.col("market_usd") * volume_ratio)
        out = out.withColumn(name, F.coalesce(flag, F.lit(False)))
    signals = ["large_trade", "large_mover", "high_activity"] + ([] if volume_ratio is not None else ["market_share"])
    out = out.withColumn("n_flags", sum(F.col(name).cast("int") for name, _, _ in FLAGS))
    return out.withColumn("notable", sum(F.col(name).cast("int") for name in signals) > 0).drop("abs_net_usd", *[f"_{name}" for name, _, _ in FLAGS])


def wallet_ranking(flags: DataFrame, top_n: int = 200) -> DataFrame:
    """Notable wallets and the next top_n, in order of flags, score, net and total."""
    order = [F.desc("n_flags"), F.desc("score"), F.desc(F.abs("net_usd")), F.desc("total_usd"), "actor"]
    ranked = numbered(flags, [TOKEN], order, {"rank": F.lit(True), "_others": ~F.col("notable")})
    return ranked.where(F.col("notable") | (F.col("_others") <= top_n)).withColumn("rank", F.col("rank").cast("int")).drop("_others")


def wallet_movers(stats: DataFrame, trajectory: DataFrame, pools: DataFrame, top_n: int = 20) -> DataFrame:
    """Traders and holders side by side, pools left out, largest net first."""
    held = trajectory.select(TOKEN, F.col("address").alias("actor"), (F.col("end_balance") - F.col("start_balance")).alias("held_change"))
    both = stats.select(TOKEN, "actor", "net_usd", "swap_count").join(held, [TOKEN, "actor"], "full_outer")
    both = both.join(pools.select(F.explode(F.array("pool_address", "custody_address")).alias("actor")).distinct(), "actor", "left_anti")
    w = Window.partitionBy(TOKEN).orderBy(F.desc(F.abs(F.coalesce("net_usd", F.lit(0)))), F.desc(F.abs(F.coalesce("held_change", F.lit(0)))), "actor")
    return both.select(TOKEN, "actor", "net_usd", "swap_count", "held_change").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def signed_swaps(raw: DataFrame, pools: DataFrame, target: str, decimals: int = 18) -> DataFrame:
    """Swap logs with amounts as the pool sees them (amount0, amount1: into the pool is positive) -> direction, the
    pool's target and quote change in raw units, whole amounts and price. raw: pool_address, amount0, amount1 as strings."""
    rows = raw.join(pools.select("pool_address", "token0", "token1"), "pool_address").where((F.col("token0") == target) | (F.col("token1") == target))
    first = F.col("token0") == target
    a0, a1 = M.raw(F.col("amount0")), M.raw(F.col("amount1"))
    delta, other = F.when(first, a0).otherwise(a1), F.when(first, a1).otherwise(a0)
    rows = rows.withColumns({"target_delta": delta, "quote_delta": other, "quote": F.when(first, F.col("token1")).otherwise(F.col("token0"))})
    amount = F.abs(F.col("target_delta")).cast("double") / F.pow(F.lit(10.0), F.lit(decimals))
    quote = F.abs(F.col("quote_delta")).cast("double") / F.pow(F.lit(10.0), M.quote_decimals(F.col("quote")))
    side = F.when(F.col("target_delta") > 0, "SELL").when(F.col("target_delta") < 0, "BUY").otherwise("ZERO_TARGET")
    return rows.withColumns({"direction": side, "target_amount": amount, "quote_amount": quote, "price": F.try_divide(quote, F.nullif(amount, F.lit(0.0)))}).drop("token0", "token1")


def pool_transfer_deltas(transfers: DataFrame, custody: DataFrame, swaps: DataFrame) -> DataFrame:
    """Transfers, one of each (transaction, log), with what the pool gains (+) or loses (-) by each, and whether the
    transaction also swaps. custody: token_address, pool_address (whose balance it is)."""
    one = transfers.groupBy(TOKEN, "transaction_hash", "log_index").agg(F.min(F.struct("block_number", "from_address", "to_address", "amount_raw")).alias("_one")).select(TOKEN, "transaction_hash", "log_index", "_one.*")
    rows = one.join(custody.select(TOKEN, "pool_address"), TOKEN)
    amount = F.col("amount_raw").cast("decimal(38,0)")
    delta = F.when(F.col("to_address") == F.col("pool_address"), amount).when(F.col("from_address") == F.col("pool_address"), -amount).otherwise(F.lit(0).cast("decimal(38,0)"))
    swapped = swaps.select(TOKEN, "transaction_hash").distinct().withColumn("_s", F.lit(True))
    return rows.withColumn("pool_delta", delta).join(swapped, [TOKEN, "transaction_hash"], "left").withColumn("related_to_swap_tx", F.coalesce("_s", F.lit(False))).drop("_s")


def tx_flows(signed: DataFrame, deltas: DataFrame) -> DataFrame:
    """Per transaction: the pool's target change by its swaps and by its transfers, and the gap between them."""
    s = signed.groupBy(TOKEN, "transaction_hash").agg(F.count("*").alias("swap_count"), F.sum("target_delta").alias("swap_delta"), F.min("block_number").alias("_b1"), F.min("actor").alias("sender"))
    t = deltas.groupBy(TOKEN, "transaction_hash").agg(F.count("*").alias("transfer_count"), F.sum("pool_delta").alias("transfer_delta"), F.min("block_number").alias("_b2"))
    both = s.join(t, [TOKEN, "transaction_hash"], "full_outer")
    number = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    both = both.select(
        TOKEN, "transaction_hash", F.coalesce("_b1", "_b2").alias("block_number"), "sender", *[number(c, "long").alias(c) for c in ("swap_count", "transfer_count")],
        *[number(c, "decimal(38,0)").alias(c) for c in ("swap_delta", "transfer_delta")],
    )
    return both.withColumns({"has_swap": F.col("swap_count") > 0, "gap": (F.col("transfer_delta") - F.col("swap_delta")).cast("decimal(38,0)")})


def sender_flows(flows: DataFrame) -> DataFrame:
    """Per sender of swap transactions: what was sold into the pool, bought from it, the net, and what transfers say."""
    d, zero = F.col("swap_delta"), F.lit(0).cast("decimal(38,0)")
    rows = flows.where("has_swap").groupBy(TOKEN, "sender")
    return rows.agg(
        F.count("*").alias("n_tx"), F.sum("swap_count").alias("swaps"), F.sum(F.when(d > 0, d).otherwise(zero)).cast("decimal(38,0)").alias("sell"), F.sum(F.when(d < 0, -d).otherwise(zero)).cast("decimal(38,0)").alias("buy"),
        F.sum(d).cast("decimal(38,0)").alias("net"), F.sum("transfer_delta").cast("decimal(38,0)").alias("actual"),
    )


def flow_reconciliation(flows: DataFrame, senders: DataFrame, balances: DataFrame, top: int = 5) -> DataFrame:
    """Per token: transfers into and out of the pool, with and without a swap, against the change of its balance; exact
    or the mismatch; and the share of the largest sellers. balances: token_address, balance_change."""
    d, swap = F.col("transfer_delta"), F.col("has_swap")
    zero = F.lit(0).cast("decimal(38,0)")
    part = lambda cond, name, value=d: F.sum(F.when(cond, value).otherwise(zero)).cast("decimal(38,0)").alias(name)
    totals = flows.groupBy(TOKEN).agg(
        F.count("*").alias("transactions"), F.count_if(swap).alias("swap_transactions"), part(d > 0, "transfer_in"), part(d < 0, "transfer_out", -d), part(swap, "swap_net"), part(~swap, "other_net"),
        F.sum("swap_delta").cast("decimal(38,0)").alias("swap_event_net"),
    )
    ranked = senders.withColumn("_r", F.row_number().over(Window.partitionBy(TOKEN).orderBy(F.desc("sell"), "sender")))
    sellers = ranked.groupBy(TOKEN).agg(F.count("*").alias("senders"), F.try_divide(F.sum(F.when(F.col("_r") <= top, F.col("sell"))).cast("double"), F.sum("sell").cast("double")).alias("_share"))
    out = totals.join(sellers, TOKEN, "left").join(balances, TOKEN, "left")
    net = F.col("transfer_in") - F.col("transfer_out")
    out = out.withColumn("mismatch", (net - F.col("balance_change")).cast("decimal(38,0)"))
    return out.select("*", (F.col("mismatch") == 0).alias("exact"), F.round("_share", 9).alias("top_share")).drop("_share")


def fund_flow_edges(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy(TOKEN, "from_address", "to_address").agg(
        F.sum(F.col("amount_raw").cast("decimal(38,0)")).cast("decimal(38,0)").alias("amount"), F.count("*").alias("transfer_count"), F.count_distinct("transaction_hash").alias("tx_count"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block")
    )


def _pairs(transfers: DataFrame) -> DataFrame:
    """Transfers of something between two addresses; those of 0 or less say nothing about a relation."""
    rows = transfers.where("from_address <> to_address").withColumn("amount_raw", F.col("amount_raw").cast("decimal(38,0)")).where("amount_raw > 0")
    return rows.withColumns({"a": F.least("from_address", "to_address"), "b": F.greatest("from_address", "to_address")})


def reciprocal_edges(transfers: DataFrame, percent: int = 25) -> DataFrame:
    """Pairs that move both ways with mean amounts within percent of the larger. One pass, no self join."""
    forth = F.col("from_address") == F.col("a")
    g = _pairs(transfers).groupBy(TOKEN, "a", "b").agg(
        F.sum(F.when(forth, F.col("amount_raw"))).alias("s1"), F.count_if(forth).alias("n1"), F.sum(F.when(~forth, F.col("amount_raw"))).alias("s2"), F.count_if(~forth).alias("n2")
    )
    left, right = F.col("s1").cast("double") * F.col("n2"), F.col("s2").cast("double") * F.col("n1")  # means over a common denominator
    return g.where((F.col("n1") > 0) & (F.col("n2") > 0) & (F.abs(left - right) * 100 <= F.greatest(left, right) * percent)).select(TOKEN, "a", "b", "n1", "n2")


def repeated_edges(transfers: DataFrame, min_count: int = 3, percent: int = 25) -> DataFrame:
    """Directed pairs with at least min_count transfers, all within percent of their mean."""
    g = _pairs(transfers).groupBy(TOKEN, "from_address", "to_address").agg(F.count("*").alias("n"), F.sum("amount_raw").alias("s"), F.min("amount_raw").alias("lo"), F.max("amount_raw").alias("hi"))
    n, s = F.col("n"), F.col("s").cast("double")
    near = ((s - F.col("lo").cast("double") * n) * 100 <= s * percent) & ((F.col("hi").cast("double") * n - s) * 100 <= s * percent)
    return g.where((n >= min_count) & near).select(TOKEN, F.least("from_address", "to_address").alias("a"), F.greatest("from_address", "to_address").alias("b")).distinct()


def cotx_support(transfers: DataFrame, min_tx: int = 3) -> DataFrame:
    return _pairs(transfers).groupBy(TOKEN, "a", "b").agg(F.count_distinct("transaction_hash").alias("n_tx")).where(F.col("n_tx") >= min_tx)


def gas_payer_edges(transfers: DataFrame, payers: DataFrame) -> DataFrame:
    """Payer and every other address of the transactions it pays for, where the payer is an address of the transfers itself."""
    sides = transfers.select(TOKEN, "transaction_hash", F.explode(F.array("from_address", "to_address")).alias("address")).distinct()
    candidates = sides.select(TOKEN, F.col("address").alias("gas_payer")).distinct()
    paid = sides.join(payers, "transaction_hash").join(candidates, [TOKEN, "gas_payer"], "left_semi").where("gas_payer <> address")
    return paid.select(TOKEN, F.least("gas_payer", "address").alias("a"), F.greatest("gas_payer", "address").alias("b")).distinct()


def owner_contracts(addresses: DataFrame, facts: DataFrame) -> DataFrame:
    """addresses with resolved_owner: a contract's owner, else the address itself. facts: contract, owner."""
    owners = facts.groupBy(F.col("contract").alias("address")).agg(F.min("owner").alias("_o"))
    return addresses.join(owners, "address", "left").withColumn("resolved_owner", F.coalesce("_o", "address")).drop("_o")


def owner_edges(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Contracts and their owner, and contracts of one owner. candidates: token_address, address.

    Contracts of one owner are each joined to the least of them, not each with each: the components are the same, the
    edges as many as the contracts.
    """
    owned = candidates.join(facts.select(F.col("contract").alias("address"), "owner").distinct(), "address")
    to_owner = owned.join(candidates.select(TOKEN, F.col("address").alias("owner")), [TOKEN, "owner"], "left_semi").where("owner <> address").select(TOKEN, F.col("address").alias("x"), F.col("owner").alias("y"))
    least = owned.groupBy(TOKEN, "owner").agg(F.min("address").alias("y"))
    shared = owned.join(least, [TOKEN, "owner"]).where("address <> y").select(TOKEN, F.col("address").alias("x"), "y")
    return to_owner.union(shared).select(TOKEN, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


# Weights of the signals in percent, the support's, and the limits of the levels.
WEIGHTS = {"gas_payer": 20, "owner": 45, "reciprocal": 30, "repeated": 15}
SUPPORT, MOST, HIGH, MEDIUM = 5, 99, 70, 40


def confidence(signals, supported):
    """Score in percent of an array of signals, and its level."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    score = F.aggregate(signals, F.lit(0), lambda total, s: total + F.element_at(weights, s)) + F.when(supported, SUPPORT).otherwise(0)
    score = F.least(F.lit(MOST), score)
    return score, F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def edge_confidence(owner: DataFrame, reciprocal: DataFrame, repeated: DataFrame, gas: DataFrame, support: DataFrame) -> DataFrame:
    """All edges with their signals, a score of at most 0.99 (in percent) and a level. Support alone makes no edge."""
    rows = None
    for name, df in (("owner", owner), ("reciprocal", reciprocal), ("repeated", repeated), ("gas_payer", gas)):
        part = df.select(TOKEN, "a", "b", F.lit(name).alias("signal"))
        rows = part if rows is None else rows.unionByName(part)
    edges = rows.groupBy(TOKEN, "a", "b").agg(F.array_sort(F.collect_set("signal")).alias("_s"))
    edges = edges.join(support.select(TOKEN, "a", "b", F.lit(True).alias("_t")), [TOKEN, "a", "b"], "left").withColumn("supported", F.coalesce("_t", F.lit(False)))
    score, level = confidence(F.col("_s"), F.col("supported"))
    return edges.select(TOKEN, "a", "b", F.array_join("_s", ",").alias("signals"), "supported", score.alias("score_pct"), level.alias("level"))


def cluster_confidence(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of each cluster of two or more with the signals of all its edges together, score and level."""
    of = clusters.withColumnRenamed("address", "a")
    signals = edges.join(of, [TOKEN, "a"]).select(TOKEN, "cluster", F.explode(F.split("signals", ",")).alias("signal"), "supported")
    found = signals.groupBy(TOKEN, "cluster").agg(F.array_sort(F.collect_set("signal")).alias("_s"), F.bool_or("supported").alias("supported"))
    score, level = confidence(F.col("_s"), F.col("supported"))
    sizes = clusters.groupBy(TOKEN, "cluster").agg(F.count("*").alias("size"))
    found = found.join(sizes, [TOKEN, "cluster"]).select(TOKEN, "cluster", F.array_join("_s", ",").alias("signals"), "supported", score.alias("score_pct"), level.alias("level"), "size")
    return clusters.join(found, [TOKEN, "cluster"])


def wallet_clusters(edges: DataFrame, checkpoint) -> DataFrame:
    """token, address, cluster: the least address of each component. checkpoint cuts lineage each round.

    Each round every component found so far takes the least label any member hears from a neighbour, and then
    jumps once more, so components at least halve and the rounds grow with the logarithm of their number.
    """
    turns = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])  # with each node beside itself
    both = checkpoint(edges.select(TOKEN, F.explode(turns).alias("e")).select(TOKEN, "e.*").distinct())
    labels = both.groupBy(TOKEN, F.col("a").alias("address")).agg(F.min("b").alias("cluster"))
    while True:
        heard = both.join(labels.withColumnRenamed("address", "b"), [TOKEN, "b"]).groupBy(TOKEN, F.col("a").alias("address")).agg(F.min("cluster").alias("heard"), F.max(F.when(F.col("a") == F.col("b"), F.col("cluster"))).alias("old"))
        # all that share a label take the least that any of them heard, and then what that label has taken
        taken = heard.groupBy(TOKEN, "old").agg(F.min("heard").alias("new"))
        jump = taken.select(TOKEN, F.col("old").alias("new"), F.col("new").alias("root"))
        new = checkpoint(heard.select(TOKEN, "address", "old").join(taken, [TOKEN, "old"]).join(jump, [TOKEN, "new"], "left").select(TOKEN, "address", "old", F.least("new", F.coalesce("root", "new")).alias("cluster")))
        labels = new.drop("old")
        if not new.where("old <> cluster").head(1):
            return labels


def label_transfer_frequency(transfers: DataFrame, top_n: int = 20, min_count: int = 5) -> DataFrame:
    """The most frequent receivers, then senders that are not among them."""
    out = []
    for side, label in (("to_address", "frequent_receiver"), ("from_address", "frequent_sender")):
        counts = transfers.groupBy(TOKEN, F.col(side).alias("address")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
        w = Window.partitionBy(TOKEN).orderBy(F.desc("n"), "address")
        out.append(counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_n).select(TOKEN, "address", F.lit(label).alias("label"), "n"))
    receivers, senders = out
    return receivers.unionByName(senders.join(receivers, [TOKEN, "address"], "left_anti"))


def find_deployer(creations: DataFrame) -> DataFrame:
    """contract, deployer, block_number: its first creation. creations: contract, creator, block_number."""
    return creations.groupBy("contract").agg(F.min_by("creator", F.struct("block_number", "creator")).alias("deployer"), F.min("block_number").alias("block_number"))


def label_positions(positions: DataFrame, deployers: DataFrame, whale_pct: float = 5.0) -> DataFrame:
    """Deployers, owners of whale_pct of a pool or more, and owners in a pool where the deployer is one too; the first label of an
    address holds. positions: token_address, pool_address, owner, share_pct; deployers: token_address, deployer."""
    of = lambda rows, label, category, confidence, order: rows.select(TOKEN, "address", F.struct(F.lit(order).alias("order"), F.lit(label).alias("label"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence")).alias("l"))
    whales = positions.where(F.col("share_pct") >= whale_pct).select(TOKEN, F.col("owner").alias("address")).distinct()
    own = positions.join(deployers.withColumnRenamed("deployer", "owner"), [TOKEN, "owner"], "left_semi").select(TOKEN, "pool_address").distinct()
    beside = positions.join(own, [TOKEN, "pool_address"], "left_semi").select(TOKEN, F.col("owner").alias("address")).distinct()
    rows = of(deployers.select(TOKEN, F.col("deployer").alias("address")), "Deployer", "token_creator", 1.0, 0)
    rows = rows.union(of(whales, "Whale LP", "large_liquidity_provider", 0.8, 1)).union(of(beside, "Pool Co-LP with Deployer", "associated_address", 0.6, 2))
    return rows.groupBy(TOKEN, "address").agg(F.min("l").alias("l")).select(TOKEN, "address", "l.label", "l.category", "l.confidence")


# Addresses that nobody holds.
BURN = ["0x0000000000000000000000000000000000000000", "0x000000000000000000000000000000000000dead"]


def labels(*tables: DataFrame) -> DataFrame:
    """All labels, and those of the burn addresses of every token named. Each table: token_address, address, label."""
    rows = None
    for table in tables:
        part = table.select(TOKEN, "address", "label")
        rows = part if rows is None else rows.unionByName(part)
    burn = rows.select(TOKEN).distinct().select(TOKEN, F.explode(F.array(*map(F.lit, BURN))).alias("address"), F.lit("Burn").alias("label"))
    return burn.unionByName(rows.where(~F.lower("address").isin(BURN)))
