"""Pools and events from raw logs: topics and data as the chain has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import abi as A

TOKEN = "token_address"
#: What a creation says of its pool.
CREATED = ["family", "event_name", "pool_address", "pool_id", "token0", "token1", "tokens", "fee", "tick_spacing", "hooks", "factory", "creation_block", "creation_tx"]


def creations(logs: DataFrame) -> DataFrame:
    """A row for each creation log: PairCreated (v2), PoolCreated (v3), Initialize (v4), TokensRegistered (balancer).

    logs: family, event_name, address (who logs), topics (array of words), data, block_number, transaction_hash. Tokens are
    topics of the first three and an array in the data of the last, which may have more than two. A v4 pool is its id of 32
    bytes, a balancer pool the first 20 of it. Other logs are left out; fields that are cut off are null.
    """
    rows = logs.where(
        ((F.col("family") == "v2") & (F.col("event_name") == "PairCreated")) | ((F.col("family") == "v3") & (F.col("event_name") == "PoolCreated"))
        | ((F.col("family") == "v4") & (F.col("event_name") == "Initialize")) | ((F.col("family") == "balancer") & (F.col("event_name") == "TokensRegistered"))
    )
    topic = lambda i: F.get("topics", F.lit(i))
    family, data = F.col("family"), F.col("data")
    by = lambda v2=None, v3=None, v4=None, balancer=None: F.coalesce(*[F.when(family == name, c) for name, c in (("v2", v2), ("v3", v3), ("v4", v4), ("balancer", balancer)) if c is not None])
    held = F.transform(A.array(data, 0), A.address)
    rows = rows.withColumn("_held", F.when(family == "balancer", held))
    token = lambda i: by(A.address(topic(1 + i)), A.address(topic(1 + i)), A.address(topic(2 + i)), F.get("_held", F.lit(i)))
    identity = F.concat(F.lit("0x"), A.digits(topic(1)))
    rows = rows.withColumns({
        "token0": token(0), "token1": token(1), "pool_id": by(v4=identity, balancer=identity), "factory": F.lower("address"),
        "pool_address": by(A.address(A.word(data, 0)), A.address(A.word(data, 1)), identity, A.first_address(topic(1))),
        "fee": by(v3=A.uint(topic(3)), v4=A.uint(A.word(data, 0))).cast("int"), "tick_spacing": by(v3=A.integer(A.word(data, 0)), v4=A.integer(A.word(data, 1))).cast("int"),
        "hooks": by(v4=A.address(A.word(data, 2))), "creation_block": F.col("block_number"), "creation_tx": F.col("transaction_hash"),
    })
    rows = rows.withColumn("tokens", F.coalesce("_held", F.array("token0", "token1")))
    return rows.select(*[c for c in (TOKEN,) if c in logs.columns], *CREATED)


def discover(logs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pools that any of the tokens is in, for all tokens in one job: token_address, and of each pool its first creation.

    tokens: token_address, target (the token's address). An equal join on the tokens of a pool, which are few.
    """
    # outer, so that no filter on the size of the array repeats its expressions; the join drops null
    found = creations(logs.drop(TOKEN)).withColumn("_t", F.explode_outer(F.array_distinct("tokens")))
    mine = found.join(tokens.select(TOKEN, F.lower("target").alias("_t")), "_t").drop("_t")
    first = F.struct("creation_block", "creation_tx", "factory")
    rest = [c for c in CREATED if c not in ("family", "pool_address")]
    out = mine.groupBy(TOKEN, "family", "pool_address").agg(F.min_by(F.struct(*rest), first).alias("c"))
    return out.select(TOKEN, "family", "pool_address", "c.*")


def standard_pools(found: DataFrame, tokens: DataFrame, quotes: DataFrame, tiers: DataFrame, seen: DataFrame) -> DataFrame:
    """Pools of a token with a known quote, at a standard fee and its spacing, without hooks, that are not among those seen.

    found: pools as `discover` gives them; tokens: token_address, target; quotes: quote; tiers: fee, tick_spacing; seen:
    pool_address. Keys are met by equal joins, for all tokens at once; no candidates are listed.
    """
    rows = found.where(F.col("hooks") == "0x" + "0" * 40).join(tokens.select(TOKEN, F.lower("target").alias("_target")), TOKEN)
    other = F.when(F.col("token0") == F.col("_target"), F.col("token1")).when(F.col("token1") == F.col("_target"), F.col("token0"))
    rows = rows.withColumn("_quote", other).join(quotes.select(F.lower("quote").alias("_quote")), "_quote", "left_semi")
    return rows.join(tiers, ["fee", "tick_spacing"], "left_semi").join(seen, "pool_address", "left_anti").drop("_quote", "_target")


def balance_changes(logs: DataFrame) -> DataFrame:
    """Balancer's PoolBalanceChanged: pool, provider, tokens, deltas (signed) from the arrays of its data."""
    topic = lambda i: F.get("topics", F.lit(i))
    rows = logs.where((F.col("family") == "balancer") & (F.col("event_name") == "PoolBalanceChanged"))
    return rows.select(
        "*", A.first_address(topic(1)).alias("pool_address"), A.address(topic(2)).alias("sender"),
        F.transform(A.array(F.col("data"), 0), A.address).alias("tokens"), F.transform(A.array(F.col("data"), 1), A.integer).alias("deltas"),
    )


def liquidity_changes(logs: DataFrame) -> DataFrame:
    """The v4 manager's ModifyLiquidity: pool id, sender, ticks, delta (signed) and salt; nft_token_id is the salt as a number of
    38 digits, salt_id as text of any length."""
    topic = lambda i: F.get("topics", F.lit(i))
    rows = logs.where((F.col("family") == "v4") & (F.col("event_name") == "ModifyLiquidity"))
    w = lambda i: A.word(F.col("data"), i)
    return rows.select(
        "*", F.concat(F.lit("0x"), A.digits(topic(1))).alias("pool_address"), A.address(topic(2)).alias("sender"), A.integer(w(0)).cast("int").alias("tick_lower"), A.integer(w(1)).cast("int").alias("tick_upper"),
        A.integer(w(2)).alias("liquidity_delta"), F.concat(F.lit("0x"), w(3)).alias("salt"), A.uint(w(3)).alias("nft_token_id"), A.number_text(w(3)).alias("salt_id"),
    )
