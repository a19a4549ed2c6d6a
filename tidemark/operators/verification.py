"""Which of the pools found in logs are what they seem: checks by family from tables, share of them that hold, custody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import money as M

TOKEN = "token_address"
#: A creation is looked for in logs of so many blocks at most.
MOST_BLOCKS = 1000
LEAST_CONFIDENCE = 0.3
CHECKS = [
    "trusted_factory", "has_code", "factory_matches", "tokens_match", "tokens_known", "target_in_pair", "found_by_key", "reserves_read", "fee_matches", "spacing_matches", "price_read", "liquidity_read",
    "manager_has_code", "creation_seen", "vault_holds_target", "coin_known",
]
ZERO = "0x" + "0" * 40


def facts(found: DataFrame, tokens: DataFrame, deployments: DataFrame, answers: DataFrame, codes: DataFrame, blocks: tuple[int, int] | None = None) -> DataFrame:
    """found + target, position_manager, custody_address and CHECKS: true, false, or null where a check is not for the family.

    found: pools as `discovery.discover` gives them. tokens: token_address, target. deployments, a row for each family that is
    trusted: family, factory, position_manager (null: none). answers, what pools say when read, the latest block of a pool
    holds: family, pool_address, block_number, factory, token0, token1, fee, tick_spacing, by_key (the pool that the factory
    names for the key), has_reserves, sqrt_price, has_liquidity, vault_tokens, first_coin. A pool that gave no answer fails what
    is asked of it. codes: address, of all contracts. blocks: the window searched, if creations are to be looked for.
    """
    said = [c for c in answers.columns if c not in ("family", "pool_address", "block_number")]
    latest = answers.groupBy("family", F.lower("pool_address").alias("pool_address")).agg(F.max_by(F.struct(*said), "block_number").alias("_said"))
    trusted = deployments.select(F.lower("factory").alias("factory")).distinct().withColumn("_trusted", F.lit(True))
    of_family = deployments.groupBy("family").agg(F.lower(F.min("position_manager")).alias("position_manager"))
    code = codes.select(F.lower("address").alias("_address")).distinct()
    rows = found.join(tokens.select(TOKEN, F.lower("target").alias("target")), TOKEN, "left").withColumns({c: F.lower(c) for c in ("pool_address", "token0", "token1", "factory")})
    rows = rows.join(latest, ["family", "pool_address"], "left").join(trusted, "factory", "left").join(of_family, "family", "left")
    family, said_of = F.col("family"), lambda c: F.col("_said." + c)
    rows = rows.withColumn("custody_address", F.when(family == "v4", F.col("factory")).otherwise(F.col("pool_address")))
    for name, address in (("_code", "custody_address"), ("_manager_code", "position_manager")):
        rows = rows.join(code.select(F.col("_address").alias(address), F.lit(True).alias(name)), address, "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    only = lambda families, c: F.when(family.isin(*families), true(c))
    both = F.col("token0").isNotNull() & F.col("token1").isNotNull()
    spacing = M.expected_tick_spacing(F.col("fee"))
    pair = true((F.col("target") == F.col("token0")) | (F.col("target") == F.col("token1")))
    held = F.array_contains(F.transform(said_of("vault_tokens"), F.lower), F.col("target"))
    width = blocks[1] - blocks[0] + 1 if blocks else MOST_BLOCKS + 1
    checks: dict[str, Column] = {
        "trusted_factory": true(F.col("_trusted")), "has_code": true(F.col("_code")),
        "factory_matches": only(("v1", "v2", "v3"), F.lower(said_of("factory")) == F.col("factory")),
        # tokens that no log told are taken from the pool
        "tokens_match": only(("v2", "v3"), F.when(both, (F.lower(said_of("token0")) == F.col("token0")) & (F.lower(said_of("token1")) == F.col("token1"))).otherwise(said_of("token0").isNotNull() & said_of("token1").isNotNull())),
        "tokens_known": F.when((family == "v4") & both, F.lit(True)),
        "target_in_pair": F.when(F.col("target").isNotNull(), F.when(family == "v1", true(F.lower(said_of("token0")) == F.col("target"))).otherwise(pair)),
        "found_by_key": only(("v2", "v3"), F.lower(said_of("by_key")) == F.col("pool_address")), "reserves_read": only(("v2",), said_of("has_reserves")),
        "fee_matches": F.when((family == "v3") & F.col("fee").isNotNull(), true(said_of("fee") == F.col("fee"))),
        "spacing_matches": F.when((family == "v3") & spacing.isNotNull(), true(said_of("tick_spacing") == spacing)),
        "price_read": F.when(family == "v3", said_of("sqrt_price").isNotNull()).when(family == "v4", true(said_of("sqrt_price") > 0)),
        "liquidity_read": F.when((family == "v3") | ((family == "v4") & said_of("sqrt_price").isNotNull()), true(said_of("has_liquidity"))),
        "manager_has_code": F.when(family.isin("v3", "v4") & F.col("position_manager").isNotNull(), true(F.col("_manager_code"))),
        "creation_seen": only(("v2", "v3"), F.col("creation_block").between(*blocks)) if width <= MOST_BLOCKS else F.lit(None).cast("boolean"),
        "vault_holds_target": only(("balancer",), held), "coin_known": only(("curve",), F.lower(said_of("first_coin")) != ZERO),
    }
    return rows.select(*found.columns, "target", "position_manager", "custody_address", *[checks[c].alias(c) for c in CHECKS])


def verify(rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """facts + n_checks, n_passed, verification_confidence, verified. Nothing holds for an untrusted factory, nor for a v4 pool
    whose id is missing or is the manager's own address; a balancer pool needs its vault's word besides."""
    known = F.filter(F.array(*CHECKS), lambda x: x.isNotNull())
    family = F.col("family")
    named = (family != "v4") | F.coalesce(F.lower("pool_address") != F.lower("factory"), F.lit(False))
    out = rows.withColumns({"n_checks": F.size(known), "n_passed": F.size(F.filter(known, lambda x: x))})
    share = F.when(F.col("trusted_factory") & named, F.try_divide("n_passed", "n_checks")).otherwise(0.0)
    enough = (share >= least) & F.col("trusted_factory") & named
    return out.withColumns({"verification_confidence": F.round(share, 4), "verified": enough & ((family != "balancer") | F.coalesce("vault_holds_target", F.lit(False)))})
