"""Verification of pools by hand: one case for each rule of a family."""

from pyspark.sql import functions as F

from tidemark.operators import discovery
from tidemark.operators import verification as V
from tidemark.plans import queries as Q

A = lambda x: "0x" + format(x, "040x")
TARGET, QUOTE, FACTORY, OTHER, NPM = A(1), A(2), A(250), A(251), A(163)
FOUND = "token_address string, family string, pool_address string, token0 string, token1 string, fee int, tick_spacing int, factory string, creation_block long"
SAID = (
    "family string, pool_address string, block_number long, factory string, token0 string, token1 string, fee int, tick_spacing int, by_key string, "
    "has_reserves boolean, sqrt_price long, has_liquidity boolean, vault_tokens array<string>, first_coin string"
)


def verified(spark, found, said, codes, blocks=None):
    deployments = spark.createDataFrame([("v2", FACTORY, None), ("v3", FACTORY, NPM), ("v4", FACTORY, NPM), ("balancer", FACTORY, None), ("curve", FACTORY, None), ("v1", FACTORY, None)], "family string, factory string, position_manager string")
    rows = V.facts(
        spark.createDataFrame(found, FOUND), spark.createDataFrame([("T", TARGET)], "token_address string, target string"), deployments, spark.createDataFrame(said, SAID),
        spark.createDataFrame([(c,) for c in codes], "address string"), blocks,
    )
    return {(r.family, r.pool_address): r for r in V.verify(rows).collect()}


def test_each_family_by_its_own_rules(spark):
    p = {name: A(1000 + i) for i, name in enumerate(("v1", "v2", "v3", "curve", "balancer", "bad", "silent"))}
    v4 = "0x" + "7" * 64
    found = [
        ("T", "v1", p["v1"], None, None, None, None, FACTORY, 5), ("T", "v2", p["v2"].upper().replace("0X", "0x"), TARGET, QUOTE, None, None, FACTORY, 5), ("T", "v3", p["v3"], QUOTE, TARGET, 500, 10, FACTORY, 5),
        ("T", "v4", v4, TARGET, QUOTE, 3000, 60, FACTORY, 5), ("T", "v4", FACTORY, TARGET, QUOTE, 3000, 60, FACTORY, 5), ("T", "curve", p["curve"], QUOTE, A(9), None, None, FACTORY, 5),
        ("T", "balancer", p["balancer"], TARGET, QUOTE, None, None, FACTORY, 5), ("T", "v2", p["bad"], TARGET, QUOTE, None, None, OTHER, 5), ("T", "balancer", p["silent"], TARGET, QUOTE, None, None, FACTORY, 5),
        ("T", "v2", p["silent"], None, None, None, None, FACTORY, None),
    ]
    no = (None,) * 6
    said = [
        ("v1", p["v1"], 1, OTHER, TARGET, None, None, None, None, *no[:5]),
        ("v2", p["v2"], 1, OTHER, QUOTE, QUOTE, None, None, None, False, None, None, None, None),  # superseded by what it says later
        ("v2", p["v2"], 2, FACTORY, TARGET, QUOTE, None, None, p["v2"], True, None, None, None, None),
        ("v3", p["v3"], 1, FACTORY, QUOTE, TARGET, 3000, 10, p["v2"], None, 0, True, None, None),
        ("v4", v4, 1, None, None, None, None, None, None, None, 0, True, None, None),
        ("curve", p["curve"], 1, None, None, None, None, None, None, None, None, None, None, V.ZERO),
        ("balancer", p["balancer"], 1, None, None, None, None, None, None, None, None, None, [QUOTE, TARGET], None),
        ("v2", p["bad"], 1, OTHER, TARGET, QUOTE, None, None, p["bad"], True, None, None, None, None),
    ]
    got = verified(spark, found, said, [p["v1"], p["v2"], p["v3"], p["curve"], p["balancer"], p["bad"], FACTORY], (1, 1000))
    passed = {k: (r.n_passed, r.n_checks, r.verified) for k, r in got.items()}
    assert passed["v1", p["v1"]] == (3, 4, True)  # another factory
    assert passed["v2", p["v2"]] == (8, 8, True)
    assert passed["v3", p["v3"]] == (9, 12, True)  # fee, pool by key, no code of the manager
    assert passed["v4", v4] == (5, 7, True)  # no price, no code of the position manager
    assert passed["v4", FACTORY][2] is False and got["v4", FACTORY].verification_confidence == 0  # the manager is no pool
    assert passed["curve", p["curve"]] == (2, 4, True)
    assert passed["balancer", p["balancer"]] == (4, 4, True)
    assert passed["balancer", p["silent"]] == (2, 4, False)  # half of the checks, but not the vault's
    assert got["v2", p["bad"]].verification_confidence == 0 and not got["v2", p["bad"]].verified
    assert passed["v2", p["silent"]] == (1, 8, False) and got["v2", p["silent"]].verification_confidence == 0.125
    assert got["v4", v4].custody_address == FACTORY and got["v2", p["v2"]].custody_address == p["v2"]
    wide = verified(spark, found, said, [p["v2"]], (1, 1001))
    assert wide["v2", p["v2"]].n_checks == 7 and wide["v2", p["v2"]].creation_seen is None
    assert verified(spark, [], said, []) == {} and all(not r.verified or r.n_passed for r in verified(spark, found, [], []).values())


def test_standard_pools(spark):
    zero = "0x" + "0" * 40
    found = spark.createDataFrame(
        [("T", "a", TARGET, QUOTE, 500, 10, zero), ("T", "b", QUOTE, TARGET, 500, 10, A(7)), ("T", "c", QUOTE, TARGET, 500, 60, zero), ("T", "d", TARGET, A(8), 500, 10, zero), ("T", "e", QUOTE, TARGET, 3000, 60, zero), ("T", "f", QUOTE, TARGET, None, None, None)],
        "token_address string, pool_address string, token0 string, token1 string, fee int, tick_spacing int, hooks string",
    )
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = discovery.standard_pools(found, one([("T", TARGET)], "token_address string, target string"), one([(QUOTE,)], "quote string"), one([(500, 10), (3000, 60)], "fee int, tick_spacing int"), one([("e",)], "pool_address string"))
    assert [r.pool_address for r in got.select(F.col("pool_address")).collect()] == ["a"]


def test_no_two_queries_of_one_name():
    import pytest

    with pytest.raises(ValueError, match="two queries"):
        Q.query("swap_volume")(lambda spark, d: None)
