"""As-of joins, ranks and running states by ranges, against loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, prices, states
from tidemark.operators.asof import asof_join, last_known
from tidemark.sources.tables import conform


@pytest.mark.parametrize("fill", [False, True])
def test_asof_over_many_ranges(spark, fill):
    rng = random.Random(4)
    left = [(rng.choice(["a", "b", None, "lonely"]), rng.randrange(60) if rng.random() < 0.95 else None, i) for i in range(300)]
    right = [(k, rng.randrange(5, 55), rng.randrange(1000)) for k in ["a"] * 12 + ["b"] * 3 + [None] * 4]
    got = asof_join(spark.createDataFrame(left, "k string, t long, i int"), spark.createDataFrame(right, "k string, u long, v long"), ["k"], "t", "u", ["v"], fill_first=fill, span=4)
    for r in got.collect():
        want = None
        if r.t is not None:
            mine = sorted((u, v) for k, u, v in right if k == r.k)
            before = [x for x in mine if x[0] <= r.t]
            want = before[-1][1] if before else None
            if fill and not before and mine:
                want = max(v for u, v in mine if u == mine[0][0])
        assert r.v == want, r
    assert got.count() == len(left)


def test_last_known(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(40), i, float(i) if rng.random() < 0.2 else None) for i in range(200)]
    got = last_known(spark.createDataFrame(rows, "k string, t long, i long, p double"), ["k"], "t", "i", F.col("p"), "q", span=5).collect()
    assert len(got) == 200
    for r in got:
        known = [(t, i, p) for k, t, i, p in rows if k == r.k and t <= r.t and p is not None]
        assert r.q == (max(known)[2] if known else None)


def test_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), rng.choice([1.0, 2.0, 2.5, 7.0, 9.0, None]) if i % 2 else float(i % 37), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = ordered.average_rank(ordered.percentile_rank(df, ["k"], "v", "pct"), ["k"], "v", "mean").collect()
    assert len(got) == 500
    for r in got:
        mine = sorted(v for k, v, _ in rows if k == r.k and v is not None)
        if r.v is None:
            assert r.pct is None and r.mean is None
            continue
        lo, hi = bisect.bisect_left(mine, r.v), bisect.bisect_right(mine, r.v)
        assert r.pct == pytest.approx(100 * hi / len(mine)) and r.mean == (lo + 1 + hi) / 2


def test_numbers_by_range(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.randrange(20), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = ordered.numbered(df, ["k"], [F.desc("v"), "i"], {"place": F.lit(True), "odd": F.col("v") % 2 == 1}).collect()
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        have = {r.i: (r.place, r.odd) for r in got if r.k == k}
        odd = 0
        for n, r in enumerate(mine, 1):
            odd += r[1] % 2
            assert have[r[2]] == (n, odd)


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_clamped_states(spark, span):
    rng = random.Random(8)
    rows, want = [], {}
    for key in ("p", "q"):
        run = 0
        for i in range(120):
            kind = "set" if rng.random() < (0.08 if key == "p" else 0) else "add"
            x = rng.randrange(0, 30) if kind == "set" else rng.randrange(-20, 18)
            rows.append((key, rng.randrange(2) + 2 * i, i % 3, kind, x))
            run = x if kind == "set" else max(0, run + x)
            want[(key, rows[-1][1])] = run
    df = spark.createDataFrame(rows, "k string, block_number long, log_index int, kind string, x long")
    steps = {"state": (F.when(F.col("kind") == "set", F.col("x")), F.when(F.col("kind") == "add", F.col("x")))}
    got = ordered.clamped(df, ["k"], ["block_number", "log_index"], steps, span=span).collect()
    assert {(r.k, r.block_number): int(r.state) for r in got} == want


EVENT = "token_address string, pool_address string, block_number long, log_index int, block_timestamp long, event_type string, source_event string, token0_amount string, token1_amount string, liquidity_delta string, amount_usd double"
POOL = "pool_address string, protocol string, version string, token0 string, token1 string, verified boolean"
TOKENS = "token_address string, target string, decimals int"
QUOTES = "quote string, decimals int, stable boolean"


def test_reserves_of_two_sides(spark):
    """Three tokens of 18, 6 and 8 decimals in one job; amounts beyond 64 bits; ranges of three blocks."""
    meta = {"a": ("xa", 18), "b": ("xb", 6), "c": ("xc", 8)}
    pools = [(f"p{t}", "u", "v2", x if t != "b" else "usdc", "usdc" if t != "b" else x, True) for t, (x, _) in meta.items()] + [("pz", "u", "v2", "xa", "usdc", False), ("pd", "u", "v2", "xa", "dai", True)]
    rng, rows, want = random.Random(9), [], {}
    for t, (_, dec) in meta.items():
        r0 = r1 = 0
        d0, d1 = (dec, 6) if t != "b" else (6, dec)
        for i in range(60):
            kind = rng.choice(["SWAP", "SWAP", "LIQUIDITY_ADD", "LIQUIDITY_REMOVE", "SYNC"] if i else ["LIQUIDITY_ADD"])
            a0, a1 = rng.randrange(1, 10**6) * 10**d0, rng.randrange(1, 10**6) * 10**d1
            if kind == "SWAP":
                a0, a1 = rng.choice([(a0, -a1), (-a0, a1)])
                r0, r1 = max(0, r0 + a0), max(0, r1 + a1)
            elif kind == "SYNC":
                r0, r1 = a0, a1
            elif kind == "LIQUIDITY_ADD":
                r0, r1 = r0 + a0, r1 + a1
            else:
                r0, r1 = max(0, r0 - a0), max(0, r1 - a1)
            rows.append((t, f"p{t}", i, 0, i, kind, "Sync" if kind == "SYNC" else kind, str(a0), str(a1), None, 5.0 if kind == "SWAP" else None))
            mine, other = (r0, r1) if t != "b" else (r1, r0)
            moved = abs(a0 if t != "b" else a1) / 10**dec
            want[(t, i)] = (r0, r1, 2 * mine, (other / 1e6) / (mine / 10**dec) if mine and other else None, 5.0 / moved if kind == "SWAP" else None)
    rows += [("a", "pz", 1, 0, 1, "SWAP", "Swap", "5", "5", None, None), ("a", "pa", 1, 7, 1, "OTHER", "x", "5", "5", None, None)]
    events = spark.createDataFrame(rows, EVENT)
    tokens, quotes = spark.createDataFrame([(t, *m) for t, m in meta.items()], TOKENS), spark.createDataFrame([("usdc", 6, True)], QUOTES)
    got = states.tvl_events_v2(events, spark.createDataFrame(pools, POOL), tokens, quotes).collect()
    assert len(got) == 180
    for r in got:
        w = want[(r.token_address, r.block_number)]
        assert (int(r.reserve0), int(r.reserve1), int(r.tvl_in_token)) == w[:3] and r.quote == "usdc"
        assert r.price == pytest.approx(w[3]) and r.price_usd == pytest.approx(w[4])


def test_liquidity_of_concentrated_pools(spark):
    pools = [("p", "u", "v3", "usdc", "xa", True), ("m", "u", "v4", "xa", "usdc", True)]
    rows = [
        ("a", "p", 1, 0, 1, "LIQUIDITY_ADD", "Mint", "7000000", "-3" + "0" * 18, "1" + "0" * 25, None), ("a", "p", 2, 0, 2, "SWAP", "Swap", "4000000", "-2" + "0" * 18, None, 6.0),
        ("a", "p", 3, 0, 3, "LIQUIDITY_REMOVE", "Burn", "1", "5", "-2" + "0" * 25, None), ("a", "p", 4, 0, 4, "LIQUIDITY_ADD", "Mint", None, None, "9", None), ("a", "p", 5, 0, 5, "SWAP", "Swap", "0", "5", None, 1.0),
        ("a", "m", 1, 0, 1, "LIQUIDITY_ADD", "ModifyLiquidity", None, None, "5", None),
    ]
    tokens, quotes = spark.createDataFrame([("a", "xa", 18)], TOKENS), spark.createDataFrame([("usdc", 6, True)], QUOTES)
    got = {(r.pool_address, r.block_number): r for r in states.tvl_events_v3(spark.createDataFrame(rows, EVENT), spark.createDataFrame(pools, POOL), tokens, quotes).collect()}
    assert [int(got["p", b].liquidity) for b in range(1, 6)] == [10**25, 10**25, 0, 9, 9]
    # twice the target's side of an addition, once of a swap
    assert [int(got["p", b].tvl_in_token) for b in range(1, 6)] == [6 * 10**18, 2 * 10**18, 10, 0, 5]
    assert (got["p", 2].price, got["p", 2].price_usd, got["p", 2].quote) == (2.0, 3.0, "usdc")
    assert got["p", 5].price is None and got["p", 1].price is None and int(got["m", 1].liquidity) == 5


def test_logs_to_prices(spark):
    """Normalised amounts keep their name through the tables; sides follow event, pool order or magnitude."""
    rows = [
        ("a", 1, 0, 1, "h", "SWAP", "u", "v3", "pa", "w", None, "Swap", "3" + "0" * 24, "6000000"), ("b", 1, 0, 1, "h", "SWAP", "u", "v3", "pb", "w", None, "Swap", "6000000", "2000000"),
        ("c", 1, 0, 1, "h", "SWAP", "u", "v3", "pc", "w", None, "dex.trades", "5" + "0" * 8, "1" + "0" * 18), ("z", 1, 0, 1, "h", "SWAP", "u", "v3", "pa", "w", None, "Swap", "1", "1"),
    ]
    names = "token_address string, block_number long, log_index int, block_timestamp long, transaction_hash string, event_type string, protocol string, version string, pool_address string, actor string, recipient string, source_event string, token0_amount string, token1_amount string"
    swaps = conform(spark.createDataFrame(rows, names), "swaps")
    assert [r.token0_raw for r in swaps.where("token_address = 'a'").collect()] == ["3" + "0" * 24]
    pools = spark.createDataFrame([("pa", "u", "v3", "xa", "usdc", True), ("pb", "u", "v3", "usdc", "xb", True), ("pc", "u", "v3", "weth", "xc", True)], POOL)
    tokens = spark.createDataFrame([("a", "xa", 18), ("b", "xb", 6), ("c", "xc", 8)], TOKENS)
    quotes = spark.createDataFrame([("usdc", 6, True), ("weth", 18, False)], QUOTES)
    got = {r.token_address: r for r in prices.priced_swaps(swaps, pools, tokens=tokens, quotes=quotes).collect()}
    assert (got["a"].target, got["a"].quote_amount, got["a"].price, float(got["a"].usd)) == (3e6, 6.0, 2e-6, 6.0)
    assert (got["b"].side, got["b"].target, got["b"].price) == (1, 2.0, 3.0)
    # the aggregator's order is not the pool's: 5e8 is nearer to eight decimals
    assert (got["c"].side, got["c"].target, got["c"].quote, got["c"].price, got["c"].usd) == (0, 5.0, "weth", 0.2, None)
    assert got["z"].side is None and got["z"].target is None and got["z"].usd is None
