"""Raw logs, exact amounts and chart tables by hand."""

from decimal import Decimal, getcontext

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.functions import abi, ticks
from tidemark.operators import charts, discovery


def word(x):
    return format(x % (1 << 256), "064x")


def test_numbers_of_words(spark):
    values = [0, 1, -1, 10**36, -(10**36), (1 << 119) - 1, 10**60, -(1 << 255), (1 << 255) - 1]
    df = spark.createDataFrame([(i, "0x" + word(v)) for i, v in enumerate(values)] + [(90, None), (91, "0x12")], "i int, w string")
    got = {r.i: r for r in df.select("i", abi.integer(F.col("w")).alias("s"), abi.uint(F.col("w")).alias("u"), abi.number_text("w").alias("t")).collect()}
    for i, v in enumerate(values):
        assert got[i].s == (v if abs(v) < 1 << 120 else None), v
        assert got[i].u == (v if 0 <= v < 1 << 120 else None)
        assert int(got[i].t) == v % (1 << 256)
    assert got[90].s is None and got[90].t is None and got[91].u == 0x12


def test_arrays_of_data(spark):
    data = "0x" + word(64) + word(160) + word(2) + word(7) + word(-9) + word(0)
    cut = data[:-64]
    rows = spark.createDataFrame([(data,), (cut,), (None,), ("0x",), ("0x" + word(32) + word(5),)], "d string")
    two = [abi.array(F.col("d"), k) for k in (0, 1)]
    got = [tuple(r) for r in rows.select(F.transform(two[0], abi.integer).alias("a"), two[1].alias("b")).collect()]
    assert got == [([7, -9], []), ([7, -9], None), (None, None), (None, None), (None, None)]


def test_arrays_that_point_too_far(spark):
    far = [1 << 30, 1 << 36, 1 << 62, 1 << 100, (1 << 256) - 1]
    data = ["0x" + word(x) + word(1) + word(7) for x in far] + ["0x" + word(32) + word(x) + word(7) for x in [2, (1 << 31) - 1, *far]]
    rows = spark.createDataFrame([(d,) for d in data], "d string")
    assert [r.a for r in rows.select(abi.array(F.col("d"), 0).alias("a")).collect()] == [None] * len(data)


def test_long_negative_numbers_are_exact(spark):
    from tidemark.operators import events

    low = -(1 << 118) - 1  # 36 digits, the last not 0
    assert spark.createDataFrame([("0x" + word(low),)], "w string").select(abi.integer(F.col("w"))).first()[0] == low
    raw = spark.createDataFrame([("PoolBalanceChanged", [Decimal(low), Decimal(2)])], "event_name string, deltas array<decimal(38,0)>")
    rows = raw.withColumns({c: F.lit(None).cast("string") for c in (*events.BASE, "pool_address", "sender", "amount0", "amount1") if c != "event_type"})
    assert events.normalize_balancer(rows).first().token0_amount == 2 - low


def test_arrays_are_read_once(spark):
    from tidemark.plans import chain

    plan = chain.vault_changes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(data") == 1 and plan.count("regexp_replace(") < 20


LOGS = "family string, event_name string, address string, topics array<string>, data string, block_number long, transaction_hash string"


def test_one_pool_for_each_family(spark):
    topic = lambda x: "0x" + word(x)
    t, q, z = 0xAAAA, 0xBBBB, 0xCCCC
    bid = "0x" + "5" * 64
    logs = [
        ("v2", "PairCreated", "0xF2", ["0x0", topic(t), topic(q)], "0x" + word(0x22) + word(9), 50, "h2"), ("v2", "PairCreated", "0xF2", ["0x0", topic(t), topic(q)], "0x" + word(0x22) + word(9), 40, "h1"),
        ("v3", "PoolCreated", "0xF3", ["0x0", topic(q), topic(t), topic(500)], "0x" + word(10) + word(0x33), 51, "h3"),
        ("v4", "Initialize", "0xF4", ["0x0", bid, topic(t), topic(q)], "0x" + word(3000) + word(-60) + word(0x77) + word(1) + word(-5), 52, "h4"),
        ("balancer", "TokensRegistered", "0xF5", ["0x0", "0x" + "6" * 64], "0x" + word(64) + word(192) + word(3) + word(q) + word(z) + word(t) + word(0), 53, "h5"),
        ("v2", "PairCreated", "0xF2", ["0x0", topic(q), topic(z)], "0x" + word(0x24), 54, "h6"), ("v2", "Sync", "0xF2", [], None, 55, "h7"), ("v3", "PoolCreated", "0xF3", ["0x0"], "0x", 56, "h8"),
    ]
    address = lambda x: "0x" + word(x)[24:]
    tokens = spark.createDataFrame([("T", address(t).upper().replace("0X", "0x")), ("Z", address(z))], "token_address string, target string")
    got = {(r.token_address, r.family, r.pool_address): r for r in discovery.discover(spark.createDataFrame(logs, LOGS), tokens).collect()}
    assert set(got) == {("T", "v2", address(0x22)), ("T", "v3", address(0x33)), ("T", "v4", bid), ("T", "balancer", "0x" + "6" * 40), ("Z", "v2", address(0x24)), ("Z", "balancer", "0x" + "6" * 40)}
    pair, pool, v4, vault = (next(r for k, r in got.items() if k[:2] == ("T", f)) for f in ("v2", "v3", "v4", "balancer"))
    assert (pair.creation_block, pair.creation_tx, pair.factory, pair.fee) == (40, "h1", "0xf2", None)
    assert (pool.token0, pool.token1, pool.fee, pool.tick_spacing) == (address(q), address(t), 500, 10)
    assert (v4.fee, v4.tick_spacing, v4.hooks, v4.pool_id) == (3000, -60, address(0x77), bid)
    assert vault.tokens == [address(q), address(z), address(t)] and vault.pool_id == "0x" + "6" * 64


def test_changes_of_vault_and_manager(spark):
    logs = [
        ("balancer", "PoolBalanceChanged", "0xV", ["0x0", "0x" + "6" * 64, "0x" + word(1)], "0x" + word(96) + word(192) + word(288) + word(2) + word(1) + word(2) + word(2) + word(5) + word(-7) + word(0), 1, "a"),
        ("v4", "ModifyLiquidity", "0xM", ["0x0", "0x" + "8" * 64, "0x" + word(2)], "0x" + word(-120) + word(60) + word(-(10**30)) + word(10**50), 2, "b"),
    ]
    df = spark.createDataFrame(logs, LOGS)
    vault = discovery.balance_changes(df).first()
    assert (vault.pool_address, vault.deltas, len(vault.tokens)) == ("0x" + "6" * 40, [5, -7], 2)
    change = discovery.liquidity_changes(df).first()
    assert (change.tick_lower, change.tick_upper, change.liquidity_delta, change.nft_token_id, change.salt_id) == (-120, 60, -(10**30), None, str(10**50))


def test_exact_amounts(spark):
    getcontext().prec = 120
    ends = [(-887272, 887272), (-887272, -887271), (887271, 887272), (-60, 60), (0, 10)]
    rows = []
    for lo, hi in ends:
        for at in (-887272, -61, 0, 5, 60, 887272):
            rows.append((str(ticks.root(at)), lo, hi, str(10**30 + 7)))
    rows += [("5", 0, 10, "0"), ("5", 10, 0, "9"), ("5", -887273, 0, "9"), (None, 0, 1, "9")]
    df = spark.createDataFrame(rows, "p string, a int, b int, l string").coalesce(1)
    got = df.select("*", ticks.exact_amounts("p", "a", "b", "l").alias("x")).select("*", "x.*").collect()
    for r in got[:-4]:
        p, n = int(r.p), int(r.l)
        a, b = (int((Decimal("1.0001") ** t).sqrt() * 2**96) for t in (r.a, r.b))
        if p <= a:
            want = (n * (b - a) * 2**96 // (a * b), 0)
        elif p < b:
            want = (n * (b - p) * 2**96 // (p * b), n * (p - a) // 2**96)
        else:
            want = (0, n * (b - a) // 2**96)
        assert (int(r.amount0), int(r.amount1)) == want
    assert [(r.amount0, r.amount1) for r in got[-4:]] == [("0", "0"), ("0", "0"), (None, None), (None, None)]
    assert ticks.root(0) == 2**96 and ticks.root(887273) is None


def test_matrix_of_all_pools(spark):
    rows = spark.createDataFrame([("T", 0, "b", 1, 5), ("T", 0, "b", 2, 7), ("T", 0, "a", 1, 1), ("T", 3600, "c", 1, 2), ("T", 3600, None, 9, 9), ("U", 0, "a", 1, None)], "token_address string, bucket long, pool string, n int, v int")
    last = {(r.token_address, r.bucket): r.m for r in charts.pool_matrix(rows, "bucket", F.col("v"), "m", ["n"]).collect()}
    assert last == {("T", 0): {"a": 1, "b": 7}, ("T", 3600): {"c": 2}}
    assert {r.bucket: r.m for r in charts.pool_matrix(rows, "bucket", F.col("v"), "m").collect()} == {0: {"a": 1, "b": 12}, 3600: {"c": 2}}


def test_details_of_a_point(spark):
    tvl = spark.createDataFrame([("T", 100, "a", 30, 1.5), ("T", 100, "b", 10, None), ("T", 9000, "a", 0, 2.0), ("U", 50, "a", 5, None)], "token_address string, at long, pool string, tvl long, price double")
    volume = spark.createDataFrame([("T", 0, "a", 7), ("T", 3600, "b", 8)], "token_address string, bucket long, pool string, volume long")
    got = {(r.token_address, r.at, r.pool): tuple(r)[5:] for r in charts.point_details(tvl, volume).collect()}
    assert got == {("T", 100, "a"): (75.0, 1.5, 0, 7, True), ("T", 100, "b"): (25.0, None, 0, None, True), ("T", 9000, "a"): (None, 2.0, 3600, None, False), ("U", 50, "a"): (100.0, None, None, None, None)}


def test_positions_of_all_families(spark):
    from tidemark.operators import positions as P

    zero = "0x" + "0" * 40
    pools = spark.createDataFrame([("T", f"p{f}", f"l{f}", f, f != "v1") for f in ("v1", "v2", "curve", "balancer")] + [("T", "pempty", "lempty", "v2", True)], "token_address string, pool_address string, lp_token string, family string, verified boolean")
    events = spark.createDataFrame([("pv2", "a", "pv2"), ("pv2", zero, None), ("pcurve", None, "b"), ("pv1", "a", None), ("pempty", "a", None)], "pool_address string, actor string, recipient string")
    moves = spark.createDataFrame([("lbalancer", zero, "c"), ("other", "d", "e")], "token_address string, from_address string, to_address string")
    big = 3 * 10**27
    ledger = [("lv2", "a", 5, str(big)), ("lv2", "a", 9, str(2 * big)), ("lv2", "a", 11, "1"), ("lv2", "stranger", 5, "9"), ("lcurve", "b", 5, "0"), ("lbalancer", "c", 10, "25"), ("lv1", "a", 5, "5"), ("lempty", "a", 5, "5")]
    ledger = spark.createDataFrame(ledger, "lp_token string, address string, block_number long, balance_raw string")
    supply = spark.createDataFrame([("lv2", 1, str(8 * big)), ("lbalancer", 3, "100"), ("lbalancer", 12, "50"), ("lcurve", 1, "9"), ("lempty", 1, "0")], "lp_token string, block_number long, supply_raw string")
    got = P.lp_token_positions(pools, events, moves, ledger, supply, 10)
    assert {tuple(r) for r in got.collect()} == {("T", "pv2", "a", "lp:lv2", 2 * big, 25.0, "v2_balanceof_at_to_block", 0.95), ("T", "pbalancer", "c", "lp:lbalancer", 25, 25.0, "balancer_bpt_balanceof_at_to_block", 0.9)}
    changes = [("T", "m", 1, -10, 10, "30", "7"), ("T", "m", 2, -10, 10, "-10", "7"), ("T", "m", 2, 50, 60, "5", str(10**50)), ("T", "m", 2, -5, 5, "60", "9"), ("T", "m", 2, -5, 5, "8", "8"), ("T", "m", 3, -5, 5, "-8", "8"), ("T", "m", 99, -5, 5, "8", "7")]
    changes = spark.createDataFrame(changes, "token_address string, pool_address string, block_number long, tick_lower int, tick_upper int, liquidity_delta string, salt_id string")
    owners = spark.createDataFrame([("7", 1, 0, "a"), ("7", 2, 1, "b"), ("7", 2, 0, "x"), (str(10**50), 1, 0, "c"), ("9", 1, 0, zero), ("7", 50, 0, "late")], "token_id string, block_number long, log_index int, owner string")
    salted = P.salt_positions(changes, owners, spark.createDataFrame([("m", 0)], "pool_address string, tick int"), 10)
    assert {tuple(r)[2:6] + (r.confidence,) for r in salted.collect()} == {("b", "v4:7", 20, 25.0, 0.95), ("c", f"v4:{10**50}", 5, 0.0, 0.9)}
    assert P.all_positions(got, salted).count() == 4
    assert {r.owner for r in P.all_positions(got, salted, allowed=spark.createDataFrame([("a",), ("c",)], "owner string")).collect()} == {"a", "c"}
    assert P.all_positions(got, salted, allowed=spark.createDataFrame([], "owner string")).count() == 0


def test_block_windows(spark):
    from tidemark.functions import scalars as S

    df = spark.createDataFrame([(100_000,), (5,), (0,), (None,)], "b long")
    got = [tuple(r) for r in df.select(S.block_window(F.col("b"), 7).alias("a"), S.block_window(F.col("b"), 30, ends=True).alias("z")).collect()]
    assert got == [((100_000, 150_399), (1, 100_000)), ((5, 50_404), (1, 5)), (None, None), (None, None)]
    with pytest.raises(ValueError):
        S.block_window(F.col("b"), 8)


def test_holders_shown(spark):
    from tidemark.operators import holders

    rows = [("T", "a", "eoa", "event_rebuild", 5), ("T", "b", "pool", "event_rebuild", 99), ("T", "c", "eoa", "zero_fill", 9), ("T", "d", "contract", "two_point_snapshot", 7), ("T", "e", "eoa", "event_rebuild", 0), ("U", "a", "eoa", "event_rebuild", 1)]
    df = spark.createDataFrame(rows, "token_address string, address string, address_type string, source string, end_balance long")
    assert [(r.token_address, r.address, r["rank"]) for r in holders.shown_holders(df, 2).orderBy("token_address", "rank").collect()] == [("T", "d", 1), ("T", "a", 2), ("U", "a", 1)]
    kinds = {(r.token_address, r.address_type): (r.addresses, r.holding, int(r.balance), r.filled) for r in holders.holders_by_kind(df).collect()}
    assert kinds == {("T", "eoa"): (3, 2, 14, 1), ("T", "pool"): (1, 1, 99, 0), ("T", "contract"): (1, 1, 7, 0), ("T", None): (5, 4, 120, 1), ("U", "eoa"): (1, 1, 1, 0), ("U", None): (1, 1, 1, 0)}


def test_the_panel_keeps_its_columns(spark):
    from conftest import SF

    import __spark_entry__ as e
    from tidemark.sources import tables

    panel = e.queries()["analysis_series"](spark, SF)
    assert set(panel.columns) == set(tables.SCHEMAS["analysis_series"].names)
    kept = tables.conform(panel, "analysis_series")
    assert {c: k for c, k in kept.dtypes} == {c: k for c, k in panel.dtypes}


def test_wallets_by_recipient_and_first_pair(spark):
    from tidemark.operators import prices, wallets

    one = "1" + "0" * 18
    names = "token_address string, block_number long, log_index int, pool_address string, actor string, recipient string, token0_address string, token1_address string, token0_raw string, token1_raw string, amount_usd double"
    rows = [
        ("T", 1, 0, "elsewhere", None, "r", "TGT", "USDC", one, "5000000", None), ("T", 2, 0, "p2", "", "r", "USDC", "TGT", "7000000", one, None),  # the first pool of the pair, whatever the address
        ("T", 3, 0, "p9", "a", "r", "TGT", "WBTC", one, "1", 100.0), ("T", 4, 0, "p2", "a", None, None, None, one, "3000000", 3.0), ("T", 5, 0, "p1", None, None, "TGT", "USDC", one, "2000000", None),
        ("T", 6, 0, "p1", "p1", "r", "TGT", "USDC", one, "9000000", None),
    ]
    pools = spark.createDataFrame([("p1", 0, "TGT", "USDC"), ("p2", 1, "TGT", "USDC")], "pool_address string, ordinal int, token0 string, token1 string")
    priced = prices.priced_swaps(spark.createDataFrame(rows, names), pools, resolve=prices.first_pair)
    assert {r.block_number: r.pool for r in priced.collect()} == {1: "p1", 2: "p1", 3: None, 4: "p2", 5: "p1", 6: "p1"}
    got = {r.actor: r for r in wallets.wallet_stats(priced, spark.createDataFrame([("p1",)], "address string")).collect()}
    assert set(got) == {"r", "a"}
    assert (got["r"].swap_count, got["r"].sold_usd, got["r"].bought_usd, got["r"].net_usd) == (2, 5.0, 7.0, 2.0)
    assert (got["a"].swap_count, got["a"].total_usd) == (1, 3.0)  # the swap of no pool is left out
    assert got["a"].market_usd == 5 + 7 + 3 + 2 + 9  # those of nobody and of infrastructure are in the market


def test_total_of_pools(spark):
    rows = [("T", 0, "a", 1, 10.0, None), ("T", 0, "a", 2, 20.0, 7.0), ("T", 0, "b", 1, 5.0, None), ("T", 9, "b", 3, None, None), ("U", 0, "a", 1, 4.0, None)]
    df = spark.createDataFrame(rows, "token_address string, at long, pool string, n int, tvl double, tvl_usd double")
    got = {(r.token_address, r.at): (r.total, r.pools, r.unit) for r in charts.total_series(df, "at", ["n"]).collect()}
    assert got == {("T", 0): (12.0, 2, "USD"), ("T", 9): (0.0, 1, "USD"), ("U", 0): (4.0, 1, "token")}
