"""Exact small cases."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import holders, market, research, wallets
from tidemark.operators.asof import asof_join
from tidemark.sources import tables


def test_trajectory(spark):
    ledger = spark.createDataFrame([("T", "a", 90, 100), ("T", "a", 110, 500), ("T", "a", 120, 80), ("T", "b", 50, 7), ("T", "c", 100, 40), ("T", "c", 101, 50)], "token_address string, address string, block_number long, balance_raw long")
    rows = {r.address: tuple(r)[2:] for r in holders.balance_trajectory(ledger, 100, 130).collect()}
    assert rows["a"] == (100, 80, 500, 400, 420, "event_rebuild")
    assert rows["b"] == (7, 7, 7, 0, 0, "two_point_snapshot")
    assert rows["c"] == (40, 50, 50, 10, 0, "event_rebuild")


@pytest.mark.parametrize("xs, ys, r", [([2, 7, 11, 30], [5, 15, 23, 61], 1.0), ([2, 7, 11, 30], [-4, -14, -22, -60], -1.0), ([4, 4, 4], [8, 1, 3], None), ([6, 9], [1, 4], None)])
def test_correlations(spark, xs, ys, r):
    df = spark.createDataFrame([("T", float(x), float(y)) for x, y in zip(xs, ys, strict=True)], "t string, x double, y double")
    assert research.pearson(df, "x", "y", ["t"]).first().r == r
    assert research.spearman(df, "x", "y", ["t"]).first().r == r


def test_lag_sign(spark):
    xs = [3, 1, 4, 1, 5, 9, 2, 6]
    ys = [99, *xs[:-1]]
    df = spark.createDataFrame([("T", i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], "t string, i int, x double, y double")
    best = research.lead_lag(df, "x", "y", "i", ["t"], max_lag=2).first()
    assert (best.lag, best.r) == (1, 1.0)


def test_ohlc_vwap(spark):
    rows = [("T", 1, 0, 10, "TGT", "USDC", 10, 5, 100_000), ("T", 2, 0, 20, "TGT", "USDC", 10, 5, 200_000), ("T", 3, 0, 30, "TGT", "USDC", 80, 5, 2_400_000)]
    swaps = spark.createDataFrame([(*r[:4], "p1", *r[4:]) for r in rows], "token_address string, block_number long, log_index int, block_timestamp long, pool_address string, token0_address string, token1_address string, token0_amount long, token1_amount long, amount_usd_e4 long")
    pools = spark.createDataFrame([("p1", "TGT", "USDC")], "pool_address string, token0 string, token1 string")
    r = market.ohlc_vwap(market.resolved_swaps(swaps, pools), ["token_address"]).first()
    unit = 10_000 * 1_000_000
    assert (r.open_e6, r.high_e6, r.low_e6, r.close_e6, r.volume) == (unit, 3 * unit, unit, 3 * unit, 100)
    assert r.vwap == 2.7 * 10_000


def test_ambiguous_pool_is_never_guessed(spark):
    swaps = spark.createDataFrame([("manager", "TGT", "USDT")], "pool_address string, token0_address string, token1_address string")
    pools = spark.createDataFrame([("p4", "TGT", "USDT"), ("p5", "TGT", "USDT")], "pool_address string, token0 string, token1 string")
    assert market.resolve_swap_pool(swaps, pools).first().pool is None


def test_asof(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("z", 5)], "k string, t long")
    right = spark.createDataFrame([("k", 5, 50), ("k", 7, 70)], "k string, u long, v long")
    assert {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"]).collect()} == {("k", 1): None, ("k", 5): 50, ("k", 9): 70, ("z", 5): None}
    assert {r.t: r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"], fill_first=True).where("k = 'k'").collect()} == {1: 50, 5: 50, 9: 70}


def test_exclusive_percentile(spark):
    df = spark.createDataFrame([("T", v) for v in (1, 2, 3, 10)], "token_address string, v long")
    assert wallets.exclusive_percentile(df, "v").first().value == 10


def test_clamp(spark):
    deltas = [5, -9, 4, -1, -10, 3]
    df = spark.createDataFrame([("T", "p", i, 0, d) for i, d in enumerate(deltas)], "token_address string, pool_address string, block_number long, log_index int, liquidity_delta long")
    run, want = 0, []
    for d in deltas:
        run = max(0, run + d)
        want.append(run)
    assert [r.liquidity for r in market.clamped_liquidity(df).orderBy("block_number").collect()] == want


def test_graph_edges(spark):
    schema = "token_address string, transaction_hash string, from_address string, to_address string, amount_raw long"
    both = spark.createDataFrame([("T", "1", "a", "b", 100), ("T", "2", "b", "a", 100)], schema)
    assert wallets.reciprocal_edges(both).count() == 1
    assert wallets.repeated_edges(spark.createDataFrame([("T", str(i), "a", "b", 100) for i in range(3)], schema)).count() == 1
    assert wallets.repeated_edges(spark.createDataFrame([("T", str(i), "a", "b", v) for i, v in enumerate((1, 10, 100))], schema)).count() == 0


def test_scalars(spark):
    r = spark.sql("select '1700000000' a, '1700000000000' b, '2024-01-02 03:04:05' c, 'x' d").select(*[S.parse_timestamp(F.col(c)).alias(c) for c in "abcd"]).first()
    assert tuple(r) == (1_700_000_000, 1_700_000_000, 1_704_164_645, 0)
    x = spark.sql("select pow(2D, 97) as s").select(S.sqrt_price_to_price(F.col("s"), F.lit(0), F.lit(0)).alias("p"), S.bucket_ts(F.lit(-5), 3600).alias("z"), S.chart_span(F.lit(50_000)).alias("w")).first()
    assert math.isclose(x.p, 4.0) and x.z == 0 and x.w == "week"


def test_tables(spark, tmp_path):
    raw = spark.createDataFrame([("T", "12", " 0xAB ", "7", "junk")], "token_address string, block_number string, pool_address string, tvl_raw string, extra string")
    tables.write_table(raw, str(tmp_path), "tvl_points", kind="both")
    r = tables.read_table(spark, str(tmp_path), "tvl_points", where="block_number = 12").first()
    assert (r.block_number, r.pool_address, r.tvl_raw, r.tvl_usd) == (12, "0xab", "7", None)
    (tmp_path / "tvl_points").rename(tmp_path / "gone")
    assert tables.read_table(spark, str(tmp_path), "tvl_points", columns=["tvl_raw"]).first().tvl_raw == "7"  # from JSON
    flat = spark.createDataFrame([(1, "p", 5), (1, "q", 6)], "bucket long, pool string, volume long")
    assert tables.flatten_volume(tables.inflate_volume(flat)).count() == 2
    assert tables.query_tables(spark, "select count(*) n from {t} where volume > :v", {"t": flat}, {"v": 5}).first().n == 1


@pytest.mark.parametrize("name", sorted(tables.SCHEMAS))
def test_conform_gives_the_declared_columns(spark, name):
    out = tables.conform(spark.createDataFrame([("T", "")], "token_address string, junk string"), name)
    assert out.schema.names == tables.SCHEMAS[name].names
    row = out.first()
    assert row.token_address == "t" and all(row[c] == "0" for c in tables.ZERO_RAW.get(name, ()))


def test_conformed_tables_feed_the_operators(spark, tmp_path):
    from tidemark.operators import prices

    pools = spark.createDataFrame([("p1", "p1", "tgt", "USDC", "v3", 0, True)], POOLS)
    rows = [("T", 1, 0, 10, "P1", "a", "TGT", "USDC", "2" + "0" * 24, "5" + "0" * 12, 5e6)]
    tables.write_table(spark.createDataFrame(rows, SWAPS), str(tmp_path), "swaps")
    got = prices.priced_swaps(tables.read_table(spark, str(tmp_path), "swaps"), pools, target="tgt").first()
    assert (got.pool, got.target, got.price) == ("p1", 2e6, 2.5)


def test_other_sources(spark, tmp_path):
    line = '{"token_address": "T", "block_number": 1, "log_index": 2, "transaction_hash": "0xA", "event_type": "SWAP", "token0_raw": "5"}\n'
    (tmp_path / "a.jsonl").write_text(line + line)
    rows = tables.read_event_lines(spark, f"{tmp_path}/*.jsonl", "swaps").collect()
    assert [(r.token0_raw, r.token1_raw, r.transaction_hash) for r in rows] == [("5", "0", "0xa")]
    for k, text in enumerate(('[{"pool": "0xP", "token0": "X", "token1": "TGT"}]', '{"data": [{"address": "0xP", "token0": "X", "token1": "Y"}]}')):
        (tmp_path / f"pools{k}.json").write_text(text)
        r = tables.read_pools_file(spark, f"{tmp_path}/pools{k}.json", "tgt").first()
        assert (r.pool_address, r.matches) == ("0xp", k == 0)
    tables.write_summary(spark, f"{tmp_path}/s", holders=3, name="x")
    assert tables.read_summary(spark, f"{tmp_path}/s") == {"holders": 3, "name": "x"}
    assert tables.read_summary(spark, f"{tmp_path}/none", {"holders": 0}) == {"holders": 0}
    tables.write_csv(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), f"{tmp_path}/c", ["v", "k"], ["k"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()] == [("a", "1"), ("b", "2")]
    assert tables.registry(spark, [("u", "v2", "0xF", True), ("u", "v1", "0xG", False)]).first().factory == "0xf"


LOG = "token_address string, block_number long, log_index int, block_timestamp long, transaction_hash string, event_name string, pool_address string, sender string, recipient string, token_id long"
NUMBERS = ["amount0", "amount1", "amount0_in", "amount0_out", "amount1_in", "amount1_out", "liquidity", "delta"]


def raw_log(spark, *rows):
    schema = LOG + "".join(f", {n} string" for n in NUMBERS)
    return spark.createDataFrame([("T", i, 0, 9, "x", name, "p", "a", "b", 7, *[str(values[n]) if n in values else None for n in NUMBERS]) for i, (name, values) in enumerate(rows)], schema)


def amounts(rows):
    number = lambda x: None if x is None else int(x)
    return [(r.event_type, number(r.token0_amount), number(r.token1_amount), number(r.liquidity_delta)) for r in rows.orderBy("block_number").collect()]


def test_normalizers(spark):
    from tidemark.operators import events

    v1 = raw_log(spark, ("EthPurchase", {"amount0": 3, "amount1": -8}), ("TokenPurchase", {"amount0": 3, "amount1": -8}), ("RemoveLiquidity", {"amount0": 3, "amount1": 8}), ("Other", {}))
    assert amounts(events.normalize_v1(v1)) == [("SWAP", 0, 8, None), ("SWAP", 8, 0, None), ("LIQUIDITY_REMOVE", 3, 8, None)]
    v2 = raw_log(spark, ("Swap", {"amount0_in": 5, "amount0_out": 0, "amount1_in": 0, "amount1_out": 7}), ("Burn", {"amount0": 2, "amount1": 4}), ("Sync", {}))
    assert amounts(events.normalize_v2(v2)) == [("SWAP", 5, -7, None), ("LIQUIDITY_REMOVE", 2, 4, None)]
    v3 = raw_log(spark, ("Swap", {"amount0": -5, "amount1": 9}), ("Burn", {"amount0": 1, "amount1": 2, "liquidity": 30}), ("Collect", {"amount0": 1, "amount1": 2}))
    assert amounts(events.normalize_v3_pool(v3)) == [("SWAP", 5, 9, None), ("LIQUIDITY_REMOVE", 1, 2, -30), ("COLLECT_FEES", 1, 2, None)]
    known = spark.createDataFrame([(7, "pool7")], "token_id long, pool_address string")
    nft = events.normalize_v3_position(raw_log(spark, ("Transfer", {}), ("DecreaseLiquidity", {"amount0": 1, "amount1": 2, "liquidity": 30})), known)
    assert amounts(nft) == [("POSITION_TRANSFER", None, None, None), ("LIQUIDITY_REMOVE", 1, 2, -30)] and {r.pool_address for r in nft.collect()} == {"pool7"}
    v4 = events.normalize_v4_pool(raw_log(spark, ("ModifyLiquidity", {"delta": -5}), ("ModifyLiquidity", {"delta": 0}), ("Swap", {"amount0": -4, "amount1": 6}), ("ModifyLiquidity", {"delta": "9" * 60})), spark.createDataFrame([("p", "v4")], "pool_address string, version string"))
    got = amounts(v4)
    assert got[:3] == [("LIQUIDITY_REMOVE", None, None, -5), ("LIQUIDITY_ADD", None, None, 0), ("SWAP", 4, 6, None)]
    assert got[3][3] is None  # beyond 38 digits: unknown, not 0
    curve = events.normalize_curve(raw_log(spark, ("RemoveLiquidityOne", {"amount0": 4, "amount1": 9}), ("TokenExchange", {"amount0": 4, "amount1": 9})))
    assert amounts(curve) == [("LIQUIDITY_REMOVE", 4, 0, None), ("SWAP", 4, 9, None)]
    change = raw_log(spark, ("PoolBalanceChanged", {}), ("PoolBalanceChanged", {})).withColumn("deltas", F.when(F.col("block_number") == 0, F.array(F.lit(-3), F.lit(0))).otherwise(F.array(F.lit(-3), F.lit(4))))
    assert amounts(events.normalize_balancer(change)) == [("LIQUIDITY_REMOVE", 3, 0, None), ("LIQUIDITY_ADD", 7, 0, None)]


def test_liquidity_status(spark):
    from tidemark.operators import events

    rows = [("v4", None, None, None, "-5", None, None), ("v4", None, None, None, "0", 3, None), ("v3", "LIQUIDITY_ADD", "0", "0", "0", None, None), ("v2", "LIQUIDITY_ADD", None, None, "9", None, None), ("v2", "LIQUIDITY_ADD", None, None, "9", None, "quantified")]
    got = events.normalize_liquidity(spark.createDataFrame(rows, "version string, event_type string, token0_amount string, token1_amount string, liquidity_delta string, event_count int, quantification_status string")).collect()
    assert [(r.event_type, r.quantification_status, r.event_count) for r in got] == [("LIQUIDITY_REMOVE", "liquidity_delta_only", 1), ("LIQUIDITY_ADD", "unmapped", 3), ("LIQUIDITY_ADD", "quantified", 1), ("LIQUIDITY_ADD", "unmapped", 1), ("LIQUIDITY_ADD", "quantified", 1)]


SWAPS = "token_address string, block_number long, log_index int, block_timestamp long, pool_address string, actor string, token0_address string, token1_address string, token0_raw string, token1_raw string, amount_usd double"
POOLS = "pool_address string, custody_address string, token0 string, token1 string, version string, ordinal int, verified boolean"


def test_amounts_of_many_digits(spark):
    from tidemark.operators import prices

    pools = spark.createDataFrame([("p1", "p1", "TGT", "USDC", "v3", 0, True), ("p2", "p2", "WETH", "TGT", "v3", 1, True)], POOLS)
    rows = [("T", 1, 0, 10, "p1", "a", "TGT", "USDC", "2" + "0" * 24, "5" + "0" * 12, None), ("T", 2, 0, 20, "p2", "b", "WETH", "TGT", "3" + "0" * 18, "6" + "0" * 18, 90.0), ("T", 3, 0, 30, "p2", "b", "WETH", "TGT", "0", "1" + "0" * 18, None), ("T", 4, 0, 40, "p2", "b", "WETH", "TGT", "1", "9" * 60, None)]
    got = prices.priced_swaps(spark.createDataFrame(rows, SWAPS), pools).orderBy("block_number").collect()
    assert (got[0].target, got[0].quote_amount, got[0].price, got[0].unit, float(got[0].usd)) == (2e6, 5e6, 2.5, "USDC", 5e6)
    assert (got[1].target, got[1].price, got[1].unit, got[1].side, float(got[1].usd)) == (6.0, 15.0, "USD", 1, 90.0)
    assert got[2].price is None and float(got[2].usd) == 15.0  # one target at the pool's last price
    assert got[3].target is None and got[3].usd is None  # too long a number is unknown, not 0


def test_target_side(spark):
    from tidemark.functions import money as M

    rows = [("TGT", "X", None, None, "5", "7", "log"), ("X", "TGT", None, None, "5", "7", "log"), (None, None, "X", "TGT", "5", "7", "log"), (None, None, "TGT", "X", "3" + "0" * 18, "4" + "0" * 6, "dex.trades"), (None, None, "TGT", "X", "5", "5", "dex.trades"), (None, None, "X", "Y", "5", "5", "log")]
    df = spark.createDataFrame(rows, "t0 string, t1 string, p0 string, p1 string, a0 string, a1 string, s string")
    side = M.target_side(*[F.col(c) for c in ("t0", "t1", "p0", "p1", "a0", "a1", "s")], F.lit("TGT"), F.lit(18))
    assert [r.side for r in df.select(side.alias("side")).collect()] == [0, 1, 1, 0, None, None]


def test_money_functions(spark):
    from tidemark.functions import money as M

    salt = "0x" + "0" * 60 + "00ff"
    r = spark.range(1).select(
        M.v2_price(F.lit("2000000000000000000"), F.lit("5000000"), F.lit(18), F.lit(6)).alias("p"), M.salt_to_token_id(F.lit(salt)).alias("salt"), M.salt_to_token_id(F.lit("0x" + "f" * 64)).alias("big"), M.pool_id_hex(F.lit("0xAB")).alias("id"),
        M.expected_tick_spacing(F.lit(3000)).alias("t"), M.canonical_protocol(F.lit("Uniswap_v3")).alias("c"), M.version_of_method(F.lit("swapV3x")).alias("v"), M.positive_balance(F.lit("0"), F.lit(5.0)).alias("b"), M.overflows(F.lit("9" * 39)).alias("o"), M.quote_decimals(F.lit("USDC")).alias("d"),
    ).first()
    assert (r.p, r.salt, r.big, r.id, r.t, r.c, r.v, r.b, r.o, r.d) == (2.5, "255", None, "0x" + "0" * 62 + "ab", 60, "uniswap", "v3", False, True, 6)


def test_wallet_flags(spark):
    schema = "token_address string, actor string, swap_count long, max_single_usd double, net_usd double, total_usd double, market_usd double"
    stats = spark.createDataFrame([("T", f"u{i}", 1, float(i), float(i), float(i), 100.0) for i in range(1, 10)] + [("T", "whale", 9, 500.0, -500.0, 900.0, 100.0), ("S", "one", 3, 5.0, 5.0, 5.0, 5.0)], schema)
    got = {r.actor: r for r in wallets.wallet_flags(stats).collect()}
    assert (got["whale"].n_flags, got["whale"].notable, got["whale"].score) == (4, True, 100.0)
    assert got["one"].n_flags == 0  # one value only: no flag
    assert got["u9"].n_flags == 0
    fixed = {r.actor: r for r in wallets.wallet_flags(stats, fixed={"large_trade": 8.0, "large_mover": 1000.0, "high_activity": 1000.0}, volume_ratio=0.05).collect()}
    assert fixed["u8"].large_trade and fixed["u8"].notable and not fixed["u7"].large_trade
    assert fixed["u5"].market_share and not fixed["u5"].notable  # the ratio is information only
    rank = wallets.wallet_ranking(wallets.wallet_flags(stats), top_n=2).where("token_address = 'T'").orderBy("rank").collect()
    assert [r.actor for r in rank] == ["whale", "u9", "u8"]


def test_signed_flow(spark):
    pools = spark.createDataFrame([("p", "WETH", "TGT")], "pool_address string, token0 string, token1 string")
    raw = spark.createDataFrame([("T", 1, 0, "x", "s", "p", "-2" + "0" * 18, "8" + "0" * 18), ("T", 2, 0, "y", "s", "p", "1", "-4" + "0" * 18)], "token_address string, block_number long, log_index int, transaction_hash string, actor string, pool_address string, amount0 string, amount1 string")
    signed = wallets.signed_swaps(raw, pools, "TGT")
    assert [(r.direction, r.price) for r in signed.orderBy("block_number").collect()][0] == ("SELL", 0.25)
    moves = spark.createDataFrame([("T", "x", 1, 1, "s", "p", 8 * 10**18), ("T", "x", 1, 1, "s", "p", 8 * 10**18), ("T", "z", 1, 3, "p", "q", 5)], "token_address string, transaction_hash string, log_index int, block_number long, from_address string, to_address string, amount_raw long")
    deltas = wallets.pool_transfer_deltas(moves, spark.createDataFrame([("T", "p")], "token_address string, pool_address string"), signed)
    flows = {r.transaction_hash: r for r in wallets.tx_flows(signed, deltas).collect()}
    assert int(flows["x"].gap) == 0 and int(flows["y"].gap) == 4 * 10**18 and int(flows["z"].transfer_delta) == -5 and not flows["z"].has_swap
    senders = wallets.sender_flows(wallets.tx_flows(signed, deltas)).first()
    assert (int(senders.sell), int(senders.buy), int(senders.net), int(senders.actual)) == (8 * 10**18, 4 * 10**18, 4 * 10**18, 8 * 10**18)
    change = spark.createDataFrame([("T", 8 * 10**18 - 5)], "token_address string, balance_change long")
    total = wallets.flow_reconciliation(wallets.tx_flows(signed, deltas), wallets.sender_flows(wallets.tx_flows(signed, deltas)), change).first()
    assert total.exact and int(total.other_net) == -5 and total.top_share == 1.0


def test_cluster_signals(spark):
    schema = "token_address string, a string, b string"
    one = lambda *rows: spark.createDataFrame([("T", *r) for r in rows], schema)
    edges = wallets.edge_confidence(one(("a", "b")), one(("a", "b")), one(("b", "c")), one(("c", "d")), one(("a", "b"), ("x", "y")))
    got = {(r.a, r.b): (r.score_pct, r.level, r.signals) for r in edges.collect()}
    assert got == {("a", "b"): (80, "high", "owner,reciprocal"), ("b", "c"): (15, "low", "repeated"), ("c", "d"): (20, "low", "gas_payer")}
    rows = wallets.cluster_confidence(wallets.wallet_clusters(edges, tables.checkpointed), edges).collect()
    assert {(r.address, r.cluster, r.score_pct, r.size) for r in rows} == {(x, "a", 99, 4) for x in "abcd"}
    owners = spark.createDataFrame([("c1", "o"), ("c2", "o"), ("c3", "o"), ("k", "z")], "contract string, owner string")
    candidates = spark.createDataFrame([("T", x) for x in ("c1", "c2", "c3", "o", "k")], "token_address string, address string")
    found = {(r.a, r.b) for r in wallets.owner_edges(candidates, owners).collect()}
    assert found == {("c1", "o"), ("c2", "o"), ("c3", "o"), ("c1", "c2"), ("c1", "c3")}


TOKENS = "token_address string"


@pytest.mark.parametrize("block, score", [(701, 1.0), (700, 0.8), (1, 0.8), (None, 0.0)])
def test_proximity_bands_start_strictly(spark, block, score):
    tokens, incident = spark.createDataFrame([("T",)], TOKENS), spark.createDataFrame([("T", 1000)], TOKENS + ", incident_block long")
    liq = spark.createDataFrame([("T", "LIQUIDITY_REMOVE", 5000 if block is None else block)], TOKENS + ", event_type string, block_number long")
    assert research.temporal_proximity(tokens, liq, incident).first().score == score


def test_proximity_far_and_without_incident(spark):
    tokens = spark.createDataFrame([("T",), ("U",), ("V",)], TOKENS)
    liq = spark.createDataFrame([("T", "LIQUIDITY_REMOVE", 1)] * 3 + [("U", "LIQUIDITY_REMOVE", 100_000)], TOKENS + ", event_type string, block_number long")
    incident = spark.createDataFrame([("U", 107_200)], TOKENS + ", incident_block long")
    got = {r.token_address: r.score for r in research.temporal_proximity(tokens, liq, incident).collect()}
    assert got == {"T": 0.25, "U": 0.3, "V": 0.0}


def test_roles(spark):
    tokens = spark.createDataFrame([(x,) for x in "ABCDE"], TOKENS)
    labels = spark.createDataFrame([("A", "0xDEP", "Whale LP", "x"), ("B", "q", "Pool Co-LP with Deployer", "x"), ("D", "q", "Owner", "x"), ("C", "q", "Burn", "x")], TOKENS + ", address string, label string, category string")
    deployers = spark.createDataFrame([("A", "0xdep"), ("B", "z"), ("C", "z")], TOKENS + ", deployer string")
    assert {r.token_address: r.score for r in research.role_sensitivity(tokens, labels, deployers).collect()} == {"A": 0.8, "B": 0.6, "C": 0.3, "D": 0.5, "E": 0.0}


def test_impact(spark):
    tokens, incident = spark.createDataFrame([("T",), ("U",)], TOKENS), spark.createDataFrame([("T", 10), ("U", 10)], TOKENS + ", incident_block long")
    prices = spark.createDataFrame([("T", 9, 4.0), ("T", 10, 6.0), ("T", 11, 2.0), ("T", 12, 0.0), ("U", 5, 1.0)], TOKENS + ", block_number long, price double")
    assert {r.token_address: r.score for r in research.market_impact(tokens, prices, incident).collect()} == {"T": 0.6, "U": 0.0}


def test_risk(spark):
    token = lambda extra, *row: spark.createDataFrame([("T", *row)], TOKENS + extra)
    both = spark.createDataFrame([("T",), ("U",)], TOKENS)
    args = [token(", main_pool_share double", 0.8), token(", top_lp_share double", 250.0), token(", severity double, removals long, large_sells boolean", 0.5, 4, True), token(", score double", 1.0), token(", score double", 0.8), token(", score double", 0.4)]
    none = spark.createDataFrame([], TOKENS)
    got = {r.token_address: r for r in research.risk_score(both, *args, none).collect()}
    # .15*.8 + .15*1 + .2*.5 + .15*1 + .15*.8 + .15*.4 + .05*1 = .75; all six kinds of evidence: 1
    assert (got["T"].raw_score, got["T"].evidence_confidence, got["T"].final_score, got["T"].risk_level) == (0.75, 1.0, 0.75, "HIGH")
    assert (got["U"].raw_score, got["U"].evidence_confidence, got["U"].risk_level) == (0.0, 0.55, "LOW")
    moved = {r.token_address: r for r in research.risk_score(both, *args, token("")).collect()}["T"]
    assert (moved.final_score, moved.risk_level, moved.migrated) == (0.45, "MEDIUM", True)


def test_strict_pool(spark):
    from tidemark.operators import pools as P

    pools = spark.createDataFrame([("p1", "p1", "A", "B", "v3", 0, True), ("p2", "m", "A", "C", "v4", 1, True), ("p3", "m", "A", "D", "v4", 2, True), ("p4", "n", "A", "C", "v4", 3, True)], POOLS)
    rows = spark.createDataFrame([("p2", None, None), ("m", None, None), ("n", None, None), ("z", "D", "A"), ("z", "A", "C"), ("m", "C", "A"), (None, "B", "A")], "pool_address string, token0_address string, token1_address string")
    got = {(r.pool_address, r.token0_address): r.pool for r in P.resolve_pool_strict(rows, pools).collect()}
    assert got == {("p2", None): "p2", ("m", None): None, ("n", None): "p4", ("z", "D"): "p3", ("z", "A"): None, ("m", "C"): "p2", (None, "B"): "p1"}


def test_panel_cases(spark):
    from tidemark.operators import panel, prices

    pools = spark.createDataFrame([("A", "A", "TGT", "WETH", "v3", 0, True), ("B", "B", "TGT", "USDC", "v3", 1, True), ("C", "m", "TGT", "USDT", "v4", 2, True), ("D", "m", "TGT", "USDT", "v4", 3, True)], POOLS)
    one = "0" * 18
    swaps = spark.createDataFrame([("T", 1, 0, 3600, "A", "u", "TGT", "WETH", "1" + one, "2" + one, None), ("T", 2, 0, 3700, "m", "u", "TGT", "USDT", "1" + "0" + one, "20" + "0" * 6, None)], SWAPS)
    liq = spark.createDataFrame([("T", 3, 0, 3650, "LIQUIDITY_REMOVE", "C", None, "v4", 0, 0, -100, 2)], "token_address string, block_number long, log_index int, block_timestamp long, event_type string, pool_address string, actor string, version string, token0_amount long, token1_amount long, liquidity_delta long, event_count int")
    tvl = spark.createDataFrame([("T", 1, 0, 3600, "A", 100), ("T", 2, 0, 3700, "A", 150), ("T", 3, 0, 3700, "B", 200), ("T", 4, 0, 7300, "A", 165)], "token_address string, block_number long, log_index int, block_timestamp long, pool_address string, tvl_raw long")
    rows = {(r.pool_identifier, r.bucket_start): r for r in panel.analysis_series(prices.priced_swaps(swaps, pools), liq, tvl, pools, decimals=0).collect()}
    total, later = rows[None, 3600], rows["A", 7200]
    assert (total.volume_token, total.swap_count, total.tvl_token_close, total.measured_pools, total.verified_pools, total.snapshot_block) == (11.0, 2, 350.0, 2, 4, 3)
    assert (rows["A", 3600].price_close, rows["A", 3600].price_unit, rows["A", 3600].volume_usd) == (2.0, "WETH", None)
    assert rows["C", 3600].lp_remove_event_count == 2 and rows["C", 3600].liquidity_removed is None and rows["C", 3600].net_lp_flow is None and rows["C", 3600].withdrawal_amount_coverage == 0.0
    assert (later.price_close, later.price_vwap, later.staleness, later.is_imputed, later.price_is_carried) == (2.0, None, 7200, True, True)
    assert later.tvl_change == round(math.log(1.1), 9) and not later.tvl_is_carried and rows["B", 7200].tvl_is_carried
    assert ("D", 3600) not in rows and later.data_coverage == "price=carried;tvl=observed;lp_amount=none"
    assert total.active_lp_count is None and total.identity_coverage is None


def test_verification(spark):
    from tidemark.operators import pools

    facts = spark.createDataFrame([("a", True, True, None, False), ("b", False, True, True, True), ("c", True, None, None, None)], "pool_address string, trusted_factory boolean, bytecode boolean, fee boolean, reserves boolean")
    got = {r.pool_address: (r.verification_confidence, r.verified) for r in pools.score_verification(facts, ["bytecode", "fee", "reserves"]).collect()}
    assert got == {"a": (0.5, True), "b": (0.0, False), "c": (0.0, False)}


def test_discovery_facts(spark):
    from tidemark.operators import states

    code = spark.createDataFrame([("c", "0x6080AABBCCDD", "0x00"), ("d", "0x60", "0x000f")], "contract string, bytecode string, implementation_slot string")
    assert {r.contract: (r.flags, r.is_proxy) for r in states.behavior_flags(code, {"mint": "aabbccdd", "pause": "11223344"}).collect()} == {"c": (["mint"], False), "d": ([], True)}
    topic = lambda x: "0x" + "0" * 24 + x * 40
    logs = spark.createDataFrame([(topic("a"), topic("b"), "0xP", 5), (topic("a"), topic("b"), "0xp", 3), (topic("b"), topic("c"), "0xq", 1)], "topic1 string, topic2 string, pool_address string, block_number long")
    assert [tuple(r) for r in states.creation_logs(logs, "0x" + "A" * 40).collect()] == [("0xp", "0x" + "a" * 40, "0x" + "b" * 40, 3)]
    mapped = spark.createDataFrame([("0x" + "1" * 64, "balancer", "v2", ["t", "q"]), ("0xshort", "uniswap", "v4", ["t", "q"]), ("0x" + "2" * 64, "uniswap", "v4", ["z", "t"]), ("0xp", "uniswap", "v9", ["t"])], "pool string, adapter string, version string, hints array<string>")
    known = spark.createDataFrame([("balancer", "v2", "f1"), ("uniswap", "v4", "f2")], "adapter string, version string, factory string")
    assert {(r.pool_address, r.counter) for r in states.pool_candidates(mapped, known, "t").collect()} == {("0x" + "1" * 40, "q"), ("0x" + "2" * 64, "z")}


def test_reserves_by_events(spark):
    from tidemark.operators import states

    steps = [("change", 5), ("change", -9), ("sync", 7), ("change", -4), ("change", -10), ("change", 2), ("sync", 1)]
    rows = spark.createDataFrame([("T", "p", i, 0, k, a) for i, (k, a) in enumerate(steps)], "token_address string, pool_address string, block_number long, log_index int, kind string, amount long")
    run, want = 0, []
    for kind, amount in steps:
        run = amount if kind == "sync" else max(0, run + amount)
        want.append(run)
    assert [r.reserve for r in states.tvl_accumulate(rows).orderBy("block_number").collect()] == want
