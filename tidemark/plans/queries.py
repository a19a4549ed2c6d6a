"""Registered queries over the driver's tables, each with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, holders, market, research, wallets
from tidemark.sources.adapters import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}



def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"two queries of one name: {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def _rs(spark: SparkSession, d: str) -> DataFrame:
    return market.resolved_swaps(view(spark, d, "swaps"), view(spark, d, "pools"))


RS = ctes("pools", "swaps") + """, pairs as (select least(token0, token1) lo, greatest(token0, token1) hi, min(pool_address) by_pair from pools group by 1, 2 having count(*) = 1),
rs0 as (select s.*, coalesce(p.pool_address, q.by_pair) as pool,
 case when token0_address = 'TGT' then abs(token0_amount) when token1_address = 'TGT' then abs(token1_amount) end as amount,
 case when token0_address = 'TGT' then abs(token1_amount) when token1_address = 'TGT' then abs(token0_amount) end as quote_amount,
 case when token0_address = 'TGT' then token1_address when token1_address = 'TGT' then token0_address end as quote
 from swaps s left join (select distinct pool_address from pools) p on s.pool_address = p.pool_address
 left join pairs q on least(token0_address, token1_address) = q.lo and greatest(token0_address, token1_address) = q.hi),
rs as (select *, case when amount_usd_e4 > 0 and amount > 0 then cast(floor(amount_usd_e4 * 1000000 / amount) as bigint)
  when amount > 0 and quote_amount > 0 and quote in ('WETH','USDC','USDT','DAI') then cast(floor(quote_amount * 1000000 / amount) as bigint) end as price_e6,
 case when amount_usd_e4 > 0 and amount > 0 then 'USD' when amount > 0 and quote_amount > 0 and quote in ('WETH','USDC','USDT','DAI') then quote end as price_unit,
 case when amount_usd_e4 > 0 and amount > 0 then 'amount_usd' when amount > 0 and quote_amount > 0 and quote in ('WETH','USDC','USDT','DAI') then 'pool_swap_ratio' end as price_source,
 case when block_timestamp > 0 then block_timestamp // 3600 * 3600 else 0 end as bucket from rs0)
"""
LIQ = """, lq as (select l.*, l.block_timestamp // 3600 * 3600 as bucket, not (l.version = 'v4' and l.token0_amount = 0 and l.token1_amount = 0) as known,
 case when not (l.version = 'v4' and l.token0_amount = 0 and l.token1_amount = 0) then case when p.token0 = 'TGT' then l.token0_amount else l.token1_amount end end as amount
 from liquidity_events l join pools p using (pool_address)),
flow as (select {keys}, bucket, case when sum(case when event_type = 'LIQUIDITY_ADD' then event_count else 0 end) = 0 then 0 else cast(sum(case when event_type = 'LIQUIDITY_ADD' then amount end) as bigint) end as added,
 case when sum(case when event_type = 'LIQUIDITY_REMOVE' then event_count else 0 end) = 0 then 0 else cast(sum(case when event_type = 'LIQUIDITY_REMOVE' then amount end) as bigint) end as removed,
 cast(sum(case when event_type = 'LIQUIDITY_ADD' then event_count else 0 end) as bigint) as add_actions, cast(sum(case when event_type = 'LIQUIDITY_REMOVE' then event_count else 0 end) as bigint) as remove_actions,
 cast(sum(case when known then event_count else 0 end) as bigint) as known_actions, cast(sum(case when known then 0 else event_count end) as bigint) as missing_actions, count(distinct actor) as active_lp_count
 from lq group by {keys}, bucket)
"""
OHLC = """, kept as (select *, first_value(price_unit) over (partition by {keys}, bucket order by block_number, log_index) as u from rs where price_e6 is not null {where}),
ohlc as (select {keys}, bucket, arg_min(price_e6, row(block_number, log_index)) as open_e6, max(price_e6) as high_e6, min(price_e6) as low_e6, arg_max(price_e6, row(block_number, log_index)) as close_e6,
 cast(sum(amount) as bigint) as volume, min(price_unit) as price_unit, case when count(distinct price_source) > 1 then 'mixed' else min(price_source) end as price_source, max(block_timestamp) as last_trade,
 round(cast(sum(cast(price_e6 as hugeint) * amount) as double) / cast(sum(amount) as double) / 1e6, 6) as vwap from kept where price_unit = u group by {keys}, bucket)
"""


@query("swap_volume", RS + "select token_address, bucket, pool, cast(sum(amount) as bigint) as volume, cast(sum(amount_usd_e4) as bigint) as volume_usd_e4, count(*) as swap_count from rs where pool is not null and amount is not null group by 1, 2, 3")
def swap_volume(spark, d):
    return market.swap_volume(_rs(spark, d))


@query("pool_volume", RS + """, g as (select token_address, pool, cast(sum(amount) as bigint) as volume, count(*) as swap_count from rs group by 1, 2)
select g.token_address, g.pool, volume, g.swap_count, round(volume / sum(volume) over (partition by g.token_address), 9) as share,
 row_number() over (partition by g.token_address order by volume desc, g.pool) = 1 as is_main, coalesce(a.n, 0) as ambiguous_events
from g left join (select token_address, swap_count as n from g where pool is null) a using (token_address) where g.pool is not null""")
def pool_volume(spark, d):
    return market.pool_volume(_rs(spark, d))


@query("swap_price_last", RS + "select token_address, bucket, pool, arg_max(price_e6, row(block_number, log_index)) as price_e6, arg_max(price_unit, row(block_number, log_index)) as price_unit, arg_max(price_source, row(block_number, log_index)) as price_source, max(block_number) as block_number, max(block_timestamp) as block_timestamp from rs where pool is not null and price_e6 is not null group by 1, 2, 3")
def swap_price_last(spark, d):
    return market.swap_price_last(_rs(spark, d))


@query("ohlc_vwap_total", RS + OHLC.format(keys="token_address", where="") + "select * from ohlc")
def ohlc_vwap_total(spark, d):
    return market.ohlc_vwap(_rs(spark, d), ["token_address"])


@query("ohlc_vwap_pool", RS + OHLC.format(keys="token_address, pool", where="and pool is not null") + "select * from ohlc")
def ohlc_vwap_pool(spark, d):
    return market.ohlc_vwap(_rs(spark, d).where("pool is not null"), ["token_address", "pool"])


@query("volume_matrix", RS + ", v as (select token_address, bucket, pool, sum(amount) as volume from rs where pool is not null and amount is not null group by 1, 2, 3) select token_address, bucket, " + ", ".join(f"cast(sum(volume) filter (pool = 'p{k}') as bigint) as p{k}" for k in range(4)) + " from v group by 1, 2")
def volume_matrix(spark, d):
    return market.volume_matrix(market.swap_volume(_rs(spark, d)), ["p0", "p1", "p2", "p3"])


@query("span_volume_7d", RS + ", v as (select token_address, bucket, pool, sum(amount) as volume from rs where pool is not null and amount is not null group by 1, 2, 3), m as (select *, max(bucket) over (partition by token_address) as e from v) select token_address, bucket // 86400 * 86400 as bucket, pool, cast(sum(volume) as bigint) as volume from m where bucket > e - 7 * 86400 group by 1, 2, 3")
def span_volume_7d(spark, d):
    return market.span_volume(market.swap_volume(_rs(spark, d)), 7, 86_400)


TVL = ctes("pools", "tvl_points") + ", r as (select token_address, block_timestamp // 3600 * 3600 as bucket, pool_address, arg_max(tvl_raw, row(block_number, log_index)) as tvl_raw, max(block_number) as block_number from tvl_points group by 1, 2, 3)\n"


@query("resample_tvl", TVL + "select * from r")
def resample_tvl(spark, d):
    return market.resample_tvl(view(spark, d, "tvl_points"))


@query("tvl_total", TVL + "select token_address, bucket, cast(sum(tvl_raw) as bigint) as tvl_raw, count(*) as measured_pools from r group by 1, 2")
def tvl_total(spark, d):
    return market.tvl_total(market.resample_tvl(view(spark, d, "tvl_points")))


@query("pool_concentration", TVL + """, l as (select token_address, pool_address, arg_max(tvl_raw, row(block_number, log_index)) as tvl_raw from tvl_points group by 1, 2)
select token_address, cast(sum(tvl_raw) as bigint) as total_tvl, arg_max(pool_address, row(tvl_raw, pool_address)) as main_pool, max(tvl_raw) as main_pool_tvl, round(max(tvl_raw) / sum(tvl_raw), 9) as main_pool_share, count(*) filter (tvl_raw > 0) as num_active_pools from l group by 1""")
def pool_concentration(spark, d):
    return market.pool_concentration(view(spark, d, "tvl_points"))


@query("tvl_state", TVL + """, b as (select token_address, min(bucket) lo, max(bucket) hi from r group by 1),
s as (select token_address, unnest(range(lo, hi + 1, 3600)) as bucket from b), sp as (select s.*, p.pool_address from s join (select distinct token_address, pool_address from r) p using (token_address)),
j as (select sp.*, r.tvl_raw, case when r.tvl_raw is not null then sp.bucket end as sb from sp left join r using (token_address, pool_address, bucket))
select token_address, pool_address, bucket, last_value(tvl_raw ignore nulls) over w as tvl_raw, last_value(sb ignore nulls) over w as state_bucket from j window w as (partition by token_address, pool_address order by bucket rows between unbounded preceding and current row)""")
def tvl_state(spark, d):
    r = market.resample_tvl(view(spark, d, "tvl_points"))
    return market.tvl_state(r, market.bucket_spine(r))


LQ = ctes("pools", "liquidity_events")


@query("liquidity_flow", LQ + LIQ.format(keys="token_address, pool_address") + "select *, added - removed as net from flow")
def liquidity_flow(spark, d):
    return market.liquidity_flow(view(spark, d, "liquidity_events"), view(spark, d, "pools"), ["token_address", "pool_address"])


@query("clamped_liquidity", LQ + """, s as (select *, sum(liquidity_delta) over (partition by token_address, pool_address order by block_number, log_index rows between unbounded preceding and current row) as s from liquidity_events)
select token_address, pool_address, block_number, log_index, cast(s - least(0, min(s) over (partition by token_address, pool_address order by block_number, log_index rows between unbounded preceding and current row)) as bigint) as liquidity from s""")
def clamped_liquidity(spark, d):
    return market.clamped_liquidity(view(spark, d, "liquidity_events")).withColumn("liquidity", F.col("liquidity").cast("long"))


WD = ctes("pools", "liquidity_events", "tvl_points") + """, t as (select token_address, pool_address, block_number, max(tvl_raw) as tvl_raw from tvl_points group by 1, 2, 3),
w0 as (select l.*, case when not (l.version = 'v4' and l.token0_amount = 0 and l.token1_amount = 0) then case when p.token0 = 'TGT' then l.token0_amount else l.token1_amount end end as amount,
 case when not (l.version = 'v4' and l.token0_amount = 0 and l.token1_amount = 0) then 'quantified' else 'liquidity_delta_only' end as status from liquidity_events l join pools p using (pool_address) where event_type = 'LIQUIDITY_REMOVE'),
w as (select w0.token_address, w0.pool_address, w0.block_number, log_index, actor, event_count, amount, status, t.tvl_raw, round(amount / t.tvl_raw, 9) as share
 from w0 asof left join t on w0.token_address = t.token_address and w0.pool_address = t.pool_address and w0.block_number >= t.block_number)
"""


def _withdrawals(spark, d):
    return market.withdrawal_events(view(spark, d, "liquidity_events"), view(spark, d, "tvl_points"), view(spark, d, "pools"))


@query("withdrawal_events", WD + "select * from w")
def withdrawal_events(spark, d):
    return _withdrawals(spark, d)


@query("withdrawal_summary", WD + "select token_address, pool_address, cast(sum(amount) as bigint) as removed, cast(sum(event_count) as bigint) as actions, cast(sum(case when status = 'quantified' then event_count else 0 end) as bigint) as quantified_actions, max(share) as max_share from w group by grouping sets ((token_address, pool_address), (token_address))")
def withdrawal_summary(spark, d):
    return market.withdrawal_summary(_withdrawals(spark, d))


@query("price_asof_tvl", ctes("tvl_points", "swaps") + """, t as (select token_address, block_number, max(tvl_raw) as tvl_raw from tvl_points group by 1, 2)
select s.token_address, s.block_number, s.log_index, t.tvl_raw from swaps s asof left join t on s.token_address = t.token_address and s.block_number >= t.block_number""")
def price_asof_tvl(spark, d):
    t = view(spark, d, "tvl_points").select("token_address", F.col("block_number").alias("b"), "tvl_raw")
    return asof.asof_join(view(spark, d, "swaps").select("token_address", "block_number", "log_index"), t, ["token_address"], "block_number", "b", ["tvl_raw"])


# holders and positions

LEDGER = ctes("balance_ledger")
TRAJ = LEDGER + """, o as (select token_address, address, 4000 as block_number, arg_max(balance_raw, block_number) as balance_raw from balance_ledger where block_number <= 4000 group by 1, 2
 union all select token_address, address, block_number, balance_raw from balance_ledger where block_number between 4001 and 12000),
dl as (select *, case when row_number() over w = 1 then case when block_number > 4000 then balance_raw else 0 end else balance_raw - lag(balance_raw) over w end as delta from o window w as (partition by token_address, address order by block_number)),
tr as (select token_address, address, coalesce(max(case when block_number = 4000 then balance_raw end), 0) as start_balance, arg_max(balance_raw, block_number) as end_balance,
 greatest(coalesce(max(case when block_number = 4000 then balance_raw end), 0), max(balance_raw)) as peak_balance, cast(sum(greatest(delta, 0)) as bigint) as moved_in, cast(sum(greatest(-delta, 0)) as bigint) as moved_out,
 case when count(*) filter (block_number > 4000) > 0 then 'event_rebuild' else 'two_point_snapshot' end as source from dl group by 1, 2)
"""


def _trajectory(spark, d):
    return holders.balance_trajectory(view(spark, d, "balance_ledger"), 4000, 12_000)


@query("holders_interval", ctes("holder_intervals") + "select distinct token_address, address from holder_intervals where valid_from <= date '1996-06-01' and valid_to > date '1996-01-01' and balance_raw > 0 and address <> '0x0000000000000000000000000000000000000000'")
def holders_interval(spark, d):
    return holders.holders_interval(view(spark, d, "holder_intervals"), "1996-01-01", "1996-06-01")


@query("transfer_addresses", ctes("transfers") + ", s as (select token_address, transaction_hash, block_number, unnest([from_address, to_address]) as address from transfers) select token_address, address, count(distinct transaction_hash) as tx_count, min(block_number) as first_seen_block, max(block_number) as last_seen_block from s group by 1, 2")
def transfer_addresses(spark, d):
    return holders.transfer_addresses(view(spark, d, "transfers"))


@query("balance_at_block", LEDGER + "select token_address, address, arg_max(balance_raw, block_number) as balance_raw from balance_ledger where block_number <= 9000 group by 1, 2")
def balance_at_block(spark, d):
    return holders.balance_at_block(view(spark, d, "balance_ledger"), 9000)


@query("balance_trajectory", TRAJ + "select * from tr")
def balance_trajectory(spark, d):
    return _trajectory(spark, d)


@query("holder_summary", TRAJ + "select token_address, count(*) as holders, count(*) filter (end_balance > 0) as positive, cast(sum(end_balance) as bigint) as total_balance, cast(sum(end_balance - start_balance) as bigint) as net_change, count(*) filter (source = 'event_rebuild') as rebuilt from tr group by 1")
def holder_summary(spark, d):
    return holders.holder_summary(_trajectory(spark, d))


@query("balance_source_cascade", LEDGER + """, a as (select distinct token_address, address from balance_ledger), h as (select token_address, address, arg_max(balance_raw, block_number) as b from balance_ledger where block_number <= 3000 group by 1, 2),
l as (select token_address, address, arg_max(balance_raw, block_number) as b from balance_ledger where block_number <= 9000 group by 1, 2)
select token_address, address, coalesce(h.b, l.b, 0) as balance_raw, case when h.b is not null then 'historical' when l.b is not null then 'latest' else 'zero_fill' end as balance_source from a left join h using (token_address, address) left join l using (token_address, address)""")
def balance_source_cascade(spark, d):
    ledger = view(spark, d, "balance_ledger")
    return holders.balance_source_cascade(ledger.select("token_address", "address").distinct(), holders.balance_at_block(ledger, 3000), holders.balance_at_block(ledger, 9000))


@query("top_holders", LEDGER + ", b as (select token_address, address, arg_max(balance_raw, block_number) as balance_raw from balance_ledger group by 1, 2) select token_address, address, balance_raw, cast(row_number() over (partition by token_address order by balance_raw desc, address) as int) as rank from b where balance_raw > 0 qualify rank <= 20")
def top_holders(spark, d):
    return holders.top_holders(holders.balance_at_block(view(spark, d, "balance_ledger"), 1 << 60))


POS = ctes("lp_nft") + """, p0 as (select token_address, token_id, arg_min(row(pool_address, tick_lower, tick_upper), row(block_number, log_index, owner)) as b, cast(sum(liquidity_delta) as bigint) as liquidity, arg_max(owner, row(block_number, log_index, owner)) as owner from lp_nft group by 1, 2),
ps as (select distinct p0.token_address, p0.token_id, l.pool_address, l.tick_lower, l.tick_upper, liquidity, p0.owner from p0 join lp_nft l using (token_address, token_id) where liquidity > 0),
tk as (select * from (values ('p0', -300), ('p1', 0), ('p2', 120), ('p3', 600), ('p4', 60), ('p5', -1200)) t(pool_address, tick)),
sh as (select ps.token_address, token_id, pool_address, owner, liquidity, tick_lower <= tick and tick < tick_upper as in_range,
 case when tick_lower <= tick and tick < tick_upper then round(100 * liquidity / sum(case when tick_lower <= tick and tick < tick_upper then liquidity else 0 end) over (partition by ps.token_address, pool_address), 6) else 0.0 end as share_pct from ps join tk using (pool_address))
"""


def _positions(spark, d):
    return holders.position_snapshot(view(spark, d, "lp_nft"))


def _shares(spark, d):
    ticks = spark.createDataFrame([("p0", -300), ("p1", 0), ("p2", 120), ("p3", 600), ("p4", 60), ("p5", -1200)], "pool_address string, tick int")
    return holders.position_share(_positions(spark, d), ticks)


@query("position_snapshot", POS + "select * from ps")
def position_snapshot(spark, d):
    return _positions(spark, d)


@query("position_share", POS + "select token_address, token_id, pool_address, owner, liquidity, in_range, cast(share_pct as double) as share_pct from sh")
def position_share(spark, d):
    return _shares(spark, d)


@query("lp_concentration", POS + """, rk as (select *, row_number() over (partition by token_address, pool_address order by share_pct desc, token_id) as r from sh),
pl as (select token_address, pool_address, max(share_pct) as top, sum(share_pct) filter (r <= 5) as top_n from rk group by 1, 2)
select pl.token_address, cast(max(top) as double) as top_lp_share, round(least(100.0::double, cast(max(top_n) as double)), 4) as top_n_share, any_value(c.n) as total_lp_positions, any_value(c.o) as num_lps
from pl join (select token_address, count(*) as n, count(distinct owner) as o from sh group by 1) c using (token_address) group by 1""")
def lp_concentration(spark, d):
    return holders.lp_concentration(_shares(spark, d))


@query("portfolios", POS + "select token_address, owner, count(*) as n_positions, string_agg(cast(token_id as varchar), ',' order by token_id) as token_ids, cast(sum(liquidity) as bigint) as liquidity from ps group by 1, 2")
def portfolios(spark, d):
    return holders.portfolios(_positions(spark, d))


# wallets, flows, graph

TR = ctes("transfers", "gas_payers", "contract_owners")
GRAPH = TR + """, pr as (select *, least(from_address, to_address) as a, greatest(from_address, to_address) as b from transfers where from_address <> to_address and amount_raw > 0),
rc0 as (select token_address, a, b, coalesce(sum(amount_raw) filter (from_address = a), 0) as s1, count(*) filter (from_address = a) as n1, coalesce(sum(amount_raw) filter (from_address <> a), 0) as s2, count(*) filter (from_address <> a) as n2 from pr group by 1, 2, 3),
rc as (select token_address, a, b, n1, n2 from rc0 where n1 > 0 and n2 > 0 and abs(s1 * n2 - s2 * n1) * 100 <= greatest(s1 * n2, s2 * n1) * 25),
rp0 as (select token_address, from_address, to_address, count(*) as n, sum(amount_raw) as s, min(amount_raw) as lo, max(amount_raw) as hi from transfers where from_address <> to_address and amount_raw > 0 group by 1, 2, 3),
rp as (select distinct token_address, least(from_address, to_address) as a, greatest(from_address, to_address) as b from rp0 where n >= 3 and (s - lo * n) * 100 <= s * 25 and (hi * n - s) * 100 <= s * 25),
ct as (select token_address, a, b, count(distinct transaction_hash) as n_tx from pr group by 1, 2, 3 having count(distinct transaction_hash) >= 3),
sd as (select distinct token_address, transaction_hash, unnest([from_address, to_address]) as address from transfers),
gp as (select distinct s.token_address, least(g.gas_payer, s.address) as a, greatest(g.gas_payer, s.address) as b from sd s join gas_payers g using (transaction_hash) where g.gas_payer <> s.address and exists (select 1 from sd c where c.token_address = s.token_address and c.address = g.gas_payer)),
cd as (select distinct token_address, address from sd),
ow0 as (select cd.token_address, cd.address, o.owner from cd join contract_owners o on cd.address = o.contract),
ow as (select distinct token_address, least(x, y) as a, greatest(x, y) as b from (select token_address, address as x, owner as y from ow0 where owner <> address and exists (select 1 from cd where cd.token_address = ow0.token_address and cd.address = ow0.owner)
 union all select token_address, address, first from (select *, min(address) over (partition by token_address, owner) as first from ow0) where address <> first)),
sg as (select token_address, a, b, 'reciprocal' as sig, 30 as w from rc union all select token_address, a, b, 'repeated', 15 from rp union all select token_address, a, b, 'gas_payer', 20 from gp union all select token_address, a, b, 'owner', 45 from ow),
ed0 as (select token_address, a, b, sum(w) as w, string_agg(sig, ',' order by sig) as signals from sg group by 1, 2, 3),
ed as (select ed0.token_address, ed0.a, ed0.b, signals, ct.n_tx is not null as supported, cast(least(99, w + case when ct.n_tx is not null then 5 else 0 end) as bigint) as score_pct from ed0 left join ct using (token_address, a, b))
"""


def _edges(spark, d):
    t, p = view(spark, d, "transfers"), view(spark, d, "gas_payers")
    return wallets.edge_confidence(_owner_edges(spark, d), wallets.reciprocal_edges(t), wallets.repeated_edges(t), wallets.gas_payer_edges(t, p), wallets.cotx_support(t))


def _owner_edges(spark, d):
    candidates = view(spark, d, "transfers").select("token_address", F.explode(F.array("from_address", "to_address")).alias("address")).distinct()
    return wallets.owner_edges(candidates, view(spark, d, "contract_owners"))


@query("owner_edges", GRAPH + "select * from ow")
def owner_edges(spark, d):
    return _owner_edges(spark, d)


@query("fund_flow_edges", TR + "select token_address, from_address, to_address, cast(sum(amount_raw) as decimal(38,0)) as amount, count(*) as transfer_count, count(distinct transaction_hash) as tx_count, min(block_number) as first_block, max(block_number) as last_block from transfers group by 1, 2, 3")
def fund_flow_edges(spark, d):
    return wallets.fund_flow_edges(view(spark, d, "transfers"))


@query("reciprocal_edges", GRAPH + "select * from rc")
def reciprocal_edges(spark, d):
    return wallets.reciprocal_edges(view(spark, d, "transfers"))


@query("repeated_edges", GRAPH + "select * from rp")
def repeated_edges(spark, d):
    return wallets.repeated_edges(view(spark, d, "transfers"))


@query("cotx_support", GRAPH + "select * from ct")
def cotx_support(spark, d):
    return wallets.cotx_support(view(spark, d, "transfers"))


@query("gas_payer_edges", GRAPH + "select * from gp")
def gas_payer_edges(spark, d):
    return wallets.gas_payer_edges(view(spark, d, "transfers"), view(spark, d, "gas_payers"))


@query("edge_confidence", GRAPH + "select *, case when score_pct >= 70 then 'high' when score_pct >= 40 then 'medium' else 'low' end as level from ed")
def edge_confidence(spark, d):
    return _edges(spark, d)


@query("label_transfer_frequency", TR + """, rv as (select token_address, to_address as address, 'frequent_receiver' as label, count(*) as n from transfers group by 1, 2 having count(*) >= 5 qualify row_number() over (partition by token_address order by n desc, address) <= 20),
sn as (select token_address, from_address as address, 'frequent_sender' as label, count(*) as n from transfers group by 1, 2 having count(*) >= 5 qualify row_number() over (partition by token_address order by n desc, address) <= 20)
select * from rv union all select * from sn where not exists (select 1 from rv where rv.token_address = sn.token_address and rv.address = sn.address)""")
def label_transfer_frequency(spark, d):
    return wallets.label_transfer_frequency(view(spark, d, "transfers"))


# timeline and correlation

INC = "inc as (select token_address, arg_max(block_number, row(abs(liquidity_delta), -block_number)) as incident_block from liquidity_events where event_type = 'LIQUIDITY_REMOVE' group by 1)"


def _incidents(spark, d):
    return research.incidents(view(spark, d, "liquidity_events"))


@query("incident_timeline", ctes("liquidity_events") + f""", {INC} select token_address, case when block_number < incident_block then 'pre' else 'post' end as phase, count(*) as events,
 min(block_number) as first_block, max(block_number) as last_block, min(block_timestamp) as first_time, max(block_timestamp) as last_time from liquidity_events join inc using (token_address) group by 1, 2""")
def incident_timeline(spark, d):
    return research.incident_timeline(view(spark, d, "liquidity_events"), _incidents(spark, d))


MIG = ", mg as (select distinct r.token_address, coalesce(r.actor, a.actor) as actor, r.block_number as remove_block, a.block_number as add_block, r.pool_address as from_pool, a.pool_address as to_pool, r.pool_address = a.pool_address as same_pool from liquidity_events r join liquidity_events a on r.token_address = a.token_address and (r.actor = a.actor or r.recipient = a.recipient) and a.block_number between r.block_number and r.block_number + 5 where r.event_type = 'LIQUIDITY_REMOVE' and a.event_type = 'LIQUIDITY_ADD')\n"


@query("liquidity_migration", ctes("liquidity_events") + MIG + "select * from mg")
def liquidity_migration(spark, d):
    return research.liquidity_migration(view(spark, d, "liquidity_events"))


@query("alternative_causes", ctes("transfers") + "select token_address, from_address as sender, count(*) as n from transfers group by 1, 2 having count(*) > 10")
def alternative_causes(spark, d):
    return research.alternative_causes(view(spark, d, "transfers"))


PAIR = RS + ", dv as (select token_address, bucket, cast(sum(amount) as bigint) as volume, count(*) as n_swaps from rs group by 1, 2)\n"


def _daily(spark, d):
    rs = _rs(spark, d)
    return rs.groupBy("token_address", S.bucket_ts(F.col("block_timestamp"), 3600).alias("bucket")).agg(F.sum("amount").alias("volume"), F.count("*").alias("n_swaps"))


@query("pearson", PAIR + "select token_address, count(*) as n, case when count(*) >= 3 then round(covar_pop(volume, n_swaps) / nullif(stddev_pop(volume) * stddev_pop(n_swaps), 0), 6) end as r from dv where volume is not null group by 1")
def pearson(spark, d):
    return research.pearson(_daily(spark, d), "volume", "n_swaps", ["token_address"])


@query("spearman", PAIR + ", k as (select *, rank() over (partition by token_address order by volume) + (count(*) over (partition by token_address, volume) - 1) / 2 as a, rank() over (partition by token_address order by n_swaps) + (count(*) over (partition by token_address, n_swaps) - 1) / 2 as b from dv where volume is not null) select token_address, count(*) as n, case when count(*) >= 3 then round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) end as r from k group by 1")
def spearman(spark, d):
    return research.spearman(_daily(spark, d), "volume", "n_swaps", ["token_address"])


@query("lead_lag", PAIR + """, nm as (select *, row_number() over (partition by token_address order by bucket) as i from dv), pp as (select x.token_address, g.lag, x.volume, y.n_swaps from nm x, (select unnest(range(-6, 7)) as lag) g, nm y where y.token_address = x.token_address and y.i = x.i + g.lag),
cr as (select token_address, lag, count(*) as n, case when count(*) >= 3 then round(covar_pop(volume, n_swaps) / nullif(stddev_pop(volume) * stddev_pop(n_swaps), 0), 6) end as r from pp group by 1, 2)
select token_address, cast(arg_max(lag, row(abs(r), -lag)) as int) as lag, arg_max(r, row(abs(r), -lag)) as r, arg_max(n, row(abs(r), -lag)) as n, max(r) filter (lag = 0) as zero_lag from cr where r is not null group by 1""")
def lead_lag(spark, d):
    return research.lead_lag(_daily(spark, d), "volume", "n_swaps", "bucket", ["token_address"])


@query("contiguous_buckets", PAIR + ", g as (select token_address, bucket - lag(bucket) over (partition by token_address order by bucket) as g from dv) select token_address, coalesce(bool_and(g = 3600), true) as ok, count(*) as n from g group by 1")
def contiguous_buckets(spark, d):
    return research.contiguous(_daily(spark, d), "bucket", ["token_address"], 3600)
