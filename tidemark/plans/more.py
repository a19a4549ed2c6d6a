"""More registered queries: events, pools, coverage, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import events, holders, market, ordered, pools, research
from tidemark.plans.queries import GRAPH, INC, LQ, RS, TRAJ, TVL, _daily, _edges, _incidents, _rs, _trajectory, _withdrawals, WD, query
from tidemark.sources.adapters import ctes, view

POOLS = ctes("pools", "swaps")


@query("combine_route_events", ctes("swaps", "transfers", "liquidity_events") + """, a as (select token_address, block_number, event_type from swaps union all select token_address, block_number, event_type from transfers union all select token_address, block_number, event_type from liquidity_events)
select token_address, case when event_type = 'SWAP' then 'swaps' when event_type like 'LIQUIDITY%' then 'liquidity_events' when event_type = 'TOKEN_TRANSFER' then 'transfers' else 'position_events' end as table_name, count(*) as n, min(block_number) as first_block, max(block_number) as last_block from a group by 1, 2""")
def combine_route_events(spark, d):
    rows = events.combine_events(view(spark, d, "swaps"), view(spark, d, "transfers"), view(spark, d, "liquidity_events"))
    routed = events.route_events(rows)
    return routed.groupBy("token_address", "table_name").agg(F.count("*").alias("n"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


@query("attach_block_time", ctes("transfers", "ev") + "select t.token_address, t.block_number, t.log_index, e.block_timestamp from transfers t left join (select block_number, block_timestamp from ev) e using (block_number)")
def attach_block_time(spark, d):
    return events.attach_block_time(view(spark, d, "transfers"), view(spark, d, "ev")).select("token_address", "block_number", "log_index", "block_timestamp")


@query("discover_pools", ctes("swaps") + "select token_address, pool_address, count(*) as trade_count, min(block_number) as first_block, max(block_number) as last_block, cast(row_number() over (partition by token_address order by count(*) desc, pool_address) as int) as rank from swaps group by 1, 2")
def discover_pools(spark, d):
    return pools.discover_pools(view(spark, d, "swaps"))


@query("swap_pool_first_match", POOLS + """, f as (select least(token0, token1) lo, greatest(token0, token1) hi, arg_min(pool_address, ordinal) as p from pools group by 1, 2), m as (select s.token_address, coalesce(x.pool_address, f.p) as pool
 from swaps s left join pools x on s.pool_address = x.pool_address left join f on least(token0_address, token1_address) = lo and greatest(token0_address, token1_address) = hi) select token_address, pool, count(*) as n from m group by 1, 2""")
def swap_pool_first_match(spark, d):
    return pools.resolve_pool_first_match(view(spark, d, "swaps"), view(spark, d, "pools")).groupBy("token_address", "pool").agg(F.count("*").alias("n"))


@query("swaps_by_custody_alias", POOLS + """, a as (select distinct pool_address, alias from (select pool_address, pool_address as alias from pools union all select pool_address, custody_address from pools)), i as (select alias, count(distinct pool_address) as n, min(pool_address) as identifier from a group by 1)
select s.token_address, i.identifier, i.n as candidates, count(*) as swaps from swaps s join i on s.pool_address = i.alias group by 1, 2, 3""")
def swaps_by_custody_alias(spark, d):
    index = pools.pool_alias_index(view(spark, d, "pools")).where("kind = 'alias'").select(F.col("alias").alias("pool_address"), "identifier", F.col("n").alias("candidates"))
    return view(spark, d, "swaps").join(F.broadcast(index), "pool_address").groupBy("token_address", "identifier", "candidates").agg(F.count("*").alias("swaps"))


@query("volume_of_unique_custody", RS + ", u as (select pool_address from pools where custody_address in (select custody_address from pools group by 1 having count(*) = 1)) select token_address, pool, cast(sum(amount) as bigint) as volume from rs where pool in (select pool_address from u) group by 1, 2")
def volume_of_unique_custody(spark, d):
    own = pools.unique_custody_pools(view(spark, d, "pools")).select(F.col("pool_address").alias("pool"))
    return _rs(spark, d).join(F.broadcast(own), "pool", "left_semi").groupBy("token_address", "pool").agg(F.sum("amount").alias("volume"))


@query("pool_coverage", TVL + """, g as (select t.token_address, p.pool_address, p.version from (select distinct token_address from tvl_points) t, pools p where verified), s as (select distinct token_address, pool_address, 1 as seen from tvl_points)
select token_address, count(*) as verified_pools, count(seen) as measured_pools, count(*) filter (version = 'v4' and seen is null) as missing_v4, round(100 * count(seen) / count(*), 4) as coverage_pct from g left join s using (token_address, pool_address) group by 1""")
def pool_coverage(spark, d):
    return pools.pool_coverage(view(spark, d, "pools"), view(spark, d, "tvl_points"))


@query("liquidity_pool_block", LQ + "select token_address, pool_address, block_number, event_type, cast(sum(token0_amount) as bigint) as token0_amount, cast(sum(token1_amount) as bigint) as token1_amount, cast(sum(liquidity_delta) as bigint) as liquidity_delta, cast(sum(event_count) as bigint) as event_count, max(block_timestamp) as block_time from liquidity_events group by 1, 2, 3, 4")
def liquidity_pool_block(spark, d):
    return pools.liquidity_pool_block(view(spark, d, "liquidity_events"))


@query("liquidity_v4_pool_block", LQ + "select token_address, pool_address, block_number, cast(sign(liquidity_delta) as int) as sign, cast(sum(token0_amount) as bigint) as token0_amount, cast(sum(token1_amount) as bigint) as token1_amount, cast(sum(liquidity_delta) as bigint) as liquidity_delta, cast(sum(event_count) as bigint) as event_count, max(block_timestamp) as block_time from liquidity_events where version = 'v4' group by 1, 2, 3, 4")
def liquidity_v4_pool_block(spark, d):
    return pools.liquidity_pool_block(view(spark, d, "liquidity_events").where("version = 'v4'"), by_sign=True)


@query("tvl_point_details", TVL + "select token_address, bucket, pool_address, tvl_raw, round(100 * tvl_raw / sum(tvl_raw) over (partition by token_address, bucket), 6) as share_pct from r")
def tvl_point_details(spark, d):
    return pools.tvl_point_details(market.resample_tvl(view(spark, d, "tvl_points")))


@query("withdrawal_rescope", WD + "select w.token_address, w.pool_address, w.block_number, w.log_index, w.amount from w where exists (select 1 from tvl_points t where t.pool_address = w.pool_address and t.block_number = w.block_number)")
def withdrawal_rescope(spark, d):
    keys = view(spark, d, "tvl_points").select("pool_address", "block_number").distinct()
    return _withdrawals(spark, d).join(keys, ["pool_address", "block_number"], "left_semi").select("token_address", "pool_address", "block_number", "log_index", "amount")


@query("cotx_baseline", GRAPH + """, ad as (select token_address, count(distinct address) as n from sd group by 1), hs as (select token_address, count(*) as hits from ct group by 1), eg as (select ed.token_address, count(*) as edges, count(ct.n_tx) as edge_hits from ed left join ct using (token_address, a, b) group by 1)
select token_address, round(coalesce(hits, 0) / (n * (n - 1) / 2), 9) as rate, round(edge_hits / edges, 9) as edge_rate, round((edge_hits / edges) / nullif(coalesce(hits, 0) / (n * (n - 1) / 2), 0), 6) as lift from ad left join hs using (token_address) left join eg using (token_address)""")
def cotx_baseline(spark, d):
    return pools.cotx_baseline(view(spark, d, "transfers"), _edges(spark, d))


@query("holdings", TRAJ.replace("with ", ctes("swaps") + ", ", 1) + ", k as (select distinct actor as address from swaps where token0_amount > 20000) select token_address, tr.address, case when k.address is not null then 'contract' else 'eoa' end as address_type, start_balance, end_balance, end_balance - start_balance as net_change, peak_balance, moved_in, moved_out, source from tr left join k on tr.address = k.address")
def holdings(spark, d):
    contracts = view(spark, d, "swaps").where("token0_amount > 20000").select(F.col("actor").alias("address"))
    return pools.holdings(_trajectory(spark, d), view(spark, d, "pools"), contracts)


@query("market_extremes", ctes("swaps") + "select token_address, block_number, log_index, pool_address, token0_amount from swaps where abs(token0_amount) > 40000")
def market_extremes(spark, d):
    return view(spark, d, "swaps").where(F.abs("token0_amount") > 40_000).select("token_address", "block_number", "log_index", "pool_address", "token0_amount")


@query("crash_window", ctes("liquidity_events") + f", {INC} select token_address, block_number, log_index, event_type from liquidity_events join inc using (token_address) where block_number between incident_block - 100 and incident_block + 50")
def crash_window(spark, d):
    return research.crash_window(view(spark, d, "liquidity_events"), _incidents(spark, d)).select("token_address", "block_number", "log_index", "event_type")


@query("cluster_transfers", ctes("transfers", "swaps") + "select token_address, block_number, log_index, from_address, to_address, amount_raw from transfers where from_address in (select actor from swaps where token0_amount > 20000) and to_address in (select actor from swaps where token0_amount > 20000)")
def cluster_transfers(spark, d):
    who = view(spark, d, "swaps").where("token0_amount > 20000").select("actor").distinct()
    t = view(spark, d, "transfers")
    kept = t.join(who.withColumnRenamed("actor", "from_address"), "from_address", "left_semi").join(who.withColumnRenamed("actor", "to_address"), "to_address", "left_semi")
    return kept.select("token_address", "block_number", "log_index", "from_address", "to_address", "amount_raw")


@query("percentile_rank", RS + ", dv as (select token_address, bucket, cast(sum(amount) as bigint) as volume from rs group by 1, 2) select token_address, bucket, round(100 * cume_dist() over (partition by token_address order by volume), 6) as pct from dv where volume is not null")
def percentile_rank(spark, d):
    rows = ordered.percentile_rank(_daily(spark, d).where("volume is not null"), ["token_address"], "volume", "pct")
    return rows.select("token_address", "bucket", F.round("pct", 6).alias("pct"))


@query("block_window", ctes("transfers", "liquidity_events") + f", {INC} select t.token_address, t.block_number, t.log_index from transfers t join inc using (token_address) where t.block_number <= incident_block")
def block_window(spark, d):
    """Transfers up to the token's incident: the window's end is each token's own."""
    rows = view(spark, d, "transfers").join(_incidents(spark, d), "token_address").where("block_number <= incident_block")
    return rows.select("token_address", "block_number", "log_index")


HOLDINGS = TRAJ.replace("with ", ctes("swaps", "pools") + ", ", 1) + """, k as (select distinct actor as address from swaps where token0_amount > 20000),
pk as (select pool_address as address from pools union select custody_address from pools),
hd as (
  select token_address, tr.address, case when pk.address is not null then 'pool' when k.address is not null then 'contract' else 'eoa' end as address_type, end_balance, source
  from tr left join k on tr.address = k.address left join pk on tr.address = pk.address)
"""


@query("shown_holders", HOLDINGS + """
select token_address, address, address_type, end_balance, cast(row_number() over (partition by token_address order by end_balance desc, address) as int) as rank
from hd where end_balance > 0 and address_type <> 'pool' and source <> 'zero_fill' qualify rank <= 20""")
def shown_holders(spark, d):
    return holders.shown_holders(holdings(spark, d)).select("token_address", "address", "address_type", "end_balance", "rank")


@query("holders_by_kind", HOLDINGS + """
select token_address, address_type, count(*) as addresses, count(*) filter (end_balance > 0) as holding, cast(sum(end_balance) as decimal(38,0)) as balance,
  count(*) filter (source = 'event_rebuild') as rebuilt, count(*) filter (source = 'two_point_snapshot') as snapshots, count(*) filter (source = 'zero_fill') as filled
from hd group by grouping sets ((token_address, address_type), (token_address))""")
def holders_by_kind(spark, d):
    return holders.holders_by_kind(holdings(spark, d))
