"""Wallets, signed flows, clusters and risk, with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import market, prices, research, wallets
from tidemark.plans.queries import GRAPH, INC, MIG, POS, TRAJ, _edges, _incidents, _shares, _trajectory, query
from tidemark.sources.adapters import ctes, view
from tidemark.sources.tables import checkpointed

#: Swaps in whole tokens: pool, side, price and USD value.
PRICED = """pairs as (select least(token0, token1) lo, greatest(token0, token1) hi, min(pool_address) by_pair from pools group by 1, 2 having count(*) = 1),
pr0 as (select s.*, coalesce(p.pool_address, q.by_pair) as pool, case when token0_address = 'TGT' then 0 when token1_address = 'TGT' then 1 end as side,
 case when token0_address = 'TGT' then token1_address when token1_address = 'TGT' then token0_address end as quote,
 abs(cast(case when token0_address = 'TGT' then token0_raw when token1_address = 'TGT' then token1_raw end as double)) / 1e18 as target,
 abs(cast(case when token0_address = 'TGT' then token1_raw when token1_address = 'TGT' then token0_raw end as double)) as other
 from raw_swaps s left join (select distinct pool_address from pools) p on s.pool_address = p.pool_address left join pairs q on least(token0_address, token1_address) = q.lo and greatest(token0_address, token1_address) = q.hi),
pr1 as (select *, other / case when quote in ('USDC', 'USDT') then 1e6 else 1e18 end as quote_amount from pr0),
pr2 as (select *, case when amount_usd > 0 and target > 0 then amount_usd / target when target > 0 and quote_amount > 0 and quote in ('ETH', 'WETH', 'USDC', 'USDT', 'DAI') then quote_amount / target end as price,
 case when amount_usd > 0 and target > 0 then 'USD' when target > 0 and quote_amount > 0 and quote in ('ETH', 'WETH', 'USDC', 'USDT', 'DAI') then quote end as unit,
 case when amount_usd > 0 and target > 0 then 'amount_usd' when target > 0 and quote_amount > 0 and quote in ('ETH', 'WETH', 'USDC', 'USDT', 'DAI') then 'pool_swap_ratio' end as source from pr1),
prk as (select token_address, pool, block_number, arg_max(price, log_index) as known from pr2 where unit = 'USD' and pool is not null group by 1, 2, 3),
pr as (select pr2.*, cast(round(coalesce(case when amount_usd > 0 then amount_usd end, case when quote in ('USDC', 'USDT', 'DAI') and quote_amount > 0 then quote_amount end, case when target > 0 and known > 0 then target * known end), 6) as decimal(24,6)) as usd
 from pr2 asof left join prk on pr2.token_address = prk.token_address and pr2.pool = prk.pool and pr2.block_number >= prk.block_number)
"""
PR = ctes("pools", "raw_swaps", "contract_owners") + ",\n" + PRICED
#: The same with the first pool of a swap's pair, whatever its address.
PRICED_FIRST = PRICED.replace("min(pool_address) by_pair from pools group by 1, 2 having count(*) = 1", "arg_min(pool_address, ordinal) by_pair from pools group by 1, 2")
PRICED_FIRST = PRICED_FIRST.replace("coalesce(p.pool_address, q.by_pair) as pool", "case when token0_address is not null and token1_address is not null then q.by_pair else p.pool_address end as pool")
PRW = ctes("pools", "raw_swaps", "contract_owners") + ",\n" + PRICED_FIRST

STATS = """infra as (select pool_address as address from pools union select custody_address from pools union select contract from contract_owners),
mk as (select token_address, sum(usd) as market_usd from pr where usd > 0 and pool is not null group by 1),
st0 as (select token_address, coalesce(actor, recipient) as actor, count(*) as swap_count, sum(case when side = 0 then 0 else usd end) as bought, sum(case when side = 0 then usd else 0 end) as sold, max(usd) as top,
 sum(case when side = 0 then 0 else cast(round(target, 6) as decimal(24,6)) end) as bt, sum(case when side = 0 then cast(round(target, 6) as decimal(24,6)) else 0 end) as stk
 from pr where usd > 0 and pool is not null and coalesce(actor, recipient) is not null and coalesce(actor, recipient) not in (select address from infra) group by 1, 2),
st as (select token_address, actor, swap_count, cast(bought as double) as bought_usd, cast(sold as double) as sold_usd, cast(top as double) as max_single_usd, cast(bt as double) as bought_token, cast(stk as double) as sold_token,
 cast(market_usd as double) as market_usd, cast(bought - sold as double) as net_usd, cast(bought + sold as double) as total_usd from st0 join mk using (token_address))
"""


def _percentile(column: str, name: str) -> str:
    return f"""{name}0 as (select token_address, {column} as v, row_number() over (partition by token_address order by {column}) - 1 as i, count(*) over (partition by token_address) as n, min({column}) over (partition by token_address) < max({column}) over (partition by token_address) as varies from st),
{name}1 as (select *, greatest(0.0::double, least(0.99::double * (n + 1) - 1, (n - 1)::double)) as pos from {name}0),
{name} as (select token_address, min(v) + (max(v) - min(v)) * max(pos - floor(pos)) as value, any_value(varies) as varies from {name}1 where i = floor(pos) or i = floor(pos) + 1 group by 1)"""


FLAGS = PRW + ", " + STATS + ", " + ", ".join(_percentile(c, n) for c, n in (("max_single_usd", "qa"), ("abs(net_usd)", "qb"), ("swap_count", "qc"), ("total_usd", "qd"))) + """,
fl0 as (select st.*, max_single_usd >= qa.value and qa.varies as large_trade, abs(net_usd) >= qb.value and qb.varies as large_mover, swap_count >= ceil(qc.value) and qc.varies as high_activity, total_usd >= qd.value and qd.varies as market_share,
 greatest(round(100 * cume_dist() over (partition by st.token_address order by max_single_usd), 4), round(100 * cume_dist() over (partition by st.token_address order by abs(net_usd)), 4), round(100 * cume_dist() over (partition by st.token_address order by swap_count), 4), round(100 * cume_dist() over (partition by st.token_address order by total_usd), 4)) as score
 from st join qa using (token_address) join qb using (token_address) join qc using (token_address) join qd using (token_address)),
fl as (select *, large_trade::int + large_mover::int + high_activity::int + market_share::int as n_flags, large_trade::int + large_mover::int + high_activity::int + market_share::int > 0 as notable from fl0)
"""


def _priced(spark, d):
    return prices.priced_swaps(view(spark, d, "raw_swaps"), view(spark, d, "pools"))


def _stats(spark, d):
    pools = view(spark, d, "pools")
    infra = pools.select(F.explode(F.array("pool_address", "custody_address")).alias("address")).union(view(spark, d, "contract_owners").select("contract"))
    priced = prices.priced_swaps(view(spark, d, "raw_swaps"), pools, resolve=prices.first_pair)
    return wallets.wallet_stats(priced, infra)


@query("priced_swaps", PR + "select token_address, block_number, log_index, pool, side, quote, round(target, 9) as target, round(quote_amount, 9) as quote_amount, round(price, 9) as price, unit, source, cast(usd as double) as usd from pr")
def priced_swaps(spark, d):
    rounded = [F.round(c, 9).alias(c) for c in ("target", "quote_amount", "price")]
    return _priced(spark, d).select("token_address", "block_number", "log_index", "pool", "side", "quote", *rounded, "unit", "source", F.col("usd").cast("double").alias("usd"))


@query("wallet_stats", PRW + ", " + STATS + "select * from st")
def wallet_stats(spark, d):
    return _stats(spark, d)


@query("exclusive_percentile", PRW + ", " + STATS + ", " + _percentile("total_usd", "q") + " select token_address, round(value, 6) as value, varies from q")
def exclusive_percentile(spark, d):
    return wallets.exclusive_percentile(_stats(spark, d), "total_usd").withColumn("value", F.round("value", 6))


@query("wallet_flags", FLAGS + "select * from fl")
def wallet_flags(spark, d):
    return wallets.wallet_flags(_stats(spark, d))


@query("wallet_ranking", FLAGS + """, r as (select *, cast(row_number() over (partition by token_address order by n_flags desc, score desc, abs(net_usd) desc, total_usd desc, actor) as int) as rank,
 row_number() over (partition by token_address, notable order by n_flags desc, score desc, abs(net_usd) desc, total_usd desc, actor) as r from fl) select * exclude (r) from r where notable or r <= 200""")
def wallet_ranking(spark, d):
    return wallets.wallet_ranking(wallets.wallet_flags(_stats(spark, d)))


@query("wallet_movers", ctes("pools", "raw_swaps", "contract_owners", "balance_ledger") + ", " + PRICED_FIRST + ", " + STATS + TRAJ[TRAJ.index(", o as") :] + """, m as (select coalesce(st.token_address, tr.token_address) as token_address, coalesce(st.actor, tr.address) as actor, net_usd, swap_count, tr.end_balance - tr.start_balance as held_change from st full join tr on st.token_address = tr.token_address and st.actor = tr.address)
select *, cast(row_number() over (partition by token_address order by abs(coalesce(net_usd, 0)) desc, abs(coalesce(held_change, 0)) desc, actor) as int) as rank from m where actor not in (select pool_address from pools union select custody_address from pools) qualify rank <= 20""")
def wallet_movers(spark, d):
    return wallets.wallet_movers(_stats(spark, d), _trajectory(spark, d), view(spark, d, "pools"))


# signed flows

#: Swap logs as the pool sees them: the pool named by the event, or the first of the manager's; a purchase takes the target out.
SIGNED_VIEW = """sg0 as (select token_address, block_number, log_index, transaction_hash, actor, case when pool_address = 'manager' then 'p4' else pool_address end as pool_address,
 case when token0_address = 'TGT' then case when target_delta_signed < 0 then '-' else '' end else case when target_delta_signed < 0 then '' else '-' end end || token0_raw as amount0,
 case when token0_address = 'TGT' then case when target_delta_signed < 0 then '' else '-' end else case when target_delta_signed < 0 then '-' else '' end end || token1_raw as amount1 from raw_swaps)"""
SIGNED = ctes("pools", "raw_swaps", "transfers", "balance_ledger") + ", " + SIGNED_VIEW + """,
sw as (select s.*, cast(case when token0 = 'TGT' then amount0 else amount1 end as decimal(38,0)) as target_delta, cast(case when token0 = 'TGT' then amount1 else amount0 end as decimal(38,0)) as quote_delta, case when token0 = 'TGT' then token1 else token0 end as quote
 from sg0 s join pools p using (pool_address) where token0 = 'TGT' or token1 = 'TGT'),
cu as (select token_address, arg_max(to_address, row(n, to_address)) as pool_address from (select token_address, to_address, count(*) as n from transfers group by 1, 2) group by 1),
dt as (select t.token_address, t.transaction_hash, t.log_index, t.block_number, t.from_address, t.to_address, t.amount_raw, cu.pool_address, cast(case when t.to_address = cu.pool_address then t.amount_raw when t.from_address = cu.pool_address then -t.amount_raw else 0 end as decimal(38,0)) as pool_delta,
 exists (select 1 from sw where sw.token_address = t.token_address and sw.transaction_hash = t.transaction_hash) as related_to_swap_tx
 from (select * from transfers qualify row_number() over (partition by token_address, transaction_hash, log_index order by block_number, from_address, to_address, amount_raw) = 1) t join cu using (token_address)),
fs as (select token_address, transaction_hash, count(*) as n, sum(target_delta) as d, min(block_number) as b, min(actor) as sender from sw group by 1, 2), ft as (select token_address, transaction_hash, count(*) as n, sum(pool_delta) as d, min(block_number) as b from dt group by 1, 2),
tf as (select token_address, transaction_hash, coalesce(fs.b, ft.b) as block_number, fs.sender, coalesce(fs.n, 0) as swap_count, coalesce(ft.n, 0) as transfer_count, cast(coalesce(fs.d, 0) as decimal(38,0)) as swap_delta, cast(coalesce(ft.d, 0) as decimal(38,0)) as transfer_delta from fs full join ft using (token_address, transaction_hash)),
sf as (select token_address, sender, count(*) as n_tx, cast(sum(swap_count) as bigint) as swaps, cast(sum(greatest(swap_delta, 0)) as decimal(38,0)) as sell, cast(sum(greatest(-swap_delta, 0)) as decimal(38,0)) as buy, cast(sum(swap_delta) as decimal(38,0)) as net, cast(sum(transfer_delta) as decimal(38,0)) as actual from tf where swap_count > 0 group by 1, 2)
"""


def _signed(spark, d):
    raw = view(spark, d, "raw_swaps")
    out, first = F.col("target_delta_signed") < 0, F.col("token0_address") == "TGT"
    sign = lambda leaves: F.when(leaves, "-").otherwise("")
    raw = raw.withColumns({
        "pool_address": F.when(F.col("pool_address") == "manager", "p4").otherwise(F.col("pool_address")),
        "amount0": F.concat(F.when(first, sign(out)).otherwise(sign(~out)), "token0_raw"), "amount1": F.concat(F.when(first, sign(~out)).otherwise(sign(out)), "token1_raw"),
    })
    return wallets.signed_swaps(raw.select("token_address", "block_number", "log_index", "transaction_hash", "actor", "pool_address", "amount0", "amount1"), view(spark, d, "pools"), "TGT")


def _deltas(spark, d):
    transfers = view(spark, d, "transfers")
    # the token's busiest receiver stands in for its pool's custody
    n = transfers.groupBy("token_address", "to_address").agg(F.count("*").alias("n"))
    custody = n.groupBy("token_address").agg(F.max_by("to_address", F.struct("n", "to_address")).alias("pool_address"))
    return wallets.pool_transfer_deltas(transfers, custody, _signed(spark, d))


def _flows(spark, d):
    return wallets.tx_flows(_signed(spark, d), _deltas(spark, d))


def _text(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query("signed_swaps", SIGNED + """select token_address, block_number, log_index, pool_address, cast(target_delta as varchar) as target_delta, cast(quote_delta as varchar) as quote_delta, case when target_delta > 0 then 'SELL' when target_delta < 0 then 'BUY' else 'ZERO_TARGET' end as direction,
 round((cast(abs(quote_delta) as double) / case when quote in ('USDC', 'USDT') then 1e6 else 1e18 end) / nullif(cast(abs(target_delta) as double) / 1e18, 0), 9) as price from sw""")
def signed_swaps(spark, d):
    return _text(_signed(spark, d), "target_delta", "quote_delta").select("token_address", "block_number", "log_index", "pool_address", "target_delta", "quote_delta", "direction", F.round("price", 9).alias("price"))


@query("pool_transfer_deltas", SIGNED + "select token_address, transaction_hash, log_index, cast(pool_delta as varchar) as pool_delta, related_to_swap_tx from dt")
def pool_transfer_deltas(spark, d):
    return _text(_deltas(spark, d), "pool_delta").select("token_address", "transaction_hash", "log_index", "pool_delta", "related_to_swap_tx")


@query("tx_flows", SIGNED + "select token_address, transaction_hash, block_number, sender, swap_count, transfer_count, cast(swap_delta as varchar) as swap_delta, cast(transfer_delta as varchar) as transfer_delta, swap_count > 0 as has_swap, cast(cast(transfer_delta - swap_delta as decimal(38,0)) as varchar) as gap from tf")
def tx_flows(spark, d):
    return _text(_flows(spark, d), "swap_delta", "transfer_delta", "gap")


@query("sender_flows", SIGNED + "select token_address, sender, n_tx, swaps, cast(sell as varchar) as sell, cast(buy as varchar) as buy, cast(net as varchar) as net, cast(actual as varchar) as actual from sf")
def sender_flows(spark, d):
    return _text(wallets.sender_flows(_flows(spark, d)), "sell", "buy", "net", "actual")


@query("flow_reconciliation", SIGNED + """, tt as (select token_address, count(*) as transactions, count(*) filter (swap_count > 0) as swap_transactions, sum(greatest(transfer_delta, 0)) as ti, sum(greatest(-transfer_delta, 0)) as tout,
 sum(case when swap_count > 0 then transfer_delta else 0 end) as sn, sum(case when swap_count > 0 then 0 else transfer_delta end) as ot, sum(swap_delta) as se from tf group by 1),
rk as (select *, row_number() over (partition by token_address order by sell desc, sender) as r from sf), sl as (select token_address, count(*) as senders, round(cast(sum(sell) filter (r <= 5) as double) / nullif(cast(sum(sell) as double), 0), 9) as top_share from rk group by 1),
bc as (select token_address, cast(sum(case when last then balance_raw else 0 end) - sum(case when first then balance_raw else 0 end) as decimal(38,0)) as balance_change from (select b.token_address, balance_raw, row_number() over w = 1 as first, row_number() over v = 1 as last from balance_ledger b join cu on b.token_address = cu.token_address and b.address = cu.pool_address window w as (partition by b.token_address order by block_number), v as (partition by b.token_address order by block_number desc)) group by 1)
select token_address, transactions, swap_transactions, cast(cast(ti as decimal(38,0)) as varchar) as transfer_in, cast(cast(tout as decimal(38,0)) as varchar) as transfer_out, cast(cast(sn as decimal(38,0)) as varchar) as swap_net, cast(cast(ot as decimal(38,0)) as varchar) as other_net,
 cast(cast(se as decimal(38,0)) as varchar) as swap_event_net, senders, cast(balance_change as varchar) as balance_change, cast(cast(ti - tout - balance_change as decimal(38,0)) as varchar) as mismatch, cast(ti - tout - balance_change as decimal(38,0)) = 0 as exact, top_share from tt left join sl using (token_address) left join bc using (token_address)""")
def flow_reconciliation(spark, d):
    flows, deltas = _flows(spark, d), _deltas(spark, d)
    custody = deltas.select("token_address", F.col("pool_address").alias("address")).distinct()
    ledger = view(spark, d, "balance_ledger").join(custody, ["token_address", "address"], "left_semi")
    change = ledger.groupBy("token_address").agg((F.max_by("balance_raw", "block_number") - F.min_by("balance_raw", "block_number")).cast("decimal(38,0)").alias("balance_change"))
    out = wallets.flow_reconciliation(flows, wallets.sender_flows(flows), change)
    return _text(out, "transfer_in", "transfer_out", "swap_net", "other_net", "swap_event_net", "balance_change", "mismatch")


@query("wallet_clusters")
def wallet_clusters(spark, d):
    """Components of the wallet graph with their signals; no SQL form, tested against union-find."""
    from tidemark.sources.tables import checkpointed

    edges = _edges(spark, d)
    return wallets.cluster_confidence(wallets.wallet_clusters(edges, checkpointed), edges)


# risk

RISK = ctes("pools", "raw_swaps", "liquidity_events", "tvl_points", "transfers", "creations", "lp_nft") + ", " + PRICED + f", {INC}" + MIG + POS[POS.index(", p0 as") :] + """,
tk0 as (select distinct token_address from liquidity_events), wd0 as (select l.*, case when not (l.version = 'v4' and l.token0_amount = 0 and l.token1_amount = 0) then case when p.token0 = 'TGT' then l.token0_amount else l.token1_amount end end as amount from liquidity_events l join pools p using (pool_address) join inc using (token_address) where event_type = 'LIQUIDITY_REMOVE' and (incident_block = 0 or l.block_number <= incident_block)),
lt as (select token_address, pool_address, arg_max(tvl_raw, row(block_number, log_index)) as tvl_raw from tvl_points group by 1, 2), cn as (select token_address, max(tvl_raw) / sum(tvl_raw) as share, sum(tvl_raw) as total from lt group by 1),
sv as (select token_address, cast(sum(event_count) as bigint) as removals, coalesce(case when coalesce(cast(sum(amount) as double), 0) > any_value(cn.total) then 1.0::double else coalesce(cast(sum(amount) as double), 0) / any_value(cn.total) end, 0) as severity, coalesce(bool_or(abs(token0_amount) > 40000), false) as large_sells from wd0 left join cn using (token_address) group by 1),
px0 as (select token_address, count(*) as removals, max(block_number) filter (block_number <= incident_block) as b, any_value(incident_block) as ib from liquidity_events join inc using (token_address) where event_type = 'LIQUIDITY_REMOVE' group by 1),
px as (select tk0.token_address, coalesce(removals, 0) as removals, case when ib <> 0 then (ib - b) * 12 end as seconds, cast(case when coalesce(ib, 0) = 0 then case when coalesce(removals, 0) >= 10 then 0.45 when removals >= 3 then 0.25 when removals >= 1 then 0.1 else 0 end when (ib - b) * 12 < 3600 then 1.0 when (ib - b) * 12 < 21600 then 0.8 when (ib - b) * 12 < 86400 then 0.5 when (ib - b) * 12 < 604800 then 0.3 when b is not null then 0.1 else 0 end as double) as score from tk0 left join px0 using (token_address)),
dp as (select contract as token_address, arg_min(creator, row(block_number, creator)) as deployer from creations group by 1),
lb as (select token_address, deployer as address, 'Deployer' as label from dp union all select distinct sh.token_address, owner, 'Whale LP' from sh where share_pct >= 5),
rl as (select tk0.token_address, cast(case when dp.deployer is null then 0 when exists (select 1 from lb where lb.token_address = tk0.token_address and lb.address = dp.deployer) then 0.8 else 0.3 end as double) as score from tk0 left join dp using (token_address)),
im0 as (select token_address, cast(sum(cast(round(price, 9) as decimal(28,9))) filter (block_number <= incident_block) as double) / nullif(count(*) filter (block_number <= incident_block), 0) as b, cast(sum(cast(round(price, 9) as decimal(28,9))) filter (block_number > incident_block) as double) / nullif(count(*) filter (block_number > incident_block), 0) as a from pr join inc using (token_address) where price > 0 and unit = 'USD' and incident_block <> 0 group by 1),
im as (select tk0.token_address, round(b, 9) as before, round(a, 9) as after, round(case when b is null or a is null then 0 when (b - a) / b > 1 then 1 else (b - a) / b end, 9) as score from tk0 left join im0 using (token_address)),
lc as (select token_address, max(share_pct) as top from sh group by 1),
rk0 as (select tk0.token_address, coalesce(least(1.0::double, cn.share), 0) as f1, coalesce(least(1.0::double, cast(lc.top as double) / 100), 0) as f2, coalesce(sv.severity, 0) as f3, px.score as f4, rl.score as f5, im.score as f6, coalesce(sv.removals, 0) as n, coalesce(sv.large_sells, false) as large, exists (select 1 from mg where mg.token_address = tk0.token_address) as migrated
 from tk0 left join cn using (token_address) left join lc using (token_address) left join sv using (token_address) left join px using (token_address) left join rl using (token_address) left join im using (token_address)),
rk1 as (select *, cast(case when n > 3 and large then 1.0 when n > 1 or large then 0.5 else 0 end as double) as f7 from rk0),
rk2 as (select *, 0.15::double * f1 + 0.15::double * f2 + 0.20::double * f3 + 0.15::double * f4 + 0.15::double * f5 + 0.15::double * f6 + 0.05::double * f7 as raw, least(1.0::double, 0.55::double + 0.09::double * ((f1 > 0)::int + (f2 > 0)::int + (f3 > 0 or n > 0)::int + (f4 > 0)::int + (f6 > 0)::int + (f5 > 0)::int)) as ev from rk1),
rk as (select *, greatest(0.0::double, least(1.0::double, raw - case when migrated then 0.3::double else 0.0::double end)) * ev as fin from rk2)
"""


def _tokens(spark, d):
    return view(spark, d, "liquidity_events").select("token_address").distinct()


def _deployers(spark, d):
    return wallets.find_deployer(view(spark, d, "creations")).select(F.col("contract").alias("token_address"), "deployer")


def _position_labels(spark, d):
    return wallets.label_positions(_shares(spark, d), _deployers(spark, d))


def _proximity(spark, d, liq=None, incidents=None):
    liq = view(spark, d, "liquidity_events") if liq is None else liq
    return research.temporal_proximity(liq.select("token_address").distinct(), liq, _incidents(spark, d) if incidents is None else incidents)


def _impact(spark, d, tokens=None, incidents=None):
    return research.market_impact(_tokens(spark, d) if tokens is None else tokens, _priced(spark, d).where("unit = 'USD'"), _incidents(spark, d) if incidents is None else incidents)


def _role(spark, d, tokens=None, labels=None):
    return research.role_sensitivity(_tokens(spark, d) if tokens is None else tokens, _position_labels(spark, d) if labels is None else labels, _deployers(spark, d))


def _severity(spark, d, liq=None, tvl=None, incidents=None, pool=None):
    liq, tvl = (view(spark, d, n) if x is None else x for n, x in (("liquidity_events", liq), ("tvl_points", tvl)))
    events = market.withdrawal_events(liq, tvl, view(spark, d, "pools"), extra=["token0_amount"])
    return market.withdrawal_severity(events, market.pool_concentration(tvl) if pool is None else pool, _incidents(spark, d) if incidents is None else incidents, large=40_000)


@query("temporal_proximity", RISK + "select * from px")
def temporal_proximity(spark, d):
    return _proximity(spark, d)


@query("role_sensitivity", RISK + "select * from rl")
def role_sensitivity(spark, d):
    return _role(spark, d)


@query("market_impact", RISK + "select * from im")
def market_impact(spark, d):
    return _impact(spark, d)


@query("withdrawal_severity", RISK + "select token_address, removals, round(severity, 9) as severity, large_sells from sv")
def withdrawal_severity(spark, d):
    return _severity(spark, d).select("token_address", "removals", F.round("severity", 9).alias("severity"), "large_sells")


@query("risk_score", RISK + """select token_address, round(f1, 4) as f_pool, round(f2, 4) as f_lp, round(f3, 4) as f_severity, round(f4, 4) as f_proximity, round(f5, 4) as f_role, round(f6, 4) as f_impact, round(f7, 4) as f_combined, migrated,
 round(raw, 4) as raw_score, round(ev, 4) as evidence_confidence, round(fin, 4) as final_score, case when fin >= 0.7 then 'HIGH' when fin >= 0.4 then 'MEDIUM' else 'LOW' end as risk_level from rk""")
def risk_score(spark, d):
    from tidemark.operators import holders

    # each input once: the events, their small aggregates by token, and the shares of positions
    liq, tvl = checkpointed(view(spark, d, "liquidity_events")), checkpointed(view(spark, d, "tvl_points"))
    shares = checkpointed(_shares(spark, d).select("token_address", "pool_address", "token_id", "owner", "share_pct"))
    tokens, incidents, pool = checkpointed(liq.select("token_address").distinct()), checkpointed(research.incidents(liq)), checkpointed(market.pool_concentration(tvl))
    labels = wallets.label_positions(shares, _deployers(spark, d))
    moved = checkpointed(research.liquidity_migration(liq).select("token_address").distinct())
    return research.risk_score(
        tokens, pool, checkpointed(holders.lp_concentration(shares)), checkpointed(_severity(spark, d, liq, tvl, incidents, pool)), checkpointed(_proximity(spark, d, liq, incidents)),
        checkpointed(_role(spark, d, tokens, labels)), checkpointed(_impact(spark, d, tokens, incidents)), moved,
    )


@query("migration_flag", ctes("liquidity_events") + MIG + """, mv as (select *, row_number() over (partition by token_address order by remove_block, add_block, from_pool, to_pool, actor) as r from mg),
g as (select token_address, count(*) as moves, string_agg(cast(remove_block as varchar), ',' order by r) filter (r <= 5) as f from mv group by 1), a as (select token_address, count(coalesce(actor, recipient)) > 0 as actors_known from liquidity_events group by 1)
select token_address, coalesce(moves, 0) as moves, coalesce(moves, 0) > 0 as migration_detected, coalesce(f, '') as first_blocks, actors_known from a left join g using (token_address)""")
def migration_flag(spark, d):
    liq = view(spark, d, "liquidity_events")
    return research.migration_flag(research.liquidity_migration(liq), liq)


@query("report_events", ctes("liquidity_events") + f", {INC} select l.*, incident_block, cast(row_number() over (partition by token_address order by case when coalesce(incident_block, 0) = 0 then -l.block_number else l.block_number end, case when coalesce(incident_block, 0) = 0 then -l.log_index else l.log_index end) as int) as rank from liquidity_events l left join inc using (token_address) where coalesce(incident_block, 0) = 0 or abs(l.block_number - incident_block) <= 100 qualify rank <= 30")
def report_events(spark, d):
    return research.report_events(view(spark, d, "liquidity_events"), _incidents(spark, d))


@query("find_deployer", ctes("creations") + "select contract, arg_min(creator, row(block_number, creator)) as deployer, min(block_number) as block_number from creations group by 1")
def find_deployer(spark, d):
    return wallets.find_deployer(view(spark, d, "creations"))


@query("owner_contracts", ctes("transfers", "contract_owners") + ", a as (select distinct unnest([from_address, to_address]) as address from transfers), o as (select contract, min(owner) as o from contract_owners group by 1) select address, coalesce(o, address) as resolved_owner from a left join o on address = contract")
def owner_contracts(spark, d):
    addresses = view(spark, d, "transfers").select(F.explode(F.array("from_address", "to_address")).alias("address")).distinct()
    return wallets.owner_contracts(addresses, view(spark, d, "contract_owners"))


LABELS = ctes("lp_nft", "creations", "pools", "transfers") + POS[POS.index(", p0 as") :] + """, dp as (select contract as token_address, arg_min(creator, row(block_number, creator)) as deployer from creations group by 1),
wh as (select distinct token_address, owner as address from sh where share_pct >= 5), dpp as (select distinct sh.token_address, pool_address from sh join dp on sh.token_address = dp.token_address and sh.owner = dp.deployer),
co as (select distinct sh.token_address, owner as address from sh join dpp using (token_address, pool_address)),
lp0 as (select token_address, deployer as address, 'Deployer' as label, 'token_creator' as category, 1.0::double as confidence, 0 as pri from dp union all select token_address, address, 'Whale LP', 'large_liquidity_provider', 0.8::double, 1 from wh union all select token_address, address, 'Pool Co-LP with Deployer', 'associated_address', 0.6::double, 2 from co),
lp as (select * exclude (pri) from lp0 qualify row_number() over (partition by token_address, address order by pri) = 1)
"""


@query("label_positions", LABELS + "select * from lp")
def label_positions(spark, d):
    return _position_labels(spark, d)
