"""The research panel and what is computed from it, with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import panel, research
from tidemark.plans.flows import PRICED, _priced
from tidemark.plans.queries import query
from tidemark.sources.adapters import ctes, view

SIDE = """, count(distinct actor) as actors, cast(sum(case when actor is not null then event_count else 0 end) as bigint) as identified,
 cast(sum(case when event_type = 'LIQUIDITY_ADD' then event_count else 0 end) as bigint) as add_count, cast(sum(case when event_type = 'LIQUIDITY_ADD' and known then event_count else 0 end) as bigint) as add_known,
 cast(sum(case when event_type = 'LIQUIDITY_ADD' then amount end) as double) / 100.0 as add_amount,
 cast(sum(case when event_type = 'LIQUIDITY_REMOVE' then event_count else 0 end) as bigint) as remove_count, cast(sum(case when event_type = 'LIQUIDITY_REMOVE' and known then event_count else 0 end) as bigint) as remove_known,
 cast(sum(case when event_type = 'LIQUIDITY_REMOVE' then amount end) as double) / 100.0 as remove_amount"""
PANEL = ctes("pools", "raw_swaps", "liquidity_events", "tvl_points") + ", " + PRICED + f""",
s0 as (select token_address, unnest([pool, '*']) as pool, block_timestamp // 3600 * 3600 as bucket, block_number, log_index, block_timestamp, price, unit, source, target, usd, actor from pr where target is not null),
s1 as (select *, first_value(unit) over (partition by token_address, pool, bucket order by case when price is null then 1 else 0 end, block_number, log_index) as u from s0 where pool is not null),
px as (select token_address, pool, bucket, arg_min(price, row(block_number, log_index)) filter (unit = u) as open, max(price) filter (unit = u) as high, min(price) filter (unit = u) as low, arg_max(price, row(block_number, log_index)) filter (unit = u) as close,
 round(cast(sum(cast(round(price * target, 6) as decimal(24,6))) filter (unit = u) as double) / nullif(cast(sum(cast(round(target, 6) as decimal(24,6))) filter (unit = u) as double), 0), 6) as vwap,
 max(u) as price_unit, case when count(distinct source) filter (unit = u) > 1 then 'mixed' else max(source) filter (unit = u) end as price_source, max(block_timestamp) filter (unit = u) as last_trade,
 cast(sum(cast(round(target, 6) as decimal(24,6))) as double) as volume, cast(sum(usd) as double) as volume_usd, count(*) as swap_count, count(distinct actor) as active_traders from s1 group by 1, 2, 3),
l0 as (select l.*, not (l.version = 'v4' and l.token0_amount = 0 and l.token1_amount = 0) as known, case when not (l.version = 'v4' and l.token0_amount = 0 and l.token1_amount = 0) then case when p.token0 = 'TGT' then l.token0_amount else l.token1_amount end end as amount,
 l.block_timestamp // 3600 * 3600 as bucket, unnest([l.pool_address, '*']) as pool from liquidity_events l join pools p using (pool_address)),
fl as (select token_address, pool, bucket{SIDE} from l0 group by 1, 2, 3),
st as (select token_address, pool_address as pool, block_timestamp // 3600 * 3600 as bucket, arg_max(tvl_raw, row(block_number, log_index)) / 100.0 as tvl, max(block_number) as snapshot_block from tvl_points group by 1, 2, 3),
ac as (select token_address, pool, bucket from px union all select token_address, pool, bucket from fl union all select token_address, pool, bucket from st),
bd as (select token_address, min(bucket) as lo, max(bucket) as hi from ac group by 1),
sp as (select o.token_address, o.pool, unnest(range(lo, hi + 1, 3600)) as bucket from (select distinct token_address, pool from ac where pool <> '*') o join bd using (token_address)),
c0 as (select sp.*, case when st.snapshot_block is not null then sp.bucket end as own_bucket, st.tvl, st.snapshot_block from sp left join st using (token_address, pool, bucket)),
cr as (select token_address, pool, bucket, last_value(own_bucket ignore nulls) over w as state_bucket, last_value(tvl ignore nulls) over w as tvl, last_value(snapshot_block ignore nulls) over w as snapshot_block from c0
 window w as (partition by token_address, pool order by bucket rows between unbounded preceding and current row)),
tt as (select token_address, bucket, min(state_bucket) as state_bucket, case when count(state_bucket) = count(tvl) and count(state_bucket) > 0 then cast(sum(cast(round(tvl, 6) as decimal(28,6))) as double) end as tvl, max(snapshot_block) as snapshot_block, count(state_bucket) as measured from cr group by 1, 2),
al as (select token_address, unnest(range(lo, hi + 1, 3600)) as bucket from bd),
bt as (select token_address, pool, bucket, state_bucket, tvl, snapshot_block, case when state_bucket is null then 0 else 1 end as measured_pools, 1 as verified_pools from cr
 union all select al.token_address, '*', al.bucket, state_bucket, tvl, snapshot_block, coalesce(measured, 0), (select count(*) from pools where verified) from al left join tt using (token_address, bucket)),
jn as (select bt.*, px.* exclude (token_address, pool, bucket), fl.* exclude (token_address, pool, bucket) from bt left join px using (token_address, pool, bucket) left join fl using (token_address, pool, bucket)
 where state_bucket is not null or swap_count > 0 or add_count > 0 or remove_count > 0),
k0 as (select *, last_value(close ignore nulls) over w as pc, last_value(case when close is not null then price_unit end ignore nulls) over w as cu, last_value(case when close is not null then price_source end ignore nulls) over w as cs, last_value(case when close is not null then last_trade end ignore nulls) over w as lt,
 max(actors) over (partition by token_address) > 0 as identifiable, case when coalesce(add_count, 0) = 0 then 0.0 else add_amount end as la, case when coalesce(remove_count, 0) = 0 then 0.0 else remove_amount end as lr,
 round(add_known::double / nullif(add_count, 0), 9) as acv, round(remove_known::double / nullif(remove_count, 0), 9) as rcv
 from jn window w as (partition by token_address, pool order by bucket rows between unbounded preceding and current row)),
k1 as (select *, lag(pc) over w as bp, lag(cu) over w as bu, lag(tvl) over w as bt from k0 window w as (partition by token_address, pool order by bucket)),
series as (select token_address, case when pool = '*' then 'token_total' else 'pool' end as scope, nullif(pool, '*') as pool_identifier, bucket as bucket_start, bucket + 3600 as bucket_end, 3600 as bucket_seconds,
 round(open, 9) as price_open, round(high, 9) as price_high, round(low, 9) as price_low, round(pc, 9) as price_close, round(vwap, 9) as price_vwap, cu as price_unit, cs as price_source, case when lt is not null then greatest(0, bucket + 3600 - lt) end as staleness,
 close is null and pc is not null as price_is_carried, round(tvl, 9) as tvl_token_close, snapshot_block, state_bucket, coalesce(state_bucket <> bucket, false) as tvl_is_carried, round(volume, 9) as volume_token, round(volume_usd, 9) as volume_usd,
 coalesce(swap_count, 0) as swap_count, coalesce(active_traders, 0) as active_trader_count, round(la, 9) as liquidity_added, round(lr, 9) as liquidity_removed, round(la - lr, 9) as net_lp_flow, coalesce(add_count, 0) as lp_add_event_count, coalesce(remove_count, 0) as lp_remove_event_count,
 case when identifiable then coalesce(actors, 0) end as active_lp_count, case when identifiable then round(identified::double / nullif(coalesce(add_count, 0) + coalesce(remove_count, 0), 0), 9) end as identity_coverage, acv as add_amount_coverage, rcv as withdrawal_amount_coverage, measured_pools, verified_pools,
 case when cu = bu and pc > 0 and bp > 0 then round(ln(pc / bp), 9) end as price_return, case when tvl > 0 and bt > 0 then round(ln(tvl / bt), 9) end as tvl_change, case when bt > 0 then round((la - lr) / bt, 9) end as net_lp_flow_ratio, case when bt > 0 then round(lr / bt, 9) end as withdrawal_ratio, case when bt > 0 then round(volume / bt, 9) end as volume_turnover,
 round(close / nullif(vwap, 0) - 1, 6) as close_vwap_gap,
 'price=' || case when close is not null then 'observed' when pc is not null then 'carried' else 'missing' end || ';tvl=' || case when coalesce(state_bucket <> bucket, false) then 'carried' when state_bucket is not null then 'observed' else 'missing' end || ';lp_amount=' || case when coalesce(add_count, 0) + coalesce(remove_count, 0) = 0 then 'none' when coalesce(acv, 1) = 1 and coalesce(rcv, 1) = 1 then 'quantified' else 'partial' end as data_coverage,
 (close is null and pc is not null) or coalesce(state_bucket <> bucket, false) as is_imputed from k1)
"""
FEATURES = ["price_return", "tvl_change", "net_lp_flow_ratio", "withdrawal_ratio", "volume_turnover", "swap_count"]


def _series(spark, d):
    return panel.analysis_series(_priced(spark, d), view(spark, d, "liquidity_events"), view(spark, d, "tvl_points"), view(spark, d, "pools"), decimals=2)


@query("analysis_series", PANEL + "select * from series")
def analysis_series(spark, d):
    return _series(spark, d)


@query("series_summary", PANEL + """, g as (select token_address, count(*) as n_rows, count(*) filter (scope = 'token_total') as total_rows, count(price_vwap) as vwap_rows, count(tvl_token_close) as tvl_rows, count(*) filter (is_imputed) as imputed_rows,
 max(measured_pools) filter (scope = 'token_total') as max_measured_pools, max(verified_pools) as verified_pools, max(staleness) as max_staleness, count(*) filter (scope = 'token_total' and lp_remove_event_count > 0 and liquidity_removed is null) as unknown_removals,
 min(identity_coverage) as least_identity_coverage, count(distinct bucket_start) as buckets from series group by 1)
select *, vwap_rows = 0 as warn_no_vwap, max_measured_pools < verified_pools as warn_partial_tvl, unknown_removals > 0 as warn_unknown_removals, least_identity_coverage is null as warn_no_identity from g""")
def series_summary(spark, d):
    return panel.series_summary(_series(spark, d))


@query("price_unit_choice", PANEL + """, n as (select token_address, price_unit, count(*) as n from series where price_unit is not null group by 1, 2)
select token_address, arg_max(price_unit, row(price_unit = 'USD', n, price_unit)) as price_unit, cast(sum(n) - arg_max(n, row(price_unit = 'USD', n, price_unit)) as bigint) as rows_left_out from n group by 1""")
def price_unit_choice(spark, d):
    return panel.price_unit_choice(_series(spark, d))


@query("matched_pool_panel", PANEL + ", f as (select token_address, min(pool_identifier) as p from series where scope = 'pool' group by 1) select series.* from series join f on series.token_address = f.token_address and pool_identifier = f.p where price_close is not null and tvl_token_close is not null")
def matched_pool_panel(spark, d):
    series = _series(spark, d)
    first = series.where("scope = 'pool'").groupBy("token_address").agg(F.min("pool_identifier").alias("_p"))
    return panel.matched_pool_panel(series.join(first, "token_address"), F.col("_p")).drop("_p")


def _pairs(ordered: bool) -> str:
    parts = [f"select token_address, '{a}' as x, '{b}' as y, cast({a} as double) as u, cast({b} as double) as v from series where scope = 'token_total'" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if (ordered or j > i)]
    return ", pq as (" + " union all ".join(parts) + "), pn as (select * from pq where u is not null and v is not null)"


R = "case when count(*) >= 3 then round(covar_pop(u, v) / nullif(stddev_pop(u) * stddev_pop(v), 0), 6) end"
CORR = PANEL + _pairs(False) + f""", rn as (select token_address, x, y, rank() over (partition by token_address, x, y order by u) + (count(*) over (partition by token_address, x, y, u) - 1) / 2 as u, rank() over (partition by token_address, x, y order by v) + (count(*) over (partition by token_address, x, y, v) - 1) / 2 as v from pn),
cc as (select token_address, x, y, count(*) as n, {R} as r, 'pearson' as method from pn group by 1, 2, 3 having count(*) >= 8 union all select token_address, x, y, count(*), {R}, 'spearman' from rn group by 1, 2, 3 having count(*) >= 8)"""


def _correlations(spark, d):
    return research.correlations(_series(spark, d).where("scope = 'token_total'"), FEATURES, ["token_address"])


@query("correlations", CORR + "select * from cc")
def correlations(spark, d):
    return _correlations(spark, d)


@query("strongest_correlations", CORR + "select *, cast(row_number() over (partition by token_address order by abs(r) desc, x, y, method) as int) as rank from cc where r is not null qualify rank <= 10")
def strongest_correlations(spark, d):
    return research.strongest(_correlations(spark, d), ["token_address"])


@query("corr_matrix", PANEL + _pairs(True) + f" select token_address, x, y, count(*) as n, coalesce({R}, 0) as r from pn group by 1, 2, 3")
def corr_matrix(spark, d):
    return research.corr_matrix(_series(spark, d).where("scope = 'token_total'"), FEATURES, ["token_address"])


@query("activity_series", PANEL + """, ts as (select token_address, bucket, cast(sum(tvl) as double) as tvl from st group by 1, 2), tr as (select token_address, bucket, volume, active_traders from px where pool = '*'), lf as (select token_address, bucket, actors as active_lps, add_count + remove_count as lp_events from fl where pool = '*')
select al.token_address, al.bucket, coalesce(round(tvl, 6), 0) as tvl, coalesce(round(volume, 6), 0) as volume, coalesce(active_lps, 0) as active_lps, coalesce(lp_events, 0) as lp_events, coalesce(active_traders, 0) as active_addresses
 from al left join ts using (token_address, bucket) left join tr using (token_address, bucket) left join lf using (token_address, bucket)""")
def activity_series(spark, d):
    by = ["token_address", "bucket"]
    swaps = _priced(spark, d).withColumn("pool", F.lit(panel.ALL))
    from tidemark.operators.prices import ohlc

    px = ohlc(swaps, ["token_address", "pool"]).select(*by, F.round(F.col("volume").cast("double"), 6).alias("volume"), F.col("active_traders").alias("active_addresses"))
    flow = panel.lp_flow(view(spark, d, "liquidity_events"), view(spark, d, "pools"), decimals=2).select(*by, "pool", F.col("actors").alias("active_lps"), (F.col("add_count") + F.col("remove_count")).alias("lp_events"))
    states = panel.tvl_states(view(spark, d, "tvl_points"), decimals=2)
    tvl = states.groupBy(*by).agg(F.round(F.sum(F.round("tvl", 6).cast("decimal(28,6)")).cast("double"), 6).alias("tvl"))
    active = px.select(*by).union(flow.select(*by)).union(states.select(*by))
    spine = active.groupBy("token_address").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select("token_address", F.explode(F.sequence("lo", "hi", F.lit(3600).cast("long"))).alias("bucket"))
    total = flow.where(F.col("pool") == panel.ALL)
    return research.activity_series(spine, {"tvl": tvl, "volume": px, "active_lps": total, "lp_events": total, "active_addresses": px}, by)


@query("feature_log1p", PANEL + "select token_address, bucket_start, case when volume_token >= 0 then round(ln(1 + volume_token), 9) end as log_volume from series where scope = 'token_total'")
def feature_log1p(spark, d):
    return _series(spark, d).where("scope = 'token_total'").select("token_address", "bucket_start", F.round(research.feature_log1p(F.col("volume_token")), 9).alias("log_volume"))
