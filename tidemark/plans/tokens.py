"""From raw logs of many tokens, each of its own decimals, to prices and TVL, with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars, ticks
from tidemark.operators import charts, events, prices, states
from tidemark.plans.queries import _positions, query
from tidemark.sources.adapters import ctes, view
from tidemark.sources.tables import conform

#: Canonical events of v2 and v3 logs; amounts as numbers of 38 digits.
EVENTS = ctes("raw_logs", "token_meta", "log_pools", "pool_logs") + """,
lg as (
  select *, cast(amount0 as decimal(38,0)) as x0, cast(amount1 as decimal(38,0)) as x1, cast(amount0_in as decimal(38,0)) as i0,
    cast(amount1_in as decimal(38,0)) as i1, cast(amount0_out as decimal(38,0)) as o0, cast(amount1_out as decimal(38,0)) as o1
  from pool_logs),
en as (
  select token_address, block_number, log_index, block_timestamp, pool_address, event_name as source_event, liquidity,
    case event_name when 'Swap' then 'SWAP' when 'Mint' then 'LIQUIDITY_ADD' when 'Burn' then 'LIQUIDITY_REMOVE' when 'Sync' then 'SYNC' end as event_type,
    case when family = 'v2' and event_name = 'Swap' then case when i0 > 0 then i0 else -o0 end else abs(x0) end as a0,
    case when family = 'v2' and event_name = 'Swap' then case when i1 > 0 then i1 else -o1 end else abs(x1) end as a1
  from lg where event_name in ('Swap', 'Mint', 'Burn', 'Sync'))
"""
#: With the pool, whole amounts and the side of the target.
SIDES = EVENTS + """,
sd as (
  select en.*, p.protocol, p.version, p.verified, p.decimals, p.quote_decimals, p.token0 = p.target as first,
    case when p.token0 = p.target then p.token1 else p.token0 end as quote,
    cast(cast(abs(case when p.token0 = p.target then a0 else a1 end) as varchar) as double) / pow(10.0, p.decimals) as whole,
    cast(cast(abs(case when p.token0 = p.target then a1 else a0 end) as varchar) as double) / pow(10.0, p.quote_decimals) as quoted
  from en join log_pools p on p.pool_address = en.pool_address)
"""


def _events(spark, d):
    logs = view(spark, d, "pool_logs")
    v2, v3 = logs.where("family = 'v2'"), logs.where("family = 'v3_pool'")
    return events.normalize_v2(v2).unionByName(events.normalize_v2_sync(v2)).unionByName(events.normalize_v3_pool(v3))


def _dimensions(spark, d):
    return view(spark, d, "log_pools"), view(spark, d, "token_meta"), view(spark, d, "quote_assets")


@query("token_meta", ctes("token_meta", "raw_logs") + """
select m.token_address, target, symbol, decimals, count(*) as logs
from token_meta m join raw_logs r on lower(r.token_address) = m.token_address group by all""")
def token_meta(spark, d):
    """Each token's address, symbol and decimals, and how many logs it has."""
    logs = view(spark, d, "raw_logs").groupBy(F.lower("token_address").alias("token_address")).agg(F.count("*").alias("logs"))
    return view(spark, d, "token_meta").join(logs, "token_address").select("token_address", "target", "symbol", "decimals", "logs")


@query("prices_from_logs", SIDES + """
select token_address, block_number, log_index, pool_address as pool, case when first then 0 else 1 end as side, quote, round(whole, 9) as target,
  round(quoted, 9) as quote_amount, case when whole > 0 and quoted > 0 then round(quoted / whole, 9) end as price,
  case when whole > 0 and quoted > 0 then quote end as unit, case when quote <> 'weth' and quoted > 0 then round(quoted, 6) end as usd
from sd where event_type = 'SWAP'""")
def prices_from_logs(spark, d):
    """Raw logs -> canonical swaps -> prices, of tokens of 18, 6 and 8 decimals in one job."""
    pools, tokens, quotes = _dimensions(spark, d)
    swaps = conform(_events(spark, d).where("event_type = 'SWAP'"), "swaps")
    rows = prices.priced_swaps(swaps, pools, tokens=tokens, quotes=quotes)
    rounded = [F.round(c, 9).alias(c) for c in ("target", "quote_amount", "price")]
    return rows.select("token_address", "block_number", "log_index", "pool", "side", "quote", *rounded, "unit", F.col("usd").cast("double").alias("usd"))


@query("tvl_events_v2", SIDES + """,
st as (
  select *, case when event_type = 'LIQUIDITY_REMOVE' then -abs(a0) when event_type = 'LIQUIDITY_ADD' then abs(a0) else a0 end as d0,
    case when event_type = 'LIQUIDITY_REMOVE' then -abs(a1) when event_type = 'LIQUIDITY_ADD' then abs(a1) else a1 end as d1,
    count(*) filter (event_type = 'SYNC') over (partition by pool_address order by block_number, log_index rows unbounded preceding) as part
  from sd where verified and version = 'v2'),
sm as (select *, sum(d0) over w as s0, sum(d1) over w as s1 from st window w as (partition by pool_address, part order by block_number, log_index rows unbounded preceding)),
rs as (
  select *, cast(s0 - least(0, min(s0) over w) as decimal(38,0)) as reserve0, cast(s1 - least(0, min(s1) over w) as decimal(38,0)) as reserve1
  from sm window w as (partition by pool_address, part order by block_number, log_index rows unbounded preceding)),
pr as (
  select *, cast(cast(case when first then reserve0 else reserve1 end as varchar) as double) / pow(10.0, decimals) as mine,
    cast(cast(case when first then reserve1 else reserve0 end as varchar) as double) / pow(10.0, quote_decimals) as other from rs)
select token_address, pool_address, block_number, log_index, event_type, reserve0, reserve1,
  cast(case when first then reserve0 else reserve1 end * 2 as decimal(38,0)) as tvl_in_token, quote,
  case when mine <> 0 and other <> 0 then round(other / mine, 9) end as price from pr""")
def tvl_events_v2(spark, d):
    rows = states.tvl_events_v2(_events(spark, d), *_dimensions(spark, d))
    return rows.select("token_address", "pool_address", "block_number", "log_index", "event_type", "reserve0", "reserve1", "tvl_in_token", "quote", F.round("price", 9).alias("price"))


@query("tvl_events_v3", SIDES + """,
st as (
  select *, cast(case event_type when 'LIQUIDITY_ADD' then 1 when 'LIQUIDITY_REMOVE' then -1 else 0 end * cast(liquidity as decimal(30,0)) as decimal(38,0)) as dl
  from sd where verified and version = 'v3'),
sm as (select *, sum(dl) over (partition by pool_address order by block_number, log_index rows unbounded preceding) as s from st)
select token_address, pool_address, block_number, log_index, event_type, quote_of.quote, liquidity, tvl_in_token, price from (
  select *, cast(s - least(0, min(s) over (partition by pool_address order by block_number, log_index rows unbounded preceding)) as decimal(38,0)) as liquidity,
    cast(case when first then a0 else a1 end * case when event_type = 'SWAP' then 1 else 2 end as decimal(38,0)) as tvl_in_token,
    case when event_type = 'SWAP' and a0 > 0 and a1 > 0 then round(quoted / whole, 9) end as price,
    struct_pack(quote := case when event_type = 'SWAP' and a0 > 0 and a1 > 0 then quote end) as quote_of
  from (select * exclude (liquidity) from sm))""")
def tvl_events_v3(spark, d):
    rows = states.tvl_events_v3(_events(spark, d), *_dimensions(spark, d))
    return rows.select("token_address", "pool_address", "block_number", "log_index", "event_type", "quote", "liquidity", "tvl_in_token", F.round("price", 9).alias("price"))


def _priced(spark, d):
    pools, tokens, quotes = _dimensions(spark, d)
    return prices.priced_swaps(conform(_events(spark, d).where("event_type = 'SWAP'"), "swaps"), pools, tokens=tokens, quotes=quotes)


RESERVES = SIDES + """,
st as (
  select *, case when event_type = 'LIQUIDITY_REMOVE' then -abs(case when first then a0 else a1 end) when event_type = 'LIQUIDITY_ADD' then abs(case when first then a0 else a1 end)
      else case when first then a0 else a1 end end as d,
    count(*) filter (event_type = 'SYNC') over (partition by pool_address order by block_number, log_index rows unbounded preceding) as part
  from sd where verified and version = 'v2'),
sm as (select *, sum(d) over (partition by pool_address, part order by block_number, log_index rows unbounded preceding) as s from st),
tv as (
  select token_address, block_number, log_index, block_timestamp, pool_address as pool,
    cast(2 * (s - least(0, min(s) over (partition by pool_address, part order by block_number, log_index rows unbounded preceding))) as decimal(38,0)) as tvl from sm),
vl as (select token_address, block_timestamp // 3600 * 3600 as bucket, pool_address as pool, cast(sum(cast(round(whole, 6) as decimal(28,6))) as decimal(38,6)) as volume from sd where event_type = 'SWAP' group by 1, 2, 3)
"""


def _reserves(spark, d):
    rows = states.tvl_events_v2(_events(spark, d), *_dimensions(spark, d))
    return rows.select("token_address", "block_number", "log_index", "block_timestamp", F.col("pool_address").alias("pool"), F.col("tvl_in_token").alias("tvl"), "price")


def _volume(spark, d):
    rows = _priced(spark, d).where("pool is not null and target is not null").withColumn("bucket", scalars.bucket_ts(F.col("block_timestamp"), 3600))
    return rows.groupBy("token_address", "bucket", "pool").agg(F.sum(F.round("target", 6).cast("decimal(28,6)")).cast("decimal(38,6)").alias("volume"))


def _text(column: str):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("pool_matrices", RESERVES + """,
tm as (select token_address, block_timestamp // 3600 * 3600 as bucket, pool, arg_max(tvl, row(block_number, log_index)) as tvl from tv group by 1, 2, 3),
pm as (
  select token_address, block_timestamp // 3600 * 3600 as bucket, pool_address as pool, arg_max(cast(round(quoted / whole * 1e6) as bigint), row(block_number, log_index)) as p
  from sd where event_type = 'SWAP' and whole > 0 and quoted > 0 group by 1, 2, 3),
cells as (
  select token_address, bucket, string_agg(pool || '=' || tvl::varchar, ',' order by pool) as tvl, null as price, null as volume from tm group by 1, 2
  union all select token_address, bucket, null, string_agg(pool || '=' || p::varchar, ',' order by pool), null from pm group by 1, 2
  union all select token_address, bucket, null, null, string_agg(pool || '=' || volume::varchar, ',' order by pool) from vl group by 1, 2)
select token_address, bucket, max(tvl) as tvl, max(price) as price_e6, max(volume) as volume from cells group by 1, 2""")
def pool_matrices(spark, d):
    """Of each hour the TVL, price and volume of every pool that has one, as maps of pools."""
    hour = scalars.bucket_ts(F.col("block_timestamp"), 3600)
    order = ["block_number", "log_index"]
    tvl = charts.pool_matrix(_reserves(spark, d).withColumn("bucket", hour), "bucket", F.col("tvl"), "tvl", order)
    price = charts.pool_matrix(_priced(spark, d).withColumn("bucket", hour), "bucket", F.round(F.col("price") * 1e6).cast("long"), "price_e6", order)
    volume = charts.pool_matrix(_volume(spark, d), "bucket", F.col("volume"), "volume")
    rows = tvl.join(price, ["token_address", "bucket"], "full_outer").join(volume, ["token_address", "bucket"], "full_outer")
    return rows.select("token_address", "bucket", *[_text(c).alias(c) for c in ("tvl", "price_e6", "volume")])


@query("point_details", RESERVES + """,
pt as (select token_address, block_timestamp as "at", pool, max(tvl) as tvl from tv group by 1, 2, 3),
tt as (select token_address, "at", sum(tvl) as total from pt group by 1, 2),
bk as (select distinct token_address, bucket from vl),
tb as (select tt.*, bk.bucket as volume_bucket from tt asof left join bk on tt.token_address = bk.token_address and tt."at" >= bk.bucket)
select pt.token_address, pt."at" as point_time, pt.pool, cast(tvl as decimal(38,0)) as tvl, round(100 * cast(cast(tvl as varchar) as double) / nullif(cast(cast(cast(total as decimal(38,0)) as varchar) as double), 0), 6) as share_pct, tb.volume_bucket, volume,
  pt."at" - tb.volume_bucket < 3600 as covered
from pt join tb on pt.token_address = tb.token_address and pt."at" = tb."at" left join vl on vl.token_address = pt.token_address and vl.bucket = tb.volume_bucket and vl.pool = pt.pool""")
def point_details(spark, d):
    """Share, and the volume of the covering bucket or the nearest earlier one, of each pool at each time."""
    tvl = _reserves(spark, d).groupBy("token_address", F.col("block_timestamp").alias("at"), "pool").agg(F.max("tvl").alias("tvl"), F.max("price").alias("price"))
    rows = charts.point_details(tvl, _volume(spark, d))
    return rows.select("token_address", F.col("at").alias("point_time"), "pool", "tvl", F.round("share_pct", 6).alias("share_pct"), "volume_bucket", "volume", "covered")


@query("position_amounts_exact")
def position_amounts_exact(spark, d):
    """Both amounts of every open position, exact at any size, at the mean tick of its pool's positions. Beyond SQL's numbers."""
    positions = _positions(spark, d)
    at = positions.groupBy("pool_address").agg(F.floor(F.avg((F.col("tick_lower") + F.col("tick_upper")) / 2)).cast("int").alias("tick")).withColumn("root_price", ticks.root_text("tick"))
    rows = positions.join(at, "pool_address").withColumn("x", ticks.exact_amounts("root_price", "tick_lower", "tick_upper", F.concat(F.col("liquidity").cast("string"), F.lit("0" * 18))))
    return rows.select("token_address", "token_id", "pool_address", "owner", "root_price", "x.amount0", "x.amount1")


@query("volume_by_month", SIDES + """
select token_address, cast(epoch(date_trunc('month', make_timestamp(block_timestamp * 1000000))) as bigint) as bucket, pool_address as pool,
  cast(sum(cast(round(whole, 6) as decimal(24,6))) as decimal(34,6)) as volume,
  cast(sum(case when quote <> 'weth' and quoted > 0 then cast(round(quoted, 6) as decimal(24,6)) else 0 end) as decimal(34,6)) as volume_usd, count(*) as swap_count
from sd where event_type = 'SWAP' group by 1, 2, 3""")
def volume_by_month(spark, d):
    return prices.volume_timeline(_priced(spark, d), "month")


@query("last_days_window", SIDES + """
, w as (select token_address, max(block_number) as last from en group by 1)
select w.token_address, greatest(1, last - 50399) as start_block, last as end_block, count(*) as events
from w join en on en.token_address = w.token_address and en.block_number between greatest(1, last - 50399) and last group by 1, 2, 3""")
def last_days_window(spark, d):
    """The last seven days of each token's blocks, and its events in them."""
    rows = _events(spark, d)
    rows = rows.where(F.col("event_type").isin("SWAP", "LIQUIDITY_ADD", "LIQUIDITY_REMOVE", "SYNC"))
    spans = rows.groupBy("token_address").agg(F.max("block_number").alias("last")).select("token_address", scalars.block_window(F.col("last"), 7, ends=True).alias("w"))
    kept = rows.join(spans, "token_address").where(F.col("block_number").between(F.col("w.start"), F.col("w.end")))
    return kept.groupBy("token_address", F.col("w.start").alias("start_block"), F.col("w.end").alias("end_block")).agg(F.count("*").alias("events"))


@query("tvl_total_series", RESERVES + """,
tu as (
  select tv.*, cast(cast(tvl as varchar) as double) / pow(10.0, p.decimals) as whole, p.quote, p.quote_decimals, p.first
  from tv join (select *, case when token0 = target then token1 else token0 end as quote, token0 = target as first from log_pools) p on p.pool_address = tv.pool),
uv as (select *, case when token_address <> 't1' and quote <> 'weth' then whole * 2 end as usd from tu),
la as (
  select token_address, block_timestamp // 3600 * 3600 as bucket, pool, arg_max(cast(round(coalesce(usd, whole), 6) as decimal(34,6)), row(block_number, log_index)) as v
  from uv group by 1, 2, 3),
un as (select token_address, case when count(usd) > 0 then 'USD' else 'token' end as unit from uv group by 1)
select token_address, bucket, cast(sum(v) as double) as total, count(*) as pools, any_value(unit) as unit from la join un using (token_address) group by 1, 2""")
def tvl_total_series(spark, d):
    """Totals of the hour's pools, in USD for tokens that have a USD value at all (here, two a token in pools of a stable quote)."""
    pools, tokens, _ = _dimensions(spark, d)
    quote = pools.select(F.col("pool_address").alias("pool"), F.when(F.col("token0") == F.col("target"), F.col("token1")).otherwise(F.col("token0")).alias("quote"), "decimals")
    rows = _reserves(spark, d).join(quote, "pool").withColumn("tvl", F.col("tvl").cast("double") / F.pow(F.lit(10.0), "decimals"))
    known = (F.col("token_address") != "t1") & (F.col("quote") != "weth")
    rows = rows.withColumns({"tvl_usd": F.when(known, F.col("tvl") * 2), "bucket": scalars.bucket_ts(F.col("block_timestamp"), 3600)})
    return charts.total_series(rows, "bucket", ["block_number", "log_index"])
