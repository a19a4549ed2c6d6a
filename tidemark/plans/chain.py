"""Pools and events from raw topics and data, with SQL over the fields that these were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.operators import discovery, events, verification
from tidemark.operators import pools as L
from tidemark.operators import positions as P
from tidemark.plans.queries import POS, _shares, query
from tidemark.sources.adapters import ctes, view

FIELDS = ctes("chain_fields", "token_addresses") + """,
made as (
  select *, '0x' || lpad(lower(hex(a)), 40, '0') as t0, '0x' || lpad(lower(hex(b)), 40, '0') as t1,
    case family when 'v4' then '0x' || rpad(lower(hex(pool)), 64, '7') when 'balancer' then '0x' || rpad(lower(hex(pool)), 40, '7')
      else '0x' || lpad(lower(hex(pool)), 40, '0') end as address
  from chain_fields)
"""


@query("pools_from_logs", FIELDS + """
, hit as (
  select t.token_address, family, address, pool, t0, t1, block_number, transaction_hash, row_number() over (partition by t.token_address, family, address order by block_number, transaction_hash) as r
  from made m join token_addresses t on t.target = m.t0 or t.target = m.t1 where raw_type in ('signup', 'view'))
select token_address, family, address as pool_address, t0 as token0, t1 as token1, case when family = 'balancer' then 3 else 2 end as n_tokens,
  case family when 'v3' then 500 when 'v4' then 3000 end as fee, case family when 'v3' then 10 when 'v4' then 60 end as tick_spacing,
  case when family = 'v4' then '0x' || lpad(case when pool % 2 = 0 then '0' else 'abc' end, 40, '0') end as hooks, block_number as creation_block, transaction_hash as creation_tx
from hit where r = 1""")
def pools_from_logs(spark, d):
    """Pools of all tokens from creation logs of four families; a pool's first creation holds."""
    rows = discovery.discover(view(spark, d, "chain_logs"), view(spark, d, "token_addresses"))
    return rows.select("token_address", "family", "pool_address", "token0", "token1", F.size("tokens").alias("n_tokens"), "fee", "tick_spacing", "hooks", "creation_block", "creation_tx")


def _verified(spark, d):
    tokens = view(spark, d, "token_addresses")
    found = discovery.discover(view(spark, d, "chain_logs"), tokens)
    rows = verification.facts(found, tokens, view(spark, d, "deployments"), view(spark, d, "pool_answers"), view(spark, d, "pool_codes"), (1, 1000))
    return verification.verify(rows)


VERIFIED = FIELDS + """
, hit as (
  select t.token_address, family, address, pool, t0, t1, t.target, block_number, row_number() over (partition by t.token_address, family, address order by block_number, transaction_hash) as r
  from made m join token_addresses t on t.target = m.t0 or t.target = m.t1 where raw_type in ('signup', 'view')),
told as (
  select family, address, t0, t1, row_number() over (partition by family, address order by block_number desc) as back
  from (select *, row_number() over (partition by family, pool order by block_number, transaction_hash) as nth from made where raw_type in ('signup', 'view')) where nth <= 2 and pool % 5 <> 0),
seen as (
  select h.*, x.family is not null as said, coalesce(x.t0 = h.t0 and x.t1 = h.t1, false) as same, coalesce(h.target in (x.t0, x.t1), false) as held, pool % 11 <> 0 as code, block_number between 1 and 1000 as made_here
  from hit h left join told x on x.family = h.family and x.address = h.address and back = 1 where r = 1),
counted as (
  select *, pool % 13 <> 0 as trusted,
    case family
      when 'v2' then code::int + (said and pool % 7 <> 0)::int + same::int + 1 + (said and pool % 9 <> 0)::int + (said and pool % 6 <> 0)::int + made_here::int
      when 'v3' then code::int + (said and pool % 7 <> 0)::int + same::int + 1 + (said and pool % 9 <> 0)::int + (said and pool % 4 <> 0)::int + said::int + said::int + (said and pool % 6 <> 1)::int + 1 + made_here::int
      when 'v4' then (pool % 13 <> 0)::int + (said and pool % 3 > 0)::int + (said and pool % 6 <> 1)::int + 1 + 1
      else code::int + 1 + held::int end + (pool % 13 <> 0)::int as n_passed,
    case family when 'v2' then 8 when 'v3' then 12 when 'v4' then 6 + said::int else 4 end as n_checks
  from seen),
scored as (select *, case when trusted then n_passed / n_checks else 0.0 end as share from counted),
verified as (
  select token_address, family, address as pool_address, case family when 'v4' then '0x' || lpad(case when trusted then 'fa' else 'fb' end, 40, '0') else address end as custody_address,
    n_checks, n_passed, cast(round(share, 4) as double) as verification_confidence, share >= 0.3 and trusted and (family <> 'balancer' or held) as verified, t0, t1, target, block_number
  from scored)
"""


@query("verified_pools", VERIFIED + """
select token_address, family, pool_address, custody_address, n_checks, n_passed, verification_confidence, verified from verified""")
def verified_pools(spark, d):
    """Pools from creation logs, checked by the rules of their family against deployments, answers and code."""
    return _verified(spark, d).select("token_address", "family", "pool_address", "custody_address", "n_checks", "n_passed", "verification_confidence", "verified")


@query("pool_table", VERIFIED + """
select v.token_address, v.pool_address, case family when 'balancer' then 'balancer' else 'uniswap' end as adapter, case family when 'balancer' then 'v2' else family end as version,
  case family when 'v3' then 500 when 'v4' then 3000 end as fee, case family when 'v3' then 10 when 'v4' then 60 end as expected_spacing,
  case family when 'v4' then 'manager' when 'balancer' then 'vault' else v.pool_address end as custody_address
from verified v where verified""")
def pool_table(spark, d):
    """Verified pools as the analytics take them: adapter and version of the project, spacing by the fee, and who holds the tokens."""
    rows = _verified(spark, d).where("verified").withColumn("ordinal", F.col("creation_block"))
    rows = rows.withColumn("m", L.map_project(F.when(F.col("family") == "balancer", "Balancer_v2").otherwise(F.concat(F.lit("Uniswap_"), "family")), F.when(F.col("family") != "balancer", F.col("family"))))
    rows = rows.withColumns({"protocol": F.col("m.adapter"), "version": F.col("m.version"), "expected_spacing": money.expected_tick_spacing(F.col("fee"))})
    managers = spark.createDataFrame([("uniswap", "v4", "manager"), ("balancer", "v2", "vault")], "protocol string, version string, manager string")
    return L.resolve_custody(rows, managers).select("token_address", "pool_address", F.col("protocol").alias("adapter"), "version", "fee", "expected_spacing", "custody_address")


@query("standard_pools_from_logs", ctes("chain_fields", "token_addresses", "chain_quotes", "fee_tiers") + """,
made as (
  select *, '0x' || lpad(lower(hex(a)), 40, '0') as t0, '0x' || lpad(lower(hex(b)), 40, '0') as t1, '0x' || rpad(lower(hex(pool)), 64, '7') as address from chain_fields where family = 'v4'),
opened as (select t.token_address, address, t0, t1, pool, block_number, row_number() over (partition by t.token_address, address order by block_number, transaction_hash) as r
  from made m join token_addresses t on t.target in (m.t0, m.t1) where raw_type in ('signup', 'view'))
select token_address, address as pool_address, t0 as token0, t1 as token1, 3000 as fee, 60 as tick_spacing from opened
where r = 1 and pool % 2 = 0 and (t0 in (select quote from chain_quotes) or t1 in (select quote from chain_quotes))
  and address not in (select address from made where raw_type not in ('signup', 'view') group by 1 having count(*) >= 3)""")
def standard_pools_from_logs(spark, d):
    """Pools of a token and a known quote at a standard tier without hooks, that fewer than three changes of liquidity have shown yet."""
    logs, tokens = view(spark, d, "chain_logs"), view(spark, d, "token_addresses")
    found = discovery.discover(logs, tokens).where("family = 'v4'")
    seen = discovery.liquidity_changes(logs).groupBy("pool_address").count().where("count >= 3").select("pool_address")
    return discovery.standard_pools(found, tokens, view(spark, d, "chain_quotes"), view(spark, d, "fee_tiers"), seen).select("token_address", "pool_address", "token0", "token1", "fee", "tick_spacing")


@query("vault_changes", FIELDS + """
select token_address, block_number, log_index, address as pool_address, '0x' || lpad(lower(hex(user_id)), 40, '0') as actor,
  case when cents > 0 or 0 > cents then 'LIQUIDITY_ADD' else 'LIQUIDITY_REMOVE' end as event_type, cast(2 * cents as decimal(38,0)) as token0_amount
from made where family = 'balancer' and raw_type not in ('signup', 'view')""")
def vault_changes(spark, d):
    """Balance changes of the vault, from the arrays of their data to canonical events."""
    rows = discovery.balance_changes(view(spark, d, "chain_logs"))
    rows = events.normalize_balancer(rows.withColumns({c: F.lit(None).cast("string") for c in ("recipient", "amount0", "amount1")} | {"block_timestamp": F.lit(0).cast("long")}))
    return rows.select("token_address", "block_number", "log_index", "pool_address", "actor", "event_type", "token0_amount")


@query("manager_changes", FIELDS + """
select token_address, block_number, log_index, address as pool_address, -60 as tick_lower, 60 as tick_upper,
  cast(case when raw_type = 'error' then -cents else cents end as decimal(38,0)) as liquidity_delta,
  case when k % 7 = 0 then null else cast(user_id as decimal(38,0)) end as nft_token_id
from made where family = 'v4' and raw_type not in ('signup', 'view')""")
def manager_changes(spark, d):
    """Liquidity changes of the manager: signed deltas, ticks and the position's id from its salt."""
    rows = discovery.liquidity_changes(view(spark, d, "chain_logs"))
    return rows.select("token_address", "block_number", "log_index", "pool_address", "tick_lower", "tick_upper", "liquidity_delta", "nft_token_id")


def _lp_positions(spark, d):
    logs = view(spark, d, "lp_logs")
    pools = logs.select("token_address", "pool_address", "family").distinct().withColumns({"lp_token": F.col("pool_address"), "verified": ~F.col("pool_address").startswith("curve_b")})
    ledger = view(spark, d, "lp_ledger")
    return P.lp_token_positions(pools, logs, view(spark, d, "lp_transfers"), ledger, view(spark, d, "lp_supply"), 1 << 60)


LP = ctes("lp_logs", "lp_ledger", "lp_supply", "lp_transfers") + """,
lpp as (select distinct token_address, pool_address, family from lp_logs where pool_address not like 'curve_b%'),
cand as (
  select pool_address, actor as owner from lp_logs union select pool_address, recipient from lp_logs
  union select token_address, from_address from lp_transfers union select token_address, to_address from lp_transfers),
bal as (select lp_token, address, cast(arg_max(balance_raw, block_number) as decimal(38,0)) as b from lp_ledger group by 1, 2),
sup as (select lp_token, cast(arg_max(supply_raw, block_number) as decimal(38,0)) as s from lp_supply group by 1),
lpx as (
  select lpp.token_address, lpp.pool_address, address as owner, 'lp:' || bal.lp_token as position, b as liquidity,
    round(100 * cast(b::varchar as double) / cast(s::varchar as double), 6) as share_pct,
    case family when 'v1' then 'v1_balanceof_at_to_block' when 'v2' then 'v2_balanceof_at_to_block' when 'curve' then 'curve_balanceof_at_to_block'
      else 'balancer_bpt_balanceof_at_to_block' end as method, cast(case when family = 'v2' then 0.95 else 0.9 end as double) as confidence
  from bal join lpp on lpp.pool_address = bal.lp_token join sup using (lp_token)
  where b > 0 and s > 0 and address <> '0x0000000000000000000000000000000000000000'
    and exists (select 1 from cand where cand.pool_address = bal.lp_token and cand.owner = bal.address))
"""


@query("lp_positions", LP + "select * from lpx")
def lp_positions(spark, d):
    """LP-token holders of four families, with how they were found and how far that is trusted."""
    return _lp_positions(spark, d)


ALL_FAMILIES = POS.replace("with ", LP.rstrip() + ", ", 1).replace("with with", "with")


@query("positions_by_family", ALL_FAMILIES + """
, every as (
  select * from lpx union all select token_address, pool_address, owner, 'v3:' || token_id::varchar, cast(liquidity as decimal(38,0)), cast(share_pct as double), 'v3_tick_amounts_at_to_block', 0.95 from sh)
select token_address, method, count(*) as positions, count(distinct owner) as owners, cast(sum(liquidity) as decimal(38,0)) as liquidity, max(share_pct) as top_share, min(confidence) as confidence from every group by 1, 2""")
def positions_by_family(spark, d):
    """All families in one table, summed up by token and how they were found."""
    rows = P.all_positions(_lp_positions(spark, d), P.token_positions(_shares(spark, d)))
    return rows.groupBy("token_address", "method").agg(
        F.count("*").alias("positions"), F.count_distinct("owner").alias("owners"), F.sum("liquidity").cast("decimal(38,0)").alias("liquidity"), F.max("share_pct").alias("top_share"), F.min("confidence").alias("confidence")
    )
