"""Canonical event tables as views over the driver's tables.

Each view is one SELECT with four places where dialects differ, so that a test can run the very same rows
through another engine. `token_address` spreads the rows over several tokens: every operator carries it as a
key, and one job computes all tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {"UNIX": "unix_timestamp(cast(ts as timestamp))", "DIV": "div", "STR": "string", "ARRAY": "array", "DADD": "date_add(cast(o_orderdate as date), cast(o_custkey % 30 + 1 as int))"}
DUCKDB = {"UNIX": "cast(floor(epoch(ts)) as bigint)", "DIV": "//", "STR": "varchar", "ARRAY": "list_value", "DADD": "cast(o_orderdate as date) + cast(o_custkey % 30 + 1 as integer)"}

#: name -> (source table or views, text)
VIEWS = {
    "pools": """select * from (values
 (0,'p0','p0','uniswap','v2','TGT','WETH',18,true,3000), (1,'p1','p1','uniswap','v3','TGT','USDC',6,true,500),
 (2,'p2','p2','uniswap','v3','WETH','TGT',18,true,3000), (3,'p3','p3','curve','v1','TGT','DAI',18,true,100),
 (4,'p4','manager','uniswap','v4','TGT','USDT',6,true,500), (5,'p5','manager','uniswap','v4','TGT','USDT',6,true,3000)
) v(ordinal,pool_address,custody_address,protocol,version,token0,token1,quote_decimals,verified,fee)""",
    "ev": """select event_id as block_number, cast(event_id % 3 as int) as log_index, {UNIX} as block_timestamp,
 'tx' || cast(event_id {DIV} 3 as {STR}) as transaction_hash, cast(regexp_extract(props,'([0-9]+)',1) as int) as k, user_id,
 'T' || cast(user_id % 3 as {STR}) as token_address, event_type as raw_type, cast(round(value*100) as bigint) as cents from events""",
    "swaps": """select token_address, block_number, log_index, block_timestamp, transaction_hash, 'SWAP' as event_type,
 case when k % 6 >= 4 then 'manager' else 'p' || cast(k % 6 as {STR}) end as pool_address, 'u' || cast(user_id as {STR}) as actor,
 case k % 6 when 2 then 'WETH' else 'TGT' end as token0_address,
 case k % 6 when 0 then 'WETH' when 1 then 'USDC' when 2 then 'TGT' when 3 then 'DAI' else 'USDT' end as token1_address,
 case k % 6 when 2 then cents * 3 else cents end as token0_amount, case k % 6 when 2 then cents else cents * 3 end as token1_amount,
 case when raw_type = 'purchase' then -cents else cents end as target_delta_signed,
 case when k % 5 = 0 then null else cents * (100 + k) end as amount_usd_e4
 from ev where raw_type in ('purchase','click')""",
    "liquidity_events": """select token_address, block_number, log_index, block_timestamp, transaction_hash,
 case raw_type when 'signup' then 'LIQUIDITY_ADD' else 'LIQUIDITY_REMOVE' end as event_type,
 'p' || cast(k % 6 as {STR}) as pool_address, case when k % 7 = 0 then null else 'u' || cast(user_id as {STR}) end as actor, case when k % 5 < 2 then 'u' || cast((user_id + k % 3) % 150 as {STR}) end as recipient,
 case when k % 6 >= 4 then 'v4' else 'v3' end as version, case when k % 6 >= 4 then 'ModifyLiquidity' else 'Mint' end as source_event,
 case when k % 6 >= 4 then 0 else cents end as token0_amount, case when k % 6 >= 4 then 0 else cents end as token1_amount,
 case raw_type when 'signup' then cents else -cents end as liquidity_delta, 1 + k % 3 as event_count
 from ev where raw_type in ('signup','error')""",
    "transfers": """select 'T' || cast((user_id + to_user) % 3 as {STR}) as token_address, block_number, log_index, block_timestamp, transaction_hash, 'TOKEN_TRANSFER' as event_type,
 'u' || cast(user_id as {STR}) as from_address, 'u' || cast(to_user as {STR}) as to_address, cast(case when k % 11 = 0 then 0 else 100 + k % 20 end as bigint) as amount_raw
 from (select *, (user_id + 150 + case k % 4 when 0 then -2 when 1 then -1 when 2 then 1 else 2 end) % 150 as to_user from ev where raw_type = 'view') t""",
    "gas_payers": "select distinct transaction_hash, 'u' || cast((block_number {DIV} 3) % 150 as {STR}) as gas_payer from ev",
    "tvl_points": """select token_address, block_number, log_index, block_timestamp, 'p' || cast(k % 6 as {STR}) as pool_address,
 1000000 + cents * 10 as tvl_raw from ev where raw_type = 'error' and k % 6 < 4""",
    "balance_ledger": """select 'T' || cast(o_custkey % 3 as {STR}) as token_address, 'u' || cast(o_custkey as {STR}) as address, o_orderkey as block_number,
 cast(round(o_totalprice*100) as bigint) as balance_raw from orders""",
    "holder_intervals": """select 'T' || cast(o_custkey % 3 as {STR}) as token_address, case when o_custkey % 41 = 0 then '0x0000000000000000000000000000000000000000' else 'u' || cast(o_custkey as {STR}) end as address, cast(o_orderdate as date) as valid_from,
 {DADD} as valid_to, case when o_orderstatus='F' then 0 else cast(round(o_totalprice*100) as bigint) end as balance_raw from orders""",
    "lp_nft": """select 'T' || cast(l_orderkey % 3 as {STR}) as token_address, l_orderkey as token_id, 'p' || cast(l_orderkey % 6 as {STR}) as pool_address,
 l_orderkey * 8 + l_linenumber as block_number, l_linenumber as log_index,
 -60 * (1 + l_orderkey % 50) as tick_lower, 60 * (1 + l_orderkey % 40) as tick_upper,
 cast(case l_returnflag when 'R' then -l_quantity else l_quantity end as bigint) as liquidity_delta, 'u' || cast(l_suppkey as {STR}) as owner from lineitem""",
}
#: Swaps and removals with raw amounts as base-10 strings by each token's decimals; facts about addresses.
VIEWS |= {
    "raw_swaps": """select token_address, block_number, log_index, block_timestamp, transaction_hash, pool_address, case when block_number % 13 = 0 then null else actor end as actor,
 case when block_number % 2 = 1 then 'u' || cast(block_number % 150 as {STR}) end as recipient, token0_address, token1_address,
 cast(token0_amount as {STR}) || case when token0_address in ('USDC','USDT') then '0000' else '0000000000000000' end as token0_raw,
 cast(token1_amount as {STR}) || case when token1_address in ('USDC','USDT') then '0000' else '0000000000000000' end as token1_raw,
 cast(amount_usd_e4 as double) / 10000 as amount_usd, target_delta_signed from swaps""",
    "contract_owners": """select distinct 'u' || cast(c_custkey % 150 as {STR}) as contract, 'u' || cast(c_custkey % 150 % 40 as {STR}) as owner from customer where c_custkey % 150 % 4 = 0""",
    "creations": """select distinct 'T' || cast(c_custkey % 3 as {STR}) as contract, 'u' || cast(c_custkey % 150 as {STR}) as creator, c_custkey as block_number from customer""",
    "raw_logs": """select token_address, block_number, log_index, block_timestamp, transaction_hash,
 case k % 8 when 0 then 'v1' when 1 then 'v2' when 2 then 'v3_pool' when 3 then 'v3_position' when 4 then 'v4_pool' when 5 then 'curve' when 6 then 'balancer' else 'erc20' end as family,
 case k % 8 when 0 then case raw_type when 'purchase' then 'EthPurchase' when 'click' then 'TokenPurchase' when 'signup' then 'AddLiquidity' else 'RemoveLiquidity' end
  when 1 then case raw_type when 'signup' then 'Mint' when 'error' then 'Burn' when 'view' then 'Sync' else 'Swap' end
  when 2 then case raw_type when 'signup' then 'Mint' when 'error' then 'Burn' when 'view' then 'Collect' else 'Swap' end
  when 3 then case raw_type when 'signup' then 'IncreaseLiquidity' when 'error' then 'DecreaseLiquidity' when 'view' then 'Collect' else 'Transfer' end
  when 4 then case when raw_type in ('signup', 'error') then 'ModifyLiquidity' else 'Swap' end
  when 5 then case raw_type when 'signup' then 'AddLiquidity' when 'error' then 'RemoveLiquidityOne' when 'view' then 'RemoveLiquidityImbalance' else 'TokenExchange' end
  when 6 then case when raw_type in ('signup', 'error') then 'PoolBalanceChanged' else 'Swap' end else 'Transfer' end as event_name,
 'p' || cast(k % 6 as {STR}) as pool_address, 'u' || cast(user_id as {STR}) as sender, 'u' || cast((user_id + 7) % 150 as {STR}) as recipient, cast(user_id * 7 % 50 as bigint) as token_id,
 cast(case when raw_type in ('purchase', 'error') then -cents else cents end as {STR}) as amount0, cast(case when raw_type in ('purchase', 'error') then cents * 3 else -cents * 3 end as {STR}) as amount1,
 cast(case when raw_type = 'purchase' then 0 else cents end as {STR}) as amount0_in, cast(case when raw_type = 'purchase' then cents else 0 end as {STR}) as amount0_out,
 cast(case when raw_type = 'purchase' then cents * 3 else 0 end as {STR}) as amount1_in, cast(case when raw_type = 'purchase' then 0 else cents * 3 end as {STR}) as amount1_out,
 cast(cents as {STR}) as liquidity, cast(case when raw_type = 'error' then -cents else cents end as {STR}) as delta, cast(case when k % 3 = 0 then 0 else cents end as {STR}) as delta1 from ev""",
    "position_keys": """select t.token_id, p.token0, p.token1, p.fee from pools p join (select distinct cast(user_id * 7 % 50 as bigint) as token_id from ev) t on p.ordinal = t.token_id % 6""",
    "token_meta": """select distinct lower(token_address) as token_address, 'x' || substr(token_address, 2) as target, case token_address when 'T0' then 18 when 'T1' then 6 else 8 end as decimals,
 'SYM' || substr(token_address, 2) as symbol from ev""",
    "quote_assets": "select * from (values ('weth', 18, false), ('usdc', 6, true), ('usdt', 6, true), ('dai', 18, true)) v(quote, decimals, stable)",
    "log_pools": """select pool_address, token_address, protocol, version, verified, target, decimals, case when first then target else quote end as token0, case when first then quote else target end as token1,
 case when quote in ('weth', 'dai') then 18 else 6 end as quote_decimals from (
 select distinct family || '_' || r.pool_address || '_' || m.token_address as pool_address, m.token_address, 'uniswap' as protocol, case family when 'v2' then 'v2' else 'v3' end as version, r.pool_address <> 'p0' as verified,
  m.target, m.decimals, r.pool_address in ('p1', 'p2', 'p5') as first, case r.pool_address when 'p0' then 'weth' when 'p1' then 'usdc' when 'p2' then 'weth' when 'p3' then 'dai' when 'p4' then 'usdc' else 'usdt' end as quote
 from raw_logs r join token_meta m on lower(r.token_address) = m.token_address where family in ('v2', 'v3_pool')) x""",
    "pool_logs": """select token_address, block_number, log_index, block_timestamp, transaction_hash, family, event_name, pool_address, sender, recipient, liquidity,
 amount0 || z0 as amount0, amount1 || z1 as amount1, amount0_in || z0 as amount0_in, amount0_out || z0 as amount0_out, amount1_in || z1 as amount1_in, amount1_out || z1 as amount1_out from (
 select p.token_address, block_number, log_index, block_timestamp, transaction_hash, family, event_name, p.pool_address, sender, recipient, liquidity, amount0, amount1, amount0_in, amount0_out, amount1_in, amount1_out,
  repeat('0', case when p.token0 = p.target then p.decimals else p.quote_decimals end - 2) as z0, repeat('0', case when p.token1 = p.target then p.decimals else p.quote_decimals end - 2) as z1
 from raw_logs r join log_pools p on p.pool_address = family || '_' || r.pool_address || '_' || lower(r.token_address)) x""",
    "chain_fields": """select token_address, block_number, log_index, transaction_hash, k, user_id, cents, raw_type, case k % 4 when 0 then 'v2' when 1 then 'v3' when 2 then 'v4' else 'balancer' end as family,
 case when k % 2 = 0 then 4096 + user_id % 3 else 8192 + k % 50 end as a, case when k % 2 = 0 then 8192 + k % 50 else 4096 + user_id % 3 end as b, 70000 + (k * 31 + user_id * 7) % 400 as pool from ev""",
    "chain_logs": """select token_address, block_number, log_index, transaction_hash, family, case when raw_type in ('signup', 'view') then case family when 'v2' then 'PairCreated' when 'v3' then 'PoolCreated' when 'v4' then 'Initialize' else 'TokensRegistered' end
  when family = 'v4' then 'ModifyLiquidity' when family = 'balancer' then 'PoolBalanceChanged' else 'Other' end as event_name, case when pool % 13 = 0 then '0x00000000000000000000000000000000000000FB' else '0x00000000000000000000000000000000000000FA' end as address,
 case when raw_type in ('signup', 'view') and family in ('v2', 'v3') then {ARRAY}('0x' || lpad('', 64, 'e'), '0x' || lpad(lower(hex(a)), 64, '0'), '0x' || lpad(lower(hex(b)), 64, '0'), '0x' || lpad(lower(hex(500)), 64, '0'))
  when raw_type in ('signup', 'view') and family = 'v4' then {ARRAY}('0x' || lpad('', 64, 'e'), '0x' || rpad(lower(hex(pool)), 64, '7'), '0x' || lpad(lower(hex(a)), 64, '0'), '0x' || lpad(lower(hex(b)), 64, '0'))
  else {ARRAY}('0x' || lpad('', 64, 'e'), '0x' || rpad(lower(hex(pool)), 64, '7'), '0x' || lpad(lower(hex(user_id)), 64, '0')) end as topics,
 case when raw_type in ('signup', 'view') then case family when 'v2' then '0x' || lpad(lower(hex(pool)), 64, '0') || lpad('', 64, '0') when 'v3' then '0x' || lpad(lower(hex(10)), 64, '0') || lpad(lower(hex(pool)), 64, '0')
   when 'v4' then '0x' || lpad(lower(hex(3000)), 64, '0') || lpad(lower(hex(60)), 64, '0') || lpad(case when pool % 2 = 0 then '0' else 'abc' end, 64, '0') || lpad('1', 64, '0') || lpad('', 64, 'f')
   else '0x' || lpad(lower(hex(64)), 64, '0') || lpad(lower(hex(192)), 64, '0') || lpad('3', 64, '0') || lpad(lower(hex(a)), 64, '0') || lpad(lower(hex(b)), 64, '0') || lpad('def', 64, '0') || lpad('', 64, '0') end
  when family = 'v4' then '0x' || lpad('c4', 64, 'f') || lpad('3c', 64, '0') || case when raw_type = 'error' then lpad(lower(hex(-cents)), 64, case when cents > 0 then 'f' else '0' end) else lpad(lower(hex(cents)), 64, case when cents < 0 then 'f' else '0' end) end || case when k % 7 = 0 then lpad(lower(hex(user_id)), 64, '9') else lpad(lower(hex(user_id)), 64, '0') end
  else '0x' || lpad('60', 64, '0') || lpad('c0', 64, '0') || lpad(lower(hex(288)), 64, '0') || lpad('2', 64, '0') || lpad(lower(hex(a)), 64, '0') || lpad(lower(hex(b)), 64, '0') || lpad('2', 64, '0') || lpad(lower(hex(cents)), 64, case when cents < 0 then 'f' else '0' end)
   || lpad(lower(hex(-cents)), 64, case when cents > 0 then 'f' else '0' end) || lpad('', 64, '0') end as data from chain_fields""",
    "pool_answers": """select family, case family when 'v4' then '0x' || rpad(lower(hex(pool)), 64, '7') when 'balancer' then '0x' || rpad(lower(hex(pool)), 40, '7')
 else '0x' || lpad(lower(hex(pool)), 40, '0') end as pool_address, block_number,
 '0x' || lpad(case when pool % 7 = 0 then 'bad' when pool % 13 = 0 then 'fb' else 'fa' end, 40, '0') as factory, '0x' || lpad(lower(hex(a)), 40, '0') as token0, '0x' || lpad(lower(hex(b)), 40, '0') as token1,
 case when pool % 4 = 0 then 3000 else 500 end as fee, 10 as tick_spacing, case when pool % 9 <> 0 then '0x' || lpad(lower(hex(pool)), 40, '0') end as by_key, pool % 6 <> 0 as has_reserves, cast(pool % 3 as bigint) as sqrt_price,
 pool % 6 <> 1 as has_liquidity, {ARRAY}('0x' || lpad(lower(hex(a)), 40, '0'), '0x' || lpad(lower(hex(b)), 40, '0')) as vault_tokens, '0x' || lpad(lower(hex(a)), 40, '0') as first_coin
 from (select *, row_number() over (partition by family, pool order by block_number, transaction_hash) as nth from chain_fields where raw_type in ('signup', 'view')) x where nth <= 2 and pool % 5 <> 0""",
    "pool_codes": """select distinct case family when 'v4' then '0x' || rpad(lower(hex(pool)), 64, '7') when 'balancer' then '0x' || rpad(lower(hex(pool)), 40, '7')
 else '0x' || lpad(lower(hex(pool)), 40, '0') end as address from chain_fields where pool % 11 <> 0
 union select '0x' || lpad('fa', 40, '0') union select '0x' || lpad('a3', 40, '0')""",
    "deployments": """select family, '0x' || lpad('fa', 40, '0') as factory, case family when 'v3' then '0x' || lpad('a3', 40, '0') when 'v4' then '0x' || lpad('a4', 40, '0') end as position_manager
 from (select distinct family from chain_fields) x""",
    "chain_quotes": "select distinct '0x' || lpad(lower(hex(8192 + k % 50)), 40, '0') as quote from chain_fields where k % 50 < 20",
    "token_addresses": """select distinct token_address, '0x' || lpad(lower(hex(4096 + cast(substr(token_address, 2) as bigint))), 40, '0') as target from ev""",
    "lp_logs": """select lower(token_address) as token_address, block_number, family, family || case when pool_address in ('p0', 'p1') then '_a_' when pool_address in ('p2', 'p3') then '_b_' else '_c_' end || lower(token_address) as pool_address,
 sender as actor, case when token_id % 3 = 0 then recipient when token_id = 1 then '0x0000000000000000000000000000000000000000' end as recipient from raw_logs where family in ('v1', 'v2', 'curve', 'balancer')""",
    "lp_ledger": """select case o_custkey % 4 when 0 then 'v1' when 1 then 'v2' when 2 then 'curve' else 'balancer' end || case o_orderkey % 3 when 0 then '_a_' when 1 then '_b_' else '_c_' end || 't' || cast(o_custkey % 3 as {STR}) as lp_token,
 'u' || cast(o_custkey % 150 as {STR}) as address, o_orderkey as block_number, case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then '0' else cast(cast(round(o_totalprice * 100) as bigint) as {STR}) || '0000000000' end as balance_raw from orders""",
    "lp_supply": """select lp_token, block_number - block_number % 500 as block_number, cast(count(*) * 10000000 as {STR}) || '0000000000' as supply_raw from lp_ledger group by lp_token, block_number - block_number % 500""",
    "lp_transfers": """select lower(token_address) as token, 'v2_a_' || lower(token_address) as token_address, from_address, to_address from transfers where amount_raw > 112""",
    "fee_tiers": "select * from (values (100, 1), (500, 10), (3000, 60), (10000, 200)) v(fee, tick_spacing)",
}
USES = {"swaps": ["ev"], "liquidity_events": ["ev"], "transfers": ["ev"], "gas_payers": ["ev"], "tvl_points": ["ev"], "raw_swaps": ["ev", "swaps"], "raw_logs": ["ev"], "position_keys": ["ev", "pools"], "token_meta": ["ev"], "log_pools": ["ev", "raw_logs", "token_meta"], "pool_logs": ["ev", "raw_logs", "token_meta", "log_pools"], "chain_fields": ["ev"], "chain_logs": ["ev", "chain_fields"], "token_addresses": ["ev"], "pool_answers": ["ev", "chain_fields"], "pool_codes": ["ev", "chain_fields"], "deployments": ["ev", "chain_fields"], "chain_quotes": ["ev", "chain_fields"], "lp_logs": ["ev", "raw_logs"], "lp_supply": ["lp_ledger"], "lp_transfers": ["ev", "transfers"]}
TABLES = {"ev": "events", "lp_ledger": "orders", "balance_ledger": "orders", "holder_intervals": "orders", "lp_nft": "lineitem", "contract_owners": "customer", "creations": "customer"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical table."""
    text = VIEWS[name]
    for k, v in SPARK.items():
        text = text.replace("{" + k + "}", v)
    sources = {s: view(spark, sf_dir, s) for s in USES.get(name, ())}
    if name in TABLES:
        table = TABLES[name]
        sources[table] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    for s in sources:
        text = re.sub(rf"\b(from|join) {s}\b", rf"\1 {{{s}}}", text)
    return spark.sql(text, **sources)


def ctes(*names: str) -> str:
    """The same tables as common table expressions for the comparison engine."""
    wanted: list[str] = []
    for n in names:
        for m in (*USES.get(n, ()), n):
            if m not in wanted:
                wanted.append(m)
    parts = []
    for n in wanted:
        text = VIEWS[n]
        for k, v in DUCKDB.items():
            text = text.replace("{" + k + "}", v)
        parts.append(f"{n} as ({text})")
    return "with " + ",\n".join(parts)
