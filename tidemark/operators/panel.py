"""The research panel: prices, volumes, liquidity flow and TVL of every pool of a token and of the token in total, by bucket.

A token's own row is scope `token_total`; it counts the swaps that fit no one pool too. Null is unknown, 0 measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.market import ORDER, TARGET
from tidemark.operators.prices import TOKEN, ohlc

#: Stands for all pools in the keys.
ALL = "*"
KEYS = [TOKEN, "pool", "bucket"]


def lp_flow(liq: DataFrame, pools: DataFrame, seconds: int = 3600, target: str = TARGET, decimals: int = 18) -> DataFrame:
    """token, pool (and ALL), bucket: added and removed target tokens, weighted counts of actions, how many of them have
    known amounts or actors, distinct actors. An amount is null where there are actions but none is known; net if either is."""
    rows = liq.join(pools.select("pool_address", F.col("token0").alias("_t0")), "pool_address")
    known = S.liquidity_quantified(F.col("version"), F.col("token0_amount"), F.col("token1_amount"))
    raw = F.when(known, F.when(F.col("_t0") == target, F.col("token0_amount")).otherwise(F.col("token1_amount")))
    rows = rows.withColumns({"_raw": raw.cast("decimal(38,0)"), "_known": known, "bucket": S.bucket_ts(F.col("block_timestamp"), seconds), "pool": F.explode(F.array("pool_address", F.lit(ALL)))})
    count = lambda cond: F.sum(F.when(cond, F.col("event_count")).otherwise(0))
    aggregates = [F.count_distinct("actor").alias("actors"), count(F.col("actor").isNotNull()).alias("identified")]
    for side in ("add", "remove"):
        mine = F.col("event_type") == f"LIQUIDITY_{side.upper()}"
        aggregates += [count(mine).alias(f"{side}_count"), count(mine & F.col("_known")).alias(f"{side}_known"), F.sum(F.when(mine, F.col("_raw"))).alias(f"_{side}")]
    out = rows.groupBy(*KEYS).agg(*aggregates)
    amount = lambda side: F.when(F.col(f"{side}_count") == 0, 0.0).otherwise(F.col(f"_{side}").cast("double") / 10.0**decimals)
    out = out.withColumns({"added": amount("add"), "removed": amount("remove")}).drop("_add", "_remove")
    return out.withColumn("net", F.col("added") - F.col("removed"))


def tvl_states(tvl: DataFrame, seconds: int = 3600, decimals: int = 18) -> DataFrame:
    """token, pool, bucket: the last observation of the bucket by block and log, with its block."""
    last = F.max_by(F.struct((F.col("tvl_raw").cast("double") / 10.0**decimals).alias("tvl"), F.col("block_number").alias("snapshot_block")), F.struct(*ORDER))
    return tvl.groupBy(TOKEN, F.col("pool_address").alias("pool"), S.bucket_ts(F.col("block_timestamp"), seconds).alias("bucket")).agg(last.alias("_s")).select(*KEYS, "_s.*")


def analysis_series(priced: DataFrame, liq: DataFrame, tvl: DataFrame, pools: DataFrame, seconds: int = 3600, decimals: int = 18) -> DataFrame:
    """A row for each token, pool with a state or activity, and bucket, and for each token with any of these.

    Closes carry over with unit, source and staleness, VWAP never does; TVL states carry over with the bucket they are
    from. The total's TVL is null where a pool's is, its state as old as the oldest. Rates compare with the previous row.
    """
    swaps = priced.withColumn("pool", F.explode(F.filter(F.array("pool", F.lit(ALL)), lambda p: p.isNotNull())))
    px, flow, states = ohlc(swaps, [TOKEN, "pool"], seconds), lp_flow(liq, pools, seconds, decimals=decimals), tvl_states(tvl, seconds, decimals)
    active = px.select(*KEYS).union(flow.select(*KEYS)).union(states.select(*KEYS))
    seen = active.groupBy(TOKEN, "pool").agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    bounds = seen.groupBy(TOKEN).agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    observed = seen.where(F.col("pool") != ALL).select(TOKEN, "pool")  # only pools that were seen, not all there are
    spine = observed.join(bounds, TOKEN).select(TOKEN, "pool", F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("bucket"))
    upto = Window.partitionBy(TOKEN, "pool").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.struct(F.col("bucket").alias("state_bucket"), "tvl", "snapshot_block")
    carried = spine.join(states, KEYS, "left").withColumn("state", F.last(F.when(F.col("snapshot_block").isNotNull(), state), ignorenulls=True).over(upto)).select(*KEYS, "state")
    measured = F.count("state")
    exact = F.sum(F.round("state.tvl", 6).cast("decimal(28,6)")).cast("double")
    total = carried.groupBy(TOKEN, "bucket").agg(
        F.when(measured > 0, F.struct(F.min("state.state_bucket").alias("state_bucket"), F.when(measured == F.count("state.tvl"), exact).alias("tvl"), F.max("state.snapshot_block").alias("snapshot_block"))).alias("state"),
        measured.alias("measured_pools"),
    )
    # a token whose swaps fit no pool has no pool rows: its buckets come from the bounds
    total = bounds.select(TOKEN, F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("bucket")).join(total, [TOKEN, "bucket"], "left")
    verified = pools.agg(F.count_if("verified").alias("_verified"))  # one row
    both = carried.select(*KEYS, "state", F.when(F.col("state").isNotNull(), 1).otherwise(0).cast("long").alias("measured_pools"), F.lit(1).cast("long").alias("verified_pools"))
    both = both.union(total.crossJoin(F.broadcast(verified)).select(TOKEN, F.lit(ALL), "bucket", "state", F.coalesce("measured_pools", F.lit(0)), "_verified"))
    rows = both.join(px, KEYS, "left").join(flow, KEYS, "left")
    rows = rows.where("state is not null or swap_count > 0 or add_count > 0 or remove_count > 0")
    return _finished(rows, seconds)


def _finished(rows: DataFrame, seconds: int) -> DataFrame:
    order = Window.partitionBy(TOKEN, "pool").orderBy("bucket")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_c", F.last(F.when(F.col("close").isNotNull(), F.struct("close", "price_unit", "price_source", "last_trade")), ignorenulls=True).over(upto))
    carried_price = F.col("close").isNull() & F.col("_c").isNotNull()
    carried_tvl = F.coalesce(F.col("state.state_bucket") != F.col("bucket"), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    coverage = lambda side: F.round(F.try_divide(F.col(f"{side}_known").cast("double"), F.nullif(F.col(f"{side}_count"), F.lit(0)).cast("double")), 9)
    identified = F.max("actors").over(Window.partitionBy(TOKEN)) > 0  # actors are known at all
    events = zero("add_count") + zero("remove_count")
    rows = rows.withColumns({
        "price": F.col("_c.close"), "unit": F.col("_c.price_unit"), "origin": F.col("_c.price_source"), "staleness": F.when(F.col("_c").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("bucket") + seconds - F.col("_c.last_trade"))), "price_carried": carried_price, "tvl_carried": carried_tvl,
        "add_coverage": coverage("add"), "remove_coverage": coverage("remove"), "tvl_close": F.col("state.tvl"), "snapshot_block": F.col("state.snapshot_block"), "state_bucket": F.col("state.state_bucket"),
        "_lp": F.when(events == 0, "none").when((F.coalesce(coverage("add"), F.lit(1.0)) == 1) & (F.coalesce(coverage("remove"), F.lit(1.0)) == 1), "quantified").otherwise("partial"),
        "lp_actors": F.when(identified, zero("actors")), "identity_coverage": F.when(identified, F.round(F.try_divide(F.col("identified").cast("double"), F.nullif(events, F.lit(0)).cast("double")), 9)),
        "liquidity_added": F.when(zero("add_count") == 0, 0.0).otherwise(F.col("added")), "liquidity_removed": F.when(zero("remove_count") == 0, 0.0).otherwise(F.col("removed")),
    })
    rows = rows.withColumn("net_flow", F.col("liquidity_added") - F.col("liquidity_removed"))
    rows = rows.withColumn("_b", F.lag(F.struct("price", "unit", "tvl_close")).over(order))
    rate = lambda now, then: F.round(F.ln(F.try_divide(F.when(now > 0, now), F.when(then > 0, then))), 9)
    ratio = lambda x: F.round(F.try_divide(F.col(x).cast("double"), F.when(F.col("_b.tvl_close") > 0, F.col("_b.tvl_close"))), 9)
    nine = lambda c, name=None: F.round(F.col(c).cast("double"), 9).alias(name or c)
    text = F.concat(
        F.lit("price="), F.when(F.col("close").isNotNull(), "observed").when(F.col("_c").isNotNull(), "carried").otherwise("missing"), F.lit(";tvl="),
        F.when(F.col("tvl_carried"), "carried").when(F.col("state").isNotNull(), "observed").otherwise("missing"), F.lit(";lp_amount="), F.col("_lp"),
    )
    total = F.col("pool") == ALL
    return rows.select(
        TOKEN, F.when(total, "token_total").otherwise("pool").alias("scope"), F.when(~total, F.col("pool")).alias("pool_identifier"), F.col("bucket").alias("bucket_start"), (F.col("bucket") + seconds).alias("bucket_end"), F.lit(seconds).alias("bucket_seconds"),
        nine("open", "price_open"), nine("high", "price_high"), nine("low", "price_low"), nine("price", "price_close"), nine("vwap", "price_vwap"), F.col("unit").alias("price_unit"), F.col("origin").alias("price_source"),
        "staleness", F.col("price_carried").alias("price_is_carried"), nine("tvl_close", "tvl_token_close"), "snapshot_block", "state_bucket", F.col("tvl_carried").alias("tvl_is_carried"),
        nine("volume", "volume_token"), nine("volume_usd"), zero("swap_count").alias("swap_count"), zero("active_traders").alias("active_trader_count"), nine("liquidity_added"), nine("liquidity_removed"), nine("net_flow", "net_lp_flow"),
        zero("add_count").alias("lp_add_event_count"), zero("remove_count").alias("lp_remove_event_count"), F.col("lp_actors").alias("active_lp_count"), "identity_coverage", F.col("add_coverage").alias("add_amount_coverage"), F.col("remove_coverage").alias("withdrawal_amount_coverage"),
        "measured_pools", "verified_pools", F.when(F.col("unit") == F.col("_b.unit"), rate(F.col("price"), F.col("_b.price"))).alias("price_return"), rate(F.col("tvl_close"), F.col("_b.tvl_close")).alias("tvl_change"),
        ratio("net_flow").alias("net_lp_flow_ratio"), ratio("liquidity_removed").alias("withdrawal_ratio"), ratio("volume").alias("volume_turnover"), F.round(F.try_divide("close", F.nullif("vwap", F.lit(0.0))) - 1, 6).alias("close_vwap_gap"),
        text.alias("data_coverage"), (F.col("price_carried") | F.col("tvl_carried")).alias("is_imputed"),
    )


def series_summary(series: DataFrame) -> DataFrame:
    """Coverage of the panel, a row per token, with warnings where something is missing."""
    total = F.col("scope") == "token_total"
    out = series.groupBy(TOKEN).agg(
        F.count("*").alias("n_rows"), F.count_if(total).alias("total_rows"), F.count("price_vwap").alias("vwap_rows"), F.count("tvl_token_close").alias("tvl_rows"), F.count_if("is_imputed").alias("imputed_rows"),
        F.max(F.when(total, F.col("measured_pools"))).alias("max_measured_pools"), F.max("verified_pools").alias("verified_pools"), F.max("staleness").alias("max_staleness"),
        F.count_if(total & (F.col("lp_remove_event_count") > 0) & F.col("liquidity_removed").isNull()).alias("unknown_removals"), F.min("identity_coverage").alias("least_identity_coverage"), F.count_distinct("bucket_start").alias("buckets"),
    )
    warn = {"warn_no_vwap": F.col("vwap_rows") == 0, "warn_partial_tvl": F.col("max_measured_pools") < F.col("verified_pools"), "warn_unknown_removals": F.col("unknown_removals") > 0, "warn_no_identity": F.col("least_identity_coverage").isNull()}
    return out.withColumns(warn)


def price_unit_choice(series: DataFrame) -> DataFrame:
    """Per token the unit to plot: USD if any row has it, else the most frequent (the larger name of equals); and the rows left out."""
    n = series.where("price_unit is not null").groupBy(TOKEN, "price_unit").agg(F.count("*").alias("n"))
    order = F.struct((F.col("price_unit") == "USD").alias("usd"), "n", "price_unit")
    return n.groupBy(TOKEN).agg(F.max_by(F.struct("price_unit", "n"), order).alias("b"), F.sum("n").alias("t")).select(TOKEN, "b.price_unit", (F.col("t") - F.col("b.n")).alias("rows_left_out"))


def matched_pool_panel(series: DataFrame, pool: Column) -> DataFrame:
    """The rows of one pool for each token that have both a price and a TVL, for correlation."""
    return series.where((F.col("scope") == "pool") & (F.col("pool_identifier") == pool) & F.col("price_close").isNotNull() & F.col("tvl_token_close").isNotNull())
