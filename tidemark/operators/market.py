"""Prices, volumes, TVL, liquidity flow and the research panel built of them.

Amounts are integers (raw units), so sums are exact; shares and prices divide last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import ordered

TARGET = "TGT"
ORDER = ("block_number", "log_index")


def resolve_swap_pool(swaps: DataFrame, pools: DataFrame) -> DataFrame:
    """swaps + pool: the exact address, else the only pool of the pair, else null. pools is a small dimension."""
    exact = pools.select(F.col("pool_address").alias("_exact")).distinct()
    pair = pools.groupBy(F.least("token0", "token1").alias("_lo"), F.greatest("token0", "token1").alias("_hi")).agg(F.count("*").alias("_n"), F.min("pool_address").alias("_by_pair")).where("_n = 1").drop("_n")
    lo, hi = F.least("token0_address", "token1_address"), F.greatest("token0_address", "token1_address")
    found = swaps.join(exact, swaps.pool_address == F.col("_exact"), "left").join(pair, (lo == F.col("_lo")) & (hi == F.col("_hi")), "left")
    return found.withColumn("pool", F.coalesce("_exact", "_by_pair")).drop("_exact", "_by_pair", "_lo", "_hi")


def resolved_swaps(swaps: DataFrame, pools: DataFrame, target: str = TARGET) -> DataFrame:
    """Swaps with pool, target and quote amounts, price (1e-6 units of usd or quote), unit and source."""
    t0, t1, a0, a1 = (F.col(c) for c in ("token0_address", "token1_address", "token0_amount", "token1_amount"))
    r = resolve_swap_pool(swaps, pools).withColumns(
        {"amount": S.target_amount(t0, t1, a0, a1, target), "quote_amount": S.quote_amount(t0, t1, a0, a1, target), "quote": F.when(t0 == target, t1).when(t1 == target, t0)}
    )
    usd = (F.col("amount_usd_e4") > 0) & (F.col("amount") > 0)
    ratio = (F.col("amount") > 0) & (F.col("quote_amount") > 0) & F.col("quote").isin(list(S.QUOTES))
    price = F.when(usd, F.floor(F.col("amount_usd_e4") * 1_000_000 / F.col("amount"))).when(ratio, F.floor(F.col("quote_amount") * 1_000_000 / F.col("amount"))).cast("long")
    return r.withColumns({"price_e6": price, "price_unit": F.when(usd, "USD").when(ratio, F.col("quote")), "price_source": F.when(usd, "amount_usd").when(ratio, "pool_swap_ratio")})


def _last(column: Column) -> Column:
    return F.max_by(column, F.struct(*ORDER))


def swap_volume(rs: DataFrame, seconds: int = 3600) -> DataFrame:
    """token, bucket, pool: volume and USD volume of resolved swaps."""
    kept = rs.where("pool is not null and amount is not null")
    return kept.groupBy("token_address", S.bucket_ts(F.col("block_timestamp"), seconds).alias("bucket"), "pool").agg(F.sum("amount").alias("volume"), F.sum("amount_usd_e4").alias("volume_usd_e4"), F.count("*").alias("swap_count"))


def pool_volume(rs: DataFrame) -> DataFrame:
    """token, pool: volume, its share of the token's, whether it is the main pool; swaps that fit no one pool are counted apart."""
    by_pool = rs.groupBy("token_address", "pool").agg(F.sum("amount").alias("volume"), F.count("*").alias("swap_count"))
    w = Window.partitionBy("token_address")
    named = by_pool.where("pool is not null").withColumn("total", F.sum("volume").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("volume"), "pool")))
    ambiguous = by_pool.where("pool is null").select("token_address", F.col("swap_count").alias("ambiguous_events"))
    return named.join(ambiguous, "token_address", "left").select(
        "token_address", "pool", "volume", "swap_count", F.round(F.try_divide("volume", "total"), 9).alias("share"), (F.col("rank") == 1).alias("is_main"), F.coalesce("ambiguous_events", F.lit(0)).alias("ambiguous_events")
    )


def swap_price_last(rs: DataFrame, seconds: int = 3600) -> DataFrame:
    """token, bucket, pool: the last price, with unit, source and block."""
    kept = rs.where("pool is not null and price_e6 is not null")
    last = kept.groupBy("token_address", S.bucket_ts(F.col("block_timestamp"), seconds).alias("bucket"), "pool").agg(_last(F.struct("price_e6", "price_unit", "price_source", "block_number", "block_timestamp")).alias("p"))
    return last.select("token_address", "bucket", "pool", "p.*")


def ohlc_vwap(rs: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Open, high, low, close and volume-weighted price of each bucket, over the unit the bucket saw first."""
    kept = rs.where("price_e6 is not null").withColumn("bucket", S.bucket_ts(F.col("block_timestamp"), seconds))
    by = [*keys, "bucket"]
    unit = F.min_by("price_unit", F.struct(*ORDER)).over(Window.partitionBy(*by))
    same = kept.withColumn("_unit", unit).where("price_unit = _unit")
    out = same.groupBy(*by).agg(
        F.min_by("price_e6", F.struct(*ORDER)).alias("open_e6"), F.max("price_e6").alias("high_e6"), F.min("price_e6").alias("low_e6"), _last(F.col("price_e6")).alias("close_e6"),
        F.sum("amount").alias("volume"), F.sum(F.col("price_e6").cast("decimal(38,0)") * F.col("amount")).alias("_pv"), F.first("price_unit").alias("price_unit"),
        F.when(F.count_distinct("price_source") > 1, "mixed").otherwise(F.min("price_source")).alias("price_source"), F.max("block_timestamp").alias("last_trade"),
    )
    return out.withColumn("vwap", F.round(F.try_divide(F.col("_pv").cast("double"), F.col("volume").cast("double")) / 1e6, 6)).drop("_pv")


def volume_matrix(volume: DataFrame, pools: list[str]) -> DataFrame:
    """One column of volume per pool; gaps stay null."""
    return volume.groupBy("token_address", "bucket").pivot("pool", pools).agg(F.sum("volume"))


def span_volume(volume: DataFrame, days: int, bucket: int) -> DataFrame:
    """Volume of the last days before each token's last bucket, in wider buckets."""
    end = F.max("bucket").over(Window.partitionBy("token_address"))
    recent = volume.withColumn("_end", end).where(F.col("bucket") > F.col("_end") - days * 86_400)
    return recent.groupBy("token_address", S.bucket_ts(F.col("bucket"), bucket).alias("bucket"), "pool").agg(F.sum("volume").alias("volume"))


def resample_tvl(tvl: DataFrame, seconds: int = 3600) -> DataFrame:
    """token, bucket, pool: the last observation, never a sum."""
    return tvl.groupBy("token_address", S.bucket_ts(F.col("block_timestamp"), seconds).alias("bucket"), "pool_address").agg(_last(F.struct("tvl_raw", "block_number")).alias("t")).select("token_address", "bucket", "pool_address", "t.*")


def tvl_total(resampled: DataFrame) -> DataFrame:
    return resampled.groupBy("token_address", "bucket").agg(F.sum("tvl_raw").alias("tvl_raw"), F.count("*").alias("measured_pools"))


def pool_concentration(tvl: DataFrame) -> DataFrame:
    """token: total of the pools' last TVL, the main pool and its share."""
    last = tvl.groupBy("token_address", "pool_address").agg(_last(F.col("tvl_raw")).alias("tvl_raw"))
    total = last.groupBy("token_address").agg(
        F.sum("tvl_raw").alias("total_tvl"), F.max(F.struct("tvl_raw", F.col("pool_address"))).alias("_m"), F.count_if(F.col("tvl_raw") > 0).alias("num_active_pools")
    )
    return total.select("token_address", "total_tvl", F.col("_m.pool_address").alias("main_pool"), F.col("_m.tvl_raw").alias("main_pool_tvl"), F.round(F.try_divide("_m.tvl_raw", "total_tvl"), 9).alias("main_pool_share"), "num_active_pools")


def liquidity_flow(liq: DataFrame, pools: DataFrame, keys: list[str], target: str = TARGET, seconds: int = 3600) -> DataFrame:
    """Added, removed and net target amounts, and how many actions have known amounts.

    event_count weighs the counts, never the amounts. An amount is null where actions exist but none is known.
    """
    side = pools.select("pool_address", F.col("token0").alias("_t0"))
    rows = liq.join(side, "pool_address").withColumn("bucket", S.bucket_ts(F.col("block_timestamp"), seconds))
    known = S.liquidity_quantified(F.col("version"), F.col("token0_amount"), F.col("token1_amount"))
    amount = F.when(known, F.when(F.col("_t0") == target, F.col("token0_amount")).otherwise(F.col("token1_amount")))
    add, remove = F.col("event_type") == "LIQUIDITY_ADD", F.col("event_type") == "LIQUIDITY_REMOVE"
    rows = rows.withColumns({"_amount": amount, "_known": known})
    out = rows.groupBy(*keys, "bucket").agg(
        F.sum(F.when(add, F.col("_amount"))).alias("_added"), F.sum(F.when(remove, F.col("_amount"))).alias("_removed"),
        F.sum(F.when(add, F.col("event_count")).otherwise(0)).alias("add_actions"), F.sum(F.when(remove, F.col("event_count")).otherwise(0)).alias("remove_actions"),
        F.sum(F.when(F.col("_known"), F.col("event_count")).otherwise(0)).alias("known_actions"), F.sum(F.when(F.col("_known"), 0).otherwise(F.col("event_count"))).alias("missing_actions"),
        F.count_distinct("actor").alias("active_lp_count"),
    )
    added = F.when(F.col("add_actions") == 0, 0).otherwise(F.col("_added")).cast("long")
    removed = F.when(F.col("remove_actions") == 0, 0).otherwise(F.col("_removed")).cast("long")
    return out.withColumns({"added": added, "removed": removed}).withColumn("net", F.col("added") - F.col("removed")).drop("_added", "_removed")


def clamped_liquidity(liq: DataFrame) -> DataFrame:
    """Running liquidity of each pool, never under 0: r = max(0, r + delta), by ranges of blocks."""
    rows = liq.select("token_address", "pool_address", *ORDER, "liquidity_delta")
    return ordered.clamped(rows, ["token_address", "pool_address"], list(ORDER), {"liquidity": (F.lit(None), F.col("liquidity_delta"))}).drop("liquidity_delta")


def bucket_spine(active: DataFrame, seconds: int = 3600) -> DataFrame:
    """Every bucket between a token's first and last, for every pool of it that was seen. active: token_address, pool_address, bucket."""
    bounds = active.groupBy("token_address").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    dense = bounds.select("token_address", F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("bucket"))
    return dense.join(active.select("token_address", "pool_address").distinct(), "token_address")


def tvl_state(resampled: DataFrame, spine: DataFrame) -> DataFrame:
    """The last known TVL of each pool carried over the spine, with the bucket it is from."""
    w = Window.partitionBy("token_address", "pool_address").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.struct(F.col("tvl_raw"), F.col("bucket").alias("state_bucket"))
    rows = spine.join(resampled.select("token_address", "pool_address", "bucket", "tvl_raw"), ["token_address", "pool_address", "bucket"], "left")
    return rows.withColumn("s", F.last(F.when(F.col("tvl_raw").isNotNull(), seen), ignorenulls=True).over(w)).select("token_address", "pool_address", "bucket", "s.tvl_raw", "s.state_bucket")


def withdrawal_events(liq: DataFrame, tvl: DataFrame, pools: DataFrame, target: str = TARGET, extra: list[str] | None = None) -> DataFrame:
    """Each removal: its target amount, and its share of the pool's TVL as of its block."""
    from tidemark.operators.asof import asof_join

    side = pools.select("pool_address", F.col("token0").alias("_t0"))
    gone = liq.where("event_type = 'LIQUIDITY_REMOVE'").join(side, "pool_address")
    known = S.liquidity_quantified(F.col("version"), F.col("token0_amount"), F.col("token1_amount"))
    gone = gone.withColumns({"amount": F.when(known, F.when(F.col("_t0") == target, F.col("token0_amount")).otherwise(F.col("token1_amount"))), "status": F.when(known, "quantified").otherwise("liquidity_delta_only")})
    state = asof_join(gone, tvl.select("token_address", "pool_address", F.col("block_number").alias("_b"), "tvl_raw"), ["token_address", "pool_address"], "block_number", "_b", ["tvl_raw"])
    return state.select("token_address", "pool_address", "block_number", "log_index", "actor", "event_count", "amount", "status", "tvl_raw", F.round(F.try_divide("amount", "tvl_raw"), 9).alias("share"), *(extra or []))


def withdrawal_summary(events: DataFrame) -> DataFrame:
    """Totals per pool, and per token where pool_address is null."""
    return events.groupingSets([["token_address", "pool_address"], ["token_address"]], "token_address", "pool_address").agg(
        F.sum("amount").alias("removed"), F.sum("event_count").alias("actions"), F.sum(F.when(F.col("status") == "quantified", F.col("event_count")).otherwise(0)).alias("quantified_actions"), F.max("share").alias("max_share")
    )


def withdrawal_severity(events: DataFrame, concentration: DataFrame, incidents: DataFrame, large: int = 10**22) -> DataFrame:
    """Per token, of removals up to the incident (all, where it is 0): their number, what they took of the token's TVL (at most 1), and whether any
    moved more than `large` of token0."""
    rows = events.join(incidents, "token_address").where((F.col("incident_block") == 0) | (F.col("block_number") <= F.col("incident_block")))
    out = rows.groupBy("token_address").agg(F.sum("event_count").alias("removals"), F.sum("amount").alias("_removed"), F.coalesce(F.bool_or(F.abs("token0_amount") > large), F.lit(False)).alias("large_sells"))
    out = out.join(concentration.select("token_address", "total_tvl"), "token_address", "left")
    share = F.try_divide(F.coalesce(F.col("_removed").cast("double"), F.lit(0.0)), F.col("total_tvl").cast("double"))
    return out.select("token_address", "removals", F.when(share > 1, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("severity"), "large_sells")
