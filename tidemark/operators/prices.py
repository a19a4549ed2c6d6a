"""Swaps with amounts in whole tokens, prices and USD values; open, high, low and close of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money as M
from tidemark.functions import scalars as S
from tidemark.operators.asof import last_known
from tidemark.operators.market import ORDER, TARGET, resolve_swap_pool

TOKEN = "token_address"


def with_token(rows: DataFrame, tokens: DataFrame | None, target: str = TARGET, decimals: int = 18) -> DataFrame:
    """rows + _target, _decimals: the address and decimals of each row's token, from the table of tokens (token_address,
    target, decimals) or, without one, the same for all. A token that the table lacks has neither."""
    if tokens is None:
        return rows.withColumns({"_target": F.lit(target), "_decimals": F.lit(decimals)})
    return rows.join(tokens.select(TOKEN, F.col("target").alias("_target"), F.col("decimals").alias("_decimals")), TOKEN, "left")


def with_quote(rows: DataFrame, quotes: DataFrame | None) -> DataFrame:
    """rows + _quote_decimals, _known, _stable of their quote, from a table (quote, decimals, stable) or the assets known here."""
    if quotes is None:
        return rows.withColumns({"_quote_decimals": M.quote_decimals(F.col("quote")), "_known": F.col("quote").isin(list(M.QUOTE_DECIMALS)), "_stable": F.col("quote").isin(M.STABLE)})
    rows = rows.join(quotes.select("quote", F.col("decimals").alias("_quote_decimals"), F.col("stable").alias("_stable"), F.lit(True).alias("_known")), "quote", "left")
    return rows.withColumns({"_quote_decimals": F.coalesce("_quote_decimals", F.lit(M.DEFAULT_DECIMALS)), "_known": F.coalesce("_known", F.lit(False)), "_stable": F.coalesce("_stable", F.lit(False))})


def first_pair(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """rows + pool: of a row that names its tokens the first pool (by ordinal) of that pair, whatever its address; else the pool of
    its address; null where there is none."""
    pair = pools.groupBy(F.least("token0", "token1").alias("_lo"), F.greatest("token0", "token1").alias("_hi")).agg(F.min_by("pool_address", "ordinal").alias("_by_pair"))
    exact = pools.select(F.col("pool_address").alias("_exact")).distinct()
    named = F.col("token0_address").isNotNull() & F.col("token1_address").isNotNull()
    lo, hi = F.least("token0_address", "token1_address"), F.greatest("token0_address", "token1_address")
    found = rows.join(exact, rows.pool_address == F.col("_exact"), "left").join(pair, named & (lo == F.col("_lo")) & (hi == F.col("_hi")), "left")
    return found.withColumn("pool", F.when(named, F.col("_by_pair")).otherwise(F.col("_exact"))).drop("_exact", "_by_pair", "_lo", "_hi")


def sided(swaps: DataFrame, pools: DataFrame, tokens: DataFrame | None = None, quotes: DataFrame | None = None, target: str = TARGET, decimals: int = 18, resolve=resolve_swap_pool) -> DataFrame:
    """swaps (raw amounts as strings) + pool, side, quote, target, quote_amount: whole tokens by each side's decimals.

    The side is that of the swap's own token addresses, else of its pool's order; trades of an aggregator do not keep that
    order, so theirs is decided by the magnitude of the amounts. Neither: no side, no amounts.
    """
    rows = with_token(resolve(swaps, pools), tokens, target, decimals)
    order = pools.groupBy(F.col("pool_address").alias("_pool")).agg(F.min(F.struct(F.col("token0").alias("_p0"), F.col("token1").alias("_p1"))).alias("_o"))
    rows = rows.join(order, rows.pool == order["_pool"], "left").drop("_pool")
    source = F.col("source_event") if "source_event" in rows.columns else F.lit(None).cast("string")
    t0, t1, p0, p1 = F.col("token0_address"), F.col("token1_address"), F.col("_o._p0"), F.col("_o._p1")
    rows = rows.withColumn("side", M.target_side(t0, t1, p0, p1, F.col("token0_raw"), F.col("token1_raw"), source, F.col("_target"), F.col("_decimals")))
    first, second = F.col("side") == 0, F.col("side") == 1
    named = (t0 == F.col("_target")) | (t1 == F.col("_target"))
    # the quote is what stands opposite: in the swap where it names the target, else in the pool
    quote = F.when(named, F.when(first, t1).when(second, t0)).when(F.col("side").isNotNull(), F.when(p0 == F.col("_target"), p1).otherwise(p0))
    rows = with_quote(rows.withColumn("quote", quote), quotes)
    mine, other = F.when(first, F.col("token0_raw")).when(second, F.col("token1_raw")), F.when(first, F.col("token1_raw")).when(second, F.col("token0_raw"))
    return rows.withColumns({"target": F.abs(M.units(mine, F.col("_decimals"))), "quote_amount": F.abs(M.units(other, F.col("_quote_decimals")))}).drop("_o")


def priced_swaps(swaps: DataFrame, pools: DataFrame, target: str = TARGET, decimals: int = 18, tokens: DataFrame | None = None, quotes: DataFrame | None = None, resolve=resolve_swap_pool) -> DataFrame:
    """swaps (raw amounts as strings) + pool, side, target, quote, quote_amount, price, unit, source, usd.

    tokens, quotes: tables of the tokens and quote assets, for many tokens in one job; else target, decimals and the assets
    known here. resolve: how a swap's pool is found. usd: stated, else a stable quote, else by the last positive USD price of the pool at or before the swap;
    null if unknown.
    """
    rows = sided(swaps, pools, tokens, quotes, target, decimals, resolve)
    price = M.swap_price(F.col("amount_usd"), F.col("target"), F.col("quote"), F.col("quote_amount"), F.col("_known"))
    rows = rows.withColumn("_p", price).withColumns({"price": F.col("_p.price"), "unit": F.col("_p.unit"), "source": F.col("_p.source")}).drop("_p")
    known = F.when((F.col("unit") == "USD") & F.col("pool").isNotNull(), F.col("price"))
    rows = last_known(rows, [TOKEN, "pool"], "block_number", "log_index", known, "_last")
    usd = M.swap_usd(F.col("amount_usd"), F.col("quote"), F.col("quote_amount"), F.col("target"), F.when(F.col("pool").isNotNull(), F.col("_last")), F.col("_stable"))
    return rows.withColumn("usd", usd).drop("_last", "_target", "_decimals", "_quote_decimals", "_known", "_stable")


def volume_timeline(priced: DataFrame, unit: str = "hour") -> DataFrame:
    """token, bucket (its first second), pool: volume in whole tokens and in USD, an unknown value counting 0, and swaps; by hour,
    day, week or month of the calendar, UTC."""
    rows = priced.where("pool is not null and target is not null")
    start = F.unix_timestamp(F.date_trunc(unit, F.timestamp_seconds("block_timestamp")))
    return rows.groupBy(TOKEN, start.alias("bucket"), "pool").agg(
        F.sum(F.round("target", 6).cast(M.USD)).alias("volume"), F.sum(F.coalesce("usd", F.lit(0).cast(M.USD))).alias("volume_usd"), F.count("*").alias("swap_count")
    )


def ohlc(priced: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Per bucket: open (the first of ties), high, low, close (the last), VWAP, volumes, trades and traders.

    Prices are those of the unit the bucket saw first. Volume, trades and traders are of all swaps with a target amount.
    """
    rows = priced.where("target is not null").withColumns({"bucket": S.bucket_ts(F.col("block_timestamp"), seconds), "_at": F.struct(*ORDER)})
    by = [*keys, "bucket"]
    first = F.min_by("unit", F.when(F.col("price").isNotNull(), F.col("_at"))).over(Window.partitionBy(*by))
    same = F.col("unit") == F.col("_unit")
    price = F.when(same, F.col("price"))
    at = F.when(same, F.col("_at"))
    rows = rows.withColumn("_unit", first)
    out = rows.groupBy(*by).agg(
        F.min_by("price", at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by("price", at).alias("close"),
        F.sum(F.round(price * F.col("target"), 6).cast(M.USD)).alias("_pv"), F.sum(F.when(same, F.round("target", 6).cast(M.USD))).alias("_v"),
        F.max("_unit").alias("price_unit"), F.when(F.count_distinct(F.when(same, F.col("source"))) > 1, "mixed").otherwise(F.max(F.when(same, F.col("source")))).alias("price_source"),
        F.max(F.when(same, F.col("block_timestamp"))).alias("last_trade"), F.sum(F.round("target", 6).cast(M.USD)).alias("volume"), F.sum("usd").alias("volume_usd"),
        F.count("*").alias("swap_count"), F.count_distinct("actor").alias("active_traders"),
    )
    return out.withColumn("vwap", F.round(F.try_divide(F.col("_pv").cast("double"), F.col("_v").cast("double")), 6)).drop("_pv", "_v")
