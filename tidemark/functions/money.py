"""Raw token amounts, decimals, prices and USD values. Null means unknown, 0 measured and zero.

Raw amounts are base-10 strings at rest and DECIMAL(38,0) in computation; what does not fit 38 digits is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Quote assets with their decimals, and the stable ones.
QUOTE_DECIMALS = {"ETH": 18, "WETH": 18, "USDC": 6, "USDT": 6, "DAI": 18}
STABLE = ["USDC", "USDT", "DAI"]
DEFAULT_DECIMALS = 18
USD = "decimal(24,6)"


def raw(amount: Column) -> Column:
    return amount.try_cast("decimal(38,0)")


def overflows(amount: Column) -> Column:
    """True for a whole number that is too long to compute with."""
    return raw(amount).isNull() & amount.rlike("^-?[0-9]+$")


def units(amount: Column, decimals: Column) -> Column:
    """Whole tokens of a raw amount, as a double."""
    return raw(amount).cast("double") / F.pow(F.lit(10.0), decimals)


def quote_decimals(quote: Column) -> Column:
    """Decimals of a quote asset, 18 for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in QUOTE_DECIMALS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, quote), F.lit(DEFAULT_DECIMALS))


def quote_meta(spark: SparkSession) -> DataFrame:
    """quote, decimals, stable: the quote assets known here, for jobs that bring no table of their own."""
    return spark.createDataFrame([(q, d, q in STABLE) for q, d in QUOTE_DECIMALS.items()], "quote string, decimals int, stable boolean")


def target_side(token0: Column, token1: Column, pool0: Column, pool1: Column, amount0: Column, amount1: Column, source: Column, target: Column, decimals: Column) -> Column:
    """0 or 1: the side that is the target. By the event's own tokens; else by the pool's order, which trades of an
    aggregator do not keep: for these by whose magnitude is nearer to the target's decimals. Null if that decides nothing."""
    far = lambda a: F.abs(F.log10(F.nullif(F.abs(raw(a)).cast("double"), F.lit(0.0))) - decimals)
    by_size = F.when(far(amount0) < far(amount1), 0).when(far(amount1) < far(amount0), 1)
    in_pool = F.when(pool0 == target, 0).when(pool1 == target, 1)
    named = F.when(token0 == target, 0).when(token1 == target, 1)
    return F.coalesce(named, F.when(F.coalesce(source, F.lit("")) != "dex.trades", in_pool).otherwise(F.when(in_pool.isNotNull(), by_size)))


def swap_price(amount_usd: Column, target: Column, quote: Column, quote_amount: Column, known: Column | None = None) -> Column:
    """struct(price, unit, source): USD over target; else a known quote over target; null without either."""
    by_usd = (amount_usd > 0) & (target > 0)
    by_ratio = (target > 0) & (quote_amount > 0) & (quote.isin(list(QUOTE_DECIMALS)) if known is None else known)
    return F.when(by_usd, F.struct((amount_usd / target).alias("price"), F.lit("USD").alias("unit"), F.lit("amount_usd").alias("source"))).when(
        by_ratio, F.struct((quote_amount / target).alias("price"), quote.alias("unit"), F.lit("pool_swap_ratio").alias("source"))
    )


def swap_usd(amount_usd: Column, quote: Column, quote_amount: Column, target: Column, pool_price: Column, stable: Column | None = None) -> Column:
    """What is stated, else the amount of a stable quote, else target times the pool's price as of then; null if none is known."""
    stable = quote.isin(STABLE) if stable is None else stable
    value = F.coalesce(F.when(amount_usd > 0, amount_usd), F.when(stable & (quote_amount > 0), quote_amount), F.when((target > 0) & (pool_price > 0), target * pool_price))
    return F.round(value, 6).cast(USD)


def v2_price(reserve0: Column, reserve1: Column, decimals0: Column, decimals1: Column) -> Column:
    """token1 per token0 by reserves; null where either is 0."""
    return F.try_divide(F.nullif(units(reserve1, decimals1), F.lit(0.0)), F.nullif(units(reserve0, decimals0), F.lit(0.0)))


def positive_balance(balance_raw: Column, balance: Column) -> Column:
    return F.coalesce(raw(balance_raw).cast("double"), balance, F.lit(0.0)) > 0


def expected_tick_spacing(fee: Column) -> Column:
    # Fee in millionths -> tick spacing.
    spacing = {100: 1, 500: 10, 3000: 60, 10000: 200}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in spacing.items() for x in pair]), fee.cast("int"))


def canonical_protocol(name: Column) -> Column:
    """uniswap, curve or balancer by prefix, else the lower-case name."""
    low = F.lower(name)
    return F.when(low.startswith("uniswap"), "uniswap").when(low.startswith("curve"), "curve").when(low.startswith("balancer"), "balancer").otherwise(low)


def version_of_method(method: Column) -> Column:
    """v4 to v1, from a method or project string."""
    return F.nullif(F.regexp_extract(F.lower(method), "v([1-4])", 0), F.lit(""))


def pool_id_hex(value: Column) -> Column:
    """32 bytes in lower-case hex: shorter ids padded on the left, longer ones cut to their low bytes."""
    digits = F.lower(F.regexp_replace(value, r"^(0x|\\x)", ""))
    return F.concat(F.lit("0x"), F.right(F.lpad(digits, F.greatest(F.length(digits), F.lit(64)), F.lit("0")), F.lit(64)))


def salt_to_token_id(salt: Column) -> Column:
    """Decimal token id of a salt of 32 bytes; null beyond 38 digits (the salt stays the id then)."""
    digits = F.right(pool_id_hex(salt), F.lit(64))
    part = lambda a: F.conv(F.substring(digits, a, 15), 16, 10).cast("decimal(38,0)")
    small = F.substring(digits, 1, 34) == "0" * 34  # 30 digits of hex are at most 37 decimal digits
    return F.when(small, (part(35) * F.lit(1 << 60).cast("decimal(20,0)") + part(50)).cast("decimal(38,0)")).cast("string")
