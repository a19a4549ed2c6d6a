"""Column functions shared by the operators. Null means unknown, 0 means measured and zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote assets with their decimals, and the stable ones.
QUOTES = {"WETH": 18, "USDC": 6, "USDT": 6, "DAI": 18}
STABLE = ["USDC", "USDT", "DAI"]


def bucket_ts(ts: Column, seconds: int) -> Column:
    """Start of the bucket; 0 for a time of 0 or before."""
    return F.when(ts > 0, F.floor(ts / seconds).cast("long") * seconds).otherwise(F.lit(0).cast("long"))


def chart_span(blocks: Column) -> Column:
    """month, week or day, by the number of blocks in view."""
    return F.when(blocks >= 180_000, "month").when(blocks >= 45_000, "week").otherwise("day")


def target_amount(token0: Column, token1: Column, amount0: Column, amount1: Column, target: str) -> Column:
    """Amount of the side that is the target, as an absolute value; null if neither is."""
    return F.when(token0 == target, F.abs(amount0)).when(token1 == target, F.abs(amount1))


def quote_amount(token0: Column, token1: Column, amount0: Column, amount1: Column, target: str) -> Column:
    return F.when(token0 == target, F.abs(amount1)).when(token1 == target, F.abs(amount0))


def same_pair(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Unordered pairs equal; true where the first pair is unknown."""
    return F.coalesce((F.least(a0, a1) == F.least(b0, b1)) & (F.greatest(a0, a1) == F.greatest(b0, b1)), F.lit(True))


def liquidity_quantified(version: Column, amount0: Column, amount1: Column) -> Column:
    """False where only a liquidity delta is known."""
    return ~((version == "v4") & (F.coalesce(amount0, F.lit(0)) == 0) & (F.coalesce(amount1, F.lit(0)) == 0))


def sqrt_price_to_price(sqrt_x96: Column, decimals0: Column, decimals1: Column) -> Column:
    """token1 per token0."""
    return F.pow(sqrt_x96.cast("double") / F.lit(2.0**96), 2) * F.pow(F.lit(10.0), decimals0 - decimals1)


def parse_timestamp(text: Column) -> Column:
    """Seconds since 1970 from epoch seconds, epoch milliseconds or common date forms; 0 if none fits."""
    number = text.try_cast("double")
    stamp = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSS 'UTC'", "yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    return F.coalesce(F.when(number > 1e10, F.floor(number / 1000)).otherwise(F.floor(number)), F.unix_timestamp(stamp), F.lit(0)).cast("long")


def normalize_address(address: Column) -> Column:
    return F.lower(F.regexp_replace(address, r"^\\x", "0x"))


def topic_address(topic: Column) -> Column:
    """Address in the low 20 bytes of a topic."""
    return F.lower(F.concat(F.lit("0x"), F.right(topic, F.lit(40))))


#: Blocks of a day, and the spans in days that a window may have.
BLOCKS_PER_DAY, WINDOW_DAYS = 7200, (7, 30)


def block_window(block: Column, days: int, ends: bool = False) -> Column:
    """struct(start, end), both inclusive: the window of so many days that starts with the block, or ends with it (never before
    block 1). Null for a block of 0 or less; other spans than WINDOW_DAYS are an error."""
    if days not in WINDOW_DAYS:
        raise ValueError(f"a window has one of {WINDOW_DAYS} days")
    span = days * BLOCKS_PER_DAY
    start = F.greatest(F.lit(1), block - (span - 1)) if ends else block
    end = block if ends else block + (span - 1)
    return F.when(block > 0, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
