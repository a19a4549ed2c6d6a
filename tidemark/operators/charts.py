"""The tables behind charts: a value of every pool at each time, and the details of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join

TOKEN = "token_address"


def pool_matrix(rows: DataFrame, at: str, value: Column, name: str, last_by: list[str] | None = None) -> DataFrame:
    """token, time, and a map of every pool that has a value there, in order of pools; gaps are left out. The last value by
    last_by, or without it the sum. Whatever pools a token has, no list of them is needed. rows: token_address, pool, `at`."""
    known = rows.where(F.col("pool").isNotNull()).withColumn("_v", value).where(F.col("_v").isNotNull())
    each = known.groupBy(TOKEN, at, "pool").agg((F.max_by("_v", F.struct(*last_by)) if last_by else F.sum("_v")).alias("_v"))
    # a map holds one entry for each pool of a token
    return each.groupBy(TOKEN, at).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pool", "_v")))).alias(name))


def point_details(tvl: DataFrame, volume: DataFrame, seconds: int = 3600) -> DataFrame:
    """Of each point of a token and pool: its TVL, its share of all pools' at that time, the price, and the volume of the bucket that
    covers the time, else of the nearest earlier one.

    tvl: token_address, at (seconds), pool, tvl, price; volume: token_address, bucket, pool, volume. The total of a time is
    taken first and joined back, buckets are looked up once for each time.
    """
    total = tvl.groupBy(TOKEN, "at").agg(F.sum("tvl").alias("total_tvl"))
    buckets = volume.select(TOKEN, F.col("bucket").alias("_b"), F.col("bucket").alias("volume_bucket")).distinct()
    times = asof_join(total, buckets, [TOKEN], "at", "_b", ["volume_bucket"], span=7 * 86_400)
    rows = tvl.join(times, [TOKEN, "at"])
    rows = rows.join(volume.select(TOKEN, F.col("bucket").alias("volume_bucket"), "pool", "volume"), [TOKEN, "volume_bucket", "pool"], "left")
    share = 100 * F.try_divide(F.col("tvl").cast("double"), F.nullif(F.col("total_tvl").cast("double"), F.lit(0.0)))
    return rows.select(TOKEN, "at", "pool", "tvl", "total_tvl", share.alias("share_pct"), "price", "volume_bucket", "volume", (F.col("at") - F.col("volume_bucket") < seconds).alias("covered"))


def total_series(tvl: DataFrame, at: str, last_by: list[str]) -> DataFrame:
    """token, time, total, pools, unit: what the pools seen at a time hold together, of each its last row there by last_by. A
    row counts in USD where its USD value is known, else in whole tokens; the unit is USD where any row of the token has one.
    tvl: token_address, `at`, pool, tvl (whole tokens), tvl_usd. Nothing is carried from earlier times."""
    value = F.coalesce(F.col("tvl_usd"), F.col("tvl"), F.lit(0.0))
    each = tvl.groupBy(TOKEN, at, "pool").agg(F.max_by(F.round(value, 6).cast("decimal(34,6)"), F.struct(*last_by)).alias("v"))
    unit = tvl.groupBy(TOKEN).agg(F.when(F.count("tvl_usd") > 0, "USD").otherwise("token").alias("unit"))
    return each.groupBy(TOKEN, at).agg(F.sum("v").cast("double").alias("total"), F.count("*").alias("pools")).join(unit, TOKEN)
