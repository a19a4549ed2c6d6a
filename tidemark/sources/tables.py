"""Reading, writing and conforming canonical tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


_BASE = "token_address string, block_number long, log_index int, block_timestamp long, transaction_hash string, event_type string"
_POOLED = f"{_BASE}, protocol string, version string, pool_address string, actor string, recipient string, source_event string"
_PANEL = (
    "token_address string, scope string, pool_identifier string, bucket_start long, bucket_end long, bucket_seconds int, price_open double, price_high double, price_low double, price_close double, price_vwap double, "
    "price_unit string, price_source string, staleness long, price_is_carried boolean, tvl_token_close double, snapshot_block long, state_bucket long, tvl_is_carried boolean, volume_token double, volume_usd double, swap_count long, "
    "active_trader_count long, liquidity_added double, liquidity_removed double, net_lp_flow double, lp_add_event_count long, lp_remove_event_count long, active_lp_count long, identity_coverage double, add_amount_coverage double, "
    "withdrawal_amount_coverage double, measured_pools long, verified_pools long, price_return double, tvl_change double, net_lp_flow_ratio double, withdrawal_ratio double, volume_turnover double, close_vwap_gap double, "
    "data_coverage string, is_imputed boolean"
)
#: Declared schemas; raw amounts are base-10 strings at rest.
SCHEMAS = {
    "swaps": _schema(f"{_POOLED}, token0_address string, token1_address string, token0_raw string, token1_raw string, amount_usd double"),
    "transfers": _schema(f"{_BASE}, from_address string, to_address string, amount_raw string"),
    "position_events": _schema(f"{_POOLED}, nft_token_id long, token0_raw string, token1_raw string, liquidity_delta string"),
    "liquidity_events": _schema(f"{_POOLED}, token0_raw string, token1_raw string, liquidity_delta string, tick_lower int, tick_upper int, salt string, event_count int, aggregation_scope string, amount_usd double, amounts_available string, quantification_status string"),
    "holdings": _schema("token_address string, address string, balance_raw string, balance_decimal double, balance_source string, address_type string, start_balance_raw string, end_balance_raw string, peak_balance_raw string, moved_in_raw string, moved_out_raw string, tx_count long, first_seen_block long, last_seen_block long"),
    "positions": _schema("token_address string, pool_address string, owner string, nft_token_id long, tick_lower int, tick_upper int, liquidity_raw string, share_pct double, method string, confidence string"),
    "tvl_points": _schema("token_address string, block_number long, log_index int, block_timestamp long, pool_address string, tvl_raw string, tvl_usd double, snapshot_block long, tvl_source string"),
    "volume_timeline": _schema("token_address string, bucket long, pool_address string, volume_raw string, volume_usd double, swap_count long, share double"),
    "analysis_series": _schema(_PANEL),
}
#: Raw amounts that are 0 where they are not given; those of liquidity events stay unknown.
ZERO_RAW = {"swaps": ["token0_raw", "token1_raw"], "transfers": ["amount_raw"], "holdings": ["balance_raw"], "volume_timeline": ["volume_raw"]}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns: unknown ones go, missing ones are null, addresses are lower-case, blanks are null. Raw amounts may
    be named as the normalisers name them (token0_amount); those of swaps, transfers, balances and volumes are "0" where they
    are missing."""
    out = []
    for f in SCHEMAS[table].fields:
        name = next((n for n in (f.name, f.name.replace("_raw", "_amount")) if n in df.columns), None)
        given = name is not None
        c = F.col(name) if given else F.lit(None).cast(f.dataType)
        if given and isinstance(f.dataType, T.StringType):
            c = F.nullif(F.trim(c.cast("string")), F.lit(""))
            c = F.lower(c) if f.name.endswith(("address", "hash", "actor", "recipient", "owner")) else c
        elif given and isinstance(df.schema[name].dataType, T.TimestampType):
            c = F.unix_timestamp(c)
        elif given:
            c = c.cast("string").try_cast(f.dataType)
        if f.name in ZERO_RAW.get(table, ()):
            c = F.coalesce(c, F.lit("0"))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, name: str, kind: str = "parquet", partition_by: tuple[str, ...] = ("token_address",)) -> None:
    """Parquet (zstd), JSON or both, of the same conformed rows."""
    rows = conform(df, name)
    if kind in ("parquet", "both"):
        rows.write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(f"{path}/{name}")
    if kind in ("json", "both"):
        rows.write.mode("overwrite").partitionBy(*partition_by).json(f"{path}/{name}.json")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet if it is there, else JSON. Columns and predicate reach the scan."""
    reader = spark.read.schema(SCHEMAS[name])
    df = reader.parquet(f"{path}/{name}") if _exists(spark, f"{path}/{name}") else reader.json(f"{path}/{name}.json")
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_event_lines(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """Events from files of JSON lines, each event once."""
    return dedupe_events(conform(spark.read.schema(SCHEMAS[name]).json(pattern), name))


def read_pools_file(spark: SparkSession, path: str, token: str) -> DataFrame:
    """Pool candidates from an export: a list, or an object that holds it as data, pools or rows. `matches` says whether the token is in the pair."""
    raw = spark.read.option("multiLine", True).json(path)
    held = [c for c in ("data", "pools", "rows") if c in raw.columns]
    rows = raw.select(F.explode(F.col(held[0])).alias("p")).select("p.*") if held else raw
    column = lambda *names: F.coalesce(*[F.lower(F.col(n).cast("string")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    out = rows.select(column("pool_address", "address", "pool").alias("pool_address"), column("token0", "token0_address").alias("token0"), column("token1", "token1_address").alias("token1"), column("project", "protocol").alias("project"), column("version").alias("version"))
    return out.withColumn("matches", F.coalesce((F.col("token0") == token.lower()) | (F.col("token1") == token.lower()), F.lit(False)))


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_summary(spark: SparkSession, path: str, **values) -> None:
    """A small keyed summary, one row of JSON."""
    spark.createDataFrame([{k: v for k, v in values.items()}]).write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """The summary, or the default where there is none."""
    if not _exists(spark, path):
        return dict(default or {})
    return spark.read.json(path).first().asDict(recursive=True)


def registry(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    """The enabled deployments: protocol, version, factory."""
    return spark.createDataFrame(rows, "protocol string, version string, factory string, enabled boolean").where("enabled").select("protocol", "version", F.lower("factory").alias("factory"))


def query_tables(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """SQL over DataFrames by name in braces, with named parameters."""
    return spark.sql(sql, args=args, **tables)


def flatten_volume(doc: DataFrame) -> DataFrame:
    """bucket, map(pool -> volume) to a row for each pool."""
    return doc.select("bucket", F.explode("pools").alias("pool", "volume"))


def inflate_volume(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pool", "volume")))).alias("pools"))


def dedupe_events(events: DataFrame, key: tuple[str, ...] = ("transaction_hash", "log_index", "event_type", "source_event", "token_address")) -> DataFrame:
    """One row of each key, of the parts of it that the events have; equal keys are the same event, so any will do."""
    return events.dropDuplicates([c for c in key if c in events.columns])


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy in the folder that spark.checkpoint.dir names, or in a folder of its own where it names none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()
