import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events as E

SCHEMA = "token_address string, pool_address string, block_number long, log_index int, ts timestamp, price double, amount long, actor string"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [("T", "p", i, 0, f"2024-01-01 0{i // 4}:{(i % 4) * 15:02d}:00", float(1 + i % 3), 10 + i, "u") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    df.union(df).coalesce(1).write.parquet(f"{tmp_path}/in")  # every row twice
    return tmp_path, df


def run(spark, df, tmp_path, mode="append"):
    q = E.stream_sink(df, f"{tmp_path}/out", f"{tmp_path}/ck", mode)
    q.awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/out")


def test_dedupe_equals_batch(spark, folder):
    path, df = folder
    out = run(spark, E.stream_dedupe(E.stream_events(spark, f"{path}/in", df.schema), ["block_number", "log_index"]), path)
    assert out.count() == 20


def test_ohlcv_of_closed_windows(spark, folder):
    path, df = folder
    out = run(spark, E.stream_ohlcv(E.stream_events(spark, f"{path}/in", df.schema)), path)
    got = {r.bucket.hour: (r.open, r.high, r.low, r.close, r.volume) for r in out.collect()}
    for hour, values in got.items():
        rows = [(1 + i % 3, 10 + i) for i in range(20) if i // 4 == hour]
        assert values == (rows[0][0], max(r[0] for r in rows), min(r[0] for r in rows), rows[-1][0], 2 * sum(r[1] for r in rows))
    assert set(got) >= {0, 1, 2, 3}


def test_balance_state(spark, tmp_path):
    schema = "token_address string, address string, block_number long, balance_raw long"
    spark.createDataFrame([("T", "a", 1, 100), ("T", "a", 2, 500), ("T", "a", 3, 80)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = E.stream_balance_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("balances").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.table("balances").first()) == ("T", "a", 100, 80, 500, 400, 420)


def test_late_blocks_do_not_become_the_end(spark, tmp_path):
    schema = "token_address string, address string, block_number long, balance_raw long"
    for k, row in enumerate([("T", "a", 5, 100), ("T", "a", 9, 300), ("T", "a", 7, 50), ("T", "a", 10, 200)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(1.1 if k < 3 else 0)  # files are taken in order of their time
    stream = E.stream_balance_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("late").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    states = {tuple(r)[2:] for r in spark.table("late").collect()}
    assert states == {(100, 100, 100, 0, 0), (100, 300, 300, 200, 0), (100, 200, 300, 200, 100)}


def test_rollup_over_sliding_spans(spark, folder):
    path, df = folder
    out = run(spark, E.stream_rollup(E.stream_events(spark, f"{path}/in", df.schema), span="2 hours", slide="1 hour"), path)
    for r in out.collect():
        rows = [10 + i for i in range(20) if r.span_end.hour - 2 <= i // 4 < r.span_end.hour]
        assert r.volume == 2 * sum(rows)
    assert out.count() >= 3


def test_migration_stream_equals_batch(spark, tmp_path):
    schema = "token_address string, actor string, block_number long, ts timestamp"
    at = lambda i: f"2024-01-01 00:00:{i:02d}"
    rows = lambda *r: spark.createDataFrame([("T", a, b, at(b)) for a, b in r], schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    rows(("x", 1), ("y", 2), ("z", 3)).coalesce(1).write.parquet(f"{tmp_path}/r")
    rows(("x", 4), ("y", 30), ("x", 1), ("w", 3)).coalesce(1).write.parquet(f"{tmp_path}/a")
    read = lambda side: E.stream_events(spark, f"{tmp_path}/{side}", spark.read.parquet(f"{tmp_path}/{side}").schema)
    out = run(spark, E.stream_migration(read("r"), read("a")), tmp_path)
    assert sorted(tuple(r) for r in out.collect()) == [("T", "x", 1, 1), ("T", "x", 1, 4)]


@pytest.mark.parametrize("keep_ms", [None, 3_600_000])
def test_balances_in_any_order_equal_the_batch(spark, tmp_path, keep_ms):
    import random
    from decimal import Decimal

    from tidemark.operators import holders
    from tidemark.streaming import balances as B

    rng = random.Random(3)
    rows = [(t, a, b, Decimal(rng.randrange(10**25))) for t, a in (("T", "a"), ("T", "b"), ("U", "a")) for b in rng.sample(range(60), 25)]
    rows += [("U", "only_before", 3, Decimal(7)), ("U", "only_after", 40, Decimal(9)), ("U", "beyond", 99, Decimal(1))]
    want = {tuple(r)[:7] for r in holders.balance_trajectory(spark.createDataFrame(rows, "token_address string, address string, block_number long, balance_raw decimal(38,0)"), 10, 50).collect()}
    rng.shuffle(rows)
    schema = "token_address string, address string, block_number long, balance_raw string"
    import time

    for k in range(3):
        spark.createDataFrame([(t, a, b, str(x)) for t, a, b, x in rows[k::3] + rows[:2]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.2)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", B.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = B.stream_balance_trajectory(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 10, 50, keep_ms)
        seen = {}

        def keep(batch, number):
            seen.update({(r.token_address, r.address): tuple(r) for r in batch.collect()})

        writer = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck")
        q = writer.trigger(processingTime="1 second").start()
        until = time.time() + 60  # with a time to live there is always a next trigger
        while time.time() < until and q.isActive and set(seen.values()) != want:
            time.sleep(0.5)
        q.stop()
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert set(seen.values()) == want and len(want) == 5
