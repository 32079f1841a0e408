from pyspark.sql import functions as F

from evimatch.operators import jobs


def test_breaker_stream(spark, tmp_path):
    from evimatch.streaming import jobs as live

    rows = [(7, i, f"2024-01-01 00:00:{i:02d}", i != 3) for i in range(12)]
    spark.createDataFrame(rows, "job_id long, event_id long, ts string, failed boolean").selectExpr("job_id", "event_id", "cast(ts as timestamp) ts", "failed").write.parquet(f"{tmp_path}/log")
    log = spark.readStream.schema("job_id long, event_id long, ts timestamp, failed boolean").parquet(f"{tmp_path}/log")
    q = live.breakers(log).writeStream.outputMode("update").format("memory").queryName("breakers").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from breakers").collect()] == [(7, 8, True)]


def test_job_states_stream_like_batch(spark, tmp_path):
    """Events of many jobs in files out of order, some told twice and some late but inside the watermark."""
    import random

    from evimatch.streaming import jobs as live

    rng = random.Random(3)
    actions = ["added", "started", "started", "done", "failed", "failed", "retry", "pause", "resume", "cancel", "run", "retry failed"]
    schema = "job_id long, ts timestamp, event_id long, action string, retryable boolean"
    rows = [(rng.randrange(12), 60 * i + rng.randrange(400), i, rng.choice(actions), rng.choice([True, False, None])) for i in range(500)]
    rows = [(j, -1, 1000 + j, "added", None) for j in range(12)] + rows
    rows += [r for r in rows if r[2] % 9 == 0]
    as_rows = lambda some: spark.createDataFrame(some, schema.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000))
    want = sorted(map(tuple, jobs.reduce_log(as_rows(rows)).collect()))
    assert len({w[1] for w in want}) > 2 and max(w[5] for w in want) > 0
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    at = f"{tmp_path}/log"
    as_rows(rows[:1]).limit(0).write.parquet(at)
    log = spark.readStream.schema(schema).parquet(at)
    q = live.states(log, "30 minutes").writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        rows.sort(key=lambda r: r[1] + rng.randrange(900))
        for lo in range(0, len(rows), 180):
            as_rows(rows[lo : lo + 180]).coalesce(1).write.mode("append").parquet(at)
            q.processAllAvailable()
        as_rows([(99, 10_000_000, 5000, "added", None)]).coalesce(1).write.mode("append").parquet(at)  # moves the watermark past all
        q.processAllAvailable()
    finally:
        q.stop()
        for k, v in before.items():
            spark.conf.set(k, v)
    last = {}
    for r in spark.sql("select * from states").collect():
        last[r.job_id] = r  # rows come in the order of batches
    assert sorted(map(tuple, last.values())) == want


def test_rate_limit(spark):
    r = spark.createDataFrame([(1, i, 0) for i in range(14)], "client long, request_id long, at_ms long")
    waits = [x.wait_ms for x in jobs.rate_limit(r).orderBy("request_id").collect()]
    assert waits[:12] == [0.0] * 12 and abs(waits[12] - 1000 / 3) < 1e-6 and abs(waits[13] - 2000 / 3) < 1e-6
