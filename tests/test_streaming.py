from ledgerloom.operators.spec import batch_daily
from ledgerloom.streaming import incremental


def test_daily_totals_match_batch(spark, sf_dir, tmp_path):
    src = f"{tmp_path}/in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.unionAll(events.limit(20)).repartition(3).write.parquet(src)  # repeated events count once
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = incremental.daily_totals(stream).writeStream.format("memory").queryName("daily").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.d), r.event_type): (r.n, r.amount_c) for r in spark.sql("select * from daily").collect()}
    want = {(str(r.d), r.event_type): (r.n, r.amount_c) for r in batch_daily(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(got) >= len(want) - 3 * 5  # the days after the watermark are still open


def test_sessions_run(spark, sf_dir, tmp_path):
    src = f"{tmp_path}/in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = incremental.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from sessions where n < 1").count() == 0
