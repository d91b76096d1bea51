from datetime import datetime, timedelta, timezone


from tickloom.streaming import live

T0 = datetime(2026, 1, 5, 8, tzinfo=timezone.utc)
SCHEMA = "tick_id long, symbol string, captured_at_utc timestamp, last double"


def write(spark, path, rows, n):
    spark.createDataFrame([(i, s, T0 + timedelta(seconds=t), v) for i, s, t, v in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/ticks.parquet/{n}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/ticks.parquet")


def test_late_rows_count_until_the_watermark_passes(spark, tmp_path):
    write(spark, tmp_path, [(1, "a", 0, 1.0), (2, "a", 50, 3.0), (3, "a", 70, 2.0)], 1)
    write(spark, tmp_path, [(4, "a", 55, 5.0), (5, "a", 1000, 7.0)], 2)
    write(spark, tmp_path, [(8, "a", 1010, 7.0)], 3)  # a batch's own rows move the mark for the next but one
    write(spark, tmp_path, [(6, "a", 10, 99.0), (7, "a", 2000, 1.0)], 4)
    rows = live.run_once(live.bars(stream(spark, tmp_path), "1 minute", "2 minutes"), f"{tmp_path}/out").orderBy("start_us").collect()
    assert [(r.open, r.high, r.low, r.close, r.readings) for r in rows] == [(1.0, 5.0, 1.0, 5.0, 3), (2.0, 2.0, 2.0, 2.0, 1), (7.0, 7.0, 7.0, 7.0, 2)]


def test_keyed_trail_over_batches(spark, tmp_path):
    write(spark, tmp_path, [(1, "a", 0, 100.0), (2, "a", 1, 98.0), (3, "b", 0, 50.0)], 1)
    write(spark, tmp_path, [(4, "a", 2, 94.0), (4, "a", 2, 94.0), (5, "a", 3, 91.0), (6, "b", 5, None)], 2)
    rows = live.run_once(live.trails(stream(spark, tmp_path), 5.0), f"{tmp_path}/out").collect()
    assert [(r.symbol, r.price, r.high) for r in rows] == [("a", 94.0, 100.0)]


def test_activity_sessions(spark, tmp_path):
    write(spark, tmp_path, [(i, "a", t, 1.0) for i, t in enumerate((0, 10, 25, 100, 5000))], 1)
    rows = live.run_once(live.activity(stream(spark, tmp_path), "30 seconds", "1 minute"), f"{tmp_path}/out").orderBy("start_us").collect()
    assert [(r.end_us - r.start_us, r.readings) for r in rows] == [(55_000_000, 3), (30_000_000, 1)]


def test_stream_join_of_one_hot_symbol(spark, tmp_path):
    """A row meets the rows near it in time, not all of its symbol: otherwise 60,000 rows do not end within the limit."""
    import random
    import threading

    r = random.Random(5)
    ms = sorted(r.randrange(60_000_000) for _ in range(60_000))
    ms[:8] = [0, 0, 100, 101, 3_200, 3_300, 6_399, 6_400]  # equal instants, the distance itself, borders of slots
    ms.sort()
    rows = [(i, "a", t / 1000, 1.0) for i, t in enumerate(ms)]
    write(spark, tmp_path, [*rows[:40_000], (90_000, "b", ms[0] / 1000, 1.0), (90_001, None, ms[0] / 1000, 1.0)], 1)
    write(spark, tmp_path, rows[40_000:], 2)
    cols = lambda n: stream(spark, tmp_path).selectExpr("symbol", "captured_at_utc as t", f"tick_id as {n}")
    limit = threading.Timer(90, lambda: [q.stop() for q in spark.streams.active])
    limit.start()
    got = live.run_once(live.matched_feeds(cols("lid"), cols("rid"), "100 milliseconds", "10 minutes").where("lid < rid"), f"{tmp_path}/out", conf=live.JOIN)
    limit.cancel()
    want = sorted((i, j) for i, t in enumerate(ms) for j in range(i + 1, min(i + 50, len(ms))) if ms[j] - t <= 100)
    assert sorted((x.lid, x.rid) for x in got.collect()) == want and len(want) > 50
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"  # the session's settings are as before
