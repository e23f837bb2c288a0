import datetime as dt

from pyspark.sql import functions as F

from dotspark.operators import dedupe, tracks
from dotspark.streaming import streams

DAY = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, n=60):
    return spark.createDataFrame([(i, DAY + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(n)], EVENTS)


def streamed(spark, tmp_path, rows, name):
    path = str(tmp_path / name)
    rows.coalesce(1).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def closed(rows):
    """Rows and one far later, that the watermark passes all others."""
    last = rows.limit(1).withColumn("ts", F.lit(DAY + dt.timedelta(days=30))).withColumn("user_id", F.lit(99).cast("long"))
    return rows.unionByName(last)


def same(stream_result, batch, skip):
    return sorted(map(tuple, stream_result.collect())) == sorted(map(tuple, batch.where(skip).collect()))


def test_windows_equal_batch(spark, tmp_path):
    rows = closed(events(spark))
    make = lambda df: streams.tumbling(df, "2 hours", ["user_id"])
    got = streams.run_to_memory(make(streamed(spark, tmp_path, rows, "a")), "tumbling")
    assert same(got, make(rows), "user_id < 99")
    make = lambda df: streams.sessions(df, "40 minutes", ["user_id"])
    got = streams.run_to_memory(make(streamed(spark, tmp_path, rows, "b")), "sessions")
    assert same(got, make(rows), "user_id < 99")


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    rows = events(spark, 20)
    rows.coalesce(1).write.parquet(path)
    stream = streams.tumbling(spark.readStream.schema(rows.schema).parquet(path), "1 hour", [], late="10 minutes")
    again = lambda: streams.run_to_memory(stream, "late", checkpoint=str(tmp_path / "cp"))
    assert again().where(F.col("start") == DAY).first().n == 4
    events(spark, 1).coalesce(1).write.mode("append").parquet(path)  # minute 0 again, hours behind the watermark
    writer = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    writer.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in writer.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_dedupe_and_join_equal_batch(spark, tmp_path):
    rows = events(spark)
    twice = rows.unionByName(rows)
    got = streams.run_to_memory(streams.dedupe(streamed(spark, tmp_path, twice, "c"), ["event_id"]), "dedupe")
    assert sorted(r.event_id for r in got.collect()) == list(range(60))
    make = lambda df: streams.interval_join(df.where("event_type = 'a'"), df.where("event_type = 'b'"), ["user_id"], "60 MINUTES").select("event_id", "r_event_id")
    got = streams.run_to_memory(make(streamed(spark, tmp_path, rows, "d")), "joined")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, make(rows).collect())) != []


def test_new_files_count_once(spark, tmp_path):
    path, target, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    for n in (10, 5):
        events(spark, n).coalesce(1).write.mode("append").parquet(path)
        for _ in range(2):
            streams.ingest_new_files(spark.readStream.schema(EVENTS).parquet(path), target, checkpoint).awaitTermination()
    assert spark.read.parquet(target).count() == 15


def detections(spark):
    rows = [(0, k, 100 * k + t, t, float(t + (t % 3) * k), float(k), DAY + dt.timedelta(seconds=t)) for k in range(3) for t in range(30) if t % (4 + k) or t > 20]
    rows += [(0, 0, 900 + t, t, float(t + 2), 0.5, DAY + dt.timedelta(seconds=t)) for t in range(0, 30, 2)]
    return spark.createDataFrame(rows, "video_id long, obj_id long, det_id long, t long, x double, y double, ts timestamp")


def test_stateful_tracks_equal_batch(spark, tmp_path):
    rows = detections(spark).withColumn("t", F.col("t") + F.lit(int(DAY.replace(tzinfo=dt.timezone.utc).timestamp())))
    batch = {r.det_id: r.track_id for r in tracks.link_tracks(rows, 2, 3.0).collect()}
    late = rows.limit(1).withColumn("obj_id", F.lit(9).cast("long")).withColumn("det_id", F.lit(9999).cast("long")).withColumn("ts", F.lit(DAY + dt.timedelta(days=2)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = streams.link_tracks_stream(streamed(spark, tmp_path, rows.unionByName(late).orderBy(F.desc("det_id")), "t"), 2, 3.0, 1000)
        got = {r.det_id: r.track_id for r in streams.run_to_memory(stream, "tracks").collect() if r.det_id != 9999}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == batch


def test_segments_do_not_change_tracks(spark):
    rows = detections(spark)
    got = {r.det_id: r.track_id for r in tracks.link_tracks(rows, 2, 3.0).collect()}
    want = {}
    for key, part in rows.toPandas().groupby(["video_id", "obj_id"]):
        linker = tracks.Linker(2, 3.0)
        for t, frame in part.sort_values(["t", "det_id"]).groupby("t"):
            want |= dict(linker.frame(t, list(zip(frame["det_id"], frame["x"], frame["y"], strict=True))))
    assert got == want


def test_dedupe_twice_is_dedupe_once(spark):
    rows = detections(spark).withColumn("weight", F.col("x"))
    once = dedupe.keep_heaviest(rows, 2.0)
    assert sorted(r.det_id for r in dedupe.keep_heaviest(once, 2.0).collect()) == sorted(r.det_id for r in once.collect())
