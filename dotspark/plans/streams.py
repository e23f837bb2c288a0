"""Queries of section J: ``live_*`` run a stream over ``events`` and read its sink; ``stream_*`` are the same functions on the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import shared_dir
from ..streaming import streams
from .components import LINKED, _objects
from .registry import ORACLES, Tables, query


def _events(t: Tables) -> DataFrame:
    return streams.event_time(t.read("events")).select("event_id", "ts", "user_id", "event_type", "value")


def _plain(rows: DataFrame, *columns: str) -> DataFrame:
    """Window times as seconds since midnight of 2024-01-01, whatever the session's zone."""
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rows.withColumns({c: (F.unix_micros(c) - F.unix_micros(origin)) / 1e6 for c in columns})


@query("stream_tumbling", "SELECT floor(epoch(ts - TIMESTAMP '2024-01-01') / 86400) * 86400.0 AS start, event_type, count(*) AS n, sum(value) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    return _plain(streams.tumbling(_events(t), "1 day", ["event_type"]), "start")


@query("stream_sliding", "SELECT s * 43200.0 AS start, event_type, avg(value) AS mean FROM (SELECT *, floor(epoch(ts - TIMESTAMP '2024-01-01') / 43200)::BIGINT AS k FROM events), range(0, 2) o(d), LATERAL (SELECT k - d AS s) GROUP BY 1, 2")
def stream_sliding(t: Tables) -> DataFrame:
    return _plain(streams.sliding_mean(_events(t), "1 day", "12 hours", ["event_type"]), "start")


@query("stream_sessions", """SELECT user_id, epoch(min(ts) - TIMESTAMP '2024-01-01') AS start, epoch(max(ts) - TIMESTAMP '2024-01-01') + 7200 AS "end", count(*) AS n, sum(value) AS total FROM (
    SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g""")
def stream_sessions(t: Tables) -> DataFrame:
    return _plain(streams.sessions(_events(t), "2 hours", ["user_id"]), "start", "end")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    return streams.dedupe(_events(t), ["user_id", "event_type"]).select("user_id", "event_type")


@query("stream_interval_join", "SELECT a.event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE")
def stream_interval_join(t: Tables) -> DataFrame:
    e = _events(t)
    return streams.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "30 MINUTES").select("event_id", "r_event_id")


def _path(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _live(t: Tables) -> DataFrame:
    """The table's files as a stream."""
    return streams.event_time(streams.read_table_stream(t.spark, t.sf_dir, "events")).select("event_id", "ts", "user_id", "event_type", "value")


def _in_batches(t: Tables, *parts: DataFrame) -> DataFrame:
    """A stream of files, one batch each, in this order."""
    path = _path(t, "live-source")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def _closing(rows: DataFrame, **values: object) -> DataFrame:
    """One row far later than all others: with it the watermark passes them."""
    last = rows.limit(1).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    return last.withColumns({k: F.lit(v).cast(dict(rows.dtypes)[k]) for k, v in values.items()})


def _ended(t: Tables) -> DataFrame:
    """The events in two batches, in order of time, and the row that ends them."""
    rows = _events(t)
    # Each batch finds the border again: it must not depend on the order in which partitions are merged, as an approximate median does.
    middle = rows.agg(F.expr("(min(unix_micros(ts)) + max(unix_micros(ts))) div 2").alias("_middle"))  # one row
    marked = rows.join(F.broadcast(middle)).withColumn("_late", F.unix_micros("ts") > F.col("_middle")).drop("_middle")
    return _in_batches(t, marked.where("NOT _late").drop("_late"), marked.where("_late").drop("_late"), _closing(rows))


@query("live_tumbling", ORACLES["stream_tumbling"])
def live_tumbling(t: Tables) -> DataFrame:
    """Windows come out as the watermark passes them; a last row far later closes all of them and its own stays open."""
    return _plain(streams.run_to_table(streams.tumbling(_ended(t), "1 day", ["event_type"]), _path(t, "live")), "start")


@query("live_sliding", ORACLES["stream_sliding"])
def live_sliding(t: Tables) -> DataFrame:
    return _plain(streams.run_to_table(streams.sliding_mean(_ended(t), "1 day", "12 hours", ["event_type"]), _path(t, "live")), "start")


@query("live_sessions", ORACLES["stream_sessions"])
def live_sessions(t: Tables) -> DataFrame:
    return _plain(streams.run_to_table(streams.sessions(_live(t), "2 hours", ["user_id"]), _path(t, "live"), "complete"), "start", "end")


@query("live_dedupe", ORACLES["stream_dedupe"])
def live_dedupe(t: Tables) -> DataFrame:
    """Keys within the watermark, which a delay longer than the table makes all of it."""
    return streams.run_to_table(streams.dedupe(_live(t), ["user_id", "event_type"], "3650 days"), _path(t, "live")).select("user_id", "event_type")


@query("live_interval_join", ORACLES["stream_interval_join"])
def live_interval_join(t: Tables) -> DataFrame:
    joined = streams.interval_join(_live(t).where("event_type = 'click'"), _live(t).where("event_type = 'purchase'"), ["user_id"], "30 MINUTES")
    return streams.run_to_table(joined, _path(t, "live")).select("event_id", "r_event_id")


@query("live_late_rows", """WITH b AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events WHERE event_id % 10 > 1)
    SELECT floor(epoch(ts - TIMESTAMP '2024-01-01') / 86400) * 86400.0 AS start, event_type, count(*) AS n, sum(value) AS total, max(value) AS most FROM events, b
    WHERE event_id % 10 > 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1, 2""")
def live_late_rows(t: Tables) -> DataFrame:
    """Rows of days that the watermark, two days behind the latest row of the first batch, closed in the second are dropped in the third."""
    rows = _events(t)
    source = _in_batches(t, rows.where("event_id % 10 > 1"), rows.where("event_id % 10 = 1"), rows.where("event_id % 10 = 0").unionByName(_closing(rows, event_type="end")))
    return _plain(streams.run_to_table(streams.tumbling(source, "1 day", ["event_type"], "2 days"), _path(t, "live")), "start")


@query("live_ingest", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def live_ingest(t: Tables) -> DataFrame:
    """Two runs of the ingest with one checkpoint: the second takes the files that came in between, and no file twice."""
    rows, source, target, checkpoint = _events(t), _path(t, "live-source"), _path(t, "live-target"), _path(t, "live-checkpoint")
    for k in (0, 1):
        rows.where(F.col("event_id") % 2 == k).write.mode("append").parquet(source)
        streams.ingest_new_files(t.spark.readStream.schema(rows.schema).parquet(source), target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("live_link_tracks", LINKED)
def live_link_tracks(t: Tables) -> DataFrame:
    """Tracks linked by state and timers as frames come in; equal to ``link_tracks`` on the table."""
    rows = _objects(t).select("video_id", "obj_id", "det_id", "t", "x", "y").withColumn("t", F.col("t") + 473352).withColumn("ts", F.timestamp_millis(F.col("t") * 3600000))
    path = _path(t, "live-source")
    rows.unionByName(_closing(rows, video_id=-1, t=1_139_568)).write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.run_to_table(streams.link_tracks_stream(stream, 3, 8.0, 3600000), _path(t, "live"))
    finally:
        t.spark.conf.set(key, before) if before else t.spark.conf.unset(key)
    return out.select("det_id", "track_id")
