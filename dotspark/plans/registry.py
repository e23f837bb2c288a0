"""Registration of queries with their DuckDB forms, and the tables that queries are bound to.

The driver's tables hold no video, so detections, ground truth, frames and the like are derived from them
by integer arithmetic that both engines compute alike. ``{det}`` and so on in an oracle's text stand for the
same derivations as subqueries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Frame size of the derived detections, and of the derived gray frames.
WIDTH, HEIGHT, SIDE = 64, 48, 8

DUCK = {
    "det": """(SELECT event_id AS det_id, user_id % 4 AS video_id, (floor(epoch(ts) / 3600) - 473352)::BIGINT AS t,
        ((event_id * 7919) % 60 + (event_id % 4) * 0.25)::DOUBLE AS x, ((event_id * 104729) % 40)::DOUBLE AS y,
        (3 + event_id % 9)::INT AS w, (2 + event_id % 7)::INT AS h, value AS weight, value / (value + 50) AS confidence,
        event_type, CASE event_id % 5 WHEN 0 THEN 'center' WHEN 1 THEN ' CENTER' WHEN 2 THEN 'top_left' WHEN 3 THEN '' END AS xy_semantics,
        CASE event_id % 6 WHEN 0 THEN ' Positive' WHEN 1 THEN 'negative' WHEN 2 THEN NULL WHEN 3 THEN 'background' ELSE 'positive' END AS class FROM events)""",
    "pred": "(SELECT * FROM {det} WHERE event_type IN ('click', 'view', 'purchase'))",
    "gt": """(SELECT det_id AS gt_id, video_id, t, round_even(x, 0) + det_id % 7 - 3 AS x, round_even(y, 0) + det_id % 5 - 2 AS y, w, h, weight
        FROM {det} WHERE event_type IN ('click', 'view', 'error'))""",
    "frame": """(SELECT label AS video_id, vec_id AS t, list_transform(embedding, lambda e: least(255, greatest(0, round_even((e::DOUBLE + 0.55) * 232, 0)))::INT) AS pixels FROM embeddings)""",
    "named": """(SELECT event_id, 'clip' || (event_id % 7) || '_b' || (event_id % 3) AS video, CASE event_id % 4 WHEN 0 THEN 'Alpha Day' WHEN 1 THEN 'beta-Night' WHEN 2 THEN 'Gamma' ELSE 'today tonight' END AS grp_text,
        event_id % 60 AS x, event_id % 40 AS y, event_id % 9 AS w, event_id % 7 AS h, event_id % 720 AS t, value FROM events)""",
    "video": """(SELECT page_id, url, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') AS path, 'src' || (page_id % 23) AS grp, CASE WHEN page_id % 3 = 0 THEN 'day' ELSE 'night' END AS route,
        CASE WHEN page_id % 5 < 3 THEN 'training' ELSE 'inference' END AS category FROM pages)""",
}


def duck(text: str) -> str:
    """An oracle's text with the derived tables put in."""
    for _ in range(3):
        for name, sql in DUCK.items():
            text = text.replace("{" + name + "}", sql)
    return text


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` as query ``name``."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn

    return register


class Tables:
    """The driver's tables by name, and those derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def det(self) -> DataFrame:
        hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        semantics = F.expr("CASE event_id % 5 WHEN 0 THEN 'center' WHEN 1 THEN ' CENTER' WHEN 2 THEN 'top_left' WHEN 3 THEN '' END")
        kind = F.expr("CASE event_id % 6 WHEN 0 THEN ' Positive' WHEN 1 THEN 'negative' WHEN 2 THEN NULL WHEN 3 THEN 'background' ELSE 'positive' END")
        return self.read("events").select(
            F.col("event_id").alias("det_id"), (F.col("user_id") % 4).alias("video_id"), (hours - 473352).cast("long").alias("t"),
            F.expr("cast((event_id * 7919) % 60 + (event_id % 4) * 0.25D AS double)").alias("x"), F.expr("cast((event_id * 104729) % 40 AS double)").alias("y"),
            F.expr("cast(3 + event_id % 9 AS int)").alias("w"), F.expr("cast(2 + event_id % 7 AS int)").alias("h"), F.col("value").alias("weight"),
            F.expr("value / (value + 50)").alias("confidence"), "event_type", semantics.alias("xy_semantics"), kind.alias("class"),
        )

    @property
    def pred(self) -> DataFrame:
        return self.det.where("event_type IN ('click', 'view', 'purchase')")

    @property
    def gt(self) -> DataFrame:
        return self.det.where("event_type IN ('click', 'view', 'error')").select(F.col("det_id").alias("gt_id"), "video_id", "t", F.expr("bround(x) + det_id % 7 - 3").alias("x"), F.expr("bround(y) + det_id % 5 - 2").alias("y"), "w", "h", "weight")

    @property
    def frame(self) -> DataFrame:
        """8 by 8 gray frames: one per embedding, its label the video."""
        pixel = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.bround((e.cast("double") + 0.55) * 232))).cast("int")
        return self.read("embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("t"), F.transform("embedding", pixel).alias("pixels"))

    @property
    def named(self) -> DataFrame:
        grp = F.expr("CASE event_id % 4 WHEN 0 THEN 'Alpha Day' WHEN 1 THEN 'beta-Night' WHEN 2 THEN 'Gamma' ELSE 'today tonight' END")
        return self.read("events").select("event_id", F.expr("concat('clip', event_id % 7, '_b', event_id % 3)").alias("video"), grp.alias("grp_text"), *(F.expr(f"event_id % {n}").alias(k) for k, n in (("x", 60), ("y", 40), ("w", 9), ("h", 7), ("t", 720))), "value")

    @property
    def video(self) -> DataFrame:
        path = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/+$", "")
        return self.read("pages").select("page_id", "url", path.alias("path"), F.expr("concat('src', page_id % 23)").alias("grp"), F.expr("CASE WHEN page_id % 3 = 0 THEN 'day' ELSE 'night' END").alias("route"), F.expr("CASE WHEN page_id % 5 < 3 THEN 'training' ELSE 'inference' END").alias("category"))
