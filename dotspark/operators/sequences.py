"""Gaps and islands over frame numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def free_ranges(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(video_id, t_start, t_end): maximal runs of frames of each video (``n_frames``) without a row."""
    used = rows.select("video_id", "t").distinct().join(spans, "video_id").where("t >= 0 AND t < n_frames").select("video_id", "t")
    marks = used.unionByName(spans.select("video_id", F.lit(-1).cast("long").alias("t"))).unionByName(spans.select("video_id", F.col("n_frames").cast("long").alias("t")))
    nxt = F.lead("t").over(W.partitionBy("video_id").orderBy("t"))
    return marks.select("video_id", (F.col("t") + 1).alias("t_start"), (nxt - 1).alias("t_end")).where("t_start <= t_end")
