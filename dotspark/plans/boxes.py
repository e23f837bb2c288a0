"""Queries of section B: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry, pixels, scores
from ..operators import filters
from .registry import HEIGHT, SIDE, WIDTH, Tables, query


def _size() -> tuple:
    return F.lit(WIDTH), F.lit(HEIGHT)


@query("to_center", "SELECT det_id, CASE WHEN lower(trim(xy_semantics)) = 'center' THEN x ELSE x + w / 2.0 END AS cx, CASE WHEN lower(trim(xy_semantics)) = 'center' THEN y ELSE y + h / 2.0 END AS cy FROM {det}")
def to_center(t: Tables) -> DataFrame:
    return filters.with_center(t.det).select("det_id", "cx", "cy")


@query("crop_box_clamped", """SELECT det_id, greatest(0, least(round_even(x - w / 2.0, 0)::INT, 64 - w)) AS bx, greatest(0, least(round_even(y - h / 2.0, 0)::INT, 48 - h)) AS byy, least(w, 64) AS bw, least(h, 48) AS bh
    FROM (SELECT det_id, x, y, w + CASE WHEN det_id % 10 = 0 THEN 60 ELSE 0 END AS w, h FROM {det})""")
def crop_box_clamped(t: Tables) -> DataFrame:
    box = geometry.crop_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), *_size())
    some_wide = F.expr("w + CASE WHEN det_id % 10 = 0 THEN 60 ELSE 0 END").alias("w")
    return filters.with_box(t.det.select("det_id", "x", "y", some_wide, "h"), box, "b").select("det_id", "bx", F.col("by").alias("byy"), "bw", "bh")


_CROP = """SELECT t, list_transform(range(0, 16), lambda i: {pixel}) AS crop FROM (SELECT t, pixels, (t % 11 - 3)::INT AS x0, (t % 13 - 4)::INT AS y0 FROM {frame})"""


@query("crop_pad", _CROP.replace("{pixel}", "CASE WHEN y0 + i // 4 BETWEEN 0 AND 7 AND x0 + i % 4 BETWEEN 0 AND 7 THEN pixels[(y0 + i // 4) * 8 + x0 + i % 4 + 1] ELSE 0 END"))
def crop_pad(t: Tables) -> DataFrame:
    crop = geometry.gather(F.col("pixels"), F.lit(SIDE), F.lit(SIDE), F.expr("cast(t % 11 - 3 AS int)"), F.expr("cast(t % 13 - 4 AS int)"), 4, 4, "pad")
    return t.frame.select("t", crop.alias("crop"))


@query("crop_wrap", _CROP.replace("{pixel}", "pixels[least(greatest(y0 + i // 4, 0), 7) * 8 + ((x0 + i % 4) % 8 + 8) % 8 + 1]"))
def crop_wrap(t: Tables) -> DataFrame:
    crop = geometry.gather(F.col("pixels"), F.lit(SIDE), F.lit(SIDE), F.expr("cast(t % 11 - 3 AS int)"), F.expr("cast(t % 13 - 4 AS int)"), 4, 4, "wrap")
    return t.frame.select("t", crop.alias("crop"))


@query("box_clamp", "SELECT det_id, greatest(0, least(trunc(x + 7)::INT, 64 - w)) AS x, greatest(0, least(trunc(y + 11)::INT, 48 - h)) AS y, w, h FROM (SELECT det_id, x, y, w, greatest(1, least(h * 6, 48)) AS h FROM {det})")
def box_clamp(t: Tables) -> DataFrame:
    return filters.with_box(t.det, geometry.clamp_box(F.col("x") + 7, F.col("y") + 11, F.col("w"), F.col("h") * 6, *_size())).select("det_id", "x", "y", "w", "h")


@query("box_clip", """SELECT * FROM (SELECT det_id, greatest(x - 4, 0) AS x, greatest(y - 3, 0) AS y, least(x - 4 + w, 50) - greatest(x - 4, 0) AS w, least(y - 3 + h, 30) - greatest(y - 3, 0) AS h FROM {det}) WHERE w > 0 AND h > 0""")
def box_clip(t: Tables) -> DataFrame:
    moved = t.det.select("det_id", (F.col("x") - 4).alias("x"), (F.col("y") - 3).alias("y"), "w", "h")
    return filters.clip_boxes(moved, F.lit(50), F.lit(30))


@query("area_filter", "SELECT det_id, w, h FROM {det} WHERE w * h >= 25")
def area_filter(t: Tables) -> DataFrame:
    return filters.area_filter(t.det, 25).select("det_id", "w", "h")


@query("area_gate", "SELECT det_id, w, h FROM {det} WHERE w * h BETWEEN 12 AND 64 * 48 * 0.015")
def area_gate(t: Tables) -> DataFrame:
    return filters.area_gate(t.det, 12, 0.015, *_size()).select("det_id", "w", "h")


@query("bright_gate", "SELECT t FROM {frame} WHERE list_max(pixels) >= 210")
def bright_gate(t: Tables) -> DataFrame:
    return t.frame.where(pixels.bright_enough(F.col("pixels"), 210)).select("t")


@query("gt_offset", "SELECT gt_id, t - 5 AS t FROM {gt} WHERE t - 5 >= 0 AND t - 5 < 300")
def gt_offset(t: Tables) -> DataFrame:
    return filters.shift_time(t.gt, 5, 300).select("gt_id", "t")


@query("positive_only", "SELECT det_id FROM {det} WHERE coalesce(lower(trim(class)), 'positive') = 'positive'")
def positive_only(t: Tables) -> DataFrame:
    return filters.positive_only(t.det).select("det_id")


@query("classify", "SELECT det_id, CASE WHEN confidence >= 0.5 THEN 'positive' ELSE 'negative' END AS class FROM {det}")
def classify(t: Tables) -> DataFrame:
    return filters.classify(t.det, 0.5).select("det_id", "class")


@query("annotation_valid", "SELECT event_id, x, y, w, h, t FROM (SELECT event_id, x, y, w, h, t - 20 AS t FROM {named}) WHERE w > 0 AND h > 0 AND t >= 0")
def annotation_valid(t: Tables) -> DataFrame:
    return filters.valid_annotations(t.named.select("event_id", "x", "y", "w", "h", (F.col("t") - 20).alias("t")))


@query("clamp_confidence", """SELECT event_id, least(greatest(try_cast(nullif(trim(c), '') AS DOUBLE), 0.0), 1.0) AS confidence FROM (
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN ' -0.5 ' ELSE ((event_id % 300) / 200.0)::VARCHAR END AS c FROM {named})""")
def clamp_confidence(t: Tables) -> DataFrame:
    text = F.expr("CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN ' -0.5 ' ELSE cast((event_id % 300) / 200.0D AS string) END")
    return t.named.select("event_id", scores.clamp_confidence(text).alias("confidence"))


_ENABLED = "SELECT * FROM (VALUES ('day', 'src0'), ('day', 'src3'), ('night', 'src4'), ('night', 'src7'), ('night', 'src99')) AS e(route, grp)"


def _enabled(t: Tables) -> DataFrame:
    return t.spark.sql(_ENABLED)


@query("enabled_groups", f"SELECT page_id, route, grp FROM {{video}} v WHERE EXISTS (SELECT 1 FROM ({_ENABLED}) e WHERE e.route = v.route AND e.grp = v.grp)")
def enabled_groups(t: Tables) -> DataFrame:
    return filters.enabled_groups(t.video, _enabled(t)).select("page_id", "route", "grp")


@query("missing_groups", f"SELECT route, grp FROM ({_ENABLED}) EXCEPT SELECT route, grp FROM {{video}}")
def missing_groups(t: Tables) -> DataFrame:
    return filters.missing_groups(t.video, _enabled(t)).select("route", "grp")


@query("draw_list", """SELECT video_id, t, x, y, x + w AS x1, y + h AS y1, 'gt' AS role, 'green' AS color FROM {gt}
    UNION ALL SELECT video_id, t, x, y, x + w, y + h, 'model', 'red' FROM {pred}""")
def draw_list(t: Tables) -> DataFrame:
    return filters.draw_list(t.gt, "gt", "green").unionByName(filters.draw_list(t.pred, "model", "red"))
