"""Row filters and row-wise projections over detection and annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry


def with_center(rows: DataFrame) -> DataFrame:
    """Adds ``cx``, ``cy`` from x, y, w, h and ``xy_semantics``."""
    return rows.withColumn("cx", geometry.to_center(F.col("x"), F.col("w"), F.col("xy_semantics"))).withColumn("cy", geometry.to_center(F.col("y"), F.col("h"), F.col("xy_semantics")))


def with_box(rows: DataFrame, box: geometry.Box, prefix: str = "") -> DataFrame:
    return rows.withColumns({f"{prefix}{k}": v for k, v in box._asdict().items()})


def area_filter(rows: DataFrame, least: float) -> DataFrame:
    return rows.where(F.col("w") * F.col("h") >= least)


def area_gate(rows: DataFrame, least: float, scale: float, width: Column, height: Column) -> DataFrame:
    """Areas from ``least`` to ``scale`` of the frame's area; a scale of 0 or less means the whole frame."""
    most = width * height * (scale if scale > 0 else 1.0)
    return rows.where((F.col("w") * F.col("h")).between(F.lit(least), most))


def clip_boxes(rows: DataFrame, width: Column, height: Column) -> DataFrame:
    box = geometry.clip_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
    return with_box(rows.select("*", *(v.alias(f"_{k}") for k, v in box._asdict().items())).where("_w > 0 AND _h > 0"), geometry.Box(*(F.col(f"_{k}") for k in "xywh"))).drop("_x", "_y", "_w", "_h")


def shift_time(rows: DataFrame, offset: int, max_frames: int | None = None) -> DataFrame:
    """``t`` - offset, rows before frame 0 and from ``max_frames`` on dropped."""
    moved = rows.withColumn("t", F.col("t") - offset).where("t >= 0")
    return moved if max_frames is None else moved.where(F.col("t") < max_frames)


def positive_only(rows: DataFrame, class_col: str = "class") -> DataFrame:
    """Rows of the positive class; all rows if there is no class column, and those without a class."""
    if class_col not in rows.columns:
        return rows
    return rows.where(F.coalesce(F.lower(F.trim(F.col(class_col))), F.lit("positive")) == "positive")


def classify(rows: DataFrame, threshold: float, drop_negatives: bool = False) -> DataFrame:
    out = rows.withColumn("class", F.when(F.col("confidence") >= threshold, "positive").otherwise("negative"))
    return out.where("class = 'positive'") if drop_negatives else out


def valid_annotations(rows: DataFrame) -> DataFrame:
    return rows.where("w > 0 AND h > 0 AND t >= 0")


def draw_list(rows: DataFrame, role: str, color: str) -> DataFrame:
    """Corners of the boxes to draw, with role and color."""
    return rows.select("video_id", "t", "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), F.lit(role).alias("role"), F.lit(color).alias("color"))


def enabled_groups(rows: DataFrame, enabled: DataFrame) -> DataFrame:
    """Rows whose (route, group slug) is enabled."""
    return rows.join(enabled, ["route", "grp"], "left_semi")


def missing_groups(rows: DataFrame, enabled: DataFrame) -> DataFrame:
    """Enabled (route, group) pairs without a row."""
    return enabled.join(rows, ["route", "grp"], "left_anti")
