"""Box and point arithmetic as column expressions.

Boxes are (x, y, w, h) with x, y the top-left corner unless ``xy_semantics`` says ``center``. Rounding is
half-even throughout (``bround``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column


def is_center(semantics: Column) -> Column:
    return F.coalesce(F.lower(F.trim(semantics)) == "center", F.lit(False))


def to_center(x: Column, size: Column, semantics: Column) -> Column:
    """The center coordinate of a box along one axis."""
    return F.when(is_center(semantics), x.cast("double")).otherwise(x + size / 2.0)


def crop_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Box of (w, h) around a center, its size rounded and its corner too, moved inside the frame.

    The size stays (at least 1 by 1, at most the frame): a box at the edge is shifted, not shrunk.
    """
    w, h = (F.greatest(F.bround(n.cast("double")).cast("int"), F.lit(1)) for n in (w, h))
    x0 = F.greatest(F.lit(0), F.least(F.bround(cx - w / 2.0).cast("int"), width - w))
    y0 = F.greatest(F.lit(0), F.least(F.bround(cy - h / 2.0).cast("int"), height - h))
    return Box(x0, y0, F.least(w, width), F.least(h, height))


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Whole numbers (fractions are cut), a size of 1 up to the frame's, and the box moved inside the frame."""
    w, h = (F.greatest(F.lit(1), F.least(n.cast("int"), most)) for n, most in ((w, width), (h, height)))
    return Box(F.greatest(F.lit(0), F.least(x.cast("int"), width - w)), F.greatest(F.lit(0), F.least(y.cast("int"), height - h)), w, h)


def clip_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Shrink the box to its part inside the frame; w or h of 0 or less where nothing is left."""
    x0, y0 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    return Box(x0, y0, F.least(x + w, width) - x0, F.least(y + h, height) - y0)


def min_square(cx: Column, cy: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<side, x0, y0>: the smallest square centered on (cx, cy) that covers the box's pixels, and its corner."""
    reach = F.greatest(F.abs(cx - x), F.abs(x + w - 1 - cx), F.abs(cy - y), F.abs(y + h - 1 - cy))
    side = F.ceil(2 * reach + 1).cast("int")
    return F.struct(side.alias("side"), F.bround(cx - side / 2.0).cast("int").alias("x0"), F.bround(cy - side / 2.0).cast("int").alias("y0"))


def box_to_norm(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """``cx cy w h`` as fractions of the frame with ten decimals, clipped; null where nothing is left or a value is null."""
    box = clip_box(x, y, w, h, width, height)
    values = [(box.x + box.w / 2.0) / width, (box.y + box.h / 2.0) / height, box.w / width, box.h / height]
    return F.when((x + y + w + h).isNotNull() & (box.w > 0) & (box.h > 0), F.format_string("%.10f %.10f %.10f %.10f", *[v.cast("double") for v in values]))


def gather(pixels: Column, width: Column, height: Column, x0: Column, y0: Column, w: int, h: int, mode: str) -> Column:
    """A w by h crop of a row-major pixel array from (x0, y0) on.

    ``pad``: zeros outside the frame. ``wrap``: columns wrap around, rows are clamped.
    """

    def pixel(i: Column) -> Column:
        row, col = y0 + F.floor(i / w).cast("int"), x0 + i % w
        if mode == "wrap":
            row = F.least(F.greatest(row, F.lit(0)), height - 1)
            return F.get(pixels, (row * width + F.pmod(col, width)).cast("int"))
        inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
        return F.when(inside, F.get(pixels, (row * width + col).cast("int"))).otherwise(F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), pixel)
