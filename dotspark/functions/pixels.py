"""Pixel-array expressions: row-major gray arrays of a fixed width and height, no Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def crop_weight(pixels: Column) -> Column:
    """Sum of all pixels (long)."""
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, p: a + p)


def brightest_pixel(pixels: Column, width: int) -> Column:
    """struct<px, py, value> of the first brightest pixel in row-major order."""
    at = F.array_position(pixels, F.array_max(pixels)).cast("int") - 1
    return F.struct((at % width).alias("px"), F.floor(at / width).cast("int").alias("py"), F.array_max(pixels).alias("value"))


def gaussian_weights(width: int, height: int, sigma: float) -> list[float]:
    """Weights around the patch's middle; sigma 0 or less weighs all alike."""
    if sigma <= 0:
        return [1.0] * (width * height)
    cx, cy = (width - 1) / 2, (height - 1) / 2
    return [math.exp(-((i % width - cx) ** 2 + (i // width - cy) ** 2) / (2 * sigma * sigma)) for i in range(width * height)]


def centroid(pixels: Column, width: int, height: int, sigma: float = 0.0, fallback: str = "half") -> Column:
    """struct<cx, cy>: intensity centroid under Gaussian weights.

    A patch without mass has the ``half`` point (width/2, height/2), the ``middle`` pixel
    ((width-1)/2, (height-1)/2), or the ``plain`` centroid without weights (then the middle).
    """
    where = F.sequence(F.lit(0), F.lit(width * height - 1))

    def moments(weights: list[float]) -> tuple[Column, Column, Column]:
        masses = F.zip_with(pixels, F.array(*[F.lit(w) for w in weights]), lambda p, w: p * w)
        total = F.aggregate(masses, F.lit(0.0), lambda a, m: a + m)
        x = F.aggregate(F.zip_with(masses, where, lambda m, i: m * (i % width)), F.lit(0.0), lambda a, m: a + m)
        y = F.aggregate(F.zip_with(masses, where, lambda m, i: m * F.floor(i / width)), F.lit(0.0), lambda a, m: a + m)
        return total, x, y

    total, x, y = moments(gaussian_weights(width, height, sigma))
    middle = {"half": (width / 2, height / 2), "middle": ((width - 1) / 2, (height - 1) / 2), "plain": ((width - 1) / 2, (height - 1) / 2)}[fallback]
    otherwise = [F.lit(m) for m in middle]
    if fallback == "plain":
        plain, px, py = moments([1.0] * (width * height))
        otherwise = [F.when(plain > 0, v / plain).otherwise(m) for v, m in ((px, otherwise[0]), (py, otherwise[1]))]
    return F.struct(F.when(total > 0, x / total).otherwise(otherwise[0]).alias("cx"), F.when(total > 0, y / total).otherwise(otherwise[1]).alias("cy"))


def bright_enough(pixels: Column, threshold: int) -> Column:
    """At least one pixel of ``threshold`` or more."""
    return F.coalesce(F.array_max(pixels) >= threshold, F.lit(False))
