"""Detectors and scorers over decoded frames, pluggable by name.

A detector is a function of frames (video_id, t, pixels) that returns boxes (video_id, t, x, y, w, h, cx, cy,
confidence). What looks at one frame runs in ``mapInPandas``; what carries a background takes it from the
stacking operators.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..sources.scratch import materialise as written
from . import regions, stacking
from .dedupe import proximity_merge

BOX = "video_id int, t long, x int, y int, w int, h int, cx double, cy double, confidence double"
_NAMES = [f.split()[0] for f in BOX.split(", ")]

DETECTORS: dict[str, Callable[..., DataFrame]] = {}


def detector(name: str) -> Callable:
    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        DETECTORS[name] = fn
        return fn

    return register


def detect(frames: DataFrame, name: str, **options: object) -> DataFrame:
    """Run a detector by name; options that it does not take are left out."""
    fn = DETECTORS[name]
    known = inspect.signature(fn).parameters
    return fn(frames, **{k: v for k, v in options.items() if k in known})


def otsu(values: np.ndarray) -> int:
    """The gray value that splits the histogram with the greatest variance between both sides."""
    histogram = np.bincount(values.ravel(), minlength=256)[:256].astype(float)
    below = np.cumsum(histogram)
    moment = np.cumsum(histogram * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (moment / below - (moment[-1] - moment) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def _boxes(frames: DataFrame, width: int, find: Callable[[np.ndarray], list[tuple]], column: str = "pixels") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(video, t, *box) for video, t, flat in zip(batch["video_id"], batch["t"], batch[column], strict=True) for box in find(np.asarray(flat).reshape(-1, width))]
            yield pd.DataFrame(rows, columns=_NAMES)

    return frames.select("video_id", "t", column).mapInPandas(run, BOX)


@detector("threshold")
def threshold(frames: DataFrame, width: int, level: int | None = None, min_area: int = 1, max_scale: float = 0.0) -> DataFrame:
    """Regions above a fixed level (Otsu's if none is given) whose box area lies between the gates; confidence max / 255."""

    def find(pixels: np.ndarray) -> list[tuple]:
        cut = otsu(pixels) if level is None else level
        most = pixels.size * (max_scale if max_scale > 0 else 1.0)
        found = regions.regions(pixels, pixels > cut)
        return [(x, y, w, h, cx, cy, float(pixels[y : y + h, x : x + w].max()) / 255) for _, _, x, y, w, h, cx, cy, _ in found if min_area <= w * h <= most]

    return _boxes(frames, width, find)


def _blur(pixels: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, edges mirrored."""
    reach = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(pixels, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        pixels = sum(k * np.take(padded, range(i, i + pixels.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return pixels


@detector("log")
def blobs(frames: DataFrame, width: int, sigmas: tuple[float, ...] = (1.0, 1.6), relative: float = 0.5) -> DataFrame:
    """Scale-space Laplacian of Gaussian: 3 by 3 maxima above a share of each scale's maximum; box from the radius."""

    def find(pixels: np.ndarray) -> list[tuple]:
        height, out = pixels.shape[0], []
        for sigma in sigmas:
            smooth = _blur(pixels.astype(float), sigma)
            padded = np.pad(smooth, 1, mode="edge")
            response = -(padded[2:, 1:-1] + padded[:-2, 1:-1] + padded[1:-1, 2:] + padded[1:-1, :-2] - 4 * smooth) * sigma**2
            ring = np.pad(response, 1, constant_values=-np.inf)
            around = np.max([ring[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
            top = response.max()
            ys, xs = np.nonzero((response == around) & (response >= relative * top) & (response > 0))
            radius = int(np.ceil(sigma * 2**0.5))
            for y, x in zip(ys, xs, strict=True):
                x0, y0, x1, y1 = max(0, x - radius), max(0, y - radius), min(width, x + radius + 1), min(height, y + radius + 1)
                out.append((int(x0), int(y0), int(x1 - x0), int(y1 - y0), float(x), float(y), float(response[y, x] / top)))
        return out

    return _boxes(frames, width, find)


@detector("rolling")
def rolling(frames: DataFrame, width: int, window: int = 5, level: int = 40, min_area: int = 1) -> DataFrame:
    """Regions of frame minus rolling mean (the frame included); the first ``window`` frames warm up and give nothing."""
    return threshold(_above(stacking.rolling_background(frames, window, warm=window)), width, level, min_area)


def _above(folded: DataFrame) -> DataFrame:
    """Whole frames of what tiles lie above their background, in whole values."""
    diff = F.zip_with("pixels", "background", lambda p, b: F.greatest(F.lit(0), F.floor(p - b)).cast("int")).alias("pixels")
    return stacking.glue(folded.select("video_id", "t", "tile", diff), ["video_id", "t"], "pixels")


@detector("ewma")
def ewma(frames: DataFrame, width: int, alpha: float = 0.2, level: int = 40, min_area: int = 1) -> DataFrame:
    """Regions of frame minus the exponentially weighted mean of the frames before it."""
    return threshold(_above(stacking.ewma_background(frames, alpha)), width, level, min_area)


def in_batches(score: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A scorer out of a function of many patches, (n, pixels) to n scores, that is called once for each size in a batch."""

    @F.pandas_udf(DoubleType())
    def run(patches: pd.Series) -> pd.Series:
        out = np.full(len(patches), np.nan)
        sizes = np.array([-1 if p is None else len(p) for p in patches])
        for size in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == size)
            out[at] = score(np.stack(patches.iloc[at].to_list()).astype(float).reshape(len(at), size))
        return pd.Series(out)

    return run


def score_patches(rows: DataFrame, scorer: Callable[[Column], Column] | None, column: str = "pixels") -> DataFrame:
    """Adds ``score`` by a function of the patch's column; null without a function or a patch, and where it gives NaN."""
    if scorer is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    return rows.withColumn("score", F.when(F.col(column).isNotNull(), F.nanvl(scorer(F.col(column)).cast("double"), F.lit(None).cast("double"))))


def mask_boxes(frames: DataFrame, boxes: DataFrame, width: int) -> DataFrame:
    """Frames with the boxes' pixels set to 0; frames without a box stay."""
    held = boxes.groupBy("video_id", "t").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("_boxes"))
    joined = frames.join(held, ["video_id", "t"], "left")
    inside = lambda i: F.exists("_boxes", lambda b: (i % width >= b["x"]) & (i % width < b["x"] + b["w"]) & (F.floor(i / width) >= b["y"]) & (F.floor(i / width) < b["y"] + b["h"]))
    return joined.withColumn("pixels", F.when(F.col("_boxes").isNull(), F.col("pixels")).otherwise(F.transform("pixels", lambda p, i: F.when(inside(i), 0).otherwise(p)))).drop("_boxes")


def redetect(frames: DataFrame, boxes: DataFrame, width: int, rounds: int, radius: float, name: str, materialise: Callable[[DataFrame, str], DataFrame], **options: object) -> DataFrame:
    """Rounds of: black out what is known, detect again, keep what is far enough from it. Each round is written out."""
    known = boxes.withColumn("round", F.lit(0))
    for n in range(1, rounds + 1):
        found = detect(mask_boxes(frames, known, width), name, width=width, **options)
        order = F.xxhash64("video_id", "t", "x", "y", "w", "h")
        as_points = lambda df: df.select("video_id", "t", order.alias("det_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
        kept = proximity_merge(as_points(known), as_points(found), radius).select("video_id", "t", "det_id")
        fresh = found.withColumn("det_id", order).join(kept, ["video_id", "t", "det_id"], "left_semi").drop("det_id").withColumn("round", F.lit(n))
        known = materialise(known.unionByName(fresh), f"redetect-{n}")
    return known


def patch_model(rows: DataFrame, label: str, weights: DataFrame, epochs: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """(epoch, split, n, accuracy, chosen): logistic regression on pixel vectors with class weights.

    ``rows`` have ``features``, the label and ``split`` (train, val, test). One model per number of epochs;
    the best by validation accuracy is chosen.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    ready = rows.join(F.broadcast(weights.select(label, "weight")), label).withColumn("_f", array_to_vector(F.transform("features", lambda p: p.cast("double") / 255.0)))
    train = ready.where("split = 'train'")
    out = None
    for n in epochs:
        model = LogisticRegression(featuresCol="_f", labelCol=label, weightCol="weight", maxIter=n, predictionCol="_p").fit(train)
        result = model.transform(ready).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") == F.col(label)).cast("double")).alias("accuracy")).withColumn("epoch", F.lit(n))
        out = result if out is None else out.unionByName(result)
    out = written(out, "patch-model")  # a row a model and split: the models score all rows once
    best = out.where("split = 'val'").agg(F.max_by("epoch", F.struct("accuracy", -F.col("epoch"))).alias("_best"))
    return out.crossJoin(F.broadcast(best)).select("epoch", "split", "n", F.round("accuracy", 4).alias("accuracy"), (F.col("epoch") == F.col("_best")).alias("chosen"))
