"""Connected pixel regions: vectorised labelling inside ``mapInPandas`` over (row, pixels)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType


#: Pixels that are labelled at once.
CELLS = 1 << 21


def spread_labels(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Each pixel of the masks (the last two axes) with the smallest place, from 1, in its region; height * width + 1 outside.

    Minimum labels spread along rows and columns until nothing changes; all pixels of all masks at once.
    """
    height, width = mask.shape[-2:]
    far = height * width + 1
    labels = np.where(mask, np.arange(1, height * width + 1).reshape(height, width), far)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    while True:
        before = labels.copy()
        for dy, dx in steps:
            a = (..., slice(0, height - dy), slice(max(0, -dx), width - max(0, dx)))
            b = (..., slice(dy, height), slice(max(0, dx), width + min(0, dx)))
            both = mask[a] & mask[b]
            least = np.minimum(labels[a], labels[b])
            labels[a] = np.where(both, least, labels[a])
            labels[b] = np.where(both, np.minimum(labels[b], least), labels[b])
        if (labels == before).all():
            return labels


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (behind the last) of each run of set pixels along the rows, in row-major order."""
    edge = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    edge[:, 1:-1] = mask
    step = np.diff(edge, axis=1)
    rows, starts = np.nonzero(step == 1)
    return rows, starts, np.nonzero(step == -1)[1]


def label_mask(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Labels (from 1, in row-major order of first pixels) of a mask's regions; 0 outside.

    Regions are components of runs: a run touches those of the row above that overlap it, which are neighbours in
    order. Smallest places spread over these links by pointer jumping, so rounds grow with the logarithm.
    """
    rows, starts, ends = _runs(mask)
    out = np.zeros(mask.shape, np.int64)
    n = len(rows)
    if not n:
        return out
    reach = 1 if connectivity == 8 else 0
    width = mask.shape[1] + 2
    # Runs of the row above that end behind this one's start and begin before its end (one pixel more across corners).
    above = (rows - 1) * width
    first = np.searchsorted(rows * width + ends, above + starts - reach, side="right")
    last = np.searchsorted(rows * width + starts, above + ends + reach, side="left")
    touching = np.maximum(last - first, 0)
    touching[rows == 0] = 0
    a = np.repeat(np.arange(n), touching)
    b = np.repeat(first - np.concatenate([[0], np.cumsum(touching)[:-1]]), touching) + np.arange(touching.sum())
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not (new == new[new]).all():
            new = new[new]
        if (new == root).all():
            break
        root = new
    names = np.unique(root, return_inverse=True)[1] + 1
    flat, width = out.ravel(), mask.shape[1]
    sizes = ends - starts
    at = np.repeat(rows * width + starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    flat[at] = np.repeat(names, sizes)
    return out


def largest_regions(masks: np.ndarray) -> np.ndarray:
    """Pixels of the largest 8-connected region of each mask (n, height, width); 0 without one."""
    cells = masks.shape[1] * masks.shape[2] + 2
    labels = np.where(masks, spread_labels(masks), 0) + (np.arange(len(masks)) * cells)[:, None, None]
    return np.bincount(labels.ravel(), minlength=len(masks) * cells).reshape(-1, cells)[:, 1:].max(axis=1, initial=0)


def boxes(labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Area, x, y, w, h of each label from 1 on; and the rows, columns and labels (from 0) of all pixels."""
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs] - 1
    n = int(labels.max(initial=0))
    low, high = np.full((2, n), 1 << 30), np.full((2, n), -1)
    for k, places in enumerate((xs, ys)):
        np.minimum.at(low[k], of, places)
        np.maximum.at(high[k], of, places)
    return np.bincount(of, minlength=n), low[0], low[1], high[0] - low[0] + 1, high[1] - low[1] + 1, ys, xs, of


def regions(pixels: np.ndarray, mask: np.ndarray, connectivity: int = 8) -> list[tuple]:
    """(label, area, x, y, w, h, cx, cy, mass) of each region; the centroid weighs pixels by intensity."""
    area, x, y, w, h, ys, xs, of = boxes(label_mask(mask, connectivity))
    v = pixels[ys, xs].astype(float)
    total = lambda weights: np.bincount(of, weights, minlength=len(area))
    mass = total(v)
    lit = mass > 0
    cx, cy = (np.where(lit, total(c * v) / np.where(lit, mass, 1), total(c) / np.maximum(area, 1)) for c in (xs, ys))
    return list(zip(range(1, len(area) + 1), *(c.tolist() for c in (area, x, y, w, h, cx, cy, mass)), strict=True))


REGION = "video_id int, t long, label int, area int, x int, y int, w int, h int, cx double, cy double, mass double"


def mask_components(frames: DataFrame, width: int, threshold: int, connectivity: int = 8, strict: bool = True) -> DataFrame:
    """Regions of pixels above ``threshold`` (at or above it unless ``strict``), one row each."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, t, flat in zip(batch["video_id"], batch["t"], batch["pixels"], strict=True):
                pixels = np.asarray(flat).reshape(-1, width)
                rows += [(video, t, *r) for r in regions(pixels, pixels > threshold if strict else pixels >= threshold, connectivity)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in REGION.split(", ")])

    return frames.select("video_id", "t", "pixels").mapInPandas(find, REGION)


def largest_in(column: str, width: int, floor: int) -> Column:
    """Pixels of the largest 8-connected region strictly above ``floor`` in a gray array; 0 without one."""

    @F.pandas_udf(IntegerType())
    def find(arrays: pd.Series) -> pd.Series:
        sizes, out = arrays.map(len).to_numpy(), np.zeros(len(arrays), np.int64)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            most = max(1, CELLS // max(1, size))
            for at in range(0, len(which), most):
                part = which[at : at + most]
                out[part] = largest_regions(np.stack(arrays.iloc[part].to_list()).reshape(len(part), -1, width) > floor)
        return pd.Series(out)

    return find(F.col(column))


def largest_area(frames: DataFrame, width: int, floor: int) -> DataFrame:
    """(video_id, t, ``max_area``) of each frame, see ``largest_in``."""
    return frames.select("video_id", "t", largest_in("pixels", width, floor).alias("max_area"))


def grow_region(seeds: DataFrame, frames: DataFrame, width: int, threshold: int, keep: list[str] | None = None) -> DataFrame:
    """(video_id, t, columns of ``keep``, area, x, y, w, h) of the region of pixels >= ``threshold`` around each row's seed (sx, sy); area 0 if the seed is darker.

    A frame's seeds come to it as a list, and its pixels are labelled once for all of them.
    """
    keep = keep or []
    kinds = {f.name: f.dataType.simpleString() for f in seeds.schema}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, t, flat, points in batch[["video_id", "t", "pixels", "_points"]].itertuples(index=False):
                labels = label_mask(np.asarray(flat).reshape(-1, width) >= threshold)
                area, *box = boxes(labels)[:5]
                for p in points:
                    k = labels[p["sy"], p["sx"]] - 1
                    out.append((video, t, *(p[c] for c in keep), *((int(area[k]), *(int(c[k]) for c in box)) if k >= 0 else (0, None, None, None, None))))
            frame = pd.DataFrame(out, columns=["video_id", "t", *keep, "area", "x", "y", "w", "h"])
            yield frame.astype({c: "Int32" for c in "xywh"})

    shape = ", ".join(f"{c} {kinds[c]}" for c in ["video_id", "t", *keep])
    return points_of_frames(seeds, frames, [*keep, "sx", "sy"]).mapInPandas(find, shape + ", area int, x int, y int, w int, h int")


#: Points of a frame that meet its pixels together.
TOGETHER = 4096


def points_of_frames(rows: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """(video_id, t, pixels, ``_points``): each frame with the list of its rows' ``columns``.

    A frame's pixels are sent once and not once for each of its rows; a frame with very many rows is met by lists
    of ``TOGETHER``. Rows beyond the video vanish.
    """
    keys = ["video_id", "t"]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*columns[:1]))
    listed = rows.withColumn("_list", F.floor((place - 1) / TOGETHER)).groupBy(*keys, "_list").agg(F.collect_list(F.struct(*columns)).alias("_points"))
    return listed.join(frames.select(*keys, "pixels"), keys).select(*keys, "pixels", "_points")
