"""Component dedupe and proximity merges of detections.

Tables have ``video_id``, ``t``, an id, ``x``, ``y`` and a weight. Everything is local to a frame, so the
Python steps see one frame at a time, of components its places alone.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .matching import KEYS, by_frame, distance_pairs


#: Points of a cell that are tried against a neighbouring cell's before all of them are.
TRIED = 8


def _linked(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """A number for each point, equal where chains of steps of at most ``radius`` lead from one point to the other.

    Points of one cell are near each other, as its diagonal is the radius; of two cells it is enough to find one near pair. A few
    points of each are tried first, the others only where that left the cells apart.
    """
    width = radius / np.sqrt(2) * (1 - 1e-6)
    kx, ky = (np.floor((v - v.min()) / width).astype(np.int64) + 3 for v in (x, y))
    span = int(ky.max()) + 6
    cells, of = np.unique(kx * span + ky, return_inverse=True)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of)
    start = np.cumsum(size) - size
    parent = list(range(len(cells)))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]) <= radius * radius

    left, right = [], []
    for step in (dx * span + dy for dx in range(3) for dy in range(-2, 3) if dx or dy > 0):
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        hit = np.flatnonzero(cells[at] == cells + step)
        left.append(hit)
        right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    for k in range(TRIED):
        for m in range(TRIED):
            some = np.flatnonzero((size[a] > k) & (size[b] > m))
            for p in some[near(order[start[a[some]] + k], order[start[b[some]] + m])].tolist():
                parent[find(int(a[p]))] = find(int(b[p]))
    for p in np.flatnonzero((size[a] > TRIED) | (size[b] > TRIED)).tolist():
        c, d = int(a[p]), int(b[p])
        if find(c) != find(d):
            others = order[start[d] : start[d] + size[d]]
            for i in range(start[c], start[c] + size[c]):
                if near(order[i], others).any():
                    parent[find(c)] = find(d)
                    break
    return np.array([find(v) for v in range(len(cells))])[of]


def _roots(places: pd.DataFrame, radius: float) -> pd.DataFrame:
    """A frame's places (x, y and the smallest ``_id`` there) with the smallest id of their component."""
    x, y = places["x"].to_numpy(float), places["y"].to_numpy(float)
    wide = max(np.ptp(x), np.ptp(y))
    if radius > 0 and wide / radius < 1 << 29:
        number = _linked(x, y, radius)
    elif radius > 0:  # too wide for cells of that size: places so far apart are few
        number = np.arange(len(x))
        for i in range(len(x)):
            close = (x - x[i]) * (x - x[i]) + (y - y[i]) * (y - y[i]) <= radius * radius
            number[np.isin(number, number[close])] = number[close].min()
    else:
        number = np.arange(len(x))
    return places[[*KEYS, "x", "y"]].assign(component=places["_id"].groupby(number).transform("min").to_numpy())


def components(rows: DataFrame, radius: float) -> DataFrame:
    """``rows`` with ``component``: the smallest id that chains of neighbours in the frame reach.

    Rows of one place belong together, so that only a frame's places are linked, and they without listing their pairs.
    """
    known = [F.col(k).isNotNull() for k in KEYS] + [F.abs(F.col(c).cast("double")) < float("inf") for c in "xy"]
    places = rows.where(functools.reduce(operator.and_, known)).groupBy(*KEYS, "x", "y").agg(F.min("det_id").alias("_id"))
    kinds = {f.name: f.dataType.simpleString() for f in places.schema}
    shape = ", ".join(f"{c} {kinds[c]}" for c in (*KEYS, "x", "y")) + f", component {kinds['_id']}"
    found = by_frame(places, functools.partial(_roots, radius=radius), shape)
    return rows.join(found, [*KEYS, "x", "y"], "left").select(*rows.columns, F.coalesce("component", "det_id").alias("component"))


def keep_heaviest(rows: DataFrame, radius: float) -> DataFrame:
    """The heaviest row of each component, the smallest id of equals; all columns stay."""
    order = W.partitionBy(*KEYS, "component").orderBy(F.desc("weight"), "det_id")
    return components(rows, radius).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "component")


def replace_regions(originals: DataFrame, candidates: DataFrame, radius: float) -> DataFrame:
    """Large-region repair: a component that holds candidates keeps its heaviest candidate alone, others stay whole."""
    both = originals.withColumn("kind", F.lit("original")).unionByName(candidates.withColumn("kind", F.lit("candidate")))
    grouped = components(both, radius)
    group = W.partitionBy(*KEYS, "component")
    is_candidate = F.when(F.col("kind") == "candidate", 1).otherwise(0)
    marked = grouped.withColumn("_any", F.max(is_candidate).over(group)).withColumn("_n", F.row_number().over(group.orderBy(F.desc(is_candidate), F.desc("weight"), "det_id")))
    return marked.where("_any = 0 OR _n = 1").drop("_any", "_n", "component")


def _spread(rows: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Walk a frame's rows by id and return those that are near a kept one. Kept ones are apart: a cell holds few of them."""
    kept, near = {}, []
    width = radius or 1.0
    for v, x, y in sorted(rows[["det_id", "x", "y"]].itertuples(index=False, name=None)):
        if not (math.isfinite(x) and math.isfinite(y)):
            continue
        cx, cy = math.floor(x / width), math.floor(y / width)
        around = (p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in kept.get((cx + dx, cy + dy), ()))
        if any((x - a) * (x - a) + (y - b) * (y - b) <= radius * radius for a, b in around):
            near.append(v)
        else:
            kept.setdefault((cx, cy), []).append((x, y))
    return pd.DataFrame({"video_id": [rows["video_id"].iloc[0]] * len(near), "t": [rows["t"].iloc[0]] * len(near), "det_id": near})


def proximity_merge(base: DataFrame, new: DataFrame, radius: float) -> DataFrame:
    """Rows of ``new`` farther than ``radius`` from every base row and from every earlier kept new row, by id."""
    # Places are met by places: rows of one place have the same neighbours.
    place = F.struct("x", "y")
    places = lambda rows, name: rows.select(*KEYS, "x", "y").distinct().withColumn(name, place)
    taken = distance_pairs(places(new, "_at"), places(base, "_base"), radius, "_at", "_base").select(*KEYS, "_at.x", "_at.y").distinct()
    free = new.join(taken, [*KEYS, "x", "y"], "left_anti")
    crowded = by_frame(free.where("video_id IS NOT NULL AND t IS NOT NULL").select(*KEYS, "det_id", "x", "y"), functools.partial(_spread, radius=radius), "video_id long, t long, det_id long")
    return free.join(crowded, [*KEYS, "det_id"], "left_anti")


def merge_corrections(rows: DataFrame, radius: float, exact: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merge annotation sources: exact copies go to the first source by ``source_rank``, then components keep the heaviest.

    Returns the kept rows, and per source how many were removed by either step.
    """
    first = W.partitionBy(*KEYS, *exact).orderBy("source_rank", "det_id")
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kept = keep_heaviest(once, radius)
    count = lambda df, name: df.groupBy("source_rank").agg(F.count(F.lit(1)).alias(name))
    report = count(rows, "n_rows").join(count(once, "n_once"), "source_rank", "left").join(count(kept, "n_kept"), "source_rank", "left").na.fill(0)
    return kept, report.select("source_rank", "n_rows", (F.col("n_rows") - F.col("n_once")).alias("exact_removed"), (F.col("n_once") - F.col("n_kept")).alias("near_removed"), "n_kept")
