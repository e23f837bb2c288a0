"""Track linking, and shape features of tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import greedy

#: Pixels added to a link's cost for each frame of gap.
TIME_SCALE = 0.5


#: Pairs of points and tracks up to which a frame is linked pair by pair.
FEW = 1024


def assign(active: list[dict], points: list[tuple], t: int, max_gap: int, radius: float, time_scale: float = TIME_SCALE) -> list[tuple[tuple, dict | None]]:
    """Link one frame's points (id, x, y) to active tracks {track, t, x, y}, cheapest pair first.

    A pair is allowed if 0 < gap <= max_gap and distance <= radius * gap; it costs distance + time_scale *
    gap; ties go to the earlier point and then the older track. Unlinked points get None. In a frame of more than ``FEW``
    pairs places are linked and not points, at widening radii (see ``greedy``): tracks of one place and gap wait there in line.
    """
    if len(active) * len(points) > FEW:
        return _assign_many(active, points, t, max_gap, radius, time_scale)
    pairs = []
    for i, (_, x, y) in enumerate(points):
        for track in active:
            gap = t - track["t"]
            if 0 < gap <= max_gap:
                dx, dy = x - track["x"], y - track["y"]
                far = math.sqrt(dx * dx + dy * dy)
                if far <= radius * max(1, gap):
                    pairs.append((far + time_scale * gap, i, track["track"], track))
    linked: dict[int, dict] = {}
    used: set = set()
    for _, i, name, track in sorted(pairs, key=lambda p: p[:3]):
        if i not in linked and name not in used:
            linked[i] = track
            used.add(name)
    return [(p, linked.get(i)) for i, p in enumerate(points)]


def _assign_many(active: list[dict], points: list[tuple], t: int, max_gap: int, radius: float, time_scale: float) -> list[tuple[tuple, dict | None]]:
    near = sorted((a for a in active if 0 < t - a["t"] <= max_gap), key=lambda a: a["track"])
    column = lambda rows, c: np.array([r[c] for r in rows], float)
    gaps = np.array([t - a["t"] for a in near], float)
    left, right = greedy.Queues(column(points, 1), column(points, 2)), greedy.Queues(column(near, "x"), column(near, "y"), gaps)
    gap = right.extra

    def cost(d2: np.ndarray, j: np.ndarray) -> np.ndarray:
        far = np.sqrt(d2)
        return np.where(far <= radius * np.maximum(1, gap[j]), far + time_scale * gap[j], np.inf)

    least = min((time_scale * g for g in set(gaps.tolist())), default=0.0)
    # The least offset stands for all: what costs less than it and a width lies within that width, whatever its gap.
    got = greedy.match(left, right, radius * max(1, max_gap), cost, lambda r: r * (1 - 1e-9) + least)
    linked = dict(zip(*(g.tolist() for g in got), strict=True))
    return [(p, near[linked[i]] if i in linked else None) for i, p in enumerate(points)]


class Linker:
    """Links the frames of one key in order; holds the tracks that are still open and nothing else."""

    def __init__(self, max_gap: int, radius: float) -> None:
        self.max_gap, self.radius, self.open = max_gap, radius, []

    def frame(self, t: int, points: list[tuple]) -> list[tuple]:
        """(det_id, track_id) of a frame's points (id, x, y); a track is named by its first detection."""
        self.open = [a for a in self.open if t - a["t"] <= self.max_gap]
        out = []
        for (det, x, y), track in assign(self.open, points, t, self.max_gap, self.radius):
            if track is None:
                self.open.append({"track": det, "t": t, "x": x, "y": y})
            else:
                track.update(t=t, x=x, y=y)
            out.append((det, det if track is None else track["track"]))
        return out


def segments(rows: DataFrame, max_gap: int, radius: float, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``_segment``, such that no chain of links crosses from one of a key's segments to another.

    Rows fall into cells as long as the longest gap and as wide as the longest step. Where a cell is empty along
    time, or along x or y of what is left together, no link can cross. Only the cells, far fewer than the rows of a
    dense key, are put in order.
    """
    reach = max(radius * max_gap, 1e-9)
    cell = {"_ct": F.floor(F.col("t") / max(max_gap, 1)), "_cx": F.coalesce(F.floor(F.col("x") / reach), F.lit(0)), "_cy": F.coalesce(F.floor(F.col("y") / reach), F.lit(0))}
    placed = rows.withColumns(cell)
    cells, within = placed.select(*keys, *cell).distinct(), list(keys)
    for c in cell:
        order = W.partitionBy(*within).orderBy(c)
        cells = cells.withColumn("_far", F.when(F.col(c) - F.lag(c).over(order) > 1, 1).otherwise(0))
        cells = cells.withColumn(f"_s{c}", F.sum("_far").over(order.rangeBetween(W.unboundedPreceding, 0))).drop("_far")
        within.append(f"_s{c}")
    named = cells.select(*keys, *cell, F.concat_ws("-", *(F.col(f"_s{c}").cast("string") for c in cell)).alias("_segment"))
    return placed.join(named, [*keys, *cell]).drop(*cell)


def link_tracks(rows: DataFrame, max_gap: int, radius: float, keys: tuple[str, ...] = ("video_id", "obj_id")) -> DataFrame:
    """Rows (keys, t, det_id, x, y) with ``track_id``: gap-bounded greedy linking within each key.

    Segments of a key that no link can join are dealt to tasks and sorted there by Spark; Python reads a stream of
    rows, of which it holds one frame and the open tracks.
    """
    parted = segments(rows, max_gap, radius, keys).select(*keys, "_segment", "t", "det_id", "x", "y")
    group = [*keys, "_segment"]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, t, points, linker = None, None, [], None
        for batch in batches:
            out = []
            for *own, at, det, x, y in zip(*(batch[c].tolist() for c in (*group, "t", "det_id", "x", "y")), strict=True):
                if (own, at) != (key, t):
                    if points:
                        out += linker.frame(t, points)
                    if own != key:
                        linker = Linker(max_gap, radius)
                    key, t, points = own, at, []
                points.append((det, x, y))
            yield pd.DataFrame(out, columns=["det_id", "track_id"])
        if points:
            yield pd.DataFrame(linker.frame(t, points), columns=["det_id", "track_id"])

    ordered = parted.repartition(*group).sortWithinPartitions(*group, "t", "det_id")
    return rows.join(ordered.mapInPandas(link, "det_id long, track_id long"), "det_id")


def motion(rows: DataFrame) -> DataFrame:
    """Path length of each track."""
    at = W.partitionBy("track_id").orderBy("t", "det_id")
    step = F.hypot(F.col("x") - F.lag("x").over(at), F.col("y") - F.lag("y").over(at))
    return rows.withColumn("_d", step).groupBy("track_id").agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("motion"))


def profile(rows: DataFrame) -> DataFrame:
    """Per row its track's size, its turn (from 0) and its frame relative to the track's first."""
    track = W.partitionBy("track_id")
    return rows.withColumns({"track_size": F.count(F.lit(1)).over(track), "turn": F.row_number().over(track.orderBy("t", "det_id")) - 1, "rel_t": F.col("t") - F.min("t").over(track)})


def _smoothed(value: str, window: int) -> Column:
    """Centered moving average along each track; a window of 1 or less, or a track of two rows, changes nothing."""
    at = W.partitionBy("track_id").orderBy("t", "det_id")
    if window <= 1:
        return F.col(value).cast("double")
    # Rounded far below any difference that counts, so that equal means are equal whatever the order of the sum.
    mean = F.round(F.avg(value).over(at.rowsBetween(-(window // 2), window // 2)), 9)
    return F.when(F.count(F.lit(1)).over(W.partitionBy("track_id")) <= 2, F.col(value).cast("double")).otherwise(mean)


def moving_average(rows: DataFrame, value: str, window: int) -> DataFrame:
    """``smooth``: the centered moving average along each track, truncated at its ends.

    A window of 1 or less changes nothing, nor does any window in a track of one or two rows.
    """
    return rows.withColumn("smooth", _smoothed(value, window))


def intensity_range(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("track_id").agg((F.max(value) - F.min(value)).alias("intensity_range"), F.count(F.lit(1)).alias("n"))


def hill_shape(rows: DataFrame, value: str, window: int = 3, edge_low: float = 0.1, edge_high: float = 0.9, min_up: int = 2, min_down: int = 2, monotone: float = 0.6, eps: float = 1e-6) -> DataFrame:
    """(track_id, n, ``is_hill``): the smoothed curve rises to its first maximum and falls behind it.

    With n rows the peak lies strictly between floor(edge_low (n - 1)) and ceil(edge_high (n - 1)). Steps of
    at most ``eps`` are flat and count for nothing; of the others at least ``min_up`` rise before and
    ``min_down`` fall behind the peak, and at least the share ``monotone`` of each side's go its way. Tracks of
    fewer than three rows are no hills.
    """
    at, track = W.partitionBy("track_id").orderBy("t", "det_id"), W.partitionBy("track_id")
    smooth = rows.select("track_id", "t", "det_id", _smoothed(value, window).alias("_v"))
    numbered = smooth.select("track_id", "_v", (F.row_number().over(at) - 1).alias("_i"), (F.lead("_v").over(at) - F.col("_v")).alias("_step"))
    marked = numbered.withColumn("_peak", F.min_by("_i", F.struct(-F.col("_v"), F.col("_i"))).over(track))
    rise, fall = F.col("_i") < F.col("_peak"), F.col("_i") >= F.col("_peak")
    up, down = F.col("_step") > eps, F.col("_step") < -eps
    counts = {"_up": rise & up, "_before": rise & (up | down), "_down": fall & down, "_after": fall & (up | down)}
    s = marked.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.max("_peak").alias("_peak"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    last, p = F.col("n") - 1, F.col("_peak")
    inside: Column = (F.col("n") >= 3) & (p > F.floor(edge_low * last)) & (p < F.ceil(edge_high * last)) & (F.col("_before") > 0) & (F.col("_after") > 0)
    shape = (F.col("_up") >= min_up) & (F.col("_down") >= min_down) & (F.col("_up") >= monotone * F.col("_before")) & (F.col("_down") >= monotone * F.col("_after"))
    return s.select("track_id", "n", (inside & shape).alias("is_hill"))


def select_tracks(rows: DataFrame, value: str, min_points: int, min_range: float, **shape: float) -> DataFrame:
    """Rows with ``selected``: their track has the points, the intensity range and the hill shape (options of ``hill_shape``)."""
    good = intensity_range(rows, value).join(hill_shape(rows, value, **shape).select("track_id", "is_hill"), "track_id")
    flag = (F.col("n") >= min_points) & (F.col("intensity_range") >= min_range) & F.col("is_hill")
    return rows.join(good.select("track_id", flag.alias("selected")), "track_id")
