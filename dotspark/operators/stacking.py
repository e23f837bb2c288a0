"""Backgrounds and stacks of gray frames, tile by tile.

Frames are (video_id, t, pixels). A frame is cut to tiles, runs of its pixels, and a tile is worked as one vector:
folds in frame order go over the sorted tiles of a video as one stream, and stacks combine vectors before they
are shuffled. What is shuffled are frames times tiles, never pixels as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Pixels of a tile, and pixels that a task's open stacks may hold before they are passed on.
TILE, OPEN = 4096, 1 << 22


def tiles(frames: DataFrame, size: int = TILE) -> DataFrame:
    """Cut each frame's pixels to runs of ``size``: (video_id, t, tile, pixels)."""
    n = F.ceil(F.size("pixels") / size).cast("int")
    return frames.select("video_id", "t", "pixels", F.explode(F.sequence(F.lit(0), n - 1)).alias("tile")).withColumn("pixels", F.slice("pixels", F.col("tile") * size + 1, F.lit(size)))


def glue(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Whole frames of tiles: (keys, column)."""
    ordered = F.sort_array(F.collect_list(F.struct("tile", column)))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda s: s[column])).alias(column))


def fold_tiles(frames: DataFrame, tile: int, start: Callable[[], Callable[[np.ndarray], np.ndarray | None]]) -> DataFrame:
    """(video_id, t, tile, pixels, background): ``start()`` makes a step that takes a tile's vectors in frame order.

    A row for which the step gives nothing is left out. One tile's state is held at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for batch in batches:
            out = []
            for video, at, pixels in batch[["video_id", "tile", "pixels"]].itertuples(index=False):
                if (video, at) != key:
                    key, step = (video, at), start()
                out.append(step(np.asarray(pixels, float)))
            kept = batch.assign(background=out)
            yield kept[[b is not None for b in out]]

    ordered = tiles(frames, tile).select("video_id", "t", "tile", "pixels").repartition("video_id", "tile").sortWithinPartitions("video_id", "tile", "t")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", background array<double>")


def rolling_background(frames: DataFrame, window: int, warm: int = 0, tile: int = TILE) -> DataFrame:
    """(video_id, t, tile, pixels, background): mean of the last ``window`` vectors, the current one included.

    The window's vectors are a ring, of which a running sum is kept; the first ``warm`` frames give no row.
    """

    def start() -> Callable[[np.ndarray], np.ndarray | None]:
        ring: list[np.ndarray] = []
        seen, total = 0, None

        def step(values: np.ndarray) -> np.ndarray | None:
            nonlocal seen, total
            total = values.copy() if total is None else total + values
            if seen < window:
                ring.append(values)
            else:
                total -= ring[seen % window]
                ring[seen % window] = values
            seen += 1
            return total / min(seen, window) if seen > warm else None

        return step

    return fold_tiles(frames, tile, start)


def ewma_background(frames: DataFrame, alpha: float, tile: int = TILE) -> DataFrame:
    """(video_id, t, tile, pixels, background): the exponentially weighted mean before the current frame is put in.

    The first frame of a video starts the mean and has no row.
    """

    def start() -> Callable[[np.ndarray], np.ndarray | None]:
        state = None

        def step(values: np.ndarray) -> np.ndarray | None:
            nonlocal state
            before, state = state, values if state is None else (1 - alpha) * state + alpha * values
            return before

        return step

    return fold_tiles(frames, tile, start)


def stack_max(frames: DataFrame, interval: int) -> DataFrame:
    """(video_id, t_start, pixels): per pixel the maximum over each interval of frames."""
    return _stack(frames, interval, lambda v: v, np.maximum, lambda v, n: v)


def stack_mean(frames: DataFrame, interval: int, gamma: float | None = None) -> DataFrame:
    """Per pixel the mean over each interval, in linear light if ``gamma`` is given; truncated to whole values."""
    if gamma is None:
        return _stack(frames, interval, lambda v: v, np.add, lambda v, n: np.floor(v / n))
    # A value that is whole but for rounding errors stays whole.
    return _stack(frames, interval, lambda v: (v / 255.0) ** gamma, np.add, lambda v, n: np.floor((v / n) ** (1.0 / gamma) * 255.0 + 1e-6))


def _stack(frames: DataFrame, interval: int, each: Callable, join: Callable, last: Callable, tile: int = TILE) -> DataFrame:
    """``each`` frame's vector, two vectors ``join``ed, and ``last`` of the joined vector and its number of frames."""
    cut = tiles(frames, tile).select("video_id", (F.floor(F.col("t") / interval) * interval).alias("t_start"), "tile", "pixels")
    keys = ["video_id", "t_start", "tile"]
    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in keys)

    def rows(held: dict, of: Callable) -> pd.DataFrame:
        return pd.DataFrame([(*k, n, of(v, n)) for k, (n, v) in held.items()], columns=[*keys, "n", "v"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for *key, pixels in batch[[*keys, "pixels"]].itertuples(index=False):
                values = each(np.asarray(pixels, float))
                n, old = held.get(tuple(key), (0, None))
                held[tuple(key)] = (n + 1, values if old is None else join(old, values))
                if len(held) * tile > OPEN:
                    yield rows(held, lambda v, n: v)
                    held = {}
        yield rows(held, lambda v, n: v)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, value = None, 0, None
        for batch in batches:
            done: dict = {}
            for *own, more, vector in batch[[*keys, "n", "v"]].itertuples(index=False):
                if tuple(own) == key:
                    n, value = n + more, join(value, vector)
                    continue
                if key is not None:
                    done[key] = (n, value)
                key, n, value = tuple(own), more, vector
            yield rows(done, last).drop(columns="n")
        if key is not None:
            yield rows({key: (n, value)}, last).drop(columns="n")

    summed = cut.mapInPandas(partial, kinds + ", n long, v array<double>").repartition(*keys).sortWithinPartitions(*keys)
    whole = summed.mapInPandas(final, kinds + ", v array<double>").withColumn("pixels", F.transform("v", lambda v: v.cast("int")))
    return glue(whole, ["video_id", "t_start"], "pixels")
