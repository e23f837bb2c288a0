"""Same-frame distance joins, one-to-one matching and nearest rows.

Point tables have ``video_id``, ``t``, an id and ``x``, ``y``.
"""

from __future__ import annotations


from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import materialise
from . import assignment, greedy

KEYS = ["video_id", "t"]


def distance_pairs(left: DataFrame, right: DataFrame, radius: float, left_id: str = "gt_id", right_id: str = "det_id") -> DataFrame:
    """(video_id, t, left id, right id, ``d2``) of same-frame pairs at most ``radius`` apart.

    Both sides are laid on a grid of cells as wide as the radius; one side goes to its cell and the eight
    around it. The join is an equi-join on the cell, so a dense frame costs its points times their
    neighbours and not its square, and the cells of one frame spread over tasks.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = left.select(*KEYS, F.col(left_id), F.col("x").alias("_lx"), F.col("y").alias("_ly"), F.explode(near).alias("_n"))
    a = a.withColumn("_cx", F.floor(F.col("_lx") / radius) + F.col("_n.a")).withColumn("_cy", F.floor(F.col("_ly") / radius) + F.col("_n.b")).drop("_n")
    b = right.select(*KEYS, F.col(right_id), F.col("x").alias("_rx"), F.col("y").alias("_ry"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    d2 = (F.col("_lx") - F.col("_rx")) * (F.col("_lx") - F.col("_rx")) + (F.col("_ly") - F.col("_ry")) * (F.col("_ly") - F.col("_ry"))
    return a.join(b, [*KEYS, "_cx", "_cy"]).select(*KEYS, left_id, right_id, d2.alias("d2")).where(F.col("d2") <= radius * radius)


def whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole frames, and where each frame begins, from batches that are sorted by frame."""

    def cuts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in KEYS:
            codes = rows[k].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            new |= codes[1:] != codes[:-1]
        return np.flatnonzero(new) + 1

    def run(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        whole = pa.concat_tables(parts).combine_chunks()
        return whole, np.concatenate([[0], cuts(whole)])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        own = lambda n: tuple(part[k][n].as_py() for k in KEYS)  # noqa: B023, E731
        ends = cuts(part)
        # The last frame may go on in the next batch.
        cut = int(ends[-1]) if len(ends) else 0
        if cut or (held and own(0) != last):
            if cut:
                held.append(part.slice(0, cut))
            yield run(held)
            held = []
        held.append(part.slice(cut))
        last = own(part.num_rows - 1)
    if held:
        yield run(held)


def _points(gt: DataFrame, preds: DataFrame) -> DataFrame:
    """Both sides' points, by frames that are dealt to tasks and sorted there by Spark, each side by its id."""
    g = gt.select(*KEYS, F.lit(0).alias("_side"), "gt_id", F.lit(None).cast(preds.schema["det_id"].dataType).alias("det_id"), "x", "y")
    p = preds.select(*KEYS, F.lit(1).alias("_side"), F.lit(None).cast(gt.schema["gt_id"].dataType).alias("gt_id"), "det_id", "x", "y")
    return g.unionByName(p).repartition(*KEYS).sortWithinPartitions(*KEYS, "_side", "gt_id", "det_id")


class _Matched:
    """A matching of a table of whole frames: row numbers ``left`` and ``right`` of the pairs, and ``d2``.

    ``by_point`` matches the two sides of a frame, and ``by_id`` those of one in which points share an id.
    """

    def __init__(self, rows: pa.Table, starts: np.ndarray, radius: float, by_point: Callable = greedy.by_distance, by_id: Callable = greedy.in_plain) -> None:
        self.rows, self.starts, self.ends = rows, starts, np.append(starts[1:], rows.num_rows)
        self.side = rows["_side"].to_numpy()
        x, y = (rows[c].cast(pa.float64()).to_numpy() for c in "xy")
        # Equal ids of a side stand next to each other; ``id`` numbers the different ones.
        same = np.zeros(rows.num_rows, bool)
        for c in ("gt_id", "det_id"):
            column = rows[c].combine_chunks()
            same[1:] |= pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy(zero_copy_only=False)
        same[starts] = False
        self.id = np.cumsum(~same)
        known = np.logical_and.reduce([rows[k].is_valid().to_numpy() for k in KEYS])
        self.middle = starts + np.add.reduceat((self.side == 0).astype(np.int64), starts)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, m, b in zip(self.starts.tolist(), self.middle.tolist(), self.ends.tolist(), strict=True):
            if a < m < b and known[a]:
                sides = x[a:m], y[a:m], x[m:b], y[m:b], radius
                i, j = by_id(*sides, self.id[a:m], self.id[m:b]) if same[a:b].any() else by_point(*sides)
                left.append(i + a)
                right.append(j + m)
        self.left, self.right = np.concatenate(left), np.concatenate(right)
        dx, dy = x[self.left] - x[self.right], y[self.left] - y[self.right]
        self.d2, self.repeated = dx * dx + dy * dy, same.any()

    def pairs(self) -> pa.Table:
        ids = self.rows.take(self.right)["det_id"]
        return self.rows.take(self.left).select([*KEYS, "gt_id"]).append_column("det_id", ids).append_column("d2", pa.array(self.d2))

    def counts(self) -> pa.Table:
        tp = np.bincount(np.searchsorted(self.starts, self.left, "right") - 1, minlength=len(self.starts))
        out = self.rows.take(self.starts).select(KEYS)
        for name, n in (("n_gt", self.middle - self.starts), ("n_pred", self.ends - self.middle), ("tp", tp)):
            out = out.append_column(name, pa.array(n.astype(np.int64)))
        return out

    def all(self) -> pa.Table:
        """Pairs, and the rows of either side whose id has none. A matched id that several rows share brings all of them."""
        left, right, d2 = self.left, self.right, self.d2
        free = ~np.isin(self.id, self.id[np.concatenate([left, right])])
        if self.repeated:
            last = np.searchsorted(self.id, self.id, "right")
            first = np.searchsorted(self.id, self.id, "left")
            many = [(p, q, d) for i, j, d in zip(left, right, d2, strict=True) for p in range(first[i], last[i]) for q in range(first[j], last[j])]
            left, right, d2 = (np.array(c) for c in zip(*many, strict=True)) if many else (left, right, d2)
        miss, alarm = np.flatnonzero(free & (self.side == 0)), np.flatnonzero(free & (self.side == 1))
        none = lambda n: np.full(n, -1, np.int64)
        g, p = np.concatenate([left, miss, none(len(alarm))]), np.concatenate([right, none(len(miss)), alarm])
        take = lambda at, c: self.rows[c].combine_chunks().take(pa.array(at, mask=at < 0))
        out = {k: take(np.where(g < 0, p, g), k) for k in KEYS} | {"gt_id": take(g, "gt_id"), "det_id": take(p, "det_id")}
        out |= {"gt_x": take(g, "x"), "gt_y": take(g, "y"), "pred_x": take(p, "x"), "pred_y": take(p, "y")}
        far = np.concatenate([d2, np.zeros(len(miss) + len(alarm))])
        outcome = np.repeat(["tp", "fn", "fp"], [len(d2), len(miss), len(alarm)])
        return pa.table({"outcome": pa.array(outcome, pa.string())} | out | {"d2": pa.array(far, mask=(g < 0) | (p < 0))})


def _matched(points: DataFrame, radius: float, form: str, schema: str, *how: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_frames(batches):
            yield from getattr(_Matched(rows, starts, radius, *how), form)().to_batches(max_chunksize=1 << 16)

    return points.mapInArrow(run, schema)


def _kinds(points: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in columns)


def greedy_match(gt: DataFrame, preds: DataFrame, radius: float) -> DataFrame:
    """(video_id, t, gt_id, det_id, d2) of the greedy one-to-one matching of each frame.

    Pairs are taken nearest first, ties by gt id and det id. As pairs come nearest first, the matching at a smaller
    radius is the part of this one within it: one pass serves every threshold. Only the points are shuffled; a frame's
    pairs are found where its points are, between places and at widening radii (see ``greedy``), so that a frame costs about
    its points and not their pairs.
    """
    points = _points(gt, preds)
    return _matched(points, radius, "pairs", _kinds(points, *KEYS, "gt_id", "det_id") + ", d2 double")


def greedy_counts(gt: DataFrame, preds: DataFrame, radius: float) -> DataFrame:
    """(video_id, t, n_gt, n_pred, tp) of that matching, one row per frame of either side."""
    points = _points(gt, preds)
    return _matched(points, radius, "counts", _kinds(points, *KEYS) + ", n_gt long, n_pred long, tp long")


def greedy_outcomes(gt: DataFrame, preds: DataFrame, radius: float) -> DataFrame:
    """(outcome, video_id, t, gt_id, det_id, gt_x, gt_y, pred_x, pred_y, d2) of that matching (tp) and of the rows without a partner (fn, fp), in one pass."""
    points = _points(gt, preds)
    x, y = (points.schema[c].dataType.simpleString() for c in "xy")
    return _matched(points, radius, "all", "outcome string, " + _kinds(points, *KEYS, "gt_id", "det_id") + f", gt_x {x}, gt_y {y}, pred_x {x}, pred_y {y}, d2 double")


def by_frame(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to the rows of each frame. Spark deals and sorts the frames; a partition is one stream of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in KEYS:
                column = batch[k].to_numpy()
                new[1:] |= column[1:] != column[:-1]
                new[0] |= bool(held) and held[-1][k].iloc[-1] != column[0]
            starts = np.flatnonzero(new).tolist()
            if not starts:
                held.append(batch)
                continue
            # The last frame may go on in the next batch.
            whole = [pd.concat([*held, batch.iloc[: starts[0]]], ignore_index=True)] if held or starts[0] else []
            out = [fn(f) for f in [*whole, *(batch.iloc[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True))] if len(f)]
            held = [batch.iloc[starts[-1] :]]
            if out:
                yield pd.concat(out)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(run, schema)


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest full assignment of a square matrix (potentials and augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j, way = i, 0, np.zeros(n + 1, int)
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            nxt = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[nxt]
            np.add.at(u, match[used], delta)
            v[used] -= delta
            least[~used] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


#: Cost of a pair that is too far apart.
FORBIDDEN = 1e9
#: Points of a side up to which a frame's pairs are not parted into components first.
FEW = 64


def _parts(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest left place that chains of pairs reach from each pair: pairs of one value are one component."""
    root = np.arange(n)
    while True:
        least = np.full(j.max() + 1, n)
        np.minimum.at(least, j, root[i])
        new = root.copy()
        np.minimum.at(new, i, least[j])
        if (new == root).all():
            return root[i]
        root = new


def _optimal(pairs: pd.DataFrame) -> pd.DataFrame:
    """One assignment for each component of a frame's listed pairs; a frame of few points is one. The plain form of ``assignment``, to compare with."""
    left, i = np.unique(pairs["gt_id"], return_inverse=True)
    j = np.unique(pairs["det_id"], return_inverse=True)[1]
    part = _parts(i, j, len(left)) if max(len(left), j.max() + 1) > FEW else np.zeros(len(pairs), int)
    order = np.argsort(part, kind="stable")
    keep, cost = np.ones(len(pairs), bool), np.sqrt(pairs["d2"].to_numpy())
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(rows) > 1:
            a, x = np.unique(i[rows], return_inverse=True)
            b, y = np.unique(j[rows], return_inverse=True)
            matrix = np.full((max(len(a), len(b)),) * 2, FORBIDDEN)
            matrix[x, y] = cost[rows]
            keep[rows] = hungarian(matrix)[x] == y
    return pairs[keep]


def optimal_match(gt: DataFrame, preds: DataFrame, radius: float) -> DataFrame:
    """(video_id, t, gt_id, det_id, d2) of the one-to-one matching of each frame with the most pairs within the radius and then the least total distance.

    Only the points are shuffled. A frame is assigned where its points are, between places with as many points as lie on
    them (see ``assignment``), so that its cost grows with its places and not with the square of its points.
    """
    points = _points(gt, preds)
    return _matched(points, radius, "pairs", _kinds(points, *KEYS, "gt_id", "det_id") + ", d2 double", assignment.by_distance, assignment.by_id)


#: Others of a frame up to which a row meets all of them; beyond, rings of cells are searched.
ALL = 64
#: Others that the fullest cell of a frame may hold, about, when the search begins.
CELL = 16


def nearest(rows: DataFrame, others: DataFrame, row_id: str, other_id: str) -> DataFrame:
    """For each row the nearest of the others in its frame: (keys, row id, other id, ``distance``); null if none.

    Ties go to the smaller other id. In a frame of more than ``ALL`` others a row looks into its cell of a grid and
    the eight around it; what it finds is the nearest if it is nearer than a cell is wide. Only rows
    that are not done go on, to cells twice as wide, so a row meets about as many others however dense its frame is.
    """
    points = others.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*KEYS, F.col("x").alias("_ox"), F.col("y").alias("_oy")).agg(F.min(other_id).alias("_oid"))
    sizes = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"_{f.__name__}{c}") for f in (F.min, F.max) for c in ("_ox", "_oy")))
    dense = materialise(sizes.where(F.col("_n") > ALL), "nearest-dense")
    asked = rows.select(*KEYS, row_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if dense.isEmpty():
        found = _of_few(asked, points, row_id)
    else:
        few = _of_few(asked.join(dense, KEYS, "left_anti"), points.join(dense, KEYS, "left_anti"), row_id)
        found = few.unionByName(_by_rings(asked, points, dense, row_id))
    best = found.groupBy(*KEYS, row_id).agg(F.min("_best").alias("_best"))
    return best.select(*KEYS, row_id, F.col("_best._oid").alias(other_id), F.sqrt("_best._d2").alias("distance"))


def _closest() -> Column:
    d2 = (F.col("x") - F.col("_ox")) * (F.col("x") - F.col("_ox")) + (F.col("y") - F.col("_oy")) * (F.col("y") - F.col("_oy"))
    return F.min(F.when(d2.isNotNull(), F.struct(d2.alias("_d2"), F.col("_oid")))).alias("_best")


def _of_few(rows: DataFrame, points: DataFrame, row_id: str) -> DataFrame:
    return rows.join(points, KEYS, "left").groupBy(*KEYS, row_id).agg(_closest())


def ring_candidates(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (keys, x, y, ``_w``) with the points (keys, _ox, _oy, ``_w``) of their cell of width ``_w`` and of the eight around it."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("_c")
    around = rows.select("*", near).withColumn("_cx", F.floor(F.col("x") / F.col("_w")) + F.col("_c.a")).withColumn("_cy", F.floor(F.col("y") / F.col("_w")) + F.col("_c.b")).drop("_c")
    celled = points.withColumn("_cx", F.floor(F.col("_ox") / F.col("_w"))).withColumn("_cy", F.floor(F.col("_oy") / F.col("_w"))).drop("_w")
    return around.join(celled, [*KEYS, "_cx", "_cy"]).drop("_cx", "_cy")


def first_widths(points: DataFrame, dense: DataFrame) -> DataFrame:
    """(keys, ``_w``): the width at which a frame's fullest cell holds about ``CELL`` points, if they lie evenly in it."""
    area = (F.col("_max_ox") - F.col("_min_ox")) * (F.col("_max_oy") - F.col("_min_oy"))
    line = F.greatest(F.col("_max_ox") - F.col("_min_ox"), F.col("_max_oy") - F.col("_min_oy"))
    even = dense.select(*KEYS, F.greatest(2 * F.sqrt(area / F.col("_n")), line / F.col("_n"), F.lit(1e-9)).alias("_w"))
    cell = points.join(even, KEYS).groupBy(*KEYS, "_w", F.floor(F.col("_ox") / F.col("_w")), F.floor(F.col("_oy") / F.col("_w"))).agg(F.count(F.lit(1)).alias("_in"))
    return cell.groupBy(*KEYS, "_w").agg(F.max("_in").alias("_in")).select(*KEYS, (F.col("_w") / F.pow(F.lit(2.0), F.ceil(F.greatest(F.lit(0.0), F.log2(F.col("_in") / CELL) / 2)))).alias("_w"))


def _by_rings(rows: DataFrame, points: DataFrame, dense: DataFrame, row_id: str) -> DataFrame:
    widths = materialise(first_widths(points, dense), "nearest-widths")
    points = materialise(points.join(widths, KEYS), "nearest-points")
    left = rows.join(widths, KEYS)
    missing = left.where("x IS NULL OR y IS NULL").select(*KEYS, row_id, F.lit(None).cast(f"struct<_d2: double, _oid: {points.schema['_oid'].dataType.simpleString()}>").alias("_best"))
    out, left = missing, materialise(left.where("x IS NOT NULL AND y IS NOT NULL").distinct(), "nearest-left")
    scale = 1.0
    while not left.isEmpty():
        wide = ring_candidates(left, points.withColumn("_w", F.col("_w") * scale))
        found = wide.groupBy(*KEYS, row_id, "x", "y", "_w").agg(_closest()).where(F.col("_best._d2") < F.col("_w") * F.col("_w"))
        done = materialise(found.select(*KEYS, row_id, "x", "y", "_best"), "nearest-done")
        out = out.unionByName(done.select(*KEYS, row_id, "_best"))
        scale *= 2
        left = materialise(left.join(done, [*KEYS, row_id, "x", "y"], "left_anti").withColumn("_w", F.col("_w") * 2), "nearest-left")
    return out
