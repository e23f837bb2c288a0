"""Greedy one-to-one matching of two sides' points, cheapest pair first, without listing all pairs.

Points of a side that lie on one place wait there as a queue in their order: of equally far pairs the first of the
queue always comes first, so places are paired and not points. Radii widen: what a small one leaves free
has no partner within it, so a wide one meets few points however dense a frame is.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Pairs of neighbouring cells' places that are looked at together, and that a radius may have before a smaller one goes first.
BLOCK, MOST = 1 << 20, 1 << 22


class Queues:
    """Points by place; a point's number is its turn. ``extra`` parts places further. Points without finite coordinates wait nowhere."""

    def __init__(self, x: np.ndarray, y: np.ndarray, extra: np.ndarray | None = None) -> None:
        at = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        columns = [c[at] for c in ((x, y) if extra is None else (x, y, extra))]
        order = np.lexsort(columns)  # stable: equal places keep their points' order
        self.rows = at[order]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
        starts = np.flatnonzero(new)
        self.x, self.y = x[self.rows[starts]], y[self.rows[starts]]
        self.extra = None if extra is None else extra[self.rows[starts]]
        self.at, self.end = starts.tolist(), [*starts[1:].tolist(), len(order)][: len(starts)]
        self.turns = self.rows.tolist()

    def open(self) -> np.ndarray:
        return np.flatnonzero(np.asarray(self.at, np.int64) < np.asarray(self.end, np.int64))


def ranges(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For places a the runs of places b in the nine cells around: (number of a, begin, end, order of b that runs are in)."""
    x0, y0 = min(ax.min(), bx.min()), min(ay.min(), by.min())
    reach = max(max(ax.max(), bx.max()) - x0, max(ay.max(), by.max()) - y0)
    width = max(width * (1 + 1e-9), reach / (1 << 30), 1e-300)  # wider than a step, so that rounding loses no neighbour
    cell = lambda v, low: np.floor((v - low) / width).astype(np.int64) + 1
    span = int(reach / width) + 4
    keys = cell(bx, x0) * span + cell(by, y0)
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], cell(ax, x0) * span + cell(ay, y0)
    low, high = [], []
    for step in (-span, 0, span):
        low.append(np.searchsorted(keys, own + (step - 1), "left"))
        high.append(np.searchsorted(keys, own + (step + 1), "right"))
    low, high, of = np.concatenate(low), np.concatenate(high), np.tile(np.arange(len(ax)), 3)
    some = high > low
    return of[some], low[some], high[some], order


def expand(of: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray):  # noqa: ANN201
    """Pairs (a, b) of such runs, about ``BLOCK`` at a time."""
    sizes = high - low
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1
    for part in np.split(np.arange(len(of)), cuts):
        n = sizes[part]
        first = np.cumsum(n) - n
        yield np.repeat(of[part], n), order[np.arange(n.sum()) - np.repeat(first - low[part], n)]


def _walk(left: Queues, right: Queues, i: np.ndarray, j: np.ndarray, cost: np.ndarray, out: list[tuple[int, int, int]]) -> None:
    """Match places' queues in order of cost; of equally dear pairs the smallest left turn goes first, to its smallest right turn."""
    order = np.argsort(cost, kind="stable")
    cost, i, j = cost[order], i[order].tolist(), j[order].tolist()
    bounds = [0, *(np.flatnonzero(cost[1:] != cost[:-1]) + 1).tolist(), len(i)]
    at, end, to, stop, turn, mate = left.at, left.end, right.at, right.end, left.turns, right.turns

    def all_of(a: int, b: int) -> None:
        n = min(end[a] - at[a], stop[b] - to[b])
        out.append((at[a], to[b], n))
        at[a] += n
        to[b] += n

    for begin, until in zip(bounds[:-1], bounds[1:], strict=True):
        live = [(a, b) for a, b in zip(i[begin:until], j[begin:until], strict=True) if at[a] < end[a] and to[b] < stop[b]]
        if len({a for a, _ in live}) == len(live) == len({b for _, b in live}):
            for a, b in live:
                all_of(a, b)
            continue
        near: dict[int, list[int]] = {}
        for a, b in live:
            near.setdefault(a, []).append(b)
        heap = [(turn[at[a]], a) for a in near]
        heapq.heapify(heap)
        while heap:
            a = heap[0][1]
            best, first = -1, -1
            for b in near[a]:
                if to[b] < stop[b] and (best < 0 or mate[to[b]] < first):
                    best, first = b, mate[to[b]]
            if best < 0:
                heapq.heappop(heap)
                continue
            out.append((at[a], to[best], 1))
            at[a] += 1
            to[best] += 1
            if at[a] < end[a]:
                heapq.heapreplace(heap, (turn[at[a]], a))
            else:
                heapq.heappop(heap)


def match(left: Queues, right: Queues, reach: float, cost: Callable[[np.ndarray, np.ndarray], np.ndarray], sure: Callable[[float], float]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the matched points of both sides.

    ``cost`` of squared distances and right places is infinite where a pair is not allowed, and so beyond ``reach``; every pair
    that costs at most ``sure(r)`` lies within r.
    """
    out: list[tuple[int, int, int]] = []
    done, radius = 0.0, reach
    while True:
        a, b = left.open(), right.open()
        if not len(a) or not len(b):
            break
        if done == 0.0 and radius == reach and len(a) * len(b) > BLOCK >> 4:
            wide, high = np.ptp(right.x[b]), np.ptp(right.y[b])
            radius = min(reach, max(2 * np.sqrt(wide * high / len(b)), 4 * max(wide, high) / len(b), reach * 1e-6))
        of, low, high, order = ranges(left.x[a], left.y[a], right.x[b], right.y[b], radius)
        # Where a radius has very many pairs, a smaller one goes first.
        if (high - low).sum() > MOST and radius > max(1.25 * done, reach * 1e-9):
            radius = radius / 4 if done == 0.0 else max((done + radius) / 2, radius / 4)
            continue
        limit = np.inf if radius >= reach else sure(radius)
        found = []
        for i, j in expand(of, low, high, order):
            i, j = a[i], b[j]
            price = cost((left.x[i] - right.x[j]) * (left.x[i] - right.x[j]) + (left.y[i] - right.y[j]) * (left.y[i] - right.y[j]), j)
            keep = np.isfinite(price) & (price <= limit)
            found.append((i[keep], j[keep], price[keep]))
        if found:
            _walk(left, right, *(np.concatenate(c) for c in zip(*found, strict=True)), out)
        if radius >= reach:
            break
        done, radius = radius, min(2 * radius, reach)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, other, n = np.array(out, np.int64).T
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return left.rows[np.repeat(first, n) + step], right.rows[np.repeat(other, n) + step]


def by_distance(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pairs within the radius first; ties by the left and then the right point's number."""
    return match(Queues(lx, ly), Queues(rx, ry), radius, lambda d2, _: np.where(d2 <= radius * radius, d2, np.inf), lambda r: r * r)


def in_plain(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, radius: float, left_id: np.ndarray, right_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, pair by pair, for points of which some share an id: each id is matched once."""
    a, b = np.flatnonzero(np.isfinite(lx) & np.isfinite(ly)), np.flatnonzero(np.isfinite(rx) & np.isfinite(ry))
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for i, j in expand(*ranges(lx[a], ly[a], rx[b], ry[b], radius)):
        i, j = a[i], b[j]
        d2 = (lx[i] - rx[j]) * (lx[i] - rx[j]) + (ly[i] - ry[j]) * (ly[i] - ry[j])
        keep = d2 <= radius * radius
        found.append((i[keep], j[keep], d2[keep]))
    i, j, d2 = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((right_id[j], left_id[i], d2))
    left, right, out = set(), set(), []
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        g, d = left_id[p], right_id[q]
        if g not in left and d not in right:
            left.add(g)
            right.add(d)
            out.append((p, q))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
