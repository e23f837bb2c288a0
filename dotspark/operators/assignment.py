"""Assignment of two sides' points with the most pairs within a radius and then the least total distance.

Points that lie on one place are alike, so places with supplies are assigned (a transportation problem) and a frame costs
its places, not its points. It is solved by the network simplex method: a spanning tree of pairs and of a root that takes
what is left over, with a price for each place, is mended by pairs that are too cheap for their prices until there is
none. Where there are very many pairs, only those that were once too cheap are held; the others are looked at in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import greedy

#: Pairs of places up to which all of a frame are held.
HELD = 1 << 18
#: Pairs of a left place that are taken from a block of pairs that are too cheap.
EACH = 8
#: Pivots after which prices are made afresh.
FRESH = 256


class Tree:
    """Left nodes, right nodes and the root, in this order; each but the root has an edge to its parent.

    Edges lead from left to right, from left to the root (left over, at price ``far``) and from the root to the right (free),
    so that a left node's edge leads up and a right node's down. A right node's edge always has flow: of the edges
    that a cycle empties the last one behind the cycle's top leaves, so that no tree comes twice.
    """

    def __init__(self, supply: np.ndarray, demand: np.ndarray, far: float) -> None:
        self.lefts, self.far, n = len(supply), far, len(supply) + len(demand)
        self.root, self.tol = n, far * 2.0**-42  # wider than what rounding adds up to in ``FRESH`` pivots
        self.parent, self.edge, self.flow = [n] * n, [-1] * n, [*supply.tolist(), *demand.tolist()]
        self.kids: list[set[int]] = [set() for _ in range(n + 1)]
        self.price = np.zeros(n + 1)
        self.u = self.v = np.zeros(0, np.int64)
        self.cost = np.zeros(0)

    def add(self, u: np.ndarray, v: np.ndarray, cost: np.ndarray) -> None:
        """More edges between left and right nodes."""
        self.u, self.v, self.cost = np.concatenate([self.u, u]), np.concatenate([self.v, v + self.lefts]), np.concatenate([self.cost, cost])

    def begin(self) -> None:
        """The nearest pairs first: a pair takes all that one of its ends still has, and that end hangs on the other."""
        parent, edge, flow = self.parent, self.edge, self.flow
        order = np.argsort(self.cost, kind="stable")
        for e, i, j in zip(order.tolist(), self.u[order].tolist(), self.v[order].tolist(), strict=True):
            if parent[i] == parent[j] == self.root and flow[i]:
                if flow[j] <= flow[i]:
                    parent[j], edge[j] = i, e
                    flow[i] -= flow[j]
                else:
                    parent[i], edge[i] = j, e
                    flow[j] -= flow[i]
        for w, p in enumerate(parent):
            self.kids[p].add(w)
        self.reprice()

    def reprice(self) -> None:
        """Prices afresh, so that no rounding adds up."""
        price, nodes = [0.0] * (self.root + 1), [self.root]
        cost, edge, lefts = self.cost, self.edge, self.lefts
        for p in nodes:
            for w in self.kids[p]:
                c = float(cost[edge[w]]) if edge[w] >= 0 else self.far if w < lefts else 0.0
                price[w] = price[p] + c if w < lefts else price[p] - c
            nodes.extend(self.kids[p])
        self.price = np.array(price)

    def pivot(self, e: int, u: int, v: int, r: float) -> None:
        """Take the edge u -> v in, whose cost lies ``-r`` below its ends' prices."""
        parent, flow, lefts, root = self.parent, self.flow, self.lefts, self.root
        above, w = {}, u
        while w != root:
            above[w] = None
            w = parent[w]
        above[root] = None
        down, top = [], v
        while top not in above:
            down.append(top)
            top = parent[top]
        least, out, at_u = None, -1, True
        up = []
        for w in above:
            if w == top:
                break
            up.append(w)
            if w < lefts and (least is None or flow[w] < least):
                least, out = flow[w], w
        for w in down:
            if w >= lefts and (least is None or flow[w] <= least):
                least, out, at_u = flow[w], w, False
        if least:
            for w in up:
                flow[w] += -least if w < lefts else least
            for w in down:
                flow[w] += least if w < lefts else -least
        # What hung below the edge that leaves is turned to hang on the new one.
        edge, kids = self.edge, self.kids
        w, p = (u, v) if at_u else (v, u)
        nodes, x, f = [w], e, least
        while True:
            following, y, g = parent[w], edge[w], flow[w]
            kids[following].discard(w)
            parent[w], edge[w], flow[w] = p, x, f
            kids[p].add(w)
            if w == out:
                break
            p, w, x, f = w, following, y, g
        for w in nodes:
            nodes.extend(kids[w])
        self.price[nodes] += r if at_u else -r

    def cheap(self) -> list[tuple[int, int, int]]:
        """For each left node its edge that is most too cheap for its ends' prices, and such edges of the root; the cheapest first."""
        price, n, root = self.price, self.lefts, self.root
        r = self.cost - price[self.u] + price[self.v]
        e = np.flatnonzero(r < -self.tol)
        e = e[np.argsort(r[e], kind="stable")]
        e = e[np.sort(np.unique(self.u[e], return_index=True)[1])]
        found = list(zip(e.tolist(), self.u[e].tolist(), self.v[e].tolist(), strict=True))
        found += [(-1, w, root) for w in np.flatnonzero(self.far - price[:n] + price[root] < -self.tol).tolist()]
        return found + [(-1, root, w + n) for w in np.flatnonzero(price[n:root] - price[root] < -self.tol).tolist()]

    def mend(self) -> None:
        """Pivot until no held edge is too cheap."""
        since = 0
        while (found := self.cheap()) or since:
            for e, u, v in found:
                c = self.cost[e] if e >= 0 else self.far if v == self.root else 0.0
                r = float(c - self.price[u] + self.price[v])
                if r < -self.tol:
                    self.pivot(e, u, v, r)
                    since += 1
                    if since % FRESH == 0:
                        self.reprice()
            if not found:
                self.reprice()
                since = 0

    def flows(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges with flow, and how much."""
        used = np.array([(e, f) for e, f in zip(self.edge, self.flow, strict=True) if e >= 0 and f], np.int64).reshape(-1, 2)
        used = used[np.argsort(used[:, 0])]
        return used[:, 0], used[:, 1]


Place = tuple[np.ndarray, np.ndarray, np.ndarray]


def _within(left: Place, right: Place, radius: float, step: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of pairs (left row, right row, distance) at most ``radius`` and, about, ``step`` apart."""
    for i, j in greedy.expand(*greedy.ranges(*left[:2], *right[:2], step)):
        dx, dy = left[0][i] - right[0][j], left[1][i] - right[1][j]
        d2 = dx * dx + dy * dy
        keep = d2 <= radius * radius
        yield i[keep], j[keep], np.sqrt(d2[keep])


def _count(left: Place, right: Place, step: float) -> int:
    _, low, high, _ = greedy.ranges(*left[:2], *right[:2], step)
    return int((high - low).sum())


def transport(left: Place, right: Place, supply: np.ndarray, demand: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row, how many) of the assignment. A side is x, y and the node, with its supply, of each row."""
    # No chain of pairs that brings one pair more is as long as this.
    tree = Tree(supply, demand, 2.0 ** np.ceil(np.log2((len(supply) + len(demand) + 1) * max(radius, 1e-300))))
    step = radius
    while not (few := _count(left, right, step) <= HELD) and step > radius * 1e-9:
        step /= 2
    first, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        first.append(i)
        other.append(j)
        tree.add(left[2][i], right[2][j], c)

    if few:
        for i, j, c in list(_within(left, right, radius, step)):
            take(i, j, c)
    tree.begin()
    tree.mend()
    while not few or step < radius:
        new = []
        for i, j, c in _within(left, right, radius, radius):
            r = c - tree.price[left[2][i]] + tree.price[right[2][j] + tree.lefts]
            e = np.flatnonzero(r < -tree.tol)
            e = e[np.lexsort((r[e], left[2][i[e]]))]
            node = left[2][i[e]]
            turn = np.arange(len(e)) - np.searchsorted(node, node)
            e = e[turn < EACH]
            new.append((i[e], j[e], c[e]))
        i, j, c = (np.concatenate(part) for part in zip(*new, strict=True)) if new else (np.zeros(0, np.int64),) * 3
        if not len(i):
            break
        take(i, j, c)
        tree.mend()
    e, n = tree.flows()
    return np.concatenate(first)[e], np.concatenate(other)[e], n


def by_distance(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the assigned points of both sides."""
    left, right = greedy.Queues(lx, ly), greedy.Queues(rx, ry)
    if not len(left.x) or not len(right.x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sides = [(q.x, q.y, np.arange(len(q.x))) for q in (left, right)]
    supplies = [np.subtract(q.end, q.at).astype(np.int64) for q in (left, right)]
    a, b, n = transport(*sides, *supplies, radius)
    return _points(left, a, n), _points(right, b, n)


def _points(queues: greedy.Queues, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` points of each place in the order of its queue; a place may come several times."""
    order = np.argsort(place, kind="stable")
    sizes, at = n[order], place[order]
    before = np.cumsum(sizes) - sizes
    own = before - before[np.searchsorted(at, at)]
    begin = np.empty(len(place), np.int64)
    begin[order] = np.asarray(queues.at, np.int64)[at] + own
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return queues.rows[np.repeat(begin, n) + step]


def by_id(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, radius: float, left_id: np.ndarray, right_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for points of which some share an id: each id is assigned once, at one of its points."""
    a, b = np.flatnonzero(np.isfinite(lx) & np.isfinite(ly)), np.flatnonzero(np.isfinite(rx) & np.isfinite(ry))
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.unique(left_id[a], return_inverse=True), np.unique(right_id[b], return_inverse=True)
    ones = np.ones(len(left[0]), np.int64), np.ones(len(right[0]), np.int64)
    i, j, _ = transport((lx[a], ly[a], left[1]), (rx[b], ry[b], right[1]), *ones, radius)
    return a[i], b[j]
