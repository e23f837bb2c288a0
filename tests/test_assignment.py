"""Optimal matching between places: against listed pairs and the plain matrix, and with work that does not grow with points."""

import itertools

import numpy as np
import pandas as pd
import pytest

from dotspark.operators import assignment, matching


def plain(lx, ly, rx, ry, radius):
    """Number of pairs and total distance of the matching by matrices."""
    d2 = (lx[:, None] - rx) ** 2 + (ly[:, None] - ry) ** 2
    i, j = np.nonzero(d2 <= radius * radius)
    if not len(i):
        return 0, 0.0
    best = matching._optimal(pd.DataFrame({"gt_id": i, "det_id": j, "d2": d2[i, j]}))
    return len(best), np.sqrt(best["d2"]).sum()


@pytest.mark.parametrize("held", [1 << 18, 0])
@pytest.mark.parametrize("place", ["even", "grid", "clustered", "one place"])
def test_against_matrices(monkeypatch, place, held):
    """All pairs held, or none at first, give as many matches, and as short ones, as the matrix of all pairs."""
    monkeypatch.setattr(assignment, "HELD", held)
    monkeypatch.setattr(assignment, "FRESH", 7)
    r = np.random.default_rng(3)
    draw = {
        "even": lambda n: r.uniform(0, 30, n), "grid": lambda n: r.integers(0, 9, n).astype(float),
        "clustered": lambda n: np.where(r.random(n) < 0.7, r.normal(5, 0.1, n), r.uniform(-40, 40, n)), "one place": lambda n: np.full(n, 7.0),
    }[place]
    for n, m, radius in ((1, 1, 3.0), (3, 40, 2.0), (40, 3, 2.0), (60, 60, 1.0), (70, 50, 4.0), (50, 70, 100.0), (30, 30, 0.0)):
        sides = draw(n), draw(n), draw(m), draw(m)
        i, j = assignment.by_distance(*sides, radius)
        far = np.hypot(sides[0][i] - sides[2][j], sides[1][i] - sides[3][j])
        many, total = plain(*sides, radius)
        assert len(set(i.tolist())) == len(set(j.tolist())) == len(i) == many
        assert (far <= radius + 1e-12).all() and abs(far.sum() - total) < 1e-6


def test_more_pairs_come_before_shorter_ones():
    """The near pair in the middle is given up for two far ones."""
    i, j = assignment.by_distance(np.array([0.0, 10.0]), np.zeros(2), np.array([9.0, 19.0]), np.zeros(2), 9.5)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (1, 1)]


def test_dense_frame_costs_its_places(spark, monkeypatch):
    """With a hundred times the points on 40 places a side there are about as many steps; 20,000 rows a side are matched without a list of pairs or a matrix."""

    def never(*_):
        raise AssertionError("a list of all pairs")

    monkeypatch.setattr(matching, "distance_pairs", never)
    pivots, old = [], assignment.Tree.pivot
    monkeypatch.setattr(assignment.Tree, "pivot", lambda *a: (pivots.append(n), old(*a))[1])
    for n in (200, 20_000):
        k = np.arange(n)
        x, y = (k * 7 % 8).astype(float), (k * 3 % 5).astype(float)
        i, _ = assignment.by_distance(x, y, x + 3, y + 0.5, 5.0)
        assert len(i) >= n * 0.9
    assert pivots.count(20_000) <= 2 * pivots.count(200) + 40
    gt = spark.createDataFrame(pd.DataFrame({"video_id": 0, "t": k % 2, "gt_id": k, "x": x, "y": y}))
    pred = spark.createDataFrame(pd.DataFrame({"video_id": 0, "t": k % 2, "det_id": k, "x": x + 0.25, "y": y}))
    rows = matching.optimal_match(gt, pred, 10.0).toPandas()
    assert len(rows) == n and rows["gt_id"].is_unique and rows["det_id"].is_unique
    assert abs(np.sqrt(rows["d2"]).sum() - n / 4) < 1e-6


def test_rows_that_share_an_id_or_lack_a_value(spark):
    """Each id once, at its better point; rows without a frame or a place never."""
    schema = "video_id long, t long, {} long, x double, y double"
    gt = spark.createDataFrame([(0, 0, 1, 0.0, 0.0), (0, 0, 1, 5.0, 0.0), (0, 0, 2, 1.0, 0.0), (0, 0, 3, None, 0.0), (None, 0, 4, 0.0, 0.0), (0, 1, 5, float("nan"), 0.0)], schema.format("gt_id"))
    pred = spark.createDataFrame([(0, 0, 10, 0.0, 0.0), (0, 0, 11, 5.0, 1.0), (0, 0, 11, 5.0, 1.0), (None, 0, 12, 0.0, 0.0), (0, 1, 13, 0.0, 0.0)], schema.format("det_id"))
    got = matching.optimal_match(gt, pred, 4.5).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1, 11, 1.0), (0, 0, 2, 10, 1.0)]


def test_whatever_the_partitions(spark):
    r = np.random.default_rng(8)
    side = lambda name: pd.DataFrame({"video_id": r.integers(0, 2, 300), "t": r.integers(0, 3, 300), name: np.arange(300), "x": r.integers(0, 20, 300) * 1.0, "y": r.integers(0, 12, 300) * 1.0})
    gt, pred = spark.createDataFrame(side("gt_id")), spark.createDataFrame(side("det_id"))
    found = [sorted(map(tuple, matching.optimal_match(gt.repartition(n), pred.repartition(n), 5.0).collect())) for n in (1, 7, 64)]
    assert all(a == b for a, b in itertools.pairwise(found)) and found[0]
