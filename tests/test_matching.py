import itertools
import random

import numpy as np
import pandas as pd
import pytest

from dotspark.operators import matching, metrics, regions

SCHEMA = "video_id long, t long, {} long, x double, y double"


def points(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMA.format(name))


def random_frames(seed, n=60):
    r = random.Random(seed)
    side = lambda base: [(r.randrange(2), r.randrange(3), base + i, float(r.randrange(20)), float(r.randrange(12))) for i in range(n)]
    return side(0), side(1000)


def brute(gt, preds, radius):
    out = []
    for key in {r[:2] for r in gt + preds}:
        pairs = sorted(((g[3] - p[3]) ** 2 + (g[4] - p[4]) ** 2, g[2], p[2]) for g in gt for p in preds if g[:2] == p[:2] == key)
        used = set()
        for d2, g, p in pairs:
            if d2 <= radius * radius and ("g", g) not in used and ("p", p) not in used:
                used |= {("g", g), ("p", p)}
                out.append((*key, g, p, d2))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_greedy_whatever_the_partitions(spark, parts):
    gt, preds = random_frames(1)
    got = matching.greedy_match(points(spark, "gt_id", gt).repartition(parts), points(spark, "det_id", preds).repartition(parts), 5.0)
    assert sorted(map(tuple, got.collect())) == brute(gt, preds, 5.0)


def test_smaller_thresholds_are_prefixes(spark):
    gt, preds = random_frames(2)
    rows = {r.threshold: r for r in metrics.threshold_metrics(points(spark, "gt_id", gt), points(spark, "det_id", preds), (1.0, 3.0, 6.0)).collect()}
    for radius, row in rows.items():
        assert row.tp == len(brute(gt, preds, radius))
        assert row.tp + row.fp == len(preds) and row.tp + row.fn == len(gt)


def test_optimal_is_one_to_one_and_no_smaller(spark):
    gt, preds = random_frames(3)
    args = points(spark, "gt_id", gt), points(spark, "det_id", preds), 5.0
    best = matching.optimal_match(*args).collect()
    assert len({r.gt_id for r in best}) == len({r.det_id for r in best}) == len(best) >= matching.greedy_match(*args).count()


def test_hungarian_against_all_permutations():
    r = np.random.default_rng(5)
    for n in (1, 2, 4, 6):
        cost = r.integers(0, 50, (n, n)).astype(float)
        got = matching.hungarian(cost)
        assert cost[range(n), got].sum() == min(cost[range(n), p].sum() for p in itertools.permutations(range(n)))


def test_components_change_no_assignment(monkeypatch):
    """A frame's pairs in parts have as many matches, and as short ones, as its pairs in one matrix."""
    r = np.random.default_rng(9)
    for _ in range(20):
        pairs = pd.DataFrame({"gt_id": r.integers(0, 30, 50), "det_id": r.integers(0, 30, 50), "d2": r.integers(1, 400, 50).astype(float)}).drop_duplicates(["gt_id", "det_id"], ignore_index=True)
        monkeypatch.setattr(matching, "FEW", 1000)
        whole = matching._optimal(pairs)
        monkeypatch.setattr(matching, "FEW", 0)
        parts = matching._optimal(pairs)
        assert len(parts) == len(whole) and abs(np.sqrt(parts["d2"]).sum() - np.sqrt(whole["d2"]).sum()) < 1e-9
        assert parts["gt_id"].is_unique and parts["det_id"].is_unique


def test_largest_regions():
    masks = np.random.default_rng(3).random((40, 6, 7)) < 0.45
    assert regions.largest_regions(masks).tolist() == [int(np.bincount(regions.label_mask(m).ravel())[1:].max(initial=0)) for m in masks]
    assert regions.largest_regions(np.zeros((2, 3, 3), bool)).tolist() == [0, 0]


def test_empty_sides(spark):
    none = points(spark, "gt_id", [])
    some = points(spark, "det_id", [(0, 0, 1, 1.0, 1.0)])
    row = metrics.threshold_metrics(none, some, (1.0,)).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall, row.f1, row.mean_err) == (0, 1, 0, 0.0, 0.0, 0.0, None)
    assert matching.nearest(some, none.withColumnRenamed("gt_id", "other"), "det_id", "other").first().other is None
