"""The pairless greedy matching against the plain walk over all pairs."""

import inspect
import itertools
import time

import numpy as np
import pandas as pd
import pytest

from dotspark import plans
from dotspark.operators import dedupe, greedy, joins, matching, metrics, tracks
from dotspark.plans import streams
from dotspark.plans.registry import Tables
from tests import oracle
from tests.test_matching import brute, points


def sides(seed, n, m, place):
    r = np.random.default_rng(seed)
    return [place(r, k) for k in (n, n, m, m)]


PLACES = {
    "few places": lambda r, k: r.integers(0, 9, k).astype(float),
    "quarters": lambda r, k: r.integers(0, 80, k) / 4,
    "all different": lambda r, k: r.random(k) * 30 - 15,
    "clusters": lambda r, k: np.where(r.random(k) < 0.9, r.random(k) / 100, r.random(k) * 1000),
}


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("most", [8, 1 << 22])
def test_against_all_pairs(monkeypatch, place, most):
    monkeypatch.setattr(greedy, "MOST", most)
    monkeypatch.setattr(greedy, "BLOCK", 64)
    for seed, (n, m) in enumerate(itertools.product((1, 7, 120), (1, 40, 150))):
        lx, ly, rx, ry = sides(seed, n, m, PLACES[place])
        lx[::13] = np.nan
        for radius in (0.5, 6.0):
            got = greedy.by_distance(lx, ly, rx, ry, radius)
            want = greedy.in_plain(lx, ly, rx, ry, radius, np.arange(n), np.arange(m))
            assert set(zip(*(g.tolist() for g in got), strict=True)) == set(zip(*(w.tolist() for w in want), strict=True))


def test_dense_frame_looks_at_few_pairs(monkeypatch):
    """20,000 points a side hold 44 million pairs within the radius; far fewer are looked at."""
    seen, plain = [], greedy.expand
    monkeypatch.setattr(greedy, "expand", lambda *a: (seen.append(len(p[0])) or p for p in plain(*a)))
    lx, ly, rx, ry = sides(1, 20_000, 20_000, lambda r, k: r.random(k) * 60)
    left, right = greedy.by_distance(lx, ly, rx, ry, 10.0)
    assert len(left) == len(set(left)) == len(set(right)) > 19_000
    assert sum(seen) < 8_000_000


def test_rows_that_share_a_place_or_an_id(spark):
    """Counts, matches and outcomes agree with the walk, whatever the places; every row has an outcome."""
    gt = [(v, 0, 10 * v + i, float(i % 2), 0.0) for v in range(3) for i in range(9)] + [(9, 0, 900, 1.0, 1.0), (None, 0, 901, 0.0, 0.0)]
    preds = [(v, 0, 100 * v + i, float(i % 3), 0.0) for v in range(3) for i in range(7)] + [(8, 0, 800, 1.0, 1.0), (None, 0, 801, 0.0, 0.0)]
    preds += [preds[0]]  # the same row twice
    g, p = points(spark, "gt_id", gt), points(spark, "det_id", preds)
    want = brute([r for r in gt if r[0] is not None], [r for r in preds if r[0] is not None], 1.0)
    assert sorted(map(tuple, matching.greedy_match(g, p, 1.0).collect())) == want
    rows = metrics.outcomes(g, p, 1.0).collect()
    assert {(r.gt_id, r.det_id) for r in rows if r.outcome == "tp"} == {r[2:4] for r in want}
    assert sorted(r.gt_id for r in rows if r.outcome != "fp") == sorted([r[2] for r in gt] + [w[2] for w in want if w[3] == 0])
    assert sorted(r.det_id for r in rows if r.outcome != "fn") == sorted(r[2] for r in preds)
    counts = {r.video_id: (r.n_gt, r.n_pred, r.tp, r.fp, r.fn) for r in metrics.frame_counts(g, p, 1.0).collect()}
    assert counts[9] == (1, 0, 0, 0, 1) and counts[8] == (0, 1, 0, 1, 0) and counts[None] == (1, 1, 0, 1, 1)
    assert sum(c[2] for c in counts.values()) == len(want)


@pytest.mark.parametrize("grid", [1, 4, 10**6])
def test_links_by_places_are_links_by_pairs(monkeypatch, grid):
    """The same links, pair by pair and by places."""
    r = np.random.default_rng(grid)
    for n in (5, 60):
        frames = [(t, [(int(t * 100 + i), *(np.floor(r.random(2) * 12 * grid) / grid).tolist()) for i in range(n)]) for t in (0, 1, 2, 4, 5, 9, 10)]
        runs = []
        for few in (10**9, -1):
            monkeypatch.setattr(tracks, "FEW", few)
            linker = tracks.Linker(3, 2.0)
            runs.append([linker.frame(t, points) for t, points in frames])
        assert runs[0] == runs[1]


def test_crowded_frames_link_in_little_time():
    """3,000 points a frame on 64 places: 9 million pairs a frame to look at one by one."""
    r = np.random.default_rng(2)
    linker, began = tracks.Linker(3, 10.0), time.process_time()
    for t in range(6):
        out = linker.frame(t, [(t * 10_000 + i, float(x), float(y)) for i, (x, y) in enumerate(r.integers(0, 8, (3000, 2)))])
    assert time.process_time() - began < 10
    assert {a for _, a in out} == set(range(3000))


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("radius", [0.0, 0.004, 1.0, 3.0])
def test_components_against_all_pairs(place, radius):
    for seed, n in enumerate((1, 2, 50, 400)):
        x, y = sides(seed, n, 0, PLACES[place])[:2]
        places = pd.DataFrame({"x": x, "y": y}).drop_duplicates(ignore_index=True)
        x, y = places["x"].to_numpy(), places["y"].to_numpy()
        near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= radius * radius
        want = np.arange(len(x))
        for _ in x:
            want = np.where(near, want, len(x)).min(axis=1)
        got = dedupe._roots(places.assign(video_id=1, t=2, _id=np.arange(len(x))), radius)
        assert got["component"].tolist() == want.tolist()


def test_a_place_of_many_rows_is_one_place(spark):
    """30,000 rows of a frame on ten places, 450 million pairs: components, and what a merge keeps."""
    rows = spark.range(30_000).selectExpr("0L AS video_id", "0L AS t", "id AS det_id", "double(id % 10 * 3) AS x", "0D AS y", "double(id) AS weight")
    assert sorted(map(tuple, dedupe.components(rows, 2.0).groupBy("component").count().collect())) == [(k, 3000) for k in range(10)]
    assert [r.det_id for r in dedupe.keep_heaviest(rows, 3.0).collect()] == [29_999]
    kept = dedupe.proximity_merge(rows.where("det_id % 10 = 0"), rows.where("det_id % 10 > 0"), 3.0)
    assert sorted(r.det_id for r in kept.collect()) == [2, 4, 6, 8]


def test_overlapping_boxes_come_once(spark):
    """Boxes over several cells, on their edges, without area and turned; a row that is there twice pairs twice, as in SQL."""
    r = np.random.default_rng(8)
    box = lambda n: [(0, 0, i, *map(float, r.integers(-6, 12, 2)), *map(float, r.integers(-2, 9, 2))) for i in range(n)]
    left, right = box(60), box(60)
    right.append(right[0])
    frame = lambda rows, name: spark.createDataFrame(rows, f"video_id long, t long, {name} long, x double, y double, w double, h double")
    want = [(0, 0, a[2], b[2]) for a in left for b in right if a[3] < b[3] + b[5] and b[3] < a[3] + a[5] and a[4] < b[4] + b[6] and b[4] < a[4] + a[6]]
    assert sorted(map(tuple, joins.box_overlaps(frame(left, "gt_id"), frame(right, "det_id"), 4.0).collect())) == sorted(want)


def test_a_stream_of_many_files_loses_no_row(spark, tmp_path):
    """Batches are cut at a border that is the same each time it is found: both halves together are the table."""
    spark.range(300_000).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + (id * 7919 % 300000) * 8640000) AS ts", "id % 9 AS user_id", "'click' AS event_type", "1D AS value").repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    rows = streams.live_tumbling(Tables(spark, str(tmp_path))).collect()
    assert sum(r.n for r in rows) == 300_000 and len(rows) == 30
    assert "percentile_approx" not in inspect.getsource(streams._ended)


def test_frames_without_rows_count(spark):
    """Of 4 videos all frames of the month are in the distribution, also those without a row of any kind."""
    rows = plans.QUERIES["per_frame_distribution"](spark, oracle.SF).collect()
    assert len(rows) == 4 and all(r.with_rows + r.without_rows >= 720 for r in rows)
