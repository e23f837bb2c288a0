"""Operators whose frames, videos or keys are dense: against plain versions, and with work that stays flat."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dotspark.operators import detectors, flows, matching, metrics, regions, stacking, tracks


def frame_of(spark, columns, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=columns.split()))


# nearest rows


def plain_nearest(rows, others):
    out = {}
    for v, t, i, x, y in rows:
        best = min((((x - a) ** 2 + (y - b) ** 2, j) for w, s, j, a, b in others if (w, s) == (v, t)), default=None)
        out[i] = (None, None) if best is None else (best[1], math.sqrt(best[0]))
    return out


@pytest.mark.parametrize("kind", ["even", "clustered", "one line"])
def test_nearest_in_dense_frames(spark, kind):
    r = np.random.default_rng(5)
    n = 300

    def place(k):
        if kind == "even":
            return r.uniform(0, 100, 2)
        if kind == "clustered":
            return r.normal(0, 0.01, 2) + (50, 50) if k % 3 else r.uniform(0, 1000, 2)
        return float(r.integers(0, 500)), 7.0

    others = [(0, 0, k, *place(k)) for k in range(n)] + [(0, 1, n + k, *r.uniform(0, 9, 2)) for k in range(5)]
    rows = [(0, 0, k, *(place(k) if k % 10 else r.uniform(-300, 300, 2))) for k in range(200)] + [(0, 1, 900, 1.0, 1.0), (0, 2, 901, 0.0, 0.0)]
    rows += [(0, 0, 950 + k, *others[k][3:]) for k in range(5)]  # on top of another
    got = matching.nearest(frame_of(spark, "video_id t a x y", rows), frame_of(spark, "video_id t b x y", others), "a", "b")
    want = plain_nearest(rows, others)
    found = {x.a: (x.b, x.distance) for x in got.collect()}
    assert found.keys() == want.keys()
    for i, (b, d) in want.items():
        assert found[i][0] == b and (d is None or abs(found[i][1] - d) < 1e-9)


def test_nearest_meets_as_many_in_denser_frames(spark):
    """With a hundred times the points in a frame a row still meets about as many of them."""
    met = []
    for n in (200, 20_000):
        r = np.random.default_rng(n)
        points = frame_of(spark, "video_id t _oid _ox _oy", [(0, 0, k, *r.uniform(0, 100, 2)) for k in range(n)])
        rows = frame_of(spark, "video_id t a x y", [(0, 0, k, *r.uniform(0, 100, 2)) for k in range(200)])
        dense = points.groupBy("video_id", "t").agg(F.count("_oid").alias("_n"), *(f(c).alias(f"_{f.__name__}{c}") for f in (F.min, F.max) for c in ("_ox", "_oy")))
        widths = matching.first_widths(points, dense)
        met.append(matching.ring_candidates(rows.join(widths, ["video_id", "t"]), points.join(widths, ["video_id", "t"])).count() / 200)
    assert met[1] < 2 * met[0] < 200


def test_nearest_without_places(spark):
    schema = "video_id long, t long, a long, x double, y double"
    many = frame_of(spark, "video_id t b x y", [(0, 0, k, float(k), 0.0) for k in range(100)])
    rows = spark.createDataFrame([(0, 0, 1, None, 2.0), (0, 0, 2, 5.2, 0.0), (0, 3, 3, None, None)], schema)
    assert {r.a: r.b for r in matching.nearest(rows, many, "a", "b").collect()} == {1: None, 2: 5, 3: None}


# regions


def test_regions_of_a_large_frame(spark):
    """One frame of a million pixels with a thousand seeds: the same as growing each seed by itself."""
    r = np.random.default_rng(2)
    side = 1000
    pixels = np.zeros((side, side), int)
    for _ in range(600):
        y, x, h, w = *r.integers(0, side - 40, 2), *r.integers(1, 40, 2)
        pixels[y : y + h, x : x + w] = 200
    seeds = [(0, 0, k, int(x), int(y)) for k, (x, y) in enumerate(r.integers(0, side, (1000, 2)))]
    frames = spark.createDataFrame([(0, 0, pixels.ravel().tolist())], "video_id int, t long, pixels array<int>")
    got = {row.k: (row.area, row.x, row.y, row.w, row.h) for row in regions.grow_region(frame_of(spark, "video_id t k sx sy", seeds), frames, side, 150, keep=["k"]).collect()}
    labels = regions.label_mask(pixels >= 150)
    corner = regions.label_mask(pixels[:150, :150] >= 150)
    assert (regions.spread_labels(pixels[:150, :150] >= 150)[corner > 0] == (np.unique(corner.ravel(), return_index=True)[1] + 1)[corner[corner > 0]]).all()
    for _, _, k, x, y in seeds:
        ys, xs = np.nonzero((labels == labels[y, x]) & (labels > 0) & (labels[y, x] > 0))
        assert got[k] == ((len(xs), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1) if len(xs) else (0, None, None, None, None))


def test_region_rows():
    r = np.random.default_rng(4)
    for connectivity in (4, 8):
        pixels = r.integers(0, 256, (30, 40))
        mask = pixels > 140
        labels = regions.label_mask(mask, connectivity)
        for label, area, x, y, w, h, cx, cy, mass in regions.regions(pixels, mask, connectivity):
            ys, xs = np.nonzero(labels == label)
            v = pixels[ys, xs]
            assert (area, x, y, w, h, mass) == (len(xs), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, v.sum())
            assert abs(cx - (xs * v).sum() / mass) < 1e-9 and abs(cy - (ys * v).sum() / mass) < 1e-9
    assert regions.regions(pixels, pixels > 999) == []


def test_crops_of_crowded_frames(spark, monkeypatch):
    """Lists of a few points each give the crops that points have alone."""
    monkeypatch.setattr(regions, "TOGETHER", 3)
    r = np.random.default_rng(6)
    frames = [(v, t, r.integers(0, 256, 48).tolist()) for v in range(2) for t in range(3)]
    rows = [(k % 2, k % 4, k, float(x), float(y)) for k, (x, y) in enumerate(r.uniform(-2, 10, (40, 2)))]
    held = {(v, t): np.array(p).reshape(6, 8) for v, t, p in frames}
    got = flows.with_crop(frame_of(spark, "video_id t k x y", rows), spark.createDataFrame(frames, "video_id int, t long, pixels array<int>"), 8, 6, 4).collect()
    assert sorted(g.k for g in got) == sorted(k for _, t, k, _, _ in rows if t < 3)
    for g in got:
        x0, y0 = (max(0, min(round(c - 2), n - 4)) for c, n in ((g.x, 8), (g.y, 6)))
        assert (g._x0, g._y0) == (x0, y0) and g.crop == held[(g.video_id, g.t)][y0 : y0 + 4, x0 : x0 + 4].ravel().tolist()


# folds and stacks over tiles


def video(r, n, size):
    return [(v, t, r.integers(0, 256, size).tolist()) for v in range(2) for t in range(n)]


@pytest.mark.parametrize("tile", [7, 4096])
def test_rolling_background(spark, tile):
    rows = video(np.random.default_rng(1), 9, 20)
    frames = spark.createDataFrame(rows, "video_id int, t long, pixels array<int>").repartition(4)
    for window, warm in ((1, 0), (3, 0), (4, 4), (50, 2)):
        got = stacking.glue(stacking.rolling_background(frames, window, warm, tile), ["video_id", "t"], "background").collect()
        assert sorted((g.video_id, g.t) for g in got) == [(v, t) for v in range(2) for t in range(warm, 9)]
        for g in got:
            seen = np.array([p for v, t, p in rows if v == g.video_id and g.t - window < t <= g.t])
            assert np.allclose(g.background, seen.mean(axis=0), atol=1e-9)


def test_stacks_of_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(stacking, "OPEN", 30)
    rows = video(np.random.default_rng(3), 10, 23)
    frames = spark.createDataFrame(rows, "video_id int, t long, pixels array<int>").repartition(5)
    for each, join, last, plain in ((lambda v: v, np.maximum, lambda v, n: v, lambda a: a.max(axis=0)), (lambda v: v, np.add, lambda v, n: np.floor(v / n), lambda a: np.floor(a.mean(axis=0)))):
        got = stacking._stack(frames, 4, each, join, last, tile=5).collect()
        assert sorted((g.video_id, g.t_start) for g in got) == [(v, t) for v in range(2) for t in (0, 4, 8)]
        for g in got:
            held = np.array([p for v, t, p in rows if v == g.video_id and t // 4 * 4 == g.t_start])
            assert g.pixels == plain(held).astype(int).tolist()
    assert stacking.stack_max(frames.where("false"), 4).collect() == []


# detectors against plain versions


def plain_regions(pixels, cut):
    """Boxes of 8-connected regions above ``cut`` by flood fill, with the centroid."""
    height, width = pixels.shape
    seen, out = np.zeros(pixels.shape, bool), []
    for y in range(height):
        for x in range(width):
            if pixels[y, x] > cut and not seen[y, x]:
                todo, cells = [(y, x)], []
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    cells.append((a, b))
                    for i in range(max(0, a - 1), min(height, a + 2)):
                        for j in range(max(0, b - 1), min(width, b + 2)):
                            if pixels[i, j] > cut and not seen[i, j]:
                                seen[i, j] = True
                                todo.append((i, j))
                ys, xs = map(np.array, zip(*cells, strict=True))
                v = pixels[ys, xs]
                out.append((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, round((xs * v).sum() / v.sum(), 5), round((ys * v).sum() / v.sum(), 5), round(pixels[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1].max() / 255, 6)))
    return out


def found_boxes(df):
    return sorted((r.video_id, r.t, r.x, r.y, r.w, r.h, round(r.cx, 5), round(r.cy, 5), round(r.confidence, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def clip(spark):
    rows = video(np.random.default_rng(8), 12, 48)
    return rows, spark.createDataFrame(rows, "video_id int, t long, pixels array<int>").repartition(3)


def test_background_detectors(clip):
    rows, frames = clip
    rolling, ewma = [], []
    for v in range(2):
        own = [np.array(p, float) for w, _, p in rows if w == v]
        state = own[0]
        for t, p in enumerate(own):
            if t >= 5:
                lit = np.maximum(0, np.floor(p - np.mean(own[t - 4 : t + 1], axis=0)))
                rolling += [(v, t, *b) for b in plain_regions(lit.reshape(6, 8), 40)]
            if t:
                lit = np.maximum(0, np.floor(p - state))
                ewma += [(v, t, *b) for b in plain_regions(lit.reshape(6, 8), 40)]
                state = 0.8 * state + 0.2 * p
    assert found_boxes(detectors.detect(frames, "rolling", width=8)) == sorted(rolling)
    assert found_boxes(detectors.detect(frames, "ewma", width=8)) == sorted(ewma)


def test_log_detector(clip):
    """Laplacian of a Gaussian, pixel by pixel."""
    rows, frames = clip
    want = []
    for v, t, flat in rows:
        p = np.array(flat, float).reshape(6, 8)
        for sigma in (1.0, 1.6):
            reach = max(1, int(3 * sigma + 0.5))
            g = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
            g /= g.sum()
            wide = np.pad(p, reach, mode="symmetric")
            smooth = np.array([[(wide[y : y + 2 * reach + 1, x : x + 2 * reach + 1] * np.outer(g, g)).sum() for x in range(8)] for y in range(6)])
            e = np.pad(smooth, 1, mode="edge")
            response = np.array([[sigma**2 * (4 * e[y + 1, x + 1] - e[y, x + 1] - e[y + 2, x + 1] - e[y + 1, x] - e[y + 1, x + 2]) for x in range(8)] for y in range(6)])
            d = int(np.ceil(sigma * 2**0.5))
            for y in range(6):
                for x in range(8):
                    around = response[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
                    if response[y, x] == around.max() and response[y, x] > 0 and response[y, x] >= 0.5 * response.max():
                        x0, y0, x1, y1 = max(0, x - d), max(0, y - d), min(8, x + d + 1), min(6, y + d + 1)
                        want.append((v, t, x0, y0, x1 - x0, y1 - y0, float(x), float(y), round(response[y, x] / response.max(), 6)))
    assert found_boxes(detectors.detect(frames, "log", width=8)) == sorted(want)


def test_detectors_by_name(clip):
    _, frames = clip
    for name in detectors.DETECTORS:
        plain = detectors.DETECTORS[name](frames, 8, **({"level": 60} if name != "log" else {}))
        assert found_boxes(detectors.detect(frames, name, width=8, level=60, no_such_option=1)) == found_boxes(plain)


def test_redetect(clip):
    """Rounds by hand: black out the boxes, detect, keep what is far from all that is known, the earlier id first."""
    rows, frames = clip
    first = detectors.detect(frames, "threshold", width=8, level=220)
    from dotspark.sources.scratch import materialise

    got = detectors.redetect(frames, first, 8, 2, 2.0, "threshold", materialise, level=200).collect()
    assert {r["round"] for r in got} == {0, 1, 2} or {r["round"] for r in got} == {0, 1}
    for v, t, flat in rows:
        known = [r for r in got if (r.video_id, r.t) == (v, t)]
        p = np.array(flat).reshape(6, 8)
        assert sorted((r.x, r.y, r.w, r.h) for r in known if r["round"] == 0) == sorted(b[:4] for b in plain_regions(p, 220))
        for n in (1, 2):
            before = [r for r in known if r["round"] < n]
            dark = p.copy()
            for r in before:
                dark[r.y : r.y + r.h, r.x : r.x + r.w] = 0
            new = {b[:4]: b for b in plain_regions(dark, 200)}
            kept = [r for r in known if r["round"] == n]
            assert all((r.x, r.y, r.w, r.h) in new for r in kept)
            near = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]) <= 2.0
            taken = [(r.cx, r.cy) for r in before + kept]
            for k, r in enumerate(kept):
                assert not any(near((r.cx, r.cy), p) for p in [(s.cx, s.cy) for s in before] + [(s.cx, s.cy) for s in kept[:k]])
            assert all(any(near(b[4:6], p) for p in taken) for b in new.values())  # nothing far was left out


def test_scorers(clip):
    _, frames = clip
    column = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(p)
    batch = detectors.in_batches(lambda many: many.mean(axis=1))
    more = frames.unionByName(frames.limit(1).withColumn("pixels", F.lit(None).cast("array<int>"))).unionByName(frames.limit(1).withColumn("pixels", F.array(F.lit(3))))
    one, two = (sorted((r.t, r.score is None, r.score or 0) for r in detectors.score_patches(more, f).collect()) for f in (column, batch))
    assert [x[:2] for x in one] == [x[:2] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two]) and sum(x[1] for x in one) == 1


# track linking


def plain_links(part, max_gap, radius):
    """Greedy linking with all pairs of a frame."""
    active, out = [], {}
    for t, frame in part.sort_values(["t", "det_id"]).groupby("t"):
        points = list(zip(frame["det_id"].tolist(), frame["x"].tolist(), frame["y"].tolist(), strict=True))
        pairs = sorted((math.hypot(x - a[2], y - a[3]) + 0.5 * (t - a[1]), i, a[0]) for i, (_, x, y) in enumerate(points) for a in active if 0 < t - a[1] <= max_gap and math.hypot(x - a[2], y - a[3]) <= radius * max(1, t - a[1]))
        linked, used = {}, set()
        for _, i, name in pairs:
            if i not in linked and name not in used:
                linked[i] = name
                used.add(name)
        for i, (det, x, y) in enumerate(points):
            name = linked.get(i, det)
            active = [a for a in active if a[0] != name] + [(name, t, x, y)]
            out[det] = name
    return out


@pytest.mark.parametrize(("span", "radius"), [(10, 1.0), (60, 2.0), (400, 1.5)])
def test_links_of_dense_keys(spark, span, radius):
    r = np.random.default_rng(span)
    rows = pd.DataFrame({"video_id": r.integers(0, 2, 1500), "obj_id": 0, "t": r.integers(0, 120, 1500), "det_id": r.permutation(1500), "x": r.uniform(-span, span, 1500).round(2), "y": r.uniform(0, span, 1500).round(2)})
    got = {x.det_id: x.track_id for x in tracks.link_tracks(spark.createDataFrame(rows).repartition(5), 3, radius).collect()}
    want = {}
    for _, part in rows.groupby("video_id"):
        want |= plain_links(part, 3, radius)
    assert got == want


def test_segments_part_a_dense_key(spark):
    """Objects that stay apart in space are linked apart, though the key has a row in every frame."""
    rows = frame_of(spark, "video_id obj_id t det_id x y", [(0, 0, t, 10 * t + k, 100.0 * k, 50.0 * (k % 3)) for t in range(200) for k in range(5)])
    parted = tracks.segments(rows, 3, 2.0, ("video_id", "obj_id"))
    assert parted.select("_segment").distinct().count() == 5 and parted.count() == 1000


def test_open_tracks_are_all_that_is_held():
    """A hundred thousand frames: what a linker holds follows the tracks that are open."""
    linker, most = tracks.Linker(3, 2.0), 0
    for t in range(100_000):
        linker.frame(t, [(4 * t + k, 50.0 * k + (t % 2), 0.0) for k in range(3)] + ([(4 * t + 3, 1e6 + t, 0.0)] if t % 5 == 0 else []))
        most = max(most, len(linker.open))
    assert most <= 5


# sketches


def test_sketched_quantiles(spark):
    """The rank of each quartile is within the stated error, over many tasks and a skewed key."""
    rows = spark.range(200_000, numPartitions=16).select((F.col("id") % 100 == 0).cast("int").alias("k"), F.pow(F.rand(3), F.lit(4.0)).alias("v"))
    pandas = rows.toPandas()
    for r in metrics.sketched_distribution(rows, ["k"], "v").collect():
        v = np.sort(pandas.v[pandas.k == r.k].to_numpy())
        assert r.n == len(v) and (r.min, r.max) == (v[0], v[-1])
        for q, got in ((0.25, r.p25), (0.5, r.p50), (0.75, r.p75)):
            assert abs(np.searchsorted(v, got) / len(v) - q) <= metrics.sketch_error() + 1 / len(v)
    none = spark.createDataFrame([(1, None)], "k long, v double")
    assert metrics.sketched_distribution(none, ["k"], "v").select("n", "p50").first() == (0, None)
