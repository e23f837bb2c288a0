"""Whole flows, and queries that SQL cannot say, against plain versions of the same steps."""

import json
import math
import struct

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from dotspark import plans
from dotspark.operators import detectors, flows, metrics
from dotspark.plans.registry import Tables
from tests import oracle
from tests.test_dense import plain_links, plain_regions

SIDE = 8


def spark_hash(*parts):
    """xxhash64 of (kind, value) pairs, i for int and q for long and d for double, as Spark chains them."""
    seed = 42
    for kind, v in parts:
        seed = xxhash.xxh64(struct.pack("<" + kind, v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def corner(c, size):
    return max(0, min(round(c - size / 2), SIDE - size))


def crop(p, x, y, size):
    x0, y0 = corner(x, size), corner(y, size)
    return x0, y0, p[y0 : y0 + size, x0 : x0 + size]


def centroid(patch, sigma):
    n = len(patch)
    ys, xs = np.mgrid[:n, :n]
    mass = patch * np.exp(-((xs - (n - 1) / 2) ** 2 + (ys - (n - 1) / 2) ** 2) / (2 * sigma**2))
    return ((mass * xs).sum() / mass.sum(), (mass * ys).sum() / mass.sum()) if mass.sum() > 0 else (n / 2, n / 2)


def largest(patch, floor):
    return max((sum(1 for _ in r) for r in [cells(patch, floor, b) for b in plain_regions(patch, floor)]), default=0)


def cells(patch, floor, box):
    """The pixels above ``floor`` that are reached from a box's own region: by flood fill from each of them."""
    x, y, w, h = box[:4]
    best = []
    for sy in range(y, y + h):
        for sx in range(x, x + w):
            if patch[sy, sx] > floor:
                seen, todo = {(sy, sx)}, [(sy, sx)]
                while todo:
                    a, b = todo.pop()
                    for i in range(max(0, a - 1), min(len(patch), a + 2)):
                        for j in range(max(0, b - 1), min(patch.shape[1], b + 2)):
                            if patch[i, j] > floor and (i, j) not in seen:
                                seen.add((i, j))
                                todo.append((i, j))
                best = max(best, sorted(seen), key=len)
    return best


def parts(rows, radius):
    """Rows (x, y, ...) in chains of neighbours."""
    left, out = list(range(len(rows))), []
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            a = todo.pop()
            group.append(a)
            near = [b for b in left if (rows[a]["x"] - rows[b]["x"]) ** 2 + (rows[a]["y"] - rows[b]["y"]) ** 2 <= radius**2]
            left = [b for b in left if b not in near]
            todo += near
        out.append([rows[k] for k in group])
    return out


def plain_refine(v, t, p):
    key = lambda b: spark_hash(("i", v), ("q", t), *(("i", int(n)) for n in b[:4]))
    known = plain_regions(p, 150)
    dark = p.copy()
    for x, y, w, h, *_ in known:
        dark[y : y + h, x : x + w] = 0
    far = lambda b, others: all((b[4] - o[4]) ** 2 + (b[5] - o[5]) ** 2 > 4 for o in others)
    fresh = []
    for b in sorted((b for b in plain_regions(dark, 120) if far(b, known)), key=key):
        if far(b, fresh):
            fresh.append(b)
    rows = []
    for b in known + fresh:
        if b[2] * b[3] >= 2:
            x0, y0, patch = crop(p, b[4], b[5], 3)
            if patch.max() >= 180:
                cx, cy = centroid(patch, 2.0)
                rows.append({"id": key(b), "x": b[4], "y": b[5], "weight": int(patch.sum()), "cx": x0 + cx, "cy": y0 + cy})
    kept = [min(group, key=lambda r: (-r["weight"], r["id"])) for group in parts(rows, 2.0)]
    kept = [{"id": r["id"], "x": r["cx"], "y": r["cy"], "weight": r["weight"], "kind": 0} for r in kept]
    gate = lambda rs: [r for r in rs if largest(crop(p, r["x"], r["y"], 3)[2], 150) >= 2]
    kept = gate(kept)
    grown = []
    for r in kept:
        sx, sy = (min(max(round(c), 0), SIDE - 1) for c in (r["x"], r["y"]))
        if p[sy, sx] >= 190:
            for b in plain_regions(p, 189):
                own = cells(p, 189, (sx, sy, 1, 1))
                ys, xs = zip(*own, strict=True)
                box = (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
                if b[:4] == box and max(box[2:]) >= 3:
                    grown.append({"id": -r["id"] - 1, "x": box[0] + (box[2] - 1) / 2, "y": box[1] + (box[3] - 1) / 2, "weight": r["weight"] * len(own), "kind": 1})
                    break
    out = []
    for group in parts(kept + grown, 2.0):
        some = [r for r in group if r["kind"]]
        out += [min(some, key=lambda r: (-r["weight"], r["id"]))] if some else group
    slim = {}
    for r in sorted(gate(out), key=lambda r: r["id"]):
        slim[round(r["x"]), round(r["y"])] = r["weight"]
    return {(v, t, x, y, w) for (x, y), w in slim.items()}


def blobs(r, n):
    """Frames with bright spots of different sizes on noise."""
    out = []
    for t in range(n):
        p = r.integers(0, 110, (SIDE, SIDE))
        for _ in range(r.integers(1, 5)):
            y, x, h, w = *r.integers(0, SIDE, 2), *r.integers(1, 5, 2)
            p[y : y + h, x : x + w] = r.integers(125, 256)
        out.append((int(t % 2), t // 2, p))
    return out


def frames_of(spark, made):
    return spark.createDataFrame([(v, t, p.ravel().tolist()) for v, t, p in made], "video_id int, t long, pixels array<int>").repartition(3)


def test_refine(spark):
    made = blobs(np.random.default_rng(11), 80)
    got = {(r.video_id, r.t, r.x, r.y, r.weight) for r in flows.refine(frames_of(spark, made), SIDE, SIDE).collect()}
    want = set().union(*(plain_refine(v, t, p) for v, t, p in made))
    assert len(want) > 30 and got == want


def test_refine_takes_a_scorer(spark):
    made = frames_of(spark, blobs(np.random.default_rng(12), 20))
    none = flows.refine(made, SIDE, SIDE, scorer=lambda crop: F.lit(0.1) * F.size(crop) * 0)
    assert none.count() == 0
    model = detectors.in_batches(lambda many: (many.max(axis=1) >= 200).astype(float))
    column = lambda crop: F.when(F.array_max(crop) >= 200, 1.0).otherwise(0.0)
    rows = [sorted((r.video_id, r.t, r.x, r.y, r.weight) for r in flows.refine(made, SIDE, SIDE, scorer=s).collect()) for s in (model, column)]
    assert rows[0] == rows[1] != []


def plain_hill(values, window, edge_low, edge_high, min_up, min_down, monotone):
    n = len(values)
    smooth = [float(v) for v in values] if window <= 1 or n <= 2 else [round(float(np.mean(values[max(0, i - window // 2) : i + window // 2 + 1])), 9) for i in range(n)]
    if n < 3:
        return False
    peak, steps = int(np.argmax(smooth)), np.diff(smooth)
    up, down = steps > 1e-6, steps < -1e-6
    rise, fall = up[:peak].sum(), down[peak:].sum()
    before, after = (up | down)[:peak].sum(), (up | down)[peak:].sum()
    return bool(math.floor(edge_low * (n - 1)) < peak < math.ceil(edge_high * (n - 1)) and before and after and rise >= min_up and fall >= min_down and rise >= monotone * before and fall >= monotone * after)


@pytest.mark.parametrize("hill", [{}, {"window": 1, "edge_low": 0.0, "edge_high": 1.0, "min_up": 1, "min_down": 1}], ids=["default", "loose"])
def test_track_ranges(spark, hill):
    r = np.random.default_rng(13)
    made = blobs(r, 120)
    held = {(v, t): p for v, t, p in made}
    ranges = [(int(r.integers(0, 2)), int(r.integers(0, 3)), k, int(a := r.integers(0, 55)), int(a + r.integers(-4, 6)), float(r.uniform(0, 8)), float(r.uniform(0, 8)), int(r.integers(0, 4)), 2) for k in range(60)]
    rows = []
    for v, obj, k, a, b, x, y, w, _ in ranges:
        for t in range(min(a, b), max(a, b) + 1) if w else ():
            if (v, t) in held:
                x0, y0, patch = crop(held[v, t], x, y, 4)
                if patch.max() >= 100:
                    py, px = np.unravel_index(patch.argmax(), patch.shape)
                    x1, y1, own = crop(held[v, t], float(x0 + px), float(y0 + py), 4)
                    cx, cy = centroid(own, 1.5)
                    rows.append((v, obj, spark_hash(("q", v), ("q", obj), ("q", k), ("q", t)), t, float(x0 + px), float(y0 + py), float(own.sum()), round(x1 + cx, 6), round(y1 + cy, 6)))
    table = pd.DataFrame(rows, columns="video_id obj_id det_id t x y weight cx cy".split())
    links = {}
    for _, part in table.groupby(["video_id", "obj_id"]):
        links |= plain_links(part, 3, 8.0)
    table["track"] = table.det_id.map(links)
    options = {"window": 3, "edge_low": 0.1, "edge_high": 0.9, "min_up": 2, "min_down": 2, "monotone": 0.6} | hill
    want = []
    for name, track in table.sort_values(["t", "det_id"]).groupby("track"):
        values = track.weight.to_numpy()
        if len(values) >= 3 and np.ptp(values) >= 20 and plain_hill(values, **options):
            want += [(name, x, y, t) for x, y, t in zip(track.cx, track.cy, track.t, strict=True)]
    source = spark.createDataFrame(ranges, "video_id long, obj_id long, det_id long, t_start long, t_end long, x double, y double, w int, h int")
    got = [(g.track_id, round(g.x, 6), round(g.y, 6), g.t) for g in flows.track_ranges(source, frames_of(spark, made), SIDE, SIDE, bright=100, **hill).collect()]
    assert sorted(got) == sorted(want) and (want or not hill)


pytest_tables = pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")


@pytest_tables
def test_summaries(spark):
    """Both forms of the summary hold exactly the outcome rows and their counts."""
    t = Tables(spark, oracle.SF)
    rows = [r.asDict() for r in metrics.outcomes(t.gt, t.pred, 10.0).collect()]
    nested = plans.QUERIES["summary_nested"](spark, oracle.SF).collect()
    texts = [json.loads(r.document) for r in plans.QUERIES["summary_json"](spark, oracle.SF).collect()]
    cells = lambda k: sorted((r["t"], r["gt_id"] or -1, r["det_id"] or -1, round(r["distance"] or -1, 3)) for r in rows if r["outcome"] == k)
    for k in ("tp", "fp", "fn"):
        assert sorted((c.t, c.gt_id or -1, c.det_id or -1, round(c.distance or -1, 3)) for r in nested for c in r[k]) == cells(k)
        assert sorted((c["t"], c.get("gt_id") or -1, c.get("det_id") or -1, round(c.get("distance") or -1, 3)) for d in texts for c in d[k]) == cells(k)
        assert sum(r.counts[k] for r in nested) == sum(d["counts"][k] for d in texts) == len(cells(k))
    assert all(r.part == c.t // 24 for r in nested for k in ("tp", "fp", "fn") for c in r[k])


@pytest_tables
def test_links_of_the_tables(spark):
    """Batch and live linking of the events agree with the plain version."""
    rows = plans.components._objects(Tables(spark, oracle.SF)).toPandas()
    want = {}
    for _, part in rows.groupby(["video_id", "obj_id"]):
        want |= plain_links(part, 3, 8.0)
    assert {r.det_id: r.track_id for r in plans.QUERIES["link_tracks"](spark, oracle.SF).collect()} == want
    live = {r.det_id: r.track_id for r in plans.QUERIES["live_link_tracks"](spark, oracle.SF).collect()}
    assert {k: v for k, v in live.items() if k in want} == want


def test_patch_model(spark):
    """Classes that a plane parts are learned; the chosen epoch is the best on the validation rows, the earlier of equals."""
    r = np.random.default_rng(3)
    rows = [(k % 2, ("train", "val", "test")[k % 3], (r.integers(0, 100, 16) + (100 if k % 2 else 0)).tolist()) for k in range(240)]
    weights = spark.createDataFrame([(0, 1.0), (1, 1.0)], "label int, weight double")
    got = detectors.patch_model(spark.createDataFrame(rows, "label int, split string, features array<int>"), "label", weights, epochs=(1, 4, 12)).collect()
    assert {(g.epoch, g.split, g.n) for g in got} == {(e, s, 80) for e in (1, 4, 12) for s in ("train", "val", "test")}
    val = {g.epoch: g.accuracy for g in got if g.split == "val"}
    assert {g.epoch for g in got if g.chosen} == {min(val, key=lambda e: (-val[e], e))}
    assert all(g.accuracy > 0.95 for g in got if g.epoch == 12)
