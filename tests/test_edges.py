"""Edge cases of scans, geometry, names, pixels and datasets on tables of a few rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotspark.functions import geometry, pixels, scores
from dotspark.operators import datasets, detectors, joins, metrics, regions, sequences, sets, stacking
from dotspark.sources import tables


def values(df):
    return [tuple(r) for r in df.collect()]


def test_csv_scan_keeps_extra_columns_and_drops_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Frame, X ,y,label\n1,2.5,3,a\nx,1,1,b\n2,,1,c\n3,4,5,d\n")
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"), {"frame": "long", "x": "double", "y": "double"})
    assert values(rows.select("frame", "x", "y", "label")) == [(1, 2.5, 3.0, "a"), (3, 4.0, 5.0, "d")]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), {"z": "long"})


def test_ground_truth_schemas(spark):
    boxes = spark.createDataFrame([("2.7", "3", "10", "10", "frame_009019.png"), ("1", "1", "1", "1", "clip2_00031.png"), ("1", "1", "1", "1", "none"), ("1", "1", "1", "1", "12.0")], "x string, y string, w string, h string, frame string")
    assert values(tables.normalize_gt(boxes)) == [(3, 3, 9019), (1, 1, 31), (1, 1, 12)]
    assert values(tables.normalize_gt(boxes, "first")) == [(3, 3, 9019), (1, 1, 2), (1, 1, 12)]
    assert values(tables.normalize_gt(spark.createDataFrame([(1, 2, 3)], "x int, y int, t int"))) == [(1, 2, 3)]
    with pytest.raises(ValueError, match="needs t, or"):
        tables.normalize_gt(boxes.drop("w"))


def test_frame_column_by_any_name(spark):
    rows = spark.createDataFrame([("1", None), (None, "7")], "` Frame_IDX` string, time string")
    assert values(tables.with_frame(rows)) == [("1",), ("7",)]
    with pytest.raises(ValueError, match="none of"):
        tables.with_frame(rows.select(F.lit(1).alias("z")))


def test_sinks_do_not_touch_what_is_read(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    root = str(tmp_path / "set")
    assert spark.read.parquet(tables.write_version(one, root, 1)).count() == 3
    assert spark.read.parquet(tables.write_version(two, root, 2)).count() == 5
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_version(two, root, 1)
    log = str(tmp_path / "log")
    for df in (one, two):
        tables.append_log(df, log)
    assert spark.read.json(log).count() == 8
    outcomes = spark.createDataFrame([(1.0, "tp", 1), (1.0, "fp", 2), (2.0, "tp", 3)], "threshold double, outcome string, x int")
    tables.write_outcomes(outcomes, str(tmp_path / "out"))
    assert (tmp_path / "out" / "threshold=1.0" / "outcome=fp").is_dir()


def test_change_log_bad_lines(spark):
    lines = ['{"timestamp": "a", "meta": {"actor": "x", "dry_run": true, "grp": "g", "pairs": ["v"]}, "had_error": false}', "{broken", '{"other": 1}', '{"timestamp": "b", "meta": {"actor": "x", "grp": "g", "pairs": ["v", "w"]}}']
    changes = tables.parse_change_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert changes.count() == 2
    assert sorted(values(tables.ingest_index(changes, ("x",)))) == [("g", "v", "b"), ("g", "w", "b")]


def test_coco_files(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 10, "height": 10}, {"id": 2, "file_name": "b.png", "width": 10, "height": 10}], "annotations": [{"image_id": 1, "bbox": [8, 8, 4, 4]}, {"image_id": 1, "bbox": [1, 2]}, {"image_id": 1, "bbox": [20, 20, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    got = {r.file_name: r.lines for r in tables.coco_labels(*tables.read_coco(spark, str(tmp_path / "c.json"))).collect()}
    assert got == {"a.png": ["0 0.9000000000 0.9000000000 0.2000000000 0.2000000000"], "b.png": []}


def test_clip_and_center(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    one = spark.range(1)
    assert values(one.select(*geometry.clip_box(*lit(18, -3, 5, 5, 20, 20)))) == [(18, 0, 2, 2)]
    assert values(one.select(geometry.to_center(F.lit(4), F.lit(3), F.lit(" Center ")), geometry.to_center(F.lit(4), F.lit(3), F.lit(None).cast("string")))) == [(4.0, 5.5)]


def test_scores(spark):
    got = spark.createDataFrame([(0.0, 0.0), (-1000.0, 1000.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double").select(scores.softmax_conf(F.col("a"), F.col("b")))
    assert [r[0] for r in got.collect()] == [0.5, 1.0, 0.5, 0.5]


def test_pixels(spark):
    rows = spark.createDataFrame([([0, 0, 0, 0],), ([0, 9, 9, 0],)], "p array<int>")
    got = rows.select(pixels.centroid(F.col("p"), 2, 2, 0, "middle").alias("c"), pixels.brightest_pixel(F.col("p"), 2).alias("b"))
    assert [(r.c.cx, r.c.cy, r.b.px, r.b.py) for r in got.collect()] == [(0.5, 0.5, 0, 0), (0.5, 0.5, 1, 0)]
    wrapped = rows.select(geometry.gather(F.col("p"), F.lit(2), F.lit(2), F.lit(-1), F.lit(0), 2, 2, "wrap"), geometry.gather(F.col("p"), F.lit(2), F.lit(2), F.lit(-1), F.lit(0), 2, 2, "pad"))
    assert values(wrapped)[1] == ([9, 0, 0, 9], [0, 0, 0, 9])


def test_labels_against_flood_fill():
    r = np.random.default_rng(2)
    for _ in range(30):
        mask = r.random((9, 11)) < 0.45
        for connectivity in (4, 8):
            got, seen, k = regions.label_mask(mask, connectivity), np.zeros(mask.shape, int), 0
            for y, x in zip(*np.nonzero(mask), strict=True):
                if seen[y, x]:
                    continue
                k, todo = k + 1, [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 9 and 0 <= b < 11 and mask[a, b] and not seen[a, b]:
                        seen[a, b] = k
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (connectivity == 8 or not (i and j))]
            assert (got == seen).all()


def test_backgrounds(spark):
    frames = spark.createDataFrame([(0, t, [10 * t, 5]) for t in range(5)], "video_id int, t long, pixels array<int>")
    ewma = {r.t: list(r.background) for r in stacking.ewma_background(frames, 0.5, tile=2).collect()}
    assert ewma == {1: [0.0, 5.0], 2: [5.0, 5.0], 3: [12.5, 5.0], 4: [21.25, 5.0]}
    small = {(r.t, r.tile): list(r.background) for r in stacking.ewma_background(frames, 0.5, tile=1).collect()}
    assert small[(4, 0)] == [21.25] and small[(4, 1)] == [5.0]
    assert values(stacking.stack_max(frames, 3).orderBy("t_start")) == [(0, 0, [20, 5]), (0, 3, [40, 5])]


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 3), (1, 4), (1, 9), (2, 0)], "video_id long, t long")
    spans = spark.createDataFrame([(1, 8), (2, 1), (3, 2)], "video_id long, n_frames int")
    assert sorted(values(sequences.free_ranges(rows, spans))) == [(1, 0, 2), (1, 5, 7), (3, 0, 1)]


def test_snapshots(spark):
    schema = "path string, size long, mtime_ns long, sha256 string"
    before = spark.createDataFrame([("same", 1, 1, "a"), ("gone", 1, 1, "a"), ("hash", 1, 1, "a"), ("time", 1, 1, None), ("size", 1, 1, "a"), ("touched", 1, 1, "a")], schema)
    after = spark.createDataFrame([("same", 1, 1, "a"), ("new", 1, 1, "a"), ("hash", 1, 1, "b"), ("time", 1, 2, None), ("size", 2, 1, "a"), ("touched", 1, 9, "a")], schema)
    assert dict(values(sets.snapshot_diff(before, after))) == {"gone": "removed", "new": "added", "hash": "modified", "time": "modified", "size": "modified"}


def test_splits(spark):
    rows = spark.range(103).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    got = datasets.split_stratified(rows, "id", "label").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {(1, "train"): 20, (1, "val"): 3, (1, "test"): 3, (0, "train"): 61, (0, "val"): 11, (0, "test"): 5}
    pairs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "name string, grp string")
    assert sorted(values(datasets.split_pairs(pairs, "name", 1.0, ["grp"]))) == [("a", "x", "train"), ("b", "x", "test"), ("c", "y", "train")]


def test_range_expansion_and_prefixes(spark):
    rows = spark.createDataFrame([(1, 5, 3, 2, 2), (2, 1, 1, 0, 2)], "id int, t_start int, t_end int, w int, h int")
    assert values(joins.expand_ranges(rows).select("id", "t").orderBy("t")) == [(1, 3), (1, 4), (1, 5)]
    names, stems = spark.createDataFrame([("a_b_c",), ("ab",), ("a",)], "name string"), spark.createDataFrame([("a",), ("a_b",), ("a",)], "stem string")
    assert dict(values(joins.prefix_pair(names, stems))) == {"a_b_c": "a_b", "ab": None, "a": "a"}


def test_best_threshold_ties(spark):
    rows = spark.createDataFrame([(3.0, 0.5, 2), (2.0, 0.5, 1), (1.0, 0.5, 1), (4.0, 0.4, 0)], "threshold double, f1 double, fp long")
    assert values(metrics.best_threshold(rows)) == [(1.0, 0.5, 1)]


def test_detectors(spark):
    image = np.zeros((12, 12), int)
    image[3:5, 4:7] = 200
    image[9, 1] = 90
    frames = spark.createDataFrame([(0, 0, image.ravel().tolist())], "video_id int, t long, pixels array<int>")
    found = values(detectors.detect(frames, "threshold", width=12, level=80, min_area=2).select("x", "y", "w", "h"))
    assert found == [(4, 3, 3, 2)]
    assert detectors.detect(frames, "log", width=12).count() >= 1
    masked = detectors.mask_boxes(frames, detectors.detect(frames, "threshold", width=12, level=80, min_area=2), 12)
    assert max(masked.first().pixels) == 90
    assert values(detectors.score_patches(frames, None).select("score")) == [(None,)]
