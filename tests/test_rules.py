"""Rules with values worked out by hand, edges included."""

import pytest
from pyspark.sql import functions as F

from dotspark.functions import geometry, naming
from dotspark.operators import joins, metrics, tracks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ((18.0, 18.0, 10, 10, 20, 20), (10, 10, 10, 10)),  # shifted at the edge, not shrunk
        ((3.5, 4.5, 2, 2, 20, 20), (2, 4, 2, 2)),  # 2.5 and 3.5 round to even
        ((-5.0, 30.0, 4, 4, 20, 20), (0, 16, 4, 4)),
        ((10.0, 10.0, 30, 0, 20, 20), (0, 10, 20, 1)),  # wider than the frame; empty becomes 1
        ((10.0, 10.0, 2.5, 3.5, 20, 20), (9, 8, 2, 4)),  # sizes round to even too
    ],
)
def test_crop_box(spark, given, want):
    assert one(spark, *geometry.crop_box(*lits(*given))) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [((18, -3, 5, 5, 20, 20), (15, 0, 5, 5)), ((3, 3, 30, 0, 20, 20), (0, 3, 20, 1)), ((7.9, 2.2, 3.9, 2.0, 20, 20), (7, 2, 3, 2))],
)
def test_clamp_box(spark, given, want):
    assert one(spark, *geometry.clamp_box(*lits(*given))) == want


def test_min_square(spark):
    # From (2, 3) to the far column 9: 2 * 7 + 1 = 15 wide, corner at 2 - 7.5 = -5.5 and 3 - 7.5 = -4.5, to even.
    assert one(spark, geometry.min_square(*lits(2.0, 3.0, 1, 2, 9, 4)))[0] == (15, -6, -4)
    # A center outside the box: distances count without sign.
    assert one(spark, geometry.min_square(*lits(0.0, 0.0, 4, 0, 1, 1)))[0].side == 9


@pytest.mark.parametrize(
    ("curve", "options", "want"),
    [
        ([0, 5, 1], {}, False),  # one step a side
        ([0, 0, 0, 1, 0, 0, 0], {}, False),  # smoothed to 1/3 thrice: one rise before the first of them
        ([0, 2, 4, 6, 4, 2, 0], {}, True),
        ([0, 2, 4, 6, 4, 2, 0], {"window": 1}, True),
        ([0, 2, 4, 6, 4, 2, 0], {"edge_low": 0.5}, False),  # peak 3 is not beyond floor(3.0)
        ([0, 2, 4, 6, 4, 2, 0], {"edge_high": 0.5}, False),  # nor before ceil(3.0)
        ([9, 2, 3, 1, 2, 0, 1], {"window": 1}, False),  # peak at the start
        ([1, 1, 2, 2, 3, 3, 2, 2, 1, 1], {"window": 1}, True),  # flat steps do not count
        ([0, 3, 1, 4, 2, 5, 0, 1, 0, 1, 0], {"window": 1, "monotone": 0.7}, False),  # 3 of 5 rise
        ([4, 4], {"window": 1}, False),
    ],
)
def test_hill(spark, curve, options, want):
    rows = spark.createDataFrame([(1, i, i, float(v)) for i, v in enumerate(curve)], "track_id long, t long, det_id long, v double")
    assert tracks.hill_shape(rows, "v", **options).first().is_hill is want


@pytest.mark.parametrize(("curve", "window", "want"), [([1, 3], 3, [1, 3]), ([1, 3, 8], 1, [1, 3, 8]), ([1, 3, 8], 3, [2, 4, 5.5]), ([0, 0, 9, 0], 2, [0, 3, 3, 4.5])])
def test_moving_average(spark, curve, window, want):
    rows = spark.createDataFrame([(1, i, i, float(v)) for i, v in enumerate(curve)], "track_id long, t long, det_id long, v double")
    assert [r.smooth for r in tracks.moving_average(rows, "v", window).orderBy("t").collect()] == want


def test_class_weights(spark):
    rows = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    got = metrics.class_weights(rows, "label", spark.range(3).select(F.col("id").cast("int").alias("label")))
    assert sorted(map(tuple, got.collect())) == [(0, 6, 8 / 6), (1, 2, 4.0), (2, 0, 0.0)]


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (naming.safe_name, "  a _ b//c__(d) ", "a_b_c_d"),
        (naming.safe_name, "_x.-y_", "x.-y"),
        (naming.slug, " Today_s  Take (1)/day ", "today-s-take-1-day"),
        (naming.slug, "--A__b--", "a-b"),
        (naming.stem, "/v/clip.1.MP4", "clip.1"),
        (naming.stem, "/v/clip.tar.gz", "clip.tar.gz"),
        (naming.file_stem, "/v/clip.tar.gz", "clip.tar"),
        (naming.file_stem, "/v/.hidden", ".hidden"),
        (naming.parse_frame, "12.7", 13),
        (naming.parse_frame, " 12.5 ", 12),
        (naming.parse_frame, "run7/frame_0031_b2.png", 2),
        (naming.parse_frame, "run7/frame", None),
        (naming.parse_frame, "nan", None),
        (lambda c: naming.parse_frame(c, "first"), "run7/frame", 7),
        (naming.label_from_name, "a/clip_nonnegative.csv", "positive"),
        (naming.label_from_name, "a/clip_Negative.csv", "negative"),
        (naming.label_from_name, "a/clip-negative.csv", "negative"),
        (naming.label_from_name, "a/clip_negative_x.csv", "positive"),
        (lambda c: naming.label_from_name(c, F.lit("clip_negative")), "a/clip_negative.csv", "positive"),
        (lambda c: naming.label_from_name(c, F.lit("clip (negative)")), "a/clip_negative_negative.csv", "negative"),
        (naming.route_hint, "Today's Take/day", "day"),
        (naming.route_hint, "day & night_time", "conflict"),
        (naming.route_hint, "nightly", None),
    ],
)
def test_names(spark, fn, text, want):
    assert one(spark, fn(F.lit(text))) == (want,)


def test_short_key(spark):
    import hashlib

    name = "x" * 119 + " (" + "y" * 20
    safe = "x" * 119 + "_" + "y" * 20
    # The cut falls behind the underscore, which goes.
    assert one(spark, naming.short_key(F.lit("a b"), F.lit(name))) == ("a_b__" + "x" * 119 + "__" + hashlib.sha1(safe.encode()).hexdigest()[:10],)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tp=3 fp=1 fn=0", ("ok", "", 3, 1, 0, 0.75, 1.0, 0.75, 6 / 7)),
        ("tp=3 fp=1 fn=1 precision=0.5 recall=9 f1=0.25", ("ok", "", 3, 1, 1, 0.5, 0.75, 0.6, 0.25)),
        ("tp=0 fp=0 fn=0", ("ok", "", 0, 0, 0, 0.0, 0.0, 0.0, 0.0)),
        ("tp=1 fp=2", ("error", "unable to parse metric summary: tp=1 fp=2") + (None,) * 7),
        ("tp=1.0 fp=2 fn=1", ("error", "unable to parse metric summary: tp=1.0 fp=2 fn=1") + (None,) * 7),
        ("ERROR: x=y ", ("error", "x=y") + (None,) * 7),
        ("  ", ("not_run", "") + (None,) * 7),
        (None, ("not_run", "") + (None,) * 7),
    ],
)
def test_metric_text(spark, text, want):
    assert tuple(one(spark, naming.parse_metrics(F.lit(text).cast("string")))[0]) == want


def test_slim_table(spark):
    rows = spark.createDataFrame([(0, 1, 2.5, 3.5, "positive", 1, 10), (0, 1, 2.4, 4.4, " POSITIVE", 2, 20), (0, 1, 9.0, 9.0, "negative", 3, 30), (0, 1, 8.0, 8.0, None, 4, 40)], "video_id long, t long, x double, y double, class string, id long, v long")
    assert [tuple(r) for r in joins.rebuild_slim(rows, "id", ["v"]).collect()] == [(0, 1, 2, 4, 20)]
    assert joins.rebuild_slim(rows.drop("class"), "id", ["v"]).count() == 3


def test_groups_in_paths(spark):
    paths = spark.createDataFrame([("/x/Pyralis Day/1",), ("/x/mypyralises",), ("/y",)], "path string")
    groups = spark.createDataFrame([("pyralis",), ("Pyralis_day",), ("x",), ("!",)], "grp string")
    assert dict(map(tuple, joins.token_groups(paths, groups).collect())) == {"/x/Pyralis Day/1": "Pyralis_day", "/x/mypyralises": "pyralis", "/y": None}


def test_catalog_labels(spark):
    videos = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "n")], "grp string, stem string")
    got = joins.catalog_label(videos, spark.createDataFrame([("a", "s")], "grp string, stem string"))
    assert sorted((r.grp, r.stem, r.label, r.same_group) for r in got.collect()) == [("a", "s", "training", True), ("b", "n", "inference", False), ("b", "s", "training", False)]


@pytest.mark.parametrize(
    ("held", "incoming", "want"),
    [
        ([], ["A"], [("copy", "s")]),
        ([("s", "A")], ["A"], [("skip", None)]),
        ([("s", "A")], ["B"], [("rename", "s__src_web")]),
        ([("s", "A"), ("s__src_web", "B")], ["B"], [("skip", None)]),
        ([("s", "A"), ("s__src_web", "B")], ["C"], [("rename", "s__src_web__dup2")]),
        ([("s", "A"), ("s__src_web__dup2", "B")], ["B"], [("rename", "s__src_web")]),  # the free name comes first
        ([("s", "A"), ("s__src_web__dup2", "B")], ["C", "B"], [("rename", "s__src_web"), ("skip", None)]),  # filled by then
        ([("s", "A"), ("s__src_web__dup2", "B")], ["C", "D"], [("rename", "s__src_web"), ("rename", "s__src_web__dup3")]),
        ([], ["A", "A", "B"], [("copy", "s"), ("skip", None), ("rename", "s__src_web")]),
    ],
)
def test_collisions(spark, held, incoming, want):
    existing = spark.createDataFrame(held, "stem string, hash string")
    rows = spark.createDataFrame([(f"in/{i}", "s", h) for i, h in enumerate(incoming)], "path string, stem string, hash string")
    got = joins.collision_plan(rows, existing, "web").orderBy("path").collect()
    assert [(r.action, r.target) for r in got] == want


def test_group_rollup(spark):
    rows = spark.createDataFrame([("a", "ok", None, 3, 1, 0), ("a", "error", "e", None, None, None), ("a", "empty", None, None, None, None)], "grp string, status string, error string, tp long, fp long, fn long")
    r = metrics.group_rollup(rows).first()
    assert (r.videos_total, r.n_ok, r.n_error, r.status, r.errors, r.precision, r.recall, r.accuracy) == (3, 1, 1, "partial", "e", 0.75, 1.0, 0.75)
